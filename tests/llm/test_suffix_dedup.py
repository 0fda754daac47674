"""Suffix arrays against sorted suffixes, and byte-exact removal against a plain count of all strings."""

import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textscan.llm import suffix_dedup
from textscan.llm.suffix_groups import suffix_arrays


def test_suffix_arrays():
    rng = random.Random(1)
    for _ in range(200):
        texts = [[rng.randint(1, rng.choice([1, 2, 3, 9])) for _ in range(rng.randint(0, 60))] + [0] for _ in range(rng.randint(1, 6))]
        sizes = np.array([len(t) for t in texts])
        base = np.cumsum(sizes) - sizes
        want = [b + i for t, b in zip(texts, base, strict=True) for i in sorted(range(len(t)), key=lambda i: t[i:])]  # noqa: B023
        assert suffix_arrays(np.array(sum(texts, []), np.uint16), sizes).tolist() == want
    assert suffix_arrays(np.array([], np.uint16), np.array([], np.int64)).tolist() == []


def plain(rows, length):
    """(id, bytes, removed, stretches, digest) by counting all strings."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[k : k + length] for _, b in texts for k in range(len(b) - length + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for k in range(len(b) - length + 1):
            if count[b[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        starts = sum(1 for k, g in enumerate(gone) if g and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), starts, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def tangled(seed):
    """Texts of shared passages in changing surroundings, near copies, periods and copies."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdéß日") for _ in range(rng.randint(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rng.randint(20, 90)) for _ in range(6)]
    base = prose(150)
    rows = []
    for _ in range(60):
        rows.append(" ".join([prose(rng.randint(0, 30)), rng.choice(passages), prose(rng.randint(0, 30)), rng.choice(passages)]))
        words = base.split(" ")
        words[rng.randrange(len(words))] = word()
        rows.append(" ".join(words))
    rows += ["ab" * 150, "ab" * 101, "x" * 199, "x" * 200, "y" * 201, "0123456789" * 21, (prose(8) + ".") * 9, None, "", base, base, base]
    rows += [passages[0][:k] + passages[1] for k in range(0, 120, 7)]
    return [(i if i % 10 else None, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("group_bytes", [8192, 300])
def test_repeats_against_a_plain_count(spark, monkeypatch, group_bytes):
    monkeypatch.setattr(suffix_dedup, "GROUP_BYTES", group_bytes)
    rows = tangled(group_bytes)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = suffix_dedup.digests(suffix_dedup.without_repeats(df, "text"), "doc_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 200)


def test_other_lengths_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    rows = tangled(3)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = suffix_dedup.digests(suffix_dedup.without_repeats(df, "text", 150), "doc_id").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows, 150)


def test_columns_stay_and_stretches_are_given(spark):
    text = "A passage that stands twice, word for word. " * 3
    df = spark.createDataFrame([(1, text * 2, "mine"), (2, "short", None)], "doc_id long, text string, kept string")
    out = suffix_dedup.without_repeats(df, "text", 130)
    assert out.columns == ["doc_id", "text", "kept", "n_bytes", "_kept", "removed"]
    first, second = out.orderBy("doc_id").collect()
    assert first["kept"] == "mine" and first["removed"] == [(0, len(text) * 2)] and bytes(first["_kept"]) == b""
    assert second["removed"] == [] and bytes(second["_kept"]) == b"short"
    assert suffix_dedup.without_repeats(df.filter(F.lit(False)), "text").count() == 0
