"""The trie of conversations against plain Python."""

import hashlib
import random
import zlib

import pytest

from textscan.llm import prefix_trie
from textscan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_trie(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn, role or "", text or ""))
    for turns in own.values():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        built[c] = tuple((role, text) for _, role, text in own.get(base, [])[:h] + turns[h:])
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out, leaves, saved = [], {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[n] for n in below) if below else 1
        last = len(node[-1][1].encode()) if node else 0
        saved[node] = (len(members[node]) - 1) * last + sum(saved[n] for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in members[node] if built[c] == node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(members[node]), len(node), parent, len(members[node]), len(below), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(2)
    rows = [(None, 1, "user", "nobody's")]
    for conv in [*range(-3, 60), 10**12]:
        rows += [(conv, rng.choice([None, *range(20)]), rng.choice(["user", "assistant", None]), rng.choice(["a", "", None, "日本🙂", "b" * 3000])) for _ in range(rng.randint(1, 12))]
    rows += [(conv, 30 + k, "user", "same") for conv in range(100, 160) for k in range(10)]
    rows += [(7, 100 + k, "user", str(k)) for k in range(300)]
    return rows + rows[:30]


@pytest.mark.parametrize("bounds", ["plain", "small"])
def test_query_against_plain_python(spark, tmp_path, monkeypatch, bounds):
    if bounds == "small":
        for name, value in {"LEFT_OVER": 100, "CHILDREN": 3, "STRETCH": 4}.items():
            monkeypatch.setattr(prefix_trie, name, value)
    tables = [odd_rows()] if bounds == "small" else [odd_rows(), [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], [], [(4, 0, "user", "x")]]
    for rows in tables:
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
        got = QUERIES["op13_prefix_trie"](spark, path)
        assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(rows)
