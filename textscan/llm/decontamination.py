"""Benchmark decontamination by Wu-Manber search for many strings.

Texts and benchmark items become words (A-Z lowered; digits, letters and everything beyond ASCII), joined by
single blanks.  The test strings are the windows of ten consecutive item words, with a blank on either side;
an item with fewer words is one window.  Strings are grouped by length.  Per group, a table over hashed
blocks says how far the scan may move on when a block stands at the end of the current window; positions
that can't be an end of a match are skipped.  Where the table says zero, the block's bucket gives the
candidate strings, which are compared directly.

The scan runs over all texts of an Arrow batch at once: the joined texts are cut into stretches, and one
array holds the place of each stretch's window.

Benchmarks travel with the tasks in blocks of ``BLOCK_BYTES`` at most; a larger one takes several passes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh, written

WINDOW = 10
BLOCK_BYTES = 16 << 20
#: Least lengths of the groups of strings.
LENGTHS = (64, 48, 32, 24, 16, 8, 3)
STRETCH = 512

_TABLE = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def word_bytes(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def windows(words: list[bytes], size: int = WINDOW) -> list[bytes]:
    if not words:
        return []
    return [b" " + b" ".join(words[i : i + size]) + b" " for i in range(max(1, len(words) - size + 1))]


class Group:
    """Strings of ``least`` bytes or more: shift table, suffix buckets."""

    def __init__(self, strings: list[bytes], numbers: list[int], least: int):
        self.m = min(map(len, strings))
        self.block = min(8, max(3, self.m // 2))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        step = self.m - self.block + 1
        heads = np.frombuffer(b"".join(s[: self.m] for s in strings) + b"\0" * 8, np.uint8)
        at = np.arange(len(strings))[:, None] * self.m + np.arange(step)[None, :]
        keys = _words_at(heads, at.ravel()).reshape(at.shape) & self.mask
        self.bits = np.uint64(64 - max(16, int(np.ceil(np.log2(8 * keys.size + 1)))))
        hashes = self.hash(keys)
        self.shift = np.full(1 << int(64 - self.bits), step, np.int16 if step < 30000 else np.int64)
        np.minimum.at(self.shift, hashes.ravel(), np.broadcast_to(step - 1 - np.arange(step), at.shape).ravel())
        ends = hashes[:, -1]
        self.order = np.argsort(ends, kind="stable")
        self.ends = ends[self.order]
        self.strings, self.numbers = strings, np.array(numbers)
        self.first = _words_at(heads, at[:, 0]) & self.mask

    def hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.bits).astype(np.int64)

    def search(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(place, number of the string) of every occurrence."""
        last = len(text) - self.m
        if last < 0:
            return np.array([], np.int64), np.array([], np.int64)
        data = np.frombuffer(text + b"\0" * 8, np.uint8)
        at = np.arange(0, last + 1, STRETCH)
        limit = np.minimum(at + STRETCH, last + 1)
        stops, stop_hash = [], []
        while len(at):
            h = self.hash(_words_at(data, at + (self.m - self.block)) & self.mask)
            shift = self.shift[h]
            zero = shift == 0
            if zero.any():
                stops.append(at[zero]), stop_hash.append(h[zero])
            at = at + np.maximum(shift, 1)
            going = at < limit
            at, limit = at[going], limit[going]
        if not stops:
            return np.array([], np.int64), np.array([], np.int64)
        stop, h = np.concatenate(stops), np.concatenate(stop_hash)
        low, high = np.searchsorted(self.ends, h, "left"), np.searchsorted(self.ends, h, "right")
        count = high - low
        place = np.repeat(stop, count)
        entry = np.repeat(low - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        string = self.order[entry]
        same = (_words_at(data, place) & self.mask) == self.first[string]
        place, string = place[same], string[same]
        full = np.array([text.startswith(self.strings[s], p) for p, s in zip(place.tolist(), string.tolist(), strict=True)], bool)
        return place[full], self.numbers[string[full]]


def _words_at(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on."""
    return np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))[at]


class Matcher:
    """Searches for all windows of the given (item id, text) rows."""

    def __init__(self, items: Iterable[tuple[str, str | None]]):
        owners: dict[bytes, set[str]] = {}
        for item, text in items:
            for w in windows(word_bytes(text)):
                owners.setdefault(w, set()).add(item)
        self.strings = sorted(owners)
        self.items = [sorted(owners[s]) for s in self.strings]
        self.sizes = [s.count(b" ") - 1 for s in self.strings]
        self.groups = []
        top = 1 << 62
        for least in LENGTHS:
            chosen = [i for i, s in enumerate(self.strings) if least <= len(s) < top]
            if chosen:
                self.groups.append(Group([self.strings[i] for i in chosen], chosen, least))
            top = least

    def search(self, texts: list[str | None]) -> list[tuple[int, set[int], set[str]]]:
        """(words, places of hit words, items) of each text."""
        split = [word_bytes(t) for t in texts]
        parts = [b" " + b" ".join(w) + b" " if w else b"" for w in split]
        text = b"".join(parts)
        starts = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int64)
        out: list[tuple[int, set[int], set[str]]] = [(len(w), set(), set()) for w in split]
        found = [g.search(text) for g in self.groups]
        if not any(len(p) for p, _ in found):
            return out
        place, number = (np.concatenate(x) for x in zip(*found, strict=True))
        rows = np.searchsorted(starts, place, "right") - 1
        order = np.argsort(rows, kind="stable")
        edges = np.flatnonzero(np.diff(rows[order], prepend=-1))
        for at in np.split(order, edges[1:]):
            row = int(rows[at[0]])
            blanks = np.flatnonzero(np.frombuffer(parts[row], np.uint8) == 32)
            first = np.searchsorted(blanks, place[at] - starts[row])
            _, hit, items = out[row]
            for w, k in zip(first.tolist(), number[at].tolist(), strict=True):
                hit.update(range(w, w + self.sizes[k]))
                items.update(self.items[k])
        return out


def contamination(df: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``df`` with ``n_words``, ``n_hit``, ``item_ids`` (sorted as strings) and ``contaminated``.

    Null and wordless texts have no words and no hits; items that are null, wordless or without an id
    match nothing.  Equal items are all named; rows that repeat a text are each judged.  Whole texts are searched, however
    long, in stretches.  An empty table gives an empty result, and without items nothing is hit.  New columns get
    underscores in front if ``df`` has their names already.
    """
    added = fresh(df, "n_words", "n_hit", "item_ids", "contaminated")
    bench = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).filter("item is not null and text is not null")
    size = bench.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    passes = max(1, -(-int(size) * 2 // BLOCK_BYTES))
    columns = df.columns
    fields = [("n_words", T.LongType()), ("hits", T.ArrayType(T.IntegerType())), ("item_ids", T.ArrayType(T.StringType()))]
    before: list[str] = []
    out = df
    for i in range(passes):
        block = bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == i) if passes > 1 else bench
        matcher = Matcher([(r["item"], r["text"]) for r in block.collect()])
        names = fresh(out, *[f"{n}_{i}" for n, _ in fields])

        def run(texts, *old, matcher=matcher):
            rows = matcher.search(texts)
            hits = [h | set(o or ()) for (_, h, _), o in zip(rows, old[0], strict=True)] if old else [h for _, h, _ in rows]
            items = [s | set(o or ()) for (_, _, s), o in zip(rows, old[1], strict=True)] if old else [s for _, _, s in rows]
            return [n for n, _, _ in rows], [sorted(h) for h in hits], [sorted(s) for s in items]

        out = append_columns(out, [text, *before[1:]], [(n, t) for n, (_, t) in zip(names, fields, strict=True)], run).drop(*before)
        before = names
        if i + 1 < passes:
            out = written(out)
    n, hits, items = map(F.col, before)
    new = (n, F.size(hits).cast("long"), items, F.size(hits) > 0)
    return out.select(*columns, *[c.alias(name) for c, name in zip(new, added, strict=True)])


def drop_contaminated(df: DataFrame, text: str, benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """The rows of ``df`` without any window of the benchmark, with its columns, whatever their names; see ``contamination``
    for nulls and the like."""
    return contamination(df.select(F.struct("*").alias("row"), F.col(text).alias("text")), "text", benchmark, item_id, item_text).filter("not contaminated").select("row.*")


def items_digest(ids: str) -> Column:
    return F.sha2(F.array_join(ids, ",").cast("binary"), 256)


#: DuckDB SQL for the query.
SQL = r"""
WITH item_words AS (
  SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
strings AS (
  SELECT DISTINCT item, w[i:i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(g) AS k FROM strings),
docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
windows AS (
  SELECT r, i, k, w[i:i + k - 1] AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, sizes WHERE len(w) >= k)),
found AS (SELECT r, i, k, item FROM windows JOIN strings USING (g)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS ids FROM found GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(hit.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
