"""Byte-exact removal of repeated strings, decided by suffix arrays of small groups.

A string of ``length`` bytes that starts at more than one place of the corpus is repeated, and every byte that a
repeated string covers goes.  Equal strings hold equal pieces of ``KMER`` bytes, so the piece with the least hash
in a string, its anchor, is the same wherever the string stands.  Strings in a row with one anchor make a segment,
and only segments with a common anchor can hold equal strings:

1. Anchors are counted; those of one place only are out.
2. Segments of shared anchors are counted by their hash: what a segment that occurs twice covers is repeated.
3. The different segments of an anchor are one text, of which a suffix array is built (``suffix_groups``: linear
   grouping by Lyndon prefixes).  Strings that are neighbours in it and agree in ``length`` bytes are repeated.

An anchor with more than ``GROUP_BYTES`` of different segments is split further: its strings are counted one by
one by a 128-bit hash.  Equal texts that many rows share are cut once and never move.  Rows find each other by a
96-bit hash of the text, so the result doesn't depend on how the table is stored.  Keys with more than
1 / ``MOST_HOT`` of all rows are dealt out by a second key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh, small_batches, written
from textscan.llm.suffix_groups import suffix_arrays

LENGTH = 200
KMER = 64
SEED = 42
#: Bytes of text that are cut in one go.
BLOCK = 1 << 19
#: Strings of a segment at most (an anchor of a periodic text goes on and on).
LONGEST = 1024
#: Different segments of one anchor that go into one suffix array, in bytes.
GROUP_BYTES = 8192
#: Bytes of suffix arrays that are built side by side.
SIDE_BY_SIDE = 1 << 21
MOST_HOT = 10_000

KEY = ["k1", "k2"]
_ODD = 0x9E3779B97F4A7C15


@lru_cache(maxsize=2)
def _constants(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number per byte, and the powers of an odd number and of its inverse modulo 2 ** 64."""
    per_byte = np.random.default_rng(SEED).integers(0, 1 << 64, 256, dtype=np.uint64)
    powers = []
    for base in (_ODD, pow(_ODD, -1, 1 << 64)):
        p = np.full(size, base, np.uint64)
        p[0] = 1
        powers.append(np.cumprod(p, dtype=np.uint64))
    return per_byte, *powers


def _slide(values: np.ndarray, width: int, better: np.ufunc) -> np.ndarray:
    """The least or greatest of each ``width`` values in a row."""
    done = 1
    while 2 * done <= width:
        values, done = better(values[:-done], values[done:]), 2 * done
    more = width - done
    return better(values[:-more], values[more:]) if more else values


def _cut_block(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, strings, anchor, twice) of the segments of a block.  ``ends`` gives the end of the text of each
    byte; ``twice`` tells whether the anchor may stand in the segment more than once."""
    none = np.array([], np.int64)
    if len(data) < length:
        return none, none, none, none.astype(bool)
    per_byte, powers, inverse = _constants(BLOCK + length)
    n, width = len(data), length - KMER + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(per_byte[data] * powers[:n], out=total[1:])
    hashes = (total[KMER:] - total[:-KMER]) * inverse[: n - KMER + 1]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    least = _slide(hashes, width, np.minimum)
    windows = np.flatnonzero(np.arange(length, n + 1) <= ends[: len(least)])
    if not len(windows):
        return none, none, none, none.astype(bool)
    anchors, text = least[windows], ends[windows]
    new = np.concatenate(([True], (anchors[1:] != anchors[:-1]) | (text[1:] != text[:-1])))
    edge = np.flatnonzero(new)
    place = np.arange(len(windows)) - edge[np.cumsum(new) - 1]
    new |= place % LONGEST == 0
    edge = np.flatnonzero(new)
    strings = np.diff(np.append(edge, len(windows)))
    # places whose piece is the least of some string: where neighbours among them are equal, a string may hold both
    padded = np.concatenate((np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)))
    seen = np.flatnonzero(_slide(padded, width, np.maximum) == hashes)
    near = (hashes[seen[1:]] == hashes[seen[:-1]]) & (np.diff(seen) <= width)
    twice = strings > width
    if near.any():
        count = np.zeros(n + 1, np.int64)
        count[1:][seen[1:][near]] = 1
        count = np.cumsum(count)
        starts = windows[edge]
        twice |= count[np.minimum(starts + strings + width - 1, n)] > count[starts]
    return windows[edge], strings, anchors[edge].view(np.int64), twice


def _blocks(column: pa.Array, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, place in the block, text, start in the text, strings, anchor, twice) of an array of binary texts."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    if offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)
    for low in range(int(offsets[0]), int(offsets[-1]), BLOCK):
        part = data[low : min(low + BLOCK + length - 1, int(offsets[-1]))]
        text = np.searchsorted(offsets, np.arange(low, low + len(part)), "right") - 1
        at, strings, anchor, twice = _cut_block(part, offsets[text + 1] - low, length)
        inside = text[at] if len(at) else at
        yield part, at, inside, at + low - offsets[inside], strings, anchor, twice


def anchor_counts(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(anchor, n): how many segments have the anchor; a segment that may hold it twice counts twice."""
    small_batches(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            times = b.column(1).to_numpy()
            for _, _, text, _, _, anchor, twice in _blocks(b.column(0), length):
                found, at = np.unique(anchor, return_inverse=True)
                n = np.zeros(len(found), np.int64)
                np.add.at(n, at, times[text] + twice)
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], names=["anchor", "n"])

    return texts.select("text", "times").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n"))


def segments(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, times, anchor, segment, start, strings, twice): every segment of every text, with its hash."""
    small_batches(texts.sparkSession)
    names = [*KEY, "times", "anchor", "segment", "start", "strings", "twice"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, at, text, start, strings, anchor, twice in _blocks(b.column(3), length):
                raw, digest = part.tobytes(), xxhash.xxh3_64_intdigest
                ends = at + strings + length - 1
                hashes = np.array([digest(raw[s:e], SEED) for s, e in zip(at.tolist(), ends.tolist(), strict=True)], np.uint64)
                row = pa.array(text)
                arrays = [*(b.column(i).take(row) for i in range(3)), pa.array(anchor), pa.array(hashes.view(np.int64))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(start, pa.int32()), pa.array(strings, pa.int32()), pa.array(twice)], names=names)

    return texts.select(*KEY, "times", "text").mapInArrow(
        run, "k1 long, k2 long, times long, anchor long, segment long, start int, strings int, twice boolean"
    )


def salted_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, spread: Column) -> DataFrame:
    """``rows`` joined with a written ``table`` of one row per key, whose column ``n`` says how many rows meet it.

    A key with more than 1 / ``MOST_HOT`` of all is dealt out by ``spread``, so its rows go to several tasks; there
    are fewer such keys than ``MOST_HOT``, and only their numbers of parts are broadcast."""
    most = max(1, (table.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    parts = F.ceil(F.col(n) / most).cast("int")
    hot = table.filter(F.col(n) > most).select(*on, parts.alias("parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("part", F.coalesce(F.pmod(spread, F.col("parts")).cast("int"), F.lit(0)))
    copied = table.withColumn("part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.drop("parts").join(copied, [*on, "part"]).drop("part")


def _pieces(different: DataFrame, texts: DataFrame, length: int) -> DataFrame:
    """(anchor, segment, k1, k2, start, once, wide, piece): the bytes of different segments, from the text that holds them."""
    wanted = different.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "segment", "start", "strings", "once", "wide")).alias("wanted"))
    joined = texts.join(wanted, KEY).select(*KEY, "text", "wanted")
    names = [*KEY, "anchor", "segment", "start", "once", "wide", "piece"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, text, wanted in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows = [
                    (k1, k2, w["anchor"], w["segment"], w["start"], w["once"], w["wide"], text[w["start"] : w["start"] + w["strings"] + length - 1])
                    for w in wanted
                ]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return joined.mapInArrow(run, "k1 long, k2 long, anchor long, segment long, start int, once boolean, wide boolean, piece binary")


def repeated_in_groups(groups: list[list[bytes]], length: int = LENGTH) -> list[np.ndarray]:
    """Per group of different byte strings, laid one behind the other with a byte between: whether the string of
    ``length`` bytes that starts at a place starts at another place of its group too."""
    joined = np.frombuffer(b"".join(p + b"\0" for g in groups for p in g), np.uint8)
    sizes = np.array([len(p) + 1 for g in groups for p in g], np.int64)
    ends = np.cumsum(sizes)
    per_group = np.array([sum(len(p) + 1 for p in g) for g in groups], np.int64)
    signs = joined.astype(np.uint16) + np.uint16(2)
    signs[ends - 1] = 1
    signs[np.cumsum(per_group) - 1] = 0
    order = suffix_arrays(signs, per_group)
    whole = np.arange(len(joined)) + length < np.repeat(ends, sizes)
    order = order[whole[order]]
    group = np.repeat(np.arange(len(groups)), per_group)
    repeated = np.zeros(len(joined), bool)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = group[a] == group[b]
        for k in (0, length // 2, length - 1):  # most neighbours differ here already
            same &= joined[a + k] == joined[b + k]
        a, b = a[same], b[same]
        windows = sliding_window_view(joined, length)
        for at in range(0, len(a), 4096):
            x, y = a[at : at + 4096], b[at : at + 4096]
            equal = (windows[x] == windows[y]).all(axis=1)
            repeated[x[equal]] = repeated[y[equal]] = True
    return np.split(repeated, np.cumsum(per_group)[:-1])


def _spans_of_groups(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows (anchor, segment, k1, k2, start, once, piece) sorted by the first two -> (k1, k2, low, high) of repeated
    strings in segments that occur once."""
    groups: list[list[tuple]] = []
    held = 0
    last = None

    def solve() -> pa.RecordBatch:
        out: list[list[int]] = [[], [], [], []]
        if groups:
            for rows, repeated in zip(groups, repeated_in_groups([[r[4] for r in g] for g in groups], length), strict=True):
                at = 0
                for k1, k2, start, once, piece in rows:
                    if once:
                        edges = np.flatnonzero(np.diff(repeated[at : at + len(piece) + 1].astype(np.int8), prepend=0, append=0))
                        for low, high in edges.reshape(-1, 2).tolist():
                            for column, value in zip(out, (k1, k2, start + low, start + high), strict=True):
                                column.append(value)
                    at += len(piece) + 1
        groups.clear()
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=[*KEY, "low", "high"])

    for b in batches:
        for anchor, segment, k1, k2, start, once, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if last is None or last[0] != anchor:
                if held > SIDE_BY_SIDE:
                    yield solve()
                    held = 0
                groups.append([])
            elif last[1] == segment:  # another copy of the text
                continue
            last = (anchor, segment)
            groups[-1].append((k1, k2, start, once, piece))
            held += len(piece)
    yield solve()


def _single_strings(pieces: DataFrame, length: int) -> DataFrame:
    """(h1, h2, k1, k2, at, once): every string of the segments, with its hash."""
    names = ["h1", "h2", *KEY, "at", "once"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k1, k2, start, once, piece in zip(*(c.to_pylist() for c in b.columns), strict=True):
                n = len(piece) - length + 1
                digest = xxhash.xxh3_128_digest
                halves = np.frombuffer(b"".join([digest(piece[i : i + length]) for i in range(n)]), "<i8").reshape(-1, 2)
                arrays = [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(np.full(n, k1)), pa.array(np.full(n, k2))]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(np.arange(start, start + n), pa.int32()), pa.array(np.full(n, once))], names=names)

    return pieces.select(*KEY, "start", "once", "piece").mapInArrow(run, "h1 long, h2 long, k1 long, k2 long, at int, once boolean")


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(k1, k2, spans): the places at which repeated strings start, as [low, high), per text.

    ``texts`` has k1, k2 (a key of the text), times (how many rows have the text) and text (binary)."""
    spark = texts.sparkSession
    small_batches(spark)
    shared = written(anchor_counts(texts, length).filter("n > 1"))
    places = written(salted_join(segments(texts, length), shared, ["anchor"], "n", F.xxhash64(*KEY, "start")).drop("n"))
    counted = written(
        places.groupBy("anchor", "segment").agg(
            F.sum("times").alias("n"),
            F.min(F.struct(*KEY, "start")).alias("first"),
            F.first("strings").alias("strings"),
            F.max("twice").alias("twice"),
        )
    )
    # segments that occur more than once: all their strings are repeated
    many = written(counted.filter("n > 1").select("anchor", "segment", "n"))
    copies = salted_join(places.drop("times", "twice"), many, ["anchor", "segment"], "n", F.xxhash64(*KEY, "start"))
    whole = copies.select(*KEY, F.col("start").alias("low"), (F.col("start") + F.col("strings")).alias("high"))
    # different segments with one anchor
    size = F.col("strings") + F.lit(length - 1)
    per = counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("m"), F.sum(size).alias("bytes"), F.max("twice").alias("twice"), F.min("n").alias("least"))
    per = written(per.filter("(m > 1 or twice) and least = 1").select("anchor", "m", (F.col("bytes") > GROUP_BYTES).alias("wide")))
    different = salted_join(counted.drop("twice"), per, ["anchor"], "m", F.col("segment")).select(
        "anchor", "segment", "first.*", "strings", (F.col("n") == 1).alias("once"), (F.col("wide")).alias("wide")
    )
    pieces = written(_pieces(different, texts, length))
    grouped = pieces.filter("not wide").select("anchor", "segment", *KEY, "start", "once", "piece")
    parts = grouped.repartition("anchor").sortWithinPartitions("anchor", "segment")
    in_groups = parts.mapInArrow(lambda batches: _spans_of_groups(batches, length), "k1 long, k2 long, low int, high int")
    # anchors with too much for one suffix array: every string by its hash
    strings = _single_strings(pieces.filter("wide").dropDuplicates(["anchor", "segment"]), length)
    met = written(strings.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
    alone = salted_join(strings.filter("once"), met, ["h1", "h2"], "n", F.xxhash64(*KEY, "at"))
    single = alone.select(*KEY, F.col("at").alias("low"), (F.col("at") + 1).alias("high"))
    spans = whole.unionByName(in_groups).unionByName(single)
    return spans.groupBy(*KEY).agg(F.collect_list(F.struct("low", "high")).alias("spans"))


def _covered(spans: list[dict] | None, everything: bool, size: int, length: int) -> list[tuple[int, int]]:
    """The stretches of bytes that strings starting in the spans cover."""
    if everything:
        return [(0, size)]
    out: list[list[int]] = []
    for low, high in sorted((s["low"], s["high"] + length - 1) for s in spans or ()):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def without_repeats(df: DataFrame, text: str, length: int = LENGTH) -> DataFrame:
    """``df`` with ``n_bytes``, ``kept`` (binary: the text's UTF-8 bytes without those that a repeated string of
    ``length`` bytes covers) and ``removed`` (maximal stretches of removed bytes, end exclusive).

    Null texts are empty.  Texts shorter than ``length`` stay whole, of any number of copies; from there on all
    copies of a text go.  Strings repeat inside one text too, and may overlap.  Long texts are cut in blocks.  An
    empty table gives an empty result.  New columns get underscores in front if ``df`` has their names already.
    """
    if length < 2 * KMER:
        raise ValueError(f"the length must be at least {2 * KMER}")
    small_batches(df.sparkSession)
    n_bytes, kept, removed = fresh(df, "n_bytes", "kept", "removed")
    k1, k2, body, spans, hot = fresh(df, "k1", "k2", "body", "spans", "hot")
    binary = F.coalesce(F.col(text).cast("binary"), F.lit(b""))
    keys = [F.xxhash64(binary), F.crc32(binary)]
    plain = df.select(keys[0].alias("k1"), keys[1].alias("k2"), binary.alias("text"))
    counts = plain.groupBy(*KEY).agg(F.count(F.lit(1)).alias("times"))
    total = df.count()
    many = written(counts.filter(F.col("times") > max(1, total // MOST_HOT)))
    known = F.broadcast(many)
    once = plain.join(known.drop("times"), KEY, "left_anti").select(*KEY, F.lit(1).cast("long").alias("times"), "text")
    often = plain.join(known, KEY).groupBy(*KEY).agg(F.first("times").alias("times"), F.first("text").alias("text"))
    found = repeated_spans(once.unionByName(written(often)), length)

    marked = df.withColumns({k1: keys[0], k2: keys[1]}).join(
        known.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.lit(True).alias(hot)), [k1, k2], "left"
    )
    # copies of frequent texts need no spans: they get keys that meet nothing and stay apart
    apart = F.col(hot).isNotNull()
    marked = marked.withColumns(
        {k1: F.when(apart, F.monotonically_increasing_id()).otherwise(F.col(k1)), k2: F.when(apart, F.lit(-1)).otherwise(F.col(k2))}
    )
    joined = marked.join(found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("spans").alias(spans)), [k1, k2], "left")

    def run(bodies: list[bytes], spans: list, hot: list) -> list[list]:
        sizes, rests, gone = [], [], []
        for b, s, h in zip(bodies, spans, hot, strict=True):
            stretches = _covered(s, bool(h) and len(b) >= length, len(b), length)
            edges = [0, *(x for y in stretches for x in y), len(b)]
            sizes.append(len(b))
            rests.append(b"".join(b[i:j] for i, j in zip(edges[::2], edges[1::2], strict=True)))
            gone.append([{"start": i, "end": j} for i, j in stretches])
        return [sizes, rests, gone]

    stretch = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
    fields = [(n_bytes, T.LongType()), (kept, T.BinaryType()), (removed, stretch)]
    return append_columns(joined.withColumn(body, binary), [body, spans, hot], fields, run).select(*df.columns, n_bytes, kept, removed)


def digests(result: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of a result of ``without_repeats``."""
    return result.select(
        F.col(doc_id).alias("doc_id"),
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
