"""SimHash near-duplicates: fingerprints that differ in few bits, found over pigeonhole blocks.

A fingerprint is cut into blocks.  Two that differ in at most 3 bits agree in at least ``BLOCKS - 3``
blocks, so they share one of the keys made of that many blocks; only fingerprints with a common key are
compared.  Equal fingerprints count once, so groups of copies of any size cost one row.  A key that many
fingerprints share is dealt out as pairs of chunks, so that a task holds two chunks at most, and inside a
key only the links of a spanning forest leave the task.  Components come from alternating star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, cut, fresh, stored_rows, written

SEED = 42
DISTANCE = 3
BLOCKS = 6
#: Fingerprints of one key that a task compares in one go; a longer list is cut into chunks of this size.
CHUNK = 4096
#: Up to this many of one key all linked pairs are given, beyond it a spanning forest.
PAIRS_UP_TO = 16


def fingerprint(text: str | None, words: int = 3, seed: int = SEED) -> int:
    """64 bits, unsigned; 0 without a word."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        pairs = zip(starts[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)
        hashes = [digest(joined[s:e], seed) for s, e in pairs]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        block = np.array(hashes[at : at + 65536], dtype="<u8")
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * counts > len(hashes)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str, name: str = "fingerprint") -> DataFrame:
    """``df`` and the fingerprint as a signed long; null and blank texts have 0."""

    def run(texts: list[str | None]) -> list[np.ndarray]:
        return [np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)]

    return append_columns(df, [text], [(name, T.LongType())], run)


def block_keys(fp: Column, blocks: int = BLOCKS, distance: int = DISTANCE) -> Column:
    """One key per choice of ``blocks - distance`` blocks: the choice's number, and the bits of its blocks."""
    bounds = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(bounds, bounds[1:], strict=False)]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    chosen = [signed(sum(masks[i] for i in pick)) for pick in combinations(range(blocks), blocks - distance)]
    return F.array(*[F.struct(F.lit(n).cast("int").alias("pick"), fp.bitwiseAND(F.lit(m)).alias("bits")) for n, m in enumerate(chosen)])


def _close_in_group(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that connect just what pairs within the distance connect."""
    if len(fps) <= PAIRS_UP_TO:
        far = np.bitwise_count(fps[:, None] ^ fps[None, :])
        return [(i, j) for i, j in zip(*np.nonzero(np.triu(far <= distance, 1)), strict=True)]
    links, rest, todo = [], np.arange(len(fps)), []
    while len(rest):
        if not todo:
            todo, rest = [rest[0]], rest[1:]
        i = todo.pop()
        near = np.bitwise_count(fps[rest] ^ fps[i]) <= distance
        if near.any():
            found = rest[near]
            links += [(i, j) for j in found]
            todo += found.tolist()
            rest = rest[~near]
    return links


def _links_of_sorted(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by group; a group may go on in the next batch, and is never more than two chunks."""
    open_rows: list[pd.DataFrame] = []

    def links(frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        fps = frame["fp"].to_numpy().view(np.uint64)
        keys = frame[["pick", "bits", "low", "high"]].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1)))) if len(keys) else np.array([], int)
        sizes = np.diff(np.append(edge, len(keys)))
        a, b = [], []
        for k in range(1, PAIRS_UP_TO):  # small groups: the row k places on, while it is in the same group
            small = np.repeat(np.where(sizes <= PAIRS_UP_TO, edge + sizes, 0), sizes)
            at = np.flatnonzero(np.arange(len(keys)) + k < small)
            if not len(at):
                break
            at = at[np.bitwise_count(fps[at] ^ fps[at + k]) <= distance]
            a.append(fps[at]), b.append(fps[at + k])
        for start, size in zip(edge[sizes > PAIRS_UP_TO], sizes[sizes > PAIRS_UP_TO], strict=True):
            if found := _close_in_group(fps[start : start + size], distance):
                i, j = np.array(found).T
                a.append(fps[start + i]), b.append(fps[start + j])
        none = np.array([], np.uint64)
        return np.concatenate([none, *a]).view(np.int64), np.concatenate([none, *b]).view(np.int64)

    def batch(frame: pd.DataFrame) -> pa.RecordBatch:
        a, b = links(frame)
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for b in batches:
        open_rows.append(b.to_pandas())
        frame = pd.concat(open_rows, ignore_index=True)
        last = (frame[["pick", "bits", "low", "high"]] == frame[["pick", "bits", "low", "high"]].iloc[-1]).all(axis=1) if len(frame) else []
        if len(frame):
            yield batch(frame[~last])
            open_rows = [frame[last]]
    if open_rows:
        yield batch(pd.concat(open_rows, ignore_index=True))


def close_pairs(fps: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links between distinct fingerprints ``fp`` that connect just those that chains of pairs
    within ``distance`` connect."""
    keyed = fps.select(F.explode(block_keys(F.col("fp"), blocks, distance)).alias("k"), "fp").select("k.pick", "k.bits", "fp")
    shared = keyed.groupBy("pick", "bits").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chunks = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    dealt = (
        keyed.join(shared, ["pick", "bits"])
        .withColumn("chunks", chunks)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("pick", "bits", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "fp")
    )
    key = ["pick", "bits", "low", "high"]
    return (
        dealt.repartition(*key)
        .sortWithinPartitions(*key)
        .mapInArrow(lambda batches: _links_of_sorted(batches, distance), "a long, b long")
        .distinct()
    )


def components(links: DataFrame, most_rounds: int = 50) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the least node that chains of links reach.

    Alternating star steps.  Each step is a minimum per node (combined before the shuffle) and a join with
    one row per node, so a node with many links is split by Spark's skew handling.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if large:
            both = both.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            both = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        met = both.join(least, "u")
        out = met.filter("v > u" if large else "v != m").select(F.col("m").alias("a"), F.col("v").alias("b"))
        if not large:
            out = out.unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
        return out.filter("a != b").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.sum(F.hash("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("a", "b"))).first())

    links = cut(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = state(links)
    for _ in range(most_rounds):
        if not before[0]:
            break
        links = cut(star(star(links, True), False))
        after = state(links)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components are not found after {most_rounds} rounds")
    pairs = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return pairs.unionByName(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())


def near_classes(fingerprints: DataFrame, doc_id: str, fp: str) -> DataFrame:
    """(fp, component_id) for each distinct fingerprint: the smallest ``doc_id`` that links reach."""
    per = cut(fingerprints.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")))
    found = components(close_pairs(per.select("fp"))).withColumnRenamed("node", "fp")
    linked = found.join(per, "fp")
    roots = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    return per.join(found.join(roots, "root").select("fp", "component_id"), "fp", "left").select(
        "fp", F.coalesce("component_id", "least").alias("component_id")
    )


def simhash_classes(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id), one row per row of ``df``.

    Null and blank texts have fingerprint zero and are linked like any other.  Rows that repeat an id or a
    text are in one class; a null id stays null and never names a class unless it has no other member.
    Whole texts count, however long, in blocks of shingles.  An empty table gives an empty result.  Other columns are left out, so
    their names can't clash.
    """
    prints = written(with_fingerprint(df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), "text", "fp").drop("text"))
    return prints.join(near_classes(prints, "doc_id", "fp"), "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``df`` with one row of each class: the one with the smallest ``doc_id`` (the first as stored among
    rows that repeat it; rows without an id come last).

    Null and blank texts are one class; whole texts count, however long; an empty table stays empty; all columns stay, whatever
    their names.  Rows of a Parquet table are known by their file and place; of another table a copy with numbers is written."""
    file, place = fresh(df, "file", "place")
    ids = stored_rows(df)
    numbered = df.withColumns(dict(zip((file, place), ids or [F.lit(0).cast("long"), F.monotonically_increasing_id()], strict=True)))
    if ids is None:
        numbered = written(numbered)
    prints = written(with_fingerprint(numbered.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(file).alias("file"), F.col(place).alias("place")), "text", "fp").drop("text"))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "file", "place")
    per = cut(prints.groupBy("fp").agg(F.min(rank).alias("rank")))
    found = components(close_pairs(per.select("fp"))).withColumnRenamed("node", "fp")
    least = per.join(found, "fp", "left").groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("rank").alias("rank"))
    kept = least.select(F.col("rank.file").alias(file), F.col("rank.place").alias(place))
    return numbered.join(kept, [file, place], "left_semi").select(*df.columns)
