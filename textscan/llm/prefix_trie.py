"""The trie of conversations by their turns, and sums over its subtrees by an Euler tour.

A node is a sequence of first turns that some conversation has.  Prefixes are known by hashes that grow along the
conversation (two times 64 bits, the exclusive or of a hash of each turn and its place), so no text is moved.

The tour enters each node, goes through its children one by one, and leaves it: two arcs per node, each knowing
its next.  The arcs are ranked as a list, distributedly: arcs of one stretch of a conversation are joined to one first,
then, round by round, arcs that a coin marks take in their unmarked next ones, a quarter of all, until at most
``LEFT_OVER`` are left for one task; then the rounds are undone.  What a node adds stands at its entering arc, and
prefix sums over the ranked arcs give a subtree's sum as what the leaving arc has more than the entering one.

Nothing is gathered by conversation or node: places, prefixes and sums are running sums over ranges
(``textscan.operators.ordered``), and children are chained in parts of ``CHILDREN``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscan.llm.batches import cut, small_batches, written
from textscan.llm.suffix_dedup import salted_join
from textscan.operators.ordered import running

#: Arcs that one task ranks at the end.
LEFT_OVER = 1 << 14
#: Children of a node that are chained in one part.
CHILDREN = 10_000
#: Turns of a conversation whose arcs are joined first in one task.
STRETCH = 500
END = -1


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, h1, h2, bytes) of rows (conv_id, turn, role, text): the place of each turn in its conversation
    from 0 on, two hashes of role and text, and the text's size.

    Turns are in the order of ``turn`` (nulls first), role and digest of the text; null roles and texts are empty; rows
    without a conversation are left out."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    hashes = [F.xxhash64(F.lit(k), F.octet_length(role), role, text).alias(f"h{k}") for k in (1, 2)]
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), F.md5(text.cast("binary")).alias("digest"),
        *hashes, F.octet_length(text).cast("long").alias("bytes"),
    )
    placed = running(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), "role", "digest"], {"place": F.lit(1)})
    return placed.select("conv_id", "place", "h1", "h2", "bytes")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations): each conversation c with the first h turns of conversation c - c % 5 in place of its own
    first h, where h is the checksum of c modulo 9."""
    ids = turns.select("conv_id").distinct()
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9
    base = F.col("conv_id") - F.col("conv_id") % 5
    chosen = ids.select("conv_id", base.alias("base"), h.alias("h"))
    first = turns.filter("place < 8").withColumnRenamed("conv_id", "base")
    begun = chosen.join(first, "base").filter("place < h").select("conv_id", "place", "h1", "h2", "bytes")
    held = first.groupBy("base").agg(F.count(F.lit(1)).alias("held"))
    shift = written(chosen.join(held, "base", "left").select("conv_id", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("begun")))
    sizes = written(turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).join(shift, "conv_id"))
    rest = salted_join(turns, sizes, ["conv_id"], "n", F.col("place")).filter("place >= h")
    rest = rest.select("conv_id", (F.col("place") - F.col("h") + F.col("begun")).alias("place"), "h1", "h2", "bytes")
    return begun.unionByName(rest), sizes.select("conv_id")


def _prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, bytes): the hashes of the prefix that ends with each turn, and of the one before."""
    at = F.col("place") + 1
    mixed = {"m1": F.xxhash64(at, "h1", "h2"), "m2": F.xxhash64("h2", at, "h1")}
    rows = turns.select("conv_id", at.alias("depth"), "bytes", *[m.alias(n) for n, m in mixed.items()])
    before = running(rows, ["conv_id"], ["depth"], {"q1": F.col("m1"), "q2": F.col("m2")}, "xor")
    here = [F.col(f"q{k}").bitwiseXOR(F.col(f"m{k}")).alias(f"p{k}") for k in (1, 2)]
    return before.select("conv_id", "depth", *here, "q1", "q2", "bytes")


def _nodes(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(node, conv_id, depth, parent, parent_conv_id, n_convs, n_children, bytes, p1, p2), with a root (of hashes 0) if there is a
    conversation.  ``node`` and ``parent`` are numbers of the written table."""
    root = conversations.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select("conv_id", zero.alias("depth"), *[zero.alias(c) for c in ("p1", "p2", "q1", "q2")], "n_convs", zero.alias("bytes"))
    rest = prefixes.groupBy("depth", "p1", "p2").agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.first("q1").alias("q1"), F.first("q2").alias("q2"), F.first("bytes").alias("bytes")
    )
    found = written(root.unionByName(rest).withColumn("node", F.monotonically_increasing_id()))
    depth = F.col("depth") - 1
    counted = found.filter("depth > 0").groupBy(depth.alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count(F.lit(1)).alias("n_children"))
    with_children = written(found.join(counted, ["depth", "p1", "p2"], "left").withColumn("n_children", F.coalesce("n_children", zero)).drop("q1", "q2"))
    parents = with_children.filter("n_children > 0").select(
        (F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"),
        F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("siblings"),
    )
    links = found.filter("depth > 0").select("node", "depth", "q1", "q2")
    met = salted_join(links, parents, ["depth", "q1", "q2"], "siblings", F.col("node")).select("node", "parent", "parent_conv_id", "siblings")
    return written(with_children.join(met, "node", "left"))


def _tour(nodes: DataFrame) -> DataFrame:
    """(arc, next, block): the arcs 2 * node (entering) and 2 * node + 1 (leaving), and the stretch they belong to."""
    parts = F.ceil(F.col("siblings") / CHILDREN)
    children = nodes.filter("parent is not null").select("node", "conv_id", "depth", "parent", F.pmod(F.xxhash64("node"), parts).alias("part"))
    inside = Window.partitionBy("parent", "part").orderBy("node")
    chained = cut(children.withColumns({"after": F.lead("node").over(inside), "nth": F.row_number().over(inside)}))
    heads = chained.filter("nth = 1").select("parent", "part", F.col("node").alias("head"))
    between = Window.partitionBy("parent").orderBy("part")
    heads = heads.withColumns({"after_part": F.lead("head").over(between), "rank": F.row_number().over(between)})
    ends = chained.filter("after is null").join(heads.select("parent", "part", "after_part"), ["parent", "part"])
    nexts = chained.filter("after is not null").select("node", "parent", "after").unionByName(ends.select("node", "parent", F.col("after_part").alias("after")))
    first = heads.filter("rank = 1").select(F.col("parent").alias("node"), F.col("head").alias("first"))
    whole = nodes.select("node", "conv_id", "depth").join(nexts, "node", "left").join(first, "node", "left")
    enter, leave = F.col("node") * 2, F.col("node") * 2 + 1
    after = F.coalesce(F.col("after") * 2, F.col("parent") * 2 + 1, F.lit(END).cast("long"))
    arcs = F.array(F.struct(enter.alias("arc"), F.coalesce(F.col("first") * 2, leave).alias("next")), F.struct(leave.alias("arc"), after.alias("next")))
    return whole.select(F.inline(arcs), F.xxhash64("conv_id", F.floor(F.col("depth") / STRETCH)).alias("block"))


def _walk(arcs: np.ndarray, nexts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(head, distance from it, next behind the chain, size of the chain) of each arc: chains are those of arcs whose
    next is among them too.  Pointers are doubled."""
    by = np.argsort(arcs)
    at = np.searchsorted(arcs, nexts, sorter=by)
    at = by[np.minimum(at, len(arcs) - 1)]
    inner = arcs[at] == nexts
    before = np.arange(len(arcs))
    before[at[inner]] = np.flatnonzero(inner)
    distance = np.where(before != np.arange(len(arcs)), sizes[before], 0)
    while True:
        further = before[before]
        if (further == before).all():
            break
        distance, before = distance + distance[before], further
    last = np.flatnonzero(~inner)
    behind, total = np.full(len(arcs), END, np.int64), np.zeros(len(arcs), np.int64)
    behind[before[last]], total[before[last]] = nexts[last], distance[last] + sizes[last]
    return arcs[before], distance, behind, total


def _join_stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (block, arc, next) sorted by block -> (arc, head, distance, next, size), the last two at heads only."""
    names = ["arc", "head", "distance", "next", "size"]
    held: list[np.ndarray] = []

    def solve(rows: np.ndarray) -> pa.RecordBatch:
        if not len(rows):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 5, names=names)
        # blocks are told apart by their arcs alone: a next in another block is not joined
        block, arc, nexts = rows.T
        by = np.argsort(arc)
        at = by[np.minimum(np.searchsorted(arc, nexts, sorter=by), len(arc) - 1)]
        joined = np.where((arc[at] == nexts) & (block[at] == block), nexts, -2 - np.arange(len(arc)))
        head, distance, behind, total = _walk(arc, joined, np.ones(len(arc), np.int64))
        outer = behind < END
        behind[outer] = nexts[-2 - behind[outer]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (arc, head, distance, behind, total)], names=names)

    for b in batches:
        rows = np.column_stack([b.column(i).to_numpy() for i in range(3)]) if b.num_rows else np.empty((0, 3), np.int64)
        rows = np.concatenate([*held, rows])
        if not len(rows):
            continue
        open_rows = rows[:, 0] == rows[-1, 0]
        held = [rows[open_rows]]
        yield solve(rows[~open_rows])
    if held:
        yield solve(np.concatenate(held))


def _rank_rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All of a list of at most ``LEFT_OVER`` arcs (arc, next, size) -> (arc, rank)."""
    parts = [np.column_stack([b.column(i).to_numpy() for i in range(3)]) for b in batches if b.num_rows]
    if parts:
        arcs, nexts, sizes = np.concatenate(parts).T
        _, distance, _, _ = _walk(arcs, nexts, sizes)
        yield pa.RecordBatch.from_arrays([pa.array(arcs), pa.array(distance)], names=["arc", "rank"])


def list_ranks(arcs: DataFrame) -> DataFrame:
    """(arc, rank) of a list (arc, next, block) that ends in ``END``: how many arcs come before each.

    Arcs of a block should follow each other, and a block must be small."""
    dealt = arcs.select("block", "arc", "next").repartition("block").sortWithinPartitions("block")
    first = written(dealt.mapInArrow(_join_stretches, "arc long, head long, distance long, next long, size long"))
    rest = first.filter("arc = head").select("arc", "next", "size")
    left, taken = rest.count(), [first.filter("arc != head").select("arc", F.col("head").alias("into"), "distance")]
    while left > LEFT_OVER:
        coin = F.pmod(F.xxhash64("arc", F.lit(len(taken))), F.lit(2)) == 1
        heads = rest.filter(coin)
        tails = rest.filter(~coin).select(*[F.col(c).alias(f"t_{c}") for c in rest.columns])
        met = cut(heads.join(tails, heads["next"] == tails["t_arc"], "full"))
        both, alone = F.col("arc").isNotNull() & F.col("t_arc").isNotNull(), F.col("arc").isNull()
        taken.append(met.filter(both).select(F.col("t_arc").alias("arc"), F.col("arc").alias("into"), F.col("size").alias("distance")))
        rest = met.select(
            F.coalesce("arc", "t_arc").alias("arc"),
            F.when(alone | both, F.col("t_next")).otherwise(F.col("next")).alias("next"),
            (F.coalesce("size", F.lit(0)) + F.coalesce("t_size", F.lit(0))).alias("size"),
        )
        left = rest.count()
    ranks = cut(rest.repartition(1).mapInArrow(_rank_rest, "arc long, rank long"))
    for undone in reversed(taken):
        back = undone.join(ranks.withColumnRenamed("arc", "into"), "into").select("arc", (F.col("rank") + F.col("distance")).alias("rank"))
        ranks = cut(ranks.unionByName(back))
    return ranks


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (p1, p2, depth, conv_id) in order -> (p1, p2, depth, ends_sha256); holds one running digest."""
    state: list | None = None
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = list(zip(*[(*d[0], d[1].hexdigest()) for d in done], strict=True)) or [()] * 4
        done.clear()
        kinds = [pa.int64()] * 3 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["p1", "p2", "depth", "ends_sha256"])

    for b in batches:
        for *key, conv in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or state[0] != key:
                if state:
                    done.append(tuple(state))
                state = [key, hashlib.sha256()]
            else:
                state[1].update(b",")
            state[1].update(str(conv).encode())
        yield batch()
    if state:
        done.append(tuple(state))
    yield batch()


def _ended(prefixes: DataFrame, conversations: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256) of the nodes at which conversations end."""
    longest = prefixes.groupBy("conv_id").agg(F.max(F.struct("depth", "p1", "p2")).alias("end"))
    zero = F.lit(0).cast("long")
    at = [F.coalesce(F.col(f"end.{c}"), zero).alias(c) for c in ("p1", "p2", "depth")]
    ends = conversations.join(longest, "conv_id", "left").select(*at, "conv_id")
    key = ["p1", "p2", "depth"]
    dealt = ends.repartition(*key).sortWithinPartitions(*key, "conv_id")
    return dealt.mapInArrow(_ends, "p1 long, p2 long, depth long, ends_sha256 string")


def _subtrees(nodes: DataFrame, own: dict[str, Column]) -> DataFrame:
    """(node, sums...): what the columns of all nodes of a node's subtree come to."""
    ranks = list_ranks(_tour(nodes))
    entering = F.col("arc") % 2 == 0
    arcs = ranks.select("arc", "rank", F.floor(F.col("arc") / 2).cast("long").alias("node"), entering.alias("entering"))
    values = nodes.select("node", *[c.cast("long").alias(n) for n, c in own.items()])
    at_arcs = arcs.join(values, "node").withColumns({n: F.when(F.col("entering"), F.col(n)).otherwise(0) for n in own})
    summed = running(at_arcs.withColumnsRenamed({n: f"at_{n}" for n in own}), [], ["rank"], {n: F.col(f"at_{n}") for n in own})
    sign = F.when(F.col("entering"), -1).otherwise(1)
    return summed.groupBy("node").agg(*[F.sum(sign * F.col(n)).alias(n) for n in own])


def trie(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of ``turns`` (conv_id, place, h1, h2, bytes) of ``conversations`` (conv_id): (conv_id, depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    A node is named by its smallest member and its depth.  ``saved_tokens`` are the bytes of last texts that need not be
    computed again for further members, ``ends_sha256`` digests the members that end there.  Conversations without turns
    end at the root; without any conversation there is no node.  Conversations with equal turns share all their nodes; texts
    of any length count by their hashes; other columns are left out, so their names can't clash."""
    small_batches(turns.sparkSession)
    prefixes = written(_prefixes(turns))
    nodes = _nodes(prefixes, conversations)
    sums = _subtrees(nodes, {"n_leaves": F.col("n_children") == 0, "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes")})
    out = nodes.join(sums, "node").join(_ended(prefixes, conversations), ["p1", "p2", "depth"], "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(b""), 256)).alias("ends_sha256"),
    )


#: DuckDB SQL for the query.  The checksum is worked out byte by byte with its table; a prefix is known by the digests of its turns.
SQL = r"""
WITH crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384::BIGINT, c >> 1) ELSE c >> 1 END) AS v FROM range(256) r(n))),
ids AS (SELECT DISTINCT conv_id::BIGINT AS c FROM conversations WHERE conv_id IS NOT NULL),
chosen AS (
  SELECT c, c - c % 5 AS base, xor(4294967295::BIGINT, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, length(c::VARCHAR) + 1), lambda i: ascii(substr(c::VARCHAR, i::BIGINT, 1))::BIGINT)),
    lambda s, b: xor(t[(xor(s, b) & 255) + 1], s >> 8))) % 9 AS h
  FROM ids, crc),
turns AS (
  SELECT conv_id AS c, md5(coalesce(role, '') || chr(1) || coalesce(text, '')) AS turn_key, octet_length(encode(coalesce(text, ''))) AS bytes,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), md5(coalesce(text, ''))) - 1 AS place
  FROM conversations WHERE conv_id IS NOT NULL),
built AS (
  SELECT chosen.c, 0 AS part, place, turn_key, bytes FROM chosen JOIN turns ON turns.c = base WHERE place < h
  UNION ALL SELECT c, 1, place, turn_key, bytes FROM chosen JOIN turns USING (c) WHERE place >= h),
prefixes AS (
  SELECT c, row_number() OVER o AS d, bytes, string_agg(turn_key, '') OVER o AS k FROM built
  WINDOW o AS (PARTITION BY c ORDER BY part, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT c, 0, 0, '' FROM ids),
ends AS (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY c)) AS digest FROM (SELECT c, arg_max(k, d) AS k FROM prefixes GROUP BY c) GROUP BY k),
plain AS (SELECT d, k, left(k, greatest(length(k) - 32, 0)) AS up, min(c) AS c, count(*) AS n, any_value(bytes) AS bytes FROM prefixes GROUP BY d, k),
children AS (SELECT up AS k, count(*) AS n_children FROM plain WHERE d > 0 GROUP BY up),
nodes AS (SELECT plain.*, coalesce(n_children, 0) AS n_children FROM plain LEFT JOIN children USING (k)),
sums AS (
  SELECT left(k, 32 * j) AS k, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * bytes) AS saved
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM nodes) GROUP BY 1)
SELECT nodes.c AS conv_id, nodes.d AS depth, above.c AS parent_conv_id, nodes.n AS n_convs, nodes.n_children, n_leaves,
  saved::BIGINT AS saved_tokens, coalesce(digest, sha256('')) AS ends_sha256
FROM nodes JOIN sums USING (k) LEFT JOIN ends USING (k) LEFT JOIN plain above ON nodes.d > 0 AND above.k = nodes.up
"""
