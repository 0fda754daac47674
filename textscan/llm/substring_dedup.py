"""Substring deduplication over sliding runs of sentences.

A text is cut into sentences; one of more than ``LONG`` words is cut further behind words chosen by their
hash, so that the cuts inside a repeated passage are the same wherever it stands: behind the word with the least
hash of each ``WINDOW`` words in a row.  So no piece of a long sentence has more than ``WINDOW`` words, and what
repeats 4 * ``WINDOW`` + 16 = 40 words or more of long sentences holds a whole run: the cuts agree from the
``WINDOW``-th word on, up to as many before the end, and ``LEAST_WORDS`` words are always ``RUN`` pieces.  From each sentence on, the
shortest run of at least ``RUN`` sentences and ``LEAST_WORDS`` words is hashed (128 bits, case and white space
aside).  Runs are joined globally: the first occurrence is the one with the least (document, row, place), and
sentences that any other occurrence covers are removed.  Places belong to a row, as rows may share a document.

Runs meet in one shuffle, sorted by hash and occurrence: the first of a group is kept, and all others are repeats,
told apart as they stream by.  Of a run that occurs often in a batch of texts only the first goes there as such; the
others are repeats already, and are dealt out evenly.  Texts are read twice and move once, at the end.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, small_batches, written

RUN = 3
LEAST_WORDS = 20
LONG = 16
#: At most (LEAST_WORDS - 1) // (RUN - 1), so that the pieces of a long sentence need no more words than LEAST_WORDS.
WINDOW = 6
#: Texts among which a run is first looked for.
TOGETHER = 1 << 14

_LINE = re.compile("\n")
_SPACE = np.array([chr(c).isspace() for c in range(0x3002)])


def _word_bounds(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points (blanks as zero), starts and ends of the words."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = _SPACE[np.minimum(points, len(_SPACE) - 1)]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.concatenate(([0], edge))
    if not blank[-1]:
        edge = np.append(edge, len(points))
    return np.where(blank, np.uint32(0), points), edge[::2], edge[1::2]


def _least_of_windows(hashes: np.ndarray) -> np.ndarray:
    """Whether a place has the least hash, the last of equal ones, of any ``WINDOW`` in a row around it."""
    chosen = np.zeros(len(hashes), bool)
    windows = len(hashes) - WINDOW + 1
    least, at = hashes[:windows].copy(), np.arange(windows)
    for k in range(1, WINDOW):
        here = hashes[k : k + windows]
        lower = here <= least
        least[lower] = here[lower]
        at[lower] = np.flatnonzero(lower) + k
    chosen[at] = True
    return chosen


def sentences(text: str | None) -> list[tuple[int, int, bytes, int]]:
    """(start, end, hash, words) of the sentences; they cover the text but for blanks in front.

    A sentence goes on to the next word's start behind ``.``, ``!``, ``?`` or a line end.
    """
    lower = (text or "").lower()
    words = lower.split()
    if not words:
        return []
    low_points, starts, ends = _word_bounds(lower)
    hashes = np.add.reduceat(low_points * (low_points ^ np.uint32(0x85EBCA6B)), starts, dtype=np.uint32) * np.uint32(0x9E3779B1)
    points = low_points
    if not lower.isascii():  # lower case may have another length
        points, starts, ends = _word_bounds(text)
    last = points[ends - 1]
    closes = (last == ord(".")) | (last == ord("!")) | (last == ord("?"))
    lines = np.array([m.start() for m in _LINE.finditer(text)], np.int64)
    behind = np.searchsorted(starts, lines)
    closes[behind[behind > 0] - 1] = True
    closes[-1] = True
    bounds = np.concatenate(([0], np.flatnonzero(closes) + 1))
    long = np.repeat(np.diff(bounds) > LONG, np.diff(bounds))
    if long.any():
        closes |= _least_of_windows(hashes) & long
    cuts = [0, *(np.flatnonzero(closes) + 1).tolist()]
    place = starts[cuts[:-1]].tolist()
    if not len(lines) or lines[0] > place[0]:
        place[0] = 0
    place.append(len(text))
    digest = xxhash.xxh3_128_digest
    return [
        (p, q, digest(" ".join(words[a:b]).encode("utf-8", "surrogatepass")), b - a)
        for (p, q), (a, b) in zip(pairwise(place), pairwise(cuts), strict=True)
    ]


def runs(units: list[tuple[int, int, bytes, int]]) -> Iterator[tuple[int, int, bytes]]:
    """(first sentence, number of sentences, hash)."""
    upto = [0, *accumulate(u[3] for u in units)]
    hashes = b"".join([u[2] for u in units])
    end = 0
    for i in range(len(units)):
        end = max(end, i + RUN)
        while end <= len(units) and upto[end] - upto[i] < LEAST_WORDS:
            end += 1
        if end > len(units):
            return
        yield i, end - i, xxhash.xxh3_128_digest(hashes[16 * i : 16 * end])


_RUN = "high long, low long, doc_id {}, row1 long, row2 long, at long"


def _run_rows(b: pa.RecordBatch) -> pa.Table:
    """The runs of a batch (doc_id, row1, row2, text); ``at`` is 32 times the place plus the number of sentences."""
    row, at, hashes = [], [], []
    for i, t in enumerate(b.column(3).to_pylist()):
        for place, n, h in runs(sentences(t)):
            row.append(i), at.append(32 * place + n), hashes.append(h)
    halves = np.frombuffer(b"".join(hashes), "<i8").reshape(-1, 2)
    of = pa.array(row, pa.int32())
    ids = [b.column(k).take(of) for k in range(3)]
    return pa.table([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), *ids, pa.array(at, pa.int64())], names=["high", "low", "doc_id", "row1", "row2", "at"])


def run_table(df: DataFrame) -> DataFrame:
    """(high, low, doc_id, row1, row2, at): every run of every text of ``df`` (doc_id, row1, row2, text).

    Of equal runs among ``TOGETHER`` texts, only the first has its hash; the others, repeats for certain, have no ``low`` and
    any number as ``high``."""
    small_batches(df.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        texts = 0

        def told() -> Iterator[pa.RecordBatch]:
            table = pa.concat_tables(held)
            held.clear()
            if table.num_rows:
                order = [(c, "ascending") for c in ("high", "low", "doc_id", "row1", "row2", "at")]
                table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
                high, low = table["high"].to_numpy(), table["low"].to_numpy()
                again = np.concatenate(([False], (high[1:] == high[:-1]) & (low[1:] == low[:-1])))
                spread = np.where(again, np.arange(len(high)) * np.int64(0x9E3779B97F4A7C1) + table["row2"].to_numpy(), high)
                table = table.set_column(0, "high", pa.array(spread)).set_column(1, "low", pa.array(low, mask=again))
            yield from table.combine_chunks().to_batches(max_chunksize=65536)

        for b in batches:
            held.append(_run_rows(b))
            texts += b.num_rows
            if texts >= TOGETHER or sum(t.num_rows for t in held) > 64 * TOGETHER:
                yield from told()
                texts = 0
        if held:
            yield from told()

    return df.select("doc_id", "row1", "row2", "text").mapInArrow(find, _RUN.format(df.schema["doc_id"].dataType.simpleString()))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by hash and occurrence -> (row1, row2, at) of all that are not the first of their hash."""
    last: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        high, low = b.column(0).to_numpy(), b.column(1).fill_null(0).to_numpy()
        told = b.column(1).is_valid().to_numpy(zero_copy_only=False)
        again = np.concatenate(([last == (high[0], low[0])], (high[1:] == high[:-1]) & (low[1:] == low[:-1]) & told[:-1]))
        last = (high[-1], low[-1]) if told[-1] else None
        gone = pa.array(again | ~told)
        yield pa.RecordBatch.from_arrays([b.column(i).filter(gone) for i in (2, 3, 4)], names=["row1", "row2", "at"])


def repeated_runs(found: DataFrame) -> DataFrame:
    """(row1, row2, covered): the places (32 times the first sentence plus the number of sentences) of non-first
    occurrences."""
    dealt = found.repartition("high").sortWithinPartitions("high", "low", "doc_id", "row1", "row2", "at")
    later = dealt.select("high", "low", "row1", "row2", "at").mapInArrow(_later, "row1 long, row2 long, at long")
    return later.groupBy("row1", "row2").agg(F.collect_set("at").alias("covered"))


def _keep(text: str | None, covered: list[int] | None) -> tuple[str | None, int, str]:
    """(kept text, removed sentences, removed stretches as start:end)."""
    gone: set[int] = set()
    for c in covered or ():
        gone.update(range(c // 32, c // 32 + c % 32))
    if not gone:
        return text, 0, ""
    units = sentences(text)
    stretches: list[list[int]] = []
    for i in sorted(gone):
        if stretches and stretches[-1][1] == units[i][0]:
            stretches[-1][1] = units[i][1]
        else:
            stretches.append([units[i][0], units[i][1]])
    at, parts = 0, []
    for a, b in stretches:
        parts.append(text[at:a])
        at = b
    return "".join([*parts, text[at:]]), len(gone), ",".join(f"{a}:{b}" for a, b in stretches)


def remove_repeats(df: DataFrame, doc_id: str, text: str, row: Sequence[str] = ()) -> DataFrame:
    """(doc_id, text, n_removed, removed), one row per row of ``df``: the text without sentences
    that a non-first repeated run covers, and the removed stretches (code points, end exclusive).

    ``row`` names two columns of longs that tell rows apart and are the same whenever ``df`` is computed, such as a file and a
    place in it; without them, a copy with numbers is written.

    Null texts stay null.  Texts of fewer than ``RUN`` sentences or ``LEAST_WORDS``
    words have no runs and stay.  Rows that share a doc_id are cut and judged on their own, in the order of ``row``;
    a null id is an id like any other and is the first.  A long text is cut by one task as a whole.  An empty table gives an
    empty result.  Other columns are left out, so their names can't clash.
    """
    ids = [F.col(c).alias(f"row{k}") for k, c in enumerate(row, 1)] or [F.lit(0).cast("long").alias("row1"), F.monotonically_increasing_id().alias("row2")]
    base = df.select(F.col(doc_id).alias("doc_id"), *ids, F.col(text).alias("text"))
    if not row:
        base = written(base)
    covered = repeated_runs(run_table(base))
    joined = base.join(covered, ["row1", "row2"], "left").select("doc_id", "text", "covered")
    fields = [("kept", T.StringType()), ("n_removed", T.LongType()), ("removed", T.StringType())]

    def run(texts: list, covered: list) -> list[tuple]:
        return list(zip(*map(_keep, texts, covered), strict=True)) or [()] * 3

    out = append_columns(joined, ["text", "covered"], fields, run)
    return out.select("doc_id", F.col("kept").alias("text"), "n_removed", "removed")
