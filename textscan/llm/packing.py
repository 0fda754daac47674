"""Packing into windows by non-negative least squares.

Texts become token ids, each followed by an end id, and are cut at multiples of the window.  Whole windows
are sequences of their own.  What remains of each text is shorter than a window; the histogram of these
lengths (a row per length, so bounded by the window) is all that the driver sees.

The plan: lengths are rounded up to ``UNIT`` tokens, and all combinations of up to three that fill the
window are enumerated.  Non-negative least squares finds how often each combination should be used so that
the histogram comes out; at most as many combinations as there are lengths get a part.

Equal pieces are counted and numbered as copies, so the packing is a function of the rows, however they are
stored.  Pieces are dealt by a hash of piece and copy into groups of about ``GROUP``, without their ids.  Each group uses every
combination its share of times, rounded and as far as its pieces reach, and packs the rest greedily, longest first,
each into the fullest sequence that still has room.  Ids, if asked for, meet their packed pieces in one shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import small_batches, written
from textscan.llm.token_count import encode, tokenizer

WINDOW = 2048
END = 1
UNIT = 8
GROUP = 8192
PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "digest")
#: Distinct words whose ids a worker keeps, some 250 MB.
CACHE = 1_200_000
#: Stems that go to the library in one text.
JOINED = 1000

#: Letters that every Unicode version lowers alike and composes to themselves.
_LATIN = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+")


class WordIds:
    """Ids of texts, word by word: this tokenizer drops white space and merges within words only, so the
    ids of a text are those of its blank-separated words in order."""

    def __init__(self, path: str):
        self.path = path
        self.known: dict[str, bytes] = {}
        vocabulary = tokenizer(path).get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[n for s, n in vocabulary.items() if s.endswith("</w>")]] = True

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > CACHE:
            self.known = {}
        known = self.known
        words = [(t or "").replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        new = {w: self._parts(w) for w in set().union(*words).difference(known)}
        stems = list({p[0] for p in new.values() if p}.difference(known))
        for at in range(0, len(stems), JOINED):
            self._learn(stems[at : at + JOINED])
        rest = [w for w, p in new.items() if not p] + [m for m in (",", ".") if m not in known]
        known.update(zip(rest, (np.array(x, "<u4").tobytes() for x in encode(self.path, rest)), strict=True))
        for w, p in new.items():
            if p:
                known[w] = known[p[0]] + (known[p[1]] if p[1] else b"")
        return [b"".join(map(known.__getitem__, x)) for x in words]

    def _learn(self, stems: list[str]) -> None:
        """Stems of letters, in one text: each is one pre-token, whose last id alone ends a word."""
        ids = np.array(encode(self.path, [" ".join(stems)])[0], "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(stems):  # a tokenizer without word ends
            parts = [np.array(x, "<u4").tobytes() for x in encode(self.path, stems)]
        else:
            raw = ids.tobytes()
            parts = [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        self.known.update(zip(stems, parts, strict=True))

    @staticmethod
    def _parts(word: str) -> tuple[str, str] | None:
        """A word of plain letters as its lower-case letters and the mark behind them, if any."""
        letters, mark = (word[:-1], word[-1]) if word[-1:] in (",", ".") else (word, "")
        return (letters.lower(), mark) if _LATIN.fullmatch(letters) else None


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def pieces(df: DataFrame, doc_id: str, text: str, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, digest[, ids]) with each text cut at multiples of the window;
    ``digest`` is a 128-bit hash of the piece's ids."""
    small_batches(df.sparkSession)
    names = [*PIECE] + ["ids"] * with_ids
    last = np.array([end], "<u4").tobytes()
    kind = df.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, start, size, crc, total, digest, held = [], [], [], [], [], [], []
            for i, ids in enumerate(word_ids(path).ids(b.column(1).to_pylist())):
                ids += last
                n = len(ids) // 4
                for s in range(0, n, window):
                    piece = ids[4 * s : 4 * (s + window)]
                    row.append(i), start.append(s), size.append(len(piece) // 4), crc.append(zlib.crc32(piece)), total.append(n)
                    digest.append(xxhash.xxh3_128_digest(piece))
                    if with_ids:
                        held.append(np.frombuffer(piece, "<i4"))
            arrays = [b.column(0).take(pa.array(row, pa.int32())), *(pa.array(x, pa.int64()) for x in (start, size, crc, total)), pa.array(digest, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays + [pa.array(held, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, digest binary" + ", ids array<int>" * with_ids
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def combinations(units: int) -> list[tuple[int, ...]]:
    """All ways to fill ``units`` with one, two or three lengths."""
    pairs = [(a, units - a) for a in range(1, units // 2 + 1)]
    triples = [(a, b, units - a - b) for a in range(1, units // 3 + 1) for b in range(a, (units - a) // 2 + 1)]
    return [(units,), *pairs, *triples]


def non_negative_least_squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The x >= 0 with the least |a x - b|, by the active set method."""
    x, used = np.zeros(a.shape[1]), np.zeros(a.shape[1], bool)
    tolerance = 1e-9 * max(1.0, float(np.abs(b).max(initial=0)))
    for _ in range(4 * a.shape[0] + 10):
        gain = a.T @ (b - a @ x)
        gain[used] = -np.inf
        # several columns that share no row enter at once, best first
        entered = np.zeros(a.shape[0], bool)
        fresh = False
        for k in np.argsort(-gain)[:256]:
            if gain[k] <= tolerance:
                break
            rows = a[:, k] > 0
            if not entered[rows].any():
                used[k] = fresh = True
                entered |= rows
        if not fresh:
            break
        while True:
            at = np.flatnonzero(used)
            s = np.linalg.lstsq(a[:, at], b, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[at] = s
                break
            bad = s <= 0
            step = np.min(x[at][bad] / np.maximum(x[at][bad] - s[bad], 1e-300))
            x[at] += step * (s - x[at])
            gone = at[bad & (x[at] <= tolerance)]
            if not len(gone):
                gone = at[bad][[np.argmin(x[at][bad])]]
            x[gone], used[gone] = 0, False
    return x


def plan(histogram: dict[int, int], window: int = WINDOW, unit: int = UNIT) -> list[tuple[tuple[int, ...], float]]:
    """(lengths in units, share of all pieces' sequences) of the combinations in use."""
    units = window // unit
    if not histogram or units < 1:
        return []
    b = np.zeros(units + 1)
    for length, n in histogram.items():
        b[-(-length // unit)] += n
    total, chosen = b.sum(), combinations(units)
    chosen = [c for c in chosen if all(b[u] for u in c)]
    if not chosen:
        return []
    a = np.zeros((units + 1, len(chosen)))
    for k, c in enumerate(chosen):
        for u in c:
            a[u, k] += 1
    x = non_negative_least_squares(a, b)
    return [(chosen[k], x[k] / total) for k in np.argsort(-x, kind="stable") if x[k] > 0]


def pack_group(lengths: np.ndarray, shares: list[tuple[tuple[int, ...], float]], window: int = WINDOW, unit: int = UNIT) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of each length, each at most the window."""
    sequence, offset = np.full(len(lengths), -1, np.int64), np.zeros(len(lengths), np.int64)
    free: list[int] = []

    def put(i: int, s: int) -> None:
        sequence[i], offset[i] = s, window - free[s]
        free[s] -= int(lengths[i])

    full = np.flatnonzero(lengths == window)
    sequence[full] = np.arange(len(full))
    free += [0] * len(full)
    by_unit: dict[int, list[int]] = {}
    short = np.flatnonzero(lengths < window)
    for i in short[::-1].tolist():
        by_unit.setdefault(int(-(-lengths[i] // unit)), []).append(i)
    for combination, share in shares:
        for _ in range(round(share * len(short))):
            need = {u: combination.count(u) for u in combination}
            if any(len(by_unit.get(u, ())) < n for u, n in need.items()):
                break
            free.append(window)
            for u in combination:
                put(by_unit[u].pop(), len(free) - 1)
    # the rest: longest first, each into the fullest sequence with room
    room: dict[int, list[int]] = {}
    mask = 0
    for s, f in enumerate(free):
        if f:
            room.setdefault(f, []).append(s)
            mask |= 1 << f
    for i in sorted((i for x in by_unit.values() for i in x), key=lambda i: (-lengths[i], i)):
        n = int(lengths[i])
        fits = mask >> n
        if fits:
            f = n + (fits & -fits).bit_length() - 1
            s = room[f].pop()
            if not room[f]:
                mask ^= 1 << f
        else:
            free.append(window)
            s = len(free) - 1
        put(i, s)
        if free[s]:
            room.setdefault(free[s], []).append(s)
            mask |= 1 << free[s]
    return sequence, offset


def _numbered(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``copy``, from 0 on among equal ones.  Equal pieces are counted before they are shuffled, and
    dealt out in parts of ``GROUP`` when they are numbered."""
    parts = F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / GROUP))
    counted = pieces.groupBy(*PIECE).agg(F.count(F.lit(1)).alias("n")).select(*PIECE, "n", F.explode(parts).alias("part"))
    low, high = F.col("part") * GROUP, F.least((F.col("part") + 1) * GROUP, F.col("n")) - 1
    return counted.repartition("digest", "start", "part").select(*PIECE, F.explode(F.sequence(low, high)).alias("copy"))


def pack(df: DataFrame, doc_id: str, text: str, path: str, window: int = WINDOW, end: int = END, with_ids: bool = False) -> DataFrame:
    """The pieces (doc_id, start, length, ids_crc32, doc_tokens) with ``sequence_id`` and ``offset``.

    Null texts are empty and have the end id alone.  Rows that share an id, or are equal, each have pieces of their own,
    anywhere.  A long text is cut into whole windows and a rest.  An empty table gives an empty result.  Other columns of
    ``df`` are left out, so their names can't clash.  ``with_ids`` adds the ids of each piece.
    """
    if window % UNIT:
        raise ValueError(f"the window must be a multiple of {UNIT}")
    cut = written(pieces(df, doc_id, text, path, window, end, with_ids))
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    total = sum(histogram.values())
    shares = plan({k: n for k, n in histogram.items() if k < window}, window)
    groups = max(1, -(-total // GROUP))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        word_ids.cache_clear()  # of no use any more in this worker
        table = table.sort_by([(c, "ascending") for c in ("spread", "digest", "start", "copy")])
        sequence, offset = pack_group(table["length"].to_numpy(), shares, window)
        table = table.drop_columns(["pack_group", "spread", "copy"])
        return table.append_column("sequence_id", pa.array(sequence + (key[0].as_py() << 32))).append_column("offset", pa.array(offset))

    spread = F.xxhash64(*PIECE, "copy")
    dealt = _numbered(cut.select(*PIECE)).withColumn("spread", spread).withColumn("pack_group", F.pmod(spread, F.lit(groups)))
    schema = T.StructType(cut.select(*PIECE).schema.fields).add("sequence_id", "long").add("offset", "long")
    packed = dealt.groupBy("pack_group").applyInArrow(run, schema)
    if not with_ids:
        return packed.drop("digest")
    held = cut.groupBy("digest").agg(F.first("ids").alias("ids"))  # equal pieces have equal ids, which move once
    return packed.join(held, "digest").select(*[c for c in packed.columns if c != "digest"], "ids")
