"""Repair of the turn structure of conversations, by the cheapest edits.

A repaired conversation is an optional system turn and pairs of a user's and an assistant's turn.  Its edits, in
the order of their letters, are

* ``D`` (2): the turn goes; blank and repeated turns must
* ``I`` (5): an empty turn of the role that must follow comes in
* ``K`` (0): the turn stays
* ``R`` (1): the turn stays under the role that must follow

and a truncated turn that stays costs 5 more.  The cheapest edits are searched by iterative-deepening A*: depth
first, edits in the order of their letters, under a cost bound that grows from the least that blank, repeated and
truncated turns cost anyway to what the last search exceeded it by.  A table keeps for each state (turns read,
last role) what it failed with, as a bound for its rest.  So the first path that ends in a whole conversation is the
cheapest, and the first in the order of letters among these.  A long conversation is searched from its end, ``BLOCK``
turns at a time, so the table is exact behind each block and the work stays linear in the turns.

Faults are found by Spark; the search reads two bytes per turn, in the conversation's order.  Then each
conversation's edits meet its turns in one shuffle of the texts, and are applied as the turns stream by.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscan.llm.batches import small_batches

DELETE, INSERT, RENAME, CUT = 2, 5, 1, 5
BLOCK = 32
BLANKS = " \t\n\x0b\x0c\r"

#: States are the last role: none, system, user, assistant.  What must follow each, and which may be the last.
_FOLLOWS = (2, 2, 3, 2)
_WHOLE = (True, False, False, True)
_ROLE = {2: "user", 3: "assistant"}
#: The state that a kept turn leads to, by its first letter and the states that it may follow.
_KEPT = {"s": (1, (0,)), "u": (2, (0, 1, 3)), "a": (3, (2,))}
_LEGAL = {"su", "ua", "au"}
#: Codes of a turn's fault.
FINE, BLANK, REPEATED, TRUNCATED = range(4)


def cheapest_edits(initials: str, faults: bytes) -> tuple[int, str]:
    """(cost, edits) for the first letters of the roles and the faults of the turns, in order."""
    n = len(faults)
    least = array("q", bytes(32 * (n + 1)))  # 4 * place + state -> proven least cost of the rest

    def at_least(start: int, end: int) -> None:
        """What the faults of a block cost anyway, before the least that is known behind it."""
        rest = min(least[4 * end : 4 * end + 4])
        for i in range(end - 1, start - 1, -1):
            rest += DELETE if faults[i] else 0
            least[4 * i : 4 * i + 4] = array("q", [rest] * 4)

    def moves(i: int, state: int) -> list[tuple[str, int, int, int]]:
        """(letter, cost, place, state), in the order of letters."""
        follows = _FOLLOWS[state]
        out = [("D", DELETE, i + 1, state)] if i < n else []
        out.append(("I", INSERT, i, follows))
        if i < n and faults[i] not in (BLANK, REPEATED):
            more = CUT if faults[i] == TRUNCATED else 0
            kept, after = _KEPT.get(initials[i], (0, ()))
            if state in after:
                out.append(("K", more, i + 1, kept))
            out.append(("R", RENAME + more, i + 1, follows))
        return out

    def search(i: int, state: int, bound: int, until: int) -> str | None:
        """The first edits from here that cost no more than the bound, as far as place ``until``."""
        path, stack = [], [(i, state, bound, iter(moves(i, state)))]
        while True:
            i, state, left, open_moves = stack[-1]
            if (i == n and _WHOLE[state]) or (i == until < n and len(stack) > 1 and least[4 * i + state] <= left):
                return "".join(path)
            for letter, cost, j, after in open_moves:
                if least[4 * j + after] <= left - cost:
                    path.append(letter)
                    stack.append((j, after, left - cost, iter(moves(j, after))))
                    break
            else:  # failed: the rest costs at least what the cheapest edit leads to
                here = 4 * i + state
                least[here] = max(least[here], min(cost + least[4 * j + after] for _, cost, j, after in moves(i, state)))
                stack.pop()
                if not stack:
                    return None
                path.pop()

    for start in range((n - 1) // BLOCK * BLOCK, 0, -BLOCK):  # the table behind a block is exact
        at_least(start, min(start + BLOCK, n))
        for state in range(4):
            while search(start, state, least[4 * start + state], min(start + BLOCK, n)) is None:
                pass
    at_least(0, min(BLOCK, n))
    while True:
        bound = least[0]
        found = search(0, 0, bound, n)
        if found is not None:
            return bound, found


def with_faults(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, copy, role, text, dropped) and their fault, for the search and without the text."""
    same = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy")
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    plain = turns.select("conv_id", "turn", "copy", "role", F.md5("text").alias("digest"), "dropped", F.length(end).alias("size"), F.right(end, F.lit(1)).alias("last"))
    fault = (
        F.when(F.col("size") == 0, BLANK)
        .when(F.row_number().over(same) > 1, REPEATED)
        .when(~F.col("last").isin(".", "!", "?"), TRUNCATED)
        .otherwise(FINE)
    )
    return plain.withColumn("fault", fault).drop("size", "last")


def _order(*front: str) -> list[Column | str]:
    return [*front, F.col("turn").asc_nulls_first(), "role", "digest", "copy"]


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _search_conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, turn, role, fault, dropped) in order -> a row of ``_REPORT`` per conversation."""
    names = [c.split()[0] for c in _REPORT.split(", ")]
    done: list[tuple] = []
    state: list | None = None

    def close() -> None:
        if state:
            conv, low, high, distinct, initials, faults, illegal = state
            gaps = high - low + 1 - distinct if distinct else 0
            cost, audit = cheapest_edits("".join(initials), bytes(faults))
            done.append((conv, gaps, *(faults.count(f) for f in (BLANK, REPEATED, TRUNCATED)), illegal, cost, audit))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        done.clear()
        kinds = [pa.int64()] * 7 + [pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for conv, turn, role, fault, dropped in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or state[0] != conv:
                close()
                state = [conv, None, None, 0, [], bytearray(), 0]
            if dropped:
                continue
            if turn is not None and turn != state[2]:
                state[1] = turn if state[1] is None else state[1]
                state[2] = turn
                state[3] += 1
            initial = role[:1] or "-"
            if state[4] and state[4][-1] + initial not in _LEGAL:
                state[6] += 1
            state[4].append(initial)
            state[5].append(fault)
        yield batch()
    close()
    yield batch()


def reports(turns: DataFrame) -> DataFrame:
    """One row of ``_REPORT`` per conversation of ``turns`` (conv_id, turn, copy, role, text, dropped).

    ``gaps`` counts whole numbers between the least and greatest turn without a turn; ``illegal`` counts neighbours whose
    roles can't follow each other.  Dropped turns only say that there is such a conversation.  Turns are in the order of
    ``turn`` (nulls first), then role, digest of the text, and copy.  A null id is an id like any other, equal rows are turns of
    their own, texts may be empty or of any length, and no turns give no rows; roles and texts must not be null.  Other columns are
    left out, so their names can't clash.  One task reads a conversation; it holds some 40 bytes per turn, whatever the texts."""
    small_batches(turns.sparkSession)
    rows = with_faults(turns).repartition("conv_id").sortWithinPartitions(*_order("conv_id"))
    return rows.select("conv_id", "turn", "role", "fault", "dropped").mapInArrow(_search_conversations, _REPORT)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, audit, role, text), a conversation's edits before its turns -> (conv_id, position, role, text, edit)."""
    names = ["conv_id", "position", "role", "text", "edit"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    done: list[tuple] = []
    conv, audit, at, state, position = None, "", 0, 0, 0

    def put(role: str, text: str, edit: str) -> None:
        nonlocal position
        done.append((conv, position, role, text, edit))
        position += 1

    def inserts() -> None:
        nonlocal at, state
        while at < len(audit) and audit[at] == "I":
            state, at = _FOLLOWS[state], at + 1
            put(_ROLE[state], "", "I")

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * len(names)
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for here, edits, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if edits is not None:
                inserts()
                conv, audit, at, state, position = here, edits, 0, 0, 0
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = _KEPT[role[0]][0]
                put(role, text, edit)
            elif edit == "R":
                state = _FOLLOWS[state]
                put(_ROLE[state], text, edit)
        yield batch()
    inserts()
    yield batch()


def repaired(turns: DataFrame, report: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit): the turns after the edits of ``report``.  A conversation's turns lie
    together and in order in one partition; a conversation of which nothing is left has none."""
    small_batches(turns.sparkSession)
    kept = turns.filter(~F.col("dropped")).select("conv_id", F.lit(None).cast("string").alias("audit"), "turn", "copy", "role", "text", F.md5("text").alias("digest"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("turn", "long"), ("copy", "int"), ("role", "string"), ("text", "string"), ("digest", "string"))]
    rows = report.select("conv_id", "audit", *none).unionByName(kept)
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("audit").isNull(), *_order())
    return dealt.select("conv_id", "audit", "role", "text").mapInArrow(_apply, "conv_id long, position long, role string, text string, edit string")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv_id, role, text) in order -> (conv_id, repaired_sha256); holds one batch and one running digest."""
    state: list | None = None
    done: list[tuple] = []

    def batch() -> pa.RecordBatch:
        columns = [[d[0] for d in done], [d[1].hexdigest() for d in done]]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string())], names=["conv_id", "repaired_sha256"])

    for b in batches:
        for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if state is None or state[0] != conv:
                if state:
                    done.append(tuple(state))
                state = [conv, hashlib.sha256()]
            else:
                state[1].update(b"\n")
            state[1].update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield batch()
    if state:
        done.append(tuple(state))
    yield batch()


def digested(report: DataFrame, turns: DataFrame) -> DataFrame:
    """``report`` and ``repaired_sha256`` of what ``repaired`` gave: ``role:text``, joined by line ends."""
    digests = turns.select("conv_id", "role", "text").mapInArrow(_digest, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "id")
    out = report.join(digests, report["conv_id"].eqNullSafe(digests["id"]), "left")
    return out.select(*report.columns, F.coalesce("repaired_sha256", F.sha2(F.lit(b""), 256)).alias("repaired_sha256"))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as turns of which some are damaged, by a checksum of their ids: one in 20 each
    is dropped, emptied, loses its ends of sentences, is doubled, or becomes the user's.  Null roles and texts are a blank."""
    blank = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (kind == 0).alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )
