"""The repair of conversations against a plain shortest path over all edits, and the query against plain Python."""

import hashlib
import random
import re
import time
import zlib

import pytest

from textscan.llm import turn_repair
from textscan.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def plain_edits(initials, faults):
    """(cost, edits): the least pair over all edits, by relaxing suffixes until nothing changes."""
    n = len(faults)
    best = {(n, 0): (0, ""), (n, 3): (0, "")}
    for i in range(n, -1, -1):
        changed = True
        while changed:
            changed = False
            for state in range(4):
                options = [best[i, state]] if (i, state) in best else []
                after = {0: 2, 1: 2, 2: 3, 3: 2}[state]
                steps = [("I", 5, (i, after))]
                if i < n:
                    steps.append(("D", 2, (i + 1, state)))
                    if faults[i] in (0, 3):
                        extra = 5 if faults[i] == 3 else 0
                        steps.append(("R", 1 + extra, (i + 1, after)))
                        if (initials[i], state) in {("s", 0), ("u", 0), ("u", 1), ("u", 3), ("a", 2)}:
                            steps.append(("K", extra, (i + 1, "_sua".index(initials[i]))))
                options += [(cost + best[to][0], letter + best[to][1]) for letter, cost, to in steps if to in best]
                if options and min(options) != best.get((i, state)):
                    best[i, state] = min(options)
                    changed = True
    return best[0, 0]


@pytest.mark.parametrize("block", [32, 3])
def test_cheapest_edits(monkeypatch, block):
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(1500):
        n = rng.randint(0, 14)
        initials = "".join(rng.choice("suauat") for _ in range(n))
        faults = bytes(rng.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        assert turn_repair.cheapest_edits(initials, faults) == plain_edits(initials, faults), (initials, faults)


def test_long_conversations_take_linear_time():
    rng = random.Random(5)
    initials = "".join(rng.choice("uauauas") for _ in range(60_000))
    began = time.monotonic()
    cost, audit = turn_repair.cheapest_edits(initials, bytes(rng.choice([0, 0, 0, 1, 3]) for _ in range(60_000)))
    assert time.monotonic() - began < 60 and cost > 10_000 and len(audit.replace("I", "")) == 60_000


def plain_rows(rows):
    groups = {}
    for conv, turn, role, text in rows:
        groups.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        groups[conv] += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    out = []
    for conv, turns in groups.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        seen, faults = set(), []
        for _, role, text in turns:
            rest = re.sub(r"[\x20\x09-\x0D]+", "", text)
            faults.append(1 if not rest else 2 if (role, text) in seen else 3 if rest[-1] not in ".!?" else 0)
            seen.add((role, text))
        initials = [r[1][:1] or "-" for r in turns]
        cost, audit = plain_edits(initials, faults)
        state, i, lines = 0, 0, []
        for edit in audit:
            follows = {0: 2, 1: 2, 2: 3, 3: 2}[state]
            if edit == "K":
                lines.append(f"{turns[i][1]}:{turns[i][2]}")
                state = "_sua".index(initials[i])
            elif edit != "D":
                lines.append(f"{['', '', 'user', 'assistant'][follows]}:{turns[i][2] if edit == 'R' else ''}")
                state = follows
            i += edit != "I"
        known = [t for t, _, _ in turns if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        out.append((conv, gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def odd_rows():
    rng = random.Random(9)
    rows = []
    for conv in [None, *range(40)]:
        for _ in range(rng.randint(1, 70 if conv == 7 else 9)):
            turn = rng.choice([None, *range(12)])
            rows.append((conv, turn, rng.choice(["user", "assistant", "system", "tool", None, ""]), rng.choice(["Yes.", "No! \n", "cut", "", None, "　", "Ünï日🙂?", "x" * 5000 + "."])))
    return rows + rows[:20]


def test_query_against_plain_python(spark, tmp_path):
    for rows in (odd_rows(), [tuple(r) for r in spark.read.parquet(f"{DATA}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()], []):
        path = f"{tmp_path}/{len(rows)}"
        spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(f"{path}/conversations.parquet")
        got = QUERIES["op12_turn_repair"](spark, path).collect()
        assert sorted((tuple(r) for r in got), key=str) == plain_rows(rows)


def test_repaired_turns(spark):
    rows = [(1, 0, "user", "Hello?"), (1, 1, "user", "Hi."), (1, 2, "user", "Hi."), (1, 3, "assistant", "and so"), (2, 0, "tool", " ")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "0 as copy", "false as dropped")
    report = turn_repair.reports(turns)
    assert {r["conv_id"]: (r["cost"], r["audit"]) for r in report.collect()} == {1: (5, "KRDD"), 2: (2, "D")}
    got = turn_repair.repaired(turns, report).collect()
    assert [tuple(r) for r in got] == [(1, 0, "user", "Hello?", "K"), (1, 1, "assistant", "Hi.", "R")]
