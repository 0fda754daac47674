"""Chat formatting from an event log.

A log has one row per event: ``conv`` and ``seq`` order it, ``message`` is the place of the message it is
about, and ``event`` is one of

* ``message``: a whole message (role and text)
* ``delta``: more text for a message, which the first delta opens
* ``edit``: new text for the message
* ``regenerate``: the text so far is dropped, deltas that follow write it anew
* ``retract``: the message goes

A ``key``, where there is one, orders and tells apart messages that share a place.

Events are partitioned by conversation, sorted by message and sequence, and folded into final messages as they stream
by, so a task holds one message at a time.  The template then marks the turns:

    <s>[INST] user [/INST]assistant</s><<SYS>>system<</SYS>>[ROLE "tool"] text [/ROLE]

Control strings inside texts get a backslash behind their first sign (one more if they have some already),
which reading takes away again.  The loss mask covers the assistant's texts.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscan.llm.batches import small_batches

_CONTROL = r"(?:/?s>|</?SYS>>|/?INST\]|/?ROLE\b)"
_PLAIN = re.compile(rf"([<\[])(\\*)(?={_CONTROL})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)(?={_CONTROL})")
#: Opening and closing mark by role.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
BEGIN = "<s>"
_OPENING = re.compile(r'\[INST\] |<<SYS>>|\[ROLE ("(?:[^"\\]|\\.)*"|null)\] ')


def escape(text: str) -> str:
    return _PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2", text)


def render(role: str | None, text: str | None) -> tuple[str, int, int]:
    """(the turn, start and end of the loss mask in it; both 0 without one)."""
    body = escape(text or "")
    if role in MARKS:
        before, after = MARKS[role]
    else:
        # a role is JSON with its signs "<" and "[" spelled out, so it holds no control string
        name = json.dumps(role).replace("<", "\\u003c").replace("[", "\\u005b")
        before, after = f"[ROLE {name}] ", " [/ROLE]"
    masked = (len(before), len(before) + len(body)) if role == "assistant" else (0, 0)
    return before + body + after, *masked


def parse(turn: str) -> tuple[str | None, str]:
    """(role, text) of a rendered turn."""
    m = _OPENING.match(turn)
    if m is None:
        return "assistant", unescape(turn[: -len("</s>")])
    if m.group(1) is not None:
        return json.loads(m.group(1)), unescape(turn[m.end() : -len(" [/ROLE]")])
    role = "user" if m.group() == "[INST] " else "system"
    return role, unescape(turn[m.end() : -len(MARKS[role][1])])


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation, message and sequence -> final messages, rendered."""
    open_message: list | None = None
    before: tuple | None = None
    done: list[tuple] = []

    def close() -> None:
        nonlocal open_message
        if open_message:
            (conv, message, role), parts, copy = open_message
            done.append((conv, message, copy, *render(role, "".join(parts))))
        open_message = None

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 6
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv", "message", "copy", "turn", "loss_start", "loss_end"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    copy = 0
    for b in batches:
        for conv, message, key, event, role, text in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if (conv, message, key) != before:
                close()
                if before is None or before[:2] != (conv, message):
                    copy = 0
                before = (conv, message, key)
            if event == "message" or (open_message is None and event in ("delta", "edit")):
                close()
                open_message = [(conv, message, role), [text or ""], copy]
                copy += 1
            elif open_message is None:
                continue
            elif event == "delta":
                open_message[1].append(text or "")
            elif event == "edit":
                open_message[1] = [text or ""]
            elif event == "regenerate":
                open_message[1] = []
            elif event == "retract":
                open_message = None
        yield batch()
    close()
    yield batch()


def format_log(events: DataFrame) -> DataFrame:
    """(conv, message, copy, turn, loss_start, loss_end): the formatted turns of an event log (conv, message, seq, event, role,
    text, and key if messages share places).  A conversation's turns lie together and in order in one partition.

    Null ids are an id of their own, null texts are empty, unknown events and events about a message that
    isn't open are left out.  Events with the same sequence number are folded in the order of event, role and
    text; messages that share their place all stay, numbered by ``copy``: those of different keys, and whole messages of
    one key.  Equal rows are different events.  A text of any length is one value.  An empty log gives no rows; other columns are left out,
    so their names can't clash.
    """
    small_batches(events.sparkSession)
    key = F.col("key") if "key" in events.columns else F.lit("")
    rank = F.when(F.col("event") == "message", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "delta", 2).otherwise(3)
    rows = events.select("conv", "message", key.alias("key"), "event", "role", "text", "seq", rank.alias("event_rank"))
    dealt = rows.repartition("conv").sortWithinPartitions("conv", "message", "key", "seq", "event_rank", "role", "text")
    return dealt.drop("seq", "event_rank").mapInArrow(_fold, "conv long, message long, copy long, turn string, loss_start long, loss_end long")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by conversation and message -> one row per conversation, read back from the turns.
    Holds one batch and two running digests, however long a conversation is."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    state: list | None = None
    done: list[tuple] = []

    def close() -> None:
        if state:
            conv, n, turns, chars, loss, size = state
            done.append((conv, n, turns.hexdigest(), chars, loss.hexdigest(), size))

    def batch() -> pa.RecordBatch:
        columns = list(zip(*done, strict=True)) or [()] * 6
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

    for b in batches:
        for conv, turn, start, end in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if state is None or state[0] != conv:
                close()
                state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), len(BEGIN)]
            role, text = parse(turn)
            masked = unescape(turn[start:end])
            state[1] += 1
            state[2].update(f"{role or ''}\n{text}\n".encode("utf-8", "surrogatepass"))
            state[3] += len(masked)
            state[4].update(masked.encode("utf-8", "surrogatepass"))
            state[5] += len(turn)
        yield batch()
    close()
    yield batch()


def digests(turns: DataFrame) -> DataFrame:
    """Per conversation of ``format_log``: its turns, their digest, the text under the loss mask, and the formatted length,
    with ``BEGIN`` once in front.

    A digest of a whole conversation needs its turns in order, so one task reads them; it streams."""
    columns = ["conv", "turn", "loss_start", "loss_end"]
    return turns.select(*columns).mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def conversation_events(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) as the log of a chat in which they came about, each in one of four ways: as a
    whole, in three deltas, by an edit of a draft, or in deltas after another start was dropped.  What folding
    the log must give is the rows."""
    text = F.coalesce("text", F.lit(""))
    third = F.ceil(F.length(text) / 3).cast("int")
    parts = [F.substring(text, 1, third), F.substring(text, third + 1, third), F.substring(text, 2 * third + 1, F.length(text))]

    def event(kind: str, value: Column) -> Column:
        return F.struct(F.lit(kind).alias("event"), value.alias("text"))

    deltas = [event("delta", p) for p in parts]
    ways = [
        [event("message", text)],
        deltas,
        [event("message", parts[2]), event("edit", text)],
        [event("delta", F.reverse(parts[0])), event("regenerate", F.lit("")), *deltas],
    ]
    way = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(len(ways)))
    happened = F.when(way == 0, F.array(*ways[0])).when(way == 1, F.array(*ways[1])).when(way == 2, F.array(*ways[2])).otherwise(F.array(*ways[3]))
    key = F.concat(F.coalesce("role", F.lit("")), F.lit("\0"), F.md5(text.cast("binary")), F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    rows = conversations.select("conv_id", "turn", "role", key.alias("key"), happened.alias("happened"))
    rows = rows.select("conv_id", "turn", "role", "key", F.posexplode("happened").alias("seq", "e"))
    return rows.select(
        F.col("conv_id").alias("conv"), F.col("turn").alias("message"), "key", F.col("seq").cast("long").alias("seq"), "e.event", "role", "e.text"
    )


#: Fixed value: the conversation of control strings that the query adds.
PROBE = "</s>[INST] ok [/INST]"

#: DuckDB SQL for the query.
SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
escaped AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '[<\[]\\*(/?s>|</?SYS>>|/?INST\]|/?ROLE\b)')) AS size FROM rows)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(coalesce(role, '') || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (3 + sum(size + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 WHEN 'system' THEN 15 ELSE coalesce(length(to_json(role)), 4) + 16 END))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""
