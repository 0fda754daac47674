"""Texts in pieces, with the patterns that each piece may match.

Most patterns are searched for in a few sentences of a text only.  An Arrow UDF cuts the texts behind full stops and tests each
piece with the linear-time regexes of Arrow (RE2); the patterns themselves then run, as everywhere, on the JVM, but only in the
pieces that passed.  The tests are wider than the patterns: where engines or Unicode versions may differ, any character passes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from textscan.catalog import PATTERNS, Pattern
from textscan.functions.regexes import START_MARK, let, marked, replaced

#: With fewer patterns, a plain search of the whole text costs less than the way to Python and back.
MANY = 8
_BITS = 60  # patterns per integer of a mask

# What may be a character of a word, a blank, a digit or no character of a word, for any Unicode version.
_W = r"[0-9A-Za-z_\x{80}-\x{10FFFF}]"
_S = r"[\x00-\x20\x{80}-\x{A0}\x{1680}-\x{10FFFF}]"
_D = r"[0-9\x{600}-\x{10FFFF}]"
_NO_WORD = r"[^0-9A-Za-z_\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{24F}]"
_TWO_WORDS, _AND_TWO = f"{_W}{_S}+{_W}+{_S}+", f"{_S}+{_W}+{_S}+{_W}"

#: Tests of labels (of all patterns, or of each in order; None: the gate of the catalog).
_TESTS = {
    "interrogative_context": f"{_TWO_WORDS}(?:how|why|what|when|where|who){_AND_TWO}",
    "reporting_statement": f"{_TWO_WORDS}{_W}+{_S}+(?:said|stated|reported|mentioned|claimed|explained|noted|suggested){_S}",
    "entity_name": f"{_TWO_WORDS}(?:by|from|to|with|about|for){_S}+[A-Z][a-z]+{_AND_TWO}",
    "all_caps_phrase": f"{_TWO_WORDS}[A-Z][A-Z]+{_AND_TWO}",
    "quoted_text": f"{_TWO_WORDS}\"",
    "action_context": f"{_TWO_WORDS}{_W}+{_S}+(?:completed|developed|initiated|threatened|investigated){_S}+{_W}",
    "possessive_context": rf"{_TWO_WORDS}[A-Z][a-z]+['’]s{_S}|(?:owned|reported|handled) by{_S}+[A-Z][a-z]",
    "proper_noun": f"{_TWO_WORDS}[A-Z][a-z]+{_AND_TWO}",
    "adjective_context": f"{_TWO_WORDS}(?:critical|urgent|significant|dangerous|illegal|fraudulent){_S}+{_W}",
    "question_context": rf"{_TWO_WORDS}(?:who|what|why|how|where|when)(?:{_S}+{_W}+)+\?",
    "number_context": f"{_TWO_WORDS}{_D}[0-9,.\\x{{600}}-\\x{{10FFFF}}]*{_AND_TWO}",
    "threat_context": f"{_TWO_WORDS}(?:threat|risk|danger|exploit)(?:{_S}+{_W}+)+[.!?]",
    "phone_number": rf"{_D}{{3}}[-.]?{_S}?{_D}{{4}}",
    "ipv6": (None, None, r"!(?s:.*)::(?s:.*)::", None, None, None),
    "ipv4": rf"(?:{_D}{{1,3}}\.){{3}}{_D}",
    "datetime": (
        rf"{_D}{{4}}-{_D}{{2}}-{_D}{{2}}(?:T|{_S}){_D}{{2}}:",
        rf"{_D}{{4}}[/-][01][0-9][/-][0-3][0-9]",
        r"[0-2][0-9]:[0-5][0-9]:[0-6][0-9]",
        r"[0-2][0-9]:[0-5][0-9]",
        rf"{_D}{{2}}/{_D}{{2}}/{_D}{{4}} {_D}{{2}}:",
        rf"{_D}{{2}}/{_D}{{2}}/{_D}{{2}} {_D}{{2}}:",
        r"[0-2][0-9]:[0-5][0-9]",
        rf"{_D}{{8}} {_D}{{2}}:",
    ),
    "date": (
        rf"{_D}{{4}}[-/]{_D}{{1,2}}[-/]{_D}",
        rf"{_D}[-/]{_D}{{1,2}}[-/]{_D}{{4}}",
        rf"{_D}(?:st|nd|rd|th){_S}{_D}{{4}}",
        rf"{_D}(?:st|nd|rd|th){_S}{_D}{{4}}",
    ),
    "time": (rf"{_D}{{2}}[:.]{_D}{{2}}", rf"{_D}(?i:[ap]m)"),
    "mac": (r"(?:[0-9a-fA-F]{2}[:-]){5}[0-9a-fA-F]{2}", None, None),
    "analyze": (None, None, None, None, r"(?:[A-Za-z0-9]{2}[,:|.-](?:[A-Za-z0-9]{2})?){4}"),
    "unix_path": r"(?:^|[ \t\n])/[a-zA-Z0-9_.-]",
}
#: Patterns (label and number) that may go over a full stop and a blank.  Those of the first kind begin in the piece that has what
#: their test looks for, so texts are searched from there on; the other is searched for in the text as a whole.
_ONWARD = {("reporting_statement", 0), ("quoted_text", 0), ("action_context", 0)}
_WHOLE = {("ipv6", 2)}
_FOLDS = {"i": "[iıİ]"}  # the JVM takes these for equal; RE2 knows the others (s, k)
#: Labels that have a digit in every match: their tests run on the pieces with a digit.
_WITH_DIGIT = ("number_context", "phone_number", "datetime", "date", "time", "ipv4")


def _wide(gate: str) -> str:
    """A gate of the catalog as a test."""
    return gate.replace(r"(?<!\w)", f"(?:^|{_NO_WORD})").replace(r"\d", _D).replace(r"\s", _S)


def _any_word(words: Sequence[str]) -> str:
    spelled = "|".join("".join(_FOLDS.get(c, c) for c in w) for w in words)
    return f"(?:^|{_NO_WORD})(?i:{spelled})(?:$|{_NO_WORD})"


def _tests(patterns: Sequence[Pattern]) -> list[tuple[str | None, str | None, str]]:
    """Per pattern: a test that several share, its own test and what is searched: the "pieces" that pass, the text from the first of
    them "onward", or the "whole" text."""
    some_word = _any_word(sorted({w for p in patterns for w in p.words}))
    numbers = {p: sum(q.label == p.label for q in PATTERNS[:i]) for i, p in enumerate(PATTERNS)}
    out = []
    for p in patterns:
        if p not in numbers:  # not of the catalog
            out.append((None, None, "whole"))
            continue
        own = _TESTS.get(p.label)
        own = own[numbers[p]] if isinstance(own, tuple) else own
        shared = _D if p.label in _WITH_DIGIT else None
        if own is None and p.words:
            shared, own = some_word, _any_word(p.words)
        elif own is None and p.gate is not None:
            own = _wide(p.gate)
        key = (p.label, numbers[p])
        out.append((shared, own, "whole" if key in _WHOLE else "onward" if key in _ONWARD else "pieces"))
    return out


def cutter(tests: Sequence[tuple[str | None, str | None, str]]) -> Callable[[pa.Array], pa.Array]:
    """A function from texts to struct<mask0.., pieces: array<struct<text, mask0..>>>; bit i of the masks says that pattern i may
    match.  A piece ends behind a full stop with white space after it; neighbours with the same masks are one piece.  It goes
    to the tasks with all that it calls, so they need not find this package."""
    count = -(-len(tests) // _BITS)
    names = [f"mask{k}" for k in range(count)]
    bits = [(i // _BITS, np.int64(1 << i % _BITS)) for i in range(len(tests))]

    def strings(offsets: np.ndarray, data: pa.Buffer) -> pa.Array:
        return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), data)

    def holding(texts: pa.Array, test: str) -> np.ndarray:
        return np.flatnonzero(pc.fill_null(pc.match_substring_regex(texts, test), False).to_numpy(zero_copy_only=False))

    def cut(texts: pa.Array) -> pa.Array:
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        data = pa.py_buffer(b"") if data is None else data
        rows = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held = np.frombuffer(data, np.uint8)[rows[0] : rows[-1]]
        after = held[1:]
        stops = (held[:-1] == ord(".")) & ((after == ord(" ")) | ((after >= ord("\t")) & (after <= ord("\r"))))
        ends = np.union1d(np.flatnonzero(stops) + 1 + rows[0], rows)
        pieces = strings(ends, data)
        of_piece, of_row = np.zeros((count, len(pieces)), np.int64), np.zeros((count, len(texts)), np.int64)
        shared = {s: holding(pieces, s) for s in {s for s, _, _ in tests} if s is not None}
        fewer = {s: pieces.take(pa.array(at)) for s, at in shared.items()}
        known = {}
        for (k, bit), (prior, test, searched) in zip(bits, tests, strict=True):
            if test is None:
                (of_row if searched == "whole" else of_piece)[k] |= bit
            elif searched == "whole":
                of_row[k, holding(texts, test)] |= bit
            else:
                if (prior, test) not in known:
                    known[prior, test] = holding(pieces, test) if prior is None else shared[prior][holding(fewer[prior], test)]
                of_piece[k, known[prior, test]] |= bit
        at = np.searchsorted(ends[:-1], rows[:-1])  # the first piece of each row; an empty text has none
        row_of = np.searchsorted(rows, ends[:-1], side="right") - 1
        for masks, found in zip(of_row, of_piece, strict=True):
            np.bitwise_or.at(masks, row_of, found)
        new = np.ones(len(pieces), bool)
        new[1:] = (of_piece[:, 1:] != of_piece[:, :-1]).any(axis=0)
        new[at[at < len(pieces)]] = True
        first = np.flatnonzero(new)
        joined = strings(np.append(ends[first], ends[-1]), data).cast(pa.string())
        items = pa.StructArray.from_arrays([joined, *[pa.array(m[first]) for m in of_piece]], ["text", *names])
        lists = pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(first, at), len(first)).astype(np.int32)), items)
        return pa.StructArray.from_arrays([*[pa.array(m) for m in of_row], lists], [*names, "pieces"])

    return cut


def in_pieces(text: Column, patterns: Sequence[Pattern]) -> Column:
    """The ``cutter`` on a text (as searched, see ``markable``) for the patterns."""
    masks = ",".join(f"mask{k}:bigint" for k in range(-(-len(patterns) // _BITS)))
    return F.arrow_udf(cutter(_tests(patterns)), f"struct<{masks},pieces:array<struct<text:string,{masks}>>>")(text)


def marked_pieces(text: Column, cut: Column, patterns: Sequence[Pattern], values_only: Sequence[Pattern] = ()) -> dict[Pattern, Column]:
    """``marked`` of the text for each pattern; only the pieces that may hold a match are searched.  For ``values_only``, a blank
    stands for each other piece, so that matches that touch still do, but offsets are lost."""

    def joined(pieces: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda x: x["text"]), "")

    def of_pattern(i: int, p: Pattern, searched: str) -> Column:
        def may(x: Column) -> Column:
            return x[f"mask{i // _BITS}"].bitwiseAND(F.lit(1 << i % _BITS).cast("bigint")) != 0

        def rest(x: Column) -> Column:
            return F.lit(" ") if p in values_only else x["text"]

        def onward(first: Column) -> Column:
            head, tail = F.slice(cut["pieces"], F.lit(1), first - 1), F.slice(cut["pieces"], first, F.size(cut["pieces"]))
            return F.concat(joined(head), replaced(joined(tail), p))

        if searched == "whole":
            return marked(text, p, may(cut))
        if searched == "onward":
            hit = let(F.array_position(F.transform(cut["pieces"], may), True).cast("int"), onward)
        else:
            hit = F.array_join(F.transform(cut["pieces"], lambda x: F.when(may(x), replaced(x["text"], p)).otherwise(rest(x))), "")
        return F.when(may(cut), let(hit, lambda m: F.when(F.contains(m, F.lit(START_MARK)), m)))

    return {p: of_pattern(i, p, searched) for i, (p, (_, _, searched)) in enumerate(zip(patterns, _tests(patterns), strict=True))}
