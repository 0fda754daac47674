"""Python regular expressions as Spark Columns.

``to_jvm`` writes a Python pattern in the dialect of Spark's regex functions.
Both dialects give group 0 of every match the same text: the class shorthands
are spelled out, because Java's ``\\w \\d \\s`` are ASCII and its ``\\b`` differs
between Java versions, while Python's follow Unicode.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from textscan.catalog import Pattern

_WORD = r"\p{L}\p{N}_"
_SPACE = r"\t-\r\x1c-\x20\x85\p{Z}"
_CLASS = {"w": _WORD, "d": r"\p{Nd}", "s": _SPACE}
_NEGATED = {"W": f"[^{_WORD}]", "D": r"\P{Nd}", "S": f"[^{_SPACE}]"}

_STARTS = f"(?<![{_WORD}])"
_ENDS = f"(?![{_WORD}])"
_BOUNDARY = f"(?:(?<![{_WORD}])(?=[{_WORD}])|(?<=[{_WORD}])(?![{_WORD}]))"

# "\b" that has a word character on its right (or left) for certain needs to
# look at the other side only.  These rules are right for the shapes in the
# catalog; patterns from elsewhere always get the full test.
_GROUP = r"\((?:\?:|\?=|\?i:|\?P<\w+>)?"
_ATOM = r"(?:\\w|\\d|\[[A-Za-z0-9-]+\])"
_WORD_FOLLOWS = re.compile(rf"(?:{_GROUP})*(?:(?:\\w|\\d|[A-Za-z0-9])(?![?*{{])|{_ATOM}(?:\+|\{{[1-9]))")
_MAY_BE_EMPTY = re.compile(rf"(?:{_GROUP})+[^()]*(?:\|\)|\)[?*])")
_WORD_BEFORE = re.compile(rf"(?:{_ATOM}(?:\+{{1,2}}|\{{[1-9]\d*(?:,\d*)?\}})?|(?<![\\+#|])[A-Za-z0-9])\)*$")
_SYMBOL_ENDING = re.compile(r"[+#]\||\|\)|[+#]\)$")

_GLOBAL_FLAGS = re.compile(r"\(\?([imsx]+)\)")
_WORD_LIST = re.compile(r"\(\?i:((?:[A-Za-z][^()|\[\]]*\|)+[A-Za-z][^()|\[\]]*)\)")

START_MARK, END_MARK, MARK_STAND_IN = "\u0001", "\u0002", "\u0003"
#: Marks of the catalog's patterns in steps.
STEP_MARKS = "\u0004\u0005"


def _boundary(before: str, after: str) -> str:
    after = re.sub(r"^(?:\(\?=[^()]*\))+", "", after)  # look-aheads take nothing
    if _WORD_FOLLOWS.match(after) and not _MAY_BE_EMPTY.match(after):
        return _STARTS
    if _WORD_BEFORE.search(before) and not _SYMBOL_ENDING.search(before):
        return _ENDS
    return _BOUNDARY


def _word_list(alternatives: list[str], boundary: str) -> str:
    """A case-insensitive word list as a JVM group.  Words are gathered by first
    letter, behind a test of the first letter, so that most positions of a text
    are dismissed by one look; words with different first letters exclude each
    other, so the order of preference stays the same."""
    by_letter: dict[str, list[str]] = {}
    for word in alternatives:
        by_letter.setdefault(word[0].lower(), []).append(word[1:])
    letters = "".join(c + c.upper() + {"s": "\u017f", "k": "\u212a"}.get(c, "") for c in by_letter)
    branches = "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())
    return f"(?=[{letters}]){boundary}(?iu:{branches})"


def word_list(words: Sequence[str]) -> str:
    """A JVM pattern for whole words of ASCII letters, digits and ``_`` in any case."""
    return f"{_word_list(sorted(words), _STARTS)}{_ENDS}"


def to_jvm(regex: str, known: bool = False) -> str:
    """The pattern in the JVM dialect, Unicode-aware as in Python.  ``known``
    says that the pattern is from the catalog."""
    out, i, in_class = [], 0, False
    while i < len(regex):
        c = regex[i]
        if c == "\\":
            n = regex[i + 1]
            if in_class and n in _CLASS:
                out.append(_CLASS[n])
            elif n in _CLASS:
                out.append(f"[{_CLASS[n]}]" if n != "d" else _CLASS[n])
            elif n in _NEGATED:
                out.append(_NEGATED[n])
            elif n == "b" and not in_class:
                out.append(_boundary(regex[:i], regex[i + 2:]) if known else _BOUNDARY)
            elif n == "Z" and not in_class:
                out.append(r"\z")
            else:
                out.append(c + n)
            i += 2
            continue
        if in_class:
            if c == "[" or (c == "&" and regex[i + 1:i + 2] == "&"):
                out.append("\\")
            elif c == "]" and regex[i - 1] not in "[^" or c == "]" and regex[i - 2:i] == "\\[":
                in_class = False
        elif c == "[":
            in_class = True
        elif regex.startswith("(?P<", i):
            i = regex.index(">", i) + 1
            out.append("(")  # group numbers stay as they are
            continue
        elif regex.startswith("(?P=", i):
            end = regex.index(")", i)
            out.append(f"\\{_group_numbers(regex)[regex[i + 4:end]]}")
            i = end + 1
            continue
        elif flags := _GLOBAL_FLAGS.match(regex, i):
            out.append(f"(?{flags.group(1).replace('i', 'iu')})")
            i = flags.end()
            continue
        elif regex.startswith("{,", i):
            out.append("{0,")
            i += 2
            continue
        elif regex.startswith("(?i:", i):
            words = _WORD_LIST.match(regex, i)
            if words:
                boundary = out.pop() if out and out[-1] in (_STARTS, _BOUNDARY) else ""
                out.append(_word_list([to_jvm(w)[4:] for w in words.group(1).split("|")], boundary))
                i = words.end()
            else:
                out.append("(?iu:")
                i += 4
            continue
        out.append(c)
        i += 1
    return "(?d)" + "".join(out)


def jvm_regex(pattern: Pattern) -> str:
    return to_jvm(pattern.jvm or pattern.regex, known=pattern.group != "custom")


def _group_numbers(regex: str) -> dict[str, int]:
    return dict(re.compile(regex).groupindex)


def jvm_replacement(replacement: str, regex: str = "") -> str:
    r"""A Python replacement template (``\1``, ``\g<1>``, ``\g<name>``) in Java's
    ``$1`` form."""

    def group(m: re.Match) -> str:
        name = m.group(1) or m.group(2)
        return "$" + (name if name.isdigit() else str(_group_numbers(regex)[name]))

    return re.sub(r"\\g<(\w+)>|\\(\d+)", group, replacement.replace("$", r"\$"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` computed once however often used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sanitize(text: Column) -> Column:
    """Drop unprintable characters (line ends and tabs included), then collapse
    runs of blanks."""
    return F.regexp_replace(F.regexp_replace(text, r"(?=[^ -~])[\p{C}\p{Z}&&[^ ]]+", ""), " {2,}", " ")


def running(
    values: Column, merge: Callable[[Column, Column], Column], start: Column, block: int = 256
) -> Column:
    """Exclusive running ``merge`` (an associative function such as + or
    greatest) of an integer array, beginning with ``start``.

    Appending to an array copies it, so the fold runs on blocks of fixed size
    and once more over the block results; cost stays linear in the array size.
    """

    def fold(items: Column, first: Column) -> Column:
        init = F.struct(F.array().cast("array<int>").alias("seen"), first.cast("int").alias("last"))
        return F.aggregate(
            items,
            init,
            lambda acc, x: F.struct(
                F.concat(acc["seen"], F.array(acc["last"])).alias("seen"), merge(acc["last"], x).alias("last")
            ),
        )["seen"]

    def result(items: Column) -> Column:
        return F.aggregate(items, start.cast("int"), merge)

    def in_blocks(v: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.floor((F.size(v) - 1) / block).cast("int")),
            lambda b: F.slice(v, b * block + 1, F.lit(block)),
        )
        return let(
            blocks,
            lambda parts: F.flatten(F.zip_with(parts, fold(F.transform(parts, result), start), fold)),
        )

    return let(values, lambda v: F.when(F.size(v) <= block, fold(v, start)).otherwise(in_blocks(v)))


#: A regex that matches one string only.
_LITERAL = re.compile(r"(?:\\[^A-Za-z0-9]|[^\\\[\](){}|?*+.^$])+")


def _passes(text: Column, gate: str) -> Column:
    """Whether the text has a match of a gate; a plain string is searched without a regex."""
    if _LITERAL.fullmatch(gate):
        return F.contains(text, F.lit(re.sub(r"\\(.)", r"\1", gate)))
    return text.rlike(to_jvm(gate))


def markable(text: Column, sanitized: bool) -> Column:
    """The text to match on: free of the marks used below, same length."""
    marks = START_MARK + END_MARK + STEP_MARKS
    return text if sanitized else F.translate(text, marks, MARK_STAND_IN * len(marks))


#: Letters that match "i", "s" and "k" without regard to case.
_FOLDED = ("\u0130\u0131\u017f\u212a", "iisk")


def with_triggers(text: Column, patterns: Sequence[Pattern], body: Callable[[Sequence[Column]], Column]) -> Column:
    """``body`` of one boolean per pattern: whether the pattern may match the text at all.

    The words of the text are cut once and looked up in one set of all words that begin a phrase; each distinct gate
    runs once, however many patterns share it."""
    known = sorted({w for p in patterns for w in p.words})
    gates = sorted({p.gate for p in patterns if p.gate is not None})

    def with_words(words: Column | None) -> Column:
        tests = [_passes(text, g) for g in gates]

        def read(passed: Column | None) -> Column:
            out = []
            for p in patterns:
                may = F.lit(True)
                if p.words:
                    may = F.arrays_overlap(words, F.array(*map(F.lit, p.words)))
                if p.gate is not None:
                    gate = F.get(passed, F.lit(gates.index(p.gate)))
                    may = may & gate if p.words else gate
                out.append(may)
            return body(out)

        return let(F.array(*tests), read) if gates else read(None)

    if not known:
        return with_words(None)
    words = F.split(F.lower(F.translate(text, *_FOLDED)), f"[^{_WORD}]+")
    return let(F.array_intersect(words, F.array(*map(F.lit, known))), with_words)


def replaced(text: Column, pattern: Pattern) -> Column:
    """The text with a mark before and after every match, by one regex pass or the pattern's steps."""
    hit = text
    for regex, replacement in pattern.steps or [(pattern.jvm or pattern.regex, f"{START_MARK}$0{END_MARK}")]:
        hit = F.regexp_replace(hit, F.lit(to_jvm(regex, known=pattern.group != "custom")), F.lit(replacement))
    return hit


def marked(text: Column, pattern: Pattern, trigger: Column | None = None) -> Column:
    """The text with its matches marked; null if nothing matches, so that no copy of a text without a match is kept.
    ``trigger`` tells whether the pattern may match; without it, the pattern's gate does."""
    kept = let(replaced(text, pattern), lambda m: F.when(F.contains(m, F.lit(START_MARK)), m))
    if trigger is None and pattern.gate is not None:
        trigger = _passes(text, pattern.gate)
    return kept if trigger is None else F.when(trigger, kept)


def matches(text: Column, pattern: Pattern) -> Column:
    """Whether the pattern matches anywhere in the text."""
    if pattern.steps:
        return marked(markable(text, False), pattern).isNotNull()
    return text.rlike(jvm_regex(pattern))


def _pieces(marked_text: Column, read: Callable[[Column], Column], type_of_result: str) -> Column:
    """``read`` of a marked text cut at its start marks; empty without matches."""
    return F.when(marked_text.isNotNull(), let(F.split(marked_text, START_MARK), read)).otherwise(
        F.array().cast(type_of_result)
    )


def spans(marked_text: Column, original: Column | None = None) -> Column:
    """All non-empty matches of a marked text as array<struct<value, start, end>>;
    offsets count characters from 0 and ``end`` is exclusive."""

    def read(pieces: Column) -> Column:
        # pieces[0] precedes the first match; every other piece is
        # <match><end mark><text up to the next match>, one mark too long.
        found = F.slice(pieces, F.lit(2), F.size(pieces) - 1)
        lengths = F.transform(pieces, lambda p, i: F.length(p) - F.when(i == 0, 0).otherwise(1))
        before = running(lengths, lambda total, x: total + x, F.lit(0))
        return F.filter(
            F.zip_with(
                F.transform(found, lambda p: F.substring_index(p, END_MARK, 1)),
                F.slice(before, F.lit(2), F.size(pieces) - 1),
                lambda v, at: F.struct(
                    (v if original is None else original.substr(at + 1, F.length(v))).alias("value"),
                    at.alias("start"),
                    (at + F.length(v)).alias("end"),
                ),
            ),
            lambda m: m["value"] != "",
        )

    return _pieces(marked_text, read, "array<struct<value:string,start:int,end:int>>")


def joined_values(marked_text: Column) -> Column:
    """Matched values of one pattern, with directly adjacent matches joined.

    Matches of a single pattern never overlap, so dropping the marks between
    two touching matches joins them; no offsets are needed.
    """

    def read(pieces: Column) -> Column:
        return F.transform(
            F.slice(pieces, F.lit(2), F.size(pieces) - 1), lambda p: F.substring_index(p, END_MARK, 1)
        )

    # computed once: whether it is null and its pieces are two uses of it
    joined = F.replace(marked_text, F.lit(END_MARK + START_MARK), F.lit(""))
    return let(joined, lambda m: _pieces(m, read, "array<string>"))
