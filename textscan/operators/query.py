"""Boolean queries on the entities of a text, in a small Lucene-like notation.

Queries become Column expressions: sets of matches are arrays combined by
array functions, and conditions are ordinary boolean Columns.  AND, OR, NOT and
parentheses of a condition are left to Spark's own SQL expression parser.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textscan.catalog import PATTERNS, Pattern
from textscan.functions.network import IPV4_OR_CIDR
from textscan.functions.regexes import jvm_regex, to_jvm

_FIRST = {p.label: p for p in reversed(PATTERNS)}
_DATETIMES = [p for p in PATTERNS if p.label == "datetime"]

#: Query fields: pattern groups, tried in this order at each place of a text.
FIELDS: dict[str, tuple[Pattern, ...]] = {
    "datetime": (_DATETIMES[0], _DATETIMES[1], _DATETIMES[2], _DATETIMES[4]),
    "misc": (_FIRST["unix_path"], _FIRST["windows_path"], _FIRST["email"], _FIRST["url"]),
    "ipv4": (_FIRST["ipv4"],),
    "email": (_FIRST["email"],),
    "url": (_FIRST["url"],),
    "unix_path": (_FIRST["unix_path"],),
}

_OPERATORS = {"AND": F.array_intersect, "OR": F.array_union, "NOT": F.array_except}


def field_regex(field: str) -> str:
    """One alternation over the patterns of a field."""
    if field not in FIELDS:
        raise ValueError(f"Unknown field: {field}")
    return "(?d)" + "|".join(f"(?:{jvm_regex(p).removeprefix('(?d)')})" for p in FIELDS[field])


def _trimmed(matches: Column) -> Column:
    stripped = F.transform(matches, lambda m: F.regexp_replace(m, to_jvm(r"^\s+|\s+\Z"), ""))
    return F.array_distinct(F.filter(stripped, lambda m: m != ""))


def match_set(text: Column, field: str) -> Column:
    """Distinct matches of a field in a text."""
    return _trimmed(F.regexp_extract_all(text, F.lit(field_regex(field)), F.lit(0)))


def ipv4_only(values: Column) -> Column:
    """Keep complete IPv4 addresses, with or without a prefix length."""
    return F.filter(values, lambda v: v.rlike(IPV4_OR_CIDR))


def combine(text: Column, query: str) -> Column:
    """The sorted set for ``field:… (AND|OR|NOT) field:… …``, evaluated from left
    to right without precedence.  A query that names ipv4 keeps IPv4 values only."""
    result, operator = None, None
    for term in re.split(r"\s+(AND|OR|NOT)\s+", query.strip()):
        term = term.strip()
        if term in _OPERATORS:
            operator = _OPERATORS[term]
            continue
        if ":" not in term:
            raise ValueError(f"Invalid term format: {term}")
        found = match_set(text, term.split(":", 1)[0])
        result = found if result is None else operator(result, found)
    return F.array_sort(ipv4_only(result) if "ipv4" in query else result)


def run_queries(df: DataFrame, text: str, keep: str | Sequence[str], queries: Sequence[str]) -> DataFrame:
    """Each query on each row: (keep…, query, matches, error).  A faulty query
    gives its message and null matches; the table is read once."""
    keep = [keep] if isinstance(keep, str) else list(keep)
    results = []
    for query in queries:
        try:
            matches, error = combine(F.col(text), query), F.lit(None).cast("string")
        except ValueError as problem:
            matches, error = F.lit(None).cast("array<string>"), F.lit(str(problem))
        results.append(F.struct(F.lit(query).alias("query"), matches.alias("matches"), error.alias("error")))
    return df.select(*keep, F.inline(F.array(*results)))


# --- Terms ------------------------------------------------------------------------


def term_regex(term: str) -> str:
    """A term as a regular expression: ``*`` any text, ``?`` one character, the
    rest literal."""
    return re.sub(r"([.+^$[\]{}=!<>|\\()-])", r"\\\1", term).replace("*", ".*").replace("?", ".")


def field_values(text: Column, query: str) -> Column:
    """Matches of ``field:term`` from which the term is still to come on the same
    line (the match itself included)."""
    parsed = re.match(r"(\w+):(.+)", query)
    if not parsed:
        raise ValueError(f"Invalid query: {query}")
    field, term = parsed.groups()
    regex = field_regex(field).removeprefix("(?d)")
    # the pattern is tried first, so that lines are searched for the term only
    # where an entity begins
    ahead = f"(?d)(?={regex})(?=.*{term_regex(term.strip('()'))})(?:{regex})"
    return _trimmed(F.regexp_extract_all(text, F.lit(ahead), F.lit(0)))


_TOKEN = re.compile(r'(?:(\w+):)?"([^"]*)"|\[(\w+)\sTO\s(\w+)\]|([()])|([^\s()]+)')
_JOINERS = ("AND", "OR", "NOT", "(")


def sql_string(value: str) -> str:
    """A SQL string literal without escapes inside."""
    parts = [f"r'{part}'" if part else "''" for part in value.split("'")]
    return "concat(" + ", \"'\", ".join(parts) + ")" if len(parts) > 1 else parts[0]


def name_sql(column: str) -> str:
    """A column name for SQL text: a path of plain names (``a.b``) by its parts, any other as one name."""
    parts = column.split(".") if re.fullmatch(r"\w+(\.\w+)*", column) else [column]
    return ".".join("`" + part.replace("`", "``") + "`" for part in parts)


def _matches_sql(column: str, field: str) -> str:
    found = f"regexp_extract_all({column}, {sql_string(field_regex(field))}, 0)"
    return f"array_distinct(filter(transform({found}, m -> trim(m)), m -> m <> ''))"


def _word_sql(word: str, subject: str) -> str:
    near = re.fullmatch(r"([^+]+)\+(\d+)\+([^+]+)", word)
    if near:
        regex = f"{term_regex(near[1])}.{{0,{near[2]}}}{term_regex(near[3])}"
    else:
        regex = term_regex(word)
    return f"{subject} RLIKE {sql_string('(?d)' + regex)}"


def _condition_sql(expression: str, subject: str) -> str:
    """The expression as SQL text, every term as a test of ``subject`` (a column
    or a lambda variable); two terms side by side must both hold."""
    out: list[str] = []
    for of_field, quoted, low, high, paren, word in _TOKEN.findall(expression):
        starts_operand = word not in _JOINERS[:2] and paren != ")"
        if starts_operand and out and out[-1] not in _JOINERS:
            out.append("AND")
        field = re.fullmatch(r"(\w+):(.+)", word)
        if paren or word in _JOINERS:
            out.append(paren or word)
        elif quoted:
            phrase = sql_string(term_regex(quoted))
            if of_field in FIELDS:
                out.append(f"exists({_matches_sql(subject, of_field)}, v -> v RLIKE {phrase})")
            else:
                out.append(f"{subject} RLIKE {phrase}")
        elif low:
            out.append(f"{subject} RLIKE '[{low}-{high}]'")
        elif field and field[1] in FIELDS:
            out.append(f"exists({_matches_sql(subject, field[1])}, v -> {_word_sql(field[2], 'v')})")
        else:
            out.append(_word_sql(field[2] if field else word, subject))
    return " ".join(out)


def matching_values(column: str, query: str) -> Column:
    """Values of one field that satisfy a condition on the value itself:
    ``field:a``, ``field:(a AND b NOT c)`` or ``field:a AND NOT field:b``."""
    field = query.split(":", 1)[0]
    condition = _condition_sql(re.sub(rf"\b{field}:", "", query), "v")
    return F.expr(f"array_sort(filter({_matches_sql(name_sql(column), field)}, v -> {condition}))")


def _closing(query: str, begin: int) -> int:
    """Where the parenthesis that opens at ``begin`` closes; quoted ones don't count."""
    depth = 0
    for m in re.compile(r'"[^"]*"|[()]').finditer(query, begin):
        depth += {"(": 1, ")": -1}.get(m.group(), 0)
        if depth == 0:
            return m.start()
    raise ValueError(f"Unclosed parenthesis: {query}")


def _repeat_fields(query: str, field: str = "") -> str:
    """The query with the field of each group written before every term in it, at any depth."""
    out, at = [], 0
    term = re.compile(r'(\w+):\(|"[^"]*"|[()]|[^\s()]+|\s+')
    while at < len(query):
        m = term.match(query, at)
        if m.group(1):
            end = _closing(query, m.end() - 1)
            out.append("(" + _repeat_fields(query[m.end() : end], m.group(1)) + ")")
            at = end + 1
            continue
        word = m.group()
        plain = field and not word.isspace() and word not in ("(", ")", "AND", "OR", "NOT") and not re.match(r"\w+:.", word)
        out.append(f"{field}:{word}" if plain else word)
        at = m.end()
    return "".join(out)


def text_filter(column: str, query: str) -> Column:
    """A row condition: free terms, "quoted phrases", wildcards, ranges
    ``[A TO B]`` (one character from A to B), nearness ``a+N+b``, and
    ``field:term`` (an entity of that field that holds the term), combined by
    AND, OR, NOT and parentheses.  ``field:((a OR b) AND NOT c)`` repeats the field for
    every term inside that has none of its own."""
    return F.expr(_condition_sql(_repeat_fields(query), name_sql(column)))
