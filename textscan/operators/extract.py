"""Labelled entity extraction: match, stitch, clean.

Everything up to the long result is a projection of one row; no shuffle is
needed to extract entities, whatever the number of labels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from itertools import groupby

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textscan.catalog import PATTERNS, Pattern, label_names, select_patterns, split_valid
from textscan.functions.pieces import MANY, in_pieces, marked_pieces
from textscan.functions.regexes import (
    joined_values,
    let,
    markable,
    marked,
    matches,
    running,
    sanitize,
    spans,
    to_jvm,
    with_triggers,
)

_TEXT, _CUT = "__text", "__cut"

#: Labels with a pattern of which a match can hold a full stop and white space behind it, so that its length has no bound and
#: a long text is searched for it as a whole.
UNBOUNDED = ("reporting_statement", "quoted_text", "action_context", "ipv6")


def _columns(keep: str | Sequence[str]) -> list[str]:
    return [keep] if isinstance(keep, str) else list(keep)


def _by_label(labels, patterns: Iterable[Pattern]) -> dict[str, tuple[Pattern, ...]]:
    valid, _ = split_valid(select_patterns(labels, patterns))
    ordered = sorted(valid, key=lambda p: (p.label, p.ordinal))
    return {label: tuple(ps) for label, ps in groupby(ordered, key=lambda p: p.label)}


# --- Column level -----------------------------------------------------------


def _with_marks(
    base: Column,
    chosen: Sequence[Pattern],
    cut: Column | None,
    body: Callable[[dict[Pattern, Column]], Column],
    values_only: Sequence[Pattern] = (),
) -> Column:
    """``body`` of the marked text of each pattern."""
    if cut is not None:
        return body(marked_pieces(base, cut, chosen, values_only))
    return with_triggers(base, chosen, lambda may: body({p: marked(base, p, t) for p, t in zip(chosen, may, strict=True)}))


def _marked_array(text: Column, patterns: Sequence[Pattern], sanitized: bool) -> Column:
    """array<struct<ordinal, marked>>: one regex pass per pattern.  What follows
    is written once, over this array, so that the plan stays small however many
    patterns there are."""
    base = markable(text, sanitized)
    return with_triggers(
        base,
        patterns,
        lambda may: F.array(
            *[F.struct(F.lit(p.ordinal).alias("ordinal"), marked(base, p, t).alias("marked")) for p, t in zip(patterns, may, strict=True)]
        ),
    )


def all_matches(marked_patterns: Column, original: Column | None = None) -> Column:
    """Matches of several patterns, sorted by start, then by catalog order:
    array<struct<start, ordinal, end, value>>."""
    return F.array_sort(
        F.flatten(
            F.transform(
                marked_patterns,
                lambda p: F.transform(
                    spans(p["marked"], original),
                    lambda m: F.struct(
                        m["start"].alias("start"),
                        p["ordinal"].alias("ordinal"),
                        m["end"].alias("end"),
                        m["value"].alias("value"),
                    ),
                ),
            )
        )
    )


def stitch(sorted_matches: Column, mode: str = "concat") -> Column:
    """Join touching and overlapping matches of one label into values.

    ``concat`` appends each whole match that begins at or before the end of the
    match just before it.  ``span`` joins a match that begins at or before the
    furthest end so far, and adds only what lies beyond it, so that each value
    is the text between its first start and its last end.
    """
    if mode not in ("concat", "span"):
        raise ValueError(f"Unknown stitch mode: {mode}")

    def values(m: Column, before: Column) -> Column:
        # before[i]: where the text covered so far ends, as seen from match i
        breaks = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (before[i] < m[i]["start"]))
        if mode == "concat":
            parts = F.transform(m, lambda x: x["value"])
        else:
            parts = F.transform(
                m,
                lambda x, i: x["value"].substr(
                    F.greatest(before[i] - x["start"], F.lit(0)) + 1, F.length(x["value"])
                ),
            )
        return let(
            breaks,
            lambda b: F.transform(
                b,
                lambda first, k: F.array_join(
                    F.slice(parts, first + 1, F.coalesce(F.get(b, k + 1), F.size(m)) - first), ""
                ),
            ),
        )

    def covered(m: Column) -> Column:
        ends = F.transform(m, lambda x: x["end"])
        if mode == "span":
            return running(ends, lambda a, b: F.greatest(a, b), F.lit(-1))
        return F.concat(F.array(F.lit(-1)), ends)

    return let(
        sorted_matches,
        lambda m: F.when(F.size(m) > 0, let(covered(m), lambda before: values(m, before))).otherwise(
            F.array().cast("array<string>")
        ),
    )


def clean_values(values: Column, label: Column) -> Column:
    """Strip, undo doubled backslashes of Windows paths, drop trailing full
    stops; distinct and sorted."""

    def clean(v: Column) -> Column:
        stripped = F.regexp_replace(v, to_jvm(r"^\s+|\s+\Z"), "")
        path = F.when(label == "windows_path", F.replace(stripped, F.lit("\\\\"), F.lit("\\"))).otherwise(stripped)
        return F.rtrim(path, F.lit("."))

    return F.array_sort(F.array_distinct(F.transform(values, clean)))


def entities(
    text: Column,
    labels: str | Sequence[str] | None = None,
    mode: str = "concat",
    sanitized: bool = True,
    patterns: Iterable[Pattern] = PATTERNS,
    cut: Column | None = None,
) -> Column:
    """The labels found in a (sanitized) text with their final values, as
    array<struct<label, values>> ordered by label.  ``cut`` is the text ``in_pieces``, if it was cut up."""
    by_label = _by_label(labels, patterns)
    # A label with one pattern needs no offsets: its matches cannot overlap.
    single = {label: ps for label, ps in by_label.items() if len(ps) == 1 and sanitized}
    several = {label: ps for label, ps in by_label.items() if label not in single}

    def final(values: Column, label: Column) -> Column:
        return F.struct(label.alias("label"), clean_values(values, label).alias("values"))

    def found(marks: dict[Pattern, Column]) -> Column:
        parts = []
        if single:
            values = F.array(
                *[
                    F.struct(F.lit(label).alias("label"), joined_values(marks[ps[0]]).alias("values"))
                    for label, ps in single.items()
                ]
            )
            parts.append(F.transform(values, lambda x: final(x["values"], x["label"])))
        if several:
            texts = F.array(
                *[
                    F.struct(
                        F.lit(label).alias("label"),
                        F.array(
                            *[F.struct(F.lit(p.ordinal).alias("ordinal"), marks[p].alias("marked")) for p in ps]
                        ).alias("patterns"),
                    )
                    for label, ps in several.items()
                ]
            )
            original = None if sanitized else text
            parts.append(
                F.transform(texts, lambda x: final(stitch(all_matches(x["patterns"], original), mode), x["label"]))
            )
        return F.array_sort(F.filter(F.concat(*parts), lambda e: F.size(e["values"]) > 0))

    if not by_label:
        return F.array().cast("array<struct<label:string,values:array<string>>>")
    base = markable(text, sanitized)
    return _with_marks(base, [p for ps in by_label.values() for p in ps], cut, found, [ps[0] for ps in single.values()])


def has_entity(text: Column, labels: str | Sequence[str], patterns: Iterable[Pattern] = PATTERNS) -> Column:
    """Whether the text holds at least one match of the labels."""
    tests = [matches(text, p) for p in select_patterns(labels, patterns)]
    result = tests[0]
    for test in tests[1:]:
        result = result | test
    return result


def redact(text: Column, labels: str | Sequence[str], patterns: Iterable[Pattern] = PATTERNS) -> Column:
    """Replace what the labels match by the label in capitals and brackets.

    All matches are found in the original text, so a tag is never matched again.
    Overlapping matches are replaced as one, under the label of the first (of
    those with the same start, the first in the catalog)."""
    chosen, _ = split_valid(select_patterns(labels, patterns))
    if not chosen:
        return text
    tags = F.array(*[F.lit(f"[{p.label.upper()}]") for p in chosen])
    ordinals = F.array(*[F.lit(p.ordinal) for p in chosen])

    def stretches(m: Column, before: Column) -> Column:
        """array<struct<start, end, tag>> of matches that don't overlap."""
        ends = F.transform(m, lambda x: x["end"])
        firsts = F.filter(F.sequence(F.lit(0), F.size(m) - 1), lambda i: (i == 0) | (before[i] <= m[i]["start"]))
        return let(
            firsts,
            lambda b: F.transform(
                b,
                lambda i, k: F.struct(
                    m[i]["start"].alias("start"),
                    F.coalesce(F.get(before, F.get(b, k + 1)), F.array_max(ends)).alias("end"),
                    F.element_at(tags, F.array_position(ordinals, m[i]["ordinal"]).cast("int")).alias("tag"),
                ),
            ),
        )

    def replaced(s: Column) -> Column:
        def piece(x: Column, k: Column) -> Column:
            at = F.coalesce(F.get(s, k - 1)["end"], F.lit(0))
            return F.concat(text.substr(at + 1, x["start"] - at), x["tag"])

        rest = F.element_at(s, -1)["end"]
        return F.concat(F.array_join(F.transform(s, piece), ""), text.substr(rest + 1, F.length(text)))

    def of_matches(m: Column) -> Column:
        before = running(F.transform(m, lambda x: x["end"]), lambda a, b: F.greatest(a, b), F.lit(-1))
        return F.when(F.size(m) > 0, let(let(before, lambda b: stretches(m, b)), replaced)).otherwise(text)

    return let(all_matches(_marked_array(text, chosen, sanitized=False)), of_matches)


# --- DataFrame level --------------------------------------------------------


def _prepared(df: DataFrame, text: str, keep: list[str], sanitized: bool) -> DataFrame:
    source = sanitize(F.col(text)) if sanitized else F.col(text)
    return df.select(*keep, source.alias(_TEXT))


def _cut(prepared: DataFrame, chosen: Sequence[Pattern], sanitized: bool) -> tuple[DataFrame, Column | None]:
    """The prepared texts with their pieces, if the patterns are many."""
    if len(chosen) < MANY:
        return prepared, None
    return prepared.withColumn(_CUT, in_pieces(markable(F.col(_TEXT), sanitized), chosen)), F.col(_CUT)


def _entities(
    df: DataFrame, text: str, keep: list[str], labels, mode: str = "concat", sanitized: bool = True, patterns: Iterable[Pattern] = PATTERNS
) -> tuple[DataFrame, Column]:
    """The prepared texts, and their ``entities``."""
    patterns = tuple(patterns)
    chosen = [p for ps in _by_label(labels, patterns).values() for p in ps]
    prepared, cut = _cut(_prepared(df, text, keep, sanitized), chosen, sanitized)
    return prepared, entities(F.col(_TEXT), labels, mode, sanitized, patterns, cut)


def extract(
    df: DataFrame,
    text: str,
    keep: str | Sequence[str],
    labels: str | Sequence[str] | None = None,
    stitch: str = "concat",
    sanitized: bool = True,
    patterns: Iterable[Pattern] = PATTERNS,
    stretch: int | None = None,
) -> DataFrame:
    """Distinct values per input row and label, in long form: (keep…, label, value).  With ``stretch``, longer texts are searched
    in pieces by many tasks (see ``find_matches``); their matches, not the texts, are gathered by row and label."""
    keep = _columns(keep)
    if stretch is not None:
        return _extract_long(df, text, keep, labels, mode=stitch, sanitized=sanitized, patterns=patterns, stretch=stretch)
    prepared, found = _entities(df, text, keep, labels, stitch, sanitized, patterns)
    pairs = F.transform(
        found,
        lambda e: F.transform(e["values"], lambda v: F.struct(e["label"].alias("label"), v.alias("value"))),
    )
    return prepared.select(*keep, F.inline(F.flatten(pairs)))


def _extract_long(df: DataFrame, text: str, keep: list[str], labels, mode: str, sanitized: bool, patterns, stretch: int) -> DataFrame:
    size = F.length(F.col(text))
    short = extract(df.filter(size <= stretch), text, keep, labels, mode, sanitized, patterns)
    numbered = df.filter(size > stretch).withColumn("__row", F.monotonically_increasing_id())
    found = find_matches(numbered, text, [*keep, "__row"], labels, sanitized, patterns, stretch)
    by = [*keep, "__row", "label"]
    sorted_matches = F.array_sort(F.collect_list(F.struct("start", "ordinal", "end", "value")))
    values = found.groupBy(*by).agg(sorted_matches.alias("matches"))
    final = clean_values(stitch(F.col("matches"), mode), F.col("label"))
    return short.unionByName(values.select(*keep, "label", F.explode(final).alias("value")))


def extract_map(df: DataFrame, text: str, keep: str | Sequence[str], labels=None, **options) -> DataFrame:
    """One ``entities`` map per row, from the labels that matched to their values."""
    keep = _columns(keep)
    prepared, found = _entities(df, text, keep, labels, **options)
    return prepared.select(*keep, F.map_from_entries(found).alias("entities"))


def extract_wide(df: DataFrame, text: str, keep: str | Sequence[str], labels=None, **options) -> DataFrame:
    """One array column of values per label (empty where nothing matched)."""
    keep = _columns(keep)
    nothing = F.array().cast("array<string>")
    names = label_names(select_patterns(labels, options.get("patterns", PATTERNS)))
    mapped = extract_map(df, text, keep, labels, **options)
    return mapped.select(*keep, *[F.coalesce(F.try_element_at("entities", F.lit(c)), nothing).alias(c) for c in names])


def find_matches(
    df: DataFrame,
    text: str,
    keep: str | Sequence[str],
    labels: str | Sequence[str] | None = None,
    sanitized: bool = True,
    patterns: Iterable[Pattern] = PATTERNS,
    stretch: int | None = None,
) -> DataFrame:
    """Every match of every pattern before stitching, with its offsets:
    (keep…, label, ordinal, value, start, end).

    With ``stretch``, texts of more characters than that are searched in pieces by many tasks, with the same result, but for
    the labels in ``UNBOUNDED`` and patterns from elsewhere, which see the text as a whole."""
    keep = _columns(keep)
    valid, _ = split_valid(select_patterns(labels, patterns))
    prepared = _prepared(df, text, keep, sanitized)
    if stretch is None:
        return _matches_of(prepared, keep, valid, sanitized)
    return _in_stretches(prepared, keep, valid, sanitized, stretch)


def _matches_of(prepared: DataFrame, keep: list[str], valid: Sequence[Pattern], sanitized: bool, offset: Column | None = None) -> DataFrame:
    base = markable(F.col(_TEXT), sanitized)
    original = None if sanitized else F.col(_TEXT)
    at = F.lit(0) if offset is None else offset
    prepared, cut = _cut(prepared, valid, sanitized)
    texts = _with_marks(
        base,
        valid,
        cut,
        lambda marks: F.array(
            *[
                F.struct(F.lit(p.label).alias("label"), F.lit(p.ordinal).alias("ordinal"), marks[p].alias("marked"))
                for p in valid
            ]
        ),
    )
    rows = F.transform(
        texts,
        lambda x: F.transform(
            spans(x["marked"], original),
            lambda m: F.struct(
                x["label"].alias("label"),
                x["ordinal"].alias("ordinal"),
                m["value"].alias("value"),
                (m["start"] + at).alias("start"),
                (m["end"] + at).alias("end"),
            ),
        ),
    )
    return prepared.select(*keep, F.inline(F.flatten(rows)))


def _in_stretches(prepared: DataFrame, keep: list[str], valid: Sequence[Pattern], sanitized: bool, stretch: int) -> DataFrame:
    """As ``_matches_of``, with texts of more than ``stretch`` characters dealt out over the tasks in pieces.

    Pieces end behind a full stop with white space after it, the last one within ``stretch`` characters or else the next.  No match
    of the catalog's other patterns goes over such a place, and the characters on both sides look to it like the ends of a
    text, so the matches of the pieces are those of the text."""
    whole = [p for p in valid if p.label in UNBOUNDED or p.group == "custom"]
    cut = [p for p in valid if p not in whole]
    size = F.length(_TEXT)
    out = _matches_of(prepared.filter(size <= stretch), keep, valid, sanitized)
    giants = prepared.filter(size > stretch)
    if whole:
        out = out.unionByName(_matches_of(giants, keep, whole, sanitized))
    if cut:
        stop = to_jvm(r"(?:(?<=\.)(?=\s)|\Z)").removeprefix("(?d)")
        pieces = F.regexp_extract_all(_TEXT, F.lit(rf"(?s).{{1,{stretch}}}{stop}|.+?{stop}"), F.lit(0))
        starts = running(F.transform("__pieces", F.length), lambda total, n: total + n, F.lit(0))
        dealt = giants.select(*keep, pieces.alias("__pieces")).withColumn("__starts", starts)
        each = dealt.select(*keep, F.inline(F.arrays_zip("__pieces", "__starts")))
        rows = each.select(*keep, F.col("__pieces").alias(_TEXT), F.col("__starts").alias("__start")).repartition(F.col("__start"))
        out = out.unionByName(_matches_of(rows, keep, cut, sanitized, F.col("__start")))
    return out


def merge_spans(found: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Interval union of a match table: (keys…, label, value, start, end).

    ``keys`` must identify the text the offsets belong to.  Both windows and
    the final grouping use the same partitioning, so the matches (not the
    texts) are shuffled once.
    """
    by = [*_columns(keys), "label"]
    order = ["start", "ordinal", "end"]
    earlier = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    covered = F.coalesce(F.max("end").over(earlier), F.lit(-1))
    parts = (
        found.withColumn("covered", covered)
        .withColumn("island", F.sum((F.col("start") > F.col("covered")).cast("int")).over(so_far))
        .withColumn(
            "part",
            F.col("value").substr(
                F.greatest(F.col("covered") - F.col("start"), F.lit(0)) + 1, F.length(F.col("value"))
            ),
        )
    )
    return (
        parts.groupBy(*by, "island")
        .agg(
            F.array_sort(F.collect_list(F.struct(*order, "part"))).alias("parts"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .select(*by, F.array_join(F.transform("parts", lambda p: p["part"]), "").alias("value"), "start", "end")
    )


def entity_profile(
    df: DataFrame, text: str, by: str | Sequence[str] = (), labels=None, patterns: Iterable[Pattern] = PATTERNS
) -> DataFrame:
    """Per label (and ``by`` columns): how many texts hold it, and how many
    values they hold.  Counts are taken inside each row and added up, so no
    distinct count and no explode of values is needed."""
    by = _columns(by)
    prepared, found = _entities(df, text, by, labels, patterns=patterns)
    counts = F.transform(
        found,
        lambda e: F.struct(e["label"].alias("label"), F.size(e["values"]).alias("n")),
    )
    return (
        prepared.select(*by, F.inline(counts))
        .groupBy(*by, "label")
        .agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("values"))
    )


def email_domains(df: DataFrame, text: str, keep: str | Sequence[str]) -> DataFrame:
    """How many extracted e-mail values each domain has."""
    return (
        extract(df, text, keep, "email")
        .groupBy(F.lower(F.substring_index("value", "@", -1)).alias("domain"))
        .agg(F.count(F.lit(1)).alias("values"))
    )
