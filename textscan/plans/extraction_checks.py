"""Checked queries: catalog, extraction and entity queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from textscan import catalog
from textscan.catalog import PATTERNS
from textscan.functions.regexes import sanitize
from textscan.operators import extract as E
from textscan.operators import query as Q
from textscan.plans.inputs import SEARCHED_SQL, searched_documents

MARKS = "chr(1) || '\\0' || chr(2)"
LETTERS = "[\\x{C0}-\\x{24F}]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def sanitize_sql(column: str) -> str:
    bad = r"[\p{C}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
    return f"regexp_replace(regexp_replace({column}, {quoted(bad)}, '', 'g'), ' +', ' ', 'g')"


def _re2(pattern: catalog.Pattern) -> tuple[str, str, str]:
    """(text column, pattern, condition on a match) for DuckDB.

    Its word classes are ASCII, so letters beyond ASCII are masked as "_" for
    all but the patterns without word classes.  Look-aheads are turned into
    conditions on the match.
    """
    regex, keep = pattern.regex.replace("{4}+", "{4}"), "true"
    if "(?=" in regex:
        regex = r"\b[A-Za-z0-9]{6,20}\b"
        keep = "regexp_matches(m, '[A-Za-z]') AND regexp_matches(m, '[0-9]')"
    return ("t" if pattern.label in ("unix_path", "url") else "u"), regex, keep


def matches_sql(patterns, source: str = SEARCHED_SQL, key: str = "doc_id") -> str:
    """Common table expressions ending in ``h``: every match with its offsets."""
    arms = " UNION ALL ".join(
        f"SELECT {key}, t, {p.ordinal} AS ordinal, {quoted(p.label)} AS label, "
        f"string_split(regexp_replace({text}, {quoted(regex)}, {MARKS}, 'g'), chr(1)) AS ps FROM u"
        for p in patterns
        for text, regex, _ in [_re2(p)]
    )
    kept = " AND ".join(
        [f"(ordinal <> {p.ordinal} OR ({keep}))" for p in patterns for _, _, keep in [_re2(p)] if keep != "true"]
        or ["true"]
    )
    return f"""
WITH s AS (SELECT {key}, {sanitize_sql('text')} AS t FROM {source}),
u AS (SELECT {key}, t, regexp_replace(t, {quoted(LETTERS)}, '_', 'g') AS u FROM s),
r AS ({arms}),
e AS (SELECT {key}, t, ordinal, label, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i FROM r WHERE len(ps) > 1),
f AS (SELECT *, sum(length(piece) - CASE WHEN i = 1 THEN 0 ELSE 1 END)
      OVER (PARTITION BY {key}, ordinal ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS st FROM e),
g AS (SELECT {key}, t, ordinal, label, CAST(st AS INTEGER) AS st, split_part(piece, chr(2), 1) AS m FROM f WHERE i > 1),
h AS (SELECT {key}, label, ordinal, st, CAST(st + length(m) AS INTEGER) AS en, substr(t, st + 1, length(m)) AS v
      FROM g WHERE m <> '' AND {kept})"""


def values_sql(patterns, source: str = SEARCHED_SQL, key: str = "doc_id") -> str:
    """Continues ``matches_sql`` to ``x(key, label, value)``: stitched by whole
    matches, stripped and cleaned."""
    return matches_sql(patterns, source, key) + f""",
k AS (SELECT *, CASE WHEN lag(en) OVER (PARTITION BY {key}, label ORDER BY st, ordinal) >= st THEN 0 ELSE 1 END AS nw FROM h),
n AS (SELECT *, sum(nw) OVER (PARTITION BY {key}, label ORDER BY st, ordinal) AS isl FROM k),
w AS (SELECT {key}, label, isl, trim(string_agg(v, '' ORDER BY st, ordinal)) AS v FROM n GROUP BY {key}, label, isl),
x AS (SELECT DISTINCT {key}, label, rtrim(CASE WHEN label = 'windows_path'
      THEN replace(v, chr(92) || chr(92), chr(92)) ELSE v END, '.') AS value FROM w)"""


def spans_sql(patterns) -> str:
    """Continues ``matches_sql`` to ``x``: union of overlapping and touching spans."""
    return matches_sql(patterns) + """,
k AS (SELECT *, max(en) OVER (PARTITION BY doc_id, label ORDER BY st, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cov FROM h),
n AS (SELECT *, sum(CASE WHEN cov >= st THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, label ORDER BY st, ordinal) AS isl FROM k),
y AS (SELECT doc_id, label, isl, min(st) AS st, max(en) AS en FROM n GROUP BY doc_id, label, isl),
x AS (SELECT doc_id, label, st AS "start", en AS "end", substr(t, st + 1, en - st) AS value FROM y JOIN s USING (doc_id))"""


def _patterns(*labels: str):
    return catalog.select_patterns(list(labels))


PII = ("email", "ipv4", "phone_number")
SEVERAL = ("datetime", "date", "time", "ipv6", "month")

# labels in the order of the catalog table
_ORDER = [
    "phone_number", "month", "week", "datetime", "date", "time", "ipv6", "ipv4", "mac", "unix_path", "windows_path",
    "email", "url", "ini", "hex_number", "env_var", "uuid", "protocol", "language", "file_format", "os", "web_tech",
    "cloud_devops", "database", "cybersecurity", "hardware", "networking", "ml_ai", "version_control", "mobile_dev",
    "blockchain", "game_dev", "analyze", "interrogative_context", "reporting_statement", "entity_name",
    "all_caps_phrase", "quoted_text", "action_context", "possessive_context", "proper_noun", "adjective_context",
    "question_context", "number_context", "threat_context",
]


def _strings(column: str) -> str:
    """A list as one string, so that both engines give the same type."""
    return f"array_to_string({column}, chr(9))"


def _joined(column):
    return F.array_join(column, "\t")


def _field_sql(text: str, field: str) -> str:
    """The match set of a query field: one alternation, on masked text, values
    cut from the original text by offset."""
    regex = "|".join(f"(?:{p.regex})" for p in Q.FIELDS[field])
    return (
        f"list_distinct(list_filter(list_transform(regexp_extract_all({text}, {quoted(regex)}), "
        "lambda m: trim(m, chr(32) || chr(9) || chr(10))), lambda m: m <> ''))"
    )


_IP_OK = r"^(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:/0*(?:3[0-2]|[12]?[0-9]))?$"


def checks() -> dict:
    out: dict = {}

    def add(name, run, sql=None):
        out[name] = (run, sql)

    def docs(spark, d):
        return searched_documents(spark, d)

    add(
        "CAT3_labels",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", ["email", "url", "uuid", "ipv4"])
        .select("label").distinct().orderBy("label"),
        values_sql(_patterns("email", "url", "uuid", "ipv4")) + " SELECT DISTINCT label FROM x",
    )
    add(
        "CAT4_label_filter",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", "email"),
        values_sql(_patterns("email")) + " SELECT doc_id, label, value FROM x",
    )
    for number, label in enumerate(_ORDER, start=1):
        add(
            f"X{number:02d}_{label}",
            lambda spark, d, label=label: E.extract(docs(spark, d), "text", "doc_id", label),
            values_sql(_patterns(label)) + " SELECT doc_id, label, value FROM x",
        )
    add(
        "EX01_sanitize",
        lambda spark, d: docs(spark, d).select("doc_id", sanitize(F.col("text")).alias("text")),
        f"SELECT doc_id, {sanitize_sql('text')} AS text FROM {SEARCHED_SQL}",
    )
    found_sql = ' SELECT doc_id, label, ordinal, v AS value, st AS "start", en AS "end" FROM h'
    add(
        "EX02_matches_with_offsets",
        lambda spark, d: E.find_matches(docs(spark, d), "text", "doc_id", list(PII)),
        matches_sql(_patterns(*PII)) + found_sql,
    )
    add(
        "EX03_long_matches",
        lambda spark, d: E.find_matches(docs(spark, d), "text", "doc_id", list(SEVERAL)),
        matches_sql(_patterns(*SEVERAL)) + found_sql,
    )
    add(
        "EX04_stitch_concat",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", list(SEVERAL)),
        values_sql(_patterns(*SEVERAL)) + " SELECT doc_id, label, value FROM x",
    )
    add(
        "EX05_stitch_span",
        lambda spark, d: E.merge_spans(E.find_matches(docs(spark, d), "text", "doc_id", list(SEVERAL)), "doc_id"),
        spans_sql(_patterns(*SEVERAL)) + ' SELECT doc_id, label, value, "start", "end" FROM x',
    )
    add(
        "EX05_stitch_span_in_row",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", list(SEVERAL), stitch="span"),
        spans_sql(_patterns(*SEVERAL)) + " SELECT DISTINCT doc_id, label, rtrim(trim(value), '.') AS value FROM x",
    )
    add(
        "EX06_distinct_values",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", ["month", "week"]).groupBy("label", "value")
        .agg(F.count(F.lit(1)).alias("documents")),
        values_sql(_patterns("month", "week")) + " SELECT label, value, count(*) AS documents FROM x GROUP BY 1, 2",
    )
    add(
        "EX07_clean_values",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id", ["windows_path", "url", "unix_path"]),
        values_sql(_patterns("windows_path", "url", "unix_path")) + " SELECT doc_id, label, value FROM x",
    )
    add(
        "EX08_extract_all_labels",
        lambda spark, d: E.extract(docs(spark, d), "text", "doc_id"),
        values_sql(PATTERNS) + " SELECT doc_id, label, value FROM x",
    )
    add(
        "EX09_entity_map",
        lambda spark, d: E.extract_map(docs(spark, d), "text", "doc_id", list(PII))
        .select("doc_id", F.array_join(F.array_sort(F.map_keys("entities")), ",").alias("labels"),
                F.size(F.flatten(F.map_values("entities"))).alias("n")),
        values_sql(_patterns(*PII)) + """ SELECT s.doc_id, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS labels,
            CAST(count(x.value) AS INTEGER) AS n FROM s LEFT JOIN x USING (doc_id) GROUP BY s.doc_id""",
    )
    add(
        "EX09_wide_columns",
        lambda spark, d: E.extract_wide(docs(spark, d), "text", "doc_id", list(PII)).select(
            "doc_id", *[_joined(F.col(c)).alias(c) for c in PII]
        ),
        values_sql(_patterns(*PII)) + " SELECT s.doc_id, " + ", ".join(
            f"coalesce(string_agg(value, chr(9) ORDER BY value) FILTER (label = '{c}'), '') AS {c}" for c in PII
        ) + " FROM s LEFT JOIN x USING (doc_id) GROUP BY s.doc_id",
    )
    add(
        "EX10_has_entity",
        lambda spark, d: docs(spark, d).filter(E.has_entity(F.col("text"), ["url", "unix_path"])).select("doc_id"),
        f"SELECT doc_id FROM {SEARCHED_SQL} WHERE " + " OR ".join(
            f"regexp_matches(text, {quoted(p.regex)})" for p in _patterns("url", "unix_path")
        ),
    )
    add(
        "EX11_entity_profile",
        lambda spark, d: E.entity_profile(docs(spark, d), "text", "source"),
        values_sql(PATTERNS) + """ SELECT source, label, count(DISTINCT doc_id) AS documents, count(*) AS "values"
            FROM x JOIN documents USING (doc_id) GROUP BY source, label""",
    )
    add(
        "EX12_email_domains",
        lambda spark, d: E.email_domains(docs(spark, d), "text", "doc_id"),
        values_sql(_patterns("email")) + """ SELECT lower(list_extract(string_split(value, '@'), -1)) AS domain, count(*) AS "values" FROM x GROUP BY 1""",
    )
    email = r"[\p{L}\p{N}_.-]+@([\p{L}\p{N}_-]+\.)+[\p{L}\p{N}_-]+"
    ipv4 = r"(^|[^\p{L}\p{N}_])(?:(\d{1,3}\.){3}\d{1,3}(\/\d{1,2}\b|\/|))"
    add(
        "EX13_redact",
        lambda spark, d: docs(spark, d).select("doc_id", E.redact(F.col("text"), ["email", "ini", "ipv4", "url"]).alias("text")),
        f"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\[[\\p{{L}}\\p{{N}}_]+\\]', '[INI]', 'g'), {quoted(ipv4)}, '\\1[IPV4]', 'g'),
            {quoted(email)}, '[EMAIL]', 'g'), {quoted(_patterns('url')[0].regex)}, '[URL]', 'g') AS text FROM {SEARCHED_SQL}""",
    )

    # --- entity queries -------------------------------------------------------
    unix, url, ipv4_set, misc = (_field_sql("text", f) for f in ("unix_path", "url", "ipv4", "misc"))

    def ip_only(values):
        return f"list_filter({values}, lambda v: regexp_matches(v, {quoted(_IP_OK)}))"

    def both(a, b):
        return f"list_distinct(list_concat({a}, {b}))"

    def lq(name, column, expression):
        add(
            name,
            lambda spark, d: docs(spark, d).select("doc_id", _joined(column()).alias("matches")),
            f"SELECT doc_id, {_strings(f'list_sort({expression})')} AS matches FROM {SEARCHED_SQL}",
        )

    lq("LQ01_match_set", lambda: F.array_sort(Q.match_set(F.col("text"), "unix_path")), unix)
    lq("LQ02_and", lambda: Q.combine(F.col("text"), "misc:x AND unix_path:x"), f"list_intersect({misc}, {unix})")
    lq("LQ03_or", lambda: Q.combine(F.col("text"), "url:x OR unix_path:x"), both(url, unix))
    lq("LQ04_not", lambda: Q.combine(F.col("text"), "misc:x NOT unix_path:x"), f"list_filter({misc}, lambda v: NOT list_contains({unix}, v))")
    lq(
        "LQ05_left_to_right",
        lambda: Q.combine(F.col("text"), "unix_path:x OR url:x NOT url:x OR url:y"),
        both(f"list_filter({both(unix, url)}, lambda v: NOT list_contains({url}, v))", url),
    )
    lq("LQ06_ipv4_filter", lambda: Q.combine(F.col("text"), "ipv4:x OR url:x"), ip_only(both(ipv4_set, url)))
    batch = ["url:x OR unix_path:x", "url:x", "nope:x", "plain"]
    errors = {"nope:x": "Unknown field: nope", "plain": "Invalid term format: plain"}
    add(
        "LQ07_batch",
        lambda spark, d: Q.run_queries(docs(spark, d), "text", "doc_id", batch).select(
            "doc_id", "query", _joined(F.col("matches")).alias("matches"), "error"
        ),
        " UNION ALL ".join(
            [
                f"SELECT doc_id, '{q}' AS query, {_strings(f'list_sort({e})')} AS matches, CAST(NULL AS VARCHAR) AS error FROM {SEARCHED_SQL}"
                for q, e in ((batch[0], both(url, unix)), (batch[1], url))
            ]
            + [
                f"SELECT doc_id, '{q}' AS query, CAST(NULL AS VARCHAR) AS matches, '{e}' AS error FROM {SEARCHED_SQL}"
                for q, e in errors.items()
            ]
        ),
    )
    # the term must come on the rest of the line: in these texts the passage is
    # the end of the last line, so "rest of line" is cut by hand in SQL
    path_regex = _patterns("unix_path")[0].regex
    pieces = f"string_split(regexp_replace(text, {quoted(path_regex)}, {MARKS}, 'g'), chr(1))"
    add(
        "LQ08_field_term",
        lambda spark, d: docs(spark, d).select(
            "doc_id", _joined(F.array_sort(Q.field_values(F.col("text"), "unix_path:conf*ini"))).alias("matches")
        ),
        f"""WITH e AS (SELECT doc_id, {pieces} AS ps FROM {SEARCHED_SQL}),
            f AS (SELECT doc_id, unnest(ps) AS piece, generate_subscripts(ps, 1) AS i,
                  unnest(list_transform(ps, lambda p, i: array_to_string(list_slice(ps, i, len(ps)), ''))) AS rest FROM e),
            g AS (SELECT DISTINCT doc_id, trim(split_part(piece, chr(2), 1), chr(32) || chr(9) || chr(10)) AS m FROM f
                  WHERE i > 1 AND regexp_matches(rest, '^[^\\n]*conf[^\\n]*ini'))
            SELECT d.doc_id, coalesce(string_agg(m, chr(9) ORDER BY m), '') AS matches FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""",
    )
    lq(
        "LQ09_value_condition",
        lambda: Q.matching_values("text", "url:(example AND 1 NOT 2)"),
        f"list_filter({url}, lambda v: v LIKE '%example%' AND v LIKE '%1%' AND NOT v LIKE '%2%')",
    )

    lq(
        "LQ09_nested_value_condition",
        lambda: Q.matching_values("text", "url:((example OR ssh) AND NOT (3 OR 7))"),
        f"list_filter({url}, lambda v: (v LIKE '%example%' OR v LIKE '%ssh%') AND NOT (v LIKE '%3%' OR v LIKE '%7%'))",
    )

    def rows(name, query, condition):
        add(
            name,
            lambda spark, d: docs(spark, d).filter(Q.text_filter("text", query)).select("doc_id"),
            f"SELECT doc_id FROM {SEARCHED_SQL} WHERE {condition}",
        )

    rows("LQ10_free_text", '"Alice Smith" OR h?use', "text LIKE '%Alice Smith%' OR regexp_matches(text, 'h.use')")
    rows("LQ11_range", "[7 TO 9] AND NOT Monday", "regexp_matches(text, '[7-9]') AND text NOT LIKE '%Monday%'")

    def exists(values, condition):
        return f"len(list_filter({values}, lambda v: {condition})) > 0"

    rows(
        "LQ12_grouping",
        "url:(example OR ssh) AND NOT unix_path:etc AND (Id OR write)",
        exists(url, "v LIKE '%example%' OR v LIKE '%ssh%'")
        + " AND NOT " + exists(unix, "v LIKE '%etc%'") + " AND (text LIKE '%Id%' OR text LIKE '%write%')",
    )
    rows(
        "LQ12_nested_grouping",
        "url:((example OR ssh) AND NOT (3 OR 7)) AND (Id OR write)",
        "(" + " OR ".join(exists(url, f"v LIKE '%{w}%'") for w in ("example", "ssh")) + ") AND NOT ("
        + " OR ".join(exists(url, f"v LIKE '%{w}%'") for w in ("3", "7")) + ")"
        " AND (text LIKE '%Id%' OR text LIKE '%write%')",
    )
    rows("LQ13_nearness", "the+20+lab", "regexp_matches(text, 'the.{0,20}lab')")
    return out
