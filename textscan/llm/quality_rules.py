"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each text is measured once.  The rates (symbols, repeated lines, repeated words, word length) go into
sketches per language and source: counts per bin, where a bin keeps the five leading binary digits of a
value (a relative error of 1/16 at most).  Sketches merge by adding counts, so the result doesn't depend
on how rows are dealt; those of a language and of the whole table are merged from the same counts.

A fence lies three interquartile ranges outside the quartiles, as sketched; the range counts as ``SPREAD``
at least, so that texts of one kind don't condemn small deviations.  The fences of a group are drawn towards those of
its language, and these towards those of the whole table, as if the wider group had ``PARENT_DOCS`` documents in it:
small groups go by the wider one, large ones by themselves, with no edge between.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.llm.batches import append_columns, fresh, written

LEAST_WORDS = 10
MOST_REPEATED = 20  # percent of the words
#: Weight of the wider group, in documents.
PARENT_DOCS = 50
#: Least interquartile range of each rate, in its own units.
SPREAD = {"symbol_rate": 10, "dup_line_rate": 10, "repeat_rate": 5, "word_length": 10}
SYMBOLS = "#*$%&|<>"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    """(words, code points in words, symbols, repeated lines, words in repeated windows, lines with a word)."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits at just the six white space bytes of the definition
    word_chars = len(text) - sum(map(text.count, " \t\n\v\f\r"))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[i:] for i in range(5)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts, reach = Counter(windows), 0
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + 5 - max(i, reach)
                reach = i + 5
    return len(words), word_chars, symbols, len(lines) - len(set(lines)), repeated, len(lines)


def with_measures(df: DataFrame, text: str, names: list[str]) -> DataFrame:
    def run(texts: list[str | None]) -> list[tuple]:
        return list(zip(*map(measure, texts), strict=True)) or [()] * len(MEASURES)

    return append_columns(df, [text], [(n, T.LongType()) for n in names], run)


def rates(m: dict[str, Column]) -> dict[str, Column]:
    """Whole numbers: per 100 words or lines, word length in tenths."""
    per = lambda a, b: F.floor(F.try_divide(a, b)).cast("long")
    return {
        "symbol_rate": per(m["n_symbols"] * 100, m["n_words"]),
        "dup_line_rate": per(m["n_dup_lines"] * 100, m["n_lines"]),
        "repeat_rate": per(m["n_repeat_words"] * 100, m["n_words"]),
        "word_length": per(m["word_chars"] * 10, m["n_words"]),
    }


def failed(m: dict[str, Column]) -> Column:
    return (m["n_words"] < LEAST_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MOST_REPEATED)


def bin_of(x: Column) -> Column:
    """The value with only its five leading binary digits."""
    drop = F.greatest(F.length(F.bin(x)) - 5, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", x, drop), drop)


def sketches(measured: DataFrame, keys: list[str], m: dict[str, Column]) -> DataFrame:
    """(*keys, rate, bin, n) over the rows that pass the base rules."""
    pairs = F.array(*[F.struct(F.lit(k).alias("rate"), bin_of(v).alias("bin")) for k, v in rates(m).items()])
    return (
        measured.filter(~failed(m))
        .select(*keys, F.explode(pairs).alias("p"))
        .groupBy(*keys, F.col("p.rate").alias("rate"), F.col("p.bin").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """(*keys, docs, <rate>_low, <rate>_high) from the merged sketches of each group."""
    group = Window.partitionBy(*keys, "rate")
    merged = sketch.groupBy(*keys, "rate", "bin").agg(F.sum("n").alias("n"))
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("bin"))).withColumn("total", F.sum("n").over(group))
    quartiles = ranked.groupBy(*keys, "rate").agg(
        F.max("total").alias("docs"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("bin"))).alias("q1"),
        F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("bin"))).alias("q3"),
    )
    least = F.coalesce(*[F.when(F.col("rate") == k, F.lit(v)) for k, v in SPREAD.items()])
    reach = F.greatest(F.col("q3") - F.col("q1"), least) * 3
    fenced = quartiles.withColumns({"low": F.col("q1") - reach, "high": F.col("q3") + reach})
    out = [F.max(F.when(F.col("rate") == k, F.col(e))).alias(f"{k}_{e}") for k in SPREAD for e in ("low", "high")]
    return fenced.groupBy(*keys).agg(F.max("docs").alias("docs"), *out)


def thresholds(sketch: DataFrame, lang: str, source: str) -> DataFrame:
    """(lang, source, fences) with the fences of the group, its language and the whole table in one.

    Sketches and fences are written: Spark then knows their sizes, and joins few groups without moving the
    texts; many are joined by hash."""
    sketch = written(sketch)
    names = [f"{k}_{e}" for k in SPREAD for e in ("low", "high")]
    own = fences(sketch, [lang, source])
    by_lang = fences(sketch, [lang]).select(F.col(lang).alias("l_lang"), F.col("docs").alias("l_docs"), *[F.col(n).alias(f"l_{n}") for n in names])
    overall = fences(sketch.withColumn("all", F.lit(1)), ["all"]).first()  # one row, or none of an empty sketch
    every = overall.asDict() if overall else dict.fromkeys(names)
    joined = own.join(by_lang, F.col(lang).eqNullSafe(F.col("l_lang")), "left")

    def drawn(own: Column, docs: str, wider: Column) -> Column:
        return F.floor((F.col(docs) * own + PARENT_DOCS * wider) / (F.col(docs) + PARENT_DOCS))

    def pick(n: str) -> Column:
        return drawn(F.col(n), "docs", drawn(F.col(f"l_{n}"), "l_docs", F.lit(every[n])))

    return written(joined.select(F.col(lang).alias("t_lang"), F.col(source).alias("t_source"), *[pick(n).cast("long").alias(f"t_{n}") for n in names]))


def judged(df: DataFrame, text: str, lang: str, source: str, prefix: str = "", carry_text: bool = True) -> tuple[DataFrame, list[str]]:
    """``df`` with the measures, ``base_failed`` and ``kept``; also gives the new names.
    Without ``carry_text`` the text is measured only, and left out of the result.

    Null texts have no words and fail the base rules.  A null language or source is a group like any
    other.  Repeated rows count and are judged each; whole texts are measured, however long; an empty table gives an empty
    result.  New columns get underscores in front if ``df`` has their names already.
    """
    names = fresh(df, *[prefix + n for n in MEASURES])
    measured = with_measures(df, text, names)
    measured = written(measured if carry_text else measured.drop(text))
    m = {k: F.col(n) for k, n in zip(MEASURES, names, strict=True)}
    keys = measured.select(F.col(lang).alias("g_lang"), F.col(source).alias("g_source"), *[F.col(n).alias(k) for k, n in zip(MEASURES, names, strict=True)])
    limits = thresholds(sketches(keys, ["g_lang", "g_source"], {k: F.col(k) for k in MEASURES}), "g_lang", "g_source")
    within = F.lit(True)
    for k, v in rates(m).items():
        within &= v.between(F.col(f"t_{k}_low"), F.col(f"t_{k}_high"))
    base, kept = fresh(measured, prefix + "base_failed", prefix + "kept")
    joined = measured.join(limits, measured[lang].eqNullSafe(F.col("t_lang")) & measured[source].eqNullSafe(F.col("t_source")), "left")
    fails = F.coalesce(failed(m), F.lit(True))
    return joined.select(*measured.columns, fails.alias(base), (~fails & F.coalesce(within, F.lit(False))).alias(kept)), [*names, base, kept]


def quality_filter(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """The rows of ``df`` that pass, with its columns; see ``judged`` for nulls and the like."""
    out, names = judged(df, text, lang, source, prefix="q_")
    return out.filter(F.col(names[-1])).select(*df.columns)


#: DuckDB SQL for the query.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS text FROM documents),
tokens AS (SELECT r, doc_id, lang, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM docs),
placed AS (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM tokens),
windows AS (
  SELECT r, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o AS g
  FROM placed WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY g IS NOT NULL),
doubled AS (SELECT r, g FROM windows GROUP BY r, g HAVING count(*) > 1),
repeated AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM windows JOIN doubled USING (r, g)) GROUP BY r),
lines AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs),
dup AS (
  SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
measured AS (
  SELECT t.r, doc_id, lang, source, len(w) AS n_words,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(repeated.n, 0) AS n_repeat_words, coalesce(n_lines, 0) AS n_lines
  FROM tokens t LEFT JOIN repeated USING (r) LEFT JOIN dup USING (r)),
based AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_symbols * 100 // nullif(n_words, 0) AS symbol_rate, n_dup_lines * 100 // nullif(n_lines, 0) AS dup_line_rate,
    n_repeat_words * 100 // nullif(n_words, 0) AS repeat_rate, word_chars * 10 // nullif(n_words, 0) AS word_length
  FROM measured),
rated AS (
  UNPIVOT (SELECT r, lang, source, symbol_rate, dup_line_rate, repeat_rate, word_length FROM based WHERE NOT base_failed)
  ON symbol_rate, dup_line_rate, repeat_rate, word_length INTO NAME rate VALUE x),
binned AS (SELECT *, (x >> greatest(length(bin(x)) - 5, 0)) << greatest(length(bin(x)) - 5, 0) AS bin FROM rated),
grouped AS (
  SELECT 0 AS level, lang, source, rate, bin FROM binned
  UNION ALL SELECT 1, lang, NULL, rate, bin FROM binned
  UNION ALL SELECT 2, NULL, NULL, rate, bin FROM binned),
fences AS (
  SELECT level, lang, source, rate, count(*) AS docs, quantile_disc(bin, 0.25) AS q1, quantile_disc(bin, 0.75) AS q3,
    3 * greatest(quantile_disc(bin, 0.75) - quantile_disc(bin, 0.25), CASE rate WHEN 'repeat_rate' THEN 5 ELSE 10 END) AS reach
  FROM grouped GROUP BY level, lang, source, rate),
by_lang AS (
  SELECT l.lang, rate, floor((l.docs * (l.q1 - l.reach) + 50 * (a.q1 - a.reach))::DOUBLE / (l.docs + 50)) AS low,
    floor((l.docs * (l.q3 + l.reach) + 50 * (a.q3 + a.reach))::DOUBLE / (l.docs + 50)) AS high
  FROM fences l JOIN fences a USING (rate) WHERE l.level = 1 AND a.level = 2),
limits AS (
  SELECT g.lang, g.source, g.rate, floor((g.docs * (g.q1 - g.reach) + 50 * l.low)::DOUBLE / (g.docs + 50)) AS low,
    floor((g.docs * (g.q3 + g.reach) + 50 * l.high)::DOUBLE / (g.docs + 50)) AS high
  FROM fences g JOIN by_lang l ON l.rate = g.rate AND l.lang IS NOT DISTINCT FROM g.lang WHERE g.level = 0),
outside AS (
  SELECT DISTINCT b.r FROM binned b
  JOIN limits g ON g.rate = b.rate AND g.lang IS NOT DISTINCT FROM b.lang AND g.source IS NOT DISTINCT FROM b.source
  WHERE NOT b.x BETWEEN g.low AND g.high)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept
FROM based
"""
