"""Corpus analytics: frequencies, n-grams, statistics, lemmas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textscan.functions import text as X
from textscan.functions.dictionary import MOST_BYTES, dictionary
from textscan.functions.regexes import to_jvm
from textscan.operators.ordered import kept, running


def _columns(keep: str | Sequence[str]) -> list[str]:
    return [keep] if isinstance(keep, str) else list(keep)


def word_frequency(df: DataFrame, text: str, by: str | Sequence[str] = ()) -> DataFrame:
    """Lower-case word counts, over the corpus or per group.  Counting is done
    before the shuffle as well, so a frequent word costs one row per task."""
    by = _columns(by)
    words = df.select(*by, F.explode(F.transform(X.tokenize_words(F.col(text)), F.lower)).alias("word"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"))


def _counted(df: DataFrame, text: str, by: list[str], order: str) -> DataFrame:
    """(by…, word, count, first) where ``first`` orders words by occurrence: the
    ``order`` of the row, then the place in the text.

    An integer order and the place are packed into one decimal, a fixed-width
    value that hash aggregation can keep; a struct would make Spark sort all
    words before counting them.
    """
    words = df.select(
        *by, F.col(order), F.posexplode(F.transform(X.tokenize_words(F.col(text)), F.lower)).alias("pos", "word")
    )
    if isinstance(df.schema[order].dataType, T.IntegralType):
        width = F.lit(2**31).cast("decimal(10,0)")
        place = F.col(order).cast("decimal(19,0)") * width + F.col("pos").cast("decimal(10,0)")
    else:
        place = F.struct(F.col(order), F.col("pos"))
    return words.groupBy(*by, "word").agg(F.count(F.lit(1)).alias("count"), F.min(place).alias("first"))


def top_words(df: DataFrame, text: str, order: str, n: int) -> DataFrame:
    """The n most frequent words; of equals, the one that occurs first (by the
    ``order`` column of its row, then by its place in the text)."""
    counts = _counted(df, text, [], order)
    return counts.orderBy(F.desc("count"), "first").limit(n).select("word", "count")


def top_words_by(df: DataFrame, text: str, by: str, order: str, n: int) -> DataFrame:
    """The n most frequent words of each group, ranked with the same ties.  Spark
    cuts each task's share of a group to n rows before it gathers the group."""
    ranked = Window.partitionBy(by).orderBy(F.desc("count"), "first")
    counts = _counted(df, text, [by], order).withColumn("rank", F.row_number().over(ranked))
    return counts.filter(F.col("rank") <= n).select(by, "word", "count", "rank")


def ngram_frequency(df: DataFrame, text: str, n: int = 2) -> DataFrame:
    """Counts of n-grams of words, joined by a blank."""
    grams = F.transform(X.ngrams(X.tokenize_words(F.col(text)), n), lambda g: F.array_join(g, " "))
    return df.select(F.explode(grams).alias("ngram")).groupBy("ngram").agg(F.count(F.lit(1)).alias("count"))


def top_ngrams(df: DataFrame, text: str, n: int, k: int) -> DataFrame:
    """The k most frequent n-grams; equals in alphabetical order."""
    return ngram_frequency(df, text, n).orderBy(F.desc("count"), "ngram").limit(k)


def sequence_ngrams(
    df: DataFrame, group: str, order: str, text: str, n: int = 2, chunk: int = 4096
) -> DataFrame:
    """n-grams that run on from one text of a group to the next, as
    (group, ngram, count).

    A group may hold a large share of all rows, so it is never gathered: every text is told how many words of its group
    come before it, by running sums over ranges, and the stream of words is cut into chunks of ``chunk`` words.  Each
    chunk also gets the n-1 words that follow it, from however many texts they come.  Texts with the same order value
    follow each other in their own order; null texts have no words.
    """
    tokens = df.select(F.col(group).alias("group"), F.col(order).alias("order"), F.col(text).alias("text"), X.tokenize_words(F.col(text)).alias("tokens"))
    tokens = tokens.filter(F.size("tokens") > 0)
    at = running(tokens, ["group"], ["order", "text"], {"start": F.size("tokens")}).select("group", "start", "tokens")
    end = F.col("start") + F.size("tokens")
    first = F.greatest(F.floor((F.col("start") - (n - 1)) / chunk), F.lit(0).cast("long"))
    spread = at.withColumn("chunk", F.explode(F.sequence(first, F.floor((end - 1) / chunk))))
    low = F.greatest(F.col("start"), F.col("chunk") * chunk)
    high = F.least(end, (F.col("chunk") + 1) * chunk + (n - 1))
    part = F.slice("tokens", (low - F.col("start") + 1).cast("int"), (high - low).cast("int"))
    chunks = spread.select("group", "chunk", low.alias("low"), part.alias("words")).groupBy("group", "chunk")
    words = chunks.agg(F.array_sort(F.collect_list(F.struct("low", "words"))).alias("parts"))
    joined = words.select("group", F.flatten(F.transform("parts", lambda p: p["words"])).alias("tokens"))
    grams = F.transform(X.ngrams(F.col("tokens"), n), lambda g: F.array_join(g, " "))
    counted = joined.select("group", F.explode(grams).alias("ngram")).groupBy("group", "ngram").agg(F.count(F.lit(1)).alias("count"))
    return counted.select(F.col("group").alias(group), "ngram", "count")


def text_statistics(df: DataFrame, text: str, keep: str | Sequence[str]) -> DataFrame:
    """One statistics record per text."""
    return df.select(*_columns(keep), X.statistics(F.col(text)).alias("s")).select(*_columns(keep), "s.*")


def corpus_statistics(df: DataFrame, text: str, by: Sequence[str], grouping: str = "groupBy") -> DataFrame:
    """Statistics summed and averaged per group; ``grouping`` is groupBy, rollup
    or cube."""
    stats = df.select(*by, X.statistics(F.col(text)).alias("s")).select(*by, "s.*")
    grouped = {"groupBy": stats.groupBy, "rollup": stats.rollup, "cube": stats.cube}[grouping](*by)
    return grouped.agg(
        F.count(F.lit(1)).alias("documents"),
        F.sum("word_count").alias("word_count"),
        F.sum("sentence_count").alias("sentence_count"),
        F.max("unique_words").alias("max_unique_words"),
        F.avg("avg_word_length").alias("avg_word_length"),
        F.avg("avg_sentence_length").alias("avg_sentence_length"),
    )


def by_part_of_speech(lemmas: DataFrame, tags: DataFrame, default: str = "n") -> DataFrame:
    """(token, lemma) of a (token, pos, lemma) table, where ``tags`` (token, pos) says which part of speech a word is;
    words without a tag, or without a lemma for theirs, count as ``default``."""
    tagged = tags.groupBy("token").agg(F.min("pos").alias("tag"))
    ranked = lemmas.join(tagged, "token", "left").filter((F.col("pos") == F.col("tag")) | (F.col("pos") == default))
    best = F.min(F.struct((F.col("pos") != F.coalesce("tag", F.lit(default))).alias("other"), "lemma"))
    return ranked.groupBy("token").agg(best["lemma"].alias("lemma"))


def _forms(lemmas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(form, exact) and (lower, any_case): one lemma for each form, and for each form in lower case."""
    known = lemmas.filter("token is not null and lemma is not null")
    exact = known.groupBy(F.col("token").alias("form")).agg(F.min("lemma").alias("exact"))
    rank = F.struct((F.col("token") != F.lower("token")).alias("other"), "token", "lemma")
    return exact, known.groupBy(F.lower("token").alias("lower")).agg(F.min(rank)["lemma"].alias("any_case"))


def _bytes(df: DataFrame) -> int:
    return df.agg(F.sum(sum(F.octet_length(c) for c in df.columns))).first()[0] or 0


def lemmatize(df: DataFrame, text: str, key: str, lemmas: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(key, text) with every token replaced by its lemma in a (token, lemma)
    table, tokens joined by blanks.  Look-up is by exact form, then lower case; of
    several rows for one the form written alike counts, then the first in order.

    Keys may repeat or be null.  A table of at most ``most_bytes`` travels with the plan, and so does the part of a
    larger one that the texts use, if it is no larger: texts and tokens are then looked up where they are.  Only beyond
    that are the rows numbered and written, and meet the lemmas of their words by that number.
    """
    tokens = F.regexp_extract_all(F.col(text), F.lit(to_jvm(r"\w+|[^\w\s]")), F.lit(0))
    exact, lower = _forms(lemmas)
    if _bytes(exact) + _bytes(lower) > most_bytes:
        words = df.select(F.explode(tokens).alias("form")).groupBy("form").agg(F.lower("form").alias("lower"))
        exact = exact.join(words.select("form"), "form", "left_semi")
        lower = lower.join(words.select("lower").distinct(), "lower", "left_semi")
        if _bytes(exact) + _bytes(lower) > most_bytes:
            return _lemmatize_by_join(df, tokens, key, text, exact, lower)
    in_form = dictionary({r["form"]: r["exact"] for r in exact.collect()})
    in_lower = dictionary({r["lower"]: r["any_case"] for r in lower.collect()})
    words = F.transform(tokens, lambda t: F.coalesce(in_form(t), in_lower(F.lower(t)), t))
    return df.select(key, F.coalesce(F.array_join(words, " "), F.lit("")).alias(text))


def _lemmatize_by_join(df: DataFrame, tokens: Column, key: str, text: str, exact: DataFrame, lower: DataFrame) -> DataFrame:
    base = kept(df.select(F.col(key).alias("key"), tokens.alias("tokens"), F.monotonically_increasing_id().alias("row")))
    forms = base.select("row", F.explode(F.array_distinct("tokens")).alias("form")).withColumn("lower", F.lower("form"))
    found = forms.join(exact, "form", "left").join(lower, "lower", "left")
    found = found.select("row", "form", F.coalesce("exact", "any_case").alias("lemma")).filter("lemma is not null")
    table = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("form", "lemma"))).alias("found"))
    words = F.transform("tokens", lambda t: F.coalesce(F.try_element_at(F.col("found"), t), t))
    joined = base.join(table, "row", "left")
    return joined.select(F.col("key").alias(key), F.coalesce(F.array_join(words, " "), F.array_join("tokens", " "), F.lit("")).alias(text))


def prepare(df: DataFrame, text: str, key: str, lemmas: DataFrame, stopwords: Sequence[str] | None = None) -> DataFrame:
    """The full preparation of texts, lemmas last."""
    prepared = df.select(key, X.prepare_text(F.col(text), stopwords).alias(text))
    return lemmatize(prepared, text, key, lemmas)
