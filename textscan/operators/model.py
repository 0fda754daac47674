"""A classifier of short strings by their characters, as a Spark ML pipeline."""

from __future__ import annotations

import string

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import StringIndexer
from pyspark.ml.linalg import SparseVector, Vectors, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textscan.functions.dictionary import MOST_BYTES
from textscan.operators.joins import spread_join
from textscan.operators.ordered import kept, running

#: Rows whose n-grams one task counts, and bytes of the numbers beside a feature of a vocabulary.
ROWS_PER_TASK, _NUMBER_BYTES = 20_000, 28

_LETTERS = string.ascii_lowercase + string.ascii_uppercase
# --- Fixed values: the characters of each class -----------------------------------
_PUNCTUATION = "!@#$%^&*()_+=-{}[]|;:'\\\",.<>?/`~"
CLASSES = {
    r"\\d": "0123456789",
    r"\\D": _LETTERS + _PUNCTUATION,
    r"\\w": _LETTERS + "0123456789_",
    r"\\W": _PUNCTUATION,
    r"\\s": " \t\n",
    r"\\S": _LETTERS + "0123456789" + _PUNCTUATION,
    r"\\n": "\n",
    r"\\t": "\t",
    r"\\\\": "\\",
}
# ------------------------------------------------------------------------------


def character_samples(spark: SparkSession, per_class: int = 200, length: int = 15, seed: int = 42) -> DataFrame:
    """(text, label): random strings of 1 to ``length`` characters of a class,
    padded with blanks."""
    rows = spark.range(per_class * len(CLASSES)).withColumn("class", (F.col("id") % len(CLASSES)).cast("int"))
    names = F.array(*map(F.lit, CLASSES))
    alphabets = F.array(*map(F.lit, CLASSES.values()))
    rows = rows.select(
        F.element_at(names, F.col("class") + 1).alias("label"),
        F.element_at(alphabets, F.col("class") + 1).alias("alphabet"),
        (F.floor(F.rand(seed) * length) + 1).cast("int").alias("n"),
        F.array(*[F.rand(seed + 1 + i) for i in range(length)]).alias("draws"),
    )
    chosen = F.transform(
        F.slice("draws", F.lit(1), F.col("n")),
        lambda r: F.col("alphabet").substr((F.floor(r * F.length("alphabet")) + 1).cast("int"), F.lit(1)),
    )
    return rows.select(F.rpad(F.array_join(chosen, ""), length, " ").alias("text"), "label")


def character_counts(text: Column) -> Column:
    """Digits, letters, whitespace and other characters of a text."""
    letters, digits, spaces = r"\p{L}", r"\p{Nd}", r"[\t-\r\x1c-\x20\x85\p{Z}]"
    other = r"[^\p{L}\p{N}\t-\r\x1c-\x20\x85\p{Z}]"
    return F.array(*[F.regexp_count(text, F.lit(r)) for r in (digits, letters, spaces, other)])


def _positions(text: Column) -> Column:
    return F.transform(F.split(text, ""), lambda c, i: F.concat(c, F.lit("_pos_"), i.cast("string")))


def _grams(text: Column, longest: int) -> Column:
    """All character n-grams of the lower-case text, repeated as they occur."""
    low, n = F.lower(text), F.length(text)
    nothing = F.array().cast("array<string>")

    def of(k: int) -> Column:
        return F.when(n >= k, F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: low.substr(i, F.lit(k)))).otherwise(nothing)

    return F.concat(*[of(k) for k in range(1, longest + 1)])


def gram_table(df: DataFrame, text: str = "text", longest: int = 5) -> DataFrame:
    """(gram, occurrences, documents, idf) of all character n-grams of lower-case texts; idf is
    ln((1 + rows) / (1 + documents)) + 1, so that a gram of every row keeps weight 1."""
    grams = _grams(F.col(text), longest)

    def counted(values: Column, occurrences: int, documents: int) -> Column:
        return F.transform(values, lambda g: F.struct(g.alias("gram"), F.lit(occurrences).alias("o"), F.lit(documents).alias("d")))

    each = df.select(grams.alias("grams")).select(F.inline(F.concat(counted(F.col("grams"), 1, 0), counted(F.array_distinct("grams"), 0, 1))))
    sums = each.groupBy("gram").agg(F.sum("o").alias("occurrences"), F.sum("d").alias("documents"))
    rows = df.select(F.count(F.lit(1))).scalar()
    return sums.withColumn("idf", F.log((rows + 1) / (F.col("documents") + 1)) + 1)


def position_table(df: DataFrame, text: str = "text") -> DataFrame:
    """(feature, occurrences) of the characters marked by position."""
    positions = df.select(F.explode(_positions(F.col(text))).alias("feature"))
    return positions.groupBy("feature").agg(F.count(F.lit(1)).alias("occurrences"))


def vocabulary(df: DataFrame, text: str = "text", longest: int = 5) -> DataFrame:
    """(feature, kind, n, weight, index): every n-gram of the texts with the weight of ``gram_table``, then every character
    marked by position with weight 1, numbered from 0 on in their order; ``n`` is how many texts have it.

    The numbers come from running sums over ranges of features, so no vocabulary goes through the driver."""
    grams = gram_table(df, text, longest).select(F.col("gram").alias("feature"), F.lit(0).alias("kind"), F.col("documents").alias("n"), F.col("idf").alias("weight"))
    places = position_table(df, text).select("feature", F.lit(1).alias("kind"), F.col("occurrences").alias("n"), F.lit(1.0).alias("weight"))
    return kept(running(grams.unionByName(places), [], ["kind", "feature"], {"index": F.lit(1)}))


def vectors(df: DataFrame, text: str, known: DataFrame, longest: int = 5) -> DataFrame:
    """``df`` with ``indices`` and ``values``: the sparse vector of each text over a ``vocabulary``.  N-grams count times their
    weight, scaled to length 1 together; positions count 1; what the vocabulary doesn't have is left out.

    Rows are numbered, written and dealt out by number.  A vocabulary of at most ``MOST_BYTES`` is broadcast to them, so that no
    (row, feature) pair is shuffled; a larger one is met by the pairs, by frequent features in several tasks."""
    numbered = kept(df.withColumn("__row", F.monotonically_increasing_id()))
    tasks = max(4 * df.sparkSession.sparkContext.defaultParallelism, -(-numbered.count() // ROWS_PER_TASK))
    base = numbered.repartition(tasks, "__row")
    both = F.array(F.struct(F.lit(0).alias("kind"), _grams(F.col(text), longest).alias("found")), F.struct(F.lit(1).alias("kind"), _positions(F.col(text)).alias("found")))
    each = base.select("__row", F.inline(both)).select("__row", "kind", F.explode("found").alias("feature"))
    counted = each.groupBy("__row", "kind", "feature").agg(F.count(F.lit(1)).alias("times"))
    size = known.agg(F.sum(F.octet_length("feature") + _NUMBER_BYTES)).first()[0] or 0
    if size <= MOST_BYTES:
        met = counted.join(F.broadcast(known), ["kind", "feature"])
    else:
        met = spread_join(counted, known, ["kind", "feature"], "n", F.xxhash64("__row"))
    weighted = met.select("__row", "kind", F.col("index").cast("int").alias("index"), (F.col("times") * F.col("weight")).alias("value"))
    lengths = F.sqrt(F.sum(F.when(F.col("kind") == 0, F.col("value") * F.col("value"))))
    entries = F.array_sort(F.collect_list(F.struct("index", "kind", "value")))
    rows = weighted.groupBy("__row").agg(entries.alias("entries"), lengths.alias("length"))
    scaled = F.transform("entries", lambda e: F.when(e["kind"] == 0, e["value"] / F.col("length")).otherwise(e["value"]))
    out = base.join(rows, "__row", "left").withColumns({"indices": F.transform("entries", lambda e: e["index"]), "values": scaled})
    none = F.array()
    return out.select(
        *df.columns, F.coalesce("indices", none.cast("array<int>")).alias("indices"), F.coalesce("values", none.cast("array<double>")).alias("values")
    )


def features(df: DataFrame, text: str, known: DataFrame, size: int, longest: int = 5) -> DataFrame:
    """``df`` with ``features`` for Spark ML: the vector over ``size`` features and the character counts."""

    def vector(indices: list[int], values: list[float], counts: list[int]) -> SparseVector:
        return Vectors.sparse(size + len(counts), [*indices, *range(size, size + len(counts))], [*values, *map(float, counts)])

    build = F.udf(vector, VectorUDT(), useArrow=False)  # Spark has no native function for sparse vectors
    return vectors(df, text, known, longest).withColumn("features", build("indices", "values", character_counts(F.col(text)))).drop("indices", "values")


def forest(trees: int = 100, seed: int = 42, depth: int = 30) -> Pipeline:
    """A random forest over ``features``; ``depth`` is the most that Spark's trees can have."""
    return Pipeline(
        stages=[
            StringIndexer(inputCol="label", outputCol="label_index", stringOrderType="alphabetAsc", handleInvalid="keep"),
            RandomForestClassifier(
                labelCol="label_index", featuresCol="features", numTrees=trees, seed=seed, maxDepth=depth,
                subsamplingRate=1.0, predictionCol="predicted_index",
            ),
        ]
    )


def train_and_predict(df: DataFrame, trees: int = 100, seed: int = 42, depth: int = 30) -> DataFrame:
    """(label, prediction) of the held-out fifth of (text, label) rows.  The vocabulary and its weights are those of the
    other rows, whole."""
    train, test = (kept(part) for part in df.select("text", "label").randomSplit([0.8, 0.2], seed))
    known = vocabulary(train)
    size = known.count()
    # the forest reads its rows several times before it keeps them, so the vectors are built once
    model = forest(trees, seed, depth).fit(kept(features(train, "text", known, size)))
    labels = next(s.labels for s in model.stages if hasattr(s, "labels"))
    names = F.array(*map(F.lit, labels))
    return model.transform(features(test, "text", known, size)).select(
        "label", F.element_at(names, (F.col("predicted_index") + 1).cast("int")).alias("prediction")
    )


def classification_report(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, precision, recall, f1, support) per class.  Pairs are counted
    once; the rest works on one row per pair."""
    pairs = df.groupBy(F.col(label).alias("l"), F.col(prediction).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    sides = pairs.select(
        F.inline(
            F.array(
                F.struct(F.col("l").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                         F.when(F.col("l") == F.col("p"), F.col("n")).otherwise(0).alias("hits")),
                F.struct(F.col("p").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("long").alias("hits")),
            )
        )
    )
    sums = sides.groupBy("label").agg(F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits"))

    def share(part: str, whole: Column) -> Column:
        return F.when(whole > 0, F.col(part) / whole).otherwise(F.lit(0.0))

    return sums.select(
        "label",
        share("hits", F.col("predicted")).alias("precision"),
        share("hits", F.col("support")).alias("recall"),
        F.when(F.col("support") + F.col("predicted") > 0, 2 * F.col("hits") / (F.col("support") + F.col("predicted")))
        .otherwise(F.lit(0.0))
        .alias("f1"),
        "support",
    )
