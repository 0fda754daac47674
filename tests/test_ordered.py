"""Running sums over sorted partitions against plain Python."""

import random

from pyspark.sql import functions as F

from textscan.operators.ordered import running


def expect(rows, how):
    out, before = [], {}
    for key, place, value in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        out.append((key, place, value, before.get(key, 0)))
        before[key] = before.get(key, 0) ^ value if how == "xor" else before.get(key, 0) + value
    return sorted(out, key=str)


def test_running_sums(spark):
    rng = random.Random(4)
    rows = [("hot", i, rng.randint(-9, 99)) for i in range(3000)] + [(rng.choice([None, "a", "b", str(i)]), i, i) for i in range(900)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "key string, place int, value long").repartition(7)
    with_small_batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for how in ("sum", "xor"):
            got = running(df, ["key"], ["place"], {"sum_before": F.col("value")}, how)
            assert got.columns == ["key", "place", "value", "sum_before"]
            assert sorted((tuple(r) for r in got.collect()), key=str) == expect(rows, how)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", with_small_batches)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_ties_one_group_and_no_rows(spark):
    df = spark.createDataFrame([(5,)] * 40, "value long").repartition(6)
    got = running(df, [], [F.lit(1)], {"n": F.lit(1), "total": F.col("value")})
    assert sorted(tuple(r) for r in got.collect()) == [(5, i, 5 * i) for i in range(40)]
    assert running(df.filter("value < 0"), ["value"], ["value"], {"n": F.lit(1)}).count() == 0
