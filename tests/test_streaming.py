import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from textscan.operators.extract import extract
from textscan.streaming import entities as ST


@pytest.fixture
def source(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i % 50:02d}:00", f"mail u{i % 4}@b.co from 10.0.0.{i % 3}") for i in range(100)]
    df = spark.createDataFrame(rows, "id int, at string, text string").withColumn("at", F.to_timestamp("at"))
    path = str(tmp_path / "in")
    df.repartition(4).write.parquet(path)
    return df, path


def fresh(name):
    # the session may name a shared checkpoint folder that outlives a test run
    return f"{name}-{uuid.uuid4()}"


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None


def test_stream_equals_batch(spark, source, tmp_path):
    df, path = source
    stream = ST.read_parquet_stream(spark, path, df.schema, max_files=1)
    out = str(tmp_path / "out")
    found = ST.stream_entities(stream, "text", "id", ["email", "ipv4"])
    name = fresh("entities")
    drain(ST.write_stream(found, name, out, fallback_checkpoints=str(tmp_path / "cp")))
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, extract(df, "text", "id", ["email", "ipv4"]).collect()))
    # a restart finds nothing new
    drain(ST.write_stream(found, name, out, fallback_checkpoints=str(tmp_path / "cp")))
    assert spark.read.parquet(out).count() == len(got)


def test_window_counts(spark, source, tmp_path):
    df, path = source
    stream = ST.read_parquet_stream(spark, path, df.schema)
    counts = ST.entity_counts(stream, "text", "at", "email", window="10 minutes", delay="1 hour")
    query = (
        counts.writeStream.format("memory").queryName("counts").outputMode("complete")
        .option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    )
    drain(query)
    rows = spark.sql("select label, sum(values) n, count(*) w from counts group by label").collect()
    assert [(r["label"], r["n"], r["w"]) for r in rows] == [("email", 100, 5)]


def test_first_seen(spark, source, tmp_path):
    df, path = source
    stream = ST.read_parquet_stream(spark, path, df.schema, max_files=2)
    out = str(tmp_path / "seen")
    drain(ST.write_stream(ST.first_seen(stream, "text", "at", ["email", "ipv4"], "2 hours"), fresh("seen"), out,
                          fallback_checkpoints=str(tmp_path / "cp3")))
    seen = [tuple(r) for r in spark.read.parquet(out).select("label", "value").collect()]
    assert len(seen) == len(set(seen)) == 7


def test_checkpoint_location():
    def session(value):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: value))

    assert ST.checkpoint_location(session("/shared/cp/"), "x", "/other") == "/shared/cp/x"
    assert ST.checkpoint_location(session(None), "x", "/other") == "/other/x"
    with pytest.raises(ValueError):
        ST.checkpoint_location(session(None), "x")


def test_text_lines_stream(spark, tmp_path):
    (tmp_path / "lines").mkdir()
    (tmp_path / "lines" / "a.txt").write_text("a@b.co\nnone\n")
    stream = ST.read_text_stream(spark, str(tmp_path / "lines"))
    out = str(tmp_path / "o")
    drain(ST.write_stream(ST.stream_entities(stream, "text", [], "email"), fresh("lines"), out, fallback_checkpoints=str(tmp_path / "c")))
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("email", "a@b.co")]
