"""Entity extraction on streams.

Extraction and validation are projections, so the batch operators run on a
stream as they are, in append mode.  Only counts per window and first-seen
values keep state, bounded by a watermark.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from textscan.operators.extract import extract


def read_text_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Lines of text files as they arrive: (text)."""
    return (
        spark.readStream.format("text").option("maxFilesPerTrigger", max_files).load(path)
        .select(F.col("value").alias("text"))
    )


def read_parquet_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def stream_entities(
    stream: DataFrame, text: str, keep: str | Sequence[str], labels: str | Sequence[str] | None = None
) -> DataFrame:
    """(keep…, label, value) for each arriving text; no state."""
    return extract(stream, text, keep, labels)


def entity_counts(
    stream: DataFrame,
    text: str,
    time: str,
    labels: str | Sequence[str] | None = None,
    window: str = "10 minutes",
    slide: str | None = None,
    delay: str = "10 minutes",
) -> DataFrame:
    """How many values of each label fall into each time window.  Rows later than
    ``delay`` behind the newest are left out.  Counts are added up before the
    shuffle, so a frequent label costs one row per task and window."""
    watermarked = stream.withWatermark(time, delay)
    found = extract(watermarked, text, time, labels)
    span = F.window(F.col(time), window, slide) if slide else F.window(F.col(time), window)
    return (
        found.groupBy(span.alias("window"), "label")
        .agg(F.count(F.lit(1)).alias("values"))
        .select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "label", "values")
    )


def first_seen(
    stream: DataFrame, text: str, time: str, labels: str | Sequence[str] | None = None, delay: str = "1 hour"
) -> DataFrame:
    """(time, label, value) when a value is first seen within ``delay``."""
    found = extract(stream.withWatermark(time, delay), text, time, labels)
    return found.dropDuplicatesWithinWatermark(["label", "value"])


def checkpoint_location(spark: SparkSession, name: str, fallback: str | None = None) -> str:
    """A place for a query's progress below the shared folder that the cluster
    names in ``spark.checkpoint.dir``; ``fallback`` is for sessions without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or fallback
    if not root:
        raise ValueError("Set spark.checkpoint.dir, or give a checkpoint folder")
    return f"{root.rstrip('/')}/{name}"


def write_stream(
    stream: DataFrame, name: str, path: str, file_format: str = "parquet", fallback_checkpoints: str | None = None
) -> StreamingQuery:
    """Process what has arrived, exactly once, into files; restart-safe."""
    return (
        stream.writeStream.format(file_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint_location(stream.sparkSession, name, fallback_checkpoints))
        .trigger(availableNow=True)
        .start(path)
    )
