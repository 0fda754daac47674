"""Helpers shared by the operators: Arrow batches, intermediate tables, tie-free column names."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Rows of text per Arrow batch, so that a worker holds a bounded number of texts at a time.
TEXT_ROWS = 512
#: The folder that holds the package.
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before those that ``df`` has already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small_batches(spark: SparkSession, rows: int = TEXT_ROWS) -> None:
    """Lower the session's rows per Arrow batch where they are more than ``rows``, and let the Python workers
    of a local session import this package wherever it was started (a cluster gets it with the job)."""
    context = spark.sparkContext
    known = context.environment.get("PYTHONPATH", "").split(os.pathsep)
    if context.master.startswith("local") and ROOT not in known:
        context.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*known, ROOT]))
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def append_columns(
    df: DataFrame, inputs: Sequence[str], fields: Sequence[tuple[str, T.DataType]], function: Callable[..., Sequence[Sequence]]
) -> DataFrame:
    """``df`` and new columns: ``function`` gets the input columns of a batch as lists
    and returns one sequence per new column.  All other columns pass through as Arrow data."""
    small_batches(df.sparkSession)
    at = [df.columns.index(c) for c in inputs]
    kinds = [to_arrow_type(t) for _, t in fields]
    schema = T.StructType(df.schema.fields + [T.StructField(n, t) for n, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = function(*[b.column(i).to_pylist() for i in at])
            arrays = [pa.array(x, type=k) for x, k in zip(new, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=schema.names)

    return df.mapInArrow(run, schema)


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="textscan-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: computed once, and kept
    when executors are lost."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/textscan-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_rows(df: DataFrame) -> list[Column] | None:
    """Two longs that tell the rows of a Parquet table apart, the same whenever it is read; None for other tables."""
    ids = [F.xxhash64("_metadata.file_path"), F.col("_metadata.row_index")]
    try:
        df.select(*ids).schema  # noqa: B018
    except AnalysisException:
        return None
    return ids


def cut(df: DataFrame) -> DataFrame:
    """``df`` without its lineage, for loops."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def lower_ascii(column: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
