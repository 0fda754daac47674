"""Folder listings by tasks: a frontier of folders is expanded level by level, so no name passes through the driver."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textscan.operators.ordered import kept

_ENTRIES = "parent string, path string, is_folder boolean, length long, modified double"


def _lister() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def entries_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The entries of folders; hidden ones (``.`` and ``_``) are left out, as in a scan."""
        from pyarrow import fs as arrow_fs

        for batch in batches:
            rows = []
            for folder in batch["path"]:
                system, inner = arrow_fs.FileSystem.from_uri(folder)
                prefix = folder.rstrip("/").removesuffix(inner.rstrip("/"))
                try:
                    entries = system.get_file_info(arrow_fs.FileSelector(inner, recursive=False))
                except FileNotFoundError:  # gone since its parent was listed
                    continue
                for e in entries:
                    if not e.base_name.startswith((".", "_")):
                        is_folder = e.type == arrow_fs.FileType.Directory
                        rows.append((folder, prefix + e.path, is_folder, None if is_folder else e.size, e.mtime_ns / 1e9 if e.mtime_ns else None))
            yield pd.DataFrame(rows, columns=["parent", "path", "is_folder", "length", "modified"])

    return entries_of


def list_tree(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, is_folder, length, modificationTime, empty) of all files and folders below ``root``.

    Each round lists the folders that the last one found, dealt out over the tasks; only their number comes back.  An
    empty file has no bytes; an empty folder has no entries but hidden ones.  ``root`` is a path or a URI of any file
    system that Arrow reads."""
    root = root.rstrip("/") if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))
    levels: list[DataFrame] = []
    frontier = spark.createDataFrame([(root,)], "path string")
    while True:
        found = kept(frontier.repartition(F.col("path")).mapInPandas(_lister(), _ENTRIES))
        levels.append(found)
        frontier = found.filter("is_folder").select("path")
        if frontier.isEmpty():
            break
    entries = levels[0]
    for level in levels[1:]:
        entries = entries.unionByName(level)
    inhabited = entries.select(F.col("parent").alias("path")).distinct().withColumn("inhabited", F.lit(True))
    joined = entries.join(inhabited, "path", "left")
    return joined.select(
        "path",
        F.substring("path", len(root) + 2, 1 << 30).alias("relative"),
        "is_folder",
        "length",
        F.timestamp_micros((F.col("modified") * 1_000_000).cast("long")).alias("modificationTime"),
        F.when(F.col("is_folder"), F.col("inhabited").isNull()).otherwise(F.col("length") == 0).alias("empty"),
    )
