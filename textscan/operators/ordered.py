"""Running sums over ordered groups of any size, without gathering a group.

The rows are sorted over all partitions by range.  Each partition adds up on its own; only the first group of a partition
can have begun before it, so one offset per partition makes the sums whole.
"""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COMBINE = {"sum": np.add, "xor": np.bitwise_xor}


def kept(df: DataFrame) -> DataFrame:
    """``df`` computed once, in the folder that ``spark.checkpoint.dir`` names for all executors.  Only a local session
    without that setting gets a temporary one."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="textscan-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def _local(n: int, combine: np.ufunc) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows whose last columns are the group (two longs) and ``n`` values -> the same with what comes before each
    row in its group and partition, what it comes to with the row, the number of groups before, and the row's number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, carry, number, rows = None, [np.int64(0)] * n, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            at = b.num_columns - n - 2
            ids = np.column_stack([b.column(at + k).to_numpy(zero_copy_only=False) for k in (0, 1)])
            new = np.concatenate(([group is not None and (ids[0] != group).any()], (ids[1:] != ids[:-1]).any(axis=1)))
            of = np.cumsum(new)
            edges = np.concatenate(([0], np.flatnonzero(new[1:]) + 1))
            befores, afters = [], []
            for k in range(n):
                value = b.column(at + 2 + k).to_numpy(zero_copy_only=False)
                with np.errstate(over="ignore"):
                    through = combine.accumulate(value)
                    before = np.concatenate(([np.int64(0)], through[:-1]))
                    base = before[edges]  # what all groups of the batch before this one come to
                    if combine is np.add:
                        before = before - np.repeat(base, np.diff(np.append(edges, len(ids))))
                    else:
                        before = before ^ np.repeat(base, np.diff(np.append(edges, len(ids))))
                    if not new[0]:
                        first = slice(0, edges[1] if len(edges) > 1 else len(ids))
                        before[first] = combine(before[first], carry[k])
                    after = combine(before, value)
                befores.append(pa.array(before)), afters.append(pa.array(after))
                carry[k] = after[-1]
            numbers = pa.array(number + of)
            place = pa.array(rows + np.arange(len(ids), dtype=np.int64))
            number, group, rows = number + int(of[-1]), ids[-1], rows + len(ids)
            names = [*b.schema.names[: at + 2], *(f"__before{k}" for k in range(n)), *(f"__after{k}" for k in range(n)), "__number", "__place"]
            yield pa.RecordBatch.from_arrays([*b.columns[: at + 2], *befores, *afters, numbers, place], names=names)

    return run


def running(df: DataFrame, by: Sequence[str], order: Sequence[Column | str], values: dict[str, Column], how: str = "sum") -> DataFrame:
    """``df`` and, per name of ``values`` (longs), what the values of the rows before it in its group come to (0 in the
    first row).  ``how`` is ``sum`` or ``xor``.

    Groups are the rows that agree in ``by`` (nulls too); ``order`` sorts a group, and rows that tie are in any order.
    No group is gathered: a group that fills many partitions costs one offset for each of them."""
    combine = _COMBINE[how]
    n, names = len(values), list(values)
    nulls = [F.col(c).isNull() for c in by]
    group = [F.xxhash64(F.lit(k), *by, *nulls) for k in (0, 1)]
    schema = T.StructType(list(df.schema.fields)).add("__part", "integer").add("__group0", "long").add("__group1", "long")
    for name in (*(f"__before{k}" for k in range(n)), *(f"__after{k}" for k in range(n)), "__number", "__place"):
        schema = schema.add(name, "long")
    keyed = df.withColumns({"__group0": group[0], "__group1": group[1], "__tie": F.monotonically_increasing_id()})
    sort = ["__group0", "__group1", *order, "__tie"]
    ranged = keyed.repartitionByRange(*sort).sortWithinPartitions(*sort)
    wide = ranged.select(*df.columns, F.spark_partition_id().alias("__part"), "__group0", "__group1", *[v.cast("long").alias(f"__value{k}") for k, v in enumerate(values.values())])
    local = kept(wide.mapInArrow(_local(n, combine), schema))
    group_id = F.struct("__group0", "__group1").alias("group")
    last = F.struct("__number", *[F.col(f"__after{k}") for k in range(n)], group_id)
    ends = local.groupBy("__part").agg(F.min_by(group_id, "__place").alias("first"), F.max_by(last, "__place").alias("last")).orderBy("__part").collect()
    offsets, carry, before = [], [0] * n, None
    for row in ends:  # one row per partition
        begun = before is not None and row["first"] == before
        offset = carry if begun else [0] * n
        offsets.append((row["__part"], *offset))
        after = [row["last"][f"__after{k}"] for k in range(n)]
        goes_on = row["last"]["__number"] == 0
        carry = [int(combine(np.int64(a), np.int64(b))) for a, b in zip(after, offset, strict=True)] if goes_on else after
        before = row["last"]["group"]
    table = df.sparkSession.createDataFrame(offsets, "__part int" + "".join(f", __offset{k} long" for k in range(n)))
    joined = local.join(F.broadcast(table), "__part")
    added = []
    for k, name in enumerate(names):
        here, offset = F.col(f"__before{k}"), F.col(f"__offset{k}")
        total = here.bitwiseXOR(offset) if how == "xor" else here + offset
        added.append(F.when(F.col("__number") == 0, total).otherwise(here).alias(name))
    return joined.select(*df.columns, *added)

