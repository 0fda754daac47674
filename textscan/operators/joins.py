"""Joins of many rows with a table of keys of which a few may be very frequent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key that more than one in so many rows meet is dealt out; there are fewer such keys than this.
MOST_HOT = 10_000


def spread_join(rows: DataFrame, table: DataFrame, on: list[str], n: str, spread: Column) -> DataFrame:
    """``rows`` joined with a ``table`` of one row per key, whose column ``n`` says how many rows meet it.

    A frequent key is dealt out by ``spread``, a hash of the rows, to several tasks; only the numbers of parts of frequent
    keys are broadcast.  ``table`` is read three times, so it should be computed already."""
    most = max(1, (table.agg(F.sum(n)).first()[0] or 0) // MOST_HOT)
    parts = F.ceil(F.col(n) / most).cast("int")
    hot = table.filter(F.col(n) > most).select(*on, parts.alias("__parts"))
    dealt = rows.join(F.broadcast(hot), on, "left").withColumn("__part", F.coalesce(F.pmod(spread, F.col("__parts")).cast("int"), F.lit(0)))
    copied = table.withColumn("__part", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)))
    return dealt.drop("__parts").join(copied, [*on, "__part"]).drop("__part")
