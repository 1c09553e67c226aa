"""Runs of events of a key without a gap over a window, for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400_000_000


def gap_runs(rows: DataFrame, keys: list[str], time: str, window: int, bucket: int = DAY) -> DataFrame:
    """``rows`` with ``_n``: the number, from 1 on, of the run that a row is in among those of its key.

    ``time`` is in microseconds, without nulls; a gap of exactly ``window`` doesn't end a run. A key's rows are dealt
    by buckets of time, so that a frequent key is sorted in many tasks; each bucket's first and last time and number of
    runs then settle where runs go on over buckets and from which number a bucket counts.
    """
    dealt = rows.withColumn("_b", F.floor(F.col(time) / bucket))
    inside = Window.partitionBy(*keys, "_b").orderBy(time)
    over = F.col(time) - F.lag(time).over(inside) > window
    marked = dealt.withColumn("_over", F.coalesce(over, F.lit(False)).cast("long")).withColumn("_local", F.sum("_over").over(inside.rangeBetween(Window.unboundedPreceding, 0)))
    buckets = marked.groupBy(*keys, "_b").agg(F.min(time).alias("_first"), F.max(time).alias("_last"), F.sum("_over").alias("_inner"))
    across = Window.partitionBy(*keys).orderBy("_b")
    apart = F.coalesce(F.col("_first") - F.lag("_last").over(across) > window, F.lit(True)).cast("long")
    counted = buckets.withColumn("_apart", apart).withColumn("_base", F.sum(F.col("_apart") + F.col("_inner")).over(across) - F.col("_inner"))
    joined = marked.join(counted.select(*keys, "_b", "_base"), [*keys, "_b"])
    return joined.withColumn("_n", F.col("_base") + F.col("_local")).drop("_b", "_over", "_local", "_base")
