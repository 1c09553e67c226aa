"""Duplicates of alerts: one fingerprint, close in time to one that was kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchglass.functions.text import normal_title
from watchglass.operators.sessions import gap_runs


def fingerprint() -> Column:
    """SHA-256 over title, addresses, category, host and user, in lower case, with NUL between."""
    parts = [normal_title(F.coalesce("title", F.lit("")))]
    parts += [F.lower(F.coalesce(n, F.lit(""))) for n in ("source_ip", "dest_ip", "category", "host", "user")]
    return F.sha2(F.concat_ws("\0", *parts), 256)


def _scope(scope: str) -> list[Column]:
    return [F.coalesce("source_file", F.lit(""))] if scope == "file" else []


def deduplicate(alerts: DataFrame, window_minutes: float = 30, scope: str = "file") -> DataFrame:
    """Alerts without duplicates.

    In input order (``seq``), an alert with a timestamp stays if none kept before it lies within the window of its own
    time, on either side, bounds included; a window of 0 keeps the first one. An alert without a timestamp stays only
    as the first of its fingerprint. Copies at one instant are folded into one before the fold over time, so a
    storm of equal alerts costs a group no more than its different times.
    """
    marked = alerts.withColumn("_fp", F.concat_ws("\0", *_scope(scope), fingerprint()))
    window = round(window_minutes * 60_000_000)
    groups = marked.groupBy("_fp").agg(F.min("seq").alias("_first"))
    untimed = marked.filter(F.col("timestamp").isNull()).join(groups, "_fp").filter(F.col("seq") == F.col("_first")).drop("_fp", "_first")
    timed = marked.filter(F.col("timestamp").isNotNull())
    instants = timed.groupBy("_fp", F.unix_micros("timestamp").alias("_t")).agg(F.min("seq").alias("_s"))
    if window == 0:
        kept = instants.groupBy("_fp").agg(F.min("_s").alias("_s"))
        return timed.join(kept.select(F.col("_s").alias("seq")), "seq", "left_semi").drop("_fp").unionByName(untimed)
    # Only instants of one run, without a gap over the window, can bear on each other.
    runs = gap_runs(instants, ["_fp"], "_t", window)
    ordered = runs.groupBy("_fp", "_n").agg(F.sort_array(F.collect_list(F.struct("_s", "_t"))).alias("all"))

    def step(kept: Column, row: Column) -> Column:
        return F.when(F.exists(kept, lambda k: F.abs(k["_t"] - row["_t"]) <= window), kept).otherwise(F.concat(kept, F.array(row)))

    empty = F.array().cast("array<struct<_s:bigint,_t:bigint>>")
    folded = ordered.select(F.explode(F.aggregate("all", empty, step)).alias("k")).select(F.col("k._s").alias("_s"))
    return timed.join(folded.select(F.col("_s").alias("seq")), "seq", "left_semi").drop("_fp").unionByName(untimed)


def dedup_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: original, kept, removed and removed_pct (two decimals, 0 without alerts)."""
    both = before.agg(F.count("*").alias("original")).crossJoin(after.agg(F.count("*").alias("kept")))
    both = both.withColumn("removed", F.col("original") - F.col("kept"))
    return both.withColumn("removed_pct", F.coalesce(F.round(F.try_divide(100 * F.col("removed"), F.col("original")), 2), F.lit(0.0)))
