"""The same work on streams of alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from watchglass.operators.dedup import fingerprint
from watchglass.plans.schema import Settings, points
from watchglass.plans.triage import Report, triage


def deduplicated(alerts: DataFrame, lateness: str = "30 minutes") -> DataFrame:
    """Drops alerts whose fingerprint was seen within ``lateness`` before; state is let go behind the watermark."""
    return alerts.withColumn("fingerprint", fingerprint()).withWatermark("timestamp", lateness).dropDuplicatesWithinWatermark(["fingerprint"])


def category_sessions(alerts: DataFrame, gap: str = "30 minutes", lateness: str = "30 minutes") -> DataFrame:
    """Sessions of each category, as they close: category, first_seen, last_seen, n and severity points.

    Alerts exactly a gap apart are in one session, as in batches.
    """
    timed = alerts.withWatermark("timestamp", lateness)
    grouped = timed.groupBy("category", F.session_window("timestamp", gap).alias("w"))
    out = grouped.agg(F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"), F.count("*").alias("n"), F.sum(points(F.col("severity"))).alias("points"))
    return out.drop("w")


def triage_batches(alerts: DataFrame, sink: Callable[[Report, int], None], checkpoint: str, settings: Settings = Settings()) -> StreamingQuery:
    """Triage of each micro-batch, handed to ``sink``; started with a checkpoint, so that a batch is done again after a failure."""

    def one(batch: DataFrame, number: int) -> None:
        sink(triage(batch, settings), number)

    return alerts.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).start()
