"""The driver's tables as alerts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.plans.schema import FIELDS


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def alerts_from_events(events: DataFrame) -> DataFrame:
    """An alert per event: its kind is title and category, and its kind and value decide the severity."""
    kind, value = F.col("event_type"), F.col("value")
    error = kind == "error"
    severity = F.when(error & (value >= 50), "CRITICAL").when(error, "HIGH").when(value >= 50, "MEDIUM").when(value >= 10, "LOW").otherwise("INFO")
    text = lambda c: c.cast("string")
    return events.select(
        F.col("event_id").alias("seq"), F.lit("events").alias("source_file"), text(F.col("event_id")).alias("id"), F.col("ts").cast("timestamp").alias("timestamp"), severity.alias("severity"),
        kind.alias("title"), F.lit(None).cast("string").alias("description"), F.lit("events").alias("source"), text(F.concat(F.lit("net-"), F.col("user_id") % 10)).alias("source_ip"),
        text(F.concat(F.lit("srv-"), F.col("user_id") % 3)).alias("dest_ip"), text(F.col("user_id")).alias("user"), text(F.concat(F.lit("host-"), F.col("user_id") % 7)).alias("host"), kind.alias("category"),
        F.array().cast("array<string>").alias("iocs"), F.array().cast("array<string>").alias("technique_ids"), F.col("props").alias("raw"),
    ).select(*FIELDS)


def alerts_from_documents(docs: DataFrame) -> DataFrame:
    """An alert per document, with its text as description."""
    none = F.lit(None).cast("string")
    return docs.select(
        F.col("doc_id").alias("seq"), F.lit("documents").alias("source_file"), F.col("doc_id").cast("string").alias("id"), F.lit(None).cast("timestamp").alias("timestamp"), F.lit("MEDIUM").alias("severity"),
        F.col("source").alias("title"), F.col("text").alias("description"), F.col("source"), none.alias("source_ip"), none.alias("dest_ip"), none.alias("user"), none.alias("host"), none.alias("category"),
        F.array().cast("array<string>").alias("iocs"), F.array().cast("array<string>").alias("technique_ids"), none.alias("raw"),
    ).select(*FIELDS)
