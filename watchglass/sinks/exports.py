"""Flat and nested exports. Encoded payloads leave only as stubs, unless asked for."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchglass.functions import patterns as P
from watchglass.functions.indicators import encoded_stub, indicator_type
from watchglass.plans.triage import Report

#: Clusters, and alerts of each, that one document shows.
TOP = 1000


def _hidden(value: Column) -> Column:
    return F.when(F.startswith(value, F.lit(P.ENCODED_PREFIX)), P.ENCODED_PREFIX + "[REDACTED]").otherwise(value)


def _iso(time: Column) -> Column:
    return F.coalesce(F.date_format(time, "yyyy-MM-dd'T'HH:mm:ssXXX"), F.lit("None"))


def alert_rows(members: DataFrame, clusters: DataFrame, raw_payload: bool = False) -> DataFrame:
    """One row per alert with its cluster's label, priority and score: the 15 columns of the alert CSV."""
    kept = clusters.select("cluster_id", "label", "priority", F.col("score").alias("cluster_score"))
    value = (lambda v: v) if raw_payload else _hidden
    empty = lambda n: F.coalesce(n, F.lit(""))
    return members.join(kept, "cluster_id").select(
        F.col("id").alias("alert_id"),
        _iso(F.col("timestamp")).alias("alert_timestamp"),
        F.col("severity").alias("alert_severity"),
        F.col("title").alias("alert_title"),
        *[empty(n).alias(f"alert_{n}") for n in ("category", "source_ip", "dest_ip", "user", "host")],
        F.array_join(F.transform("iocs", value), "|").alias("alert_iocs"),
        F.array_join(F.array_distinct(F.transform("iocs", lambda v: indicator_type(v))), "|").alias("alert_ioc_types"),
        F.col("cluster_id").cast("string").alias("cluster_id"),
        F.col("label").alias("cluster_label"),
        F.col("priority").alias("cluster_priority"),
        "cluster_score",
    )


def cluster_rows(clusters: DataFrame) -> DataFrame:
    """One row per cluster: the 11 columns of the cluster CSV."""
    return clusters.select(
        F.col("cluster_id").cast("string").alias("cluster_id"), "label", "priority", "score", "confidence", "alert_count", "ioc_count",
        F.array_join("techniques", "|").alias("technique_ids"), _iso(F.col("first_seen")).alias("first_seen"), _iso(F.col("last_seen")).alias("last_seen"),
        F.coalesce("cluster_reason", F.lit("")).alias("cluster_reason"),
    )


def cluster_documents(members: DataFrame, clusters: DataFrame, raw_payload: bool = False) -> DataFrame:
    """(cluster_id, json): each cluster with its alerts as one JSON document."""
    safe = (lambda v: v) if raw_payload else lambda v: encoded_stub(v)
    listed = lambda n: F.transform(n, safe)
    fields = ["id", "timestamp", "severity", "title", "description", "source", "source_ip", "dest_ip", "user", "host", "category"]
    alert = F.struct("seq", *fields, listed("iocs").alias("iocs"), "technique_ids")
    nested = members.groupBy("cluster_id").agg(F.sort_array(F.collect_list(alert)).alias("alerts"))
    typed = F.transform("iocs_typed", lambda x: F.struct(safe(x["value"]).alias("value"), x["type"].alias("type")))
    both = clusters.join(nested, "cluster_id").withColumns({"iocs": listed("iocs"), "iocs_typed": typed})
    kept = ["cluster_id", "label", "priority", "score", "confidence", "cluster_reason", "first_seen", "last_seen", "iocs", "iocs_typed", "techniques", "alerts"]
    return both.select("cluster_id", F.to_json(F.struct(*kept)).alias("json"))


def report_document(report: Report, source: str, at: str, summary: dict | None = None, raw_payload: bool = False, top: int = TOP) -> dict:
    """The report as one document: statistics, how it was made, a summary if given, and the first ``top`` clusters.

    It is for people and tools that take one document; ``write_report`` writes every cluster.
    """
    stats = report.stats().first().asDict()
    first = report.clusters.orderBy(F.desc("score"), F.desc("raw_score"), "cluster_id").limit(top)
    few = report.members.join(F.broadcast(first.select("cluster_id")), "cluster_id", "left_semi")  # ``top`` ids
    place = F.row_number().over(Window.partitionBy("cluster_id").orderBy("seq"))
    shown = few.withColumn("_place", place).filter(F.col("_place") <= top).drop("_place")
    rows = {r["cluster_id"]: json.loads(r["json"]) for r in cluster_documents(shown, first, raw_payload).collect()}
    order = [r["cluster_id"] for r in first.select("cluster_id").collect()]
    counts = {r["priority"]: r["count"] for r in report.clusters.groupBy("priority").count().collect()}
    return {
        "input_file": source, "analyzed_at": at, "alerts_ingested": stats["original"], "alerts_after_dedup": stats["kept"], "removed_pct": stats["removed_pct"],
        "cluster_count": sum(counts.values()), "clusters_by_priority": counts, "clusters_shown": len(order), "clusters": [rows[i] for i in order], "summary": summary,
        "manifest": {"engine": "watchglass", "spark": report.clusters.sparkSession.version, "alerts_shown_per_cluster": top},
    }


def write_report(report: Report, path: str, source: str, at: str, summary: dict | None = None, raw_payload: bool = False) -> None:
    """Writes ``report`` (the document), ``clusters`` (every one, a line each) and ``alerts`` (every one) under ``path``."""
    spark = report.clusters.sparkSession
    text = json.dumps(report_document(report, source, at, summary, raw_payload), default=str)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/report")
    safe = (lambda v: v) if raw_payload else lambda v: encoded_stub(v)
    clusters = report.clusters.withColumn("iocs", F.transform("iocs", safe)).drop("iocs_typed")
    clusters.select(F.to_json(F.struct(*clusters.columns)).alias("value")).write.mode("overwrite").text(f"{path}/clusters")
    alert_rows(report.members, report.clusters, raw_payload).write.mode("overwrite").json(f"{path}/alerts")


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_json(documents: DataFrame, path: str) -> None:
    """A line of JSON per cluster, written where the rows are."""
    documents.select(F.col("json").alias("value")).write.mode("overwrite").text(path)
