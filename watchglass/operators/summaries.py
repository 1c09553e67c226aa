"""Template summaries of clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What is recommended by priority: (action, priority, rationale).
ADVICE = {
    "CRITICAL": (
        ("Isolate affected hosts immediately", "IMMEDIATE", "Critical-priority cluster indicates active or high-confidence threat."),
        ("Block all IOCs at perimeter", "IMMEDIATE", "Prevent lateral movement or exfiltration while investigation proceeds."),
    ),
    "HIGH": (
        ("Investigate affected systems", "WITHIN_1H", "High-priority cluster warrants prompt analyst review to confirm or deny compromise."),
        ("Block top IOCs", "WITHIN_1H", "Reduce attack surface by blocking the most prominent indicators in this cluster."),
    ),
    "MEDIUM": (("Review and validate alerts", "WITHIN_24H", "Medium-priority cluster may represent suspicious activity requiring analyst triage."),),
    "LOW": (("Monitor for escalation", "MONITOR", "Low-confidence or low-severity cluster; re-evaluate if new alerts arrive."),),
}


def advice(priority: Column) -> Column:
    rows = {p: F.array(*[F.struct(F.lit(a).alias("action"), F.lit(b).alias("priority"), F.lit(c).alias("rationale")) for a, b, c in v]) for p, v in ADVICE.items()}
    return F.when(priority == "CRITICAL", rows["CRITICAL"]).when(priority == "HIGH", rows["HIGH"]).when(priority == "MEDIUM", rows["MEDIUM"]).otherwise(rows["LOW"])


def common_severity(members: DataFrame) -> DataFrame:
    """(cluster_id, common_severity): the most frequent one, ties by what is seen first."""
    counted = members.groupBy("cluster_id", "severity").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return counted.groupBy("cluster_id").agg(F.max_by("severity", F.struct("n", -F.col("s"))).alias("common_severity"))


def narratives(clusters: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster_id, narrative, recommendations) of each cluster that is not NOISE."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    iocs = F.when(F.col("ioc_count") == 0, "No IOCs extracted").otherwise(text("Involves ", F.col("ioc_count"), " IOC(s) including ", F.get("iocs", F.lit(0))))
    techniques = F.when(F.size("techniques") == 0, "No ATT&CK mapping").otherwise(text("ATT&CK: ", F.array_join("techniques", ", ")))
    told = clusters.filter(F.col("priority") != "NOISE").join(common_severity(members), "cluster_id")
    line = text(F.col("alert_count"), " ", F.col("common_severity"), " alert(s) grouped by ", F.col("cluster_reason"), ". ", iocs, ". ", techniques, ".")
    return told.select("cluster_id", line.alias("narrative"), advice(F.col("priority")).alias("recommendations"))


def executive(ingested: DataFrame, members: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row: executive_summary and overall_priority."""
    counts = ingested.agg(F.count("*").alias("n")).crossJoin(members.agg(F.count("*").alias("d")))
    over = clusters.agg(F.count("*").alias("c"), F.count_if(F.col("priority") == "CRITICAL").alias("k"), F.coalesce(F.max_by("priority", "priority_rank"), F.lit("NOISE")).alias("overall_priority"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    head = text("Processed ", F.col("n"), " alert(s) (", F.col("d"), " after deduplication), grouped into ", F.col("c"), " cluster(s). ")
    tail = F.when(F.col("k") > 0, text(F.col("k"), " cluster(s) require immediate attention.")).otherwise("No clusters require immediate attention.")
    return counts.crossJoin(over).select(F.concat(head, tail).alias("executive_summary"), "overall_priority")
