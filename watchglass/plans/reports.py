"""Reports of separate runs as one: clusters that share an indicator become one and are scored anew."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.operators.clustering import merge_on_indicators, ranked, summarize
from watchglass.plans.schema import Settings
from watchglass.plans.triage import Report


def _united(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def merge_reports(reports: Sequence[Report], settings: Settings = Settings()) -> Report:
    """One report of several.

    Alerts are numbered one run after the other. Of clusters that become one, the label and the reason are those of the
    highest score, with how many there were; the confidence is the greatest; score and priority follow from all alerts.
    """
    if not reports:
        raise ValueError("there is no report to merge")
    if len(reports) == 1:
        return reports[0]
    ingested, members, clusters, start = [], [], [], 0
    for report in reports:
        shift = lambda frame, *names, by=start: frame.withColumns({n: F.col(n) + by for n in names})
        ingested.append(shift(report.ingested, "seq"))
        members.append(shift(report.members, "seq", "cluster_id"))
        clusters.append(shift(report.clusters, "cluster_id"))
        last = report.ingested.agg(F.max("seq")).first()[0]
        start += 0 if last is None else last + 1
    known = _united(clusters)
    named = merge_on_indicators(known)
    groups = known.join(named, "cluster_id").groupBy("merged_id")
    best = lambda name: F.max_by(name, F.struct("score", -F.col("cluster_id"))).alias(name)
    told = groups.agg(F.count("*").alias("n"), best("label"), best("cluster_reason"), F.max("confidence").alias("confidence"))
    suffix = F.concat(F.lit("merged "), F.col("n"), F.lit(" chunks by IOC overlap"))
    reason = F.when(F.col("n") == 1, F.col("cluster_reason")).when(F.col("cluster_reason") == "", suffix).otherwise(F.concat("cluster_reason", F.lit(" ["), suffix, F.lit("]")))
    told = told.select(F.col("merged_id").alias("cluster_id"), "label", reason.alias("cluster_reason"), "confidence")
    moved = _united(members).join(named, "cluster_id").withColumn("cluster_id", F.col("merged_id")).drop("merged_id")
    return Report(_united(ingested), moved, ranked(summarize(moved, settings, told)))
