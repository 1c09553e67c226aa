"""Counts over alerts and clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.functions.indicators import indicator_type, metric_type
from watchglass.functions.text import filled
from watchglass.plans.schema import points


def overview(members: DataFrame) -> DataFrame:
    """One row: cluster_count, alert_count and avg_cluster_size."""
    out = members.groupBy("cluster_id").agg(F.count("*").alias("n")).agg(F.count("*").alias("cluster_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("alert_count"))
    return out.withColumn("avg_cluster_size", F.coalesce(F.try_divide("alert_count", "cluster_count"), F.lit(0.0)))


def top_categories(members: DataFrame, most: int = 5) -> DataFrame:
    """(category, n): the most frequent categories, ties by what is seen first."""
    counted = members.filter(filled(F.col("category")).isNotNull()).groupBy("category").agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return counted.orderBy(F.desc("n"), "s").limit(most).select("category", "n")


def indicator_types(clusters: DataFrame, most: int = 10) -> DataFrame:
    """(type, n): indicators of clusters by coarse type."""
    return clusters.select(F.explode("iocs").alias("v")).groupBy(metric_type(F.col("v")).alias("type")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "type").limit(most)


def types_by_cluster(clusters: DataFrame) -> DataFrame:
    return clusters.select("cluster_id", F.explode("iocs").alias("v")).groupBy("cluster_id", indicator_type(F.col("v")).alias("type")).agg(F.count("*").alias("n"))


def breakdown(members: DataFrame, most: int = 10) -> DataFrame:
    """(cluster_id, title, n, severity, first_id): titles of each cluster, the worst ones first, ``most`` of each."""
    from pyspark.sql import Window

    groups = members.groupBy("cluster_id", "title").agg(F.count("*").alias("n"), F.max_by("severity", points(F.col("severity"))).alias("severity"), F.min_by("id", "seq").alias("first_id"), F.min("seq").alias("s"))
    order = Window.partitionBy("cluster_id").orderBy(F.desc(points(F.col("severity"))), "s")
    return groups.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("s")


def confusion(rows: DataFrame) -> DataFrame:
    """(expected, actual, n)."""
    return rows.groupBy("expected", "actual").agg(F.count("*").alias("n"))
