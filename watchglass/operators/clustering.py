"""Clusters of alerts: connected through shared indicators, and through sessions of a category or an address pair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchglass.functions.indicators import indicator_type, severity_hint, valid_techniques
from watchglass.functions.text import filled
from watchglass.operators.components import connected_components
from watchglass.operators.sessions import gap_runs
from watchglass.plans.schema import Settings, points, priority_rank

LABEL_CHARS = 60


def sessions(alerts: DataFrame, keys: list[Column], window_minutes: float, scope: str = "file") -> DataFrame:
    """(seq, session): alerts of equal keys, in order of time, as long as no gap is over the window.

    A session is named by its least ``seq``. Alerts with an empty key have none; those without a timestamp share one
    per key. Joining an alert to any within the window makes the same groups, as links of neighbours in time suffice.
    """
    names = [f"_k{i}" for i in range(len(keys) + (scope == "file"))]
    given = [*keys, *([F.coalesce("source_file", F.lit(""))] if scope == "file" else [])]
    rows = alerts.select("seq", F.unix_micros("timestamp").alias("_t"), *[(filled(k) if k is not given[-1] or scope != "file" else k).alias(n) for k, n in zip(given, names, strict=True)])
    rows = rows.dropna(subset=names)
    timed = gap_runs(rows.filter(F.col("_t").isNotNull()), names, "_t", round(window_minutes * 60_000_000))
    numbered = timed.unionByName(rows.filter(F.col("_t").isNull()).withColumn("_n", F.lit(0).cast("long")))
    return numbered.groupBy(*names, "_n").agg(F.min("seq").alias("session")).join(numbered, [*names, "_n"]).select("seq", "session")


def shared_links(alerts: DataFrame) -> DataFrame:
    """Edges (a, b) from the least alert of each shared indicator to each of its alerts."""
    seen = alerts.select("seq", F.explode(F.array_distinct("iocs")).alias("ioc"))
    least = seen.groupBy("ioc").agg(F.min("seq").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return seen.join(least, "ioc").select("a", F.col("seq").alias("b"))


def links(alerts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Edges (a, b) of the graph whose components are clusters.

    A shared indicator or a session is a node itself, with an edge to each of its alerts: edges grow with the alerts
    and not with the square of those that share something. Here the node is the least alert of the group.
    """
    found = shared_links(alerts)
    for keys in ([F.col("category")], [F.col("source_ip"), F.col("dest_ip")]):
        found = found.unionByName(sessions(alerts, keys, settings.window_minutes, settings.scope).select(F.col("session").alias("a"), F.col("seq").alias("b")))
    return found.filter(F.col("a") != F.col("b"))


def assign(alerts: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Alerts with ``cluster_id``: the least ``seq`` of their component."""
    found = connected_components(links(alerts, settings)).select(F.col("node").alias("seq"), F.col("component").alias("cluster_id"))
    out = alerts.join(found, "seq", "left").withColumn("cluster_id", F.coalesce("cluster_id", "seq"))
    return _limited(out, settings.max_clusters) if settings.max_clusters is not None else out.withColumn("overflow", F.lit(False))


def _limited(members: DataFrame, most: int) -> DataFrame:
    """Keeps the ``most`` - 1 clusters of most severity points; the alerts of all others go to one."""
    groups = members.groupBy("cluster_id").agg(F.sum(points(F.col("severity"))).alias("p"))
    top = groups.orderBy(F.desc("p"), "cluster_id").limit(max(0, most - 1)).select("cluster_id").withColumn("kept", F.lit(True))
    over = groups.select(F.count("*").alias("n"))
    joined = members.join(top, "cluster_id", "left").crossJoin(over)
    moved = joined.withColumn("overflow", (F.col("n") > most) & F.col("kept").isNull())
    rest = moved.filter("overflow").agg(F.min("seq").alias("_other"))
    return moved.crossJoin(rest).withColumn("cluster_id", F.when(F.col("overflow"), F.col("_other")).otherwise(F.col("cluster_id"))).drop("n", "kept", "_other")


def _most(members: DataFrame, value: Column, name: str) -> DataFrame:
    """(cluster_id, name): the most frequent value of each cluster, of equally frequent ones that seen first."""
    counted = members.withColumn(name, value).filter(F.col(name).isNotNull()).groupBy("cluster_id", name).agg(F.count("*").alias("n"), F.min("seq").alias("s"))
    return counted.groupBy("cluster_id").agg(F.max_by(name, F.struct("n", -F.col("s"))).alias(name))


def summarize(members: DataFrame, settings: Settings = Settings(), told: DataFrame | None = None) -> DataFrame:
    """One row per cluster: label, confidence, reason, counts, times, indicators, techniques, score and priority.

    ``told`` (cluster_id, label, cluster_reason, confidence) goes before what would be said of a cluster otherwise.
    """
    weights, limits = settings.weights, settings.thresholds
    severity = F.col("severity")
    groups = members.groupBy("cluster_id").agg(
        F.count("*").alias("alert_count"),
        F.min("timestamp").alias("first_seen"),
        F.max("timestamp").alias("last_seen"),
        F.sum(points(severity)).cast("double").alias("raw_score"),
        F.sum(points(severity, weights)).cast("double").alias("base"),
        F.bool_or(severity == "CRITICAL").alias("any_critical"),
        F.count_if(severity == "HIGH").alias("high_count"),
        F.min_by(F.coalesce("title", F.lit("")), "seq").alias("first_title"),
        F.coalesce(F.min_by(F.coalesce("category", F.lit("")), "seq"), F.lit("")).alias("first_category"),
        F.bool_or("overflow").alias("overflow"),
    )
    seen = members.select("cluster_id", "seq", F.explode(F.array_distinct("iocs")).alias("ioc"))
    counted = seen.groupBy("cluster_id", "ioc").agg(F.count("*").alias("n")).withColumn("hint", severity_hint(F.col("ioc")))
    iocs = counted.groupBy("cluster_id").agg(
        F.sort_array(F.collect_list("ioc")).alias("iocs"),
        F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("ioc")))).alias("shared"),
        F.bool_or(F.col("hint").eqNullSafe("critical")).alias("critical_hint"),
        F.bool_or(F.col("hint").eqNullSafe("high")).alias("high_hint"),
    )
    named = members.select("cluster_id", "seq", F.posexplode("technique_ids").alias("p", "t"))
    techniques = named.groupBy("cluster_id", "t").agg(F.min(F.struct("seq", "p")).alias("o")).groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("o", "t"))).alias("ts"))
    techniques = techniques.select("cluster_id", F.array_distinct(valid_techniques(F.transform("ts", lambda x: x["t"]))).alias("techniques"))
    pair = _most(members, F.when(filled(F.col("source_ip")).isNotNull() & filled(F.col("dest_ip")).isNotNull(), F.struct("source_ip", "dest_ip")), "pair")
    category = _most(members, filled(F.col("category")), "top_category")
    out = groups
    for other in (iocs, techniques, pair, category):
        out = out.join(other, "cluster_id", "left")
    none = F.array().cast("array<string>")
    out = out.withColumns({n: F.coalesce(n, none) for n in ("iocs", "shared", "techniques")})
    n, shared, single = F.col("alert_count"), F.size("shared"), F.col("alert_count") == 1
    cat, minutes = F.coalesce("top_category", F.lit("Mixed")), settings.window_minutes
    arrow = F.concat_ws(" → ", F.col("pair.source_ip"), F.col("pair.dest_ip"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    label = (
        F.when(F.col("overflow"), text("Other (", n, " alerts)"))
        .when(single, F.substring(F.coalesce(filled(F.col("first_title")), F.lit("(no title)")), 1, LABEL_CHARS))
        .when(shared == 1, text("IOC Cluster: ", F.get("shared", F.lit(0))))
        .when(shared > 1, text("IOC Campaign (", shared, " IOCs)"))
        .when(F.col("pair").isNotNull(), text(arrow, " (", n, " alerts)"))
        .otherwise(text(cat, " – ", n, " alerts"))
    )
    reason = (
        F.when(F.col("overflow"), "max_clusters limit reached; grouped as Other")
        .when(single, "singleton")
        .when(shared > 3, text("IOC overlap: ", F.array_join(F.slice("shared", 1, 3), ", "), " (+", shared - 3, " more)"))
        .when(shared > 0, text("IOC overlap: ", F.array_join("shared", ", ")))
        .when(F.col("pair").isNotNull(), text("source/dest IP pair: ", arrow))
        .otherwise(text(f"same category within {minutes}m: ", cat))
    )
    confidence = F.when(F.col("overflow") | single, 1.0).when(shared > 0, 0.95).when(F.col("pair").isNotNull(), 0.80).otherwise(0.75)
    out = out.withColumns({"label": label, "cluster_reason": reason, "confidence": confidence, "techniques": F.transform("techniques", lambda t: t)})
    if told is not None:
        names = ("label", "cluster_reason", "confidence")
        out = out.join(told.select("cluster_id", *[F.col(c).alias(f"told_{c}") for c in names]), "cluster_id", "left")
        out = out.withColumns({c: F.coalesce(f"told_{c}", c) for c in names}).drop(*[f"told_{c}" for c in names])
    out = out.withColumn("score", score(F.col("base"), F.col("any_critical"), F.col("high_count"), F.size("iocs"), F.size("techniques"), F.coalesce("critical_hint", F.lit(False)), F.coalesce("high_hint", F.lit(False)), F.col("confidence")))
    out = out.withColumn("priority", priority(F.col("score"), limits)).withColumn("priority_rank", priority_rank(F.col("priority")))
    typed = F.transform("iocs", lambda v: F.struct(v.alias("value"), indicator_type(v).alias("type")))
    return out.withColumns({"ioc_count": F.size("iocs"), "iocs_typed": typed}).drop("base", "any_critical", "high_count", "critical_hint", "high_hint", "pair", "top_category", "shared")


def score(base: Column, any_critical: Column, high_count: Column, iocs: Column, techniques: Column, critical_hint: Column, high_hint: Column, confidence: Column) -> Column:
    """Severity points times what makes a cluster worse, times its confidence, to two decimals."""
    factor = F.lit(1.0)
    for holds, times in ((any_critical, 1.5), (high_count >= 3, 1.3), (iocs >= 5, 1.2), (techniques >= 3, 1.1), (critical_hint, 1.4), (high_hint, 1.2)):
        factor = factor * F.when(holds, times).otherwise(1.0)
    return F.round(base * (factor * confidence), 2)


def priority(points_: Column, limits: dict[str, int] | None = None) -> Column:
    from watchglass.plans.schema import THRESHOLDS

    known = limits or THRESHOLDS
    out = F.when(points_ < known["LOW"], "NOISE")
    for lower, upper in (("LOW", "MEDIUM"), ("MEDIUM", "HIGH"), ("HIGH", "CRITICAL")):
        out = out.when(points_ < known[upper], lower)
    return out.otherwise("CRITICAL")


def ranked(clusters: DataFrame) -> DataFrame:
    """Clusters, highest score first; ties by severity points, then by the first alert."""
    return clusters.orderBy(F.desc("score"), F.desc("raw_score"), "cluster_id")


def merge_on_indicators(clusters: DataFrame) -> DataFrame:
    """(cluster_id, merged_id): clusters of separate runs that share an indicator become one, named by the least."""
    seen = clusters.select("cluster_id", F.explode("iocs").alias("ioc"))
    least = seen.groupBy("ioc").agg(F.min("cluster_id").alias("a"))
    found = connected_components(seen.join(least, "ioc").select("a", F.col("cluster_id").alias("b")))
    return clusters.select("cluster_id").join(found.withColumnRenamed("node", "cluster_id"), "cluster_id", "left").select("cluster_id", F.coalesce("component", "cluster_id").alias("merged_id"))
