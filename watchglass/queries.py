"""Queries of the triage engine over the driver's tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.functions import indicators as I
from watchglass.functions import patterns as P
from watchglass.functions.text import entropy, escape_html, escape_markdown, name_uuid, normal_title
from watchglass.operators import clustering, dedup, enrichment, injection, metrics, redaction, summaries
from watchglass.operators.components import connected_components
from watchglass.operators.filters import parse_filter
from watchglass.plans.schema import Settings, points
from watchglass.plans.triage import triage
from watchglass.sinks import exports, stix, tickets
from watchglass.sources.tables import alerts_from_documents, alerts_from_events, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

ALERTS = """alerts AS (SELECT event_id AS seq, ts, event_type AS category, event_type AS title, user_id::VARCHAR AS "user", 'host-' || (user_id % 7) AS host,
  'net-' || (user_id % 10) AS source_ip, 'srv-' || (user_id % 3) AS dest_ip, props AS raw,
  CASE WHEN event_type = 'error' AND value >= 50 THEN 'CRITICAL' WHEN event_type = 'error' THEN 'HIGH' WHEN value >= 50 THEN 'MEDIUM' WHEN value >= 10 THEN 'LOW' ELSE 'INFO' END AS severity
  FROM events)"""
POINTS = "CASE severity WHEN 'INFO' THEN 1 WHEN 'LOW' THEN 2 WHEN 'MEDIUM' THEN 5 WHEN 'HIGH' THEN 10 ELSE 20 END"
FINGERPRINT = """fp AS (SELECT *, sha256(lower(title) || chr(0) || lower(source_ip) || chr(0) || lower(dest_ip) || chr(0) || lower(category) || chr(0) || lower(host) || chr(0) || lower("user")) AS fingerprint FROM alerts)"""
SESSIONS = """gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY category ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM alerts),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY category ORDER BY ts, seq) AS n FROM gaps),
members AS (SELECT *, min(seq) OVER (PARTITION BY category, n) AS cluster_id FROM numbered)"""
SCORED = f"""groups AS (SELECT cluster_id, count(*) AS alert_count, sum({POINTS})::DOUBLE AS raw_score, bool_or(severity = 'CRITICAL') AS any_critical,
  count(*) FILTER (severity = 'HIGH') AS high_count, min(category) AS category, min(ts) AS first_seen, max(ts) AS last_seen, arg_min(title, seq) AS first_title FROM members GROUP BY cluster_id),
scored AS (SELECT *, round(raw_score * (1.0::DOUBLE * CASE WHEN any_critical THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN high_count >= 3 THEN 1.3::DOUBLE ELSE 1.0 END * CASE WHEN alert_count = 1 THEN 1.0::DOUBLE ELSE 0.75 END), 2) AS score FROM groups),
clusters AS (SELECT *, CASE WHEN score < 5 THEN 'NOISE' WHEN score < 20 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 100 THEN 'HIGH' ELSE 'CRITICAL' END AS priority,
  CASE WHEN alert_count = 1 THEN 1.0 ELSE 0.75 END::DOUBLE AS confidence, CASE WHEN alert_count = 1 THEN substr(first_title, 1, 60) ELSE category || ' – ' || alert_count || ' alerts' END AS label,
  CASE WHEN alert_count = 1 THEN 'singleton' ELSE 'same category within 30m: ' || category END AS reason FROM scored)"""
WITH = f"WITH {ALERTS}, {SESSIONS}, {SCORED} "


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def events(spark: SparkSession, d: str) -> DataFrame:
    return alerts_from_events(read(spark, d, "events"))


def session_members(spark: SparkSession, d: str) -> DataFrame:
    """Alerts in the clusters that sessions of their category make: a single kind of link needs no graph."""
    alerts = events(spark, d).withColumns({"source_ip": F.lit(None).cast("string"), "dest_ip": F.lit(None).cast("string")})
    found = clustering.sessions(alerts, [F.col("category")], 30)
    return alerts.join(found, "seq").withColumnRenamed("session", "cluster_id").withColumn("overflow", F.lit(False))


def session_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clustering.summarize(session_members(spark, d))


@query("session_triage", WITH + "SELECT cluster_id, label, reason AS cluster_reason, confidence, alert_count, score, priority, first_seen, last_seen FROM clusters")
def session_triage(spark: SparkSession, d: str) -> DataFrame:
    out = session_clusters(spark, d).select("cluster_id", "label", "cluster_reason", "confidence", "alert_count", "score", "priority", "first_seen", "last_seen")
    return out.withColumns({n: F.col(n).cast("timestamp_ntz") for n in ("first_seen", "last_seen")})


@query("severity_counts", f"WITH {ALERTS} SELECT severity, count(*) AS n, sum({POINTS})::BIGINT AS points FROM alerts GROUP BY severity")
def severity_counts(spark, d):
    return events(spark, d).groupBy("severity").agg(F.count("*").alias("n"), F.sum(points(F.col("severity"))).alias("points"))


@query("dedup_fingerprint", f"WITH {ALERTS}, {FINGERPRINT} SELECT seq, fingerprint FROM fp")
def dedup_fingerprint(spark, d):
    return events(spark, d).select("seq", dedup.fingerprint().alias("fingerprint"))


@query("dedup_window_zero", f"WITH {ALERTS}, {FINGERPRINT} SELECT min(seq) AS seq FROM fp GROUP BY fingerprint")
def dedup_window_zero(spark, d):
    return dedup.deduplicate(events(spark, d), 0).select("seq")


@query("dedup_untimed", f"WITH {ALERTS}, {FINGERPRINT} SELECT min(seq) AS seq FROM fp GROUP BY fingerprint")
def dedup_untimed(spark, d):
    return dedup.deduplicate(events(spark, d).withColumn("timestamp", F.lit(None).cast("timestamp"))).select("seq")


# Events come in order of time, so the last one kept is all that greedy retention has to look at.
@query(
    "dedup_greedy",
    f"""WITH RECURSIVE {ALERTS}, {FINGERPRINT}, o AS (SELECT seq, fingerprint, ts, row_number() OVER (PARTITION BY fingerprint ORDER BY seq) AS i FROM fp),
walk AS (SELECT seq, fingerprint, i, ts AS last, true AS kept FROM o WHERE i = 1 UNION ALL
SELECT o.seq, o.fingerprint, o.i, CASE WHEN o.ts - w.last > INTERVAL 30 MINUTE THEN o.ts ELSE w.last END, o.ts - w.last > INTERVAL 30 MINUTE FROM walk w JOIN o ON o.fingerprint = w.fingerprint AND o.i = w.i + 1)
SELECT seq FROM walk WHERE kept""",
)
def dedup_greedy(spark, d):
    return dedup.deduplicate(events(spark, d), 30).select("seq")


@query("dedup_stats", f"WITH {ALERTS}, {FINGERPRINT}, k AS (SELECT count(*) AS original, count(DISTINCT fingerprint) AS kept FROM fp) SELECT original, kept, original - kept AS removed, round(100 * (original - kept) / original, 2) AS removed_pct FROM k")
def dedup_statistics(spark, d):
    alerts = events(spark, d)
    return dedup.dedup_stats(alerts, dedup.deduplicate(alerts, 0))


@query("category_sessions", f"WITH {ALERTS}, {SESSIONS} SELECT seq, cluster_id AS session FROM members")
def category_sessions(spark, d):
    return clustering.sessions(events(spark, d), [F.col("category")], 30)


@query(
    "ip_pair_sessions",
    f"""WITH {ALERTS}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source_ip, dest_ip ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM alerts),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY source_ip, dest_ip ORDER BY ts, seq) AS n FROM gaps) SELECT seq, min(seq) OVER (PARTITION BY source_ip, dest_ip, n) AS session FROM numbered""",
)
def ip_pair_sessions(spark, d):
    return clustering.sessions(events(spark, d), [F.col("source_ip"), F.col("dest_ip")], 30)


@query(
    "overlap_components",
    """WITH RECURSIVE a AS (SELECT event_id AS seq, 'u' || user_id AS u, 'h' || date_trunc('hour', ts) AS h FROM events), e AS (SELECT DISTINCT u AS x, h AS y FROM a UNION SELECT DISTINCT h, u FROM a),
first AS (SELECT k, min(seq) AS m FROM (SELECT u AS k, seq FROM a UNION ALL SELECT h, seq FROM a) GROUP BY k),
cc(k, m) USING KEY (k) AS (SELECT k, m FROM first UNION SELECT e.y, min(cc.m) FROM cc JOIN e ON e.x = cc.k JOIN recurring.cc AS r ON r.k = e.y WHERE cc.m < r.m GROUP BY e.y)
SELECT seq, m AS component FROM a JOIN cc ON cc.k = a.u""",
)
def overlap_components(spark, d):
    """Components of all alerts that share a user or an hour."""
    alerts = events(spark, d).withColumn("iocs", F.array_compact(F.array(F.concat(F.lit("u"), "user"), F.concat(F.lit("h"), F.date_trunc("hour", "timestamp").cast("string")))))
    found = connected_components(clustering.shared_links(alerts)).withColumnRenamed("node", "seq")
    return alerts.select("seq").join(found, "seq", "left").select("seq", F.coalesce("component", "seq").alias("component"))


PAGE_HOST = "regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1)"
PAGE_DOMAIN = f"regexp_extract({PAGE_HOST}, '[^.]+\\.[^.]+$')"
SEVERITY_OF_PAGE = "CASE page_id % 5 WHEN 0 THEN 'INFO' WHEN 1 THEN 'LOW' WHEN 2 THEN 'MEDIUM' WHEN 3 THEN 'HIGH' ELSE 'CRITICAL' END"
PRIORITY_OF = "CASE WHEN score < 5 THEN 'NOISE' WHEN score < 20 THEN 'LOW' WHEN score < 50 THEN 'MEDIUM' WHEN score < 100 THEN 'HIGH' ELSE 'CRITICAL' END"


def page_alerts(spark, d, *indicators: str) -> DataFrame:
    """An alert per page, with indicators of its address."""
    pages = read(spark, d, "pages")
    host = F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#:]+)", 1)
    values = {"url": F.col("url"), "host": host, "domain": F.regexp_extract(host, r"[^.]+\.[^.]+$", 0)}
    severity = F.element_at(F.array(*[F.lit(s) for s in ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")]), (F.col("page_id") % 5 + 1).cast("int"))
    none = F.lit(None).cast("string")
    made = {"seq": F.col("page_id"), "source_file": F.lit("pages"), "id": F.col("page_id").cast("string"), "timestamp": F.lit(None).cast("timestamp"), "severity": severity, "title": host}
    made |= {n: none for n in ("description", "source", "source_ip", "dest_ip", "user", "host", "category", "raw")}
    made |= {"iocs": F.array(*[values[n] for n in indicators]), "technique_ids": F.array().cast("array<string>")}
    return pages.select(*[c.alias(n) for n, c in made.items()])


def _page_clusters(key: str, indicators: str) -> str:
    return f"""WITH m AS (SELECT page_id AS seq, min(page_id) OVER (PARTITION BY {key}) AS cluster_id, {indicators} AS iocs, {PAGE_HOST} AS title, {SEVERITY_OF_PAGE} AS severity FROM pages),
i AS (SELECT cluster_id, ioc, count(*) AS n FROM (SELECT cluster_id, unnest(iocs) AS ioc FROM m) GROUP BY ALL),
s AS (SELECT cluster_id, count(*)::INTEGER AS ioc_count, list_sort(list(ioc) FILTER (n > 1)) AS shared, string_agg(ioc, '|' ORDER BY ioc) AS iocs FROM i GROUP BY cluster_id),
g AS (SELECT cluster_id, count(*) AS alert_count, sum({POINTS})::DOUBLE AS raw_score, bool_or(severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, arg_min(title, seq) AS t FROM m GROUP BY cluster_id),
k AS (SELECT *, CASE WHEN alert_count = 1 THEN 1.0 ELSE 0.95 END::DOUBLE AS confidence FROM g JOIN s USING (cluster_id)),
r AS (SELECT *, round(raw_score * (1.0::DOUBLE * CASE WHEN c THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN h >= 3 THEN 1.3::DOUBLE ELSE 1.0 END * CASE WHEN ioc_count >= 5 THEN 1.2::DOUBLE ELSE 1.0 END * confidence), 2) AS score FROM k)
SELECT cluster_id, alert_count, ioc_count, iocs, confidence, score, {PRIORITY_OF} AS priority,
CASE WHEN alert_count = 1 THEN substr(t, 1, 60) WHEN len(shared) = 1 THEN 'IOC Cluster: ' || shared[1] ELSE 'IOC Campaign (' || len(shared) || ' IOCs)' END AS label,
CASE WHEN alert_count = 1 THEN 'singleton' ELSE 'IOC overlap: ' || array_to_string(shared[1:3], ', ') || CASE WHEN len(shared) > 3 THEN ' (+' || (len(shared) - 3) || ' more)' ELSE '' END END AS cluster_reason FROM r"""


def _page_triage(spark, d, *indicators: str) -> DataFrame:
    members = clustering.assign(page_alerts(spark, d, *indicators))
    out = clustering.summarize(members).withColumn("iocs", F.array_join("iocs", "|"))
    return out.select("cluster_id", "alert_count", "ioc_count", "iocs", "confidence", "score", "priority", "label", "cluster_reason")


@query("ioc_clusters", _page_clusters(PAGE_HOST, f"[url, {PAGE_HOST}]"))
def ioc_clusters(spark, d):
    """Clusters through shared indicators, scored: pages of one host."""
    return _page_triage(spark, d, "url", "host")


@query("ioc_campaigns", _page_clusters(PAGE_DOMAIN, f"[url, {PAGE_HOST}, {PAGE_DOMAIN}]"))
def ioc_campaigns(spark, d):
    """Clusters that share several indicators: hosts linked by their domain."""
    return _page_triage(spark, d, "url", "host", "domain")


@query(
    "ip_pair_triage",
    f"""WITH {ALERTS}, gaps AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY source_ip, dest_ip ORDER BY ts, seq) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS starts FROM alerts),
numbered AS (SELECT *, sum(starts) OVER (PARTITION BY source_ip, dest_ip ORDER BY ts, seq) AS n FROM gaps), m AS (SELECT *, min(seq) OVER (PARTITION BY source_ip, dest_ip, n) AS cluster_id FROM numbered),
g AS (SELECT cluster_id, count(*) AS alert_count, any_value(source_ip) || ' → ' || any_value(dest_ip) AS pair, sum({POINTS})::DOUBLE AS raw_score, bool_or(severity = 'CRITICAL') AS c, count(*) FILTER (severity = 'HIGH') AS h, arg_min(title, seq) AS t FROM m GROUP BY cluster_id),
k AS (SELECT *, CASE WHEN alert_count = 1 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence FROM g),
r AS (SELECT *, round(raw_score * (1.0::DOUBLE * CASE WHEN c THEN 1.5::DOUBLE ELSE 1.0 END * CASE WHEN h >= 3 THEN 1.3::DOUBLE ELSE 1.0 END * confidence), 2) AS score FROM k)
SELECT cluster_id, alert_count, confidence, score, {PRIORITY_OF} AS priority, CASE WHEN alert_count = 1 THEN t ELSE pair || ' (' || alert_count || ' alerts)' END AS label,
CASE WHEN alert_count = 1 THEN 'singleton' ELSE 'source/dest IP pair: ' || pair END AS cluster_reason FROM r""",
)
def ip_pair_triage(spark, d):
    """Clusters through sessions of an address pair, scored and labelled by it."""
    alerts = events(spark, d).withColumn("category", F.lit(None).cast("string"))
    found = clustering.sessions(alerts, [F.col("source_ip"), F.col("dest_ip")], 30)
    members = alerts.join(found, "seq").withColumnRenamed("session", "cluster_id").withColumn("overflow", F.lit(False))
    return clustering.summarize(members).select("cluster_id", "alert_count", "confidence", "score", "priority", "label", "cluster_reason")


@query("priority_histogram", WITH + "SELECT priority, count(*) AS clusters, sum(alert_count)::BIGINT AS alerts FROM clusters GROUP BY priority")
def priority_histogram(spark, d):
    return session_clusters(spark, d).groupBy("priority").agg(F.count("*").alias("clusters"), F.sum("alert_count").alias("alerts"))


FILTERS = {
    "filter_priority_and_count": ("priority >= HIGH AND alert_count > 5", "priority IN ('HIGH', 'CRITICAL') AND alert_count > 5"),
    "filter_category_in": ("category IN ('Error', click) AND NOT priority == NOISE", "category IN ('error', 'click') AND priority <> 'NOISE'"),
    "filter_category_not_in": ("category NOT IN (error, view,) OR confidence_score >= 1.0", "category NOT IN ('error', 'view') OR confidence >= 1"),
    "filter_nested": ("NOT (priority < MEDIUM OR ioc_count != 0) AND category != 'view'", "NOT priority IN ('NOISE', 'LOW') AND category <> 'view'"),
}
for _name, (_text, _where) in FILTERS.items():
    query(_name, WITH + f"SELECT cluster_id, priority, alert_count FROM clusters WHERE {_where}")(lambda spark, d, t=_text: session_clusters(spark, d).filter(parse_filter(t)).select("cluster_id", "priority", "alert_count"))

_RE2 = {
    "emails": ("documents", "doc_id", "text", I._within(P.EMAIL), r"\b[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}\b"),
    "ipv4": ("documents", "doc_id", "text", I._within(P.IPV4), r"\b(?:(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]\d|\d)\b"),
    "sha1": ("documents", "doc_id", "text", r"(?U)\b[0-9a-fA-F]{40}\b", r"\b[0-9a-fA-F]{40}\b"),
    "domains": ("pages", "page_id", "url", I._within(P.DOMAIN), r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+[a-zA-Z]{2,}\b"),
    "urls": ("pages", "page_id", "url", "(?iU)" + P.URL.removeprefix("(?i)"), r"""(?i)(?:https?|ftp)://[^\s"'<>()\[\]{}|\\^`]+"""),
}
for _name, (_table, _key, _column, _java, _re2) in _RE2.items():
    _found = f"list_sort(list_distinct(regexp_extract_all({_column}, '{_re2.replace(chr(39), chr(39) * 2)}')))"
    query(f"extract_{_name}", f"SELECT {_key}, array_to_string({_found}, '|') AS found FROM {_table}")(
        lambda spark, d, t=_table, k=_key, c=_column, p=_java: read(spark, d, t).select(k, F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(c, F.lit(p), F.lit(0)))), "|").alias("found"))
    )


@query("extract_indicators")
def extract_indicators(spark, d):
    """Indicators of every document, typed; Java's look-around has no counterpart in DuckDB."""
    return read(spark, d, "documents").select("doc_id", F.explode(I.typed(I.extract_indicators(F.col("text")))).alias("x")).select("doc_id", "x.value", "x.type")


@query("alert_indicators", None)
def alert_indicators(spark, d):
    from watchglass.plans.triage import with_indicators

    return with_indicators(alerts_from_documents(read(spark, d, "documents"))).select("seq", F.array_join("iocs", "|").alias("iocs"))


URL_TYPE = "CASE WHEN regexp_full_match(url, '(?i)(?:https?|ftp)://[^\\s\"''<>()\\[\\]{}|\\\\^`]+') THEN 'url' ELSE 'unknown' END"
HOST = "regexp_extract(regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '^[^@]*@', ''), '^[^/?#:]*')"


@query("ioc_type_classify", f"SELECT page_id, {URL_TYPE} AS type, {HOST} AS host FROM pages")
def ioc_type_classify(spark, d):
    return read(spark, d, "pages").select("page_id", I.indicator_type(F.col("url")).alias("type"), I.host_of(F.col("url")).alias("host"))


@query("ioc_type_values", """SELECT v, CASE WHEN v LIKE 'T%' THEN 'mitre_technique' WHEN v LIKE 'CVE%' THEN 'cve' WHEN v LIKE 'HK%' THEN 'registry_key' WHEN v LIKE '%@%' THEN 'email' WHEN length(v) = 64 AND v <> repeat('0', 64) THEN 'hash_sha256'
 WHEN v = repeat('0', 64) THEN 'unknown' WHEN v LIKE '%.exe' THEN 'filename' WHEN v LIKE '%.com' THEN 'domain' WHEN v LIKE '10.%' THEN 'ip' ELSE 'unknown' END AS type FROM
 (SELECT unnest(['T1' || (100 + n_nationkey), 'CVE-2024-' || (10000 + n_nationkey), 'HKLM\\Software\\' || n_nationkey, 'a' || n_nationkey || '@b.com', sha256(n_nationkey::VARCHAR), repeat('0', 64), 'x' || n_nationkey || '.exe', 'd' || n_nationkey || '.com',
 '10.0.0.' || n_nationkey, 'plain' || n_nationkey]) AS v FROM nation)""".replace("\\\\", "\\"))
def ioc_type_values(spark, d):
    n = F.col("n_nationkey").cast("string")
    c = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    made = F.array(c("T1", (F.col("n_nationkey") + 100).cast("string")), c("CVE-2024-", (F.col("n_nationkey") + 10000).cast("string")), c("HKLM\\Software\\", n), c("a", n, "@b.com"), F.sha2(n, 256), F.lit("0" * 64), c("x", n, ".exe"), c("d", n, ".com"), c("10.0.0.", n), c("plain", n))
    return read(spark, d, "nation").select(F.explode(made).alias("v")).select("v", I.indicator_type(F.col("v")).alias("type"))


@query("metric_types", "SELECT t AS type, count(*) AS n FROM (SELECT CASE WHEN u LIKE '%://%' OR u LIKE 'http%' OR u LIKE 'ftp%' THEN 'url' WHEN u LIKE '%@%' THEN 'email' ELSE 'other' END AS t FROM (SELECT unnest([url, 'a@' || page_id]) AS u FROM pages)) GROUP BY t")
def metric_types(spark, d):
    value = F.explode(F.array("url", F.concat(F.lit("a@"), F.col("page_id").cast("string")))).alias("u")
    return read(spark, d, "pages").select(value).groupBy(I.metric_type(F.col("u")).alias("type")).agg(F.count("*").alias("n"))


@query("severity_hints", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'high' END AS hint FROM pages")
def severity_hints(spark, d):
    host = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".ngrok.io"))).otherwise(F.concat(F.lit("x"), F.col("page_id").cast("string"), F.lit(".example-site.com")))
    return read(spark, d, "pages").select("page_id", I.severity_hint(F.concat(F.lit("https://"), host, F.lit("/a"))).alias("hint"))


@query("refang_urls", "SELECT page_id, url AS clean FROM pages")
def refang_urls(spark, d):
    masked = F.regexp_replace(F.regexp_replace("url", "^http", "hxxp"), r"\.", "[.]")
    return read(spark, d, "pages").select("page_id", I.refang(masked).alias("clean"))


@query("top_categories", f"WITH {ALERTS} SELECT category, count(*) AS n FROM alerts GROUP BY category ORDER BY n DESC, min(seq) LIMIT 5")
def top_categories(spark, d):
    return metrics.top_categories(events(spark, d))


@query("metrics_overview", WITH + "SELECT count(*) AS cluster_count, sum(alert_count)::BIGINT AS alert_count, sum(alert_count) / count(*) AS avg_cluster_size FROM clusters")
def metrics_overview(spark, d):
    return metrics.overview(session_members(spark, d))


def by_user(spark, d):
    return events(spark, d).withColumn("cluster_id", F.col("user").cast("long")).withColumn("overflow", F.lit(False))


@query("dominant_category", f'WITH {ALERTS}, k AS (SELECT "user"::BIGINT AS cluster_id, category, count(*) AS n, min(seq) AS s FROM alerts GROUP BY ALL) SELECT cluster_id, arg_max(category, n * 1000000000 - s) AS top_category FROM k GROUP BY cluster_id')
def dominant_category(spark, d):
    return clustering._most(by_user(spark, d), F.col("category"), "top_category")


@query("common_severity", f'WITH {ALERTS}, k AS (SELECT "user"::BIGINT AS cluster_id, severity, count(*) AS n, min(seq) AS s FROM alerts GROUP BY ALL) SELECT cluster_id, arg_max(severity, n * 1000000000 - s) AS common_severity FROM k GROUP BY cluster_id')
def common_severity(spark, d):
    return summaries.common_severity(by_user(spark, d))


@query(
    "alert_type_breakdown",
    f"""WITH {ALERTS}, k AS (SELECT "user"::BIGINT AS cluster_id, title, count(*) AS n, max({POINTS}) AS p, arg_min(seq::VARCHAR, seq) AS first_id, min(seq) AS s FROM alerts GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY p DESC, s)::INTEGER AS rank FROM k)
SELECT cluster_id, title, n, CASE p WHEN 1 THEN 'INFO' WHEN 2 THEN 'LOW' WHEN 5 THEN 'MEDIUM' WHEN 10 THEN 'HIGH' ELSE 'CRITICAL' END AS severity, first_id, rank FROM r WHERE rank <= 3""",
)
def alert_type_breakdown(spark, d):
    return metrics.breakdown(by_user(spark, d), 3)


@query("max_clusters_other", WITH + ", t AS (SELECT cluster_id FROM groups ORDER BY raw_score DESC, cluster_id LIMIT 9), o AS (SELECT min(seq) AS other FROM members WHERE cluster_id NOT IN (SELECT cluster_id FROM t)) SELECT CASE WHEN cluster_id IN (SELECT cluster_id FROM t) THEN cluster_id ELSE other END AS cluster_id, count(*) AS n FROM members, o GROUP BY 1")
def max_clusters_other(spark, d):
    return clustering._limited(session_members(spark, d).drop("overflow"), 10).groupBy("cluster_id").agg(F.count("*").alias("n"))


@query("timeline_top10", f"""WITH {ALERTS}, r AS (SELECT "user"::BIGINT AS cluster_id, '[' || strftime(ts, '%Y-%m-%d %H:%M:%S UTC') || '] [' || severity || '] ' || title AS line, row_number() OVER (PARTITION BY "user" ORDER BY ts NULLS FIRST, seq) AS r, count(*) OVER (PARTITION BY "user") AS n FROM alerts)
SELECT cluster_id, string_agg(line, chr(10) ORDER BY r) FILTER (r <= 10) || CASE WHEN max(n) > 10 THEN chr(10) || '... and ' || (max(n) - 10) || ' more alert(s)' ELSE '' END AS timeline FROM r GROUP BY cluster_id""")
def timeline_top10(spark, d):
    return tickets.timelines(by_user(spark, d)).select("cluster_id", F.array_join("timeline", "\n").alias("timeline"))


@query("entropy_host", f"""WITH h AS (SELECT page_id, {HOST} AS host FROM pages), c AS (SELECT page_id, unnest(string_split(host, '')) AS ch, length(host) AS n FROM h), k AS (SELECT page_id, ch, count(*) / any_value(n) AS p FROM c GROUP BY page_id, ch)
SELECT page_id, round(-sum(p * log2(p)), 6) AS bits FROM k GROUP BY page_id""")
def entropy_host(spark, d):
    return read(spark, d, "pages").select("page_id", F.round(entropy(I.host_of(F.col("url"))), 6).alias("bits"))


@query("local_heuristics", """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'ip:ipv4|ip:private' WHEN page_id % 4 = 1 THEN 'hash:md5' WHEN page_id % 4 = 2 THEN 'domain:suspicious_tld:.xyz|domain:suspicious_keyword:login' ELSE '' END AS findings FROM pages""")
def local_heuristics(spark, d):
    n = F.col("page_id").cast("string")
    value = F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("10.0.0."), (F.col("page_id") % 200).cast("string"))).when(F.col("page_id") % 4 == 1, F.md5(n)).when(F.col("page_id") % 4 == 2, F.lit("login.aa.xyz")).otherwise(F.lit("a.com"))
    return read(spark, d, "pages").select("page_id", F.array_join(enrichment.findings(value), "|").alias("findings"))


@query("lookup_routes", "SELECT page_id, true AS url_analysis, true AS reputation, false AS email FROM pages")
def lookup_routes(spark, d):
    mail = F.concat(F.lit("a@b"), F.col("page_id").cast("string"), F.lit(".com"))
    return read(spark, d, "pages").select("page_id", enrichment.for_url_analysis(F.col("url")).alias("url_analysis"), enrichment.for_reputation(F.col("url")).alias("reputation"), enrichment.for_url_analysis(mail).alias("email"))


@query("redact_drop_iocs", f"""WITH {ALERTS} SELECT seq, '[REDACTED]' AS "user", dest_ip AS iocs FROM alerts""")
def redact_drop_iocs(spark, d):
    alerts = events(spark, d).withColumn("iocs", F.array("user", "source_ip", "dest_ip"))
    return redaction.redact(alerts, ["user", "source_ip"]).select("seq", "user", F.array_join("iocs", "|").alias("iocs"))


@query("stix_ids", f"""SELECT page_id, 'indicator--' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', ('0x' || substr(h, 17, 1))::INTEGER % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id
FROM (SELECT page_id, sha1(unhex('{stix.NAMESPACE.replace("-", "")}') || encode(url)) AS h FROM pages)""")
def stix_ids(spark, d):
    return read(spark, d, "pages").select("page_id", F.concat(F.lit("indicator--"), name_uuid(stix.NAMESPACE, F.col("url"))).alias("id"))


@query("stix_objects", None)
def stix_objects(spark, d):
    members = session_members(spark, d)
    clusters = clustering.summarize(members)
    return stix.objects(clusters, "2024-01-01T00:00:00.000Z", summaries.narratives(clusters, members)).select("id", "type")


@query("alert_csv", WITH + "SELECT seq::VARCHAR AS alert_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS alert_timestamp, severity AS alert_severity, title AS alert_title, members.category AS alert_category, '' AS alert_source_ip, '' AS alert_dest_ip, \"user\" AS alert_user, host AS alert_host, '' AS alert_iocs, '' AS alert_ioc_types, cluster_id::VARCHAR AS cluster_id, label AS cluster_label, priority AS cluster_priority, score AS cluster_score FROM members JOIN clusters USING (cluster_id)")
def alert_csv(spark, d):
    members = session_members(spark, d)
    return exports.alert_rows(members, clustering.summarize(members))


@query("cluster_csv", WITH + "SELECT cluster_id::VARCHAR AS cluster_id, label, priority, score, confidence, alert_count, 0::INTEGER AS ioc_count, '' AS technique_ids, strftime(first_seen, '%Y-%m-%dT%H:%M:%SZ') AS first_seen, strftime(last_seen, '%Y-%m-%dT%H:%M:%SZ') AS last_seen, reason AS cluster_reason FROM clusters")
def cluster_csv(spark, d):
    return exports.cluster_rows(session_clusters(spark, d))


@query("executive_summary", WITH + """SELECT 'Processed ' || (SELECT count(*) FROM alerts) || ' alert(s) (' || (SELECT count(*) FROM members) || ' after deduplication), grouped into ' || count(*) || ' cluster(s). ' ||
CASE WHEN count(*) FILTER (priority = 'CRITICAL') > 0 THEN count(*) FILTER (priority = 'CRITICAL') || ' cluster(s) require immediate attention.' ELSE 'No clusters require immediate attention.' END AS executive_summary,
coalesce(arg_max(priority, CASE priority WHEN 'NOISE' THEN 0 WHEN 'LOW' THEN 1 WHEN 'MEDIUM' THEN 2 WHEN 'HIGH' THEN 3 ELSE 4 END), 'NOISE') AS overall_priority FROM clusters""")
def executive_summary(spark, d):
    members = session_members(spark, d)
    return summaries.executive(events(spark, d), members, clustering.summarize(members))


@query("narratives", WITH + """, k AS (SELECT cluster_id, severity, count(*) AS n, min(seq) AS s FROM members GROUP BY ALL), c AS (SELECT cluster_id, arg_max(severity, n * 1000000000 - s) AS sev FROM k GROUP BY cluster_id)
SELECT cluster_id, alert_count || ' ' || sev || ' alert(s) grouped by ' || reason || '. No IOCs extracted. No ATT&CK mapping.' AS narrative, CASE priority WHEN 'CRITICAL' THEN 2 WHEN 'HIGH' THEN 2 ELSE 1 END::INTEGER AS n FROM clusters JOIN c USING (cluster_id) WHERE priority <> 'NOISE'""")
def narratives(spark, d):
    members = session_members(spark, d)
    return summaries.narratives(clustering.summarize(members), members).select("cluster_id", "narrative", F.size("recommendations").alias("n"))


@query("ticket_drafts", WITH + "SELECT cluster_id, priority FROM (SELECT cluster_id, CASE priority WHEN 'CRITICAL' THEN 'IMMEDIATE' WHEN 'HIGH' THEN 'WITHIN_1H' WHEN 'MEDIUM' THEN 'WITHIN_24H' ELSE 'MONITOR' END AS priority FROM clusters)")
def ticket_drafts(spark, d):
    members = session_members(spark, d)
    clusters = clustering.summarize(members)
    return tickets.drafts(clusters, members, summaries.narratives(clusters, members)).select("cluster_id", "priority")


@query("escapes", """SELECT region.r_regionkey, replace(replace(replace(replace('<a href="x">&' || r_name, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, '\\*' || r_name || '\\_\\|' AS md FROM region""")
def escapes(spark, d):
    return read(spark, d, "region").select("r_regionkey", escape_html(F.concat(F.lit('<a href="x">&'), "r_name")).alias("html"), escape_markdown(F.concat(F.lit("*"), "r_name", F.lit("_|"))).alias("md"))


@query("title_normalize", r"SELECT p_partkey, regexp_replace(trim(lower('  ' || p_name || chr(9) || '  ' || p_type)), '\s+', ' ', 'g') AS title FROM part")
def title_normalize(spark, d):
    return read(spark, d, "part").select("p_partkey", normal_title(F.concat(F.lit("  "), "p_name", F.lit("\t  "), "p_type")).alias("title"))


@query("injection_scan", None)
def injection_scan(spark, d):
    return injection.scan(alerts_from_documents(read(spark, d, "documents"))).select("seq", "field", "pattern_type", "severity")


@query("raw_strings", "SELECT event_id AS seq, event_type || chr(10) || 'v' || event_id || chr(10) || 'w\"' AS text FROM events")
def raw_strings(spark, d):
    rows = read(spark, d, "events")
    raw = F.to_json(F.struct(F.concat(F.lit("v"), F.col("event_id").cast("string")).alias("a"), F.struct(F.array(F.lit('w"')).alias("c"), F.lit(1).alias("n")).alias("b")))
    return rows.select(F.col("event_id").alias("seq"), I.collect_text(raw, F.col("event_type"), F.lit("")).alias("text"))


@query("merge_on_indicators", WITH + ", k AS (SELECT cluster_id, min(cluster_id) OVER (PARTITION BY category) AS merged_id FROM clusters) SELECT * FROM k")
def merge_on_indicators(spark, d):
    clusters = session_clusters(spark, d).withColumn("iocs", F.array("first_category"))
    return clustering.merge_on_indicators(clusters)


@query("first_indicators", WITH + ", r AS (SELECT category, cluster_id, score, raw_score, row_number() OVER (PARTITION BY category ORDER BY score DESC, raw_score DESC, cluster_id) AS r FROM clusters) SELECT category AS ioc, row_number() OVER (ORDER BY score DESC, raw_score DESC, cluster_id)::INTEGER AS place FROM r WHERE r = 1")
def first_indicators(spark, d):
    return enrichment.to_look_up(session_clusters(spark, d).withColumn("iocs", F.array("first_category")))


@query("full_triage", None)
def full_triage(spark, d):
    """Dedup, extraction, graph clustering and scoring of all events."""
    return triage(events(spark, d), Settings()).clusters.select("cluster_id", "label", "alert_count", "score", "priority")


__all__ = ["QUERIES", "SQL"]
