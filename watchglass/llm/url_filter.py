"""URL filtering by host-suffix and path-prefix rules, found through short hash prefixes.

A URL is expanded into the expressions that a rule fitting it could have: each suffix of its host with as many labels
as some rule has at most, followed by each prefix of its path as long as some rule's path. Expressions and rules meet
in an equi-join on the first 32 bits of their SHA-256; the full digest then confirms, and the longest rule wins.
Every distinct URL is judged once; the number of expressions depends on the rules' shapes, not on the URL's length.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.llm.common import table

#: (verdict, host, path).
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)
#: The verdict on a URL that no rule fits.
DEFAULT = "allow"
PREFIX_HEX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.coalesce(F.when(at > 0, F.substring(url, at + 3, F.length(url))), F.lit(""))


def _raw_host(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*", 0)


def host_of(url: Column) -> Column:
    """What is between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(_raw_host(url), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to a ``?`` or ``#``; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def expressions(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """Host suffixes of at most ``labels`` labels, each with the path's prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda n: F.array_join(F.slice(parts, -n, n), "."))
    prefixes = F.filter(F.array([F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda p: p.isNotNull())
    return F.array_distinct(F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p)))))


def rule_table(spark: SparkSession, rules: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rules with their digests. Of equal rules, block is kept."""
    for verdict, _, path in rules:
        if verdict not in ("allow", "block") or not (path == "" or path.startswith("/")):
            raise ValueError(f"not a rule: {verdict} with path {path!r}")
    given = spark.createDataFrame([(v, h, p) for v, h, p in rules], "verdict string, rule_host string, rule_path string")
    text = F.concat(F.translate("rule_host", UPPER, LOWER), F.col("rule_path"))
    once = given.withColumn("rule", text).groupBy("rule").agg(F.max("verdict").alias("verdict"), F.max(F.length("rule_host")).alias("host_length"))
    digest = F.sha2("rule", 256)
    return once.withColumn("rule_digest", digest).withColumn("prefix", F.substring(digest, 1, PREFIX_HEX))


def judge(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, default: str = DEFAULT) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``.

    A rule fits its host and all subdomains where the path starts with the rule's; the longest rule wins, of equally
    long ones that with the longer host. A null URL, or one without ``://``, has empty host and path. Repeated rows
    each give a row; an empty table gives none. Other columns of ``pages`` are not read.
    """
    spark = pages.sparkSession
    slim = pages.select("page_id", F.col("url").cast("string").alias("url"))
    matches = None
    if rules:
        labels = max(h.count(".") + 1 for _, h, _ in rules)
        lengths = sorted({len(p) for _, _, p in rules})
        urls = slim.select("url").filter(F.col("url").isNotNull()).distinct()
        spread = urls.select("url", F.explode(expressions(host_of(F.col("url")), path_of(F.col("url")), labels, lengths)).alias("expression"))
        spread = spread.withColumn("digest", F.sha2("expression", 256)).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
        # Catalyst broadcasts the rules if they are under its size limit and sorts and merges otherwise.
        met = spread.join(rule_table(spark, rules), "prefix").filter(F.col("digest") == F.col("rule_digest"))
        best = F.max_by(F.struct("rule", "verdict"), F.struct(F.length("rule"), "host_length"))
        matches = met.groupBy("url").agg(best.alias("best"))
    joined = slim.join(matches, "url", "left") if matches is not None else slim.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    return joined.select(
        "page_id",
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("best.rule").alias("rule"),
        F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


SQL = r"""
WITH rules(action, h, p) AS (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
                                    ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')),
cut AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest, row_number() OVER () AS n FROM pages),
parts AS (SELECT page_id, n, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                 regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut),
fit AS (SELECT n, action, h || p AS rule, row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, length(h) DESC) AS r
        FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p))
SELECT page_id, host, path, rule, coalesce(action, 'allow') AS verdict
FROM parts LEFT JOIN (SELECT * FROM fit WHERE r = 1) best USING (n)
"""
