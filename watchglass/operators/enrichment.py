"""What can be said about an indicator without asking anyone, and whom one could ask."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchglass.functions import patterns as P
from watchglass.functions.indicators import cache_key, is_ip, is_ipv4, is_ipv6, top_level, within_nets
from watchglass.functions.text import entropy

# The address ranges that count as private, loopback and multicast.
PRIVATE = ("0.0.0.0/8", "10.0.0.0/8", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/29", "192.0.0.170/31", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4")
LOOPBACK, MULTICAST = ("127.0.0.0/8",), ("224.0.0.0/4",)
MOST_LOOKED_UP = 20


def _host(value: Column) -> Column:
    bare = F.regexp_replace(F.lower(value), r"^h(?:tt|xx)ps?://", "")
    return F.regexp_extract(bare, r"^[^/?#:]*", 0)


def findings(value: Column) -> Column:
    """Labels of what stands out in an indicator; of several TLDs or words, the first of the lists."""
    digest = F.when(value.rlike("^[0-9a-fA-F]{32}$"), "hash:md5").when(value.rlike("^[0-9a-fA-F]{40}$"), "hash:sha1").when(value.rlike("^[0-9a-fA-F]{64}$"), "hash:sha256")
    host = _host(value)
    tld = word = F.lit(None).cast("string")
    for t in reversed(P.SUSPICIOUS_TLDS):
        tld = F.when(F.endswith(host, F.lit(t)), f"domain:suspicious_tld:{t}").otherwise(tld)
    for w in reversed(P.SUSPICIOUS_WORDS):
        word = F.when(host.contains(w), f"domain:suspicious_keyword:{w}").otherwise(word)
    label = F.regexp_replace(F.regexp_replace(host, r"^www\.", ""), r"\.[^.]*$", "")
    six = value.rlike(r"^(?:fc|fd)|^::1?$|^fe[89ab]") & is_ipv6(value)
    others = F.array(
        F.when(is_ipv4(value), "ip:ipv4").when(is_ipv6(value), "ip:ipv6"),
        F.when(within_nets(value, PRIVATE) | six, "ip:private"),
        F.when(within_nets(value, LOOPBACK) | (value == "::1"), "ip:loopback"),
        F.when(within_nets(value, MULTICAST) | (F.lower(value).rlike("^ff") & is_ipv6(value)), "ip:multicast"),
        F.when(F.lower(value).rlike(r"^https?://(?:\d{1,3}\.){3}\d{1,3}"), "url:ip_in_url"),
        tld,
        word,
        F.when(entropy(label) > P.HIGH_ENTROPY, "domain:high_entropy"),
    )
    return F.when(digest.isNotNull(), F.array(digest)).otherwise(F.filter(others, lambda x: x.isNotNull()))


def _no_lookup(value: Column) -> Column:
    upper = F.upper(value)
    return (
        F.startswith(upper, F.lit("CVE-"))
        | value.rlike(r"^T\d{4}(?:\.\d{3})?$")
        | upper.rlike(r"^(?:HK(?:LM|CU|CR|U|CC)\\|HKEY_)")
        | F.startswith(value, F.lit(P.ENCODED_PREFIX))
        | value.rlike(r"^\d+:[^:]{3,}:[^:]{3,}$")
        | value.rlike(r"^[Tt]1(?:[0-9A-Fa-f]{68}|[0-9A-Fa-f]{70})$")
    )


# Suffixes of files, which a URL analyser doesn't take for domains.
NOT_DOMAINS = (
    "exe", "dll", "sys", "ps1", "bat", "cmd", "vbs", "js", "log", "ldb", "sst", "tmp", "mca", "inf", "msi", "jar", "zip", "rar", "7z", "tar", "gz", "iso", "img", "py", "sh", "rb",
    "pl", "php",
)


def _filename(value: Column) -> Column:
    return F.lower(F.substring_index(value, ".", -1)).isin(*NOT_DOMAINS) & value.contains(".")


def for_url_analysis(value: Column) -> Column:
    """Whether a URL analyser takes an indicator: URLs, and domains that are routable."""
    v = F.trim(value)
    web = F.lower(v).rlike(r"^(?:https?|ftp|hxxps?)://")
    domain = v.contains(".") & ~v.contains(" ") & ~v.contains("@") & ~is_ip(F.substring_index(v, "/", 1)) & ~_filename(v) & ~top_level(v).isin(*P.INTERNAL_TLDS)
    return ~_no_lookup(v) & ~F.startswith(v, F.lit("[")) & (web | domain)


def for_reputation(value: Column) -> Column:
    """Whether a reputation service takes an indicator: public addresses, hashes, URLs and domains."""
    v = F.trim(value)
    public = is_ip(v) & ~within_nets(v, PRIVATE) & ~v.rlike(r"(?i)^(?:::1?|fe[89ab].*|2001:0?db8:.*)$")
    digest = v.rlike("^(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64})$")
    return ~_no_lookup(v) & (digest | public | (for_url_analysis(v) & ~is_ip(v)))


def to_look_up(clusters: DataFrame, most: int = MOST_LOOKED_UP) -> DataFrame:
    """(ioc, place): the first different indicators over clusters in their order, as lookups know them."""
    rows = clusters.select("cluster_id", "score", "raw_score", F.posexplode("iocs").alias("p", "v"))
    once = rows.groupBy(cache_key(F.col("v")).alias("ioc")).agg(F.min(F.struct((-F.col("score")).alias("s"), (-F.col("raw_score")).alias("r"), "cluster_id", "p")).alias("first"))
    return once.orderBy("first").limit(most).withColumn("place", F.row_number().over(Window.orderBy("first"))).select("ioc", "place")


def local_analysis(values: DataFrame) -> DataFrame:
    """(ioc, source, findings) of each row's indicator."""
    return values.select("ioc", F.lit("local_heuristics").alias("source"), findings(F.col("ioc")).alias("findings"))


def command(*argv: str, seconds: float = 15) -> Callable[[str], dict]:
    """A lookup that runs a program with the indicator as its last argument and reads JSON from its output."""

    def look_up(value: str) -> dict:
        done = subprocess.run([*argv, value], capture_output=True, text=True, timeout=seconds, check=True)  # noqa: S603
        return json.loads(done.stdout)

    return look_up


#: A name, a condition on the indicator column, and what looks one indicator up.
Lookup = tuple[str, Callable[[Column], Column], Callable[[str], dict]]


def run(clusters: DataFrame, lookups: Sequence[Lookup], consent: bool = False, most: int = MOST_LOOKED_UP, threads: int = 4) -> list[dict]:
    """What lookups say of the first indicators: rows with ioc, source and result or error.

    Each lookup gets the indicators that its condition takes, ``most`` in all. Indicators leave the machine only with
    ``consent``; without it, only the local analysis is given. A lookup that fails gives its error and stops no other.
    """
    chosen = to_look_up(clusters, most)
    local = local_analysis(chosen).orderBy("ioc").collect()  # ``most`` rows
    out = [{"ioc": r["ioc"], "source": r["source"], "result": {"findings": r["findings"]}} for r in local]
    if not consent or not lookups:
        return out
    taken = chosen.select("ioc", "place", *[condition(F.col("ioc")).alias(f"l{i}") for i, (_, condition, _) in enumerate(lookups)]).orderBy("place").collect()
    tasks = [(r["ioc"], name, look_up) for r in taken for i, (name, _, look_up) in enumerate(lookups) if r[f"l{i}"]]

    def one(task: tuple[str, str, Callable[[str], dict]]) -> dict:
        ioc, name, look_up = task
        try:
            return {"ioc": ioc, "source": name, "result": look_up(ioc)}
        except Exception as e:  # noqa: BLE001
            return {"ioc": ioc, "source": name, "error": f"{type(e).__name__}: {e}"}

    with ThreadPoolExecutor(threads) as pool:
        return [*out, *pool.map(one, tasks)]
