"""STIX 2.1 objects of clusters."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchglass.functions.indicators import encoded_stub
from watchglass.functions.text import escape_stix, name_uuid

NAMESPACE = str(uuid.uuid5(uuid.NAMESPACE_DNS, "watchglass.invalid"))

# What a type of indicator is compared with in a pattern.
PATHS = {
    "hash_sha256": "file:hashes.'SHA-256'",
    "hash_sha1": "file:hashes.'SHA-1'",
    "hash_md5": "file:hashes.MD5",
    "hash_sha512": "file:hashes.'SHA-512'",
    "ssdeep": "file:hashes.ssdeep",
    "tlsh": "file:hashes.TLSH",
    "jarm": "network-traffic:extensions.'tls-ext'.ja3_hash",
    "cve": "vulnerability:name",
    "mitre_technique": "attack-pattern:name",
    "registry_key": "windows-registry-key:key",
    "filename": "file:name",
    "domain": "domain-name:value",
    "url": "url:value",
    "email": "email-addr:value",
}


def pattern(value: Column, kind: Column) -> Column:
    """The pattern that finds an indicator; an encoded payload is replaced by its stub."""
    path = F.when(kind == "ip", F.when(value.contains(":"), "ipv6-addr:value").otherwise("ipv4-addr:value"))
    for name, where in PATHS.items():
        path = path.when(kind == name, where)
    return F.concat(F.lit("["), path.otherwise("artifact:payload_bin"), F.lit(" = '"), escape_stix(encoded_stub(value, "b")), F.lit("']"))


def _id(kind: str, *parts: Column) -> Column:
    return F.concat(F.lit(f"{kind}--"), name_uuid(NAMESPACE, F.concat_ws(":", *parts)))


def objects(clusters: DataFrame, now: str, narratives: DataFrame | None = None) -> DataFrame:
    """(id, type, json): groupings, indicators, notes and relationships, each id once."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    given = clusters.withColumn("grouping_id", _id("grouping", F.col("cluster_id").cast("string")))
    each = given.select("grouping_id", F.explode("iocs_typed").alias("x")).select("grouping_id", "x.value", "x.type")
    indicator = _id("indicator", F.col("grouping_id"), F.col("value"))
    common = lambda kind, ident: [F.lit(kind).alias("type"), F.lit("2.1").alias("spec_version"), ident.alias("id"), F.lit(now).alias("created"), F.lit(now).alias("modified")]

    def made(rows: DataFrame, kind: str, ident: Column, *fields: Column) -> DataFrame:
        return rows.select(ident.alias("id"), F.lit(kind).alias("type"), F.to_json(F.struct(*common(kind, ident), *fields)).alias("json"))

    refs = F.transform("iocs", lambda v: _id("indicator", F.col("grouping_id"), v))
    about = text("Alert cluster: ", F.col("label"), ". Priority: ", F.col("priority"))
    out = made(given, "grouping", F.col("grouping_id"), F.col("label").alias("name"), about.alias("description"), F.lower("priority").alias("context"), refs.alias("object_refs"))
    name = text("IOC: ", encoded_stub(F.col("value"), "b"))
    out = out.unionByName(
        made(each, "indicator", indicator, name.alias("name"), F.lit("Indicator detected in cluster alerts").alias("description"), pattern(F.col("value"), F.col("type")).alias("pattern"),
             F.lit("stix").alias("pattern_type"), F.lit(now).alias("valid_from"), F.array(F.lit("malicious-activity")).alias("labels"))
    )
    confidence = F.concat(F.round(F.col("confidence") * 100, 1).cast("decimal(5,1)").cast("string"), F.lit("%"))
    content = text("Cluster: ", F.col("label"), "\nPriority: ", F.col("priority"), "\nAlerts: ", F.col("alert_count"), "\nIOCs: ", F.col("ioc_count"), "\nConfidence: ", confidence, "\nReason: ", F.col("cluster_reason"))
    out = out.unionByName(made(given, "note", _id("note", F.col("grouping_id"), F.lit("summary")), F.lit("Cluster Summary").alias("abstract"), content.alias("content"), F.array("grouping_id").alias("object_refs")))
    if narratives is not None:
        told = given.join(narratives.select("cluster_id", "narrative"), "cluster_id")
        out = out.unionByName(made(told, "note", _id("note", F.col("grouping_id"), F.lit("narrative")), F.lit("Analysis Narrative").alias("abstract"), F.col("narrative").alias("content"), F.array("grouping_id").alias("object_refs")))
    relation = _id("relationship", F.col("grouping_id"), F.lit("aggregates"), indicator)
    out = out.unionByName(made(each, "relationship", relation, F.lit("aggregates").alias("relationship_type"), F.col("grouping_id").alias("source_ref"), indicator.alias("target_ref")))
    return out.dropDuplicates(["id"])


def bundle(rows: DataFrame) -> str:
    """The objects as one bundle, gathered on the driver: for reports that are to be one file."""
    lines = [r["json"] for r in rows.orderBy("type", "id").select("json").toLocalIterator()]
    return f'{{"type": "bundle", "id": "bundle--{uuid.uuid4()}", "objects": [{", ".join(lines)}]}}'
