"""Alert files of several formats as canonical alerts: JSON, NDJSON, SIEM exports and CSV.

Files are read by Spark, so folders, wildcards and any file system it knows will do. Each file's format is told by its
own head, and each file's CSV header is its own. A record becomes a map of its keys to JSON values; alias lists then
choose fields from it. Only whole-file JSON is read a file at a time.

Alerts are numbered over all files: by the files' paths, then by the place in the file.
"""

from __future__ import annotations

import csv
import io
import json
import os
import sys
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchglass.functions.text import filled
from watchglass.plans.schema import FIELDS, severity_of

# The names under which fields are found, in this order.
ALIASES = {
    "id": ["id", "alert_id", "event_id", "uid", "_id"],
    "timestamp": ["timestamp", "time", "event_time", "created_at", "@timestamp", "date"],
    "severity": ["severity", "priority", "level", "risk_level", "alert_level"],
    "title": ["title", "name", "alert_name", "message", "msg", "description", "event_name", "label"],
    "source": ["source", "sensor", "detector", "product", "vendor", "parentimage"],
    "source_ip": ["source_ip", "src_ip", "src", "sourceAddress", "source_address", "attacker_ip", "source ip", "src ip"],
    "dest_ip": ["dest_ip", "dst_ip", "dst", "destAddress", "destination_ip", "target_ip", "destination ip", "dest ip", "dst ip"],
    "user": ["user", "username", "user_name", "account", "actor"],
    "host": ["host", "hostname", "computer", "device", "endpoint", "machine", "image"],
    "category": ["category", "type", "alert_type", "event_type", "classification", "label", "eventid"],
    "description": ["description", "details", "message", "msg", "summary", "commandline"],
}
SIEM = {
    "id": ["event_id", "orig_event_id", "_cd"],
    "title": ["rule_name", "rule_title", "search_name", "source"],
    "severity": ["urgency", "severity", "info.severity"],
    "timestamp": ["_time", "timestamp", "event_time"],
    "description": ["description", "rule_description", "_raw"],
    "source": ["source", "sourcetype"],
    "source_ip": ["src", "src_ip", "source_ip"],
    "dest_ip": ["dest", "dest_ip", "destination_ip"],
    "user": ["user", "src_user"],
    "host": ["host", "dest_host"],
    "category": ["category", "type", "tag"],
}
SIEM_MARKS = ("_time", "urgency", "rule_name", "event_id")
SUFFIXES = (".json", ".csv", ".ndjson", ".jsonl", ".log")
MAP = "map<string,string>"
RECORDS = "source_file string, block long, at long, siem boolean, csv boolean, fields map<string,string>, raw string"
#: Larger files are told by their suffix or first lines, and never read as one text.
WHOLE_BYTES = 64 << 20
STDIN = "<stdin>"


class Normalizer(Protocol):
    """Reads files of a further format: ``read`` gives records (RECORDS) of files whose heads it can handle."""

    name: str

    def can_handle(self, head: str) -> bool: ...

    def read(self, spark: SparkSession, paths: list[str]) -> DataFrame: ...


def first_present(record: Column, names: Sequence[str]) -> Column:
    """Value under the first name that the record has, even if it is null or empty there."""
    out = None
    for name in names:
        has, value = F.map_contains_key(record, name), F.try_element_at(record, F.lit(name))
        out = F.when(has, value) if out is None else out.when(has, value)
    return out


def first_filled(record: Column, names: Sequence[str]) -> Column:
    """Value under the first name that has one that is not empty."""
    return F.coalesce(*[_truthy(F.try_element_at(record, F.lit(n))) for n in names])


def _truthy(value: Column) -> Column:
    """Null for what counts as missing: empty text, zero, false, empty lists and objects."""
    return F.when(~value.isin("", "0", "0.0", "false", "[]", "{}"), value)


def parse_time(value: Column) -> Column:
    """Seconds since 1970, or one of the accepted forms of date and time, without a zone in UTC; else null."""
    number = F.when(value.rlike(r"^-?\d+(?:\.\d+)?$") & ~value.rlike(r"^\d{8}$"), value.try_cast("double"))
    iso = value.rlike(r"^\d{4}-\d{2}-\d{2}(?:[T ]\d{2}(?::?\d{2}(?::?\d{2}(?:[.,]\d{1,9})?)?)?(?:Z|[+-]\d{2}:?\d{2})?)?$")
    return F.coalesce(F.timestamp_seconds(number), F.when(iso, value.try_cast("timestamp")))


def normalize(records: DataFrame, siem: bool = False, lowered: bool = False) -> DataFrame:
    """Alerts from records: seq, source_file, fields (a map) and raw (JSON).

    Ids that are missing are made from the file and the place in it, so that a run repeated gives the same ones.
    """
    m, aliases = F.col("fields"), SIEM if siem else ALIASES
    pick = first_filled if siem else first_present
    names = {k: [*dict.fromkeys([*v, *(x.lower() for x in v if lowered)])] for k, v in aliases.items()}
    get = {k: pick(m, v) for k, v in names.items()}
    title = F.coalesce(_truthy(get["title"]), F.lit("SIEM Alert" if siem else "Unknown Alert"))
    optional = lambda k: _truthy(get[k])
    made = F.sha2(F.concat_ws("\0", F.coalesce("source_file", F.lit("")), F.col("seq").cast("string")), 256)
    out = records.select(
        "seq",
        "source_file",
        F.coalesce(_truthy(get["id"]), made).alias("id"),
        parse_time(get["timestamp"]).alias("timestamp"),
        severity_of(get["severity"]).alias("severity"),
        title.alias("title"),
        F.when(F.lit(siem) | (_truthy(get["description"]) != title), _truthy(get["description"])).alias("description"),
        *[optional(k).alias(k) for k in ("source", "source_ip", "dest_ip", "user", "host", "category")],
        F.array().cast("array<string>").alias("iocs"),
        F.array().cast("array<string>").alias("technique_ids"),
        F.col("raw"),
    )
    return out.select(*FIELDS)


def _as_map(value: Column) -> Column:
    return F.from_json(value, MAP)


def _from_texts(files: DataFrame) -> DataFrame:
    """Records of whole texts (source_file, value): an array, one object, or ``{"results": [...]}``; others give none."""
    text = F.regexp_replace("value", r"(?U)^[\s\x{FEFF}]+|\s+$", "")
    files = files.select("source_file", text.alias("t"))
    wrapped = F.when(F.startswith("t", F.lit("[")), F.col("t")).when(F.get_json_object("t", "$.results").isNotNull(), F.get_json_object("t", "$.results")).otherwise(F.concat(F.lit("["), F.col("t"), F.lit("]")))
    items = files.select("source_file", F.get_json_object("t", "$.results").isNotNull().alias("siem"), F.posexplode(F.from_json(wrapped, "array<string>")).alias("at", "raw"))
    objects = items.filter(F.startswith("raw", F.lit("{")))
    return objects.select("source_file", F.lit(0).cast("long").alias("block"), F.col("at").cast("long"), "siem", F.lit(False).alias("csv"), _as_map(F.col("raw")).alias("fields"), "raw")


def read_json(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of whole-file JSON."""
    return _from_texts(spark.read.text(paths, wholetext=True, recursiveFileLookup=True).select(F.col("_metadata.file_path").alias("source_file"), "value"))


def _from_lines(lines: DataFrame) -> DataFrame:
    """Records of JSON lines (source_file, block, at, value); lines that are no objects are left out."""
    whole = lines.withColumn("raw", F.trim("value")).filter(F.startswith("raw", F.lit("{"))).withColumn("fields", _as_map(F.col("raw")))
    known = whole.filter(F.col("fields").isNotNull() & (F.size("fields") > 0))
    return known.select("source_file", "block", "at", F.exists(F.map_keys("fields"), lambda k: k.isin(*SIEM_MARKS)).alias("siem"), F.lit(False).alias("csv"), "fields", "raw")


def _places() -> list[Column]:
    """A row's file, the split of it and a number that rises in the split."""
    return [F.col("_metadata.file_path").alias("source_file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at")]


def read_ndjson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of JSON lines."""
    return _from_lines(spark.read.text(paths, recursiveFileLookup=True).select(*_places(), "value"))


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Records of CSV files of one header, of two columns or more; names are matched in lower case."""
    table = spark.read.csv(paths, header=True, multiLine=True, escape='"', mode="PERMISSIVE", inferSchema=False, recursiveFileLookup=True)
    names = table.columns
    if len(names) < 2:
        return spark.createDataFrame([], RECORDS)
    quoted = {n: F.coalesce(F.col("`" + n.replace("`", "``") + "`"), F.lit("")) for n in names}
    raw = F.to_json(F.struct(*[v.alias(n) for n, v in quoted.items()]))
    last = {n.lower().strip(): v for n, v in quoted.items()}  # of names alike the last one holds
    fields = F.map_from_arrays(F.array(*[F.lit(n) for n in last]), F.array(*last.values()))
    return table.select(*_places(), F.lit(False).alias("siem"), F.lit(True).alias("csv"), fields.alias("fields"), raw.alias("raw"))


def read_text(spark: SparkSession, text: str, source: str = STDIN) -> DataFrame:
    """Records of one text that the driver holds, such as standard input."""
    kind = kind_of(text)
    if kind == "csv":
        rows = list(csv.reader(io.StringIO(text)))
        header = rows[0] if rows else []
        if len(header) < 2:
            return spark.createDataFrame([], RECORDS)
        padded = ([*r, *[""] * len(header)][: len(header)] for r in rows[1:] if r)
        made = [(source, 0, i, False, True, {n.lower().strip(): v for n, v in zip(header, r, strict=True)}, json.dumps(dict(zip(header, r, strict=True)))) for i, r in enumerate(padded)]
        return spark.createDataFrame(made, RECORDS)
    if kind == "ndjson":
        lines = [(source, 0, i, x) for i, x in enumerate(text.splitlines())]
        return _from_lines(spark.createDataFrame(lines, "source_file string, block long, at long, value string"))
    return _from_texts(spark.createDataFrame([(source, text)], "source_file string, value string"))


def kind_of(head: str) -> str:
    """``json``, ``ndjson`` or ``csv``, from the beginning of a file, or ``""`` if that is blank."""
    lines = [x.strip() for x in head.lstrip("\ufeff").splitlines() if x.strip()]
    if not lines:
        return ""
    if lines[0].startswith("{") and lines[0].endswith("}") and len(lines) > 1:
        return "ndjson"
    return "json" if lines[0][0] in "[{" else "csv"


def files_of(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, int]]:
    """Files (path, bytes) at the paths, sorted: of folders those of a known suffix, in any depth; files as they are."""
    found: dict[str, int] = {}
    for path in paths:
        listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length").collect()
        alone = len(listed) == 1 and os.path.basename(listed[0]["path"]) == os.path.basename(path.rstrip("/"))
        found |= {r["path"]: r["length"] for r in listed if alone or r["path"].lower().endswith(SUFFIXES)}
    return sorted((p, n) for p, n in found.items() if n)


def heads(spark: SparkSession, files: Sequence[tuple[str, int]], chars: int = 4000) -> dict[str, str]:
    """The beginning of each file. Small ones are read in one job; of each larger one the first lines."""
    short = [p for p, n in files if n <= WHOLE_BYTES]
    out: dict[str, str] = {}
    if short:
        texts = spark.read.text(short, wholetext=True).select(F.col("_metadata.file_path").alias("p"), F.substring(F.regexp_replace("value", r"(?U)^[\s\x{FEFF}]+", ""), 1, chars).alias("h"))
        out = {r["p"]: r["h"] for r in texts.collect()}

    def first(path: str) -> str:
        return "\n".join(r["value"] for r in spark.read.text(path).limit(5).collect())[:chars]

    with ThreadPoolExecutor(16) as pool:
        long = [p for p, n in files if n > WHOLE_BYTES]
        out |= dict(zip(long, pool.map(first, long), strict=True))
    return out


def _same(path: str) -> str:
    """A path as the listing and the reader both give it."""
    from urllib.parse import unquote

    scheme, _, rest = unquote(path).rpartition(":")
    return (scheme + ":" if scheme not in ("", "file") else "") + "/" + rest.lstrip("/")


def records_of(spark: SparkSession, paths: Sequence[str], kind: str | None = None, normalizers: Sequence[Normalizer] = ()) -> DataFrame:
    """Records of the files at the paths (``-``: standard input), each by its own format unless ``kind`` is given."""
    parts, named = [], [p for p in paths if p != "-"]
    if "-" in paths:
        parts.append(read_text(spark, sys.stdin.read()))
    files = files_of(spark, named) if named else []
    known = {_same(p): h for p, h in heads(spark, files).items()} if files else {}
    groups: dict[tuple[str, str], list[str]] = {}
    for path, size in files:
        head = known.get(_same(path), "")
        other = next((n.name for n in normalizers if n.can_handle(head)), None)
        told = other or kind or kind_of(head)
        if told == "json" and size > WHOLE_BYTES:
            told = "ndjson"  # too large for one text: objects that have a line each are read
        if told:
            header = head.splitlines()[0].strip() if told == "csv" else ""
            groups.setdefault((told, header), []).append(path)
    readers = {"json": read_json, "ndjson": read_ndjson, "csv": read_csv} | {n.name: n.read for n in normalizers}
    parts += [readers[told](spark, group) for (told, _), group in sorted(groups.items())]
    out = parts[0] if parts else spark.createDataFrame([], RECORDS)
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def numbered(records: DataFrame) -> DataFrame:
    """Records with ``seq``: a number over all files, by path and place. Splits are counted, then each gets its first number."""
    splits = records.groupBy("source_file", "block").agg(F.min("at").alias("low"), F.max("at").alias("high"))
    before = Window.orderBy("source_file", "block").rowsBetween(Window.unboundedPreceding, -1)  # a row for each split
    starts = splits.withColumn("start", F.coalesce(F.sum(F.col("high") - F.col("low") + 1).over(before), F.lit(0))).drop("high")
    return records.join(starts, ["source_file", "block"]).withColumn("seq", F.col("start") + F.col("at") - F.col("low")).drop("start", "low", "block", "at")


def read_alerts(spark: SparkSession, path: str | Sequence[str], kind: str | None = None, drop_raw: bool = False, normalizers: Sequence[Normalizer] = ()) -> DataFrame:
    """Alerts of the files at one path or several, without phantom rows; formats are told by each file unless given."""
    records = numbered(records_of(spark, [path] if isinstance(path, str) else list(path), kind, normalizers))
    alerts = normalize(records.filter("csv"), lowered=True).unionByName(normalize(records.filter("not csv and not siem"))).unionByName(normalize(records.filter("not csv and siem"), siem=True))
    alerts = drop_phantoms(alerts)
    return alerts.withColumn("raw", F.lit(None).cast("string")) if drop_raw else alerts


def drop_phantoms(alerts: DataFrame) -> DataFrame:
    """Without rows that have no title and no other evidence."""
    nothing = F.coalesce(filled(F.col("title")), F.lit("Unknown Alert")) == "Unknown Alert"
    for name in ("timestamp", "description", "source", "source_ip", "dest_ip", "user", "host", "category"):
        nothing = nothing & (F.col(name).isNull() if name == "timestamp" else filled(F.col(name)).isNull())
    return alerts.filter(~nothing)


__all__ = ["ALIASES", "SIEM", "Normalizer", "drop_phantoms", "files_of", "first_filled", "first_present", "kind_of", "normalize", "numbered", "parse_time", "read_alerts", "read_csv", "read_json", "read_ndjson", "read_text", "records_of"]
