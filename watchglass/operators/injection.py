"""Text in alerts that tries to instruct a language model."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: (kind, severity, pattern). Encoded text is no sign in an indicator.
KINDS = (
    ("instruction_override", "high", r"(?i)\b(?:ignore|disregard|forget)\s+(?:all\s+|any\s+|the\s+)*(?:previous|prior|preceding|above|earlier)\b"),
    ("output_manipulation", "high", r"(?i)\binstead\s+(?:output|print|return|reply|respond)\b|\b(?:output|return|respond|reply)\s+instead\b"),
    ("jailbreak", "high", r"(?i)\bact\s+as\s+(?:an?\s+)?(?:unrestricted|unfiltered|uncensored)\b|\byou\s+are\s+now\s+(?:dan|an?\s+unrestricted)\b"),
    ("prompt_exfiltration", "high", r"(?i)\b(?:print|reveal|show|repeat|output)\b[^.\n]{0,40}\bsystem\s+prompt\b"),
    ("json_escape_sequence", "medium", r"\\(?:[\"nrt]|u[0-9a-fA-F]{4})"),
    ("encoded_payload", "medium", r"(?<![A-Za-z0-9+/=])(?=[A-Za-z0-9+/]*[A-Z])(?=[A-Za-z0-9+/]*[a-z])(?=[A-Za-z0-9+/]*[0-9])[A-Za-z0-9+/]{28,}={0,2}(?![A-Za-z0-9+/=])"),
    ("shell_injection", "high", r"\$\([^)]*\)|`[^`]+`|\$[A-Z_]{2,}\b"),
)
FIELDS = ("title", "description", "category", "source", "user", "host")
MARK = "[REDACTED:INJECTION]"


BEYOND_ASCII = r"[^\x00-\x7F]"


@F.arrow_udf(T.StringType())
def _nfkc(texts: pa.Array) -> pa.Array:
    return pc.utf8_normalize(texts, form="NFKC")


@F.arrow_udf(T.ArrayType(T.StringType()))
def _nfkc_each(lists: pa.Array) -> pa.Array:
    return pa.array([None if values is None else pc.utf8_normalize(pa.array(values, pa.string()), form="NFKC").to_pylist() for values in lists.to_pylist()], pa.list_(pa.string()))


def normal(text: Column) -> Column:
    """A text in the form NFKC, which folds full width and other compatible characters; Python sees only non-ASCII ones."""
    return F.coalesce(_nfkc(F.when(text.rlike(BEYOND_ASCII), text)), text)


def normal_each(texts: Column) -> Column:
    return F.coalesce(_nfkc_each(F.when(F.exists(texts, lambda v: v.rlike(BEYOND_ASCII)), texts)), texts)


def kinds(text: Column, of_indicator: bool = False) -> Column:
    """Kinds found in a text of form NFKC, in the order of the list."""
    return F.filter(F.array(*[F.when(text.rlike(p), k) for k, _, p in KINDS if not (of_indicator and k == "encoded_payload")]), lambda k: k.isNotNull())


def scan(alerts: DataFrame, allowed: str | None = None) -> DataFrame:
    """(seq, field, pattern_type, severity, value_preview): what is found in fields, raw strings and indicators.

    A value that the pattern ``allowed`` matches is passed over.
    """
    pair = lambda name, value: F.struct(F.lit(name).alias("field") if isinstance(name, str) else name.alias("field"), value.alias("value"))
    raw = F.transform(F.map_entries(F.coalesce(F.from_json("raw", "map<string,string>"), F.create_map().cast("map<string,string>"))), lambda e: pair(F.concat(F.lit("raw."), e["key"]), e["value"]))
    iocs = F.transform("iocs", lambda v, i: pair(F.concat(F.lit("ioc."), i.cast("string")), v))
    rows = alerts.select("seq", F.explode(F.concat(F.array(*[pair(f, F.col(f)) for f in FIELDS]), raw, iocs)).alias("x")).select("seq", "x.*").filter(F.col("value").isNotNull())
    if allowed:
        rows = rows.filter(~F.col("value").rlike(allowed))
    value = F.col("_normal")
    rows = rows.withColumn("_normal", normal(F.col("value")))
    found = rows.withColumn("pattern_type", F.explode(F.when(F.startswith("field", F.lit("ioc.")), kinds(value, True)).otherwise(kinds(value))))
    severity = F.lit(None).cast("string")
    for kind, level, _ in KINDS:
        severity = F.when(F.col("pattern_type") == kind, level).otherwise(severity)
    return found.select("seq", "field", "pattern_type", severity.alias("severity"), F.substring("value", 1, 50).alias("value_preview"))


def redact_injections(alerts: DataFrame) -> DataFrame:
    """Alerts with fields that try to instruct replaced, and such indicators taken out."""
    plain = alerts.withColumns({f"_{f}": normal(F.col(f)) for f in FIELDS} | {"_iocs": normal_each(F.col("iocs"))})
    out = plain.withColumns({f: F.when(F.size(kinds(F.col(f"_{f}"))) > 0, F.lit(MARK)).otherwise(F.col(f)) for f in FIELDS})
    out = out.withColumn("iocs", F.filter("iocs", lambda v, i: F.size(kinds(F.get("_iocs", i), True)) == 0))
    return out.select(*alerts.columns)


def findings_log(alerts: DataFrame, path: str) -> None:
    """Writes what ``scan`` finds, a line of JSON for each finding, where the rows are."""
    scan(alerts).select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)
