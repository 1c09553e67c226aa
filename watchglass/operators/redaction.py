"""Redaction of alert fields, and of the indicators that would give a redacted value away."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.functions.text import filled

MARK = "[REDACTED]"
TEXT_FIELDS = ("title", "description", "source", "source_ip", "dest_ip", "user", "host", "category")
OTHER_FIELDS = ("iocs", "raw")


def redact(alerts: DataFrame, fields: Sequence[str], keep_raw: bool = False) -> DataFrame:
    """Alerts with the named fields replaced; indicators equal to a redacted value of the same alert go.

    The raw record may hold the same values, so it goes as well unless ``keep_raw``, and then keys of the redacted
    names are replaced in it (at its top level). An unknown field raises.
    """
    if unknown := [f for f in fields if f not in TEXT_FIELDS + OTHER_FIELDS]:
        raise ValueError(f"unknown fields: {', '.join(unknown)}")
    if not fields:
        return alerts
    hidden = [f for f in fields if f in TEXT_FIELDS]
    values = F.filter(F.array(*[filled(F.col(f)) for f in hidden]).cast("array<string>"), lambda x: x.isNotNull())
    out = alerts.withColumn("iocs", F.array().cast("array<string>") if "iocs" in fields else F.array_except("iocs", values))
    if keep_raw and "raw" not in fields:
        m = F.from_json("raw", "map<string,string>")
        kept = F.transform_values(m, lambda k, v: F.when(k.isin(*hidden), F.lit(MARK)).otherwise(v)) if hidden else m
        out = out.withColumn("raw", F.to_json(kept))
    else:
        out = out.withColumn("raw", F.lit(None).cast("string"))
    return out.withColumns({f: F.when(F.col(f).isNotNull(), F.lit(MARK)) for f in hidden})
