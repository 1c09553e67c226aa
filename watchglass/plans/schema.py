"""The canonical alert, its word lists, and settings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALERT = T.StructType(
    [
        T.StructField("seq", T.LongType(), False),
        T.StructField("source_file", T.StringType()),
        T.StructField("id", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("severity", T.StringType()),
        *[T.StructField(n, T.StringType()) for n in ("title", "description", "source", "source_ip", "dest_ip", "user", "host", "category")],
        T.StructField("iocs", T.ArrayType(T.StringType())),
        T.StructField("technique_ids", T.ArrayType(T.StringType())),
        T.StructField("raw", T.StringType()),
    ]
)
FIELDS = [f.name for f in ALERT.fields]

# They must be these for right results.
SEVERITIES = ("INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL")
SEVERITY_POINTS = {"INFO": 1, "LOW": 2, "MEDIUM": 5, "HIGH": 10, "CRITICAL": 20}
PRIORITIES = ("NOISE", "LOW", "MEDIUM", "HIGH", "CRITICAL")
THRESHOLDS = {"LOW": 5, "MEDIUM": 20, "HIGH": 50, "CRITICAL": 100}
SEVERITY_WORDS = {
    "info": "INFO", "informational": "INFO", "low": "LOW", "medium": "MEDIUM", "moderate": "MEDIUM", "high": "HIGH",
    "critical": "CRITICAL", "emergency": "CRITICAL", "fatal": "CRITICAL",
    "1": "CRITICAL", "2": "HIGH", "3": "MEDIUM", "4": "LOW", "5": "INFO",
}


@dataclass(frozen=True)
class Settings:
    """What can be set about a run. ``window_minutes`` holds for clustering and for dedup."""

    window_minutes: int = 30
    scope: str = "file"  # dedup and sessions within each file, or "global"
    dedup: bool = True
    drop_raw: bool = False
    redact: tuple[str, ...] = ()
    weights: dict[str, int] = field(default_factory=lambda: dict(SEVERITY_POINTS))
    thresholds: dict[str, int] = field(default_factory=lambda: dict(THRESHOLDS))
    max_clusters: int | None = None


def lookup(key: Column, table: dict[str, object]) -> Column:
    out = None
    for k, v in table.items():
        out = F.when(key == k, F.lit(v)) if out is None else out.when(key == k, F.lit(v))
    return out


def points(severity: Column, weights: dict[str, int] | None = None) -> Column:
    return lookup(severity, weights or SEVERITY_POINTS)


def severity_of(value: Column) -> Column:
    """Severity that a word or digit names; MEDIUM for any other value."""
    return F.coalesce(lookup(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+$", "")), SEVERITY_WORDS), F.lit("MEDIUM"))


def priority_rank(priority: Column) -> Column:
    return lookup(priority, {p: i for i, p in enumerate(PRIORITIES)})
