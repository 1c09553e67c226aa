"""The whole plan: alerts in, ranked clusters out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.functions.indicators import enrich
from watchglass.operators.clustering import assign, ranked, summarize
from watchglass.operators.dedup import dedup_stats, deduplicate
from watchglass.operators.redaction import redact
from watchglass.plans.lineage import stored
from watchglass.plans.schema import Settings


def with_indicators(alerts: DataFrame) -> DataFrame:
    """Alerts with the indicators found in them."""
    fields = [F.col(n) for n in ("title", "description", "source_ip", "dest_ip", "user", "host", "category")]
    return alerts.withColumn("iocs", enrich(F.col("raw"), fields, F.col("source_ip"), F.col("dest_ip"), F.col("iocs")))


@dataclass(frozen=True)
class Report:
    """Frames of a run: alerts that came in, those kept (with their cluster), and clusters."""

    ingested: DataFrame
    members: DataFrame
    clusters: DataFrame

    def stats(self) -> DataFrame:
        return dedup_stats(self.ingested, self.members)

    def exit_code(self, summary_error: bool = False) -> int:
        """4 after a failed summary, 1 with a cluster of HIGH or CRITICAL, else 0."""
        if summary_error:
            return 4
        return int(not self.clusters.filter(F.col("priority").isin("HIGH", "CRITICAL")).isEmpty())


def triage(alerts: DataFrame, settings: Settings = Settings()) -> Report:
    """Dedup, redaction, extraction, clustering and scoring; alerts are written once before they are clustered."""
    alerts = alerts.withColumn("raw", F.lit(None).cast("string")) if settings.drop_raw else alerts
    kept = deduplicate(alerts, settings.window_minutes, settings.scope) if settings.dedup else alerts
    known = redact(with_indicators(kept), settings.redact) if settings.redact else with_indicators(kept)
    members = assign(stored(known, "alerts"), settings)
    return Report(alerts, members, ranked(summarize(members, settings)))
