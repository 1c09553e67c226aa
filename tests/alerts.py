"""Small alert tables for tests."""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from watchglass.plans.schema import ALERT

START = datetime(2026, 3, 1, tzinfo=UTC)


def table(spark, *rows):
    """Alerts from dicts; ``minute`` gives the timestamp, missing fields are null."""
    made = []
    for i, row in enumerate(rows):
        values = {"seq": i, "source_file": "f", "id": str(i), "severity": "MEDIUM", "title": f"alert {i}", "iocs": [], "technique_ids": []} | row
        if values.get("minute") is not None:
            values["timestamp"] = START + timedelta(minutes=values["minute"])
        made.append(tuple(values.get(f.name) for f in ALERT.fields))
    return spark.createDataFrame(made, ALERT)
