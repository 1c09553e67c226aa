"""Indicator functions by name, for plans that are put together from names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchglass.functions import indicators as I

FUNCTIONS = {"extract_iocs": I.extract_indicators, "detect_ioc_type": I.indicator_type, "severity_hint": I.severity_hint, "refang": I.refang, "defang": I.defang, "host_of": I.host_of}


def with_functions(df: DataFrame, **columns: tuple[str, str]) -> DataFrame:
    """Adds columns by name: ``with_functions(df, kind=("detect_ioc_type", "value"))``. All stay inside the JVM."""
    return df.withColumns({name: FUNCTIONS[function](F.col(column)) for name, (function, column) in columns.items()})
