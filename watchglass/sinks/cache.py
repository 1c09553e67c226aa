"""Results kept as tables under a key of the input's content and all options."""

from __future__ import annotations

import hashlib
import json
import time
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchglass.plans.schema import Settings

LIFETIME = 3600


class ResultCache:
    """Keeps cluster tables in a folder for a time; an outdated one counts as missing."""

    def __init__(self, spark: SparkSession, folder: str, lifetime: float = LIFETIME):
        self.spark, self.folder, self.lifetime = spark, folder.rstrip("/"), lifetime

    def key(self, alerts: DataFrame, settings: Settings) -> str:
        """Of the rows, whatever their order, and of every option."""
        total = alerts.agg(F.count("*"), F.sum(F.xxhash64(*alerts.columns).cast("decimal(20,0)"))).first()
        return hashlib.sha256(json.dumps([*map(str, total), asdict(settings)], sort_keys=True).encode()).hexdigest()

    def get(self, key: str) -> DataFrame | None:
        try:
            found = self.spark.read.parquet(f"{self.folder}/{key}")
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        made = found.agg(F.max("_kept_at")).first()[0]
        return None if made is None or time.time() - made > self.lifetime else found.drop("_kept_at")

    def put(self, key: str, clusters: DataFrame) -> None:
        clusters.withColumn("_kept_at", F.lit(time.time())).write.mode("overwrite").parquet(f"{self.folder}/{key}")
