from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the tables")
def test_components_of_alerts_of_every_severity(spark):
    from watchglass.queries import events, overlap_components

    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    rows = events(spark, FOLDER).select("seq", F.concat(F.lit("u"), "user").alias("u"), F.concat(F.lit("h"), F.date_trunc("hour", "timestamp").cast("string")).alias("h")).collect()
    for r in rows:
        for key in (r["u"], r["h"]):
            if key is not None:
                parent[find(r["seq"])] = find(key)
    least: dict = {}
    for r in rows:
        least[find(r["seq"])] = min(r["seq"], least.get(find(r["seq"]), r["seq"]))
    got = {r["seq"]: r["component"] for r in overlap_components(spark, FOLDER).collect()}
    assert got == {r["seq"]: least[find(r["seq"])] for r in rows}
