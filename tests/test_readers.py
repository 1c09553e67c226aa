from __future__ import annotations

import io
import json

import pytest

from watchglass import cli
from watchglass.plans.schema import Settings
from watchglass.plans.triage import triage
from watchglass.sources import readers
from watchglass.sources.readers import read_alerts

#: Two equal alerts a minute apart in one file; two of other categories, days apart, in another.
FIRST = [{"id": "a1", "title": "T", "category": "ca", "timestamp": "2024-01-01T00:00:00Z"}, {"id": "a2", "title": "T", "category": "ca", "timestamp": "2024-01-01T00:01:00Z"}]
SECOND = [{"id": "b1", "title": "U", "category": "cb", "timestamp": "2024-01-05T00:00:00Z"}, {"id": "b2", "title": "V", "category": "cc", "timestamp": "2024-01-09T00:00:00Z"}]


def dump(kind: str, rows: list[dict]) -> str:
    if kind == "json":
        return json.dumps(rows)
    if kind == "ndjson":
        return "\n".join(map(json.dumps, rows)) + "\n"
    names = list(rows[0])
    return "\n".join([",".join(names), *(",".join(r[n] for n in names) for r in rows)]) + "\n"


@pytest.mark.parametrize("kind", ["json", "ndjson", "csv"])
def test_two_files_are_three_clusters(spark, tmp_path, kind):
    for name, rows in (("b", SECOND), ("a", FIRST)):
        (tmp_path / f"{name}.{kind}").write_text(dump(kind, rows))
    alerts = read_alerts(spark, str(tmp_path))
    rows = alerts.orderBy("seq").collect()
    assert [r["id"] for r in rows] == ["a1", "a2", "b1", "b2"] and len({r["seq"] for r in rows}) == 4
    report = triage(alerts, Settings())
    assert sorted((r["label"], r["alert_count"]) for r in report.clusters.collect()) == [("T", 1), ("U", 1), ("V", 1)]
    assert report.stats().first()["removed"] == 1


def test_mixed_folder_reads_each_file_by_its_own_format(spark, tmp_path):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "1.csv").write_text("id,title,severity\nc1,One,low\n")
    (tmp_path / "2.csv").write_text('severity,id,title\nhigh,c2,"Two, with\na break"\n')
    (tmp_path / "3.json").write_text(dump("json", FIRST))
    (tmp_path / "4.log").write_text(dump("ndjson", SECOND))
    (tmp_path / "sub dir" / "5.json").write_text(json.dumps({"results": [{"_time": "1704067200", "rule_name": "R", "urgency": "high", "event_id": "s1"}]}))
    (tmp_path / "6.json").write_text("")
    (tmp_path / "notes.txt").write_text("id,title\nx,not an alert\n")
    got = read_alerts(spark, str(tmp_path)).orderBy("seq").collect()
    assert [(r["id"], r["title"], r["severity"]) for r in got] == [
        ("c1", "One", "LOW"), ("c2", "Two, with\na break", "HIGH"), ("a1", "T", "MEDIUM"), ("a2", "T", "MEDIUM"), ("b1", "U", "MEDIUM"), ("b2", "V", "MEDIUM"), ("s1", "R", "HIGH"),
    ]
    assert [r["seq"] for r in got] == list(range(7))
    named = read_alerts(spark, [str(tmp_path / "notes.txt"), str(tmp_path / "4.log")]).collect()
    assert sorted(r["id"] for r in named) == ["b1", "b2", "x"]
    assert read_alerts(spark, str(tmp_path / "sub dir")).count() == 1
    blank = tmp_path / "blank"
    blank.mkdir()
    (blank / "x.json").write_text(" \n ")
    assert read_alerts(spark, str(blank)).count() == 0


def test_places_don_t_depend_on_splits(spark, tmp_path):
    rows = [{"id": f"n{i}", "title": f"title {i}", "user": "u" * (i % 40)} for i in range(500)]
    (tmp_path / "big.ndjson").write_text(dump("ndjson", rows))
    (tmp_path / "a.ndjson").write_text(dump("ndjson", SECOND))
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    found = []
    for size in ("128m", "3000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found.append([(r["seq"], r["id"]) for r in read_alerts(spark, str(tmp_path)).orderBy("seq").collect()])
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
    spark.conf.unset("spark.sql.files.openCostInBytes")
    assert found[0] == found[1] == list(enumerate(["b1", "b2", *(f"n{i}" for i in range(500))]))


@pytest.mark.parametrize("kind", ["json", "ndjson", "csv"])
def test_standard_input(spark, monkeypatch, kind):
    monkeypatch.setattr("sys.stdin", io.StringIO(dump(kind, FIRST + SECOND)))
    got = read_alerts(spark, "-").orderBy("seq").collect()
    assert [r["id"] for r in got] == ["a1", "a2", "b1", "b2"] and {r["source_file"] for r in got} == {"<stdin>"}


def test_own_normalizer(spark, tmp_path):
    class Pipes:
        name = "pipes"

        def can_handle(self, head: str) -> bool:
            return head.startswith("#pipes")

        def read(self, spark, paths):
            from pyspark.sql import functions as F

            lines = spark.read.text(paths).select(*readers._places(), F.split("value", r"\|").alias("p"))
            fields = F.create_map(F.lit("id"), F.get("p", F.lit(0)), F.lit("title"), F.get("p", F.lit(1)))
            lines = lines.filter("size(p) = 2")
            return lines.select("source_file", "block", "at", F.lit(False).alias("siem"), F.lit(False).alias("csv"), fields.alias("fields"), F.to_json(fields).alias("raw"))

    (tmp_path / "x.log").write_text("#pipes\n1|A\n2|B\n")
    (tmp_path / "y.json").write_text(dump("json", FIRST))
    got = read_alerts(spark, str(tmp_path), normalizers=[Pipes()]).orderBy("seq").collect()
    assert [r["title"] for r in got] == ["A", "B", "T", "T"]


def test_dropped_raw_is_not_searched(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"title": "T", "note": "see http://evil.example.org/x"}]))
    alerts = read_alerts(spark, str(tmp_path))
    assert triage(alerts, Settings()).members.first()["iocs"] and not triage(alerts, Settings(drop_raw=True)).members.first()["iocs"]


def test_command_line_takes_several_paths(spark, tmp_path, capsys):
    for name, rows in (("a", FIRST), ("b", SECOND)):
        (tmp_path / f"{name}.json").write_text(dump("json", rows))
    assert cli.main(["validate", str(tmp_path / "a.json"), str(tmp_path / "b.json")], spark) == 0
    assert "4 alerts" in capsys.readouterr().out
    assert cli.main(["validate", str(tmp_path / "none.json")], spark) == 2
