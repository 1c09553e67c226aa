from __future__ import annotations

import json

from pyspark.sql import functions as F

from tests.alerts import table
from watchglass import cli
from watchglass.operators.summaries import narratives
from watchglass.plans.triage import triage
from watchglass.sinks import exports, handover, stix, tickets
from watchglass.sinks.cache import ResultCache
from watchglass.plans.schema import Settings
from watchglass.sources.readers import kind_of, read_alerts
from watchglass.streaming.alerts import category_sessions, triage_batches


def write(tmp_path, name, text):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_json(spark, tmp_path):
    rows = [{"alert_id": 7, "name": "A", "description": "d", "priority": "1", "time": 1700000000, "src": "1.2.3.4", "user": ""}, {"id": None, "alert_id": "lost", "title": "B", "severity": "odd", "timestamp": "2026-03-01 10:00:00"}, 5, {"user": ""}]
    got = read_alerts(spark, write(tmp_path, "a.json", json.dumps(rows))).orderBy("seq").collect()
    assert [(r["title"], r["severity"], r["source_ip"], r["user"]) for r in got] == [("A", "CRITICAL", "1.2.3.4", None), ("B", "MEDIUM", None, None)]
    assert got[0]["id"] == "7" and len(got[1]["id"]) == 64
    assert str(got[0]["timestamp"]) == "2023-11-14 22:13:20" and str(got[1]["timestamp"]) == "2026-03-01 10:00:00"


def test_siem_export(spark, tmp_path):
    record = {"event_id": "e", "rule_name": "R", "urgency": "high", "_time": "2026-03-01T10:00:00Z", "src": "1.1.1.1", "dest": "", "dest_ip": "2.2.2.2", "tag": ["x", "y"]}
    got = read_alerts(spark, write(tmp_path, "s.json", json.dumps({"results": [record]}))).first()
    assert (got["id"], got["title"], got["severity"], got["dest_ip"]) == ("e", "R", "HIGH", "2.2.2.2")


def test_ndjson(spark, tmp_path):
    path = write(tmp_path, "n.ndjson", '{"title":"A","host":"h"}\nnot json\n\n{"rule_name":"R","urgency":"low"}\n')
    assert kind_of(open(path).read()) == "ndjson"
    assert sorted((r["title"], r["severity"]) for r in read_alerts(spark, path).collect()) == [("A", "MEDIUM"), ("R", "LOW")]


def test_csv(spark, tmp_path):
    path = write(tmp_path, "c.csv", 'ID,Title,Severity,sourceAddress,Image\n1,"two\nlines, quoted ""q""",high,1.2.3.4,host.exe\n2,,,,\n')
    got = read_alerts(spark, path).collect()
    assert [(r["id"], r["title"], r["severity"], r["source_ip"], r["host"]) for r in got] == [("1", 'two\nlines, quoted "q"', "HIGH", "1.2.3.4", "host.exe")]


def report(spark):
    payload = "ps_encoded:" + "QUJD" * 30
    return triage(table(spark, {"title": "run <b>|x|", "category": "c", "severity": "CRITICAL", "minute": 0, "iocs": [payload, "evil.com"]}, {"title": "again", "category": "c", "severity": "HIGH", "minute": 1, "iocs": ["evil.com"]}))


def test_nothing_leaves_with_a_payload(spark):
    r = report(spark)
    told = narratives(r.clusters, r.members)
    assert "QUJDQUJD" in r.clusters.first()["iocs"][1] or "QUJDQUJD" in "".join(r.clusters.first()["iocs"])
    drafts = tickets.drafts(r.clusters, r.members, told.select("cluster_id", F.lit(None).cast("string").alias("narrative"), "recommendations"))
    texts = [handover.render(r, k, "in", "now") for k in ("md", "html", "text")] + [stix.bundle(stix.objects(r.clusters, "now"))]
    for frame in (exports.alert_rows(r.members, r.clusters), exports.cluster_documents(r.members, r.clusters), drafts, tickets.case_payloads(drafts), tickets.issue_payloads(drafts, "SEC")):
        texts += [str(x) for x in frame.collect()]
    assert not [t[:80] for t in texts if "QUJDQUJD" in t]
    assert "run &lt;b&gt;" in texts[1] and "run \\<b\\>\\|x\\|" in texts[0]
    assert "QUJDQUJD" in str(exports.alert_rows(r.members, r.clusters, raw_payload=True).collect())


def test_stix_bundle(spark):
    r = report(spark)
    objects = json.loads(stix.bundle(stix.objects(r.clusters, "2026-01-01T00:00:00.000Z")))["objects"]
    assert len({o["id"] for o in objects}) == len(objects)
    kinds = [o["type"] for o in objects]
    assert (kinds.count("grouping"), kinds.count("indicator"), kinds.count("note"), kinds.count("relationship")) == (1, 2, 1, 2)
    assert {o["pattern"] for o in objects if o["type"] == "indicator"} >= {"[domain-name:value = 'evil.com']"}


def test_tickets(spark):
    r = report(spark)
    draft = tickets.drafts(r.clusters, r.members, narratives(r.clusters, r.members)).first()
    assert draft["severity"] == "CRITICAL" and draft["severity_hint"] == "critical" and len(draft["timeline"]) == 2
    issue = json.loads(tickets.issue_payloads(tickets.drafts(r.clusters, r.members, narratives(r.clusters, r.members)), "SEC").first()["json"])
    assert issue["fields"]["priority"]["name"] == "Highest" and issue["fields"]["project"]["key"] == "SEC"


def test_cache(spark, tmp_path):
    r, cache = report(spark), ResultCache(spark, str(tmp_path / "cache"))
    key = cache.key(r.ingested, Settings())
    assert key != cache.key(r.ingested, Settings(window_minutes=5)) and cache.get(key) is None
    cache.put(key, r.clusters)
    assert cache.get(key).count() == r.clusters.count()
    assert ResultCache(spark, str(tmp_path / "cache"), lifetime=-1).get(key) is None


def test_command_line(spark, tmp_path, capsys):
    rows = [{"title": f"t{i}", "category": "c", "severity": "high", "timestamp": f"2026-03-01T10:0{i}:00Z"} for i in range(3)]
    path = write(tmp_path, "a.json", json.dumps(rows))
    assert cli.main(["triage", path, "--filter", "priority >= LOW"], spark) == 0
    assert "c – 3 alerts" in capsys.readouterr().out
    out = str(tmp_path / "out")
    assert cli.main(["triage", path, "-f", "clusters", "-o", out], spark) == 0
    assert spark.read.csv(out, header=True).first()["alert_count"] == "3"
    assert cli.main(["triage", path, "--filter", "priority ~ LOW", "-f", "json"], spark) == 0
    said = capsys.readouterr()
    assert "filter left out" in said.err and json.loads(said.out)["label"] == "c – 3 alerts"
    assert cli.main(["triage", str(tmp_path / "missing")], spark) == 2
    assert cli.main(["metrics", path], spark) == 0 and cli.main(["validate", path], spark) == 0 and cli.main(["version"], spark) == 0


def test_streams(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    table(spark, *[{"category": "c", "minute": m, "severity": "HIGH"} for m in (0, 30, 90)]).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    assert category_sessions(stream).isStreaming
    query = triage_batches(stream, lambda r, n: seen.append(sorted(x["alert_count"] for x in r.clusters.collect())), str(tmp_path / "cp"))
    query.processAllAvailable()
    query.stop()
    assert seen == [[1, 2]]
