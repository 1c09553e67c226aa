from __future__ import annotations

import ipaddress

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from watchglass.functions import indicators as I
from watchglass.functions import patterns as P


def extracted(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(I.extract_indicators(F.col("t"))).first()[0]


@pytest.mark.parametrize(
    ("text", "has", "hasnt"),
    [
        ("see hxxps[://]evil[.]com/gate.php, now", ["https://evil.com/gate.php", "evil.com", "gate.php"], []),
        ("user[at]example[dot]com but state[at]rest", ["user@example.com"], ["state@rest"]),
        ("8.8.8.8 and 10.1.2.3 and 2606:4700:4700::1111 and ::1", ["8.8.8.8", "2606:4700:4700::1111"], ["10.1.2.3", "::1"]),
        ("https://evil.com/x. T1059.001 T2024 cve-2024-12345", ["https://evil.com/x", "T1059.001", "CVE-2024-12345"], ["T2024", "https://evil.com/x."]),
        (r"set HKCU\Software\Run\x; MALWARE_x.exe", [r"HKCU\Software\Run\x", "MALWARE_x.exe"], []),
        ("0" * 32 + " d41d8cd98f00b204e9800998ecf8427e", [], ["0" * 32, "d41d8cd98f00b204e9800998ecf8427e"]),
        ("JA3=E7D705A3286E19EA42F587B344EE6865", ["e7d705a3286e19ea42f587b344ee6865"], []),
        ("powershell -enc " + "QUJD" * 30, ["ps_encoded:" + "QUJD" * 30], []),
        ("srv.corp dc.local web.example-site.org", ["web.example-site.org"], ["srv.corp", "dc.local"]),
        ("", [], []),
        (None, [], []),
    ],
)
def test_extraction(spark, text, has, hasnt):
    found = extracted(spark, text)
    assert set(has) <= set(found) and not set(hasnt) & set(found)
    assert found == sorted(set(found))


def test_a_hostile_domain_doesnt_exhaust_the_stack(spark):
    assert extracted(spark, "a." * 20_000 + "com")


@pytest.mark.parametrize(
    ("value", "kind"),
    [
        ("T1059", "mitre_technique"), ("CVE-2023-1234", "cve"), ("http://a.b", "url"), ("a@b.co", "email"), ("1.2.3.4", "ip"), ("fe80::1", "ip"), ("a" * 64, "hash_sha256"), ("a" * 62, "jarm"),
        ("f" * 40, "unknown"), ("x.exe", "filename"), ("evil.com", "domain"), ("a.local", "unknown"), ("ps_encoded:x", "ps_encoded"), ("3:abc:defg", "ssdeep"), ("word", "unknown"),
    ],
)
def test_types(spark, value, kind):
    assert spark.range(1).select(I.indicator_type(F.lit(value))).first()[0] == kind


@pytest.mark.parametrize(
    ("value", "hint"),
    [("ps_encoded:x", "critical"), (r"HKLM\Software\Run\a", "high"), (r"HKLM\Software\a", None), ("https://x.ngrok.io/a", "high"), ("pastebin.com", "high"), ("https://discord.com/api/webhooks/1", "high"), ("https://discord.com/a", None)],
)
def test_hints(spark, value, hint):
    assert spark.range(1).select(I.severity_hint(F.lit(value))).first()[0] == hint


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text("0a1f:.%", min_size=1, max_size=14), min_size=50, max_size=50))
def test_addresses_are_those_of_the_standard_library(spark, values):
    def valid(x):
        try:
            return bool(ipaddress.ip_address(x))
        except ValueError:
            return False

    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", I.is_ip(F.col("v")).alias("ip")).collect()
    assert [(r["v"], r["ip"]) for r in rows if r["ip"] != valid(r["v"])] == []


def test_raw_strings_are_searched(spark):
    text = spark.range(1).select(I.collect_text(F.lit('{"k":"x\\"y","b":{"c":["p",{"d":"q"}]},"n":1}'), F.lit("t"), F.lit(""))).first()[0]
    assert text == 't\nx"y\np\nq'


def test_stub_hides_the_payload(spark):
    stub = spark.range(1).select(I.encoded_stub(F.lit("ps_encoded:QUJD"))).first()[0]
    assert stub == "ps_encoded:b5d4045c3f466fa9 (3B)"
    assert spark.range(1).select(I.encoded_stub(F.lit("ps_encoded:Q"))).first()[0] == "ps_encoded:invalid (?B)"


def test_no_pattern_repeats_a_group_without_a_bound():
    import re

    for name in dir(P):
        value = getattr(P, name)
        for pattern in [value] if isinstance(value, str) else [x[0] for x in P.REFANG] if name == "REFANG" else []:
            assert not re.search(r"\)[*+](?!\+)", pattern.replace("\\)", "")), name
