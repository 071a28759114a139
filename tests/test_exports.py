from __future__ import annotations

import csv
import glob
import json

from conftest import by_seq, record_rows

from dnsloom.operators import exports
from dnsloom.operators.intel import utc_text
from dnsloom.settings import AlertSettings, ForwardSettings

VERDICT = (True, "urlhaus", "2 URLs", 5.0)


def finished(spark):
    return exports.with_severity(
        record_rows(
            spark,
            [
                {"remark": "Normal query"},
                {"registrable_domain": "evil.com", "threat_intel": VERDICT},
                {"registrable_domain": "bad.net", "threat_intel": (True, "openphish", "listed", 6.0)},
                {"registrable_domain": "evil.com", "threat_intel": (True, "other", "later", 7.0)},
                {"registrable_domain": "good.com", "threat_intel": (False, None, "clean", 5.0)},
                {"remark": "High entropy domain name - Possible DGA or DNS Tunneling"},
                {"remark": "DNS query refused by the server"},
            ],
        )
    )


def text_of(path):
    parts = sorted(glob.glob(f"{path}/part-*"))
    return "".join(open(p, encoding="utf-8").read() for p in parts)


def test_flat_rows(spark):
    flat = exports.flatten(finished(spark))
    assert flat.columns == exports.FLAT_COLUMNS and len(flat.columns) == 27
    rows = flat.collect()
    assert all(not isinstance(v, (tuple, dict)) for r in rows for v in r)
    without = [r for r in rows if r.threat_intel_is_malicious is None]
    assert len(without) == 3 and all(r.threat_intel_source is None for r in without)


def test_csv_file(spark, tmp_path):
    exports.write_csv(finished(spark).coalesce(1), str(tmp_path / "csv"))
    lines = list(csv.DictReader(text_of(tmp_path / "csv").splitlines()))
    assert list(lines[0]) == exports.FLAT_COLUMNS and len(lines) == 7
    assert lines[1]["threat_intel_detail"] == "2 URLs" and lines[0]["flags_qr"] == "QUERY"
    assert lines[1]["threat_intel_is_malicious"] == "True" and lines[0]["subdomain_burst"] == "False"
    empty = finished(spark).limit(0)
    exports.write_csv(empty.coalesce(1), str(tmp_path / "empty"))
    assert text_of(tmp_path / "empty").strip() == ",".join(exports.FLAT_COLUMNS)


def test_any_csv_reader_reads_odd_texts_back(spark, tmp_path):
    odd = ['a"b,c.com.', "  pad.com.  ", "new\nline", "back\\slash\\", '"', "\\\"", ",", "", "cr\rlf\r\nx", "#x"]
    records = exports.with_severity(record_rows(spark, [{"query": q, "remark": f"{q}|"} for q in odd]))
    exports.write_csv(records.coalesce(1), str(tmp_path / "csv"))
    with open(glob.glob(str(tmp_path / "csv" / "part-*"))[0], newline="") as file:
        rows = list(csv.DictReader(file))
    assert [r["query"] for r in rows] == odd and [r["remark"] for r in rows] == [f"{q}|" for q in odd]
    assert all(len(r) == 27 and None not in r for r in rows)
    back = exports.read_csv(spark, str(tmp_path / "csv"))
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(
        map(tuple, exports.flatten(records).collect()), key=repr
    )


def test_json_lines_keep_nulls(spark, tmp_path):
    exports.write_json(finished(spark), str(tmp_path / "json"))
    rows = [json.loads(line) for line in text_of(tmp_path / "json").splitlines()]
    first = next(r for r in rows if r["seq"] == 0)
    assert first["threat_intel"] is None and first["entropy_z_score"] is None
    assert first["flags"]["rcode"] == "NOERROR"


def test_alert_threshold(spark):
    records = finished(spark)

    def levels(settings):
        return [(r.seq, r.severity) for r in by_seq(exports.alerts(records, settings))]

    high = [(1, "critical"), (2, "critical"), (3, "critical"), (5, "high")]
    assert levels(None) == levels(AlertSettings(enabled=True)) == high
    assert levels(AlertSettings(enabled=True, min_severity="critical")) == high[:3]
    assert levels(AlertSettings(enabled=True, min_severity="medium")) == [*high, (6, "medium")]
    assert levels(AlertSettings()) == []


def test_cef_threshold_and_given_severity(spark, tmp_path):
    records = record_rows(spark, [{"severity": "critical"}, {"severity": None}, {"severity": "info"}])
    rows = by_seq(exports.cef_lines(records))
    assert [r.severity for r in rows] == ["critical", "info", "info"]
    assert exports.cef_lines(records, ForwardSettings(enabled=True, min_severity="high")).count() == 1
    assert exports.cef_lines(records, ForwardSettings()).count() == 0
    exports.write_cef(records, str(tmp_path / "cef"))
    assert all(line.startswith("CEF:0|") for line in text_of(tmp_path / "cef").splitlines())


def test_report_blocks(spark, tmp_path):
    records = record_rows(spark, [{"entropy": 3.25, "entropy_z_score": 1.5}, {"entropy": 2.0}])
    first, second = by_seq(exports.report_blocks(records))
    assert first.block.splitlines()[:4] == [
        "Query: shop.test.",
        "Source: 192.0.2.7 -> Destination: 198.51.100.53",
        "Entropy: 3.2500 (z-score: 1.50)",
        "Flags:",
    ]
    assert "(z-score: N/A)" in second.block
    assert first.block.splitlines()[-2] == "Remark: Normal query"
    exports.write_report(records, str(tmp_path / "report"))
    assert text_of(tmp_path / "report").count("Query: ") == 2


def test_stix_indicators_and_bundle(spark, tmp_path):
    stamp = utc_text(1_700_000_000.25)
    assert stamp == "2023-11-14T22:13:20.250000Z"
    records = finished(spark)
    rows = exports.stix_indicators(records, stamp).orderBy("first_seq").collect()
    assert [r.name for r in rows] == ["Malicious domain: evil.com", "Malicious domain: bad.net"]
    assert rows[0].description == "Flagged by urlhaus: 2 URLs"
    exports.write_stix_bundle(records, str(tmp_path / "stix"), stamp, "1234")
    bundle = json.loads(text_of(tmp_path / "stix"))
    assert (bundle["type"], bundle["id"]) == ("bundle", "bundle--1234")
    evil, bad = bundle["objects"]
    assert evil["id"] == "indicator--31dbd1c3-f626-5d25-bf82-ed80aca1933c"
    assert bad["pattern"] == "[domain-name:value = 'bad.net']"
    assert evil["indicator_types"] == ["malicious-activity"] and evil["valid_from"] == stamp
    assert list(evil) == [
        "type",
        "spec_version",
        "id",
        "created",
        "modified",
        "name",
        "description",
        "indicator_types",
        "pattern",
        "pattern_type",
        "valid_from",
    ]


def test_empty_bundle(spark, tmp_path):
    exports.write_stix_bundle(record_rows(spark, [{}]), str(tmp_path / "stix"), "t", "1")
    assert json.loads(text_of(tmp_path / "stix"))["objects"] == []
