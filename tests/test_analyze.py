from __future__ import annotations

import glob
import json
from types import SimpleNamespace

import pytest
from conftest import RAW_DEFAULTS, by_seq

from dnsloom.operators.staging import shared_dir, stage
from dnsloom.plans.analyze import IntelTables, Sinks, analyze, write_outputs
from dnsloom.settings import AlertSettings, ForwardSettings
from dnsloom.sources.captures import captured_messages, scan_captures
from dnsloom.workload import capture_writer as writer

BASE_US = 1_700_000_000_000_000


def capture(path):
    """3 plain queries, 18 tunnel-like queries, 8 NXDOMAIN answers."""
    rows = [{"query": f"{n}.example.com.", "source_ip": "10.0.0.9"} for n in ("www", "mail", "api")]
    rows += [{"query": f"chunk{i}abcdefgh.tunnel.evil-corp.com."} for i in range(18)]
    answer = {"qr": 1, "rcode": 3, "source_ip": "8.8.8.8", "destination_ip": "10.0.0.77"}
    rows += [{**answer, "query": f"miss{i}.net."} for i in range(8)]
    data = writer.PCAP_HEADER
    for i, row in enumerate(rows):
        message = SimpleNamespace(**{**RAW_DEFAULTS, **row})
        data += writer.packet(BASE_US + i * 500_000, writer.frame(message))
    path.write_bytes(data)


@pytest.fixture()
def raw(spark, tmp_path):
    capture(tmp_path / "traffic.pcap")
    return captured_messages(scan_captures(spark, str(tmp_path / "traffic.pcap")))


def test_capture_to_records(raw, rules):
    out = by_seq(analyze(raw, rules))
    assert len(out) == 29
    burst = [r for r in out if r.subdomain_burst]
    assert len(burst) == 18
    assert {(r.subdomain_burst_unique_count, r.severity) for r in burst} == {(18, "high")}
    answers = [r for r in out if r.host_nxdomain_ratio is not None]
    assert {(r.host_nxdomain_ratio, r.severity) for r in answers} == {(1.0, "high")}
    assert len(answers) == 8
    assert [r.severity for r in out[:3]] == ["info"] * 3
    assert all(r.threat_intel is None for r in out)


def test_capture_to_every_sink(spark, raw, rules, tmp_path):
    feed = spark.createDataFrame([("evil-corp.com",)], "domain STRING")
    finished = stage(analyze(raw, rules, intel=IntelTables(now=1.0, feed=feed)), "finished").df
    sent, lines = str(tmp_path / "sent"), str(tmp_path / "lines")

    def append(path):
        def write(*parts):
            with open(path, "a") as sink:
                sink.write(parts[-1].replace("\n", " ") + "\n")

        return write

    write_outputs(
        finished,
        Sinks(
            json=str(tmp_path / "json"),
            csv=str(tmp_path / "csv"),
            report=str(tmp_path / "report"),
            cef=str(tmp_path / "cef"),
            stix=str(tmp_path / "stix"),
            stix_now=1.0,
            bundle_uuid="b",
            alerts=AlertSettings(enabled=True, webhook_url="https://alerts.test"),
            alert_sender=append(sent),
            forward=ForwardSettings(enabled=True),
            forward_sender=append(lines),
        ),
    )

    def lines_of(name):
        return [x for p in sorted(glob.glob(f"{tmp_path}/{name}/part-*")) for x in open(p)]

    records = [json.loads(x) for x in lines_of("json")]
    assert len(records) == 29
    critical = [r for r in records if r["severity"] == "critical"]
    assert len(critical) == 18
    assert all(r["remark"].endswith("listed in the OpenPhish active feed") for r in critical)
    assert len(json.loads("".join(lines_of("stix")))["objects"]) == 1
    assert len(lines_of("cef")) == 29 == len(open(lines).readlines())
    assert sum(x.startswith("Query: ") for x in lines_of("report")) == 29
    assert len(open(sent).readlines()) == 26


def test_shared_folder_comes_from_the_session(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")
