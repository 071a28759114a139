from __future__ import annotations

import random

import json
import uuid

import pytest
from conftest import raw_rows, record_rows
from pyspark.sql import functions as F

from dnsloom.functions import interchange, remarks
from dnsloom.functions.flags import HEADER_BITS, flag_names, flags_text, pack_header, unpack_header
from dnsloom.settings import DetectionSettings, ForwardSettings


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_opcode_and_rcode_names(spark):
    rows = raw_rows(spark, [{"opcode": i, "rcode": i} for i in range(16)])
    named = rows.select("seq", flag_names().alias("f")).orderBy("seq")
    flags = [r.f for r in named.collect()]
    opcodes = ["QUERY", "IQUERY", "STATUS", "RESERVED", "NOTIFY", "UPDATE", "DSO"]
    # Response code names.
    rcodes = "NOERROR FORMERR SERVFAIL NXDOMAIN NOTIMP REFUSED YXDOMAIN YXRRSET NXRRSET NOTAUTH NOTZONE"
    rcodes = rcodes.split()
    assert [f.opcode for f in flags] == opcodes + [f"UNKNOWN({i})" for i in range(7, 16)]
    assert [f.rcode for f in flags] == rcodes + [f"UNKNOWN({i})" for i in range(11, 16)]


def test_flag_words_and_text(spark):
    rows = raw_rows(spark, [{"qr": 1, "aa": 1, "rd": 0, "rcode": 3, "opcode": 5}])
    packed = rows.select(pack_header({k: F.col(k) for k in HEADER_BITS}).alias("word"))
    assert packed.first().word == 0x8000 | 5 << 11 | 1 << 10 | 3
    bits = packed.select(*unpack_header(F.col("word")).values()).first().asDict()
    assert bits == {"qr": 1, "opcode": 5, "aa": 1, "tc": 0, "rd": 0, "ra": 0, "rcode": 3}
    flags = flag_names()
    text = rows.select(flags_text(flags).alias("t")).first().t
    assert text == (
        "  qr: RESPONSE\n  opcode: UPDATE\n  aa: TRUE\n  tc: FALSE\n  rd: FALSE\n  ra: FALSE\n  rcode: NXDOMAIN"
    )


@pytest.mark.parametrize(
    ("row", "z", "threshold", "expected"),
    [
        ({"entropy": 4.0}, None, 3.5, remarks.HIGH_ENTROPY),
        ({"entropy": 3.5}, None, 3.5, remarks.NORMAL),
        ({"entropy": 4.0, "rcode": "REFUSED"}, None, 3.5, remarks.HIGH_ENTROPY),
        ({"rcode": "REFUSED"}, None, 3.5, remarks.REFUSED),
        ({"qr": "RESPONSE", "rcode": "SERVFAIL"}, None, 3.5, remarks.FAILED),
        ({"qr": "RESPONSE"}, None, 3.5, remarks.NORMAL),
        ({"entropy": 3.6}, None, 4.0, remarks.NORMAL),
        (
            {},
            4.0,
            3.5,
            "Entropy anomalous for this host (z=4.00) - Possible DGA or DNS Tunneling",
        ),
        ({}, 1.0, 3.5, remarks.NORMAL),
        ({}, 3.0, 3.5, remarks.NORMAL),
        ({"entropy": 4.0}, 9.0, 3.5, remarks.HIGH_ENTROPY),
    ],
)
def test_base_remark(spark, row, z, threshold, expected):
    settings = DetectionSettings(entropy_threshold=threshold)
    remark = remarks.base_remark(
        F.col("entropy"), F.col("flags"), settings, z=F.lit(z).cast("double")
    )
    assert record_rows(spark, [row]).select(remark.alias("r")).first().r == expected


def test_fixed_decimals_follow_python(spark):
    values = [0.125, 2.675, 3.40625, -0.001, -0.125, 1234.5, 0.0, 4.0, 1.005, 0.99995, -2.675]
    values += [-5e11, 0.375, 2.5e8 + 0.005, 0.00005, 9.999999]
    values += [random.Random(1).randint(0, 10**6) / 1000 + 0.0005 for _ in range(50)]
    values += [i / 200 for i in range(60)] + [i / 20000 for i in range(1, 60, 2)]
    for places in (2, 4):
        got = one(spark, *[remarks.fixed_decimals(F.lit(v), places).alias(f"c{i}") for i, v in enumerate(values)])
        assert list(got) == [f"{v:.{places}f}" for v in values]


def test_ratio_percent_follows_python(spark):
    pairs = [(a, b) for b in range(1, 60) for a in range(b + 1)]
    df = spark.createDataFrame(pairs, "a INT, b INT")
    note = remarks.nxdomain_note(F.lit("h"), F.col("a") / F.col("b"), F.col("b"), 0.0)
    for row in df.select("a", "b", note.alias("n")).collect():
        share = f"{row.a / row.b:.0%}"
        assert row.n == f"host h has a high NXDOMAIN ratio ({share} of {row.b} responses) - possible DGA client"


@pytest.mark.parametrize(
    ("remark", "malicious", "expected"),
    [
        ("Normal query", None, "info"),
        (remarks.HIGH_ENTROPY, None, "high"),
        ("Entropy anomalous for this host (z=4.00) - Possible DGA or DNS Tunneling", None, "high"),
        ("Normal query | 20 unique subdomains under a.b within 60s - possible DNS tunneling", None, "high"),
        ("x | host 1 has a high NXDOMAIN ratio (80% of 10 responses)", None, "high"),
        (remarks.REFUSED, None, "medium"),
        (remarks.FAILED, None, "medium"),
        ("Normal query", True, "critical"),
        ("Normal query", False, "info"),
        (None, None, "info"),
    ],
)
def test_severity(spark, remark, malicious, expected):
    level = remarks.severity(F.lit(remark).cast("string"), F.lit(malicious).cast("boolean"))
    assert one(spark, level.alias("s")).s == expected


def test_severity_text_rule_agrees_with_flag_rule(spark):
    settings = DetectionSettings()
    rows = [
        {"entropy": e, "qr": qr, "rcode": rc}
        for e in (1.0, 4.0)
        for qr in ("QUERY", "RESPONSE")
        for rc in ("NOERROR", "REFUSED", "NXDOMAIN")
    ]
    records = record_rows(spark, rows)
    remark = remarks.base_remark(F.col("entropy"), F.col("flags"), settings)
    failed = (F.col("flags.rcode") == "REFUSED") | (
        (F.col("flags.qr") == "RESPONSE") & (F.col("flags.rcode") != "NOERROR")
    )
    by_flags = F.when(F.col("entropy") > 3.5, "high").when(failed, "medium").otherwise("info")
    by_text = remarks.severity(remark, F.lit(None).cast("boolean"))
    assert records.where(by_flags != by_text).count() == 0


def test_alert_message_and_payload(spark):
    args = [F.lit(v).cast("string") for v in ("evil.com.", "10.0.0.1", None, 'say "hi"')]
    message = remarks.alert_message(F.lit("high"), *args)
    row = one(spark, message.alias("m"), remarks.webhook_payload(message).alias("p"))
    assert row.m == '[HIGH] DNS anomaly: evil.com. (source 10.0.0.1 -> ?)\nsay "hi"'
    assert json.loads(row.p) == {"text": row.m, "content": row.m}


def cef(spark, level="high", **fields):
    base = {
        "source": "10.0.0.1",
        "target": "8.8.8.8",
        "query": "evil.com.",
        "remark": "High entropy",
        "domain": "evil.com",
    }
    columns = {k: F.lit(v).cast("string") for k, v in (base | fields).items()}
    line = interchange.cef_line(
        **columns, entropy=F.lit(3.9), level=F.lit(level), settings=ForwardSettings()
    )
    return one(spark, line.alias("l")).l


def test_cef_line(spark):
    line = cef(spark)
    fields = line.split("|")
    assert fields[0] == "CEF:0" and fields[4] == "dns-anomaly" and fields[6] == "7"
    assert fields[7] == (
        "src=10.0.0.1 dst=8.8.8.8 request=evil.com. msg=High entropy cs1Label=registrableDomain "
        "cs1=evil.com cn1Label=entropy cn1=3.9000 cs2Label=severity cs2=high"
    )
    scale = {"info": "1", "medium": "4", "critical": "10", "odd": "1"}
    assert {s: cef(spark, s).split("|")[6] for s in scale} == scale


def test_cef_escaping_and_missing_values(spark):
    line = cef(spark, remark="Weird | remark with \\ backslash", domain="")
    assert "Weird \\| remark with \\\\ backslash" in line
    assert "cs1Label=registrableDomain cn1Label" in line
    assert "msg=query\\=value" in cef(spark, remark="query=value")
    assert "msg=two  lines" in cef(spark, remark="two\r\nlines")
    assert cef(spark, remark=None).split("|")[5] == "DNS event"
    assert len(cef(spark, remark="x" * 300).split("|")[5]) == 200


def test_indicator_id_is_uuid5(spark):
    names = ["evil.com", "a.co.uk", "bücher.de", *[f"d{i}.net" for i in range(200)]]
    df = spark.createDataFrame([(n,) for n in names], "d STRING")
    for row in df.select("d", interchange.indicator_id(F.col("d")).alias("i")).collect():
        assert row.i == f"indicator--{uuid.uuid5(uuid.NAMESPACE_DNS, row.d)}"
    assert one(spark, interchange.indicator_id(F.lit("evil.com")).alias("i")).i.endswith(
        "31dbd1c3-f626-5d25-bf82-ed80aca1933c"
    )
