from __future__ import annotations

import random
import statistics
from collections import defaultdict

import pytest
from conftest import by_seq, raw_rows, record_rows
from pyspark.sql import functions as F

from dnsloom.operators import signals
from dnsloom.operators.lookup import lookup_join
from dnsloom.operators.records import build_records
from dnsloom.settings import DetectionSettings, ScaleSettings

TINY = ScaleSettings(broadcast_rows=0, hot_rows=20, group_rows=20)


def test_record_of_a_raw_row(spark, rules):
    raw = raw_rows(
        spark, [{"query": "a1.tunnel.evil.co.uk.", "ts_us": 1_700_000_000_250_000, "arcount": 2}]
    )
    row = build_records(raw, rules).first()
    assert (row.registrable_domain, row.subdomain) == ("evil.co.uk", "a1.tunnel")
    assert (row.timestamp, row.arcount, row.flags.qr) == (1_700_000_000.25, 2, "QUERY")
    assert row.remark == "Normal query"
    assert row.subdomain_burst is False
    unset = ("entropy_z_score", "subdomain_burst_unique_count", "host_nxdomain_ratio")
    assert all(row[c] is None for c in (*unset, "threat_intel", "severity"))


def test_host_baselines(spark):
    rows = [{"entropy": float(e)} for e in (1, 2, 3, 2, 1)]
    rows += [{"entropy": 9.0, "qr": "RESPONSE"}, {"entropy": 9.0, "source_ip": "10.0.0.2"}]
    rows += [{"entropy": 0.3, "source_ip": "10.0.0.3"}] * 6
    baselines = signals.host_baselines(record_rows(spark, rows), 5).orderBy("source_ip").collect()
    assert [(b.source_ip, b.sample_count) for b in baselines] == [("10.0.0.3", 6), ("192.0.2.7", 5)]
    assert baselines[1].mean == pytest.approx(1.8)
    assert baselines[1].stdev == pytest.approx(statistics.pstdev([1, 2, 3, 2, 1]))
    assert baselines[0].stdev == 0.0


def subs(n, ts_us, start=0, **more):
    return [{"subdomain": f"s{start + i}", "ts_us": ts_us + i * 1000, **more} for i in range(n)]


def test_subdomain_bursts(spark):
    minute = 60_000_000
    rows = subs(20, 10 * minute)
    rows += subs(5, 10 * minute, registrable_domain="few.com")
    rows += subs(10, 20 * minute, registrable_domain="two.com")
    rows += subs(10, 21 * minute, 10, registrable_domain="two.com")
    rows += subs(20, 30 * minute, registrable_domain="answers.com", qr="RESPONSE")
    rows += [{"subdomain": "", "registrable_domain": "bare.com"}] * 20
    rows += [{"subdomain": "same", "registrable_domain": "same.com"}] * 20
    found = signals.subdomain_bursts(record_rows(spark, rows), minute, 15).collect()
    assert [tuple(r) for r in found] == [("shop.test", 10, 20, 20)]
    sketched = signals.subdomain_bursts(record_rows(spark, rows), minute, 15, approximate=0.02)
    assert sketched.count() == 1


def test_nxdomain_ratios_are_keyed_by_destination(spark):
    answer = {"qr": "RESPONSE", "source_ip": "8.8.8.8", "destination_ip": "10.0.0.5"}
    rows = [{**answer, "rcode": "NXDOMAIN"}] * 4 + [answer] * 6
    rows += [{**answer, "destination_ip": "10.0.0.6", "rcode": "NXDOMAIN"}] * 2
    rows += [{"destination_ip": "10.0.0.7"}] * 9
    found = signals.nxdomain_ratios(record_rows(spark, rows), 5).collect()
    assert [tuple(r) for r in found] == [("10.0.0.5", 0.4, 10)]


def test_zscore_outlier(spark):
    rows = [{"entropy": 1.0}] * 9 + [{"entropy": 5.0}]
    settings = DetectionSettings(entropy_threshold=10.0, z_score_threshold=2.0)
    last = by_seq(signals.detection_signals(record_rows(spark, rows), settings))[-1]
    assert last.entropy_z_score == pytest.approx(3.0)
    assert last.remark.startswith("Entropy anomalous for this host (z=3.00)")


def test_burst_and_nxdomain_notes(spark):
    rows = subs(20, 600_000_000)
    answer = {"qr": "RESPONSE", "source_ip": "8.8.8.8", "destination_ip": "10.0.0.5"}
    rows += [{**answer, "rcode": "NXDOMAIN"}] * 8 + [answer] * 2
    out = by_seq(signals.detection_signals(record_rows(spark, rows)))
    note = "20 unique subdomains under shop.test within 60s - possible DNS tunneling"
    assert all(r.subdomain_burst and r.subdomain_burst_unique_count == 20 for r in out[:20])
    assert out[0].remark == f"Normal query | {note}"
    assert all(r.host_nxdomain_ratio == 0.8 and not r.subdomain_burst for r in out[20:])
    note = "host 10.0.0.5 has a high NXDOMAIN ratio (80% of 10 responses) - possible DGA client"
    assert out[29].remark == f"Normal query | {note}"
    assert out[20].remark.startswith("Unsuccessful DNS response")


def test_plain_rows_stay_normal(spark):
    out = signals.detection_signals(record_rows(spark, [{}] * 3)).collect()
    assert {r.remark for r in out} == {"Normal query"}
    assert {r.entropy_z_score for r in out} == {None}


def random_records(spark, n=600, seed=5):
    """A third of all rows on one client and one domain, many ties in time."""
    rng = random.Random(seed)
    rows = []
    for _ in range(n):
        hot = rng.random() < 0.34
        qr = rng.choice(["QUERY", "QUERY", "RESPONSE"])
        client = "10.0.0.1" if hot else f"10.0.1.{rng.randint(1, 40)}"
        domain = "hot.com" if hot else rng.choice(["", *[f"d{i}.com" for i in range(30)]])
        rows.append(
            {
                "ts_us": rng.randint(0, 200) * 1_000_000,
                "source_ip": client if qr == "QUERY" else "8.8.8.8",
                "destination_ip": "8.8.8.8" if qr == "QUERY" else client,
                "registrable_domain": domain,
                "subdomain": rng.choice(["", "www", *[f"x{i}" for i in range(12)]]) if domain else "",
                "entropy": rng.choice([1.0, 2.5, rng.random() * 4]),
                "qr": qr,
                "rcode": rng.choice(["NOERROR", "NXDOMAIN"]),
            }
        )
    return rows, record_rows(spark, rows)


BUSY = DetectionSettings(
    burst_window_seconds=20, burst_unique_subdomain_threshold=5, z_score_threshold=1.0
)


def test_batch_signals_against_a_plain_model(spark):
    rows, df = random_records(spark)
    entropies, answers, names = defaultdict(list), defaultdict(list), defaultdict(set)
    for row in rows:
        if row["qr"] == "QUERY":
            entropies[row["source_ip"]].append(row["entropy"])
            if row["registrable_domain"] and row["subdomain"]:
                names[row["registrable_domain"], row["ts_us"] // 20_000_000].add(row["subdomain"])
        else:
            answers[row["destination_ip"]].append(row["rcode"] == "NXDOMAIN")
    for row, out in zip(rows, by_seq(signals.detection_signals(df, BUSY)), strict=True):
        z = ratio = count = None
        if row["qr"] == "QUERY":
            values = entropies[row["source_ip"]]
            if len(values) >= 5 and statistics.pstdev(values):
                z = (row["entropy"] - statistics.mean(values)) / statistics.pstdev(values)
            if row["registrable_domain"] and row["subdomain"]:
                size = len(names[row["registrable_domain"], row["ts_us"] // 20_000_000])
                count = size if size >= 5 else None
        else:
            values = answers[row["destination_ip"]]
            ratio = sum(values) / len(values) if len(values) >= 5 else None
        assert out.entropy_z_score == (pytest.approx(z, abs=1e-9) if z is not None else None)
        assert (out.subdomain_burst_unique_count, out.host_nxdomain_ratio) == (count, ratio)
        assert out.subdomain_burst is (count is not None)


def comparable(df):
    return by_seq(df.withColumn("entropy_z_score", F.round("entropy_z_score", 9)))


def test_result_does_not_depend_on_layout_or_scale(spark):
    _, df = random_records(spark)
    expected = comparable(signals.detection_signals(df, BUSY))
    shuffled = df.orderBy(F.xxhash64("seq")).repartition(7)
    assert comparable(signals.detection_signals(shuffled, BUSY)) == expected
    assert comparable(signals.detection_signals(df, BUSY, TINY)) == expected


@pytest.mark.parametrize("weighted", [True, False])
def test_large_lookup_spreads_hot_and_missing_keys(spark, weighted):
    left = spark.range(4000).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id") % 50))
        .alias("key"),
    )
    sizes = left.where(F.col("key").isNotNull()).groupBy("key").count()
    table = sizes.select("key", F.upper("key").alias("value"), F.col("count").alias("rows"))
    table = table.where(F.col("key") != "k7")
    scale = ScaleSettings(broadcast_rows=5, hot_rows=500)
    out = lookup_join(
        left.withColumnRenamed("key", "name"),
        table if weighted else table.drop("rows"),
        {"key": F.col("name")},
        spread=F.col("seq"),
        scale=scale,
        weight="rows" if weighted else None,
    )
    assert out.columns == ["seq", "name", "value"]
    expected = F.when(F.col("name") != "k7", F.upper("name"))
    assert out.count() == 4000
    assert out.where(~F.col("value").eqNullSafe(expected)).count() == 0
    # no partition of the shuffled side may hold the hot key or the rows without a key
    plan = out._jdf.queryExecution().toString()
    assert "__lane" in plan
