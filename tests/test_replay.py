from __future__ import annotations

import random
import statistics
from collections import defaultdict

import pytest
from conftest import by_seq, record_rows
from test_signals import BUSY, TINY, comparable, random_records

from dnsloom.operators import replay
from dnsloom.operators.ordered import CHUNK, long_groups, ordered_groups
from dnsloom.settings import DetectionSettings, ScaleSettings

PLAIN = ScaleSettings()
CHUNKED = ScaleSettings(group_rows=25, broadcast_rows=3, hot_rows=40)


def unique_counts(rows, window_us):
    """rows: (domain, subdomain, ts_us, seq) -> seq -> count, by scanning back."""
    counts, seen = {}, defaultdict(list)
    for domain, sub, ts, seq in sorted(rows, key=lambda r: (r[2], r[3])):
        seen[domain].append((ts, sub))
        counts[seq] = len({s for t, s in seen[domain] if t >= ts - window_us})
    return counts


def sliding(spark, rows, window_us, scale=PLAIN):
    schema = "registrable_domain STRING, subdomain STRING, ts_us BIGINT, seq BIGINT"
    out = replay.sliding_unique(spark.createDataFrame(rows, schema), window_us, scale)
    return {r.seq: r.unique_count for r in out.collect()}


def test_sliding_unique_edges(spark):
    second = 1_000_000
    rows = [("a.com", f"s{i}", i * second, i) for i in range(5)]
    rows += [("b.com", "same", i * second, 10 + i) for i in range(3)]
    rows += [("c.com", "x", 0, 20), ("c.com", "y", 1000 * second, 21)]
    rows += [("edge.com", "x", 0, 30), ("edge.com", "y", 60 * second, 31)]
    rows += [("past.com", "x", 0, 40), ("past.com", "y", 60 * second + 1, 41)]
    rows += [("tie.com", "x", 5, 50), ("tie.com", "y", 5, 51), ("tie.com", "x", 5, 52)]
    got = sliding(spark, rows, 60 * second)
    assert [got[i] for i in range(5)] == [1, 2, 3, 4, 5]
    assert [got[10 + i] for i in range(3)] == [1, 1, 1]
    assert (got[21], got[31], got[41]) == (1, 2, 1)
    assert [got[50 + i] for i in range(3)] == [1, 2, 2]


@pytest.mark.parametrize("scale", [PLAIN, CHUNKED], ids=["plain", "chunked"])
def test_sliding_unique_against_a_model(spark, scale):
    rng = random.Random(11)
    rows = []
    for seq in range(1500):
        domain = "hot.com" if rng.random() < 0.4 else f"d{rng.randint(0, 9)}.com"
        sub = "www" if rng.random() < 0.4 else f"s{rng.randint(0, 15)}"
        # ties, gaps of exactly the window, and one instant with a fifth of all rows
        ts = 500 if rng.random() < 0.2 else rng.randint(0, 120) * 10
        rows.append((domain, sub, ts, seq))
    assert sliding(spark, rows, 100, scale) == unique_counts(rows, 100)


def live_model(rows, settings):
    """(z, unique count, ratio) per row, one row at a time in (ts, seq) order."""
    entropies, answers = defaultdict(list), defaultdict(list)
    sightings = [
        (r["registrable_domain"], r["subdomain"], r["ts_us"], i)
        for i, r in enumerate(rows)
        if r["qr"] == "QUERY" and r["registrable_domain"] and r["subdomain"]
    ]
    counts = unique_counts(sightings, settings.burst_window_us)
    out = {}
    for i, row in sorted(enumerate(rows), key=lambda p: (p[1]["ts_us"], p[0])):
        z = ratio = None
        if row["qr"] == "QUERY":
            past = entropies[row["source_ip"]]
            if len(past) >= settings.min_baseline_samples and statistics.pstdev(past) > 0:
                z = (row["entropy"] - statistics.mean(past)) / statistics.pstdev(past)
            past.append(row["entropy"])
        else:
            past = answers[row["destination_ip"]]
            past.append(row["rcode"] == "NXDOMAIN")
            if len(past) >= settings.min_nxdomain_samples:
                ratio = sum(past) / len(past)
        count = counts.get(i, 0)
        out[i] = (z, count if count >= settings.burst_unique_subdomain_threshold else None, ratio)
    return out


@pytest.mark.parametrize("scale", [PLAIN, CHUNKED], ids=["plain", "chunked"])
def test_live_detection_against_a_model(spark, scale):
    rows, df = random_records(spark, n=900, seed=8)
    expected = live_model(rows, BUSY)
    out = by_seq(replay.live_detection(df, BUSY, scale))
    assert len(out) == len(rows)
    for got in out:
        z, count, ratio = expected[got.seq]
        assert got.entropy_z_score == (pytest.approx(z, abs=1e-7) if z is not None else None)
        assert (got.subdomain_burst_unique_count, got.host_nxdomain_ratio) == (count, ratio)
    assert any(v[0] for v in expected.values()) and any(v[1] for v in expected.values())


def test_chunked_and_plain_give_the_same_remarks(spark):
    _, df = random_records(spark, n=900, seed=9)
    plain = comparable(replay.live_detection(df, BUSY, PLAIN))
    assert comparable(replay.live_detection(df, BUSY, CHUNKED)) == plain
    assert comparable(replay.live_detection(df, BUSY, TINY)) == plain


def test_no_chunk_holds_much_more_than_its_share(spark):
    """One key, one instant: both are cut."""
    rows = [{"ts_us": 7 if i % 3 else i, "source_ip": "10.0.0.1"} for i in range(3000)]
    df = record_rows(spark, rows).select("seq", "ts_us", "source_ip")
    scale = ScaleSettings(group_rows=100)
    groups = ordered_groups(
        df, ["source_ip"], scale, long_keys=long_groups(df, ["source_ip"], scale)
    )
    assert groups.split
    sizes = [r["count"] for r in groups.df.groupBy("source_ip", CHUNK).count().collect()]
    assert sum(sizes) == 3000 and max(sizes) <= 300
    ordered = groups.df.orderBy("ts_us", "seq").collect()
    assert [r[CHUNK] for r in ordered] == sorted(r[CHUNK] for r in ordered)


@pytest.mark.parametrize("scale", [PLAIN, ScaleSettings(group_rows=3)], ids=["plain", "chunked"])
def test_constant_history_has_no_zscore(spark, scale):
    rows = [{"entropy": 0.3, "ts_us": i} for i in range(12)] + [{"entropy": 5.0, "ts_us": 99}]
    settings = DetectionSettings(entropy_threshold=10.0)
    out = by_seq(replay.live_detection(record_rows(spark, rows), settings, scale))
    assert [r.entropy_z_score for r in out] == [None] * 13
    rows.append({"entropy": 0.3, "ts_us": 100})
    out = by_seq(replay.live_detection(record_rows(spark, rows), settings, scale))
    assert out[13].entropy_z_score is not None


def test_burst_threshold_is_first_reached_on_the_fifth_row(spark):
    rows = [{"subdomain": f"s{i}", "ts_us": i * 1000} for i in range(6)]
    settings = DetectionSettings(burst_unique_subdomain_threshold=5)
    out = by_seq(replay.live_detection(record_rows(spark, rows), settings))
    assert [r.subdomain_burst for r in out] == [False] * 4 + [True] * 2
    assert [r.subdomain_burst_unique_count for r in out] == [None] * 4 + [5, 6]


def test_running_nxdomain_ratio(spark):
    answer = {"qr": "RESPONSE", "source_ip": "8.8.8.8", "destination_ip": "10.0.0.5"}
    rows = [{**answer, "rcode": "NXDOMAIN", "ts_us": i} for i in range(5)]
    out = by_seq(replay.live_detection(record_rows(spark, rows)))
    assert [r.host_nxdomain_ratio for r in out] == [None] * 4 + [1.0]
    assert out[4].remark.endswith("(100% of 5 responses) - possible DGA client")


def test_moments_of_wide_merge(spark):
    """Histories carried over many chunks keep their precision."""
    rng = random.Random(2)
    rows = [{"entropy": 3.0 + rng.random() * 1e-3, "ts_us": i} for i in range(400)]
    df = record_rows(spark, rows)
    plain = by_seq(replay.live_baseline(df, DetectionSettings(), PLAIN))
    cut = by_seq(replay.live_baseline(df, DetectionSettings(), ScaleSettings(group_rows=10)))
    for a, b in zip(plain, cut, strict=True):
        assert b.entropy_z_score == (
            None if a.entropy_z_score is None else pytest.approx(a.entropy_z_score, rel=1e-6)
        )
