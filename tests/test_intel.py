from __future__ import annotations

import random

import pytest
from conftest import by_seq, record_rows

from dnsloom.operators import intel
from dnsloom.schema import RESPONSE_TABLE_SCHEMA, VERDICT_TABLE_SCHEMA
from dnsloom.settings import IntelSettings, ScaleSettings
from dnsloom.sources import feeds

NOW = 1_000_000.0
CLEAN = ("no match in any enabled feed", False, None)


def domains(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "domain STRING")


def responses(spark, *rows):
    return spark.createDataFrame(list(rows), RESPONSE_TABLE_SCHEMA)


def cache(spark, *rows):
    return spark.createDataFrame(list(rows), VERDICT_TABLE_SCHEMA)


def outcome(df):
    return {r.domain: (r.detail, r.is_malicious, r.source) for r in df.collect()}


def vendor(malicious, suspicious):
    stats = f'{{"malicious": {malicious}, "suspicious": {suspicious}}}'
    return f'{{"data": {{"attributes": {{"last_analysis_stats": {stats}}}}}}}'


def test_feed_lines(spark, rules, tmp_path):
    lines = [
        "https://a1b2.tunnel.evil.com/login",
        "  https://phish.example.net/paypal  ",
        "",
        "no-scheme.example.org/path",
        "http://user:pw@Bad_Host.Evil.ORG:8080/x?y#z",
        "//bare.evil.com",
        "https://10.1.2.3/x",
        "http://[2001:db8::1]:80/x",
        "http:///nohost",
    ]
    path = tmp_path / "feed.txt"
    path.write_text("\n".join(lines))
    found = feeds.feed_domains(feeds.read_feed(spark, str(path)), rules)
    assert sorted(r.domain for r in found.collect()) == [
        "10.1.2.3",
        "2001:db8::1",
        "evil.com",
        "evil.org",
        "example.net",
    ]


def test_host_lookup_responses(spark):
    table = responses(
        spark,
        ("hit.com", '{"query_status": "ok", "url_count": "3"}', None),
        ("number.com", '{"query_status": "ok", "url_count": 4}', None),
        ("bare.com", '{"query_status": "ok"}', None),
        ("miss.com", '{"query_status": "no_results"}', None),
        ("down.com", '{"query_status": "ok"}', "timeout"),
        ("junk.com", "<html>", None),
    )
    hits = {r.domain: r.detail for r in feeds.host_lookup_hits(table).collect()}
    assert hits == {
        "hit.com": "3 malicious URL(s) on record",
        "number.com": "4 malicious URL(s) on record",
        "bare.com": "unknown malicious URL(s) on record",
    }


def test_vendor_responses(spark):
    table = responses(
        spark,
        ("five.com", vendor(5, 0), None),
        ("odd.com", '{"data":{"attributes":{"last_analysis_stats":{"suspicious":1}}}}', None),
        ("clean.com", vendor(0, 0), None),
        ("empty.com", "{}", None),
        ("down.com", vendor(9, 9), "quota"),
    )
    hits = {r.domain: r.detail for r in feeds.vendor_report_hits(table).collect()}
    assert hits == {
        "five.com": "5 malicious / 0 suspicious vendor flags",
        "odd.com": "0 malicious / 1 suspicious vendor flags",
    }


def test_provider_order_and_switches(spark):
    names = domains(spark, "all.com", "feed.com", "vendor.com", "none.com", "down.com")
    tables = {
        "host_responses": responses(
            spark,
            ("all.com", '{"query_status": "ok", "url_count": 1}', None),
            ("feed.com", '{"query_status": "no_results"}', None),
            ("down.com", None, "timeout"),
        ),
        "feed": domains(spark, "all.com", "feed.com", "down.com", "other.com"),
        "vendor_responses": responses(
            spark, ("all.com", vendor(1, 1), None), ("vendor.com", vendor(0, 2), None)
        ),
    }
    listed = ("listed in the OpenPhish active feed", True, "openphish")
    assert outcome(intel.fresh_verdicts(names, NOW, **tables)) == {
        "all.com": ("1 malicious URL(s) on record", True, "urlhaus"),
        "feed.com": listed,
        "down.com": listed,
        "vendor.com": ("0 malicious / 2 suspicious vendor flags", True, "virustotal"),
        "none.com": CLEAN,
    }
    off = IntelSettings(host_lookup_enabled=False, vendor_report_enabled=False)
    some = outcome(intel.fresh_verdicts(names, NOW, settings=off, **tables))
    assert (some["all.com"], some["vendor.com"]) == (listed, CLEAN)
    assert set(outcome(intel.fresh_verdicts(names, NOW)).values()) == {CLEAN}


def test_cache_keeps_verdicts_for_their_time(spark):
    names = domains(spark, "old.com", "edge.com", "fresh.com", "new.com")
    stored = cache(
        spark,
        ("old.com", True, "urlhaus", "was bad", NOW - 61),
        ("edge.com", True, "urlhaus", "still bad", NOW - 60),
        ("fresh.com", False, None, CLEAN[0], NOW - 59),
        ("unseen.com", True, "urlhaus", "not asked", NOW),
    )
    settings = IntelSettings(verdict_ttl_seconds=60)
    feed = domains(spark, "fresh.com", "new.com")
    table = intel.verdicts(names, NOW, cache=stored, settings=settings, feed=feed)
    listed = ("listed in the OpenPhish active feed", True, "openphish")
    assert outcome(table) == {
        "old.com": CLEAN,
        "edge.com": ("still bad", True, "urlhaus"),
        "fresh.com": CLEAN,
        "new.com": listed,
    }
    ages = {r.domain: r.checked_at for r in table.collect()}
    assert ages["edge.com"] == NOW - 60 and ages["old.com"] == NOW
    left = intel.domains_to_check(names, stored, NOW, settings)
    assert sorted(r.domain for r in left.collect()) == ["new.com", "old.com"]


@pytest.mark.parametrize("scale", [ScaleSettings(), ScaleSettings(broadcast_rows=0, hot_rows=3)])
def test_annotation(spark, scale):
    records = record_rows(
        spark,
        [
            {"registrable_domain": "evil.com"},
            {"registrable_domain": "good.com"},
            {"registrable_domain": ""},
            *[{"registrable_domain": "evil.com"}] * 5,
        ],
    )
    table = cache(
        spark, ("evil.com", True, "urlhaus", "2 URLs", NOW), ("good.com", False, None, CLEAN[0], NOW)
    )
    bad, good, none, *rest = by_seq(intel.annotate_intel(records, table, scale))
    assert bad.remark == "Normal query | domain matches urlhaus threat intel: 2 URLs"
    assert {r.remark for r in rest} == {bad.remark}
    assert (good.remark, none.remark) == ("Normal query", "Normal query")
    assert good.threat_intel.asDict() == {
        "is_malicious": False,
        "source": None,
        "detail": CLEAN[0],
        "checked_at": NOW,
    }
    assert none.threat_intel is None


def seen(spark, times):
    rows = [(f"d{i}.com", i, t, 1) for i, t in enumerate(times)]
    return spark.createDataFrame(
        rows, "domain STRING, first_seq BIGINT, first_ts_us BIGINT, record_count BIGINT"
    )


def test_domains_seen(spark):
    rows = [{"registrable_domain": d, "ts_us": t} for d, t in (("a.com", 5), ("", 1), ("a.com", 3))]
    found = intel.domains_seen(record_rows(spark, rows)).collect()
    assert [tuple(r) for r in found] == [("a.com", 0, 3, 2)]


def test_lookup_candidates(spark):
    table = seen(spark, range(8))
    stored = cache(spark, ("d0.com", False, None, "", NOW), ("d1.com", False, None, "", NOW - 9999))
    host = responses(spark, ("d2.com", '{"query_status": "ok"}', None))
    open_domains = intel.unsettled_domains(
        table, NOW, cache=stored, host_responses=host, feed=domains(spark, "d3.com")
    )
    picked = intel.lookup_candidates(open_domains, IntelSettings(max_lookups=3)).collect()
    assert sorted(r.domain for r in picked) == ["d1.com", "d4.com", "d5.com"]


@pytest.mark.parametrize("page", [3, 2048])
def test_lookup_schedule(spark, page):
    rng = random.Random(4)
    second = 1_000_000
    times = [0, second, 15 * second, 29 * second, 30 * second]
    times += [rng.randint(0, 400) * second for _ in range(60)]
    last, expected = None, []
    for at, i in sorted((t, i) for i, t in enumerate(times)):
        if (last is None or at - last >= 15 * second) and len(expected) < 12:
            expected.append((len(expected) + 1, f"d{i}.com", i, at))
            last = at
    got = intel.lookup_schedule(seen(spark, times), IntelSettings(max_lookups=12), page)
    assert [tuple(r) for r in got.orderBy("lookup_no").collect()] == expected
    none = intel.lookup_schedule(seen(spark, [1]).limit(0), IntelSettings())
    assert none.count() == 0


@pytest.mark.parametrize("page", [1, 2, 5, 100])
def test_schedule_without_spacing_repeats_and_loses_nothing(spark, page):
    times = [0, 0, 0, 5, 5, 7, 7, 7, 9, 12]
    settings = IntelSettings(max_lookups=8, min_interval_seconds=0)
    got = intel.lookup_schedule(seen(spark, times), settings, page).orderBy("lookup_no").collect()
    assert [r.domain for r in got] == [f"d{i}.com" for i in range(8)]


def test_budget_limits_vendor_verdicts(spark):
    table = seen(spark, [i * 10_000_000 for i in range(10)])
    answers = responses(spark, *[(f"d{i}.com", vendor(1, 0), None) for i in range(10)])

    def confirmed(**settings):
        found = intel.verdicts(
            table, NOW, settings=IntelSettings(**settings), vendor_responses=answers
        )
        return sorted(r.domain for r in found.collect() if r.is_malicious)

    assert confirmed(max_lookups=0) == []
    assert confirmed(max_lookups=3, min_interval_seconds=0) == ["d0.com", "d1.com", "d2.com"]
    assert confirmed(max_lookups=20) == [f"d{i}.com" for i in (0, 2, 4, 6, 8)]
    assert len(confirmed(max_lookups=None)) == 10
