from __future__ import annotations

import os
import random
import time
from datetime import datetime, timedelta

import pytest
from conftest import by_seq, raw_rows
from pyspark.sql import functions as F

from dnsloom.operators import exports
from dnsloom.operators.records import build_records
from dnsloom.operators.replay import live_detection
from dnsloom.operators.staging import new_path, shared_dir
from dnsloom.plans.analyze import IntelTables
from dnsloom.plans.delivery import deliver
from dnsloom.schema import RESPONSE_TABLE_SCHEMA, VERDICT_TABLE_SCHEMA
from dnsloom.settings import AlertSettings, DetectionSettings, ForwardSettings, IntelSettings, ScaleSettings
from dnsloom.sources.logs import stream_dns_log
from dnsloom.streaming.live import LiveDetection
from dnsloom.streaming.state import merged, updates
from dnsloom.workload import queries

SETTINGS = DetectionSettings(
    burst_window_seconds=30, burst_unique_subdomain_threshold=4, z_score_threshold=1.0
)


def traffic(spark, n=400):
    rows = []
    for i in range(n):
        hot = i % 3 == 0
        client = "10.0.0.1" if hot else f"10.0.1.{i % 17}"
        qr = int(i % 5 == 0)
        rows.append(
            {
                "ts_us": 1_700_000_000_000_000 + i // 2 * 1_000_000,
                "source_ip": "8.8.8.8" if qr else client,
                "destination_ip": client if qr else "8.8.8.8",
                "query": f"{'ab' * (i % 9)}s{i % 23}.{'hot' if hot else f'd{i % 7}'}.com.",
                "qr": qr,
                "rcode": 3 * (i % 2),
            }
        )
    return raw_rows(spark, rows).repartition(1).cache()


def arrive(live, raw, folder, slices=3, **options):
    """Slices by seq, the stream restarted for each."""
    size = raw.count()
    for part in range(slices):
        low, high = size * part // slices, size * (part + 1) // slices
        raw.where((F.col("seq") >= low) & (F.col("seq") < high)).write.mode("append").parquet(folder)
        live.start(stream_dns_log(live.spark, folder, **options)).awaitTermination()


def rounded(df):
    return by_seq(df.withColumn("entropy_z_score", F.round("entropy_z_score", 8)))


@pytest.mark.parametrize(
    "scale", [ScaleSettings(), ScaleSettings(group_rows=20, broadcast_rows=2, hot_rows=30)]
)
def test_stream_equals_replay(spark, rules, scale):
    raw = traffic(spark)
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS, scale)
    arrive(live, raw, new_path(spark, "in"))
    expected = exports.with_severity(live_detection(build_records(raw, rules, SETTINGS), SETTINGS))
    assert rounded(live.output()) == rounded(expected)
    assert expected.where("subdomain_burst").count() > 20


def feed(live, folder, rows):
    """One more micro-batch with these rows, by a stream that is started anew."""
    raw_rows(live.spark, rows).coalesce(1).write.mode("append").parquet(folder)
    query = live.start(stream_dns_log(live.spark, folder))
    query.awaitTermination()
    return query


def test_batch_run_twice_overwrites_itself(spark, rules):
    """A micro-batch whose end was not noted runs again, on the state of the one before it."""
    raw = traffic(spark, 120)
    folder = new_path(spark, "in")
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS)
    arrive(live, raw, folder, slices=2)
    once = rounded(live.output())
    commits = f"{live.folder}/checkpoint/commits".removeprefix("file:")
    last = max(int(f) for f in os.listdir(commits) if f.isdigit())
    for name in (str(last), f".{last}.crc"):
        os.remove(f"{commits}/{name}")
    live.start(stream_dns_log(spark, folder)).awaitTermination()
    assert os.path.exists(f"{commits}/{last}")
    assert rounded(live.output()) == once and len(once) == 120


def test_micro_batch_leaves_no_scratch_tables(spark, rules):
    folder = shared_dir(spark).removeprefix("file:")
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS)
    arriving = new_path(spark, "in")
    before = set(os.listdir(folder))
    feed(live, arriving, [{"query": f"s{i}.a.com."} for i in range(30)])
    kept = {os.path.basename(live.folder), os.path.basename(arriving)}
    assert set(os.listdir(folder)) - before == kept


def test_a_micro_batch_reads_the_state_of_its_own_keys(spark, rules):
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS)
    folder = new_path(spark, "in")
    arrived = []
    process = live.process

    def counted(rows, batch):
        arrived.append(rows.where("record IS NULL").count())
        process(rows, batch)

    object.__setattr__(live, "process", counted)
    many = [{"source_ip": f"10.1.{i % 250}.{i // 250}", "query": f"s.d{i}.com."} for i in range(400)]
    few = [{"source_ip": "10.9.9.9", "query": "s.own.com."}]
    feed(live, folder, few)
    feed(live, folder, [{**r, "seq": 10 + i} for i, r in enumerate(many)])
    feed(live, folder, [{**r, "seq": 500, "ts_us": 1_001_000_000} for r in few])
    # Its client and its one name, though 400 clients and 400 domains are kept.
    assert arrived == [0, 0, 2]


def test_state_forgets_the_idle(spark, rules):
    """After `idle_seconds` without a record a client starts anew."""
    rows = [{"source_ip": "10.0.0.1", "query": f"{'abc' * i}.a.com.", "seq": i} for i in range(6)]
    last = [{"source_ip": "10.0.0.1", "query": "zz.a.com.", "seq": 50}]
    known = []
    for idle in (None, 1):
        live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS, idle_seconds=idle)
        folder = new_path(spark, "in")
        feed(live, folder, rows)
        time.sleep(1.5)
        feed(live, folder, last)
        known.append(live.output().where("seq = 50").head().entropy_z_score is not None)
    assert known == [True, False]


def test_verdicts_inside_the_stream(spark, rules):
    """A domain gets its verdict when it is first seen, and another once that is too old."""
    bad = '{"query_status":"ok","url_count":"1"}'

    def tables(now, *listed, cache=None):
        answers = spark.createDataFrame([(d, bad, None) for d in listed] or [("x", None, "e")], RESPONSE_TABLE_SCHEMA)
        return IntelTables(now=now, host_responses=answers, cache=cache, settings=IntelSettings(max_lookups=None))

    cache = spark.createDataFrame([("c.com", True, "urlhaus", "from before", 900.0)], VERDICT_TABLE_SCHEMA)
    stream, folder, seq = new_path(spark, "stream"), new_path(spark, "in"), iter(range(100))

    def slice_of(intel, *domains):
        live = LiveDetection(spark, stream, rules, SETTINGS, intel=intel)
        numbers = [next(seq) for _ in domains]
        feed(live, folder, [{"query": f"w.{d}.", "seq": n} for d, n in zip(domains, numbers, strict=True)])
        found = live.output().where(F.col("seq").isin(numbers)).collect()
        return {r.registrable_domain: (r.threat_intel.is_malicious, r.threat_intel.checked_at) for r in found}

    first = slice_of(tables(1000.0, cache=cache), "a.com", "c.com")
    assert first == {"a.com": (False, 1000.0), "c.com": (True, 900.0)}
    # The provider lists a.com now, but the verdict still holds; b.com is new and is checked.
    assert slice_of(tables(2000.0, "a.com", "b.com"), "a.com", "b.com") == {"a.com": (False, 1000.0), "b.com": (True, 2000.0)}
    later = slice_of(tables(4700.0, "a.com"), "a.com", "b.com", "c.com")
    assert later == {"a.com": (True, 4700.0), "b.com": (True, 2000.0), "c.com": (False, 4700.0)}


def test_clients_and_verdicts_share_keys(spark, rules):
    """Python is called once per bucket, not once per client or domain; the results are the same."""
    raw = traffic(spark, 300)
    given = IntelTables(
        now=1.0,
        host_responses=spark.createDataFrame([("hot.com", '{"query_status":"ok","url_count":"1"}', None)], RESPONSE_TABLE_SCHEMA),
        cache=spark.createDataFrame([(f"d{i}.com", True, "urlhaus", "before", 0.0) for i in range(3)], VERDICT_TABLE_SCHEMA),
        settings=IntelSettings(max_lookups=None),
    )
    found = []
    for buckets in (1, 4096):
        live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS, intel=given, buckets=buckets)
        arrive(live, raw, new_path(spark, "in"))
        found.append(rounded(live.output()))
    assert found[0] == found[1] and len(found[0]) == 300
    assert {r.registrable_domain for r in found[0] if r.threat_intel.is_malicious} == {"hot.com", "d0.com", "d1.com", "d2.com"}
    records = build_records(raw, rules, SETTINGS)
    keys = updates(records, 4, 2).where("kind IN ('client', 'verdict')").select("kind", "key", "name").distinct()
    assert keys.select("kind", "key").distinct().count() <= 4 < keys.count()


def test_a_task_that_sends_opens_its_sender_once(spark, tmp_path):
    class Sender:
        def __enter__(self):
            self.sink = open(tmp_path / f"{os.getpid()}-{time.time_ns()}", "w")

        def __call__(self, url, payload):
            self.sink.write(f"{url} {payload}\n")
            if payload == "3":
                raise OSError("the receiver is down")

        def __exit__(self, *error):
            self.sink.close()

    deliver(spark.range(40).repartition(2).selectExpr("string(id)"), Sender(), "to")
    lines = [line for file in tmp_path.iterdir() for line in file.read_text().splitlines()]
    assert sorted(lines) == sorted(f"to {i}" for i in range(40)) and len(list(tmp_path.iterdir())) == 2


def test_slices_of_many_files_arrive_whole(spark, tmp_path, monkeypatch):
    """A slice of several files is one micro-batch, and the alerts of a task are one file."""
    at = datetime(2024, 1, 1)
    kinds = ("click", "error", "view", "purchase", "signup")
    events = [(i, at + timedelta(seconds=i), i % 7, kinds[i % 5], float(i), f"k={i % 50}") for i in range(800)]
    spark.createDataFrame(events, "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING").write.parquet(f"{tmp_path}/events.parquet")
    pages = [(i, f"https://{'spam' if i % 3 else 'shop'}{i}.example.net/p", "") for i in range(9)]
    spark.createDataFrame(pages, "page_id BIGINT, url STRING, html STRING").write.parquet(f"{tmp_path}/pages.parquet")
    opened, sent, batches = [], [], []
    for rows_a_file in (1 << 15, 40):
        monkeypatch.setattr(queries, "_ROWS_A_FILE", rows_a_file)
        made = []
        monkeypatch.setattr(queries, "new_path", lambda s, label: made.append((label, new_path(s, label))) or made[-1][1])
        result = queries.QUERIES["stream_alerts"](queries.Workload(spark, str(tmp_path)))
        sent.append(sorted(r.payload for r in result.collect()))
        folders = {label: path.removeprefix("file:") for label, path in made}
        opened.append(len([f for f in os.listdir(folders["inbox"]) if f.endswith(".json")]))
        batches.append(len([f for f in os.listdir(f"{folders['stream']}/records") if f.startswith("batch=")]))
        arrived = [f for f in os.listdir(folders["arriving"]) if f.endswith(".parquet")]
        assert len(arrived) == 4 if rows_a_file > 800 else len(arrived) % 4 == 0 and len(arrived) > 4
    assert sent[0] == sent[1] and batches == [4, 4]
    assert 0 < opened[0] < len(sent[0]) / 4 and opened[1] < len(sent[1]) / 4


def test_a_budget_is_refused(spark, rules):
    live = LiveDetection(spark, new_path(spark, "stream"), rules, intel=IntelTables(now=0.0))
    with pytest.raises(ValueError, match="budget"):
        live.rows(raw_rows(spark, []))


def test_partial_moments_add_up():
    rng = random.Random(2)
    values = [rng.uniform(0, 5) for _ in range(40)]

    def moments(part):
        if not part:
            return (0, None, None, None, None, 0, 0)
        mean = sum(part) / len(part)
        return (len(part), mean, sum((v - mean) ** 2 for v in part), min(part), max(part), 1, 0)

    total = moments([])
    for part in ([], values[:1], values[1:17], [], values[17:]):
        total = merged(total, moments(part))
    assert total[:5] == pytest.approx(moments(values)[:5]) and total[5:] == (3, 0)


def test_enrichment_alerts_and_forwarding(spark, rules, tmp_path):
    raw = traffic(spark, 90)
    answers = [("hot.com", '{"query_status":"ok","url_count":"1"}', None)]
    given = IntelTables(
        now=1.0,
        host_responses=spark.createDataFrame(answers, RESPONSE_TABLE_SCHEMA),
        settings=IntelSettings(max_lookups=None),
    )
    sent, lines = str(tmp_path / "sent"), str(tmp_path / "lines")

    def alert(url, payload):
        with open(sent, "a") as sink:
            sink.write(f"{url} {payload}\n")
        raise OSError("the receiver is down")

    def forward(line):
        with open(lines, "a") as sink:
            sink.write(line + "\n")

    live = LiveDetection(
        spark,
        new_path(spark, "stream"),
        rules,
        SETTINGS,
        intel=given,
        alerts=AlertSettings(enabled=True, webhook_url="https://alerts.test/x"),
        alert_sender=alert,
        forward=ForwardSettings(enabled=True, min_severity="info"),
        forward_sender=forward,
    )
    arrive(live, raw, new_path(spark, "in"), slices=2)
    out = live.output()
    hot = out.where("registrable_domain = 'hot.com'")
    assert hot.count() == 30 and {r.severity for r in hot.collect()} == {"critical"}
    alerts = exports.alerts(out)
    assert len(open(sent).read().splitlines()) == alerts.count() >= 30
    assert len(open(lines).read().splitlines()) == 90


def test_nothing_arrives_nothing_is_written(spark, rules):
    folder = new_path(spark, "in")
    os.makedirs(folder.removeprefix("file:"))
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS)
    live.start(stream_dns_log(spark, folder)).awaitTermination()
    assert not os.path.exists(live.records_path.removeprefix("file:"))


@pytest.mark.parametrize("idle_seconds", [None, 1000])
def test_lagging_source_and_a_far_clock(spark, rules, idle_seconds):
    batches = []
    for batch in range(4):
        at = 1_700_000_000_000_000 + batch * 5_000_000
        rows = [{"source_ip": f"10.0.{i}.1", "query": f"s{batch}x{i}.a.com.", "ts_us": at + i} for i in range(2)]
        rows += [
            {"source_ip": f"10.1.{i}.1", "query": f"s{batch}x{i}.b.com.", "ts_us": at - 40_000_000 + i}
            for i in range(2)
        ]
        batches.append(rows)
    batches[1].append({"source_ip": "10.2.0.1", "query": "x.far.com.", "ts_us": 1_900_000_000_000_000})
    rows = [row for batch in batches for row in batch]
    raw = raw_rows(spark, [{**row, "seq": k} for k, row in enumerate(rows)]).cache()
    live = LiveDetection(spark, new_path(spark, "stream"), rules, SETTINGS, idle_seconds=idle_seconds)
    low, folder = 0, new_path(spark, "in")
    for batch in batches:
        feed(live, folder, [{**row, "seq": low + k} for k, row in enumerate(batch)])
        low += len(batch)
    bursts = ["seq", "subdomain_burst", "subdomain_burst_unique_count"]
    expected = live_detection(build_records(raw, rules, SETTINGS), SETTINGS)
    assert by_seq(live.output().select(*bursts)) == by_seq(expected.select(*bursts))
    for domain in ("a.com", "b.com"):
        assert expected.where(F.col("subdomain_burst") & (F.col("registrable_domain") == domain)).count() > 3
