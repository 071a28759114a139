"""The registered queries: every operator on tables derived from the given ones."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsloom.functions import remarks
from dnsloom.functions.entropy import shannon_entropy
from dnsloom.functions.flags import HEADER_BITS, flag_names, flags_text, pack_header, unpack_header
from dnsloom.operators import exports, intel, replay, signals
from dnsloom.operators.names import split_names
from dnsloom.operators.staging import new_path, stage
from dnsloom.plans.analyze import analyze
from dnsloom.schema import RAW_SCHEMA, RECORD_SCHEMA
from dnsloom.settings import AlertSettings, ScaleSettings
from dnsloom.sources import captures, feeds
from dnsloom.sources.logs import read_dns_log, stream_dns_log
from dnsloom.streaming.live import LiveDetection
from dnsloom.workload.capture_writer import log_address, write_captures
from dnsloom.workload.tables import INTEL_SETTINGS, NOW, Workload

SCALE = ScaleSettings()
# pcap_scan compares times within stretches of this length; one row a stretch is carried on.
_CHUNK_BYTES = 1 << 22
# A slice of the arriving log is one file per so many rows, or one file.
_ROWS_A_FILE = 1 << 15
BUNDLE_UUID = "00000000-0000-4000-8000-000000000000"


def r9(name: str) -> Column:
    return F.round(F.col(name), 9).alias(name)


def _flat(records: DataFrame, *without: str) -> DataFrame:
    """Flat form with rounded doubles, seq in front."""
    flat = exports.flatten(records, "seq")
    return flat.select("seq", *[_rounded(c) for c in exports.FLAT_COLUMNS if c not in without])


def _rounded(name: str) -> Column:
    return r9(name) if name in ("entropy", "entropy_z_score", "host_nxdomain_ratio") else F.col(name)


INTEL_COLUMNS = tuple(c for c in exports.FLAT_COLUMNS if c.startswith("threat_intel_"))


def dns_log(w: Workload) -> DataFrame:
    """Stored as Parquet and scanned back with the raw schema."""
    path = new_path(w.spark, "dns-log")
    w.dns_log().write.parquet(path)
    return read_dns_log(w.spark, path)


def pcap_scan(w: Workload) -> DataFrame:
    """The messages in packet order: a message is in order if none before it in its file is later."""
    scan = captures.scan_captures(w.spark, _captures(w, mixed=False), split_bytes=1 << 18)
    read = scan.where(~F.col("skipped") & (F.col("unread_bytes") == 0))
    read = read.withColumn("chunk", F.floor(F.col("offset") / F.lit(_CHUNK_BYTES)))
    ends = read.groupBy("path", "chunk").agg(F.max_by("ts_us", "seq").alias("end"))
    carried = F.lag("end").over(Window.partitionBy("path").orderBy("chunk")).alias("carried")
    read = read.join(ends.select("path", "chunk", carried), ["path", "chunk"])
    within = F.lag("ts_us").over(Window.partitionBy("path", "chunk").orderBy("seq"))
    before = F.coalesce(within, F.col("carried"))
    ordered = read.withColumn("in_order", F.coalesce(before <= F.col("ts_us"), F.lit(True)))
    ordered = ordered.withColumns({c: log_address(F.col(c)) for c in ("source_ip", "destination_ip")})
    return ordered.select(*[c for c in RAW_SCHEMA.fieldNames() if c != "seq"], "in_order")


def skip_summary(w: Workload) -> DataFrame:
    return captures.skip_summary(captures.scan_captures(w.spark, _captures(w, mixed=True)))


def _captures(w: Workload, mixed: bool) -> str:
    folder = new_path(w.spark, "captures")
    write_captures(w.dns_log(), folder, files=4, mixed=mixed)
    return folder


def header_bits(w: Workload) -> DataFrame:
    word = pack_header({k: F.col(k) for k in HEADER_BITS}).alias("word")
    return w.stored_log.select("seq", word).select("seq", "word", *unpack_header(F.col("word")).values())


def flags_decoded(w: Workload) -> DataFrame:
    flags = w.stored_log.select("seq", flag_names().alias("flags"))
    named = [F.col(f"flags.{k}").alias(f"flags_{k}") for k in HEADER_BITS]
    return flags.select("seq", *named, flags_text(F.col("flags")).alias("flags_text"))


def entropy(w: Workload) -> DataFrame:
    parts = split_names(w.stored_log, w.rules)
    score = F.round(shannon_entropy("scoring_label"), 9).alias("entropy")
    return parts.select("seq", "scoring_label", score)


def domain_parts(w: Workload) -> DataFrame:
    return split_names(w.stored_log.select("seq", "query"), w.rules)


def dns_records(w: Workload) -> DataFrame:
    signal_columns = (
        "entropy_z_score",
        "subdomain_burst",
        "subdomain_burst_unique_count",
        "host_nxdomain_ratio",
        "severity",
        *INTEL_COLUMNS,
    )
    return _flat(w.parsed(), *signal_columns)


def base_remark(w: Workload) -> DataFrame:
    remark = remarks.base_remark(F.col("entropy"), F.col("flags"), w.settings)
    return w.parsed().select("seq", remark.alias("remark"))


def host_baselines(w: Workload) -> DataFrame:
    baselines = signals.host_baselines(w.records, w.settings.min_baseline_samples)
    return baselines.select("source_ip", r9("mean"), r9("stdev"), "sample_count")


def subdomain_bursts(w: Workload) -> DataFrame:
    return signals.subdomain_bursts(
        w.records, w.settings.burst_window_us, w.settings.burst_unique_subdomain_threshold
    )


def nxdomain_ratios(w: Workload) -> DataFrame:
    ratios = signals.nxdomain_ratios(w.records, w.settings.min_nxdomain_samples)
    return ratios.select("client", r9("ratio"), "sample_count")


def entropy_zscores(w: Workload) -> DataFrame:
    scored = signals.with_baseline(w.records, w.settings, SCALE)
    return scored.select("seq", "source_ip", r9("entropy"), r9("entropy_z_score"))


def burst_records(w: Workload) -> DataFrame:
    flagged = signals.with_bursts(w.records, w.settings, SCALE)
    return flagged.select("seq", "subdomain_burst", "subdomain_burst_unique_count")


def nxdomain_records(w: Workload) -> DataFrame:
    scored = signals.with_baseline(w.records, w.settings, SCALE)
    return scored.select("seq", "destination_ip", r9("host_nxdomain_ratio"))


def detection_signals(w: Workload) -> DataFrame:
    found = signals.detection_signals(w.records, w.settings)
    return _flat(found, "severity", *INTEL_COLUMNS)


def severity(w: Workload) -> DataFrame:
    graded = exports.with_severity(signals.detection_signals(w.records, w.settings))
    return graded.select("seq", "severity", "remark")


def analyze_all(w: Workload) -> DataFrame:
    return _flat(analyze(w.stored_log, w.rules, w.settings, w.intel()))


def live_baseline(w: Workload) -> DataFrame:
    rows = replay.live_baseline(w.records, w.settings, SCALE).where(signals.is_query())
    return rows.select("seq", r9("entropy"), r9("entropy_z_score"))


def live_burst(w: Workload) -> DataFrame:
    sightings = replay.burst_sightings(w.records)
    return replay.sliding_unique(sightings, w.settings.burst_window_us, SCALE)


def live_nxdomain(w: Workload) -> DataFrame:
    rows = replay.live_baseline(w.records, w.settings, SCALE).where(~signals.is_query())
    return rows.select("seq", "destination_ip", r9("host_nxdomain_ratio"))


def live_detection(w: Workload) -> DataFrame:
    found = exports.with_severity(replay.live_detection(w.records, w.settings))
    return _flat(found, *INTEL_COLUMNS)


def _stream(w: Workload, enriched: bool, parts: int = 4, **sending) -> LiveDetection:
    """The DNS log arriving in `parts` time slices, one per micro-batch, of as many files each.

    The stream is started after every second slice, and takes up the state that the run before
    left in the stream's folder.
    """
    given = w.intel() if enriched else None
    folder = new_path(w.spark, "stream")
    live = LiveDetection(w.spark, folder, w.rules, w.settings, intel=given, **sending)
    folder = new_path(w.spark, "arriving")
    log = w.stored_log
    cuts = log.approxQuantile("ts_us", [i / parts for i in range(1, parts)], 0.01)
    slices = []
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        inside = F.lit(True) if low is None else F.col("ts_us") >= int(low)
        slices.append(inside if high is None else inside & (F.col("ts_us") < int(high)))
    sizes = log.agg(*[F.count_if(inside) for inside in slices]).first()
    # Dealt out in turn, so many rows leave no file of a slice empty.
    files = max(1, min(sizes) // _ROWS_A_FILE)
    for turn, inside in enumerate(slices, 1):
        log.where(inside).repartition(files).write.mode("append").parquet(folder)
        if turn % 2 == 0 or turn == parts:
            log_stream = stream_dns_log(w.spark, folder, max_files_per_trigger=files)
            live.start(log_stream).awaitTermination()
    return live


def stream_detection(w: Workload) -> DataFrame:
    return _flat(_stream(w, enriched=False).output(), *INTEL_COLUMNS)


def stream_enriched(w: Workload) -> DataFrame:
    return _flat(_stream(w, enriched=True).output())


class _Inbox:
    """A sender that keeps what a task sends in one file of the shared folder."""

    def __init__(self, folder: str):
        self.folder = folder

    def __enter__(self) -> None:
        self.sink = None

    def __call__(self, url: str, payload: str) -> None:
        if self.sink is None:
            filesystem, inner = captures.location(self.folder)
            filesystem.create_dir(inner)
            self.sink = filesystem.open_output_stream(f"{inner}/{uuid.uuid4().hex}.json")
        self.sink.write(json.dumps({"payload": payload}).encode() + b"\n")

    def __exit__(self, *error) -> None:
        if self.sink is not None:
            self.sink.close()


def stream_alerts(w: Workload) -> DataFrame:
    """What an injected sender was handed while the stream ran, through the shared folder."""
    inbox = new_path(w.spark, "inbox")
    settings = AlertSettings(enabled=True, webhook_url="https://alerts.test/hook")
    _stream(w, enriched=True, alerts=settings, alert_sender=_Inbox(inbox))
    return w.spark.read.schema("payload STRING").json(inbox)


def phish_feed_domains(w: Workload) -> DataFrame:
    return feeds.feed_domains(w.feed_lines(), w.rules)


def phish_feed_hits(w: Workload) -> DataFrame:
    return intel.feed_hits(w.seen, feeds.feed_domains(w.feed_lines(), w.rules))


def intel_urlhaus(w: Workload) -> DataFrame:
    return feeds.host_lookup_hits(w.host_responses())


def intel_vendor_report(w: Workload) -> DataFrame:
    return feeds.vendor_report_hits(w.vendor_responses())


def intel_verdicts(w: Workload) -> DataFrame:
    return w.intel(cached=False).verdicts(w.records)


def intel_budgeted(w: Workload) -> DataFrame:
    """Vendor answers count for the scheduled lookups only."""
    return w.intel(settings=INTEL_SETTINGS).verdicts(w.records)


def intel_cache(w: Workload) -> DataFrame:
    return w.intel().verdicts(w.records)


def intel_annotated(w: Workload) -> DataFrame:
    records = w.records
    found = signals.detection_signals(records, w.settings)
    rows = intel.annotate_intel(found, w.intel().verdicts(records))
    return rows.select("seq", "registrable_domain", "threat_intel.*", "remark")


def _unsettled(w: Workload) -> DataFrame:
    given = w.intel()
    return intel.unsettled_domains(
        w.seen,
        NOW,
        cache=given.cache,
        host_responses=given.host_responses,
        feed=given.feed,
        settings=INTEL_SETTINGS,
    )


def lookup_candidates(w: Workload) -> DataFrame:
    return intel.lookup_candidates(_unsettled(w), INTEL_SETTINGS)


def lookup_schedule(w: Workload) -> DataFrame:
    return intel.lookup_schedule(stage(_unsettled(w), "unsettled").df, INTEL_SETTINGS)


def alerts(w: Workload) -> DataFrame:
    return exports.alerts(w.finished, AlertSettings(enabled=True))


def cef_lines(w: Workload) -> DataFrame:
    return exports.cef_lines(w.finished)


def cef_file(w: Workload) -> DataFrame:
    """Written as text and read back."""
    path = new_path(w.spark, "cef")
    exports.write_cef(w.finished, path)
    return w.spark.read.text(path).select(F.col("value").alias("line"))


def csv_flat(w: Workload) -> DataFrame:
    """Written as CSV and read back; the file has no row numbers."""
    path = new_path(w.spark, "csv")
    exports.write_csv(w.finished, path)
    back = exports.read_csv(w.spark, path)
    return back.select(*[_rounded(c) for c in exports.FLAT_COLUMNS])


def json_records(w: Workload) -> DataFrame:
    """Written as JSON lines and read back."""
    path = new_path(w.spark, "json")
    exports.write_json(w.finished, path)
    back = w.spark.read.schema(RECORD_SCHEMA).json(path)
    checked = F.col("threat_intel.checked_at").alias("threat_intel_checked_at")
    flat = exports.flatten(back, "seq", checked)
    columns = [_rounded(c) for c in exports.FLAT_COLUMNS]
    return flat.select("seq", *columns, "threat_intel_checked_at")


def report_blocks(w: Workload) -> DataFrame:
    return exports.report_blocks(w.finished)


def stix_indicators(w: Workload) -> DataFrame:
    indicators = exports.stix_indicators(w.finished, intel.utc_text(NOW))
    return indicators.withColumn("indicator_types", F.element_at("indicator_types", 1))


def stix_bundle(w: Workload) -> DataFrame:
    return exports.stix_bundle(w.finished, intel.utc_text(NOW), BUNDLE_UUID)


def stix_file(w: Workload) -> DataFrame:
    """Written as lines and read back."""
    path = new_path(w.spark, "stix")
    exports.write_stix_bundle(w.finished, path, intel.utc_text(NOW), BUNDLE_UUID)
    return w.spark.read.text(path).select(F.col("value").alias("line"))


def report_file(w: Workload) -> DataFrame:
    """Written as text and read back, line by line with the number of occurrences."""
    path = new_path(w.spark, "report")
    exports.write_report(w.finished, path)
    lines = w.spark.read.text(path).select(F.col("value").alias("line"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("times"))


QUERIES: dict[str, Callable[[Workload], DataFrame]] = {
    "pcap_scan": pcap_scan,
    "dns_log": dns_log,
    "skip_summary": skip_summary,
    "phish_feed_domains": phish_feed_domains,
    "intel_urlhaus": intel_urlhaus,
    "intel_vendor_report": intel_vendor_report,
    "entropy": entropy,
    "domain_parts": domain_parts,
    "flags_decoded": flags_decoded,
    "header_bits": header_bits,
    "base_remark": base_remark,
    "dns_records": dns_records,
    "host_baselines": host_baselines,
    "subdomain_bursts": subdomain_bursts,
    "nxdomain_ratios": nxdomain_ratios,
    "entropy_zscores": entropy_zscores,
    "burst_records": burst_records,
    "nxdomain_records": nxdomain_records,
    "detection_signals": detection_signals,
    "severity": severity,
    "analyze": analyze_all,
    "phish_feed_hits": phish_feed_hits,
    "intel_verdicts": intel_verdicts,
    "intel_cache": intel_cache,
    "intel_budgeted": intel_budgeted,
    "intel_annotated": intel_annotated,
    "lookup_candidates": lookup_candidates,
    "lookup_schedule": lookup_schedule,
    "live_baseline": live_baseline,
    "live_burst": live_burst,
    "live_nxdomain": live_nxdomain,
    "live_detection": live_detection,
    "stream_detection": stream_detection,
    "stream_enriched": stream_enriched,
    "stream_alerts": stream_alerts,
    "alerts": alerts,
    "cef_lines": cef_lines,
    "cef_file": cef_file,
    "csv_flat": csv_flat,
    "json_records": json_records,
    "report_blocks": report_blocks,
    "stix_indicators": stix_indicators,
    "stix_bundle": stix_bundle,
    "stix_file": stix_file,
    "report_file": report_file,
}


def _on_folder(query: Callable[[Workload], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(Workload(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _on_folder(query) for name, query in QUERIES.items()}
