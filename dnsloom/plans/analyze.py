"""The whole batch job: raw rows in, finished records out, then the sinks."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from dnsloom.operators import exports
from dnsloom.operators.intel import annotate_intel, domains_seen, utc_text, verdicts
from dnsloom.operators.records import build_records
from dnsloom.operators.signals import detection_signals
from dnsloom.operators.staging import stage
from dnsloom.plans.delivery import deliver
from dnsloom.settings import (
    AlertSettings,
    DetectionSettings,
    ForwardSettings,
    IntelSettings,
    ScaleSettings,
)
from dnsloom.sources.suffix_rules import SuffixRules


@dataclass(frozen=True)
class IntelTables:
    """Provider tables of one run; `now` is the time of the check (in a stream, None is the time of
    each micro-batch)."""

    now: float | None
    host_responses: DataFrame | None = None
    feed: DataFrame | None = None
    vendor_responses: DataFrame | None = None
    cache: DataFrame | None = None
    settings: IntelSettings = field(default_factory=IntelSettings)

    def verdicts(self, records: DataFrame) -> DataFrame:
        return verdicts(
            domains_seen(records),
            self.now,
            cache=self.cache,
            settings=self.settings,
            host_responses=self.host_responses,
            feed=self.feed,
            vendor_responses=self.vendor_responses,
        )


@dataclass(frozen=True)
class Sinks:
    """Where finished records go; a path or sender that is None is skipped."""

    json: str | None = None
    csv: str | None = None
    report: str | None = None
    cef: str | None = None
    stix: str | None = None
    stix_now: float = 0.0
    bundle_uuid: str = ""
    alerts: AlertSettings | None = None
    alert_sender: Callable[[str, str], None] | None = None
    forward: ForwardSettings | None = None
    forward_sender: Callable[[str], None] | None = None


def analyze(
    raw: DataFrame,
    rules: SuffixRules,
    settings: DetectionSettings | None = None,
    intel: IntelTables | None = None,
    scale: ScaleSettings | None = None,
) -> DataFrame:
    """Finished records of a raw DNS log: parsed, scored, enriched when asked, graded.

    Names are parsed and scored once, into a stored table; the aggregates and the lookups
    then each read the few columns they need.
    """
    records = stage(build_records(raw, rules, settings, scale), "records").df
    finished = detection_signals(records, settings, scale)
    if intel is not None:
        finished = annotate_intel(finished, intel.verdicts(records), scale, counted_on=records)
    return exports.with_severity(finished)


def write_outputs(finished: DataFrame, sinks: Sinks) -> None:
    """Write every configured sink. Pass a stored table: each sink scans it once."""
    if sinks.alerts is not None and sinks.alert_sender is not None and sinks.alerts.webhook_url:
        url, sender = sinks.alerts.webhook_url, sinks.alert_sender
        payloads = exports.alerts(finished, sinks.alerts).select("payload")
        deliver(payloads, lambda payload: sender(url, payload))
    if sinks.forward is not None and sinks.forward_sender is not None:
        deliver(exports.cef_lines(finished, sinks.forward).select("line"), sinks.forward_sender)
    if sinks.report:
        exports.write_report(finished, sinks.report)
    if sinks.csv:
        exports.write_csv(finished, sinks.csv)
    if sinks.cef:
        exports.write_cef(finished, sinks.cef, sinks.forward)
    if sinks.stix:
        exports.write_stix_bundle(
            finished, sinks.stix, utc_text(sinks.stix_now), sinks.bundle_uuid
        )
    if sinks.json:
        exports.write_json(finished, sinks.json)
