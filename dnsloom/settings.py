"""Tunable settings, passed to operators as frozen dataclasses."""

from __future__ import annotations

from dataclasses import dataclass

# Defaults of the detection, intel, alerting and forwarding steps.
ENTROPY_THRESHOLD = 3.5
Z_SCORE_THRESHOLD = 3.0
MIN_BASELINE_SAMPLES = 5
BURST_WINDOW_SECONDS = 60
BURST_UNIQUE_SUBDOMAIN_THRESHOLD = 15
NXDOMAIN_RATIO_THRESHOLD = 0.5
MIN_NXDOMAIN_SAMPLES = 5
VERDICT_TTL_SECONDS = 3600.0
REPORT_MIN_INTERVAL_SECONDS = 15.0
REPORT_MAX_LOOKUPS = 20
SEVERITY_LEVELS = ["info", "medium", "high", "critical"]
ALERT_MIN_SEVERITY = "high"
FORWARD_MIN_SEVERITY = "info"


@dataclass(frozen=True)
class DetectionSettings:
    entropy_threshold: float = ENTROPY_THRESHOLD
    z_score_threshold: float = Z_SCORE_THRESHOLD
    min_baseline_samples: int = MIN_BASELINE_SAMPLES
    burst_window_seconds: int = BURST_WINDOW_SECONDS
    burst_unique_subdomain_threshold: int = BURST_UNIQUE_SUBDOMAIN_THRESHOLD
    nxdomain_ratio_threshold: float = NXDOMAIN_RATIO_THRESHOLD
    min_nxdomain_samples: int = MIN_NXDOMAIN_SAMPLES
    # Resolvers that randomise letter case make one domain look like many keys.
    normalize_case: bool = False

    @property
    def burst_window_us(self) -> int:
        return int(self.burst_window_seconds * 1_000_000)


@dataclass(frozen=True)
class IntelSettings:
    """Which providers count, how long a verdict lives, how vendor lookups are spaced.

    max_lookups: most vendor lookups of a run; None if the answers are all there already and
    neither budget nor spacing applies.
    """

    host_lookup_enabled: bool = True
    feed_enabled: bool = True
    vendor_report_enabled: bool = True
    verdict_ttl_seconds: float = VERDICT_TTL_SECONDS
    min_interval_seconds: float = REPORT_MIN_INTERVAL_SECONDS
    max_lookups: int | None = REPORT_MAX_LOOKUPS


@dataclass(frozen=True)
class AlertSettings:
    """Sending is off unless asked for."""

    enabled: bool = False
    webhook_url: str | None = None
    min_severity: str = ALERT_MIN_SEVERITY


@dataclass(frozen=True)
class ForwardSettings:
    """Sending is off unless asked for."""

    enabled: bool = False
    min_severity: str = FORWARD_MIN_SEVERITY
    vendor: str = "dnsloom"
    product: str = "dnsloom"
    version: str = "0.1.0"


@dataclass(frozen=True)
class ScaleSettings:
    """Sizes at which an operator changes its physical plan (never its result).

    broadcast_rows: a lookup table of at most this many rows is broadcast.
    hot_rows: a key with at least this many rows is handled apart from the others;
        there can be at most total_rows / hot_rows such keys.
    group_rows: an ordered group longer than this is cut into time chunks.
    max_chunks: most chunks the time axis is cut into.
    """

    broadcast_rows: int = 1_000_000
    hot_rows: int = 5_000_000
    group_rows: int = 2_000_000
    max_chunks: int = 8192
