"""From raw DNS log rows to records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.functions.entropy import shannon_entropy
from dnsloom.functions.flags import flag_names
from dnsloom.functions.remarks import base_remark
from dnsloom.operators.names import split_names
from dnsloom.schema import RECORD_COLUMNS, RECORD_SCHEMA
from dnsloom.settings import DetectionSettings, ScaleSettings
from dnsloom.sources.suffix_rules import SuffixRules

# Columns that are not parsed here: the time in seconds, and what later steps fill in.
_FROM_RAW = {
    "timestamp": "ts_us / 1000000 AS timestamp",
    "subdomain_burst": "false AS subdomain_burst",
    **{
        name: f"CAST(NULL AS {RECORD_SCHEMA[name].dataType.simpleString()}) AS {name}"
        for name in (
            "entropy_z_score",
            "subdomain_burst_unique_count",
            "host_nxdomain_ratio",
            "threat_intel",
            "severity",
        )
    },
}


def build_records(
    raw: DataFrame,
    rules: SuffixRules,
    settings: DetectionSettings | None = None,
    scale: ScaleSettings | None = None,
) -> DataFrame:
    """One record per row of `raw` (RAW_SCHEMA), its remark from this row alone."""
    settings = settings or DetectionSettings()
    parts = split_names(raw, rules, normalize_case=settings.normalize_case, scale=scale)
    records = parts.withColumns(
        {"entropy": shannon_entropy("scoring_label"), "flags": flag_names()}
    )
    remark = base_remark(F.col("entropy"), F.col("flags"), settings)
    return records.withColumn("remark", remark).selectExpr(*[_FROM_RAW.get(c, c) for c in RECORD_COLUMNS])
