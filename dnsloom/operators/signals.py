"""Whole-table detection: host baselines, subdomain bursts, NXDOMAIN ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.functions import remarks
from dnsloom.operators.lookup import lookup_join
from dnsloom.schema import RECORD_COLUMNS
from dnsloom.settings import DetectionSettings, ScaleSettings

def is_query() -> Column:
    return F.col("flags.qr") == "QUERY"


def client_address() -> Column:
    """The client of a message: it sends queries and receives responses."""
    return F.when(is_query(), F.col("source_ip")).otherwise(F.col("destination_ip"))


def has_subdomain() -> Column:
    """Rows that count for bursts: queries with both name parts."""
    return is_query() & (F.col("registrable_domain") != "") & (F.col("subdomain") != "")


def time_bucket(window_us: int) -> Column:
    """Number of the fixed window that holds ts_us, exact in integers."""
    ts = F.col("ts_us")
    return ((ts - F.pmod(ts, F.lit(window_us))) / F.lit(window_us)).cast("long")


def client_stats(records: DataFrame) -> DataFrame:
    """Per (is_query, client): rows, entropy mean and population stdev, NXDOMAIN rows.

    Baselines and ratios share this one two-phase aggregate: map-side partials absorb a
    host that sends a third of all rows.
    """
    query_entropy = F.when(is_query(), F.col("entropy"))
    return records.groupBy(is_query().alias("is_query"), client_address().alias("client")).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.avg(query_entropy).alias("mean"),
        F.stddev_pop(query_entropy).alias("stdev"),
        F.count_if(F.col("flags.rcode") == "NXDOMAIN").alias("nxdomain_count"),
    )


def host_baselines(records: DataFrame, min_samples: int) -> DataFrame:
    """source_ip, mean, stdev, sample_count of hosts with enough queries."""
    stats = client_stats(records.where(is_query()))
    return stats.where(F.col("sample_count") >= min_samples).select(
        F.col("client").alias("source_ip"), "mean", "stdev", "sample_count"
    )


def nxdomain_ratios(records: DataFrame, min_samples: int) -> DataFrame:
    """client, ratio, sample_count of clients with enough responses."""
    responses = records.where(~is_query())
    counts = responses.groupBy(F.col("destination_ip").alias("client")).agg(
        F.count_if(F.col("flags.rcode") == "NXDOMAIN").alias("nxdomain_count"),
        F.count(F.lit(1)).alias("sample_count"),
    )
    return counts.where(F.col("sample_count") >= min_samples).select(
        "client", (F.col("nxdomain_count") / F.col("sample_count")).alias("ratio"), "sample_count"
    )


def subdomain_bursts(
    records: DataFrame, window_us: int, unique_threshold: int, *, approximate: float | None = None
) -> DataFrame:
    """registrable_domain, bucket, unique_count, query_count of buckets over the threshold.

    The exact distinct count is shuffled by (domain, bucket, subdomain) first, so one hot
    domain spreads over all tasks. approximate: relative error of a sketch, if wanted.
    """
    distinct = (
        F.count_distinct("subdomain")
        if approximate is None
        else F.approx_count_distinct("subdomain", approximate)
    )
    return (
        records.where(has_subdomain())
        .groupBy("registrable_domain", time_bucket(window_us).alias("bucket"))
        .agg(distinct.alias("unique_count"), F.count(F.lit(1)).alias("query_count"))
        .where(F.col("unique_count") >= unique_threshold)
    )


def with_baseline(
    records: DataFrame, settings: DetectionSettings, scale: ScaleSettings
) -> DataFrame:
    """Join of each record to its client's statistics; sets z-score and NXDOMAIN ratio."""
    enough = F.when(
        F.col("is_query"), F.col("sample_count") >= settings.min_baseline_samples
    ).otherwise(F.col("sample_count") >= settings.min_nxdomain_samples)
    stats = client_stats(records).where(enough).withColumnRenamed("is_query", "side")
    stats = stats.withColumn("responses", F.col("sample_count"))
    joined = lookup_join(
        records,
        stats,
        {"side": is_query(), "client": client_address()},
        spread=F.col("seq"),
        scale=scale,
        weight="sample_count",
        label="client-stats",
    )
    z = remarks.z_score(F.col("entropy"), F.col("mean"), F.col("stdev"))
    ratio = F.col("nxdomain_count") / F.col("responses")
    return joined.withColumns(
        {
            "entropy_z_score": F.when(is_query(), z),
            "host_nxdomain_ratio": F.when(~is_query(), ratio),
        }
    ).drop("mean", "stdev", "nxdomain_count")


def with_bursts(
    records: DataFrame,
    settings: DetectionSettings,
    scale: ScaleSettings,
    counted_on: DataFrame | None = None,
) -> DataFrame:
    """Join of each query to its flagged bucket; sets the two burst columns.

    counted_on: the same records before other lookups were added, to count on.
    """
    window_us = settings.burst_window_us
    bursts = subdomain_bursts(
        records if counted_on is None else counted_on,
        window_us,
        settings.burst_unique_subdomain_threshold,
    )
    candidate = has_subdomain()
    joined = lookup_join(
        records,
        bursts.withColumnRenamed("registrable_domain", "domain"),
        {
            "domain": F.when(candidate, F.col("registrable_domain")),
            "bucket": F.when(candidate, time_bucket(window_us)),
        },
        spread=F.col("seq"),
        scale=scale,
        weight="query_count",
        label="bursts",
    )
    return joined.withColumns(
        {
            "subdomain_burst": F.col("unique_count").isNotNull(),
            "subdomain_burst_unique_count": F.col("unique_count"),
        }
    ).drop("unique_count", "query_count")


def finish_remark(records: DataFrame, settings: DetectionSettings) -> DataFrame:
    """Final remark from the signal columns; `responses` backs the NXDOMAIN note."""
    base = remarks.base_remark(
        F.col("entropy"), F.col("flags"), settings, z=F.col("entropy_z_score")
    )
    burst = remarks.burst_note(
        F.col("subdomain_burst_unique_count"),
        F.col("registrable_domain"),
        settings.burst_window_seconds,
    )
    nxdomain = remarks.nxdomain_note(
        F.col("destination_ip"),
        F.col("host_nxdomain_ratio"),
        F.col("responses"),
        settings.nxdomain_ratio_threshold,
    )
    remark = remarks.join_notes(base, burst, nxdomain)
    return records.withColumn("remark", remark).select(*RECORD_COLUMNS)


def detection_signals(
    records: DataFrame,
    settings: DetectionSettings | None = None,
    scale: ScaleSettings | None = None,
) -> DataFrame:
    """Records with all three whole-table signals and the final remark.

    Two staged aggregates, then one pass over the records with two lookups.
    """
    settings = settings or DetectionSettings()
    scale = scale or ScaleSettings()
    signals = with_baseline(records, settings, scale)
    signals = with_bursts(signals, settings, scale, counted_on=records)
    return finish_remark(signals, settings)
