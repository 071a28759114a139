"""Threat-intel inputs as tables: URL feeds and provider responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.operators.names import split_names
from dnsloom.settings import ScaleSettings
from dnsloom.sources.suffix_rules import SuffixRules


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a URL feed, one column `value`."""
    return spark.read.text(path)


def url_host(url: Column) -> Column:
    """Lower-case host of a URL; NULL where there is none. Text without `//` has none."""
    text = F.regexp_replace(url, r"^\s+|\s+$", "")
    authority = F.regexp_extract(text, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//([^/?#]*)", 1)
    address = F.regexp_replace(authority, r"^.*@", "")
    bracketed = F.regexp_extract(address, r"^\[([^\]]*)\]", 1)
    plain = F.regexp_replace(address, r":.*$", "")
    host = F.when(address.startswith("["), bracketed).otherwise(plain)
    return F.nullif(F.lower(host), F.lit(""))


def feed_domains(
    lines: DataFrame, rules: SuffixRules, scale: ScaleSettings | None = None
) -> DataFrame:
    """Distinct `domain` of a feed: the registrable domain, or the host where there is none."""
    hosts = lines.select(url_host(F.col("value")).alias("host")).where(F.col("host").isNotNull())
    parts = split_names(hosts, rules, "host", scale=scale)
    domain = F.coalesce(F.nullif("registrable_domain", F.lit("")), F.col("host"))
    return parts.select(domain.alias("domain")).distinct()


def host_lookup_hits(responses: DataFrame) -> DataFrame:
    """domain, detail of host-lookup responses that confirm a domain as malicious.

    responses: domain, response (JSON text), error. A failed lookup is no verdict.
    """
    body = F.from_json("response", "query_status STRING, url_count STRING")
    count = F.coalesce(F.col("body.url_count"), F.lit("unknown"))
    detail = F.concat(count, F.lit(" malicious URL(s) on record"))
    return (
        responses.where(F.col("error").isNull())
        .select("domain", body.alias("body"))
        .where(F.col("body.query_status") == "ok")
        .groupBy("domain")
        .agg(F.min(detail).alias("detail"))
    )


def vendor_report_hits(responses: DataFrame) -> DataFrame:
    """domain, detail of domain reports in which any vendor flags the domain."""
    body = F.from_json(
        "response",
        "data STRUCT<attributes: STRUCT<last_analysis_stats: "
        "STRUCT<malicious: BIGINT, suspicious: BIGINT>>>",
    )
    stats = F.col("body.data.attributes.last_analysis_stats")
    reports = responses.where(F.col("error").isNull()).select("domain", body.alias("body"))
    reports = reports.select(
        "domain",
        *[F.coalesce(stats.getField(k), F.lit(0)).alias(k) for k in ("malicious", "suspicious")],
    )
    detail = F.concat(
        F.col("malicious").cast("string"),
        F.lit(" malicious / "),
        F.col("suspicious").cast("string"),
        F.lit(" suspicious vendor flags"),
    )
    return (
        reports.where((F.col("malicious") > 0) | (F.col("suspicious") > 0))
        .groupBy("domain")
        .agg(F.min(detail).alias("detail"))
    )
