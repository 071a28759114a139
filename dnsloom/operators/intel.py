"""Threat-intel verdicts as joins over the distinct domains of the records."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.functions.remarks import join_notes
from dnsloom.operators.lookup import lookup_join
from dnsloom.operators.staging import Staged, stage
from dnsloom.schema import VERDICT_TYPE
from dnsloom.settings import IntelSettings, ScaleSettings
from dnsloom.sources.feeds import host_lookup_hits, vendor_report_hits

# Provider names and verdict texts.
HOST_LOOKUP = "urlhaus"
FEED = "openphish"
VENDOR_REPORT = "virustotal"
FEED_DETAIL = "listed in the OpenPhish active feed"
CLEAN_DETAIL = "no match in any enabled feed"


def domains_seen(records: DataFrame) -> DataFrame:
    """domain, first_seq, first_ts_us, record_count of every registrable domain."""
    return (
        records.where(F.col("registrable_domain") != "")
        .groupBy(F.col("registrable_domain").alias("domain"))
        .agg(
            F.min("seq").alias("first_seq"),
            F.min("ts_us").alias("first_ts_us"),
            F.count(F.lit(1)).alias("record_count"),
        )
    )


def feed_hits(domains: DataFrame, feed: DataFrame) -> DataFrame:
    """domain, detail of the `domains` listed in `feed` (one `domain` per row)."""
    listed = domains.select("domain").join(feed.select("domain"), "domain", "left_semi")
    return listed.withColumn("detail", F.lit(FEED_DETAIL))


def fresh_verdicts(
    domains: DataFrame,
    now: float,
    *,
    host_responses: DataFrame | None = None,
    feed: DataFrame | None = None,
    vendor_responses: DataFrame | None = None,
    settings: IntelSettings | None = None,
) -> DataFrame:
    """Verdict per domain: the first provider that confirms it, in a fixed order, else clean.

    A provider whose table is missing or whose setting is off is left out. All tables hold
    one row per domain here, so the joins have no hot keys.
    """
    settings = settings or IntelSettings()
    hits: list[tuple[str, DataFrame]] = []
    if settings.host_lookup_enabled and host_responses is not None:
        hits.append((HOST_LOOKUP, host_lookup_hits(host_responses)))
    if settings.feed_enabled and feed is not None:
        hits.append((FEED, feed_hits(domains, feed)))
    if settings.vendor_report_enabled and vendor_responses is not None:
        hits.append((VENDOR_REPORT, vendor_report_hits(vendor_responses)))

    def verdict(found: bool, source: Column, detail: Column) -> Column:
        return F.struct(
            F.lit(found).alias("is_malicious"),
            source.alias("source"),
            detail.alias("detail"),
            F.lit(float(now)).alias("checked_at"),
        )

    joined = domains.select("domain")
    candidates = []
    for provider, table in hits:
        column = f"__{provider}"
        joined = joined.join(table.withColumnRenamed("detail", column), "domain", "left")
        hit = verdict(True, F.lit(provider), F.col(column))
        candidates.append(F.when(F.col(column).isNotNull(), hit))
    clean = verdict(False, F.lit(None).cast("string"), F.lit(CLEAN_DETAIL))
    chosen = F.coalesce(*candidates, clean).cast(VERDICT_TYPE)
    return joined.select("domain", chosen.alias("v")).select("domain", "v.*")


def provider_hits(
    *,
    host_responses: DataFrame | None = None,
    feed: DataFrame | None = None,
    vendor_responses: DataFrame | None = None,
    settings: IntelSettings | None = None,
) -> DataFrame:
    """domain, source, detail of every domain that a provider confirms: the first one that does.

    For consumers whose domains are not known beforehand; `fresh_verdicts` gives the same for
    domains that are.
    """
    settings = settings or IntelSettings()
    hits = []
    if settings.host_lookup_enabled and host_responses is not None:
        hits.append((HOST_LOOKUP, host_lookup_hits(host_responses)))
    if settings.feed_enabled and feed is not None:
        hits.append((FEED, feed.select("domain", F.lit(FEED_DETAIL).alias("detail"))))
    if settings.vendor_report_enabled and vendor_responses is not None:
        hits.append((VENDOR_REPORT, vendor_report_hits(vendor_responses)))
    if not hits:
        raise ValueError("no provider is enabled that has a table")
    ranked = [
        table.select("domain", F.struct(F.lit(i).alias("rank"), F.lit(name).alias("source"), "detail").alias("hit"))
        for i, (name, table) in enumerate(hits)
    ]
    first = reduce(DataFrame.unionAll, ranked).groupBy("domain").agg(F.min("hit").alias("hit"))
    return first.select("domain", "hit.source", "hit.detail")


def valid_cache(cache: DataFrame, now: float, settings: IntelSettings) -> DataFrame:
    """Rows of the verdict table that are not older than the time to live."""
    return cache.where(F.lit(float(now)) - F.col("checked_at") <= settings.verdict_ttl_seconds)


def domains_to_check(
    domains: DataFrame, cache: DataFrame, now: float, settings: IntelSettings | None = None
) -> DataFrame:
    """The domains without a valid cached verdict, malicious or clean."""
    valid = valid_cache(cache, now, settings or IntelSettings())
    return domains.join(valid.select("domain"), "domain", "left_anti")


def verdicts(
    domains: DataFrame,
    now: float,
    *,
    cache: DataFrame | None = None,
    settings: IntelSettings | None = None,
    **providers: DataFrame | None,
) -> DataFrame:
    """Verdict table for `domains`: the valid cached verdicts, fresh ones for the rest.

    The result is also the next cache. With a lookup budget `domains` are rows of
    `domains_seen`, and only vendor answers for the scheduled lookups count.
    """
    settings = settings or IntelSettings()
    providers = _within_budget(domains, now, cache, settings, providers)
    if cache is None:
        return fresh_verdicts(domains, now, settings=settings, **providers)
    unchecked = domains_to_check(domains, cache, now, settings)
    valid = valid_cache(cache, now, settings)
    kept = valid.join(domains.select("domain"), "domain", "left_semi")
    fresh = fresh_verdicts(unchecked, now, settings=settings, **providers)
    return kept.select("domain", *VERDICT_TYPE.fieldNames()).unionByName(fresh)


def _within_budget(
    seen: DataFrame,
    now: float,
    cache: DataFrame | None,
    settings: IntelSettings,
    providers: dict[str, DataFrame | None],
) -> dict[str, DataFrame | None]:
    """The provider tables, vendor answers cut down to the lookups that a run would make."""
    answers = providers.get("vendor_responses")
    if answers is None or settings.max_lookups is None or not settings.vendor_report_enabled:
        return providers
    unsettled = unsettled_domains(
        seen,
        now,
        cache=cache,
        host_responses=providers.get("host_responses"),
        feed=providers.get("feed"),
        settings=settings,
    )
    made = lookup_schedule(stage(unsettled, "unsettled").df, settings).select("domain")
    return providers | {"vendor_responses": answers.join(made, "domain", "left_semi")}


def annotate_intel(
    records: DataFrame,
    table: DataFrame | Staged,
    scale: ScaleSettings | None = None,
    counted_on: DataFrame | None = None,
) -> DataFrame:
    """Records with the verdict of their registrable domain; a hit adds a note.

    counted_on: the same records in a form that is cheaper to count domains on.
    """
    table = table if isinstance(table, Staged) else stage(table, "verdicts")
    verdict = F.struct(*[F.col(c) for c in VERDICT_TYPE.fieldNames()]).cast(VERDICT_TYPE)
    packed = Staged(table.df.select("domain", verdict.alias("__verdict")))
    joined = lookup_join(
        records,
        packed,
        {"domain": F.nullif("registrable_domain", F.lit(""))},
        spread=F.col("seq"),
        scale=scale or ScaleSettings(),
        counted_on=counted_on,
    )
    found = F.col("__verdict")
    note = F.concat(
        F.lit("domain matches "), found["source"], F.lit(" threat intel: "), found["detail"]
    )
    remark = join_notes(F.col("remark"), F.when(found["is_malicious"], note))
    return joined.withColumns({"threat_intel": found, "remark": remark}).drop("__verdict")


def unsettled_domains(
    seen: DataFrame,
    now: float,
    *,
    cache: DataFrame | None = None,
    host_responses: DataFrame | None = None,
    feed: DataFrame | None = None,
    settings: IntelSettings | None = None,
) -> DataFrame:
    """Rows of `domains_seen` that reach the costly vendor report: neither cached nor
    confirmed by an earlier provider."""
    settings = settings or IntelSettings()
    left = seen if cache is None else domains_to_check(seen, cache, now, settings)
    if settings.host_lookup_enabled and host_responses is not None:
        left = left.join(host_lookup_hits(host_responses), "domain", "left_anti")
    if settings.feed_enabled and feed is not None:
        left = left.join(feed.select("domain"), "domain", "left_anti")
    return left


def lookup_candidates(unsettled: DataFrame, settings: IntelSettings | None = None) -> DataFrame:
    """The domains looked up in one run without spacing: first seen first, within the budget."""
    settings = settings or IntelSettings()
    first = unsettled.orderBy("first_seq")
    if settings.max_lookups is not None:
        first = first.limit(settings.max_lookups)
    return first.select("domain", "first_seq", "first_ts_us")


def lookup_schedule(
    unsettled: DataFrame, settings: IntelSettings | None = None, page: int = 2048
) -> DataFrame:
    """lookup_no, domain, first_seq, first_ts_us of the lookups made under minimum spacing.

    A domain seen less than the interval after the last lookup is passed over, not delayed.
    The clock is the time of first sight. Each round reads the next `page` candidates in time
    order, strictly after the last pick; it ends with at least one pick, so there are at most
    `max_lookups` rounds.
    """
    settings = settings or IntelSettings()
    if settings.max_lookups is None:
        raise ValueError("a schedule needs a lookup budget")
    spacing_us = int(settings.min_interval_seconds * 1_000_000)
    picks: list[tuple[int, str, int, int]] = []
    open_from = None
    while len(picks) < settings.max_lookups:
        later = unsettled
        if picks:
            last_seq, last_ts = picks[-1][2:]
            after = (F.col("first_ts_us") > last_ts) | (
                (F.col("first_ts_us") == last_ts) & (F.col("first_seq") > last_seq)
            )
            later = unsettled.where((F.col("first_ts_us") >= open_from) & after)
        rows = (
            later.select("domain", "first_seq", "first_ts_us")
            .orderBy("first_ts_us", "first_seq")
            .limit(page)
            .collect()
        )
        for row in rows:
            if len(picks) < settings.max_lookups and (
                open_from is None or row.first_ts_us >= open_from
            ):
                picks.append((len(picks) + 1, row.domain, row.first_seq, row.first_ts_us))
                open_from = row.first_ts_us + spacing_us
        if len(rows) < page:
            break
    return unsettled.sparkSession.createDataFrame(
        picks, "lookup_no INT, domain STRING, first_seq BIGINT, first_ts_us BIGINT"
    )


def utc_text(epoch_seconds: float) -> str:
    """Timestamp text with microseconds, UTC."""
    moment = datetime(1970, 1, 1) + timedelta(seconds=epoch_seconds)
    return moment.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
