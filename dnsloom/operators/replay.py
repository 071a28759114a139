"""Causal detection over a stored table: every record judged by what came before it.

Order is (ts_us, seq). The same operators run inside each micro-batch of the stream, with
`prior` tables that hold what earlier micro-batches left behind.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dnsloom.functions import remarks
from dnsloom.operators.lookup import lookup_join
from dnsloom.operators.ordered import long_groups, ordered_groups
from dnsloom.operators.signals import client_address, finish_remark, has_subdomain, is_query
from dnsloom.operators.staging import Staged, stage
from dnsloom.settings import DetectionSettings, ScaleSettings

_LAST_SEQ = (1 << 63) - 1


@dataclass(frozen=True)
class Moments:
    """Count, mean, sum of squared deviations and range of some values, as columns.

    The range tells a constant history (spread exactly 0) from a nearly constant one.
    """

    n: Column
    mean: Column
    m2: Column
    low: Column
    high: Column

    NAMES = ("n", "mean", "m2", "low", "high")

    @staticmethod
    def of(value: Column, over: Callable[[Column], Column] = lambda c: c) -> Moments:
        """Aggregates of `value`; `over` adds a window to each."""
        n = over(F.count(value))
        return Moments(
            n,
            over(F.avg(value)),
            over(F.var_pop(value)) * n,
            over(F.min(value)),
            over(F.max(value)),
        )

    @staticmethod
    def named(prefix: str) -> Moments:
        return Moments(*[F.col(prefix + name) for name in Moments.NAMES])

    def columns(self, prefix: str) -> dict[str, Column]:
        return {prefix + name: getattr(self, name) for name in Moments.NAMES}

    def merge(self, other: Moments) -> Moments:
        """Moments of both parts together; an absent part has NULLs."""
        n1, n2 = F.coalesce(self.n, F.lit(0)), F.coalesce(other.n, F.lit(0))
        n = n1 + n2
        gap = other.mean - self.mean
        return Moments(
            n,
            F.coalesce(self.mean + gap * n2 / F.nullif(n, F.lit(0)), self.mean, other.mean),
            F.coalesce(
                self.m2 + other.m2 + gap * gap * n1 * n2 / F.nullif(n, F.lit(0)), self.m2, other.m2
            ),
            F.least(self.low, other.low),
            F.greatest(self.high, other.high),
        )

    def stdev(self) -> Column:
        spread = F.sqrt(self.m2 / F.nullif(self.n, F.lit(0)))
        return F.when(self.low == self.high, F.lit(0.0)).otherwise(spread)


def _moments_of_chunks(window: WindowSpec, keys: tuple[str, ...]) -> Moments:
    """Moments of several chunks from the chunk moments `c_*`, over `window`.

    Chunk means are taken relative to one of them, so their squares stay small.
    """
    part = Moments.named("c_")
    origin = F.max("c_mean").over(Window.partitionBy(*keys))
    offset = part.mean - origin
    n = F.sum("c_n").over(window)
    total = F.sum(part.n * offset).over(window)
    squares = F.sum(part.m2 + part.n * offset * offset).over(window)
    return Moments(
        n,
        origin + total / F.nullif(n, F.lit(0)),
        F.when(n > 0, F.greatest(squares - total * total / n, F.lit(0.0))),
        F.min("c_low").over(window),
        F.max("c_high").over(window),
    )


def with_history(
    records: DataFrame,
    scale: ScaleSettings,
    prior: DataFrame | Staged | None = None,
) -> DataFrame:
    """Each record with its client's history: h_* moments of the entropies of earlier queries,
    and `responses`, `nxdomains` among the responses so far, this one included.

    Queries and responses of a client are separate groups of one window, one shuffle.
    prior: side, client, p_* moments, p_responses, p_nxdomains from before these records.
    """
    keys = ("__side", "__client")
    keyed = records.withColumns({"__side": is_query(), "__client": client_address()})
    groups = ordered_groups(keyed, keys, scale, long_keys=long_groups(keyed, keys, scale))
    query_entropy = F.when(is_query(), F.col("entropy"))
    response = F.when(~is_query(), F.lit(1)).otherwise(F.lit(0))
    nxdomain = F.when(~is_query() & (F.col("flags.rcode") == "NXDOMAIN"), 1).otherwise(0)

    window = groups.window()
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    so_far = window.rowsBetween(Window.unboundedPreceding, 0)
    history = Moments.of(query_entropy, lambda c: c.over(before)).columns("h_")
    rows = groups.df.withColumns(
        {
            **history,
            "responses": F.sum(response).over(so_far),
            "nxdomains": F.sum(nxdomain).over(so_far),
        }
    )
    if groups.split:
        rows = groups.with_carry(
            rows,
            {
                **Moments.of(query_entropy).columns("c_"),
                "c_responses": F.sum(response),
                "c_nxdomains": F.sum(nxdomain),
            },
            lambda earlier, later: {
                **_moments_of_chunks(earlier, keys).columns("carry_"),
                "carry_responses": F.sum("c_responses").over(earlier),
                "carry_nxdomains": F.sum("c_nxdomains").over(earlier),
            },
        )
        rows = _add_history(rows, "carry_")
    if prior is not None:
        rows = lookup_join(
            rows,
            prior,
            {"side": F.col("__side"), "client": F.col("__client")},
            spread=F.col("seq"),
            scale=scale,
            counted_on=keyed,
            label="prior-clients",
        )
        rows = _add_history(rows, "p_")
    added = [*history, "responses", "nxdomains"]
    return rows.select(*records.columns, *added)


def _add_history(rows: DataFrame, prefix: str) -> DataFrame:
    merged = Moments.named(prefix).merge(Moments.named("h_"))
    counts = {
        name: F.col(name) + F.coalesce(F.col(prefix + name), F.lit(0))
        for name in ("responses", "nxdomains")
    }
    return rows.withColumns({**merged.columns("h_"), **counts})


def live_baseline(
    records: DataFrame,
    settings: DetectionSettings,
    scale: ScaleSettings,
    prior: DataFrame | Staged | None = None,
) -> DataFrame:
    """Records with entropy_z_score and host_nxdomain_ratio from the client's history."""
    rows = with_history(records, scale, prior)
    past = Moments.named("h_")
    z = remarks.z_score(F.col("entropy"), past.mean, past.stdev())
    trained = is_query() & (past.n >= settings.min_baseline_samples)
    seen = ~is_query() & (F.col("responses") >= settings.min_nxdomain_samples)
    return rows.withColumns(
        {
            "entropy_z_score": F.when(trained, z),
            "host_nxdomain_ratio": F.when(seen, F.col("nxdomains") / F.col("responses")),
        }
    )


def sliding_unique(
    sightings: DataFrame, window_us: int, scale: ScaleSettings, prior: DataFrame | None = None
) -> DataFrame:
    """unique_count per sighting: distinct subdomains of its domain in [ts - window, ts].

    sightings: registrable_domain, subdomain, ts_us, seq. A subdomain is present from a first
    sighting until `window_us` after a last one, when the next is further away than that. Each
    such stretch gives +1 at its start and -1 at its end; the count is the running sum per
    domain. An end sorts after all sightings of the same instant, because a sighting exactly
    one window old still counts. Two sorts, no set is ever held.
    prior: registrable_domain, subdomain, ts_us of the latest sightings before these.
    """
    rows = sightings.select(
        "registrable_domain", "subdomain", "ts_us", "seq", F.lit(False).alias("__old")
    )
    if prior is not None:
        old = prior.select(
            "registrable_domain", "subdomain", "ts_us", F.lit(-1).alias("seq"), F.lit(True).alias("__old")
        )
        rows = rows.unionByName(old)

    # A name has no more rows than its domain: without a long domain there is no long name.
    pair = ["registrable_domain", "subdomain"]
    long_domains = long_groups(rows, pair[:1], scale)
    long_names = None
    if long_domains is not None:
        busy = rows.join(F.broadcast(long_domains.df), pair[:1], "left_semi")
        long_names = long_groups(busy, pair, scale)
    names = ordered_groups(rows, pair, scale, long_keys=long_names)
    order = names.window()
    stretches = names.df.withColumns(
        {"__prev": F.lag("ts_us").over(order), "__next": F.lead("ts_us").over(order)}
    )
    if names.split:
        stretches = names.with_carry(
            stretches,
            {"c_first": F.min("ts_us"), "c_last": F.max("ts_us")},
            lambda earlier, later: {
                "carry_prev": F.max("c_last").over(earlier),
                "carry_next": F.min("c_first").over(later),
            },
        )
        stretches = stretches.withColumns(
            {
                "__prev": F.coalesce("__prev", "carry_prev"),
                "__next": F.coalesce("__next", "carry_next"),
            }
        )
    ts = F.col("ts_us")
    starts = F.col("__prev").isNull() | (ts - F.col("__prev") > window_us)
    ends = F.col("__next").isNull() | (F.col("__next") - ts > window_us)
    sighting = F.struct(
        ts.alias("ts_us"),
        F.col("seq"),
        F.when(starts, 1).otherwise(0).alias("__delta"),
        F.col("subdomain"),
        (~F.col("__old")).alias("__shown"),
    )
    end = F.struct(
        (ts + window_us).alias("ts_us"),
        F.lit(_LAST_SEQ).alias("seq"),
        F.lit(-1).alias("__delta"),
        F.lit(None).cast("string").alias("subdomain"),
        F.lit(False).alias("__shown"),
    )
    events = stretches.select(
        "registrable_domain", F.inline(F.array_compact(F.array(sighting, F.when(ends, end))))
    )

    if long_domains is not None:
        # Cuts are taken from the events themselves: ends lie a window later than sightings.
        events = stage(events, "sweep-events").df
    domains = ordered_groups(events, pair[:1], scale, long_keys=long_domains)
    running = domains.window().rowsBetween(Window.unboundedPreceding, 0)
    counted = domains.df.withColumn("unique_count", F.sum("__delta").over(running))
    if domains.split:
        counted = domains.with_carry(
            counted,
            {"c_delta": F.sum("__delta")},
            lambda earlier, later: {"carry_delta": F.sum("c_delta").over(earlier)},
        )
        carried = F.coalesce("carry_delta", F.lit(0))
        counted = counted.withColumn("unique_count", F.col("unique_count") + carried)
    return counted.where("__shown").select(
        "registrable_domain", "subdomain", "ts_us", "seq", "unique_count"
    )


def burst_sightings(records: DataFrame) -> DataFrame:
    """The narrow rows that `sliding_unique` needs."""
    return records.where(has_subdomain()).select("registrable_domain", "subdomain", "ts_us", "seq")


def live_detection(
    records: DataFrame,
    settings: DetectionSettings | None = None,
    scale: ScaleSettings | None = None,
    *,
    prior_clients: DataFrame | Staged | None = None,
    prior_sightings: DataFrame | None = None,
) -> DataFrame:
    """Records with all three causal signals and the final remark.

    The records themselves are shuffled once, by client. Bursts are computed on four narrow
    columns, and only sightings over the threshold are joined back, by seq.
    """
    settings = settings or DetectionSettings()
    scale = scale or ScaleSettings()
    counts = sliding_unique(
        burst_sightings(records), settings.burst_window_us, scale, prior_sightings
    )
    flagged = counts.where(
        F.col("unique_count") >= settings.burst_unique_subdomain_threshold
    ).select(F.col("seq").alias("flagged_seq"), "unique_count", F.lit(1).alias("matches"))
    rows = live_baseline(records, settings, scale, prior_clients)
    rows = lookup_join(
        rows,
        flagged,
        {"flagged_seq": F.col("seq")},
        spread=F.col("seq"),
        scale=scale,
        weight="matches",
        label="flagged-sightings",
    )
    rows = rows.withColumns(
        {
            "subdomain_burst": F.col("unique_count").isNotNull(),
            "subdomain_burst_unique_count": F.col("unique_count"),
        }
    )
    return finish_remark(rows, settings)
