"""Keyed state of the live engine, kept in Spark's state store (RocksDB).

One `transformWithState` operator, keyed by (kind, key), holds

- `client`: per bucket of clients, for each side and client count, mean, squared deviations and
  range of its query entropies, and its responses so far and NXDOMAINs among them (list state);
- `domain`: per lane of a registrable domain, the latest sighting of each subdomain that is still
  inside the domain's window (map state);
- `verdict`: per bucket of domains, for each the verdict that holds and when it was made (list
  state).

Python is called once per key, which costs milliseconds, so clients and verdicts share keys: one of
`buckets` each, by hash. A bucket is read and written as a whole.

A micro-batch hands it few rows: what a task has seen of a client or a subdomain is added up in
Arrow batches first, so a hot key arrives as one row per batch. It returns what was stored for the
clients and domains that the micro-batch touches, as it was before, and takes up what is new. State
of keys that are not touched is neither read nor written.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dnsloom.operators.signals import client_address, has_subdomain, is_query

CLIENT, DOMAIN, VERDICT = "client", "domain", "verdict"

_MOMENTS = "n bigint, mean double, m2 double, low double, high double"
_COUNTERS = "responses bigint, nxdomains bigint"
# What arrives at the operator. key: bucket of a client or verdict, lane and domain of a sighting.
# name: client, subdomain or domain. side: true for queries. The verdict is the one that the
# providers would give now.
UPDATE = (
    "kind string, key string, side boolean, name string, ts_us bigint, "
    f"{_MOMENTS}, {_COUNTERS}, is_malicious boolean, source string, detail string, checked_at double"
)
# What it returns: the same columns with what was stored before, or for verdicts what holds now.
STORED = UPDATE
_COLUMNS = [c.split()[0] for c in UPDATE.split(", ")]
_SUMS = ["n", "mean", "m2", "low", "high", "responses", "nxdomains"]
_VERDICT = ["is_malicious", "source", "detail", "checked_at"]
# Rows handed on at once.
_ROWS = 10_000


def _framed(columns: dict | pd.DataFrame, **constant) -> pd.DataFrame:
    """Columns of `UPDATE` with types that keep missing values apart from numbers."""
    given = pd.DataFrame(columns).assign(**constant)
    out = {}
    for field in UPDATE.split(", "):
        name, kind = field.split()
        values = given[name] if name in given else pd.Series([None] * len(given), index=given.index, dtype=object)
        if kind == "string":
            out[name] = values.astype(object).where(values.notna(), None)
        else:
            out[name] = values.astype({"bigint": "Int64", "double": "Float64", "boolean": "boolean"}[kind])
    return pd.DataFrame(out)


@dataclass(frozen=True)
class StateSettings:
    """lanes: parts of a domain's sightings; more of them spread a domain with very many names.
    window_us, late_us: how old sightings may get, counted from their domain's newest.
    idle_seconds: clients and domains not seen for so long, by the clock of the machine that
        plans micro-batches, are let go; None keeps them.
    verdict_ttl_seconds: age up to which a verdict holds.
    now: the clock of verdicts in epoch seconds; None takes the time of the micro-batch.
    """

    window_us: int
    late_us: int = 0
    lanes: int = 4
    idle_seconds: float | None = None
    verdict_ttl_seconds: float = 3600.0
    now: float | None = None


def client_key(side: Column, client: Column) -> Column:
    return F.concat(F.when(side, "q ").otherwise("r "), client)


def bucket(name: Column, buckets: int) -> Column:
    """Key of a client or of a domain's verdict."""
    return F.pmod(F.xxhash64(name), F.lit(buckets)).cast("string")


def updates(records: DataFrame, lanes: int, buckets: int) -> DataFrame:
    """What a micro-batch of records says about each client and domain, added up per Arrow batch.

    The sightings of a domain go to the lane of their name; a row without a name goes to each lane
    with the domain's newest time, so that all lanes return what they hold.
    """
    client = client_key(is_query(), client_address())
    known = F.nullif("registrable_domain", F.lit(""))
    narrow = records.select(
        is_query().alias("side"),
        client.alias("client"),
        bucket(client, buckets).alias("client_bucket"),
        F.col("entropy"),
        (~is_query() & (F.col("flags.rcode") == "NXDOMAIN")).alias("nxdomain"),
        F.when(has_subdomain(), F.col("registrable_domain")).alias("domain"),
        F.col("subdomain").alias("name"),
        known.alias("known"),
        bucket(known, buckets).alias("known_bucket"),
        F.pmod(F.xxhash64("subdomain"), F.lit(lanes)).cast("int").alias("lane"),
        "ts_us",
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            parts = [_framed(p) for p in (_clients(rows), _sightings(rows, lanes), _known(rows))]
            yield pd.concat(parts, ignore_index=True)

    return narrow.mapInPandas(run, UPDATE)


def _clients(rows: pd.DataFrame) -> pd.DataFrame:
    named = rows[rows["client"].notna()]
    side = named["side"].astype(bool)
    named = named.assign(
        side=side,
        value=named["entropy"].where(side),
        response=(~side).astype("int64"),
        nx=named["nxdomain"].fillna(False).astype(bool).astype("int64"),
    )
    grouped = named.groupby("client", sort=False)
    mean = grouped["value"].mean()
    apart = (named["value"] - named["client"].map(mean)).pow(2).groupby(named["client"], sort=False)
    out = pd.DataFrame(
        {
            "key": grouped["client_bucket"].first(),
            "side": grouped["side"].first(),
            "ts_us": grouped["ts_us"].max(),
            "n": grouped["value"].count(),
            "mean": mean,
            "m2": apart.sum(),
            "low": grouped["value"].min(),
            "high": grouped["value"].max(),
            "responses": grouped["response"].sum(),
            "nxdomains": grouped["nx"].sum(),
        }
    )
    return out.rename_axis("name").reset_index().assign(kind=CLIENT)


def _sightings(rows: pd.DataFrame, lanes: int) -> pd.DataFrame:
    seen = rows[rows["domain"].notna()]
    last = seen.groupby(["domain", "lane", "name"], sort=False)["ts_us"].max().reset_index()
    newest = last.groupby("domain", sort=False)["ts_us"].max().reset_index()
    touch = newest.merge(pd.DataFrame({"lane": range(lanes)}), how="cross").assign(name=None)
    both = pd.concat([last, touch], ignore_index=True)
    key = both["lane"].astype(str) + " " + both["domain"].astype(str)
    return pd.DataFrame({"kind": DOMAIN, "key": key, "name": both["name"], "ts_us": both["ts_us"]})


def _known(rows: pd.DataFrame) -> pd.DataFrame:
    known = rows[rows["known"].notna()].drop_duplicates("known")
    return pd.DataFrame({"key": known["known_bucket"], "name": known["known"]}).assign(kind=VERDICT)


def merged(old: tuple, new: tuple) -> tuple:
    """Moments and counters of both parts: (n, mean, m2, low, high, responses, nxdomains)."""
    n = old[0] + new[0]
    counts = (old[5] + new[5], old[6] + new[6])
    if not old[0] or not new[0]:
        return (*(old if old[0] else new)[:5], *counts)
    gap = new[1] - old[1]
    mean = old[1] + gap * new[0] / n
    m2 = old[2] + new[2] + gap * gap * old[0] * new[0] / n
    return (n, mean, m2, min(old[3], new[3]), max(old[4], new[4]), *counts)


class KeyedState(StatefulProcessor):
    """The three kinds of state; see the module."""

    def __init__(self, settings: StateSettings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        idle = self.settings.idle_seconds
        ttl = None if idle is None else max(1, int(idle * 1000))
        self.idle_ms = ttl
        # seen_ms: the micro-batch that last had a record of this client.
        self.client = handle.getListState(
            CLIENT, f"name string, side boolean, {_MOMENTS}, {_COUNTERS}, seen_ms bigint", ttl
        )
        self.sightings = handle.getMapState(DOMAIN, "name string", "ts_us bigint", ttl)
        holds = None if self.settings.now is not None else max(1, int(self.settings.verdict_ttl_seconds * 1000))
        self.verdict = handle.getListState(
            VERDICT, "name string, is_malicious boolean, source string, detail string, checked_at double", holds
        )

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        handler = {CLIENT: self._client, DOMAIN: self._domain, VERDICT: self._verdict}[key[0]]
        for out in handler(rows, timerValues):
            rows_out = len(next(iter(out.values())))
            whole = out | {"kind": [key[0]] * rows_out, "key": [key[1]] * rows_out}
            # Plain objects: a typed column a group costs more than the state itself.
            yield pd.DataFrame({c: whole.get(c, [None] * rows_out) for c in _COLUMNS}, dtype=object)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        """Verdicts that are known before the stream starts."""
        rows = zip(*(initialState[c].tolist() for c in ("name", *_VERDICT)), strict=True)
        self.verdict.appendList([tuple(_plain(v) for v in row) for row in rows])

    def _client(self, rows, timerValues) -> Iterator[dict]:
        now = timerValues.getCurrentProcessingTimeInMs()
        kept = {
            name: (side, tuple(sums), seen)
            for name, side, *sums, seen in self.client.get()
            if self.idle_ms is None or now < seen + self.idle_ms
        }
        fresh: dict[str, tuple] = {}
        for frame in rows:
            for name, side, *part in zip(*(frame[c].tolist() for c in ("name", "side", *_SUMS)), strict=True):
                n, *spread, responses, nxdomains = (_plain(v) for v in part)
                new = (int(n), *spread, int(responses), int(nxdomains))
                _, total, _ = fresh.get(name) or kept.get(name) or (None, None, None)
                fresh[name] = (_plain(side), new if total is None else merged(total, new), now)
        known = [name for name in fresh if name in kept]
        for start in range(0, len(known), _ROWS):
            part = known[start : start + _ROWS]
            columns = zip(*(kept[name][1] for name in part), strict=True)
            sides = [kept[name][0] for name in part]
            yield {"name": part, "side": sides, **{c: list(v) for c, v in zip(_SUMS, columns, strict=True)}}
        self.client.put([(name, side, *sums, seen) for name, (side, sums, seen) in {**kept, **fresh}.items()])

    def _domain(self, rows, timerValues) -> Iterator[dict]:
        stored = {k[0]: v[0] for k, v in self.sightings.iterator()}
        names = list(stored)
        for start in range(0, len(names), _ROWS):
            part = names[start : start + _ROWS]
            yield {"name": part, "ts_us": [stored[n] for n in part]}
        newest = max(stored.values(), default=None)
        fresh: dict[str, int] = {}
        for frame in rows:
            for name, at in zip(frame["name"], frame["ts_us"], strict=True):
                newest = int(at) if newest is None else max(newest, int(at))
                if name is not None and name == name and at > max(fresh.get(name, at - 1), stored.get(name, at - 1)):
                    fresh[name] = int(at)
        oldest = newest - self.settings.window_us - self.settings.late_us
        for name, at in fresh.items():
            if at >= oldest:
                self.sightings.updateValue((name,), (at,))
        for name, at in stored.items():
            if max(at, fresh.get(name, at)) < oldest:
                self.sightings.removeKey((name,))

    def _verdict(self, rows, timerValues) -> Iterator[dict]:
        now = self.settings.now
        now = timerValues.getCurrentProcessingTimeInMs() / 1000 if now is None else now
        held: dict[str, tuple] = {}
        for name, *verdict in self.verdict.get():
            if not now - verdict[-1] > self.settings.verdict_ttl_seconds:
                held.setdefault(name, tuple(verdict))
        asked: dict[str, tuple] = {}
        made = False
        for frame in rows:
            for name, *found in zip(*(frame[c].tolist() for c in ("name", *_VERDICT[:3])), strict=True):
                if name not in held:
                    held[name] = (*(_plain(v) for v in found), float(now))
                    made = True
                asked[name] = held[name]
        names = list(asked)
        for start in range(0, len(names), _ROWS):
            part = names[start : start + _ROWS]
            columns = zip(*(asked[name] for name in part), strict=True)
            yield {"name": part, **{c: list(v) for c, v in zip(_VERDICT, columns, strict=True)}}
        if made:
            self.verdict.put([(name, *verdict) for name, verdict in held.items()])


def _plain(value):
    """A Python value; None for missing ones."""
    if value is None or value is pd.NA or value != value:
        return None
    return value.item() if hasattr(value, "item") else value


def keyed_state(
    rows: DataFrame, settings: StateSettings, buckets: int, verdicts: DataFrame | None = None
) -> DataFrame:
    """The operator over a stream of `UPDATE` rows. verdicts: ones that hold before it starts
    (domain and verdict columns)."""
    initial = None
    if verdicts is not None:
        domain = F.col("domain")
        initial = verdicts.select(
            F.lit(VERDICT).alias("kind"), bucket(domain, buckets).alias("key"), domain.alias("name"), *_VERDICT
        )
        initial = initial.groupBy("kind", "key")
    return rows.groupBy("kind", "key").transformWithStateInPandas(
        KeyedState(settings), STORED, "append", "ProcessingTime", initialState=initial
    )
