"""Live detection: Structured Streaming over arriving DNS logs.

One streaming query parses the records and keeps what it knows of clients, domains and verdicts in
Spark's state store (`streaming.state`). Each micro-batch is the parsed records together with
what was stored for the keys that they touch, and runs the causal operators of
`operators.replay` on the two. Its output goes to a folder of its own: a micro-batch that is run
again after a failure starts from the same version of the state and overwrites the same files, so
every record comes out exactly once. A micro-batch reads the state of the keys it touches: of a
domain its sightings, of clients and verdicts whole buckets, which `buckets` keeps small.

A client or domain with more than `group_rows` rows in a micro-batch is cut into time chunks
like in a stored table. A domain's sightings that left its own window are let go: no other domain
and no clock but its own newest record moves it. Clients and domains are let go only after
`idle_seconds` without a record, if that is set, by the clock that plans the micro-batches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from dnsloom.operators import exports
from dnsloom.operators.intel import CLEAN_DETAIL, annotate_intel, provider_hits
from dnsloom.operators.records import build_records
from dnsloom.operators.replay import live_detection
from dnsloom.operators.staging import Staged, scratch, stage
from dnsloom.plans.analyze import IntelTables
from dnsloom.plans.delivery import deliver
from dnsloom.schema import RECORD_SCHEMA
from dnsloom.settings import AlertSettings, DetectionSettings, ForwardSettings, ScaleSettings
from dnsloom.sources.suffix_rules import SuffixRules
from dnsloom.streaming.state import CLIENT, DOMAIN, STORED, VERDICT, StateSettings, keyed_state, updates

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _with_candidates(rows: DataFrame, hits: Staged, scale: ScaleSettings) -> DataFrame:
    """State updates, those of verdicts with what the providers say of the domain."""
    named = hits.df.withColumnsRenamed({"domain": "hit_domain", "source": "hit_source", "detail": "hit_detail"})
    side = F.broadcast(named) if hits.rows <= scale.broadcast_rows else named
    asks = F.col("kind") == VERDICT
    joined = rows.join(side, asks & (F.col("name") == F.col("hit_domain")), "left")
    found = {
        "is_malicious": F.when(asks, F.col("hit_source").isNotNull()),
        "source": F.col("hit_source"),
        "detail": F.when(asks, F.coalesce("hit_detail", F.lit(CLEAN_DETAIL))),
    }
    return joined.withColumns(found).select(*rows.columns)


@dataclass(frozen=True)
class LiveDetection:
    """A live run; `folder` is its own, on shared storage.

    intel: provider tables and verdicts known before; a domain gets its verdict in the micro-batch
    in which it is first seen, and again once that is too old. A lookup budget is not kept here.
    alert_sender(url, payload) and forward_sender(line) run on the executors; those that are context
    managers are entered once per task.
    """

    spark: SparkSession
    folder: str
    rules: SuffixRules
    settings: DetectionSettings = DetectionSettings()
    scale: ScaleSettings = ScaleSettings()
    intel: IntelTables | None = None
    alerts: AlertSettings | None = None
    alert_sender: Callable[[str, str], None] | None = None
    forward: ForwardSettings | None = None
    forward_sender: Callable[[str], None] | None = None
    idle_seconds: float | None = None
    # How much later than its domain's newest record one may arrive and still find its window.
    late_seconds: float = 0.0
    # Parts of a domain's sightings in the state; fixed when the stream first starts.
    lanes: int = 4
    # Keys that clients share, and that verdicts share; fixed when the stream first starts. Each
    # costs a call, and is read and written as a whole: about a thousandth of the clients kept.
    buckets: int = 4096

    @property
    def records_path(self) -> str:
        return f"{self.folder}/records"

    def _records_of(self, batch: int) -> str:
        return f"{self.records_path}/batch={batch}"

    def rows(self, log: DataFrame) -> DataFrame:
        """Parsed records of a streaming log, and what the state held for their keys."""
        records = build_records(log, self.rules, self.settings, self.scale)
        rows = updates(records, self.lanes, self.buckets)
        intel = self.intel
        if intel is None:
            rows = rows.where(F.col("kind") != VERDICT)
        elif intel.settings.max_lookups is not None:
            raise ValueError("a stream keeps no lookup budget; set max_lookups to None")
        else:
            hits = provider_hits(
                host_responses=intel.host_responses,
                feed=intel.feed,
                vendor_responses=intel.vendor_responses,
                settings=intel.settings,
            )
            rows = _with_candidates(rows, stage(hits, "provider-hits"), self.scale)
        state = StateSettings(
            window_us=self.settings.burst_window_us,
            late_us=int(self.late_seconds * 1_000_000),
            idle_seconds=self.idle_seconds,
            verdict_ttl_seconds=intel.settings.verdict_ttl_seconds if intel else 0.0,
            now=intel.now if intel else None,
        )
        stored = keyed_state(rows, state, self.buckets, intel.cache if intel else None)
        record = F.struct(*RECORD_SCHEMA.fieldNames()).cast(RECORD_SCHEMA)
        absent = [F.lit(None).cast(kind).alias(name) for name, kind in (f.split() for f in STORED.split(", "))]
        return records.select(record.alias("record"), *absent).unionByName(
            stored.select(F.lit(None).cast(RECORD_SCHEMA).alias("record"), *stored.columns)
        )

    def process(self, rows: DataFrame, batch: int) -> None:
        """One micro-batch: records, alerts, forwarded lines."""
        with scratch(self.spark):
            arrived = stage(rows, "arrived").df
            parsed = arrived.where("record IS NOT NULL").select("record.*")
            if parsed.isEmpty():
                return
            self._detect(parsed, arrived, batch)
        self._send(self.spark.read.schema(RECORD_SCHEMA).parquet(self._records_of(batch)))

    def _detect(self, parsed: DataFrame, arrived: DataFrame, batch: int) -> None:
        numbers = ("n", "mean", "m2", "low", "high", "responses", "nxdomains")
        clients = arrived.where(F.col("kind") == CLIENT).select(
            "side", F.expr("substring(name, 3)").alias("client"), *[F.col(c).alias(f"p_{c}") for c in numbers]
        )
        sightings = arrived.where((F.col("kind") == DOMAIN) & F.col("name").isNotNull()).select(
            F.expr("substring(key, locate(' ', key) + 1)").alias("registrable_domain"),
            F.col("name").alias("subdomain"),
            "ts_us",
        )
        finished = live_detection(
            parsed, self.settings, self.scale, prior_clients=Staged(clients), prior_sightings=sightings
        )
        if self.intel is not None:
            held = arrived.where(F.col("kind") == VERDICT)
            held = held.select(F.col("name").alias("domain"), "is_malicious", "source", "detail", "checked_at")
            finished = annotate_intel(finished, Staged(held), self.scale, counted_on=parsed)
        exports.with_severity(finished).write.mode("overwrite").parquet(self._records_of(batch))

    def _send(self, written: DataFrame) -> None:
        if self.alerts is not None and self.alert_sender is not None and self.alerts.webhook_url:
            payloads = exports.alerts(written, self.alerts).select("payload")
            deliver(payloads, self.alert_sender, self.alerts.webhook_url)
        if self.forward is not None and self.forward_sender is not None:
            deliver(exports.cef_lines(written, self.forward).select("line"), self.forward_sender)

    def start(self, log: DataFrame, **trigger) -> StreamingQuery:
        """Run on a streaming log (RAW_SCHEMA). trigger: as for `DataStreamWriter.trigger`."""
        self.spark.conf.set(_STORE, _ROCKSDB)
        # A clock in the state asks for micro-batches without rows for ever; state that is due goes
        # with the next rows.
        self.spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
        writer = self.rows(log).writeStream.foreachBatch(self.process).outputMode("append")
        writer = writer.option("checkpointLocation", f"{self.folder}/checkpoint")
        return writer.trigger(**(trigger or {"availableNow": True})).start()

    def output(self) -> DataFrame:
        """All records written so far; input of any end-of-run export."""
        written = self.spark.read.schema(RECORD_SCHEMA).parquet(self.records_path)
        return written.select(*RECORD_SCHEMA.fieldNames())
