"""DNS tables derived from the given `events` and `pages` tables.

One SQL text serves Spark and DuckDB; only the marked pieces differ.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.operators.intel import domains_seen
from dnsloom.operators.records import build_records
from dnsloom.operators.staging import stage
from dnsloom.plans.analyze import IntelTables, analyze
from dnsloom.schema import RAW_SCHEMA
from dnsloom.settings import DetectionSettings, IntelSettings
from dnsloom.sources.feeds import feed_domains
from dnsloom.sources.suffix_rules import seed_suffix_rules

# Chosen so that every branch has rows on the given tables.
SETTINGS = DetectionSettings(
    entropy_threshold=4.2,
    z_score_threshold=1.5,
    burst_window_seconds=86_400,
    burst_unique_subdomain_threshold=40,
)
INTEL_SETTINGS = IntelSettings(max_lookups=20, min_interval_seconds=15.0)
BULK_SETTINGS = IntelSettings(max_lookups=None)
NOW = 1_800_000_000.0

DNS_LOG_SQL = """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host FROM pages),
e AS (SELECT event_id, {TSUS} AS ts_us, user_id, event_type,
             CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
             event_id % (SELECT count(*) FROM pages) AS page_id FROM events),
j AS (SELECT e.*, CASE event_id % 4 WHEN 1 THEN replace(host, 'example.net', 'example.co.uk')
                                    WHEN 2 THEN replace(host, '.example.', '.') ELSE host END AS host,
        CASE WHEN event_type IN ('error','purchase') THEN 1 ELSE 0 END AS qr,
        concat('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS {STR}), '.', CAST(user_id % 256 AS {STR})) AS client
      FROM e JOIN p ON e.page_id = p.page_id),
r AS (SELECT j.*, CASE WHEN event_type = 'error' THEN
          CASE WHEN user_id % 3 = 0 OR k % 2 = 0 THEN 3 WHEN k % 5 = 0 THEN 2 WHEN k % 7 = 0 THEN 15 ELSE 0 END
        WHEN event_type = 'purchase' THEN CASE WHEN k % 10 = 0 THEN 5 ELSE 0 END ELSE 0 END AS rcode FROM j)
SELECT event_id AS seq, ts_us,
  CASE WHEN qr = 1 THEN '8.8.8.8' ELSE client END AS source_ip,
  CASE WHEN qr = 1 THEN client ELSE '8.8.8.8' END AS destination_ip,
  CASE WHEN event_id % 97 = 0 THEN 'Unknown'
       WHEN event_id % 53 = 0 THEN concat('4.3.2.', CAST(k AS {STR}), '.in-addr.arpa.')
       WHEN event_type = 'click' THEN concat(substr(md5({MD}), 1, 16), '.', host, '.')
       WHEN event_type = 'signup' THEN concat('c', CAST(k AS {STR}), '.', host, '.')
       ELSE concat(host, '.') END AS query,
  qr, CASE WHEN event_id % 211 = 0 THEN 5 WHEN event_id % 307 = 0 THEN 15 ELSE 0 END AS opcode,
  CASE WHEN qr = 1 AND k % 3 = 0 THEN 1 ELSE 0 END AS aa, CASE WHEN k % 29 = 0 THEN 1 ELSE 0 END AS tc,
  1 AS rd, qr AS ra, rcode,
  CASE WHEN event_id % 97 = 0 THEN 0 ELSE 1 END AS qdcount,
  CASE WHEN qr = 1 AND rcode = 0 THEN 1 + k % 3 ELSE 0 END AS ancount, 0 AS nscount, k % 2 AS arcount
FROM r
"""

FEED_SQL = """
SELECT DISTINCT replace(url, '.example.', '.') AS value FROM pages
WHERE regexp_like(url, 'spam|pills|bets')
"""

# Provider answers and cached verdicts: drawn from the digits of md5(domain), so that hits,
# misses, failures, fresh and stale rows all occur.
HOST_RESPONSES_SQL = """
SELECT domain,
  CASE WHEN substr(md5(domain), 1, 1) IN ('0', '1')
         THEN concat('{"query_status":"ok","url_count":"', CAST(record_count AS {STR}), '"}')
       WHEN substr(md5(domain), 1, 1) = '2' THEN '{"query_status":"ok"}'
       WHEN substr(md5(domain), 1, 1) = '3' THEN CAST(NULL AS {STR})
       ELSE '{"query_status":"no_results"}' END AS response,
  CASE WHEN substr(md5(domain), 1, 1) = '3' THEN 'timeout' END AS error
FROM seen
"""
VENDOR_RESPONSES_SQL = """
SELECT domain,
  CASE WHEN substr(md5(domain), 2, 1) IN ('0', '1') THEN concat(
         '{"data":{"attributes":{"last_analysis_stats":{"malicious":',
         CAST(record_count % 7 AS {STR}), ',"suspicious":', CAST(record_count % 3 AS {STR}), '}}}}')
       WHEN substr(md5(domain), 2, 1) = '2'
         THEN '{"data":{"attributes":{"last_analysis_stats":{"suspicious":2}}}}'
       WHEN substr(md5(domain), 2, 1) = '3' THEN CAST(NULL AS {STR})
       WHEN substr(md5(domain), 2, 1) = '4' THEN '{}'
       ELSE '{"data":{"attributes":{"last_analysis_stats":{"malicious":0,"suspicious":0}}}}'
  END AS response,
  CASE WHEN substr(md5(domain), 2, 1) = '3' THEN 'quota' END AS error
FROM seen
"""
CACHE_SQL = """
SELECT domain, substr(md5(domain), 3, 1) = '2' AS is_malicious,
  CASE WHEN substr(md5(domain), 3, 1) = '2' THEN 'urlhaus' END AS source,
  CASE WHEN substr(md5(domain), 3, 1) = '2' THEN '4 malicious URL(s) on record'
       ELSE 'no match in any enabled feed' END AS detail,
  CAST({NOW} - CASE substr(md5(domain), 3, 1) WHEN '2' THEN 3600 WHEN '3' THEN 3601 ELSE 100 END
       AS DOUBLE) AS checked_at
FROM seen WHERE substr(md5(domain), 3, 1) IN ('0', '1', '2', '3')
"""


def fill(text: str, dialect: str) -> str:
    """`text` with the marked pieces of `dialect` ('spark' or 'duckdb')."""
    spark = dialect == "spark"
    kind = "STRING" if spark else "VARCHAR"
    micros = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"
    marks = {
        "{TSUS}": micros if spark else "epoch_us(ts)",
        "{STR}": kind,
        "{MD}": f"CAST(event_id AS {kind})",
        "{NOW}": str(int(NOW)),
        "regexp_like(": "regexp_like(" if spark else "regexp_matches(",
    }
    for mark, piece in marks.items():
        text = text.replace(mark, piece)
    return text


def _run(spark: SparkSession, text: str, **tables: DataFrame) -> DataFrame:
    """`text` over the given DataFrames, registered under names of their own."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(fill(text, "spark"))


class Workload:
    """The derived tables of one data folder.

    The log is derived by a join, so jobs that pass over it several times read a stored copy,
    as they would read a real log.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self.settings = SETTINGS
        self.rules = seed_suffix_rules(spark)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def dns_log(self) -> DataFrame:
        log = _run(
            self.spark, DNS_LOG_SQL, events=self.table("events"), pages=self.table("pages")
        )
        return log.select(*[F.col(f.name).cast(f.dataType) for f in RAW_SCHEMA])

    @cached_property
    def stored_log(self) -> DataFrame:
        """The log as files, one or more per core."""
        cores = self.spark.sparkContext.defaultParallelism
        return stage(self.dns_log().repartition(cores, "seq"), "dns-log").df

    def parsed(self) -> DataFrame:
        return build_records(self.stored_log, self.rules, self.settings)

    @cached_property
    def records(self) -> DataFrame:
        """Parsed records, stored: the input of every operator that passes over them."""
        return stage(self.parsed(), "records").df

    @cached_property
    def finished(self) -> DataFrame:
        """Finished records with enrichment, stored: the input of every export."""
        done = analyze(self.stored_log, self.rules, self.settings, self.intel())
        return stage(done, "finished").df

    def intel(self, cached: bool = True, settings: IntelSettings = BULK_SETTINGS) -> IntelTables:
        return IntelTables(
            now=NOW,
            host_responses=self.host_responses(),
            feed=feed_domains(self.feed_lines(), self.rules),
            vendor_responses=self.vendor_responses(),
            cache=self.cache() if cached else None,
            settings=settings,
        )

    def feed_lines(self) -> DataFrame:
        return _run(self.spark, FEED_SQL, pages=self.table("pages"))

    @cached_property
    def seen(self) -> DataFrame:
        return stage(domains_seen(self.records), "seen").df

    def host_responses(self) -> DataFrame:
        return _run(self.spark, HOST_RESPONSES_SQL, seen=self.seen)

    def vendor_responses(self) -> DataFrame:
        return _run(self.spark, VENDOR_RESPONSES_SQL, seen=self.seen)

    def cache(self) -> DataFrame:
        return _run(self.spark, CACHE_SQL, seen=self.seen)
