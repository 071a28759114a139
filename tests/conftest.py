from __future__ import annotations

import os
import sys

import pytest
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from dnsloom.schema import RAW_SCHEMA, RECORD_SCHEMA  # noqa: E402
from dnsloom.sources.suffix_rules import SuffixRules, seed_suffix_rules  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory) -> SparkSession:
    session = (
        SparkSession.builder.master("local[8]")
        .appName("dnsloom-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def rules(spark) -> SuffixRules:
    return seed_suffix_rules(spark)


RAW_DEFAULTS = {
    "seq": 0,
    "ts_us": 1_000_000_000,
    "source_ip": "10.0.0.1",
    "destination_ip": "8.8.8.8",
    "query": "www.example.com.",
    "qr": 0,
    "opcode": 0,
    "aa": 0,
    "tc": 0,
    "rd": 1,
    "ra": 0,
    "rcode": 0,
    "qdcount": 1,
    "ancount": 0,
    "nscount": 0,
    "arcount": 0,
}


def raw_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    full = [{**RAW_DEFAULTS, "seq": i, **row} for i, row in enumerate(rows)]
    data = [tuple(row[f.name] for f in RAW_SCHEMA) for row in full]
    return spark.createDataFrame(data, RAW_SCHEMA)


def record_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Records with defaults; qr and rcode may be given as plain keys."""
    data = []
    for i, row in enumerate(rows):
        flags = ("QUERY", "QUERY", "FALSE", "FALSE", "TRUE", "FALSE", "NOERROR")
        flags = (row.get("qr", flags[0]), *flags[1:6], row.get("rcode", flags[6]))
        ts_us = row.get("ts_us", 1_000_000_000)
        full = {
            "seq": i,
            "ts_us": ts_us,
            "source_ip": "192.0.2.7",
            "destination_ip": "198.51.100.53",
            "query": "shop.test.",
            "registrable_domain": "shop.test",
            "subdomain": "",
            "entropy": 1.0,
            "timestamp": ts_us / 1e6,
            "qdcount": 1,
            "ancount": 0,
            "nscount": 0,
            "arcount": 0,
            "flags": flags,
            "subdomain_burst": False,
            "remark": "Normal query",
        }
        full |= {k: v for k, v in row.items() if k not in ("qr", "rcode")}
        data.append(tuple(full.get(f.name) for f in RECORD_SCHEMA))
    return spark.createDataFrame(data, RECORD_SCHEMA)


def by_seq(df: DataFrame) -> list:
    return sorted(df.collect(), key=lambda row: row.seq)
