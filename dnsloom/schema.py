"""Schemas of the raw DNS log and of the analysed record."""

from __future__ import annotations

from pyspark.sql import types as T

_FLAG_KEYS = ["qr", "opcode", "aa", "tc", "rd", "ra", "rcode"]

RAW_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("query", T.StringType()),
        *[T.StructField(k, T.IntegerType()) for k in _FLAG_KEYS],
        *[T.StructField(k, T.IntegerType()) for k in ("qdcount", "ancount", "nscount", "arcount")],
    ]
)

FLAGS_TYPE = T.StructType([T.StructField(k, T.StringType()) for k in _FLAG_KEYS])

VERDICT_TYPE = T.StructType(
    [
        T.StructField("is_malicious", T.BooleanType()),
        T.StructField("source", T.StringType()),
        T.StructField("detail", T.StringType()),
        T.StructField("checked_at", T.DoubleType()),
    ]
)

VERDICT_TABLE_SCHEMA = T.StructType([T.StructField("domain", T.StringType()), *VERDICT_TYPE.fields])
RESPONSE_TABLE_SCHEMA = "domain STRING, response STRING, error STRING"

# Order of the analysed record's columns. `seq` and `ts_us` lead: the exact order key.
RECORD_COLUMNS = [
    "seq",
    "ts_us",
    "source_ip",
    "destination_ip",
    "query",
    "registrable_domain",
    "subdomain",
    "entropy",
    "entropy_z_score",
    "timestamp",
    "qdcount",
    "ancount",
    "nscount",
    "arcount",
    "flags",
    "subdomain_burst",
    "subdomain_burst_unique_count",
    "host_nxdomain_ratio",
    "threat_intel",
    "severity",
    "remark",
]

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("seq", T.LongType()),
        T.StructField("ts_us", T.LongType()),
        T.StructField("source_ip", T.StringType()),
        T.StructField("destination_ip", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("registrable_domain", T.StringType()),
        T.StructField("subdomain", T.StringType()),
        T.StructField("entropy", T.DoubleType()),
        T.StructField("entropy_z_score", T.DoubleType()),
        T.StructField("timestamp", T.DoubleType()),
        T.StructField("qdcount", T.IntegerType()),
        T.StructField("ancount", T.IntegerType()),
        T.StructField("nscount", T.IntegerType()),
        T.StructField("arcount", T.IntegerType()),
        T.StructField("flags", FLAGS_TYPE),
        T.StructField("subdomain_burst", T.BooleanType()),
        T.StructField("subdomain_burst_unique_count", T.LongType()),
        T.StructField("host_nxdomain_ratio", T.DoubleType()),
        T.StructField("threat_intel", VERDICT_TYPE),
        T.StructField("severity", T.StringType()),
        T.StructField("remark", T.StringType()),
    ]
)
