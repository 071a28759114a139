"""DNS logs, stored and arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from dnsloom.schema import RAW_SCHEMA


def read_dns_log(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Stored log with RAW_SCHEMA; any file format Spark reads. Filters reach the scan."""
    return spark.read.schema(RAW_SCHEMA).format(fmt).options(**options).load(path)


def stream_dns_log(
    spark: SparkSession,
    path: str,
    fmt: str = "parquet",
    max_files_per_trigger: int = 64,
    **options,
) -> DataFrame:
    """Log files as they arrive in a folder; the trigger limit bounds a micro-batch."""
    reader = spark.readStream.schema(RAW_SCHEMA).format(fmt).options(**options)
    return reader.option("maxFilesPerTrigger", max_files_per_trigger).load(path)
