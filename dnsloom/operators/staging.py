"""Intermediate tables written to the cluster's shared folder.

A lookup table (one row per host, domain or bucket), or parsed records that several passes
read, is computed once, written as Parquet under `spark.checkpoint.dir` and read back. That
cuts its lineage, survives the loss of executors, and gives a row count that can be checked
before a broadcast.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Staged:
    """A stored table; its row count is read from the file footers when first asked for."""

    df: DataFrame

    @cached_property
    def rows(self) -> int:
        return self.df.count()


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: `spark.checkpoint.dir`, else one set up here.

    Only a session that is one process (`local[n]`) may go without the setting; a cluster,
    `local-cluster` included, has to name a folder that all its machines see.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[[\d*, ]+\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="dnsloom-"))
    return context.getCheckpointDir().rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/dnsloom-{label}-{uuid.uuid4().hex}"


_scratch_paths: ContextVar[list[str] | None] = ContextVar("scratch_paths", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are removed at the end.

    Results are lazy and read the staged tables, so they have to be written inside as well.
    """
    paths: list[str] = []
    token = _scratch_paths.set(paths)
    try:
        yield
    finally:
        _scratch_paths.reset(token)
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in paths:
            target = hadoop.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stage(df: DataFrame, label: str) -> Staged:
    """Write `df` to the shared folder and return it re-read."""
    spark = df.sparkSession
    path = new_path(spark, label)
    paths = _scratch_paths.get()
    if paths is not None:
        paths.append(path)
    df.write.parquet(path)
    return Staged(spark.read.schema(df.schema).parquet(path))
