"""Exact top-k search by columnar branch and bound.

A task holds a block of queries and a block of candidates, the candidates as columns. For one
query it adds up products dimension by dimension, heaviest dimensions of the query first, in
steps of a few columns. After each step a candidate can gain at most the product of the norms
that are left (Cauchy-Schwarz); those that cannot reach the k-th best score any more go, and
the survivors are compacted. Scores are integer inner products and so exact, and a candidate
that could still tie is never dropped.

Vectors that are null or hold null or non-finite components take no part; vectors of different
length are never compared, empty ones have score 0 with each other. Rows that repeat id and
vector count once. Ties go to the smaller id. Extra columns are ignored. Components are below
2**40 in size, so that scores fit.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.pivot_dedup import finite
from dnsloom.operators.staging import stage


@dataclass(frozen=True)
class TopKSettings:
    """query_block, block: mean rows that one task holds. step: columns between two prunings."""

    k: int = 10
    scale: int = 1024
    query_block: int = 2048
    block: int = 16_384
    step: int = 8


def search_block(
    query: np.ndarray, own: int, ids: np.ndarray, columns: np.ndarray, norms: np.ndarray, s
) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the best candidates for one query; columns are (dimension, candidate)."""
    order = np.argsort(-np.abs(query), kind="stable")
    rest = np.append(np.cumsum((query[order].astype(float) ** 2)[::-1])[::-1], 0.0)
    alive = np.flatnonzero(ids != own)
    score = np.zeros(len(alive), np.int64)
    left = norms[alive].copy()
    for at in range(0, len(order), s.step):
        for d in order[at : at + s.step]:
            part = columns[d, alive]
            score += query[d] * part
            left -= part.astype(float) ** 2
        after = min(at + s.step, len(order))
        if len(alive) > s.k and after < len(order):
            # Rounding is met by a relative margin of the squared norms.
            gain = np.sqrt(rest[after] * np.maximum(left + 1e-9 * norms[alive], 0.0)) + 1.0
            kth = np.partition(score - gain, len(alive) - s.k)[len(alive) - s.k]
            stays = score + gain >= kth
            alive, score, left = alive[stays], score[stays], left[stays]
    best = np.lexsort((ids[alive], -score))[: s.k]
    return alive[best], score[best]


def _search(s: TopKSettings):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(queries) and len(rows):
            ids = rows["id"].to_numpy(np.int64)
            table = np.array(rows["vec"].tolist(), np.int64).reshape(len(rows), -1)
            times = rows["times"].to_numpy(np.int64)
            norms = (table.astype(float) ** 2).sum(axis=1)
            columns = np.ascontiguousarray(table.T)
            for own, vector in zip(queries["asked"], queries["asked_vec"], strict=True):
                best, score = search_block(np.array(vector, np.int64), own, ids, columns, norms, s)
                again = np.repeat(np.arange(len(best)), np.minimum(times[best], s.k))
                columns_out = {"query_id": own, "vec_id": ids[best[again]], "score": score[again]}
                found.append(pd.DataFrame(columns_out))
        empty = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype(np.int64)
        return pd.concat(found, ignore_index=True) if found else empty

    return run


def top_k(
    vectors: DataFrame,
    is_query: Column,
    settings: TopKSettings | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, id, score): the best candidates of each query row, all rows being
    candidates but the query's own.

    A row that repeats is stored once with its count and counts as often as it occurs; a query
    that repeats is asked once, and rows with its id are its own.
    """
    s = settings or TopKSettings()
    scaled = F.transform(vector_col, lambda x: F.floor(F.lit(s.scale) * x.cast("double")))
    rows = (
        vectors.where(finite(F.col(vector_col)) & F.col(id_col).isNotNull())
        .select(
            F.col(id_col).cast("long").alias("id"),
            scaled.alias("vec"),
            F.coalesce(is_query, F.lit(False)).alias("asks"),
        )
        .groupBy("id", "vec", "asks")
        .agg(F.count(F.lit(1)).alias("times"))
        .withColumn("dims", F.size("vec"))
    )
    staged = stage(rows, "vectors")
    queries = staged.df.where("asks")
    blocks = max(1, -(-staged.rows // s.block))
    query_blocks = max(1, -(-queries.count() // s.query_block))
    place = F.xxhash64("id")
    many_queries = queries.select(
        F.col("dims").alias("asked_dims"),
        F.pmod(place, F.lit(query_blocks)).cast("int").alias("asked_block"),
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("in_block"),
        F.col("id").alias("asked"),
        F.col("vec").alias("asked_vec"),
    )
    candidates = staged.df.select(
        "dims",
        F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"),
        F.pmod(place, F.lit(blocks)).cast("int").alias("block"),
        "id",
        "vec",
        "times",
    )
    keys = ["dims", "query_block", "block"]
    found = (
        many_queries.groupBy("asked_dims", "asked_block", "in_block")
        .cogroup(candidates.groupBy(*keys))
        .applyInPandas(_search(s), "query_id long, vec_id long, score long")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")
