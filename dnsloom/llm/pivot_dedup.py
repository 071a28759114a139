"""Near duplicates among embeddings by a pivot-permutation index.

Per label a bounded sample of vectors, thinned so that no two are close, serves as reference points
(pivots); a dense group thus shares its pivots however large it is. A vector is described
by its nearest pivots in order. Each pivot has an inverted list of the vectors that name it;
vectors that share enough pivots are candidates, and candidates are verified by their cosine
in double precision. A pair that shares several pivots is looked at in the list of the first.

Equal vectors of a label are one class first, so copies cost nothing. Long lists are cut into
blocks and pairs of blocks go to different tasks. Tasks return counts and local components, never
pairs, so what is passed on grows with the vectors.

A vector that is null, empty or zero, holds a null or a non-finite component, or has no label
links with nothing: 0 links, its own component, kept. Vectors of different length are never
compared. Repeated rows are vectors of their own, links with each other included. Ties do not
matter; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.components import components
from dnsloom.operators.staging import stage


@dataclass(frozen=True)
class PivotSettings:
    """least_cosine: of a link. rows_per_pivot, least_pivots, most_pivots: size of a label's
    sample of pivots. apart: pivots have a smaller cosine. prefix: pivots that describe a vector. shared: pivots that candidates
    have in common. block, chunk: most rows (on average) that a task holds of a list or label.
    """

    least_cosine: float = 0.93
    rows_per_pivot: int = 8
    least_pivots: int = 64
    most_pivots: int = 4096
    apart: float = 0.8
    prefix: int = 10
    shared: int = 2
    block: int = 1024
    chunk: int = 4096


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    odd = F.exists(
        vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    )
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def _unit(vectors: pd.Series) -> np.ndarray:
    x = np.array(vectors.tolist(), np.float64)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _thin(apart: float):
    """The pivots of one label that are not close to one kept before them."""

    def run(pivots: pd.DataFrame) -> pd.DataFrame:
        pivots = pivots.sort_values("rep")
        unit, kept = _unit(pivots["vec"]), []
        near = np.zeros(len(unit), bool)
        for i in range(len(unit)):
            if not near[i]:
                kept.append(i)
                near[i + 1 :] |= unit[i + 1 :] @ unit[i] >= apart
        return pivots.iloc[kept]

    return run


def _describe(prefix: int):
    """Cogrouped rows and pivots of one chunk: each row's nearest pivots, nearest first."""

    def run(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
        names = ["label", "dims", "rep", "copies", "vec", "prefix"]
        if rows.empty:
            return pd.DataFrame(columns=names)
        near = [[] for _ in range(len(rows))]
        if len(pivots):
            pivots = pivots.sort_values("pivot_rep")
            cosine = _unit(rows["vec"]) @ _unit(pivots["pivot_vec"]).T
            near = np.argsort(-cosine, axis=1, kind="stable")[:, :prefix].astype(np.int32).tolist()
        return rows.assign(prefix=near)[names]

    return run


def _verify(settings: PivotSettings):
    """One pair of blocks of a list: links per vector and the local component's least rep."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        pivot, lo, hi = key[2], key[3], key[4]
        rows = rows.sort_values(["own", "rep"])
        own = rows["own"].to_numpy()
        first, second = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        empty = pd.DataFrame({"rep": [], "links": [], "low": []}).astype(np.int64)
        if not len(first) or not len(second) or (lo == hi and len(first) < 2):
            return empty
        longest = max(map(len, rows["prefix"]))
        prefix = np.array([list(p) + [-1] * (longest - len(p)) for p in rows["prefix"]], np.int32)
        a, b = prefix[first], prefix[second]
        shared = np.zeros((len(first), len(second)), np.int16)
        earlier = np.zeros((len(first), len(second)), bool)
        for k in range(longest):
            for j in range(longest):
                same = (a[:, k, None] == b[None, :, j]) & (a[:, k, None] >= 0)
                shared += same
                earlier |= same & (a[:, k, None] < pivot)
        needed = min(settings.shared, longest)
        may = (shared >= needed) & ~earlier
        if lo == hi:
            may &= np.triu(np.ones(may.shape, bool), 1)
        i, j = np.nonzero(may)
        unit = _unit(rows["vec"])
        linked = np.zeros(len(i), bool)
        for k in range(0, len(i), 1 << 16):
            part = slice(k, k + (1 << 16))
            product = np.einsum("ij,ij->i", unit[first[i[part]]], unit[second[j[part]]])
            linked[part] = product >= settings.least_cosine
        i, j = first[i[linked]], second[j[linked]]
        if not len(i):
            return empty
        copies, rep = rows["copies"].to_numpy(), rows["rep"].to_numpy()
        links = np.bincount(i, copies[j], len(rows)) + np.bincount(j, copies[i], len(rows))
        low = rep.copy()
        while True:
            before = low.copy()
            np.minimum.at(low, i, low[j])
            np.minimum.at(low, j, low[i])
            if (low == before).all():
                break
        found = np.flatnonzero(links)
        return pd.DataFrame({"rep": rep[found], "links": links[found].astype(np.int64), "low": low[found]})

    return run


def near_duplicates(
    vectors: DataFrame,
    settings: PivotSettings | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of `vectors`."""
    s = settings or PivotSettings()
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(vector_col).alias("vec"), F.col(label_col).alias("label")
    )
    square = F.aggregate(
        "vec", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double")
    )
    usable = finite(F.col("vec")) & F.col("label").isNotNull() & (F.coalesce(square, F.lit(0.0)) > 0)
    rows = rows.withColumn("usable", usable)
    whole = (
        rows.where("usable")
        .groupBy("label", "vec")
        .agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
        .withColumn("dims", F.size("vec"))
    )
    classes = stage(whole, "classes").df
    sizes = classes.groupBy("label", "dims").agg(F.count(F.lit(1)).alias("rows"))
    sized = classes.join(sizes, ["label", "dims"])
    pivots_wanted = F.greatest(
        F.lit(s.least_pivots), F.least(F.lit(s.most_pivots), F.col("rows") / s.rows_per_pivot)
    )
    chunks = F.ceil(F.col("rows") / s.chunk).cast("int")
    hashed = F.pmod(F.xxhash64("rep", F.lit(17)), F.lit(1 << 31))
    sampled = sized.where(hashed < pivots_wanted / F.col("rows") * (1 << 31))
    sampled = sampled.select("label", "dims", "rows", "rep", "vec")
    thinned = sampled.groupBy("label", "dims").applyInPandas(_thin(s.apart), sampled.schema)
    pivots = (
        thinned.withColumn("chunk", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .select(*(F.col(c).alias(f"pivot_{c}") for c in ("label", "dims", "chunk", "rep", "vec")))
    )
    chunked = sized.withColumn("chunk", F.pmod(F.xxhash64("rep", F.lit(3)), chunks).cast("int"))
    keys = ["label", "dims", "chunk"]
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    kept = ", ".join(f"{name} {kinds[name]}" for name in ("label", "dims", "rep", "copies", "vec"))
    described = (
        chunked.select(*keys, "rep", "copies", "vec")
        .groupBy(*keys)
        .cogroup(pivots.groupBy(*(f"pivot_{key}" for key in keys)))
        .applyInPandas(_describe(s.prefix), f"{kept}, prefix array<int>")
    )
    described = stage(described, "described").df

    postings = described.withColumn("pivot", F.explode("prefix"))
    lists = described.select("label", "dims", F.explode("prefix").alias("pivot"))
    lists = lists.groupBy("label", "dims", "pivot").agg(F.count(F.lit(1)).alias("length"))
    blocks = F.ceil(F.col("length") / s.block).cast("int")
    dealt = (
        postings.join(lists.where("length > 1"), ["label", "dims", "pivot"])
        .withColumn("own", F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
        .select("label", "dims", "pivot", "lo", "hi", "own", "rep", "copies", "vec", "prefix")
    )
    found = dealt.groupBy("label", "dims", "pivot", "lo", "hi").applyInPandas(
        _verify(s), "rep long, links long, low long"
    )
    found = stage(found, "found").df
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    parts = components(found, "rep", "low").withColumnsRenamed({"node": "rep"})

    known = classes.join(links, "rep", "left").join(parts, "rep", "left")
    known = known.select(
        "label",
        "vec",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component_id"),
    )
    linked = rows.where("usable").join(known, ["label", "vec"]).select("id", "n_links", "component_id")
    alone = rows.where("not usable").select("id", F.lit(0).cast("long"), F.col("id"))
    return linked.union(alone).select(
        F.col("id").alias(id_col),
        "n_links",
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
