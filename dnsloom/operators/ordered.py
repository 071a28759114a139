"""Running computations over time-ordered groups of any size.

A window over one key puts all rows of that key in one task. Groups longer than
`ScaleSettings.group_rows` are therefore cut into time chunks; a window then covers one
(key, chunk), and what came before the chunk arrives by a join from the chunk totals.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from dnsloom.operators.staging import Staged, stage
from dnsloom.settings import ScaleSettings

CHUNK = "__chunk"
_SUB_CHUNKS = 1 << 20


@dataclass(frozen=True)
class OrderedGroups:
    df: DataFrame
    keys: tuple[str, ...]
    scale: ScaleSettings
    split: bool

    def window(self) -> WindowSpec:
        """Rows of one group (or one chunk of a long group) in time order."""
        return Window.partitionBy(*self.keys, CHUNK).orderBy("ts_us", "seq")

    def with_carry(
        self,
        df: DataFrame,
        totals: dict[str, Column],
        carry: Callable[[WindowSpec, WindowSpec], dict[str, Column]],
    ) -> DataFrame:
        """`df` (rows of this grouping) with columns carried over from other chunks.

        totals: aggregates per (key, chunk).
        carry: called with the windows over all earlier and all later chunks of a key,
            returns the columns to attach. Rows of groups that were not cut get NULL.
        """
        on = [*self.keys, CHUNK]
        per_chunk = (
            self.df.where(F.col(CHUNK) >= 0)
            .groupBy(*on)
            .agg(*[expr.alias(name) for name, expr in totals.items()])
        )
        chunks = Window.partitionBy(*self.keys).orderBy(CHUNK)
        earlier = chunks.rowsBetween(Window.unboundedPreceding, -1)
        later = chunks.rowsBetween(1, Window.unboundedFollowing)
        columns = [expr.alias(name) for name, expr in carry(earlier, later).items()]
        side = stage(per_chunk.select(*on, *columns), "carry")
        small = side.rows <= self.scale.broadcast_rows
        return df.join(F.broadcast(side.df) if small else side.df, on, "left")


def _cut_points(values: Sequence[float]) -> list[float]:
    return [-math.inf, *sorted(set(values)), math.inf]


def long_groups(df: DataFrame, keys: Sequence[str], scale: ScaleSettings) -> Staged | None:
    """Keys with more than `scale.group_rows` rows, at most rows / group_rows of them.

    None when there are none, which is the usual case and costs one aggregate.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size"))
    found = sizes.where(F.col("__size") > scale.group_rows)
    return None if found.isEmpty() else stage(found, "long-groups")


def ordered_groups(
    df: DataFrame,
    keys: Sequence[str],
    scale: ScaleSettings,
    *,
    long_keys: Staged | None,
) -> OrderedGroups:
    """`df` with a chunk number, -1 in groups of at most `scale.group_rows` rows.

    df needs ts_us and seq. The list of long groups is short by its making and is broadcast.
    Only when there are any, cut points are taken from quantiles of their ts_us, and from
    quantiles of seq inside instants that alone fill a chunk. The quantiles only place the
    cuts: every row lands in one chunk, and chunks follow (ts_us, seq) order wherever they fall.

    long_keys: the result of `long_groups` for these keys.
    """
    if long_keys is None:
        return OrderedGroups(df.withColumn(CHUNK, F.lit(-1).cast("long")), tuple(keys), scale, False)

    total = long_keys.df.agg(F.sum("__size")).first()[0]
    parts = min(scale.max_chunks, math.ceil(total / scale.group_rows))
    shares = [i / parts for i in range(1, parts)]
    precision = 1 / (4 * parts)
    names = F.broadcast(long_keys.df.select(*keys))
    rows = df.join(names, list(keys), "left_semi").select("ts_us", "seq")

    cuts = rows.approxQuantile("ts_us", shares, precision)
    crowded = sorted({int(v) for v in cuts if cuts.count(v) > 1})
    time_cuts = _cut_points([*cuts, *[v + 1 for v in crowded]])
    seq_cuts = [-math.inf, 0.0, math.inf]
    if crowded:
        at_once = rows.where(F.col("ts_us").isin(crowded))
        seq_cuts = _cut_points(at_once.approxQuantile("seq", shares, precision))

    marked = df.join(names.withColumn("__long", F.lit(True)), list(keys), "left")
    for column, splits in (("ts_us", time_cuts), ("seq", seq_cuts)):
        marked = Bucketizer(splits=splits, inputCol=column, outputCol=f"__{column}_part").transform(marked)
    seq_part = F.when(F.col("ts_us").isin(crowded), F.col("__seq_part")).otherwise(F.lit(0.0))
    chunk = F.col("__ts_us_part").cast("long") * _SUB_CHUNKS + seq_part.cast("long")
    chunked = marked.withColumn(CHUNK, F.when(F.col("__long"), chunk).otherwise(F.lit(-1).cast("long")))
    return OrderedGroups(
        chunked.drop("__long", "__ts_us_part", "__seq_part"), tuple(keys), scale, True
    )
