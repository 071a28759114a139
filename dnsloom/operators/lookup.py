"""Left join of a large table to a one-row-per-key table, safe for hot keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.operators.staging import Staged, stage
from dnsloom.settings import ScaleSettings

_LANES = 1 << 16


def _equal(pairs: list[tuple[Column, Column]]) -> Column:
    return reduce(lambda a, b: a & b, [left == right for left, right in pairs])


def lookup_join(
    left: DataFrame,
    table: DataFrame | Staged,
    on: dict[str, Column],
    *,
    spread: Column,
    scale: ScaleSettings,
    weight: str | None = None,
    counted_on: DataFrame | None = None,
    label: str = "lookup",
) -> DataFrame:
    """`left` with the columns of `table` added; NULL where no key matches.

    on: table key column -> expression over `left`; a NULL expression matches nothing.
    weight: column of `table` that holds the number of matching rows in `left`; counted
        here when not given and needed, on `counted_on` if that is a cheaper table on which
        `on` works as well.
    spread: well-distributed expression over `left` (a row number).

    The table is staged and counted first. Up to `scale.broadcast_rows` rows it is
    broadcast, and `left` is not shuffled at all. A larger table is split: keys with
    `scale.hot_rows` or more matches (at most rows(left) / hot_rows of them, whatever the
    data) are broadcast, the others are shuffle-joined. Rows already served, and rows
    without a key, get a spread key in that shuffle, so none of its partitions is hot.
    """
    staged = table if isinstance(table, Staged) else stage(table, label)
    names = {key: f"__key_{key}" for key in on}
    values = [c for c in staged.df.columns if c not in on and c != weight]
    renamed = staged.df.withColumnsRenamed(names)

    if staged.rows <= scale.broadcast_rows:
        match = _equal([(expr, F.col(names[key])) for key, expr in on.items()])
        side = F.broadcast(renamed.select(*names.values(), *values))
        return left.join(side, match, "left").drop(*names.values())

    if weight is not None:
        hot_keys = renamed.where(F.col(weight) >= scale.hot_rows)
    else:
        counted = left if counted_on is None else counted_on
        sizes = counted.groupBy(*[expr.alias(names[key]) for key, expr in on.items()]).count()
        busy = stage(sizes.where(F.col("count") >= scale.hot_rows), f"{label}-hot").df
        hot_keys = renamed.join(F.broadcast(busy), list(names.values()), "left_semi")
    cold_keys = renamed.join(
        F.broadcast(hot_keys.select(*names.values())), list(names.values()), "left_anti"
    )

    packed = F.struct(*values)
    hot = hot_keys.select(*names.values(), packed.alias("__hot"))
    cold = cold_keys.select(*names.values(), packed.alias("__cold"), F.lit(-1).alias("__cold_lane"))

    match = _equal([(expr, F.col(names[key])) for key, expr in on.items()])
    step = left.join(F.broadcast(hot), match, "left").drop(*names.values())
    keyed = reduce(lambda a, b: a & b, [expr.isNotNull() for expr in on.values()])
    step = step.withColumn(
        "__lane",
        F.when(keyed & F.col("__hot").isNull(), F.lit(-1)).otherwise(
            F.pmod(F.xxhash64(spread), F.lit(_LANES)).cast("int")
        ),
    )
    step = step.join(cold, match & (F.col("__lane") == F.col("__cold_lane")), "left")
    found = F.coalesce(F.col("__hot"), F.col("__cold"))
    return step.select(*left.columns, *[found.getField(v).alias(v) for v in values])
