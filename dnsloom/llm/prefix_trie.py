"""Prefix trie of conversations by truncation peeling.

Each conversation is a path of turn fingerprints. From the greatest depth down, the nodes of a
depth are the surviving nodes from below, their last turn stripped, merged with the conversations
that end just there: one grouping by the key of the path. What a node says about its subtree is
added up in the same grouping, so nodes are found and aggregated in one pass down to the root.

Deep down subtrees are small: from the least depth on where every subtree has a bounded number of
turns, whole subtrees are peeled inside tasks, in one round however long conversations are. Above
that each depth is a grouping of its own, added up in part before its shuffle and written to the
shared folder.

A turn is known by two 64-bit hashes of role and text, a prefix by the two running exclusive-ors
of its turns' hashes with their places. Texts are hashed before anything is shuffled but the rows
of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.operators.staging import new_path, stage

# Ids joined at once for a digest.
_IDS = 10_000


def ordered_turns(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation: (conv, turns), turns an array of (place, a, b, points).

    Turns are ordered by number (null first), those of the same number by role and text, and all
    of them stay; null roles and texts are empty ones. Rows without a conversation are left out.
    """
    clean = rows.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"),
        F.col(turn).alias("turn"),
        F.coalesce(role, F.lit("")).alias("role"),
        F.coalesce(text, F.lit("")).alias("said"),
    )
    within = Window.partitionBy("conv").orderBy(F.asc_nulls_first("turn"), "role", "said")
    placed = clean.select(
        "conv",
        F.row_number().over(within).alias("place"),
        # Role and text are apart in the hash: the length of the role comes first.
        F.xxhash64(F.lit(1), F.length("role"), "role", "said").alias("a"),
        F.xxhash64(F.lit(2), F.length("role"), "role", "said").alias("b"),
        F.char_length("said").alias("points"),
    )
    return placed.groupBy("conv").agg(
        F.sort_array(F.collect_list(F.struct("place", "a", "b", "points"))).alias("turns")
    )


def spliced(turns: DataFrame, base: Column, head: Column) -> DataFrame:
    """Each conversation's first `head` turns replaced with those of conversation `base`.

    All of its turns if `base` has fewer, none if there is no such conversation. A conversation
    without any turn left stays, with an empty array.
    """
    named = turns.select("conv", "turns", base.alias("base"), head.cast("int").alias("head"))
    bases = turns.select(F.col("conv").alias("base"), F.col("turns").alias("first"))
    wanted = bases.join(named.select("base").distinct(), "base", "left_semi")
    none = F.array().cast(turns.schema["turns"].dataType)
    rest = F.slice("turns", F.col("head") + 1, F.size("turns"))
    taken = F.when(F.col("first").isNull(), none).otherwise(F.slice("first", F.lit(1), F.col("head")))
    return named.join(wanted, "base", "left").select("conv", F.concat(taken, rest).alias("turns"))


def paths(turns: DataFrame) -> DataFrame:
    """(conv, path): the keys (a, b) of all prefixes and the code points of their last turns."""
    each = turns.select("conv", F.posexplode_outer("turns").alias("at", "t"))
    within = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    keys = [F.bit_xor(F.xxhash64("at", f"t.{c}")).over(within).alias(c) for c in ("a", "b")]
    prefixes = each.select("conv", "at", *keys, F.col("t.points").alias("points"))
    steps = F.collect_list(F.when(F.col("at").isNotNull(), F.struct("at", "a", "b", "points")))
    return prefixes.groupBy("conv").agg(F.sort_array(steps).alias("path"))


def _last(part: str, back: int = 1) -> Column:
    """Part of the last turn of `path` (of the one before it); 0 where there is none."""
    return F.coalesce(F.element_at(F.when(F.size("path") >= back, F.col("path")), -back)[part], F.lit(0))


def _peeled(below: DataFrame, ended: DataFrame) -> DataFrame:
    """The nodes of a depth: conversations that end there merged with stripped nodes from below.

    ended, and what is left of `below` once the last turn is stripped, are paths of that depth.
    """
    new = ended.select("path", "conv", "n_convs", *[F.lit(0).cast("long").alias(c) for c in _COUNTS])
    shorter = F.slice("path", F.lit(1), F.size("path") - 1).alias("path")
    survivors = below.select(shorter, "conv", "n_convs", F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved")
    here = new.unionByName(survivors).select("*", _last("a").alias("a"), _last("b").alias("b"))
    grouped = here.groupBy("a", "b").agg(
        F.min("conv").alias("conv"),
        *[F.sum(c).alias(c) for c in ("n_convs", *_COUNTS)],
        F.first("path").alias("path"),
    )
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_leaves")).cast("long")
    saved = F.col("saved") + (F.col("n_convs") - 1) * _last("points")
    parent = {f"p_{c}": _last(c, 2) for c in ("a", "b")}
    found = {"n_leaves": leaves, "saved": saved, "depth": F.size("path"), **parent}
    return grouped.withColumns(found).select(*_NODE)


_COUNTS = ("n_children", "n_leaves", "saved")
_NODE = ("depth", "a", "b", "p_a", "p_b", "conv", "n_convs", *_COUNTS, "path")


def peel(rows: list[tuple[list, int, int]], top: int) -> dict[str, list]:
    """The nodes at depth `top` and below of some whole subtrees, in columns as `_NODE` names them.

    rows: (path, smallest conversation, conversations) of the distinct paths that end there.
    """
    ended: dict[int, list] = {}
    for path, conv, n in rows:
        ended.setdefault(len(path), []).append((path, conv, n))
    out: dict[str, list] = {c: [] for c in _NODE}
    level: dict[tuple, list] = {}
    for depth in range(max(ended, default=0), top - 1, -1):
        for path, conv, n in ended.get(depth, []):
            _merge(level, path, depth, [conv, n, 0, 0, 0])
        shorter: dict[tuple, list] = {}
        for (a, b), (conv, n, children, leaves, saved, path) in level.items():
            leaves = leaves if children else 1
            saved += (n - 1) * path[depth - 1]["points"]
            shown = path[:depth] if depth == top else None
            up = (path[depth - 2]["a"], path[depth - 2]["b"]) if depth > 1 else (0, 0)
            for name, value in zip(_NODE, (depth, a, b, *up, conv, n, children, leaves, saved, shown), strict=True):
                out[name].append(value)
            if depth > top:
                _merge(shorter, path, depth - 1, [conv, n, 1, leaves, saved])
        level = shorter
    return out


def _merge(level: dict[tuple, list], path: list, depth: int, node: list) -> None:
    key = (path[depth - 1]["a"], path[depth - 1]["b"])
    old = level.get(key)
    if old is None:
        level[key] = [*node, path]
    else:
        old[0] = min(old[0], node[0])
        for i in range(1, 5):
            old[i] += node[i]


def _small_from(ended: DataFrame, entries: int) -> int | None:
    """The least depth from which on no subtree has over `entries` turns, unless it is one path.

    None if no path has a turn. One row per depth comes to the driver at most.
    """
    each = ended.select(F.size("path").alias("size"), F.posexplode("path").alias("at", "t"))
    sizes = each.groupBy((F.col("at") + 1).alias("depth"), "t.a", "t.b").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("size") - F.col("at")).alias("turns")
    )
    large = (F.col("n") > 1) & (F.col("turns") > entries)
    found = sizes.agg(F.max("depth").alias("deepest"), F.max(F.when(large, F.col("depth"))).alias("large")).head()
    return None if found["deepest"] is None else (found["large"] or 0) + 1


def _deep_nodes(ended: DataFrame, top: int, entries: int) -> DataFrame:
    """The nodes at depth `top` and below, whole subtrees of bounded size peeled inside a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[list, int, int]] = []
        turns, last = 0, None
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                for row in batch.slice(start, _ROWS).to_pylist():
                    key = (row["path"][top - 1]["a"], row["path"][top - 1]["b"])
                    if key != last and turns >= entries:
                        yield pa.RecordBatch.from_pydict(peel(held, top), schema=_NODES)
                        held, turns = [], 0
                    last = key
                    turns += len(row["path"]) - top + 1
                    held.append((row["path"], row["conv"], row["n_convs"]))
        yield pa.RecordBatch.from_pydict(peel(held, top), schema=_NODES)

    root = F.get("path", F.lit(top - 1))
    keyed = ended.where(F.size("path") >= top).select(root["a"].alias("ta"), root["b"].alias("tb"), "path", "conv", "n_convs")
    return keyed.repartition("ta", "tb").sortWithinPartitions("ta", "tb").mapInArrow(run, _NODES_DDL)


_ROWS = 500
_STEP = pa.struct([("at", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("points", pa.int32())])
_NODES = pa.schema(
    [("depth", pa.int32()), *[(c, pa.int64()) for c in _NODE[1:-1]], ("path", pa.list_(_STEP))]
)
_NODES_DDL = (
    "depth int, " + ", ".join(f"{c} long" for c in _NODE[1:-1]) + ", path array<struct<at:int,a:bigint,b:bigint,points:int>>"
)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each key, joined by commas; rows come ordered by key and id."""
    out: dict[str, list] = {"depth": [], "a": [], "b": [], "ends": []}
    key, state = None, None

    def close() -> None:
        if key is not None:
            for name, value in zip(out, (*key, state.hexdigest()), strict=True):
                out[name].append(value)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in ("depth", "a", "b")), strict=True))
        ids = batch.column("conv").to_pylist()
        start = 0
        while start < len(ids):
            end = start + 1
            while end < len(ids) and end - start < _IDS and keys[end] == keys[start]:
                end += 1
            text = ",".join(map(str, ids[start:end]))
            if keys[start] == key:
                state.update(("," + text).encode())
            else:
                close()
                key, state = keys[start], hashlib.sha256(text.encode())
            start = end
        if len(out["a"]) >= _IDS:
            yield pa.RecordBatch.from_pydict(out, schema=_DIGEST_SCHEMA)
            out = {name: [] for name in out}
    close()
    yield pa.RecordBatch.from_pydict(out, schema=_DIGEST_SCHEMA)


_DIGEST_SCHEMA = pa.schema([("depth", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("ends", pa.string())])


def trie(conversations: DataFrame, entries: int = 50_000) -> DataFrame:
    """The nodes of the trie over `conversations` (conv, turns), one row each.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. No conversation makes no node, conversations without turns are members of the
    root. The ids that end at a node are streamed through one digest, in order, and never held.

    entries: turns of a subtree up to which it is peeled inside one task. From the least depth on
    where all subtrees are that small, one round peels them all; above it each depth is a round.
    """
    spark = conversations.sparkSession
    keyed = paths(conversations).select("conv", _last("a").alias("a"), _last("b").alias("b"), "path")
    members = stage(keyed.withColumn("depth", F.size("path")), "trie-paths").df
    ended = members.groupBy("depth", "a", "b").agg(
        F.min("conv").alias("conv"), F.count(F.lit(1)).alias("n_convs"), F.first("path").alias("path")
    )
    ended = stage(ended.select("depth", "path", "conv", "n_convs").sortWithinPartitions("depth"), "trie-ended").df

    top = _small_from(ended, entries)
    none = spark.createDataFrame([], _NODES_DDL)
    below = none if top is None else stage(_deep_nodes(ended, top, entries), "trie-deep").df
    nodes = below
    below = below.where(F.col("depth") == F.lit(top))
    folder = new_path(spark, "trie-levels")
    for depth in range((top or 1) - 1, -1, -1):
        level = f"{folder}/level={depth}"
        _peeled(below, ended.where(F.col("depth") == depth)).write.parquet(level)
        below = spark.read.schema(none.schema).parquet(level)
    nodes = nodes.unionByName(spark.read.schema(none.schema).parquet(folder).select(*_NODE))

    ordered = members.select("depth", "a", "b", "conv").repartition("depth", "a", "b")
    digests = ordered.sortWithinPartitions("depth", "a", "b", "conv").mapInArrow(
        _digests, "depth int, a long, b long, ends string"
    )
    named = nodes.select(
        F.col("depth").alias("p_depth"), F.col("a").alias("p_a"), F.col("b").alias("p_b"), F.col("conv").alias("parent_conv_id")
    )
    whole = nodes.drop("path").join(digests, ["depth", "a", "b"], "left")
    whole = whole.withColumn("p_depth", F.col("depth") - 1).join(named, ["p_depth", "p_a", "p_b"], "left")
    return whole.select(
        F.col("conv").alias("conv_id"),
        F.col("depth").cast("long").alias("depth"),
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        F.col("saved").alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


RESULT = (
    "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, "
    "n_leaves long, saved_tokens long, ends_sha256 string"
)
