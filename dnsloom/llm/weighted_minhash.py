"""Near-duplicate documents by improved consistent weighted sampling over TF-IDF shingles.

Words are lower-case runs between blanks; a shingle is five of them in a row, and a shorter text
is one shingle. A shingle weighs its count in the text times ln(1 + N / df), N being all texts
and df the texts with it. df is counted in `cells` hash cells and taken as at least `rare` of
all texts: below that shingles weigh the same, and above it a cell's own count outweighs what
else falls into it, at every size of the corpus.

Each text gets samples of which two texts share each with the chance of their weighted Jaccard
similarity. Bands of samples put texts into buckets; candidates are verified by the exact
weighted Jaccard similarity, links make components, and the smallest id of each stays.

Texts with equal words are one class first. In a bucket every class is compared with the least
one. Where that leaves several components, a small bucket compares all classes of different
components. Members of crowded ones (texts that have a common passage, and little else, in common;
copies changed a little too much) are filed anew by rare shingles: of two texts as alike as
wanted, the rarest shingles that make up a fifth (1 - similarity) of their weights must have one in
common. There the classes outside the largest component of a bucket meet the others, `heads` at
first and four times as many in each further round, but only where the weights that are left from
the common shingle on allow the similarity. These bounds are exact: no link is left out.

Nulls and texts without words link with nothing and stay, rows without an id too (their class
is null). Rows that repeat an id are one document. Extra columns are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import mixed, pieces_of, word_hashes
from dnsloom.llm.components import components
from dnsloom.operators.lookup import lookup_join
from dnsloom.operators.staging import stage
from dnsloom.settings import ScaleSettings

_KEY_BITS = 52
_MOST_TEXTS = 4000
_TABLE_BITS = 14
_CHUNK = 4096
_SLACK = 1e-6


@dataclass(frozen=True)
class MinHashSettings:
    """words: of a shingle. similarity: least one of a link. bands, rows: of the samples; at
    similarity 0.8 a pair is missed with a chance of (1 - 0.8 ** rows) ** bands, 0.0006.
    cells, rare: see above. small: a bucket up to this size compares all at once; heads: a
    crowded one compares so many classes with the rest in the first round."""

    words: int = 5
    similarity: float = 0.8
    bands: int = 14
    rows: int = 4
    cells: int = 1 << 20
    rare: float = 0.005
    small: int = 12
    heads: int = 64


def shingles(texts: Sequence[str | None], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle key, count), sorted by text and key; keys have 52 bits."""
    hashes, size = word_hashes([text.lower() if text else "" for text in texts])
    pad = words - 1
    begin = np.cumsum(size + pad) - (size + pad)
    spread = np.zeros(int((size + pad).sum()) + pad, np.uint64)
    owner = np.repeat(np.arange(len(size)), size)
    inside = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
    spread[begin[owner] + inside] = hashes
    starts = inside <= np.maximum(size[owner] - words, 0)
    at, owner = (begin[owner] + inside)[starts], owner[starts]
    rolled = spread[at]
    with np.errstate(over="ignore"):
        for k in range(1, words):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + spread[at + k]
    key = mixed(rolled, 1) >> np.uint64(64 - _KEY_BITS)
    key |= owner.astype(np.uint64) << np.uint64(_KEY_BITS)
    key.sort()
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else at
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return (
        (key >> np.uint64(_KEY_BITS)).astype(np.int64),
        key & np.uint64((1 << _KEY_BITS) - 1),
        count,
    )


def _parts(texts: Sequence[str | None]) -> Iterator[tuple[int, int]]:
    for a, b in pieces_of(texts, 1_500_000):
        for start in range(a, b, _MOST_TEXTS):
            yield start, min(b, start + _MOST_TEXTS)


def _cell(keys: np.ndarray, cells: int) -> np.ndarray:
    return (keys >> np.uint64(_KEY_BITS - (cells - 1).bit_length())).astype(np.int64)


def document_frequency(docs: DataFrame, s: MinHashSettings) -> tuple[np.ndarray, int]:
    """(texts per cell, all texts). Tasks send arrays, which are added up in two steps, so that
    neither a task nor the driver (which gets one array of fixed size) holds many of them."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, rows = np.zeros(s.cells, np.int64), 0
        for batch in batches:
            texts = batch["text"].tolist()
            rows += len(texts)
            for a, b in _parts(texts):
                _, keys, _ = shingles(texts[a:b], s.words)
                total += np.bincount(_cell(keys, s.cells), minlength=s.cells)
        group = TaskContext.get().partitionId() // 64
        parts = total.reshape(-1, min(_CHUNK, s.cells))
        used = np.flatnonzero(parts.any(axis=1))
        yield pd.DataFrame(
            {"chunk": [*used, -1], "part": group, "n": [*parts[used], np.array([rows])]}
        )

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(rows["n"].tolist(), axis=0)
        return pd.DataFrame({"chunk": rows["chunk"][:1], "part": [0], "n": [total]})

    schema = "chunk long, part long, n array<long>"
    counted = docs.select("text").mapInPandas(count, schema)
    step = counted.groupBy("chunk", "part").applyInPandas(add, schema)
    rows = step.groupBy("chunk").applyInPandas(add, schema).collect()
    total, texts = np.zeros((-(-s.cells // _CHUNK), min(_CHUNK, s.cells)), np.int64), 0
    for row in rows:
        if row["chunk"] < 0:
            texts = row["n"][0]
        else:
            total[row["chunk"]] = row["n"]
    return total.ravel(), texts


def inverse_frequency(found: np.ndarray, texts: int, s: MinHashSettings) -> np.ndarray:
    return np.log1p(texts / np.maximum(found, max(1.0, s.rare * texts))).astype(np.float32)


def weights(texts: Sequence[str | None], idf: np.ndarray, s: MinHashSettings):
    """(text number, shingle key, weight), sorted by text and key."""
    owner, keys, count = shingles(texts, s.words)
    return owner, keys, count * idf[_cell(keys, len(idf))]


_gamma: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None


def _gamma_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) distribution, their logarithms, and their shares."""
    global _gamma
    if _gamma is None:
        share = (np.arange(1 << _TABLE_BITS) + 0.5) / (1 << _TABLE_BITS)
        low, high = np.zeros(len(share)), np.full(len(share), 60.0)
        for _ in range(80):
            x = (low + high) / 2
            below = 1 - (1 + x) * np.exp(-x) < share
            low, high = np.where(below, x, low), np.where(below, high, x)
        _gamma = tuple(x.astype(np.float32) for x in (low, np.log(low), share))
    return _gamma


def band_values(texts: Sequence[str | None], idf: np.ndarray, s: MinHashSettings) -> np.ndarray:
    """One 64-bit value per text and band; texts without shingles get zeros."""
    out = np.zeros((len(texts), s.bands), np.uint64)
    for a, b in _parts(texts):
        owner, keys, weight = weights(texts[a:b], idf, s)
        if len(owner):
            first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            out[a + owner[first]] = _bands(keys, np.log(weight).astype(np.float32), first, s)
    return out


def _bands(keys: np.ndarray, log_weight: np.ndarray, first: np.ndarray, s) -> np.ndarray:
    """Band values of texts whose shingles start at `first`; works in buffers made once."""
    gamma, log_gamma, share = _gamma_tables()
    inverse, mask = 1 / gamma, np.uint64((1 << _TABLE_BITS) - 1)
    shift = [np.uint64(64 - _TABLE_BITS * k) for k in (1, 2, 3)]
    size = np.diff(np.append(first, len(keys)))
    owner = np.repeat(np.arange(len(first)), size)
    out = np.zeros((len(first), s.bands), np.uint64)
    spread = mixed(keys, 2)
    draw, index = np.empty_like(spread), np.empty_like(spread)
    r, scaled, beta, level, value = (np.empty(len(keys), np.float32) for _ in range(5))
    at, hits = index.view(np.int64), np.empty(len(keys), bool)
    steps = mixed(np.arange(s.bands * s.rows), 3) | np.uint64(1)
    for k, odd in enumerate(steps):
        np.multiply(spread, odd, out=draw)
        np.right_shift(draw, shift[0], out=index)
        np.take(gamma, at, out=r, mode="clip")
        np.take(inverse, at, out=scaled, mode="clip")
        np.right_shift(draw, shift[1], out=index)
        np.bitwise_and(index, mask, out=index)
        np.take(share, at, out=beta, mode="clip")
        np.right_shift(draw, shift[2], out=index)
        np.bitwise_and(index, mask, out=index)
        np.take(log_gamma, at, out=value, mode="clip")
        np.multiply(log_weight, scaled, out=level)
        np.add(level, beta, out=level)
        np.floor(level, out=level)
        np.subtract(level, beta, out=scaled)
        np.add(scaled, np.float32(1), out=scaled)
        np.multiply(scaled, r, out=scaled)
        np.subtract(value, scaled, out=value)
        np.take(np.minimum.reduceat(value, first), owner, out=scaled, mode="clip")
        np.equal(value, scaled, out=hits)
        hit = np.flatnonzero(hits)
        text = owner[hit]
        hit = hit[np.append(True, text[1:] != text[:-1])]
        sample = mixed(keys[hit] ^ (level[hit].astype(np.int64).astype(np.uint64) << np.uint64(40)), k)
        band = k // s.rows
        with np.errstate(over="ignore"):
            out[:, band] = out[:, band] * np.uint64(0x9E3779B97F4A7C15) + sample
    return out


def similarity(a, b) -> float:
    """Weighted Jaccard similarity of two (keys, weights) pairs with sorted keys."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = float(np.minimum(a[1][i], b[1][j]).sum(dtype=np.float64))
    whole = float(a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64)) - shared
    return shared / whole if whole > 0 else 0.0


def _verified(pairs: DataFrame, texts: DataFrame, idf, s: MinHashSettings) -> DataFrame:
    """The pairs (a, b) whose similarity is large enough."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, known = None, None
        for batch in batches:
            keep = np.zeros(len(batch), bool)
            for a, b in _parts(batch["text_b"].tolist()):
                owner, keys, weight = weights(batch["text_b"].tolist()[a:b], idf.value, s)
                bound = np.searchsorted(owner, np.arange(b - a + 1))
                for row in range(a, b):
                    if batch["a"].iat[row] != held:
                        held = batch["a"].iat[row]
                        known = weights([batch["text_a"].iat[row]], idf.value, s)[1:]
                    part = slice(bound[row - a], bound[row - a + 1])
                    keep[row] = similarity(known, (keys[part], weight[part])) >= s.similarity
            yield batch.loc[keep, ["a", "b"]]

    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(right, "b").join(left, "a").sortWithinPartitions("a")
    return joined.select("a", "b", "text_a", "text_b").mapInPandas(check, "a long, b long")


def _open(members: DataFrame, parts: DataFrame) -> DataFrame:
    """Members (bucket, node, done) of buckets that hold several components, with the node's
    component, the bucket's size and its largest component."""
    placed = members.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    sizes = placed.groupBy("bucket", "part").agg(F.count(F.lit(1)).alias("n"))
    whole = sizes.groupBy("bucket").agg(
        F.sum("n").alias("size"),
        F.max(F.struct("n", "part"))["part"].alias("largest"),
        F.count(F.lit(1)).alias("parts"),
    )
    return placed.join(whole.where("parts > 1").drop("parts"), "bucket")


def _crossing(asking: DataFrame, least: float, members: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b) of an asking row and a member of its bucket in another component; without
    `members` all ask, and each pair is made once.

    Two texts share no more than what is `left` of either from their first common shingle on, and
    texts of a similarity of `least` share `least / (1 + least)` of both weights: pairs that
    cannot are not made. At a later common shingle less is left; the first one decides.
    """
    apart = "x_part != y_part" if members is not None else "x_part != y_part AND x < y"
    members = asking if members is None else members
    share = least / (1 + least) * (1 - _SLACK)
    enough = F.least("x_left", "y_left") >= share * (F.col("x_total") + F.col("y_total"))

    def side(rows: DataFrame, name: str) -> DataFrame:
        named = {"node": name, **{c: f"{name}_{c}" for c in ("part", "total", "left")}}
        return rows.select("bucket", *named).withColumnsRenamed(named)

    pairs = side(asking, "x").join(side(members, "y"), "bucket").where(apart).where(enough)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _prefixes(crowded: DataFrame, texts: DataFrame, idf, s: MinHashSettings) -> DataFrame:
    """Members (bucket, node, done, total, left) of the buckets of rare shingles that members of
    crowded buckets fall into: `total` is the text's weight, `left` what of it does not come
    before this shingle.

    Shingles are put in order by the number of crowded texts with them, counted exactly. Those of
    one text only come first, stand in no other text and are left out of the shuffle; a text
    goes into the buckets of the others until less than `similarity` of its weight is left.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = batch["text"].tolist()
            for a, b in _parts(rows):
                owner, keys, weight = weights(rows[a:b], idf.value, s)
                total = np.bincount(owner, weight, minlength=b - a)
                node = batch["node"].to_numpy()[a:b][owner]
                shingle = keys.view(np.int64)
                yield pd.DataFrame(
                    {"bucket": shingle, "node": node, "weight": weight, "total": total[owner]}
                )

    wanted = texts.join(crowded.select("node").distinct(), "node", "left_semi")
    cut = wanted.mapInPandas(run, "bucket long, node long, weight float, total double")
    cut = stage(cut, "shingles").df
    counts = cut.groupBy(F.col("bucket").alias("shingle")).agg(F.count(F.lit(1)).alias("rows"))
    counts = stage(counts.where("rows > 1").withColumn("n", F.col("rows")), "shared")
    shared = lookup_join(
        cut,
        counts,
        {"shingle": F.col("bucket")},
        spread=F.xxhash64("node", "bucket"),
        scale=ScaleSettings(),
        weight="rows",
    ).where("n is not null")
    after = Window.partitionBy("node").orderBy(F.desc("n"), F.desc("bucket"))
    after = after.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = shared.withColumn("left", F.sum(F.col("weight").cast("double")).over(after))
    placed = placed.where(F.col("left") >= s.similarity * (1 - _SLACK) * F.col("total"))
    placed = placed.select("bucket", "node", F.lit(False).alias("done"), "total", "left")
    placed = stage(placed, "rarest").df
    sizes = placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return placed.join(sizes.select("bucket"), "bucket", "left_semi")


def near_duplicates(
    docs: DataFrame,
    settings: MinHashSettings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, component_id, kept) for every row of `docs`."""
    s = settings or MinHashSettings()
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    found, n = document_frequency(given, s)
    idf = spark.sparkContext.broadcast(inverse_frequency(found, n, s))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch["text"].tolist()
            prints = [xxhash.xxh3_128_digest(" ".join((t or "").lower().split())) for t in texts]
            bands = band_values(texts, idf.value, s)
            worded = bands.any(axis=1)
            yield pd.DataFrame(
                {
                    "id": batch["id"],
                    "print": pd.Series(prints, dtype=object).where(worded, None),
                    "bands": list(bands.view(np.int64)),
                }
            )

    signed = given.where("id is not null").mapInPandas(
        sign, "id long, print binary, bands array<long>"
    )
    signed = stage(signed, "signed").df
    classes = (
        signed.where("print is not null")
        .groupBy("print")
        .agg(F.min("id").alias("node"), F.first("bands").alias("bands"))
    )
    classes = stage(classes, "classes").df
    filed = classes.select("node", F.posexplode("bands").alias("band", "value"))
    filed = filed.select("node", F.xxhash64("band", "value").alias("bucket"))
    heads = filed.groupBy("bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
    members = stage(filed.join(heads.where("n > 1"), "bucket").drop("n"), "members").df

    suspects = members.select(F.col("node").alias("id")).distinct()
    texts = given.join(suspects, "id", "left_semi").groupBy(F.col("id").alias("node"))
    texts = stage(texts.agg(F.min("text").alias("text")), "suspects").df
    pairs = members.where("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"))
    links = stage(_verified(pairs.distinct(), texts, idf, s), "verified").df
    parts = components(links, "a", "b").withColumnsRenamed({"component": "part"})

    whole = [F.lit(0.0).alias("total"), F.lit(0.0).alias("left")]
    done = (F.col("node") == F.col("head")).alias("done")
    state = stage(_open(members.select("bucket", "node", done, *whole), parts), "open").df
    crowded = state.where(F.col("size") > s.small)
    inner = stage(_open(_prefixes(crowded, texts, idf, s), parts), "split").df
    fits = F.col("size") <= s.small
    pairs = _crossing(state.where(fits).union(inner.select(state.columns).where(fits)), s.similarity)
    state, heads = stage(inner.where(~fits), "crowded"), s.heads
    while True:
        order = Window.partitionBy("bucket").orderBy("part", "node")
        outside = state.df.where(~F.col("done") & (F.col("part") != F.col("largest")))
        turn = outside.withColumn("turn", F.row_number().over(order))
        asking = stage(turn.where(F.col("turn") <= heads).drop("turn"), "asking")
        made = _crossing(asking.df, s.similarity, state.df.where("not done"))
        crossing = pairs.union(made).distinct()
        crossing = stage(crossing, "crossing")
        if crossing.rows:
            more = stage(_verified(crossing.df, texts, idf, s), "verified")
            if more.rows:
                links = links.union(more.df)
                parts = components(links, "a", "b").withColumnsRenamed({"component": "part"})
        if not asking.rows:
            break
        now = asking.df.select("bucket", "node", F.lit(True).alias("now"))
        rest = state.df.join(now, ["bucket", "node"], "left").select(
            "bucket", "node", (F.col("done") | F.col("now").isNotNull()).alias("done"), "total", "left"
        )
        state, pairs, heads = stage(_open(rest, parts), "crowded"), pairs.limit(0), heads * 4

    known = (
        signed.join(classes.select("print", "node"), "print", "left")
        .join(parts, "node", "left")
        .select("id", F.coalesce("part", "node", "id").alias("component_id"))
    )
    alone = given.where("id is null").select("id", F.lit(None).cast("long"))
    return known.union(alone).select(
        F.col("id").alias(id_col),
        "component_id",
        F.col("id").eqNullSafe(F.col("component_id")).alias("kept"),
    )
