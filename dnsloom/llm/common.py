"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def short_batches(spark: SparkSession, rows: int = 2000, size: int = 16 << 20) -> None:
    """Hand Python workers at most `rows` rows and about `size` bytes at once: texts may be long.

    Set for the session, as plans read it when they run.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def id_remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as an empty text."""
    text = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % modulus


def smallest_sample(labels: DataFrame, key: str, rows: int, seed: int) -> DataFrame:
    """At most `rows` rows of `labels`, chosen by hash: the same rows on every run.

    The hash bound is set from the row count, so no sort is needed; the small excess that the
    hash leaves over `rows` is kept out by asking for 5 % less than the bound allows.
    """
    total = labels.count()
    if total <= rows:
        return labels
    share = int(0.95 * rows / total * (1 << 32))
    return labels.where(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 32)) < share)


def pieces_of(texts: Sequence[str | None], most: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of `texts` with about `most` characters each (one text at least)."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text) if text else 0
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """All code points in one array, and where each text starts (one entry more than texts)."""
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=starts[1:])
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32).astype(np.int32), starts


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """For each code point whether it is a letter; made once per Python worker."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@lru_cache(maxsize=1)
def blank_table() -> np.ndarray:
    """For each code point whether it is white space; made once per Python worker."""
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x3001) if chr(i).isspace()]] = True
    return table


_FACTOR = 0x9E3779B97F4A7C15


@lru_cache(maxsize=1)
def _powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd factor modulo 2**64, and of its inverse."""
    with np.errstate(over="ignore"):
        inverse = pow(_FACTOR, -1, 1 << 64)
        return tuple(
            np.cumprod(np.append(np.uint64(1), np.full((1 << bits) - 1, f, np.uint64)))
            for f in (_FACTOR, inverse)
        )


def word_spans(codes: np.ndarray, blank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of each word of a text that ends with a blank."""
    gap = blank[codes]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.append(0, edge)
    return edge[0::2], edge[1::2]


def span_hashes(codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: a polynomial of its code points, from running sums."""
    up, down = _powers(max(16, int(len(codes)).bit_length()))
    with np.errstate(over="ignore"):
        running = np.cumsum((codes + np.uint32(1)) * up[: len(codes)])
        before = np.where(begin > 0, running[begin - 1], np.uint64(0))
        return mixed((running[end - 1] - before) * down[begin], 4)


def word_hashes(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of each word, words per text); words stand between white space."""
    joined = " ".join(texts) + " "
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    begin, end = word_spans(codes, blank_table())
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return span_hashes(codes, begin, end), np.diff(np.searchsorted(begin, starts))


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """Well-mixed 64-bit hashes of 64-bit keys (multiply and shift, twice)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label: str,
    rows: int,
    modulus: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(text, label) of at most about `rows` labelled documents outside the held-out fold.

    The chosen labels are at most `rows` small rows, so they are broadcast. Several labels of
    one document count as the largest of them.
    """
    known = (
        labels.where((id_remainder(id_col, modulus) != 0) & F.col(label).isNotNull())
        .groupBy(F.col(id_col).alias("__id"))
        .agg(F.max(label).cast("int").alias("label"))
    )
    chosen = smallest_sample(known, "__id", rows, 7)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text"))
    return texts.join(F.broadcast(chosen), "__id").select("text", "label")
