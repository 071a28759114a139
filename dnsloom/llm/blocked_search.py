"""Ranked lexical search over posting lists in geometric blocks.

Documents are reduced to a forward table of the query terms they hold (one pass over the texts),
from which document frequencies and lengths are counted. Shards of a few thousand documents, read
in turn by the tasks, hold an index each:

- a posting list per term, cut into blocks of similar documents: each document goes to the nearest
  of some members of the list, by the cosine of signed projections of their impacts;
- per block a summary, the greatest impact of each term over its documents. A list is asked for
  only by queries that hold its term, so the summary has the terms of those queries.

A query visits its terms' lists, the one with the greatest impact first. The summary's impacts of
the query's terms add up to a bound that no document of the block exceeds; a block is skipped only
if that is below the query's fiftieth best score so far, a list only if the greatest impacts of it
and all lists to come add up to less. Documents of other blocks are scored in full, so results are
exact. The best scores go on from shard to shard of a task; tasks return their best for a last
ranking.

Queries are a stated set and are handled in blocks of checked size; nothing of the documents goes
to the driver but their number, their total length and the document frequencies of query terms.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import pieces_of
from dnsloom.operators.staging import new_path, stage

# Bytes of terms: digits, letters, and all bytes of code points beyond ASCII. Others are blanks.
_BLANKS = bytes(
    (b | 0x20 if 0x41 <= b <= 0x5A else b)
    if 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80
    else 0x20
    for b in range(256)
)
_FORWARD = "doc_id long, n long, terms array<int>, times array<int>"
_FOUND = "query int, doc_id long, score long"
_NO_ID = np.iinfo(np.int64).max


@dataclass(frozen=True)
class SearchSettings:
    """best: results per query. shard: documents of an index. block: documents of a block, about.
    dimensions: of the projections. query_terms: most (query, term) pairs handled at once."""

    best: int = 50
    shard: int = 4096
    block: int = 64
    dimensions: int = 32
    query_terms: int = 500_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8, only A-Z lower-cased."""
    return text.encode("utf-8", "replace").translate(_BLANKS).split() if text else []


@dataclass(frozen=True)
class Queries:
    """A block of queries: ids, and for each the numbers of its distinct terms."""

    ids: list
    terms: list[bytes]
    of: list[np.ndarray]


def query_blocks(items: DataFrame, s: SearchSettings, item_col: str, text_col: str) -> Iterator[Queries]:
    """Items in blocks of at most about `query_terms` pairs; rows of one id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [list(dict.fromkeys(terms_of(t))) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.binary()))], ["item", "found"])

    named = items.select(F.col(item_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    cut = named.mapInArrow(run, "item long, found array<binary>")
    listed = cut.groupBy("item").agg(F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    listed = stage(listed.where(F.size("found") > 0), "queries").df
    pairs = listed.agg(F.sum(F.size("found")).alias("n")).head()["n"] or 0
    blocks = -(-pairs // s.query_terms)
    for part in range(blocks):
        rows = listed.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == part).orderBy("item").collect()
        number: dict[bytes, int] = {}
        of = [np.array([number.setdefault(bytes(t), len(number)) for t in r["found"]], np.int64) for r in rows]
        if rows:
            yield Queries([r["item"] for r in rows], list(number), of)


def forward_table(docs: DataFrame, terms: list[bytes], doc_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, terms, times) of each document that holds a term: n counts all its terms with
    repeats, the arrays hold the numbers of the query terms in it and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(terms)}
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("times", pa.list_(pa.int32()))]
        )
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for begin, end in pieces_of(texts):
                rows = []
                for i in range(begin, end):
                    words = terms_of(texts[i])
                    if words:
                        held = Counter(words)
                        known = [(number[t], c) for t, c in held.items() if t in number]
                        rows.append((ids[i], len(words), [k for k, _ in known], [c for _, c in known]))
                columns = list(zip(*rows, strict=True)) or [[]] * 4
                arrays = [pa.array(c, k.type) for c, k in zip(columns, schema, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    named = docs.select(F.col(doc_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return named.mapInArrow(run, _FORWARD)


class Index:
    """The index of one shard: forward rows, posting lists, and blocks made when first asked for."""

    def __init__(self, docs: np.ndarray, counts: np.ndarray, terms: np.ndarray, impacts: np.ndarray, s: SearchSettings):
        self.docs, self.terms, self.impacts, self.s = docs, terms, impacts, s
        self.starts = np.concatenate([[0], np.cumsum(counts)])
        owner = np.repeat(np.arange(len(docs)), counts)
        order = np.argsort(terms, kind="stable")
        self.posted, self.post_impacts = owner[order], impacts[order]
        self.held, first = np.unique(terms[order], return_index=True)
        self.bounds = np.append(first, len(order))
        self.greatest = np.maximum.reduceat(self.post_impacts, first) if len(order) else np.zeros(0, np.int64)
        self.spots: np.ndarray | None = None
        self.blocks: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}

    def _projections(self) -> np.ndarray:
        """Unit vectors: signed sums of the documents' impacts, the signs from hashes of terms."""
        if self.spots is None:
            bits = np.arange(self.s.dimensions, dtype=np.uint64)
            with np.errstate(over="ignore"):
                hashed = (self.terms.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                hashed *= np.uint64(0xBF58476D1CE4E5B9)
            signs = (((hashed[:, None] >> (bits + np.uint64(16))) & np.uint64(1)).astype(np.float32) * 2) - 1
            signs *= self.impacts[:, None]
            sums = np.zeros((len(self.docs), self.s.dimensions), np.float32)
            full = np.flatnonzero(np.diff(self.starts))
            if len(full):
                sums[full] = np.add.reduceat(signs, self.starts[full], axis=0)
            self.spots = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        return self.spots

    def entries(self, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in `docs`, entry) of all forward entries of the documents."""
        sizes = self.starts[docs + 1] - self.starts[docs]
        place = np.repeat(np.arange(len(docs)), sizes)
        offset = np.arange(len(place)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return place, self.starts[docs][place] + offset

    def blocks_of(self, at: int, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(members block after block, where blocks begin, summaries) of the list at place `at`.

        wanted: the terms of all queries that hold the list's term, ascending: the columns.
        """
        if at not in self.blocks:
            members = self.posted[self.bounds[at] : self.bounds[at + 1]]
            groups = -(-len(members) // self.s.block)
            block = np.zeros(len(members), np.int64)
            if groups > 1:
                spots = self._projections()[members]
                block = (spots @ spots[np.arange(groups) * len(members) // groups].T).argmax(axis=1)
            order = np.argsort(block, kind="stable")
            members = members[order]
            _, begin = np.unique(block[order], return_index=True)
            summaries = np.zeros((len(begin), len(wanted)), np.int64)
            number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(members))))
            place, entry = self.entries(members)
            column = np.searchsorted(wanted, self.terms[entry])
            column[column == len(wanted)] = 0
            kept = wanted[column] == self.terms[entry]
            cell = number[place[kept]] * len(wanted) + column[kept]
            np.maximum.at(summaries.reshape(-1), cell, self.impacts[entry[kept]])
            self.blocks[at] = (members, begin, summaries)
        return self.blocks[at]

    def scores(self, docs: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """Full scores of documents; mask: whether a term is the query's."""
        place, entry = self.entries(docs)
        impacts = np.where(mask[self.terms[entry]], self.impacts[entry], 0)
        total = np.zeros(len(docs), np.int64)
        np.add.at(total, place, impacts)
        return total


class Best:
    """The best (score, document) of one query: greatest score first, then least id."""

    def __init__(self, most: int):
        self.most, self.ids, self.found = most, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """A score below this cannot enter; ones equal to it may, by a smaller id."""
        return int(self.found[-1]) if len(self.found) == self.most else 1

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.found, scores])
        order = np.lexsort([ids, -scores])[: self.most]
        self.ids, self.found = ids[order], scores[order]


def search_shard(index: Index, queries: list[np.ndarray], together: Callable, best: list[Best], n_terms: int) -> int:
    """Adds the shard's documents to the queries' best; returns how many documents were scored."""
    scored = 0
    mask = np.zeros(n_terms, bool)
    for query, found in zip(queries, best, strict=True):
        at = np.searchsorted(index.held, query)
        at = at[at < len(index.held)]
        at = at[np.isin(index.held[at], query)]
        at = np.unique(at)
        # Greatest impact first; what all lists from one on can add to a document.
        at = at[np.argsort(-index.greatest[at], kind="stable")]
        to_come = np.cumsum(index.greatest[at][::-1])[::-1]
        mask[query] = True
        seen = np.zeros(len(index.docs), bool)
        for i, rest in zip(at, to_come, strict=True):
            if rest < found.least:
                break
            wanted = together(int(index.held[i]))
            members, begin, summaries = index.blocks_of(int(i), wanted)
            bound = summaries[:, np.searchsorted(wanted, query)].sum(axis=1)
            open_block = np.repeat(bound >= found.least, np.diff(np.append(begin, len(members))))
            docs = members[open_block & ~seen[members]]
            if len(docs):
                seen[docs] = True
                scored += len(docs)
                scores = index.scores(docs, mask)
                enough = scores >= found.least
                found.add(index.docs[docs[enough]], scores[enough])
        mask[query] = False
    return scored


def search(forward: DataFrame, queries: Queries, s: SearchSettings) -> DataFrame:
    """(query, doc_id, score): the best of each task for the queries, by their numbers."""
    total = forward.agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("terms")).head()
    docs, length = total["docs"], total["terms"] or 1
    frequency = np.zeros(len(queries.terms), np.int64)
    for row in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        frequency[row["t"]] = row["count"]
    weights = np.array([math.floor(1000 * math.log((2 * docs + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)
    of = queries.of

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Terms of all queries that hold a term.
        holders: dict[int, list[int]] = {}
        for q, terms in enumerate(of):
            for t in terms.tolist():
                holders.setdefault(t, []).append(q)
        known: dict[int, np.ndarray] = {}

        def together(term: int) -> np.ndarray:
            if term not in known:
                known[term] = np.unique(np.concatenate([of[q] for q in holders[term]]))
            return known[term]

        best = [Best(s.best) for _ in of]
        for rows in _shards(batches, s.shard):
            ids = np.array([_NO_ID if i is None else i for i in rows["doc_id"].to_pylist()], np.int64)
            m = [100 - 50 + (50 * n * docs) // length for n in rows["n"].to_pylist()]
            counts = pc.list_value_length(rows["terms"]).to_numpy().astype(np.int64)
            terms = rows["terms"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            times = rows["times"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            each = np.repeat(np.array(m, np.int64), counts)
            impacts = weights[terms] * ((1_000_000_000 * times) // (1000 * times + 20 * each))
            search_shard(Index(ids, counts, terms, impacts, s), of, together, best, len(weights))
        columns = {
            "query": pa.array(np.repeat(np.arange(len(best)), [len(b.ids) for b in best]), pa.int32()),
            "doc_id": pa.array(
                (ids := np.concatenate([b.ids for b in best] or [np.zeros(0, np.int64)])), pa.int64(), mask=ids == _NO_ID
            ),
            "score": pa.array(np.concatenate([b.found for b in best] or [np.zeros(0, np.int64)]), pa.int64()),
        }
        yield pa.RecordBatch.from_pydict(columns)

    return forward.mapInArrow(run, _FOUND)


def _shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.Table]:
    """The task's rows in tables of about `most` rows."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for begin in range(0, batch.num_rows, most):
            held.append(batch.slice(begin, most))
            if sum(b.num_rows for b in held) >= most:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def ranked(
    docs: DataFrame,
    items: DataFrame,
    settings: SearchSettings | None = None,
    doc_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's best documents with a score above 0.

    Equal scores go by ascending doc_id, null last. Repeated rows are documents of their own.
    Rows of `items` with the same id are one item, null being an id; an item without terms, and an
    empty table, have no results. Other columns are not looked at.
    """
    s = settings or SearchSettings()
    spark = docs.sparkSession
    found = []
    for queries in query_blocks(items, s, item_col, item_text_col):
        folder = new_path(spark, "forward")
        forward_table(docs, queries.terms, doc_col, text_col).write.parquet(folder)
        rows = search(spark.read.schema(_FORWARD).parquet(folder), queries, s)
        names = spark.createDataFrame(list(enumerate(queries.ids)), "query int, item_id long")
        found.append(rows.join(F.broadcast(names), "query").drop("query"))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    placed = reduce(DataFrame.unionAll, found).withColumn("rank", F.row_number().over(order))
    return placed.where(F.col("rank") <= s.best).select("item_id", "rank", "doc_id", "score")
