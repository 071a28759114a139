from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsloom.llm import blocked_search
from dnsloom.llm.blocked_search import Best, Index, SearchSettings
from tests.llm.conftest import sentence

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def terms(text: str | None) -> list[str]:
    return [t.translate(LOWER) for t in TERM.findall(text or "")]


def brute(docs: list[tuple], items: list[tuple], best: int = 50) -> list[tuple]:
    held = [(i, Counter(terms(t)), len(terms(t))) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(n for _, _, n in held)
    frequency = Counter(t for _, c, _ in held for t in c)
    wanted: dict = {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    out = []
    for item, asked in wanted.items():
        scores = []
        for doc, counts, n in held:
            m = 50 + (50 * n * n_docs) // length
            score = 0
            for t in asked & counts.keys():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * frequency[t] + 1)))
                score += w * ((10**9 * counts[t]) // (1000 * counts[t] + 20 * m))
            if score > 0:
                scores.append((-score, doc is None, doc))
        out += [(item, k, doc, -s) for k, (s, _, doc) in enumerate(sorted(scores, key=str_key)[:best], 1)]
    return sorted(out, key=str)


def str_key(row: tuple) -> tuple:
    return row[0], row[1], row[2] or 0


def run(docs, items, settings=None) -> list[tuple]:
    return sorted((tuple(r) for r in blocked_search.ranked(docs, items, settings).collect()), key=str)


def corpus(rng: random.Random, n: int) -> list[tuple]:
    topics = [[sentence(rng, 1) for _ in range(30)] for _ in range(6)]
    out = []
    for i in range(n):
        words = rng.choices(rng.choice(topics), k=rng.randint(1, 40)) + sentence(rng, rng.randint(0, 20)).split()
        out.append((i, rng.choice([" ", ", ", "\n"]).join(words)))
    return out


@pytest.mark.parametrize("shard, block", [(4096, 64), (70, 8), (33, 1)])
def test_equals_brute_force(spark, shard, block):
    rng = random.Random(6)
    docs = corpus(rng, 400)
    items = [(i, " ".join(rng.sample(rng.choice(docs)[1].split(), 1)) + " " + rng.choice(docs)[1]) for i in range(20)]
    found = run(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(3),
        spark.createDataFrame(items, "item_id long, text string"),
        SearchSettings(shard=shard, block=block),
    )
    assert found == brute(docs, items)


def test_messy_rows(spark, messy, messy_rows, no_rows):
    items = [(i, messy_rows[i][1]) for i in range(5)] + [
        (5, None),
        (6, ""),
        (None, "ing on st"),
        (2, "12 34 中文 É é́"),
        (7, messy_rows[33][1]),
        (8, "nothingofthekind"),
    ]
    table = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, rank int, terms string")
    rows = [(r[0], r[1]) for r in messy_rows]
    assert run(messy, table) == brute(rows, items)
    without = messy.withColumn("doc_id", F.when(F.col("doc_id") > 4, F.col("doc_id")))
    assert run(without, table) == brute([(i if i is not None and i > 4 else None, t) for i, t in rows], items)
    assert run(no_rows, table) == run(messy, table.where("item_id > 100")) == []


def test_queries_in_several_blocks(spark):
    rng = random.Random(7)
    docs, items = corpus(rng, 80), [(i, sentence(rng, 12)) for i in range(15)]
    found = run(
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(items, "item_id long, text string"),
        SearchSettings(query_terms=40),
    )
    assert found == brute(docs, items)


def test_ties_go_by_id(spark):
    docs = [(i, "same words here") for i in range(90, 0, -1)] + [(200 + i, "other") for i in range(300)]
    found = run(
        spark.createDataFrame(docs, "doc_id long, text string").repartition(4),
        spark.createDataFrame([(1, "words same")], "item_id long, text string"),
        SearchSettings(shard=16, block=4),
    )
    assert sorted(r[2] for r in found) == list(range(1, 51))


def test_summaries_bound_and_blocks_are_skipped():
    """No document scores more than its block's bound, and far blocks are not scored at all."""
    rng = np.random.default_rng(3)
    n, groups = 2000, 20
    terms, impacts, counts = [], [], []
    for i in range(n):
        own = np.unique(np.append(0, 1 + 10 * (i % groups) + rng.integers(0, 10, 5)))
        terms.append(own)
        impacts.append(np.where(own == 0, 10, rng.integers(100, 1000, len(own))))
        counts.append(len(own))
    index = Index(np.arange(n), np.array(counts), np.concatenate(terms), np.concatenate(impacts), SearchSettings())
    query = np.array([0, 1, 2, 3])
    wanted = np.arange(201)
    members, begin, summaries = index.blocks_of(0, wanted)
    assert sorted(members) == list(range(n)) and len(begin) > groups / 2
    mask = np.isin(wanted, query)
    scores = index.scores(members, mask)
    bound = np.repeat(summaries[:, query].sum(axis=1), np.diff(np.append(begin, n)))
    assert (scores <= bound).all()
    best = [Best(50)]
    scored = blocked_search.search_shard(index, [query], lambda t: wanted, best, 201)
    whole = index.scores(np.arange(n), mask)
    assert best[0].found.tolist() == sorted(whole.tolist(), reverse=True)[:50]
    assert scored < n / 4
