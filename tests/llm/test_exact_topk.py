from __future__ import annotations

import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsloom.llm import exact_topk, queries


def brute_force(rows, k=10):
    whole = [
        (i, tuple(math.floor(1024 * float(np.float32(x))) for x in v))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for i, q in set(whole):
        if i % 100 == 0:
            scores = [
                (-sum(a * b for a, b in zip(q, c, strict=True)), j)
                for j, c in whole
                if j != i and len(c) == len(q)
            ]
            out += [(i, n, j, -s) for n, (s, j) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def run(spark, rows, **settings):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<float>, id int, score int")
    found = exact_topk.top_k(df, F.col("vec_id") % 100 == 0, exact_topk.TopKSettings(**settings))
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found.collect())


@pytest.mark.parametrize("settings", [{}, {"query_block": 3, "block": 50, "step": 3}])
def test_against_all_scores(spark, settings):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=20) * rng.uniform(0.1, 2)]) for i in range(900)]
    rows += [(i, rows[4][1]) for i in range(1000, 1060)]  # ties
    assert run(spark, rows, **settings) == brute_force(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, -1.0]),
        (0, [1.0, -1.0]),
        (100, None),
        (200, [nan, 1.0]),
        (300, [1.0]),
        (400, []),
        (500, []),
        (1, [0.5, 0.25]),
        (2, [0.5, 0.25]),
        (3, [inf, 0.0]),
        (4, [None, 0.0]),
        (5, [0.0, 0.0]),
        (None, [9.0, 9.0]),
    ]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, [r for r in rows if r[0] == 77]) == []


def test_query_against_sql(spark):
    folder = "/root/testdata/sf0.01"
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    want = duck.execute(queries.ORACLE["op5_exact_topk"]).fetchall()
    got = [tuple(r) for r in queries.op5_exact_topk(spark, folder).collect()]
    assert sorted(got) == sorted(want)


def test_rows_that_repeat_count_as_often(spark):
    rows = [(i, [float(i), 1.0]) for i in (0, 1, 1, 2, 100)] + [(3, [5.0, 1.0])] * 30
    found = run(spark, rows)
    assert found == brute_force(rows)
    assert [r[2] for r in found if r[0] == 100] == [3] * 10
