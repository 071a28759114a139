from __future__ import annotations

import math

import numpy as np
import pytest

from dnsloom.llm import pivot_dedup
from dnsloom.llm.components import components

KINDS = "vec_id long, embedding array<float>, label int, rep long, vec int, n_links long"


def frame(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3) for row in rows], KINDS)


def brute_force(rows, least=0.93):
    """n_links and component of each row, by comparing all pairs."""
    usable = [
        v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)
        for _, v, label in rows
    ]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = [0] * len(rows)
    groups: dict = {}
    for i, (_, v, label) in enumerate(rows):
        if usable[i]:
            groups.setdefault((label, len(v)), []).append(i)
    for members in groups.values():
        x = np.array([np.array(rows[i][1], np.float32).astype(float) for i in members])
        x /= np.linalg.norm(x, axis=1)[:, None]
        for a, b in zip(*np.nonzero(np.triu(x @ x.T >= least, 1)), strict=True):
            i, j = members[a], members[b]
            links[i] += 1
            links[j] += 1
            parent[find(max(i, j))] = find(min(i, j))
    low: dict = {}
    for i, row in enumerate(rows):
        low[find(i)] = min(low.get(find(i), row[0]), row[0])
    return sorted((row[0], links[i], low[find(i)]) for i, row in enumerate(rows))


def planted(seed: int, groups: int, copies: int, hot: int, dims: int = 32):
    rng = np.random.default_rng(seed)
    rows, n = [], 0

    def near(v, cosine):
        z = rng.normal(size=dims)
        z -= z @ v / (v @ v) * v
        return cosine * v / np.linalg.norm(v) + math.sqrt(1 - cosine**2) * z / np.linalg.norm(z)

    for _ in range(groups):
        v, label = rng.normal(size=dims), int(rng.integers(0, 3))
        for k in range(copies):
            w = v if k == 0 else near(v, rng.uniform(0.9, 0.995)) * rng.uniform(0.5, 3)
            rows.append((n, [float(np.float32(c)) for c in w], label))
            n += 1
    v = rng.normal(size=dims)
    for k in range(hot):
        w = v if k % 2 else near(v, 0.99)
        rows.append((n, [float(np.float32(c)) for c in w], 1))
        n += 1
    return rows


@pytest.mark.parametrize("small", [True, False])
def test_against_all_pairs(spark, small):
    rows = planted(1, 250, 3, 120)
    s = pivot_dedup.PivotSettings(block=40, chunk=300) if small else pivot_dedup.PivotSettings()
    found = pivot_dedup.near_duplicates(frame(spark, rows), s).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in found)
    want = brute_force(rows)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
    assert sum(g == w for g, w in zip(got, want, strict=True)) >= 0.97 * len(rows)
    assert all(r.kept == (r.vec_id == r.component_id) for r in found)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [1.0, 0.0], 1),
        (2, [2.0, 0.0], 1),
        (3, [1.0, 0.0], 2),
        (4, [1.0, 0.0], None),
        (5, None, 1),
        (6, [0.0, 0.0], 1),
        (7, [0.0, 0.0], 1),
        (8, [nan, 1.0], 1),
        (9, [inf, 1.0], 1),
        (10, [None, 1.0], 1),
        (11, [], 1),
        (12, [1.0, 0.0, 0.0], 1),
        (13, [-1.0, 0.0], 1),
        (1, [1.0, 0.0], 1),
    ]
    found = pivot_dedup.near_duplicates(frame(spark, rows)).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in found)
    linked = {1: 2, 2: 2}
    alone = [(i, 0, i, True) for i in range(3, 14)]
    assert got == [(1, linked[1], 1, True)] * 2 + [(2, linked[2], 1, False)] + alone
    assert pivot_dedup.near_duplicates(frame(spark, rows).where("vec_id < 0")).count() == 0


def test_components_of_chains_and_stars(spark):
    rng = np.random.default_rng(3)
    nodes = rng.permutation(300).tolist()
    edges = [(nodes[i], nodes[i + 1]) for i in range(99)]
    edges += [(nodes[100], nodes[k]) for k in range(101, 200)]
    edges += [(nodes[200 + i], nodes[200 + int(rng.integers(0, i))]) for i in range(1, 50)]
    edges += [(nodes[0], nodes[0])]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in components(df, "a", "b").collect()}
    for part in (nodes[:100], nodes[100:200], nodes[200:250]):
        assert {got[n] for n in part} == {min(part)}
    assert components(df.where("a < 0"), "a", "b").count() == 0


@pytest.mark.parametrize(("size", "group"), [(3000, 1000), (6000, 2000)])
def test_distinct_near_copies_are_a_third_of_a_label(spark, size, group):
    rng = np.random.default_rng(size)
    x = rng.normal(size=(size, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    x[:group] = x[0] + 0.2 * x[:group]
    rows = [(i, [float(np.float32(c)) for c in v], 1) for i, v in enumerate(x)]
    found = pivot_dedup.near_duplicates(frame(spark, rows)).collect()
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in found)
    want = brute_force(rows)
    assert sum(w[1] for w in want) > 0.9 * group * (group - 1)
    assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
    assert sum(g[1] for g in got) >= 0.98 * sum(w[1] for w in want)
