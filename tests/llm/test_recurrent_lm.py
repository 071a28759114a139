from __future__ import annotations

import dataclasses
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsloom.llm import queries
from dnsloom.llm import recurrent_lm as lm
from dnsloom.llm.common import id_remainder

SMALL = lm.LmSettings(classes=3, per_class=4, rare=2, state=5, scoring_lanes=3, scoring_window=4)


@pytest.fixture
def network():
    made = lm.Network(SMALL, np.arange(1, 13) / 78)
    made.flat = made.flat.astype(np.float64)
    made.flat += np.random.default_rng(0).normal(0, 0.3, len(made.flat))
    return made


def test_gradient_against_differences(network):
    rng = np.random.default_rng(1)
    x = rng.integers(0, 12, (6, 4)).astype(np.int16)
    fresh, active = rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.9
    h = rng.normal(size=(4, 5))

    def loss(flat):
        w = network.views(flat)
        states, _, _ = network.steps(w, x, fresh, h)
        return -(network.log_chance(w, states.reshape(-1, 5), x.ravel()) * active.ravel()).sum() / active.sum()

    grad, _ = network.gradient(network.views(network.flat), x, fresh, active, h)
    for i in rng.integers(0, len(network.flat), 80):
        up, down = network.flat.copy(), network.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-6)


def test_chances_add_up_to_one(network):
    w, state = network.views(network.flat), np.random.default_rng(2).normal(size=(1, 5))
    total = sum(math.exp(network.log_chance(w, state, np.array([k]))[0]) for k in range(12))
    assert total == pytest.approx(1.0)


def test_output_gradient_of_all_classes_at_once(network):
    """Blocks of a class, with one that is full, one that is not and one class left out."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.flatnonzero(network.class_of == 0)[rng.integers(0, 4, 40)], np.flatnonzero(network.class_of == 2)[:1]])
    states, weight = rng.normal(size=(41, 5)), rng.random(41)
    w, g = network.views(network.flat), network.views(np.zeros_like(network.flat))
    back = network._output_gradient(w, g, states, x, weight)
    for i in range(41):
        for j in range(5):
            moved = np.repeat(states[[i]], 2, axis=0)
            moved[:, j] += (1e-5, -1e-5)
            up, down = network.log_chance(w, moved, x[[i, i]])
            assert back[i, j] == pytest.approx(-weight[i] * (up - down) / 2e-5, abs=1e-6)
    assert not g["to_symbol"][1].any() and g["to_symbol"][0].any() and g["to_symbol"][2].any()


def test_great_scores_stay_finite(network):
    w, state = network.views(network.flat), np.zeros((1, 5))
    w["symbol_bias"][0] = (0, 500, 1000, -1000)
    w["class_bias"][:] = (1000, 0, -1000)
    first = np.argsort(network.class_of * 4 + network.within)
    found = [network.log_chance(w, state, first[[k]])[0] for k in range(4)]
    assert found == pytest.approx([-1000, -500, 0, -2000])


def test_state_goes_through_whole_texts(network):
    rng = np.random.default_rng(3)
    lengths = np.array([1, 9, 30, 2, 17, 5, 5])
    symbols = rng.integers(0, 12, lengths.sum()).astype(np.int16)
    got = lm.score_symbols(network, symbols, lengths)
    w, at = network.views(network.flat), 0
    for k, n in enumerate(lengths):
        x, at = symbols[at : at + n], at + n
        h, total = np.zeros((1, 5)), 0.0
        for t, symbol in enumerate(x):
            total += network.log_chance(w, h, np.array([symbol]))[0]
            _, _, h = network.steps(w, np.array([[symbol]]), np.array([[t == 0]]), h)
        assert got[k] == pytest.approx(total, abs=1e-4)


def test_training_against_plain_adam():
    s = dataclasses.replace(SMALL, lanes=2, window=4, least_updates=12)
    rng = np.random.default_rng(5)
    lengths = np.array([7, 3, 9, 1])
    symbols = rng.integers(0, 12, lengths.sum()).astype(np.int16)
    made = lm.Network(s, np.arange(1, 13) / 78)
    made.flat = made.flat.astype(np.float64)
    weights, w = made.flat.copy(), lm.Network(s, np.arange(1, 13) / 78)
    grid, text, fresh = lm._laid_out(symbols, lengths, 2)
    mean, square, step = 0.0, 0.0, 0
    while step < 12:
        h = np.zeros((2, 5))
        for at in range(0, len(grid), 4):
            part = slice(at, at + 4)
            w.flat = weights
            grad, h = w.gradient(w.views(weights), grid[part], fresh[part], text[part] >= 0, h)
            grad *= min(1, 1 / np.linalg.norm(grad))
            step += 1
            mean, square = 0.9 * mean + 0.1 * grad, 0.99 * square + 0.01 * grad**2
            bent = np.sqrt(square / (1 - 0.99**step)) + 1e-6
            weights = weights - s.rate * mean / (1 - 0.9**step) / bent
    lm._train_locally(made, symbols, lengths)
    assert made.flat == pytest.approx(weights, abs=1e-9)


def test_gradient_in_an_array_used_before(network):
    rng = np.random.default_rng(6)
    x, h = rng.integers(0, 12, (6, 4)).astype(np.int16), rng.normal(size=(4, 5))
    fresh, active = rng.random((6, 4)) < 0.2, rng.random((6, 4)) < 0.9
    w, used = network.views(network.flat), rng.normal(size=len(network.flat))
    found, _ = network.gradient(w, x, fresh, active, h, used)
    assert found is used and (found == network.gradient(w, x, fresh, active, h)[0]).all()


@pytest.mark.parametrize("n", [0, 1, 900])
def test_hash_table_against_a_search(n):
    """Hashes spread evenly, crowded ones, the least and the greatest."""
    rng, last = np.random.default_rng(7), ~np.uint64(0)
    crowded = np.uint64(7 << 60) + np.arange(0, n, 3, dtype=np.uint64)
    spread = rng.integers(0, 1 << 64, n, dtype=np.uint64)
    table = np.unique(np.concatenate([crowded, spread, np.array([0, last], np.uint64)[: n % 7]]))
    keys = np.concatenate([table, table + np.uint64(1), spread >> np.uint64(1), [np.uint64(0), last]])
    place = {k: i for i, k in enumerate(table.tolist())}
    assert lm.HashTable(table).find(keys).tolist() == [place.get(k, -1) for k in keys.tolist()]


def test_counts_are_held_by_distinct_token():
    counts, rng = lm._Counts(), np.random.default_rng(8)
    plain = Counter()
    for _ in range(3):
        hashes = rng.integers(0, 50, 10_000).astype(np.uint64)
        counts.add(hashes, (hashes % np.uint64(8)).astype(np.int16))
        plain.update(hashes.tolist())
    assert counts.rows == 150
    hashes, group, n = counts.merge()
    assert dict(zip(hashes.tolist(), n.tolist(), strict=True)) == plain
    assert (group == hashes % np.uint64(8)).all()


def tokens(text: str | None) -> list[str]:
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\0"]


def test_tokens_against_a_pattern():
    texts = ["The the É É\x0bx\x85y", None, "", "  a ", "ÀB\xa0c", "a" * 3000]
    hashes, group, count = lm.tokens_of(texts, 8)
    plain = [token for text in texts for token in tokens(text)]
    assert count.tolist() == [len(tokens(t)) for t in texts]
    assert len(set(zip(plain, hashes.tolist(), strict=True))) == len(set(plain)) == len(set(hashes.tolist()))
    assert len(set(zip(hashes.tolist(), group.tolist(), strict=True))) == len(set(plain))


def base_scores(rows):
    counts = Counter(t for _, text, learned in rows if learned for t in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = [
        (
            key,
            len(tokens(text)),
            sum(counts[t] > 0 for t in tokens(text)),
            n,
            sum(math.log10((counts[t] + 1) / (n + 1 * (v + 1))) for t in tokens(text)),
        )
        for key, text, _ in rows
    ]
    return sorted(out, key=repr)


@pytest.mark.parametrize("frequent", [1 << 20, 40])
def test_base_against_a_plain_count(spark, messy, messy_rows, frequent):
    s = lm.LmSettings(rounds=1, slice_part=2, least_updates=5, frequent=frequent)
    found = lm.score(messy, id_remainder("doc_id", 7) != 2, s).collect()
    held = {r.doc_id: r.h for r in messy.select("doc_id", (id_remainder("doc_id", 7) != 2).alias("h")).collect()}
    want = base_scores([(r[0], r[1], held[r[0]]) for r in messy_rows])
    got = sorted((tuple(r)[:5] for r in found), key=repr)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == [pytest.approx(w[4]) for w in want]
    assert all(math.isfinite(r.score) and r.score < 0 for r in found)


def test_empty_tables(spark, messy, no_rows):
    s = lm.LmSettings(rounds=1, slice_part=2, least_updates=5)
    assert lm.score(no_rows, no_rows["doc_id"] > 0, s).count() == 0
    found = lm.score(messy.where("doc_id < 3"), messy["doc_id"] < 0, s).collect()
    assert all(r.n_known == 0 and r.train_tokens == 0 and r.base_score == 0 for r in found)


def test_better_than_single_tokens_on_held_out_texts(spark):
    rows = queries.op4_recurrent_lm(spark, "/root/testdata/sf0.01").where("held_out").toPandas()
    assert (rows["score"] > rows["base_score"]).mean() > 0.9


def test_every_slice_is_learned_from(spark):
    s = lm.LmSettings(rounds=1, least_updates=5)
    docs = spark.range(200).select("id", F.lit("the cat sat on the mat").alias("text"))
    words = lm.lexicon(lm.count_tokens(docs, s), s)
    left_out = docs.where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(s.slice_part)) != 0)
    assert np.abs(lm.train(left_out, words, s, "id").flat - lm.Network(s, words.shares).flat).max() > 0
    dealt = spark.range(2000).select(lm.turn_of("id", lm.LmSettings()).alias("turn")).groupBy("turn").count()
    assert {r.turn for r in dealt.collect()} == set(range(lm.LmSettings().rounds))
