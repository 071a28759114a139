from __future__ import annotations

import random

import numpy as np
import pytest

from dnsloom.llm import toxicity
from dnsloom.llm.common import id_remainder


@pytest.fixture(scope="module")
def tables(spark):
    folder = "/root/testdata/sf0.01"
    return tuple(spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables)


@pytest.mark.parametrize(
    ("span", "word"),
    [
        ("l0ser", "loser"),
        ("$cum", "scum"),
        ("l·o·s·e·r", "loser"),
        ("m.o.r.o.n", "moron"),
        ("stuuuuupid", "stupid"),
        ("p4th3t1c", "pathetic"),
        ("d1sgu5ting", "disgusting"),
        ("cl0wn!!", "clown"),
        ("you.loser", "you loser"),
    ],
)
def test_restores(model, span, word):
    assert model.restorer.restore(span) == word


def brute_force(restorer, span: str) -> float:
    """The least cost over all readings, one after another."""
    paths = [("", 0.0)]
    for ways in [*restorer.readings(span), [(" ", 0.0)]]:
        paths = [(text + way, cost + extra) for text, cost in paths for way, extra in ways]

    def total(text: str, cost: float) -> float:
        a = b = 0
        for char in text:
            c = toxicity._symbol_of(char)
            if c or b:
                cost += float(restorer.costs[a, b, c])
                a, b = b, c
        return cost

    return min((total(*path), path[0]) for path in paths)


@pytest.mark.parametrize("span", ["l0s3r", "1d10t", "sss!!t", "a.b-c", "7r4sh", "é0!|l"])
def test_search_finds_the_best_reading(model, span):
    cost, text = brute_force(model.restorer, span)
    assert model.restorer.search(span) == text.strip()


def test_only_spans_with_several_readings_are_decoded():
    texts = ["plain words, (here) and there.", "a l0ser", "soooo", "s c u m of", "12 34"]
    spans = toxicity.noisy_spans(texts)
    assert spans == [[], ["l0ser"], ["soooo"], ["s·c·u·m"], []]


def test_held_out_accuracy(model, tables):
    docs, labels = tables
    english = docs.where((id_remainder("doc_id", 5) == 0) & (docs.lang == "en"))
    rows = english.join(labels.dropna(), "doc_id").toPandas()
    predicted = model.score(rows["text"].tolist()) >= 0.5
    assert (predicted == (rows["toxic"].to_numpy() == 1)).mean() >= 0.95


def test_obfuscated_words_score_as_plain_ones(model):
    plain, hidden, clean = model.score(["the scum of it", "the $cum of it", "the one of it"])
    assert plain >= 0.5 and hidden >= 0.5 and clean < 0.5


def test_messy_rows(spark, messy, messy_rows, no_rows, labels):
    learned = toxicity.train(messy, labels)
    score = toxicity.toxicity_of(spark, learned, messy["text"]).alias("s")
    rows = messy.select("doc_id", score).collect()
    assert len(rows) == len(messy_rows)
    assert all(0 <= r.s <= 1 for r in rows)
    assert [r.s for r in rows if r.doc_id in (100, 101)] == [pytest.approx(0.01)] * 2
    assert len({r.s for r in rows if r.doc_id == 3}) == 1
    nothing = toxicity.train(no_rows, labels.where("doc_id < 0"))
    assert np.all(nothing.score(["the scum", None, ""]) < 0.5)
    assert no_rows.select(toxicity.toxicity_of(spark, learned, no_rows["text"])).count() == 0


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("stuuuupid. x", ["stuuuupid"]),
        ("so stuuuupid, x", ["stuuuupid"]),
        ("a dumba$$", ["dumba$$", "dumbass"]),
        ("l o s e r.", ["l·o·s·e·r"]),
        ('you "l o s e r", x', ["l·o·s·e·r"]),
        ("l  o   s  e  r", ["l·o·s·e·r"]),
        ("l\to\ts\te\tr", ["l·o·s·e·r"]),
        ("a stuupid one", ["stuupid"]),
    ],
)
def test_spans_beside_marks_and_blanks(text, spans):
    assert sorted(toxicity.noisy_spans([text])[0]) == spans


@pytest.mark.parametrize(
    "text",
    [
        "the scuuuum. of it",
        "the scuuuum, of it",
        "the idio+ of it",
        "of it: l o s e r.",
        "of it: l  o  s  e  r",
        "of it: l\to\ts\te\tr",
        "the scuum of it",
    ],
)
def test_sentences_with_obfuscated_words(model, text):
    assert model.score([text])[0] >= 0.5


def test_only_noisy_tokens_are_looked_at_one_by_one():
    rng = random.Random(6)
    alphabet = "aabbcdeßé ..,,!!''  \t\n\x1c0134@$|+(€_-·²́\U0002ebf0"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    codes, _ = toxicity.code_points([text + " " for text in texts])
    for text, found in zip(texts, toxicity._noisy_tokens(texts, codes), strict=True):
        tokens = set(text.split())
        assert found <= tokens
        assert not [token for token in tokens - found if toxicity._spans_of(token)]
    plain = ["the «cat» sat, on_ the... mat. it's d0ne, seen"]
    assert toxicity._noisy_tokens(plain, toxicity.code_points([plain[0] + " "])[0]) == [{"it's", "d0ne,", "seen"}]
