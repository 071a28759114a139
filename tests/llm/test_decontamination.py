from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from dnsloom.llm import decontamination
from tests.llm.conftest import sentence

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(0x41, 0x5B)}


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))


def brute(texts: list[str | None], items: list[tuple]) -> list[tuple]:
    windows = set()
    for item, text in items:
        w = words(text)
        windows |= {(tuple(w[i : i + 10]), "" if item is None else str(item)) for i in range(max(1, len(w) - 9)) if w}
    out = []
    for text in texts:
        w = words(text)
        hit, found = set(), set()
        for window, item in windows:
            for i in range(len(w) - len(window) + 1):
                if tuple(w[i : i + len(window)]) == window:
                    hit |= set(range(i, i + len(window)))
                    found.add(item)
        out.append((len(w), len(hit), len(found), sorted(found), bool(hit)))
    return out


def run(docs, items, settings=None):
    rows = decontamination.contamination(docs, items, settings).collect()
    return sorted((r.n_words, r.n_hit, r.n_items, list(r.items), r.contaminated) for r in rows)


@pytest.fixture(scope="module")
def passages(messy_rows):
    rng = random.Random(8)
    texts = [sentence(rng, n) for n in (40, 12, 10, 9, 3, 2, 1)]
    items = list(enumerate(texts)) + [
        (7, messy_rows[3][1]),
        (8, messy_rows[3][1]),  # the same passage in two items
        (0, sentence(rng, 15)),  # a second row of item 0
        (None, texts[1]),
        (9, None),
        (10, ""),
        (11, "!! ??"),
        (12, " ".join(messy_rows[33][1].split()[15_000:15_030])),  # amid a very long text
        (13, "ünter DER Brücke 12 é́ 中文"),
    ]
    return items


def test_equals_brute_force(spark, passages):
    rng = random.Random(9)
    texts = []
    for i in range(60):
        parts = [sentence(rng, rng.randint(0, 40))]
        for _ in range(rng.randint(0, 3)):
            w = (rng.choice(passages)[1] or "").split()
            cut = rng.randint(0, len(w)) if len(w) < 1000 else 25
            begin = rng.choice([0, rng.randint(0, max(0, len(w) - cut))])
            parts += [rng.choice([", ", "-", " "]).join(w[begin : begin + cut]).upper(), sentence(rng, rng.randint(0, 5))]
        texts.append(" ".join(parts))
    texts += [passages[0][1] * 3, "Ünter der brücke 12 é́ 中文", "ünter DER Brücke 12 é́ 中文 x"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(passages, "item_id long, text string")
    found = decontamination.contamination(docs, items).orderBy("doc_id").collect()
    expected = brute(texts, passages)
    assert [(r.n_words, r.n_hit, r.n_items, list(r.items), r.contaminated) for r in found] == expected
    assert sum(e[4] for e in expected) > 20


def test_small_blocks_and_stretches_give_the_same(spark, passages):
    rng = random.Random(10)
    texts = [sentence(rng, 30) + " " + passages[i % 3][1] + " " + sentence(rng, i) for i in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    items = spark.createDataFrame(passages, "item_id long, text string")
    small = decontamination.ContaminationSettings(stretch=3, block_bytes=4000)
    assert run(docs, items, small) == run(docs, items) == sorted(brute(texts, passages))


def test_messy_rows(spark, messy, messy_rows, no_rows, passages):
    named = spark.createDataFrame([(*p, 1, "x") for p in passages], "item_id long, text string, doc_id int, key string")
    rows = messy.withColumn("key", F.lit("k")).withColumn("passage", F.lit(1))
    assert run(rows, named) == sorted(brute([r[1] for r in messy_rows], passages))
    ids = decontamination.contamination(rows.withColumn("doc_id", F.lit(None).cast("long")), named)
    assert ids.count() == len(messy_rows)
    assert run(no_rows, named) == []
    clean = run(messy, named.where("item_id > 100"))
    assert [r[1:] for r in clean] == [(0, 0, [], False)] * len(messy_rows)


def test_one_passage_in_a_third_of_all_rows(spark):
    rng = random.Random(11)
    passage = sentence(rng, 14)
    texts = [sentence(rng, 20) + (" " + passage if i % 3 == 0 else "") for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    items = spark.createDataFrame([(i, passage) for i in range(40)], "item_id long, text string")
    found = run(docs, items)
    assert sum(r[4] for r in found) == 100
    assert {(r[1], r[2]) for r in found if r[4]} == {(14, 40)}


def test_no_python_on_the_main_path(spark, messy, passages):
    items = spark.createDataFrame(passages, "item_id long, text string")
    found = decontamination.contamination(messy, items)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)


def test_the_words_of_a_document_are_matched_once(spark, monkeypatch):
    """Passes over the documents read stored words; empty and null texts have none of them."""
    texts = ["", None, " ,. ", "A  b\u00c4\u0130 \u00a0c-d", "one", "one two three four five six seven eight nine ten " * 2]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    items = spark.createDataFrame([("i", texts[-1]), ("j", "one")], "item_id STRING, text STRING")
    matched, plain = [], decontamination.words_of
    monkeypatch.setattr(decontamination, "words_of", lambda text: matched.append(1) or plain(text))
    found = decontamination.contamination(docs, items).orderBy("doc_id").collect()
    # Once for the items, once for the documents.
    assert len(matched) == 2
    expected = [len(r.words) for r in docs.select("doc_id", plain(F.col("text")).alias("words")).orderBy("doc_id").collect()]
    assert [r.n_words for r in found] == expected == [0, 0, 0, 4, 1, 20]
    assert [r.n_hit for r in found] == [0, 0, 0, 0, 1, 20]
