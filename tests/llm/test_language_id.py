from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from dnsloom.llm import language_id
from dnsloom.llm.common import id_remainder
from dnsloom.llm.queries import op8_language


def test_trigrams_against_a_plain_loop():
    texts = ["Ab cé", None, "", "a", "x1y", "中文 a", "the then"]
    keys, which, owner = language_id.trigrams(texts)
    got = sorted(zip(owner.tolist(), keys[which].tolist(), strict=True))
    want = []
    for k, text in enumerate(texts):
        padded = [ord(c) if c.isalpha() else 0 for c in f" {(text or '').lower()} "]
        for i in range(1, len(padded) - 1):
            if padded[i]:
                want.append((k, (padded[i - 1] << 21 | padded[i]) << 21 | padded[i + 1]))
    assert got == sorted(want)


def test_counts_over_all_rows(spark, messy, messy_rows):
    got = {(r.lang, r.key): r.n for r in language_id.count_trigrams(messy, "lang", "text").collect()}
    want: dict = {}
    for _, text, lang, _ in messy_rows:
        if text is not None and lang is not None:
            keys, which, _ = language_id.trigrams([text])
            for key in keys[which].view(np.int64).tolist():
                want[lang, key] = want.get((lang, key), 0) + 1
    assert got == want


def test_filter_returns_all_languages_and_few_others():
    rng = np.random.default_rng(1)
    keys = rng.integers(1, 1 << 60, 5000).astype(np.uint64)
    language = rng.integers(0, 70, 5000)
    languages = [f"l{k:02}" for k in range(70)]
    made = language_id.LanguageFilter.build(languages, keys, language, language_id.LanguageSettings())
    masks = made.lookup(keys)
    assert all(masks[i, k // 64] >> np.uint64(k % 64) & np.uint64(1) for i, k in enumerate(language))
    strange = made.lookup(rng.integers(1, 1 << 60, 5000).astype(np.uint64))
    assert (strange != 0).any(axis=1).mean() < 0.05


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    rows = op8_language(spark, folder).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.98 * len(rows)


def test_messy_rows(spark, messy, messy_rows, no_rows):
    model = language_id.train(messy.where(id_remainder("doc_id", 5) != 0))
    found = language_id.language_of(spark, model, F.col("text")).alias("f")
    rows = messy.select("doc_id", found).collect()
    by_id = {r.doc_id: r.f for r in rows}
    assert len(rows) == len(messy_rows)
    for doc in (100, 101, 102):
        assert (by_id[doc].lang_pred, by_id[doc].score) == ("und", 0.0)
    assert by_id[1].lang_pred == "en" and 0 < by_id[1].score <= 1
    untaught = language_id.train(no_rows)
    assert untaught.predict(["text", None])["lang_pred"].tolist() == ["und", "und"]
    assert no_rows.select(language_id.language_of(spark, model, F.col("text"))).count() == 0


def test_ties_go_to_the_first_language():
    keys = np.unique(language_id.trigrams(["same"])[0])
    both = np.concatenate([keys, keys])
    language = np.repeat([0, 1], len(keys))
    s = language_id.LanguageSettings()
    model = language_id.LanguageFilter.build(["aa", "bb"], both, language, s)
    assert model.predict(["same"])["lang_pred"].tolist() == ["aa"]
    assert model.predict(["same"])["score"].tolist() == [pytest.approx(1.0)]
