from __future__ import annotations

import os
import subprocess
import sys

import pytest

import __spark_entry__ as driver
import corpus_pipeline
from dnsloom.llm import language_id, queries, toxicity
from dnsloom.llm.common import id_remainder

from .test_packing import check
from .test_weighted_minhash import classes_of, plain_similarity

FOLDER = "/root/testdata/sf0.001"


def test_registered():
    names = list(driver.queries())
    for n in range(1, 11):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names and "pipeline" not in driver.oracle_sql()
    assert set(queries.ORACLE) == {"op5_exact_topk"} <= set(driver.oracle_sql())


def test_entry_works_without_the_subpackage():
    code = (
        "import sys, importlib.util as u\n"
        "found = u.find_spec\n"
        "u.find_spec = lambda n, *a: None if n.startswith(('dnsloom.llm', 'corpus')) else found(n, *a)\n"
        "import __spark_entry__ as e\n"
        "assert set(e.queries()) == set(e.oracle_sql()) and 'entropy' in e.queries()\n"
        "assert not any('llm' in m for m in sys.modules if m.startswith('dnsloom'))\n"
    )
    root = os.path.dirname(os.path.abspath(driver.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)


def test_stages_against_brute_force(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(120)
    extra = [(9000 + i, t, "en", "s", 0) for i, t in enumerate([None, "", "123 !!", "$cum and m0r0n"])]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema)).cache()
    kept = {name: None for name, _ in corpus_pipeline.STAGES}
    current = docs
    for name, function in corpus_pipeline.STAGES:
        current = function(spark, current, FOLDER).cache()
        kept[name] = current.collect()
        if name != "packing":
            assert current.columns == docs.columns

    rows = docs.collect()
    model = language_id.train(docs.where(id_remainder("doc_id", 5) != 0))
    found = model.predict([r.text for r in rows])
    want = {
        r.doc_id
        for r, lang, score in zip(rows, found["lang_pred"], found["score"], strict=True)
        if lang != "und" and score >= corpus_pipeline.LEAST_LANGUAGE_SCORE
    }
    assert {r.doc_id for r in kept["language"]} == want
    assert not want & {9000, 9001, 9002}
    assert len(want) >= len(rows) - 4  # clean documents stay

    first = docs.where(docs["doc_id"].isin(list(want)))
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    judge = toxicity.train(first, labels)
    rest = [r for r in rows if r.doc_id in want]
    clean = [r for r, s in zip(rest, judge.score([r.text for r in rest]), strict=True) if s < 0.5]
    assert {r.doc_id for r in kept["toxicity"]} == {r.doc_id for r in clean}

    similar = plain_similarity([r.text for r in clean])
    pairs = [(clean[i].doc_id, clean[j].doc_id) for i, j in zip(*(similar >= 0.8).nonzero(), strict=True)]
    classes = classes_of([r.doc_id for r in clean], pairs)
    assert {r.doc_id for r in kept["near_copies"]} == set(classes.values())

    texts = {r.doc_id: [r.text] for r in clean if r.doc_id in set(classes.values())}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    check(kept["packing"], texts, tokenizer)


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_on_messy_and_empty_tables(spark, messy_rows, name):
    function = dict(corpus_pipeline.STAGES)[name]
    kinds = "doc_id long, text string, lang string, source string"
    docs = spark.createDataFrame([*messy_rows, (None, messy_rows[3][1], "en", "a"), (None, None, None, None)], kinds)
    rows = function(spark, docs, FOLDER).collect()
    assert rows
    if name == "near_copies":
        ids = [r.doc_id for r in rows]
        assert ids.count(3) == 1 and 106 not in ids and ids.count(None) == 2
    assert function(spark, docs.where("doc_id < 0"), FOLDER).count() == 0
