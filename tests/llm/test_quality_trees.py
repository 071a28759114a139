from __future__ import annotations

import numpy as np
import pytest

from dnsloom.llm import quality_trees
from dnsloom.llm.common import id_remainder
from dnsloom.llm.queries import op7_quality


def test_flat_traversal_equals_a_walk():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 6)).astype(np.float32)
    y = (x[:, 0] + x[:, 1] ** 2 > 0.5).astype(float)
    trees = quality_trees.grow(x, y, quality_trees.TreeSettings(trees=12, depth=3))

    def walk(row) -> float:
        margin = trees.start
        for feature, threshold, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            node = 0
            while node < len(feature):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            margin += leaf[node - len(feature)]
        return 1 / (1 + np.exp(-margin))

    assert trees.score(x) == pytest.approx([walk(row) for row in x])
    assert ((trees.score(x) >= 0.5) == y).mean() > 0.95


def test_statistics_of_known_texts():
    names = quality_trees.STATISTICS
    rows = quality_trees.statistics(["aa aa AA!", None, "", "a | b\na | b"])
    assert not rows[1].any() and not rows[2].any()
    first = dict(zip(names, rows[0].tolist(), strict=True))
    assert first["distinct_words"] == pytest.approx(2 / 3)
    assert first["repeated_next"] == pytest.approx(1 / 3)
    assert first["upper"] == pytest.approx(2 / 9)
    assert first["emphasis"] == pytest.approx(1 / 9)
    last = dict(zip(names, rows[3].tolist(), strict=True))
    assert last["repeated_lines"] == pytest.approx(0.5)
    assert last["bar"] == pytest.approx(2 / 11)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet").dropna()
    rows = op7_quality(spark, folder).where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_sample_keeps_to_its_bound_and_its_fold(spark, labels, messy):
    from dnsloom.llm.common import labelled_sample, smallest_sample

    wide = spark.range(20_000).withColumnRenamed("id", "k")
    assert 1500 < smallest_sample(wide, "k", 2000, 1).count() <= 2000
    sample = labelled_sample(messy, labels, "quality", 1000, 5).collect()
    fold = {r.doc_id for r in messy.where(id_remainder("doc_id", 5) != 0).collect()}
    assert len(sample) == sum(1 for r in messy.collect() if r.doc_id in fold and r.doc_id < 30)


def test_messy_rows(spark, messy, messy_rows, no_rows, labels):
    model = quality_trees.train(messy, labels)
    score = quality_trees.quality_of(spark, model, messy["text"]).alias("s")
    rows = messy.select("doc_id", score).collect()
    assert len(rows) == len(messy_rows) and all(0 <= r.s <= 1 for r in rows)
    assert len({r.s for r in rows if r.doc_id in (3, 106)}) == 1
    assert quality_trees.train(no_rows, labels).score(quality_trees.statistics(["a"])) == [0.5]
    one = quality_trees.train(messy, labels.where("quality = 1"))
    assert one.score(quality_trees.statistics(["a", None])).min() > 0.5
    assert no_rows.select(quality_trees.quality_of(spark, model, no_rows["text"])).count() == 0
