from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from dnsloom.llm import weighted_minhash as wm
from dnsloom.llm.common import word_hashes

DEFAULT = wm.MinHashSettings()


def plain_shingles(text: str | None, words: int = 5) -> Counter:
    cut = (text or "").lower().split()
    if not cut:
        return Counter()
    return Counter(tuple(cut[i : i + words]) for i in range(max(1, len(cut) - words + 1)))


def plain_similarity(texts: list) -> np.ndarray:
    """Weighted Jaccard similarity of all pairs from counted words, without any hashing."""
    bags = [plain_shingles(t) for t in texts]
    df = Counter(s for bag in bags for s in bag)
    floor = max(1.0, DEFAULT.rare * len(texts))
    idf = {s: np.float32(np.log1p(len(texts) / max(n, floor))) for s, n in df.items()}
    out = np.zeros((len(texts), len(texts)))
    for i, a in enumerate(bags):
        for j in range(i + 1, len(texts)):
            b = bags[j]
            keys = a.keys() | b.keys()
            top = sum(min(a[k], b[k]) * idf[k] for k in a.keys() & b.keys())
            whole = sum(max(a[k], b[k]) * idf[k] for k in keys)
            out[i, j] = top / whole if whole else 0.0
    return out


def classes_of(ids, similar) -> dict:
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in similar:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def corpus(seed: int) -> list[str]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("aeioubcdlmnrst", k=5))
    shared = [" ".join(word() for _ in range(30)) for _ in range(3)]
    texts = []
    for _ in range(40):
        base = [word() for _ in range(rng.randint(40, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = word()
            texts.append(" ".join(near).upper() if rng.random() < 0.2 else "  ".join(near))
        texts.append(f"{rng.choice(shared)} {' '.join(base[:20])}")
    base = [word() for _ in range(200)]
    for k in range(60):  # a large group that drifts: its ends are not alike
        base[(k * 3) % 200] = word()
        texts.append(" ".join(base))
    texts += [texts[0]] * 30 + ["", " \n", "one", "one", "two words", "a b c d e"]
    return texts


@pytest.mark.parametrize("settings", [DEFAULT, wm.MinHashSettings(small=2, heads=1)])
def test_against_all_pairs(spark, settings):
    texts = corpus(4)
    s = plain_similarity(texts)
    i, j = np.nonzero(s >= 0.8)
    want = classes_of(range(len(texts)), zip(i.tolist(), j.tolist(), strict=True))
    df = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, id int")
    found = wm.near_duplicates(df, settings).collect()
    got = {r.doc_id: r.component_id for r in found}
    assert got == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_shingles_against_a_plain_loop():
    texts = ["A b c d e f", None, "x", "", "a b c d e f a b c d e", "é ü\n ß"]
    owner, keys, count = wm.shingles(texts, 5)
    for k, text in enumerate(texts):
        assert sorted(count[owner == k].tolist()) == sorted(plain_shingles(text).values())
    assert set(keys[owner == 0]) <= set(keys[owner == 4])
    assert (np.diff(owner) >= 0).all()


def test_word_hashes_tell_words_apart():
    words = [f"{a}{b}" for a in "abcdeé中" for b in "xyz "]
    hashes, count = word_hashes(words)
    assert count.tolist() == [1] * len(words)
    assert len(set(hashes.tolist())) == len({w.strip() for w in words})


def test_samples_agree_as_often_as_the_similarity_says():
    rng = np.random.default_rng(0)
    s = wm.MinHashSettings(bands=600, rows=1)
    keys = np.sort(rng.integers(0, 1 << 52, 300).astype(np.uint64))
    a = rng.uniform(0.5, 4, 300)
    b = np.where(rng.random(300) < 0.7, a, rng.uniform(0.5, 8, 300))
    both = [
        wm._bands(keys, np.log(w).astype(np.float32), np.array([0]), s)[0] for w in (a, b)
    ]
    agreed = (both[0] == both[1]).mean()
    assert agreed == pytest.approx(wm.similarity((keys, a), (keys, b)), abs=0.06)


def test_document_frequency_counts_every_text(spark, messy, messy_rows):
    texts = [r[1] for r in messy_rows]
    found, n = wm.document_frequency(messy.repartition(5), DEFAULT)
    owner, keys, _ = wm.shingles(texts, 5)
    assert n == len(texts)
    assert (found == np.bincount(wm._cell(keys, DEFAULT.cells), minlength=DEFAULT.cells)).all()


def test_messy_rows(spark, messy, messy_rows, no_rows):
    found = wm.near_duplicates(messy).collect()
    assert len(found) == len(messy_rows)
    by_id = {r.doc_id: (r.component_id, r.kept) for r in found}
    for doc in (100, 101, 102, 103, 104):
        assert by_id[doc] == (doc, True)
    assert by_id[106] == (3, False) and by_id[3] == (3, True)
    nameless = messy.withColumn("doc_id", messy["doc_id"] * None)
    assert {tuple(r) for r in wm.near_duplicates(nameless).collect()} == {(None, None, True)}
    assert wm.near_duplicates(no_rows).count() == 0
