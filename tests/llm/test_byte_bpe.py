from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken

from dnsloom.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = "aaabcde é中😀ßñ     \n\n\t 　123'sthe.ing!!\x1c\x85"


@pytest.fixture(scope="module")
def voc():
    return byte_bpe.Vocabulary.load(PATH)


@pytest.fixture(scope="module")
def known(voc):
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=voc.ranks, special_tokens={}
    )


def random_texts(n: int) -> list[str]:
    rng = random.Random(1)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    return [*texts, "", " ", "  ", "\n ", " " + "abcthe" * 200, "the" * 5000]


@pytest.mark.parametrize("at_spaces", [True, False])
def test_same_ids_as_the_known_encoder(voc, known, at_spaces):
    texts = random_texts(6000)
    split = regex.compile(public_tokenizers.PATTERN).findall
    for start in range(0, len(texts), 500):
        part = texts[start : start + 500]
        for text, ids in zip(part, voc.encode_texts(part, split, at_spaces), strict=True):
            assert np.frombuffer(ids, np.int32).tolist() == known.encode_ordinary(text), text


def test_small_caches_change_nothing(known, voc):
    small = byte_bpe.Vocabulary(voc.ranks, pair_entries=10, piece_entries=10)
    split = regex.compile(public_tokenizers.PATTERN).findall
    texts = random_texts(200)
    for text in texts:
        ids = small.encode_texts([text], split, True)[0]
        assert np.frombuffer(ids, np.int32).tolist() == known.encode_ordinary(text)


def test_appends_and_edits_keep_the_table_exact(voc):
    rng = random.Random(2)
    for _ in range(100):
        data = bytes(rng.choice(b"thes aning\xc3\xa9") for _ in range(rng.randint(0, 300)))
        table = byte_bpe.PrefixTable(voc, data)
        for _ in range(3):
            start = rng.randint(0, len(table.data))
            stop = rng.randint(start, min(len(table.data), start + 9))
            table.replace(start, stop, bytes(rng.choice(b"theing") for _ in range(rng.randint(0, 6))))
            assert table.last == byte_bpe.PrefixTable(voc, bytes(table.data)).last
        table.append(b"ingthe")
        assert table.ids() == byte_bpe.PrefixTable(voc, bytes(table.data)).ids()


def test_an_edit_recomputes_only_what_is_near(voc):
    table = byte_bpe.PrefixTable(voc, b"thering" * 2000)
    before = table.recomputed
    table.replace(5000, 5003, b"xyz")
    assert table.recomputed - before < 200


def test_messy_rows(spark, messy, messy_rows, no_rows, known):
    coded = byte_bpe.encode(messy, PATH, public_tokenizers.PATTERN, at_spaces=True, decoded=True)
    got = sorted((r.doc_id, list(r.ids), bytes(r.decoded)) for r in coded.collect())
    want = sorted((r[0], known.encode_ordinary(r[1] or ""), (r[1] or "").encode()) for r in messy_rows)
    assert got == want
    again = byte_bpe.decode(coded, PATH).collect()
    assert sorted((r.doc_id, bytes(r.decoded)) for r in again) == [(i, d) for i, _, d in want]
    assert byte_bpe.encode(no_rows, PATH, public_tokenizers.PATTERN).count() == 0


def test_query(spark, known):
    folder = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in queries.op2_byte_bpe(spark, folder).collect()}
    for doc in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = known.encode_ordinary(doc.text or "")
        row = got[doc.doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((doc.text or "").encode()).hexdigest()
