from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from dnsloom.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def test_first_fit_against_a_plain_loop():
    rng = random.Random(0)
    for _ in range(30):
        lengths = sorted((rng.randint(1, 64) for _ in range(rng.randint(1, 80))), reverse=True)
        room, want = [], []
        for need in lengths:
            k = next((i for i, r in enumerate(room) if r >= need), len(room))
            if k == len(room):
                room.append(64)
            want.append((k, 64 - room[k]))
            room[k] -= need
        assert list(zip(*packing.first_fit(lengths, 64), strict=True)) == want


def test_words_encode_as_whole_texts_do(tokenizer):
    rng = random.Random(1)
    alphabet = "aAabcdeÉé éΣσςİ中😀ßñ     \n\n\t 　́123'sthe.ing!!\x1c\x85<|>"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(5000)]
    texts += ["", " ", "the " * 3000, "x" * 3000, "<|endoftext|>", "a b<|endoftext|>c <|ENDOFTEXT|> d", "<|ENDOFTEXT|>"]
    texts += ["the <|startoftext|> " * 50, "<|endoftext|"]
    for cached in (100, 100_000):
        encoder = packing.WordEncoder(PATH, cached)
        for start in range(0, len(texts), 500):
            part = texts[start : start + 500]
            for text, ids in zip(part, encoder.encode(part), strict=True):
                want = tokenizer.encode(text, add_special_tokens=False).ids
                assert np.frombuffer(ids, "<u4").tolist() == want, text


def check(rows, texts, tokenizer, length=2048):
    """Every id in one piece, sequences without gaps; returns the sequences' lengths."""
    ids = {i: [tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for t in ts] for i, ts in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    want = {
        key: sorted(
            (a, len(x[a : a + length]), zlib.crc32(np.array(x[a : a + length], "<u4").tobytes()), len(x))
            for x in several
            for a in range(0, len(x), length)
        )
        for key, several in ids.items()
    }
    assert {k: sorted(v) for k, v in pieces.items()} == want
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= length
    return [sum(n for _, n in parts) for parts in sequences.values()]


def test_messy_rows(spark, messy, messy_rows, no_rows, tokenizer):
    texts = defaultdict(list)
    for row in messy_rows:
        texts[row[0]].append(row[1])
    for group in (8192, 4):
        s = packing.PackSettings(group_pieces=group)
        rows = packing.pack(packing.token_pieces(messy, PATH, s), s).collect()
        check(rows, texts, tokenizer)
    s = packing.PackSettings()
    assert packing.pack(packing.token_pieces(no_rows, PATH, s), s).count() == 0


def test_assembled_sequences(spark, messy):
    s = packing.PackSettings(length=64, group_pieces=50)
    cut = packing.token_pieces(messy.where("doc_id < 30"), PATH, s, with_ids=True)
    placed = packing.pack(cut.drop("ids"), s)
    rows = {r.sequence_id: r.ids for r in packing.assemble(cut, placed).collect()}
    for r in placed.collect():
        part = rows[r.sequence_id][r.offset : r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32


def test_query_pads_little(spark, tokenizer):
    folder = "/root/testdata/sf0.01"
    texts = {r.doc_id: [r.text] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    filled = check(queries.op10_packing(spark, folder).collect(), texts, tokenizer)
    assert sum(filled) / (2048 * len(filled)) > 0.98


def test_words_with_runs_of_marks_are_parted(tokenizer):
    """Ids are the library's, and only the runs of marks are encoded one by one."""
    encoder = packing.WordEncoder(PATH, 1000)
    stems = ["alpha", "\u00e9t\u00e9", "cioness", "\u00f1andu", "\U0002ebf0", "\u0130z"]
    texts = [" ".join(f"{stem}{marks}" for stem in stems) for marks in ("", "&&&", "...", "!?", "'", "\"", ".,;")]
    texts += ["it's 'quoted' a.b x1! 3.5% ---", "\u03a3\u03a3!! \u03c3\u03c2&&", "= \u0338 a<\u0338"]
    single, look_up = [], encoder._look_up
    encoder._look_up = lambda words, joined: (single.extend(words) if joined == 1 else None, look_up(words, joined))
    found = encoder.encode(texts)
    assert [np.frombuffer(ids, "<u4").tolist() for ids in found] == [
        tokenizer.encode(t, add_special_tokens=False).ids for t in texts
    ]
    assert "&&&" in single and "alpha&&&" not in single and "alpha" not in single


def test_words_are_kept_without_their_marks(tokenizer):
    """A word is kept once whatever marks follow it; long words that hash alike are told apart."""
    encoder = packing.WordEncoder(PATH, 1000)
    encoder.encode([" ".join(f"{stem}{marks}" for stem in ("alpha", "beta") for marks in ("", ".", "!?", "&&&"))])
    assert len(encoder.new) == 5
    even = "a"
    for _ in range(11):
        even += even.translate({97: 98, 98: 97})
    texts = [even, even.translate({97: 98, 98: 97})]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
