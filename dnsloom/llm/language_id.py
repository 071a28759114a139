"""Language ID by letter trigrams in a bit-sliced Bloom filter of language masks.

Each filter position holds one mask with a bit per language; a trigram's mask is the AND of its
positions, so one lookup returns every language that contains it. Per language the hits of a
text are counted, corrected for the filter's false positives, and the largest share decides.

Trigrams are windows of three characters around a letter, case folded, with everything that is
no letter as a word edge. A language contains a trigram if its share there is at least
`min_share` and not far below the largest share in any language. Counts cover all training
rows; a language has at most 1 / min_share trigrams, which bounds the filter.

Nulls, empty texts and texts without a letter get `und` with score 0, as does everything if
there is no training row. Ties go to the language that sorts first. Rows are scored one by
one: repeated rows and extra columns change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from dnsloom.llm.common import code_points, letter_table, mixed, pieces_of

UNKNOWN = "und"
_DENSE_CELLS = 1 << 22


@dataclass(frozen=True)
class LanguageSettings:
    """min_share: least share of a language's trigrams. near_best: least part of the largest
    share in any language. hashes, bits_per_entry: shape of the Bloom filter."""

    min_share: float = 1.0 / (1 << 17)
    near_best: float = 0.2
    hashes: int = 4
    bits_per_entry: int = 12


def trigrams(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct keys, which of them each trigram is, text of each trigram)."""
    folded = [text.lower() if text else "" for text in texts]
    codes, starts = code_points(folded)
    letter = letter_table()[codes]
    at = np.flatnonzero(letter)
    if not len(at):
        empty = np.zeros(0, np.int64)
        return empty.astype(np.uint64), empty, empty
    alphabet = np.flatnonzero(np.bincount(codes[at]))
    rank = np.zeros(int(alphabet[-1]) + 1, np.int64)
    rank[alphabet] = np.arange(1, len(alphabet) + 1)
    ranks = np.zeros(len(codes) + 2, np.int64)
    ranks[at + 1] = rank[codes[at]]
    size = len(alphabet) + 1
    owner = np.searchsorted(starts, at, side="right") - 1
    before, after = ranks[at], ranks[at + 2]
    before[starts[owner] == at] = 0
    after[starts[owner + 1] == at + 1] = 0
    window = (before * size + ranks[at + 1]) * size + after
    if size**3 <= _DENSE_CELLS:
        present = np.flatnonzero(np.bincount(window, minlength=size**3))
        place = np.zeros(size**3, np.int64)
        place[present] = np.arange(len(present))
        which = place[window]
    else:
        present, which = np.unique(window, return_inverse=True)
    points = np.concatenate([[0], alphabet]).astype(np.uint64)
    first, middle, last = present // (size * size), present // size % size, present % size
    shift = np.uint64(21)
    keys = ((points[first] << shift) | points[middle]) << shift | points[last]
    return keys, which, owner


@dataclass(frozen=True)
class LanguageFilter:
    """The bit-sliced filter: row `p` of `masks` has the languages that set position `p`."""

    languages: list[str]
    masks: np.ndarray
    hashes: int

    @classmethod
    def build(cls, languages: list[str], keys: np.ndarray, language: np.ndarray, s):
        bits = max(10, int(np.ceil(np.log2(max(1, len(keys)) * s.bits_per_entry))))
        masks = np.zeros((1 << bits, max(1, -(-len(languages) // 64))), np.uint64)
        bit = np.uint64(1) << (language % 64).astype(np.uint64)
        for seed in range(s.hashes):
            position = (mixed(keys, seed) >> np.uint64(64 - bits)).astype(np.int64)
            np.bitwise_or.at(masks, (position, language // 64), bit)
        return cls(languages, masks, s.hashes)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """One mask per key: all languages that contain it (and false positives)."""
        bits = int(len(self.masks)).bit_length() - 1
        found = None
        for seed in range(self.hashes):
            row = self.masks[(mixed(keys, seed) >> np.uint64(64 - bits)).astype(np.int64)]
            found = row if found is None else found & row
        return found

    def false_rate(self) -> np.ndarray:
        """Per language, the chance that a foreign trigram is found."""
        fill = [self._bit(self.masks, k).mean() for k in range(len(self.languages))]
        return np.array(fill) ** self.hashes

    @staticmethod
    def _bit(masks: np.ndarray, k: int) -> np.ndarray:
        return (masks[:, k // 64] >> np.uint64(k % 64)) & np.uint64(1)

    def predict(self, texts: Sequence[str | None]) -> pd.DataFrame:
        """lang_pred and score (corrected share of the text's trigrams found) per text."""
        parts = [self._predict(texts[a:b]) for a, b in pieces_of(texts)]
        return pd.concat(parts or [self._predict([])], ignore_index=True)

    def _predict(self, texts: Sequence[str | None]) -> pd.DataFrame:
        keys, which, owner = trigrams(texts)
        total = np.bincount(owner, minlength=len(texts)).astype(float)
        share = np.zeros((len(self.languages) + 1, len(texts)))
        masks = self.lookup(keys)
        for k, wrong in enumerate(self.false_rate()):
            hits = np.bincount(owner, self._bit(masks, k)[which], minlength=len(texts))
            share[k] = (hits / np.maximum(total, 1) - wrong) / max(1e-9, 1 - wrong)
        best = share[:-1].argmax(axis=0) if self.languages else np.zeros(len(texts), int)
        score = np.clip(share[best, np.arange(len(texts))], 0.0, 1.0)
        known = total > 0 if self.languages else np.zeros(len(texts), bool)
        names = np.array([*self.languages, UNKNOWN], object)
        return pd.DataFrame(
            {"lang_pred": np.where(known, names[best], UNKNOWN), "score": np.where(known, score, 0)}
        )


def count_trigrams(labelled: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    """(lang, key, n): trigram counts per language over all rows, added up inside each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lang, rows in batch.groupby("lang"):
                texts = rows["text"].tolist()
                for a, b in pieces_of(texts, 4_000_000):
                    keys, which, _ = trigrams(texts[a:b])
                    n = np.bincount(which, minlength=len(keys))
                    name = np.full(len(keys), lang, object)
                    yield pd.DataFrame({"lang": name, "key": keys.view(np.int64), "n": n})

    rows = labelled.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = rows.dropna().mapInPandas(run, "lang string, key long, n long")
    return counts.groupBy("lang", "key").agg(F.sum("n").alias("n"))


def train(
    labelled: DataFrame,
    lang_col: str = "lang",
    text_col: str = "text",
    settings: LanguageSettings | None = None,
) -> LanguageFilter:
    """The filter over all rows with a text and a language."""
    s = settings or LanguageSettings()
    counts = count_trigrams(labelled, lang_col, text_col)
    by_lang, by_key = Window.partitionBy("lang"), Window.partitionBy("key")
    share = F.col("n") / F.sum("n").over(by_lang)
    kept = (
        counts.withColumn("share", share)
        .where(F.col("share") >= s.min_share)
        .withColumn("best", F.max("share").over(by_key))
        .where(F.col("share") >= s.near_best * F.col("best"))
        .select("lang", "key")
        .toPandas()  # at most 1 / min_share rows per language
    )
    languages = sorted(kept["lang"].unique())
    index = {lang: k for k, lang in enumerate(languages)}
    language = kept["lang"].map(index).to_numpy(np.int64) if len(kept) else np.zeros(0, np.int64)
    keys = kept["key"].to_numpy(np.int64).view(np.uint64)
    return LanguageFilter.build(languages, keys, language, s)


def language_of(spark: SparkSession, model: LanguageFilter, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in texts:
            yield shared.value.predict(batch.tolist())

    return predict(text)
