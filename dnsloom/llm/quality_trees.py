"""Quality of documents by gradient-boosted trees over histograms of document statistics.

Statistics are computed per text in numpy; trees are grown on binned statistics of a bounded
sample of labelled rows and flattened into arrays, so that a batch of documents walks down a
tree level by level without a branch.

Nulls count as empty texts, whose statistics are all 0. Without labelled rows every score is
0.5, with one class only it is the smoothed share of that class. Rows are scored one by one:
repeated rows, ties and extra columns change nothing.
"""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.llm.common import code_points, labelled_sample, pieces_of

STATISTICS = [
    "log_chars",
    "log_words",
    "word_length",
    "lower",
    "upper",
    "digit",
    "blank",
    "bar",
    "emphasis",
    "sentence_mark",
    "other_mark",
    "distinct_words",
    "commonest_word",
    "repeated_next",
    "plain_words",
    "upper_words",
    "log_lines",
    "repeated_lines",
    "words_per_line",
]
_LOWER, _UPPER, _DIGIT, _BLANK, _BAR, _EMPHASIS, _SENTENCE, _OTHER = range(8)
_classes: np.ndarray | None = None


def _class_table() -> np.ndarray:
    """The kind of each code point; made once per Python worker."""
    global _classes
    if _classes is None:
        table = np.full(0x110000, _OTHER, np.int8)
        for code in range(0x110000):
            kind = unicodedata.category(chr(code))
            if kind[0] == "L":
                table[code] = _UPPER if kind in ("Lu", "Lt") else _LOWER
            elif kind[0] == "N":
                table[code] = _DIGIT
            elif kind[0] == "Z":
                table[code] = _BLANK
        for marks, kind in (("\t\n\v\f\r ", _BLANK), ("|", _BAR), (".,;:?'\"-()", _SENTENCE)):
            table[[ord(c) for c in marks]] = kind
        table[[ord(c) for c in "!*#$%&@^~=+<>_\\/{}[]"]] = _EMPHASIS
        _classes = table
    return _classes


def statistics(texts: Sequence[str | None]) -> np.ndarray:
    """One row of STATISTICS per text."""
    out = np.zeros((len(texts), len(STATISTICS)), np.float32)
    for a, b in pieces_of(texts):
        out[a:b] = _statistics([text or "" for text in texts[a:b]])
    return out


def _statistics(texts: list[str]) -> np.ndarray:
    codes, starts = code_points(texts)
    length = np.diff(starts)
    owner = np.repeat(np.arange(len(texts)), length)
    kinds = np.bincount(owner * 8 + _class_table()[codes], minlength=8 * len(texts))
    shares = kinds.reshape(-1, 8) / np.maximum(length, 1)[:, None]
    rows = []
    for text in texts:
        words, lines = text.split(), text.split("\n")
        n = max(1, len(words))
        counts = Counter(words)
        filled = [line for line in lines if line.strip()]
        rows.append(
            (
                len(words),
                sum(map(len, words)) / n,
                len(counts) / n,
                max(counts.values(), default=0) / n,
                sum(map(eq, words, words[1:])) / n,
                sum(map(str.isalnum, words)) / n,
                sum(map(str.isupper, words)) / n,
                len(filled),
                (len(filled) - len(set(filled))) / max(1, len(filled)),
                len(words) / max(1, len(filled)),
            )
        )
    words = np.array(rows, float).reshape(len(texts), 10)
    return np.column_stack(
        [
            np.log1p(length),
            np.log1p(words[:, 0]),
            words[:, 1],
            shares,
            words[:, 2:7],
            np.log1p(words[:, 7]),
            words[:, 8],
            np.log1p(words[:, 9]),
        ]
    )


@dataclass(frozen=True)
class TreeSettings:
    """sample_rows: most labelled documents that the trees are fitted on."""

    sample_rows: int = 40_000
    trees: int = 80
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    least_weight: float = 2.0
    ridge: float = 1.0


@dataclass(frozen=True)
class Trees:
    """Complete trees as arrays: node i has the children 2i + 1 and 2i + 2."""

    start: float
    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        """The chance of label 1 for each row of statistics."""
        margin = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < len(feature):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            margin += leaf[node - len(feature)]
        return 1.0 / (1.0 + np.exp(-margin))


def grow(x: np.ndarray, y: np.ndarray, s: TreeSettings) -> Trees:
    """Boosted trees on the logistic loss; splits are searched over histograms of the bins."""
    n, width = x.shape
    p = (y.sum() + 1) / (len(y) + 2)
    start = float(np.log(p / (1 - p)))
    inner, leaves = (1 << s.depth) - 1, 1 << s.depth
    feature = np.zeros((s.trees, inner), np.int64)
    threshold = np.full((s.trees, inner), np.inf, np.float32)
    leaf = np.zeros((s.trees, leaves))
    if n == 0 or y.min() == y.max():
        return Trees(start, feature, threshold, leaf)
    grid = np.linspace(0, 1, s.bins + 1)[1:-1]
    edges = [np.unique(np.quantile(x[:, f], grid).astype(np.float32)) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f]) for f in range(width)], axis=1)
    column = np.arange(width) * s.bins
    margin = np.full(n, start)
    for t in range(s.trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(s.depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (width * s.bins) + column + binned).ravel()
            shape = (count, width, s.bins)
            size = count * width * s.bins
            g = np.bincount(cell, np.repeat(slope, width), size).reshape(shape).cumsum(axis=2)
            h = np.bincount(cell, np.repeat(curve, width), size).reshape(shape).cumsum(axis=2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = (
                g**2 / (h + s.ridge)
                + (all_g - g) ** 2 / (all_h - h + s.ridge)
                - all_g**2 / (all_h + s.ridge)
            )
            gain[(h < s.least_weight) | (all_h - h < s.least_weight)] = 0.0
            for f in range(width):
                gain[:, f, len(edges[f]) :] = 0.0
            best = gain.reshape(count, -1).argmax(axis=1)
            for k in range(count):
                f, cut = divmod(int(best[k]), s.bins)
                if gain[k, f, cut] > 1e-6:
                    feature[t, first + k], threshold[t, first + k] = f, edges[f][cut]
            split = feature[t, node]
            node = 2 * node + 1 + (x[np.arange(n), split] > threshold[t, node])
        at = node - inner
        g, h = np.bincount(at, slope, leaves), np.bincount(at, curve, leaves)
        leaf[t] = s.rate * g / (h + s.ridge)
        margin += leaf[t][at]
    return Trees(start, feature, threshold, leaf)


def train(docs: DataFrame, labels: DataFrame, settings: TreeSettings | None = None) -> Trees:
    """Trees for `labels.quality`, fitted outside the held-out fold (id remainder 0 of 5)."""
    s = settings or TreeSettings()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = statistics(batch["text"].tolist())
            yield pd.DataFrame({"x": list(rows), "label": batch["label"]})

    sample = labelled_sample(docs, labels, "quality", s.sample_rows, 5)
    fitted = sample.mapInPandas(run, "x array<float>, label int").toPandas()
    whole = np.array(fitted["x"].tolist()).reshape(len(fitted), len(STATISTICS))
    order = np.lexsort([fitted["label"], *whole.T])
    fitted = fitted.iloc[order]
    x = np.array(fitted["x"].tolist(), np.float32).reshape(len(fitted), len(STATISTICS))
    return grow(x, fitted["label"].to_numpy(float), s)


def quality_of(spark: SparkSession, model: Trees, text: Column) -> Column:
    """The quality score (0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(statistics(batch.tolist())))

    return score(text)
