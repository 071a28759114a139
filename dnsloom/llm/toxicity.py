"""Toxicity of documents, with obfuscated spellings restored by a noisy-channel decoder.

Letters written as digits or marks, stretched letters, and letters set apart by blanks or marks
span a lattice of readings. Viterbi search finds the reading that is likeliest under a
character trigram model (counted over all texts) and the costs of the channel. The restored
words and the plain words of a text are then looked up among words and word beginnings that
labelled documents show to be toxic; each one found is taken as a cause of its own (noisy or).

The channel: a text position that is a letter stands for itself; a run of two may be one, a run
of three or more is one or two; a look-alike stands for each of its letters or ends the word; any
other mark is skipped or ends the word. Only spans with more than one reading are decoded; the
words as written count as well. Letters are set apart by any blanks, and marks may stand around
them.

Nulls and empty texts have no evidence and get the lowest score. Without toxic labels every
score is low. Rows are scored one by one: repeated rows and extra columns change nothing.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.llm.common import (
    blank_table,
    code_points,
    labelled_sample,
    letter_table,
    pieces_of,
    word_spans,
)
from dnsloom.operators.staging import stage

# Look-alikes of letters.
LOOK_ALIKES = {
    "0": "o",
    "1": "il",
    "3": "e",
    "4": "a",
    "5": "s",
    "6": "gb",
    "7": "t",
    "8": "b",
    "9": "g",
    "@": "a",
    "$": "s",
    "!": "il",
    "|": "il",
    "+": "t",
    "(": "c",
    "€": "e",
}
_LATIN = [*range(ord("a"), ord("z") + 1), *range(0xDF, 0x100)]
_EDGE, _OTHER = 0, len(_LATIN) + 1
SYMBOLS = len(_LATIN) + 2
_STATES = SYMBOLS * SYMBOLS
_WORD = re.compile(r"[^\W\d_]+")
_DOUBLED = re.compile(r"([^\W\d_])\1")
_SPACED = re.compile(r"(?<!\S)[^\w\s]*?(\S(?:\s+\S){2,})[^\w\s]*(?!\S)")
_BLANKS = re.compile(r"\s+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
# Marks that hardly ever end a sentence: at a word's edge they are read as their letter as well.
_EDGE_LETTERS = str.maketrans({"@": "a", "$": "s", "+": "t", "€": "e"})
_MARKS = "".join(re.escape(c) for c in LOOK_ALIKES if not c.isalnum())
_OUTER_MARKS = re.compile(rf"^(?:(?![{_MARKS}])[\W_])+|(?:(?![{_MARKS}])[\W_])+$")
_BEGINNINGS = (3, 4, 5, 6)
_CAUTION = (1.0, 1.5, 2.0, 3.0, 4.0, 6.0, 8.0)
_UNSEEN = 0.01


@dataclass(frozen=True)
class ToxicitySettings:
    """sample_rows: most labelled documents that evidence is learned from. The costs are
    natural logarithms; `sure` is the normal quantile of the lower bound that a word's share
    of toxic documents has to keep at `least`."""

    sample_rows: int = 20_000
    look_alike_cost: float = 0.7
    break_cost: float = 1.5
    skip_cost: float = 0.7
    single_cost: float = 2.0
    double_cost: float = 1.0
    sure: float = 2.58
    least: float = 0.5
    least_documents: int = 3


def _symbols(codes: np.ndarray) -> np.ndarray:
    """Model symbols of lower-case code points: Latin letters, other letters, or an edge."""
    table = np.where(letter_table(), _OTHER, _EDGE).astype(np.int64)
    table[_LATIN] = np.arange(1, len(_LATIN) + 1)
    return table[codes]


def count_characters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(cell, n): trigram counts over all texts, added up inside each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            texts = [f"  {text.lower()}  " for text in batch["text"] if text]
            for a, b in pieces_of(texts):
                s = _symbols(code_points(texts[a:b])[0])
                cells = (s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:]
                inside = (s[1:-1] != _EDGE) | (s[2:] != _EDGE)
                total += np.bincount(cells[inside], minlength=len(total))
        used = np.flatnonzero(total)
        yield pd.DataFrame({"cell": used, "n": total[used]})

    counts = docs.select(F.col(text_col).alias("text")).mapInPandas(run, "cell long, n long")
    return counts.groupBy("cell").agg(F.sum("n").alias("n"))


@dataclass(frozen=True)
class Restorer:
    """The decoder: costs[a, b, c] is the cost of symbol c after a and b."""

    costs: np.ndarray
    settings: ToxicitySettings = field(default_factory=ToxicitySettings)

    @classmethod
    def fit(cls, docs: DataFrame, settings: ToxicitySettings, text_col: str = "text"):
        rows = count_characters(docs, text_col).toPandas()  # at most SYMBOLS ** 3 rows
        counts = np.zeros(SYMBOLS**3)
        counts[rows["cell"].to_numpy()] = rows["n"].to_numpy()
        return cls.from_counts(counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS), settings)

    @classmethod
    def from_counts(cls, three: np.ndarray, settings: ToxicitySettings) -> Restorer:
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + SYMBOLS)
        p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
        p3 = (three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)
        return cls(-np.log(p3).astype(np.float32), settings)

    def readings(self, span: str) -> list[list[tuple[str, float]]]:
        """The lattice: for each run of equal characters its readings (a blank is an edge)."""
        s, lattice, at = self.settings, [], 0
        while at < len(span):
            char, end = span[at], at + 1
            while end < len(span) and span[end] == char:
                end += 1
            run, at = end - at, end
            if char.isalpha():
                if run == 1:
                    lattice.append([(char, 0.0)])
                else:
                    costs = (s.single_cost, 0.0) if run == 2 else (0.0, s.double_cost)
                    lattice.append([(char, costs[0]), (char * 2, costs[1])])
            elif char in LOOK_ALIKES:
                ways = [(c * n, s.look_alike_cost * n) for c in LOOK_ALIKES[char] for n in (1, 2)]
                ways = ways if run > 1 else [w for w in ways if len(w[0]) == 1]
                lattice.append([*ways, (" ", s.break_cost)])
            else:
                lattice.append([("", s.skip_cost), (" ", s.break_cost)])
        return lattice

    def restore(self, span: str) -> str:
        """The likeliest reading of a span."""
        return _restored(self, span)

    @cached_property
    def listed(self) -> list[float]:
        """The costs in one list, which is faster to look into one by one."""
        return self.costs.ravel().tolist()

    def search(self, span: str) -> str:
        """Viterbi over the lattice; a state is the last two symbols, as one number."""
        costs, symbol = self.listed, _symbol_of
        states: dict[int, tuple[float, tuple]] = {_EDGE: (0.0, ())}
        for ways in [*self.readings(span), [(" ", 0.0)]]:
            steps = [(text, extra, [symbol(char) for char in text]) for text, extra in ways]
            following: dict[int, tuple[float, tuple]] = {}
            for state, (cost, path) in states.items():
                for text, extra, found in steps:
                    at, total = state, cost + extra
                    for c in found:
                        if c != _EDGE or at % SYMBOLS != _EDGE:
                            cell = at * SYMBOLS + c
                            total += costs[cell]
                            at = cell % _STATES
                    known = following.get(at)
                    if known is None or total < known[0]:
                        following[at] = (total, (path, text))
            states = following
        path, parts = min(states.values(), key=lambda state: state[0])[1], []
        while path:
            path, text = path
            parts.append(text)
        return "".join(reversed(parts)).strip()


@lru_cache(maxsize=4096)
def _symbol_of(char: str) -> int:
    return int(_symbols(np.array([ord(char)]))[0])


@lru_cache(maxsize=20_000)
def _restore_cached(key: int, span: str) -> str:
    return _decoders[key].search(span)


_decoders: dict[int, Restorer] = {}


def _restored(restorer: Restorer, span: str) -> str:
    key = id(restorer)
    if key not in _decoders:
        _decoders.clear()
        _restore_cached.cache_clear()
        _decoders[key] = restorer
    return _restore_cached(key, span)


@lru_cache(maxsize=20_000)
def _spans_of(token: str) -> tuple[str, ...]:
    """The spans of one lower-case token that have more than one reading."""
    if token.isalpha():
        return (token,) if _DOUBLED.search(token) else ()
    inner = _OUTER.sub("", token)
    if not inner:
        return ()
    if not inner.isalpha():
        return (token,) if _WORD.search(token) else ()
    spans = {inner} if _DOUBLED.search(inner) else set()
    marked = _OUTER_MARKS.sub("", token)
    if marked != inner and not (marked == "(" + inner and ")" in token):
        spans |= {marked, marked.translate(_EDGE_LETTERS)}
    return tuple(sorted(spans))


# Kinds of code points within a token.
_LETTER, _HARMLESS, _NOISY = 1, 2, 3


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point whether it is a letter, a mark that is only ever stripped, or neither;
    made once per Python worker. Marks above 0x2FFFF count as neither."""
    kinds = np.where(letter_table(), np.uint8(_LETTER), np.uint8(_NOISY))
    low = range(0x30000)
    kinds[[i for i in low if not chr(i).isalnum() and chr(i) not in LOOK_ALIKES]] = _HARMLESS
    kinds[blank_table()] = 0
    return kinds


def _noisy_tokens(texts: Sequence[str], codes: np.ndarray) -> list[set[str]]:
    """Of each text, the tokens that may have such spans; `codes`: of the texts, a blank behind each.

    Not those of at most one run of letters, none doubled, and else marks that are stripped.
    """
    kinds = _kinds()[codes]
    letter = kinds == _LETTER
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    doubled = np.zeros(len(codes), bool)
    doubled[1:] = letter[1:] & (codes[1:] == codes[:-1])
    sure = doubled | (kinds == _NOISY)
    begin, end = word_spans(codes, blank_table())
    signs = np.cumsum(first + 2 * sure, dtype=np.int64)
    noisy = signs[end - 1] - signs[begin] + (first + 2 * sure)[begin] > 1
    begin, end = begin[noisy], end[noisy]
    starts = np.cumsum([0, *(len(text) + 1 for text in texts)])
    bound = np.searchsorted(begin, starts)
    out = []
    for i, text in enumerate(texts):
        part = slice(bound[i], bound[i + 1])
        spans = zip((begin[part] - starts[i]).tolist(), (end[part] - starts[i]).tolist(), strict=True)
        out.append({text[a:b] for a, b in spans})
    return out


def noisy_spans(texts: Sequence[str]) -> list[list[str]]:
    """Of each lower-case text, the spans that have more than one reading."""
    codes, starts = code_points([text + " " for text in texts])
    blank = blank_table()[codes]
    apart = blank[:-2] & ~blank[1:-1] & blank[2:]
    spaced = np.bincount(np.searchsorted(starts, np.flatnonzero(apart) + 1, "right") - 1, minlength=len(texts))
    out = []
    for text, tokens, single in zip(texts, _noisy_tokens(texts, codes), spaced.tolist(), strict=True):
        spans = [span for token in tokens for span in _spans_of(token)]
        if single:
            spans += [_BLANKS.sub("·", m.group(1)) for m in _SPACED.finditer(text)]
        out.append(spans)
    return out


def words_of(texts: Sequence[str | None], restorer: Restorer) -> list[set[str]]:
    """The distinct words of each text, plain and restored."""
    out = []
    for a, b in pieces_of(texts):
        lower = [(text or "").lower() for text in texts[a:b]]
        for text, spans in zip(lower, noisy_spans(lower), strict=True):
            words = set(_WORD.findall(text))
            for span in spans:
                words.update(restorer.restore(span).split())
            out.append(words)
    return out


def _features(words: set[str]) -> set[str]:
    """Words as they are, and their beginnings marked by a star."""
    found = set(words)
    for n in _BEGINNINGS:
        found.update([w[:n] + "*" for w in words if len(w) > n])
    return found


@dataclass(frozen=True)
class Toxicity:
    """evidence: least chance that a document with the word (or beginning) is toxic; caution: the
    power its chances are raised to, the likeliest for the sample."""

    restorer: Restorer
    evidence: dict[str, float]
    caution: float = 1.0

    def chances(self, texts: Sequence[str | None]) -> list[list[float]]:
        """The chances of all toxic words of each text."""
        table, out, least = self._tables(), [], min(_BEGINNINGS)
        first = {start[:least] for n in _BEGINNINGS for start in table[n]}
        for words in words_of(texts, self.restorer):
            hits = words & table[0]
            near = [w for w in words if w[:least] in first]
            for n in _BEGINNINGS:
                hits |= {w for w in near if len(w) > n and w[:n] in table[n]}
            out.append([self._chance(word) for word in sorted(hits)])
        return out

    def combine(self, chances: list[float], caution: float) -> float:
        """1 less the chance that nothing found makes the text toxic."""
        return 1 - (1 - _UNSEEN) * float(np.prod([1 - p**caution for p in chances]))

    def score(self, texts: Sequence[str | None]) -> np.ndarray:
        return np.array([self.combine(x, self.caution) for x in self.chances(texts)], float)

    def _tables(self) -> dict[int, set[str]]:
        table = {0: {w for w in self.evidence if not w.endswith("*")}}
        for n in _BEGINNINGS:
            table[n] = {w[:-1] for w in self.evidence if len(w) == n + 1 and w.endswith("*")}
        return table

    def _chance(self, word: str) -> float:
        names = [word, *(word[:n] + "*" for n in _BEGINNINGS if len(word) > n)]
        return max(self.evidence.get(name, 0.0) for name in names)


def lower_bound(part: np.ndarray, whole: np.ndarray, z: float) -> np.ndarray:
    """Wilson's lower bound of a share."""
    p, n = part / whole, whole
    middle = p + z * z / (2 * n)
    return (middle - z * np.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def train(
    docs: DataFrame, labels: DataFrame, settings: ToxicitySettings | None = None
) -> Toxicity:
    """The model for `labels.toxic`, learned outside the held-out fold (id remainder 0 of 5).

    Characters are counted over all documents. The labelled sample (bounded by `sample_rows`) is
    stored once; features of its toxic documents are counted first, then the same features in
    the others.
    """
    s = settings or ToxicitySettings()
    spark = docs.sparkSession
    restorer = Restorer.fit(docs, s)
    shared = spark.sparkContext.broadcast(restorer)
    sample = stage(labelled_sample(docs, labels, "toxic", s.sample_rows, 5), "toxic").df

    def counted(rows: DataFrame, known=None) -> pd.DataFrame:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            seen: Counter = Counter()
            only = known.value if known else None
            for batch in batches:
                for words in words_of(batch["text"].tolist(), shared.value):
                    found = _features(words)
                    seen.update(found & only if only is not None else found)
            names = pd.Series(list(seen), dtype=object)
            yield pd.DataFrame({"name": names, "n": np.array(list(seen.values()), np.int64)})

        names = rows.mapInPandas(run, "name string, n long").groupBy("name")
        return names.agg(F.sum("n").alias("n")).where(F.col("n") >= 1)

    toxic = counted(sample.where("label = 1")).where(F.col("n") >= s.least_documents).toPandas()
    known = spark.sparkContext.broadcast(set(toxic["name"]))
    clean = counted(sample.where("label = 0"), known).toPandas()
    both = toxic.merge(clean, on="name", how="left", suffixes=("", "_clean")).fillna({"n_clean": 0})
    both = both.sort_values("name")
    n = both["n"].to_numpy(float)
    chance = lower_bound(n, n + both["n_clean"].to_numpy(float), s.sure) if len(n) else n
    evidence = {w: float(p) for w, p in zip(both["name"], chance, strict=True) if p >= s.least}
    fitted = spark.sparkContext.broadcast(model := Toxicity(restorer, evidence))

    def fits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = fitted.value.chances(batch["text"].tolist())
            label = batch["label"].to_numpy()
            for caution in _CAUTION:
                p = np.clip([fitted.value.combine(x, caution) for x in found], 1e-3, 1 - 1e-3)
                yield pd.DataFrame(
                    {"caution": [caution], "gain": [np.log(np.where(label == 1, p, 1 - p)).sum()]}
                )

    gains = sample.mapInPandas(fits, "caution double, gain double").groupBy("caution")
    best = gains.agg(F.round(F.sum("gain"), 6).alias("gain")).orderBy(F.desc("gain"), "caution")
    chosen = best.head()
    return Toxicity(restorer, evidence, chosen["caution"] if chosen else 1.0)


def toxicity_of(spark: SparkSession, model: Toxicity, text: Column) -> Column:
    """The toxicity score (0 to 1) of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(shared.value.score(batch.tolist()))

    return score(text)
