"""Log-likelihood of whole documents under a gated recurrent language model.

Tokens are words (A-Z folded, between blanks) and one end per document. The commonest words
are symbols of their own; any other word is one of a few rare symbols, told by its last two
letters, times its smoothed share among the training words of that symbol. So every text has a
proper probability, and the words' counts cover the whole training corpus.

The network is a gated recurrent unit whose output is factored into classes of symbols: the class
first, then the symbol within it. It starts from the symbols' counted shares and is trained by
truncated backpropagation in numpy: in each round every task trains on its share of the round's
documents, and the weights are averaged. Over the rounds every training document is learned from.

Scoring runs many documents side by side; a lane takes the next document when one ends, and the
state is carried from window to window through the whole document.

Words are known by 64-bit hashes. Nulls count as empty texts (one end). Repeated rows are scored
each. Extra columns are ignored, an empty table gives an empty table; without training rows
all words are unknown.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import code_points, pieces_of, span_hashes, word_spans
from dnsloom.operators.staging import stage

END = np.uint64(0x0E0D)
_END_ID = int(END)
# Characters of texts that are split at once: their arrays stay in a core's cache.
_PIECE = 100_000


@dataclass(frozen=True)
class LmSettings:
    """classes, per_class: output factoring (their product is the number of symbols). rare:
    symbols for other words. state: size of the network's state. rounds, slice_part:
    documents are dealt into `slice_part` slices (at least `rounds`) and the slices into rounds in
    turn, so each document belongs to one round. lanes, window: documents side by side and
    steps of a backpropagation. least_updates: per task and round, repeating its documents if
    needed. frequent: tokens with at least 1 / frequent of all tokens are looked up in a table
    that every task gets (so it has at most that many rows), others by a join."""

    classes: int = 32
    per_class: int = 32
    rare: int = 64
    state: int = 24
    rounds: int = 3
    slice_part: int = 20
    lanes: int = 64
    window: int = 16
    least_updates: int = 120
    rate: float = 0.01
    scoring_lanes: int = 1024
    scoring_window: int = 32
    frequent: int = 1 << 20

    @property
    def symbols(self) -> int:
        return self.classes * self.per_class


def _blank() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


_table: np.ndarray | None = None


def tokens_of(texts: Sequence[str | None], rare: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash of each token, its rare symbol, tokens per text); each text ends with END."""
    global _table
    if _table is None:
        _table = _blank()
    codes, starts = code_points([(text or "") + " " for text in texts])
    codes = codes.view(np.uint32)
    codes |= (codes - np.uint32(65) < 26).astype(np.uint32) << np.uint32(5)
    begin, end = word_spans(codes, _table)
    hashes = span_hashes(codes, begin, end)
    ending = codes[end - 1] * np.uint32(31) + np.where(end - 1 > begin, codes[end - 2], 0) * np.uint32(7)
    group = (ending % rare).astype(np.int16)
    words = np.diff(np.searchsorted(begin, starts))
    place = np.cumsum(words)
    return np.insert(hashes, place, END), np.insert(group, place, 0), words + 1


class _Counts:
    """Token counts of a task: each piece's tokens are counted, the pieces merged now and then."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, hashes: np.ndarray, group: np.ndarray) -> None:
        self.parts.append(_counted(hashes, group, np.ones(len(hashes), np.int64)))
        self.rows += len(self.parts[-1][0])
        if self.rows > 3_000_000:
            self.merge()

    def merge(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        merged = _counted(*(np.concatenate(x) for x in zip(*self.parts, strict=True)))
        self.parts, self.rows = [merged], 0
        return merged


def _counted(hashes: np.ndarray, group: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct tokens, sorted, with their counts added up."""
    order = np.argsort(hashes)
    hashes, group, n = hashes[order], group[order], n[order]
    first = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1]))
    return hashes[first], group[first], np.add.reduceat(n, first)


def count_tokens(docs: DataFrame, s: LmSettings) -> DataFrame:
    """(token, symbol_group, n) over all texts of `docs`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = _Counts()
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in pieces_of(texts, _PIECE):
                hashes, group, _ = tokens_of(texts[a:b], s.rare)
                counts.add(hashes, group)
                if len(counts.parts) == 1 and len(counts.parts[0][0]) > 2_000_000:
                    yield _frame(counts.merge())
                    counts = _Counts()
        if counts.parts:
            yield _frame(counts.merge())

    def _frame(merged) -> pd.DataFrame:
        hashes, group, n = merged
        return pd.DataFrame({"token": hashes.view(np.int64), "symbol_group": group.astype(np.int32), "n": n})

    counted = docs.select("text").mapInPandas(run, "token long, symbol_group int, n long")
    return counted.groupBy("token").agg(F.min("symbol_group").alias("symbol_group"), F.sum("n").alias("n"))


class HashTable:
    """Positions of hashes in a sorted table; leading bits tell where to begin, so a few steps do."""

    def __init__(self, table: np.ndarray):
        bits = len(table).bit_length() + 3
        self.size, self.shift = len(table), np.uint64(64 - bits)
        self.table = np.append(table, ~np.uint64(0))
        begin = np.arange(1 << bits, dtype=np.uint64) << self.shift
        self.begin = np.searchsorted(table, begin).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Position of each key, or -1."""
        at = self.begin[keys >> self.shift]
        value = self.table[at]
        late = np.flatnonzero(value < keys)
        while len(late):
            at[late] += 1
            value[late] = self.table[at[late]]
            late = late[value[late] < keys[late]]
        at[(value != keys) | (at == self.size)] = -1
        return at


@dataclass
class Lexicon:
    """What scoring knows of the corpus. words: hashes of the symbols that are words, sorted,
    with their symbols. frequent: tokens looked up in the task, sorted; frequent_gain: log10 of
    their count plus one. log_rest: for each rare symbol log10 of its smoothed total."""

    words: HashTable
    symbols: np.ndarray
    frequent: HashTable
    frequent_gain: np.ndarray
    log_rest: np.ndarray
    shares: np.ndarray
    tokens: int
    distinct: int

    def symbol_of(self, hashes: np.ndarray, group: np.ndarray, rare_first: int) -> np.ndarray:
        """Symbol of each token: its own, or the rare symbol of its group."""
        found = self.words.find(hashes)
        own = self.symbols[np.maximum(found, 0)] if len(self.symbols) else 0
        return np.where(found >= 0, own, rare_first + group).astype(np.int16)


def lexicon(counts: DataFrame, s: LmSettings) -> Lexicon:
    """Totals, the symbols and the table of frequent tokens from all token counts."""
    groups = counts.groupBy("symbol_group").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v"))
    groups = groups.toPandas().set_index("symbol_group").reindex(range(s.rare), fill_value=0)
    rest_n, rest_v = groups["n"].to_numpy(np.int64).copy(), groups["v"].to_numpy(np.int64).copy()
    tokens, distinct = int(rest_n.sum()), int(rest_v.sum())
    chosen = counts.where(F.col("token") != _END_ID).orderBy(F.desc("n"), "token")
    chosen = chosen.limit(s.symbols - s.rare - 1).toPandas()
    ends = counts.where(F.col("token") == _END_ID).toPandas()
    own = pd.concat([ends, chosen], ignore_index=True)
    frequent = counts.where(F.col("n") * s.frequent >= tokens).select("token", "n").toPandas()
    group = own["symbol_group"].to_numpy(np.int64)
    n = own["n"].to_numpy(np.int64)
    np.subtract.at(rest_n, group, n)
    np.subtract.at(rest_v, group, 1)
    # Symbols: rare ones first in this list, then END and words; ranked by count into classes.
    count = np.zeros(s.symbols, np.int64)
    count[: s.rare] = rest_n
    count[s.rare : s.rare + len(n)] = n
    hashes = own["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    table = frequent["token"].to_numpy(np.int64).view(np.uint64)
    sort = np.argsort(table)
    return Lexicon(
        words=HashTable(hashes[order]),
        symbols=(s.rare + np.arange(len(n)))[order].astype(np.int16),
        frequent=HashTable(table[sort]),
        frequent_gain=np.log10(frequent["n"].to_numpy(np.int64)[sort] + 1.0),
        log_rest=np.log10(rest_n + rest_v + 1.0),
        shares=(count + 1.0) / (count.sum() + s.symbols),
        tokens=tokens,
        distinct=distinct,
    )


class Network:
    """The gated recurrent unit and its class-factored output; all weights in one flat array.

    Gates stand in front (update, reset, new state), so that those of a step lie together. The
    first two open as the sum before them falls: 1 / (1 + exp(sum)).
    """

    def __init__(self, s: LmSettings, shares: np.ndarray):
        self.s = s
        h, n = s.state, s.symbols
        self.shapes = {
            "enter": (3, n, h),
            "carry": (3, h, h),
            "carry_bias": (3, h),
            "to_class": (h, s.classes),
            "class_bias": (s.classes,),
            "to_symbol": (s.classes, h, s.per_class),
            "symbol_bias": (s.classes, s.per_class),
        }
        ends = np.cumsum([math.prod(x) for x in self.shapes.values()]).tolist()
        self.places = dict(zip(self.shapes, map(slice, [0, *ends], ends), strict=False))
        self.flat = np.zeros(ends[-1], np.float32)
        w = self.views(self.flat)
        random = np.random.default_rng(11)
        w["enter"][:] = random.normal(0, 0.1, (n, 3, h)).transpose(1, 0, 2)
        w["carry"][:] = random.normal(0, 0.5 / np.sqrt(h), (h, 3, h)).transpose(1, 0, 2)
        # Slow forgetting at the start: the update gate mostly keeps the state.
        w["carry_bias"][0] = 2.0
        for name in ("enter", "carry", "carry_bias"):
            np.negative(w[name][:2], out=w[name][:2])
        order = np.argsort(-shares, kind="stable")
        place = np.empty(n, np.int16)
        place[order] = np.arange(n)
        self.class_of, self.within = place // s.per_class, place % s.per_class
        by_class = shares[order].reshape(s.classes, s.per_class)
        w["class_bias"][:] = np.log(by_class.sum(axis=1))
        w["symbol_bias"][:] = np.log(by_class / by_class.sum(axis=1, keepdims=True))

    def views(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        return {name: flat[at].reshape(self.shapes[name]) for name, at in self.places.items()}

    def steps(self, w, symbols: np.ndarray, fresh: np.ndarray, h: np.ndarray, back: bool = False):
        """Runs a window. symbols, fresh: (steps, lanes); fresh cells start a document.

        Returns the states before each step, what backpropagation needs (if `back`), and the last
        state.
        """
        (steps, lanes), size = symbols.shape, self.s.state
        carry, kind, new = w["carry"], w["carry"].dtype, fresh.any(axis=1).tolist()
        states, kept = np.empty((steps + 1, lanes, size), kind), steps if back else 1
        gates = np.empty((kept, 2, lanes, size), kind)
        q, n = np.empty((2, kept, lanes, size), kind)
        inner, bias = np.empty((2, 3, lanes, size), kind)
        bias[:] = w["carry_bias"][:, None]
        gate_inner, new_inner, gate_bias, new_bias = inner[:2], inner[2], bias[:2], bias[2]
        symbols, some = symbols.astype(np.intp), max(1, _CELLS // max(lanes, 1))
        states[0] = h
        for t in range(steps):
            if t % some == 0:
                outer = w["enter"].take(symbols[t : t + some], 1, mode="clip")
            at, entered = t if back else 0, outer[:, t % some]
            gate, qt, nt, h, after = gates[at], q[at], n[at], states[t], states[t + 1]
            if new[t]:
                h[fresh[t]] = 0
            np.matmul(h, carry, out=inner)
            np.add(gate_inner, entered[:2], out=gate)
            np.add(gate, gate_bias, out=gate)
            np.exp(gate, out=gate)
            np.add(gate, 1, out=gate)
            np.reciprocal(gate, out=gate)
            np.add(new_inner, new_bias, out=qt)
            np.multiply(gate[1], qt, out=nt)
            np.add(nt, entered[2], out=nt)
            np.tanh(nt, out=nt)
            np.subtract(h, nt, out=after)
            np.multiply(after, gate[0], out=after)
            np.add(after, nt, out=after)
        return states[:steps], (gates, q, n), states[steps]

    def log_chance(self, w, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Natural log-probability of each symbol, given the state before it (flat arrays)."""
        kind = self.class_of[symbols]
        order = np.argsort(kind, kind="stable")
        states, kind, place = states.take(order, 0), kind[order], self.within[symbols[order]]
        rows = np.arange(len(symbols))
        scores = states @ w["to_class"]
        inner = np.empty((len(symbols), self.s.per_class), scores.dtype)
        spans = self._spans(kind)
        for c, a, b in spans:
            np.matmul(states[a:b], w["to_symbol"][c], out=inner[a:b])
        found = scores[rows, kind] + w["class_bias"][kind]
        found += inner[rows, place]
        found += w["symbol_bias"][kind, place]
        found -= _log_sum(scores, w["class_bias"][None], [(0, 0, len(symbols))])
        found -= _log_sum(inner, w["symbol_bias"], spans)
        out = np.empty_like(found)
        out[order] = found
        return out

    def _spans(self, kind: np.ndarray) -> list[tuple[int, int, int]]:
        """(class, begin, end) of the classes that occur in a sorted list."""
        bound = np.searchsorted(kind, np.arange(self.s.classes + 1)).tolist()
        return [(c, a, b) for c, (a, b) in enumerate(zip(bound, bound[1:], strict=False)) if a < b]

    def gradient(self, w, symbols, fresh, active, h, into: np.ndarray | None = None):
        """(gradient of the mean loss of a window, state after it); `into`: array to be used."""
        size = self.s.state
        states, (gates, q, n), last = self.steps(w, symbols, fresh, h, back=True)
        flat = np.empty_like(self.flat) if into is None else into
        flat[:] = 0
        g = self.views(flat)
        before = states.reshape(-1, size)
        weight = (active.ravel() / max(1, active.sum())).astype(flat.dtype)
        back = self._output_gradient(w, g, before, symbols.ravel(), weight).reshape(states.shape)
        # What a step passes on, but for the factor that comes from later steps: the new state as
        # the state carries it, both gates, the new state as the symbol enters it.
        z, r = gates[:, 0], gates[:, 1]
        rest = 1 - z
        through, to = np.empty((2, 4, *states.shape), flat.dtype)
        np.multiply(n, n, out=through[3])
        np.subtract(1, through[3], out=through[3])
        through[3] *= rest
        np.multiply(through[3], r, out=through[0])
        np.subtract(n, states, out=through[1])
        through[1] *= z
        through[1] *= rest
        np.subtract(r, 1, out=through[2])
        through[2] *= q
        through[2] *= through[0]
        later, turned = np.zeros_like(states[0]), w["carry"][[2, 0, 1]].transpose(0, 2, 1)
        carried, new = np.empty((3, *later.shape), flat.dtype), fresh.any(axis=1).tolist()
        total, second, third = carried
        for t in range(len(symbols) - 1, -1, -1):
            np.multiply(through[:, t], later, out=to[:, t])
            np.matmul(to[:3, t], turned, out=carried)
            np.multiply(later, z[t], out=later)
            np.add(total, second, out=total)
            np.add(total, third, out=total)
            np.add(later, total, out=later)
            np.add(later, back[t], out=later)
            if new[t]:
                later[fresh[t]] = 0
        to = to.reshape(4, -1, size)
        np.matmul(before.T, to[1:3], out=g["carry"][:2])
        np.matmul(before.T, to[0], out=g["carry"][2])
        one = np.ones(len(before), flat.dtype)
        np.matmul(one, to[1:3], out=g["carry_bias"][:2])
        np.matmul(one, to[0], out=g["carry_bias"][2])
        used = symbols.ravel()
        order = np.argsort(used, kind="stable")
        ordered = used[order]
        first = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
        g["enter"][:, ordered[first]] = np.add.reduceat(to[1:].take(order, 1), first, axis=1)
        return flat, last

    def _output_gradient(self, w, g, states, symbols, weight) -> np.ndarray:
        """Sets the gradients of the output weights in `g`; returns that of the states.

        Rows are sorted by class, so that those of a class are multiplied in one go.
        """
        kind = self.class_of[symbols]
        order = np.argsort(kind, kind="stable")
        kind, place, weight = kind[order], self.within[symbols[order]], weight[order]
        states, rows, spans = states.take(order, 0), np.arange(len(symbols)), self._spans(kind)
        chance = states @ w["to_class"]
        chance += w["class_bias"]
        _chances_less_found(chance, rows, kind, weight)
        np.matmul(states.T, chance, out=g["to_class"])
        np.add.reduce(chance, axis=0, out=g["class_bias"])
        back = chance @ w["to_class"].T
        inner, part = np.empty((len(rows), self.s.per_class), states.dtype), np.empty_like(back)
        for c, a, b in spans:
            np.matmul(states[a:b], w["to_symbol"][c], out=inner[a:b])
        inner += w["symbol_bias"].take(kind, 0)
        _chances_less_found(inner, rows, place, weight)
        turned = w["to_symbol"].transpose(0, 2, 1)
        for c, a, b in spans:
            np.matmul(states[a:b].T, inner[a:b], out=g["to_symbol"][c])
            np.matmul(inner[a:b], turned[c], out=part[a:b])
        if spans:
            g["symbol_bias"][[c for c, _, _ in spans]] = np.add.reduceat(inner, [a for _, a, _ in spans])
        back += part
        out = np.empty_like(back)
        out[order] = back
        return out


# Lanes times steps whose symbols are looked up at once.
_CELLS = 1024
# Scores and biases within this range can be exponentiated and multiplied as they are.
_PLAIN = 40.0


def _is_plain(x: np.ndarray) -> bool:
    return x.max(initial=0) <= _PLAIN and x.min(initial=0) >= -_PLAIN


def _log_sum(x: np.ndarray, bias: np.ndarray, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """Log of the sum of exp(x + bias) of each row; `x` is used up.

    spans: (row of `bias`, begin, end) of the rows of `x`.
    """
    total, top = np.empty(len(x), x.dtype), None
    if _is_plain(x) and _is_plain(bias):
        factor = np.exp(bias)
    else:
        for c, a, b in spans:
            x[a:b] += bias[c]
        top = x.max(axis=1)
        x -= top[:, None]
        factor = np.ones_like(bias)
    np.exp(x, out=x)
    for c, a, b in spans:
        np.matmul(x[a:b], factor[c], out=total[a:b])
    np.log(total, out=total)
    return total if top is None else total + top


def _chances_less_found(x: np.ndarray, rows: np.ndarray, found: np.ndarray, weight: np.ndarray) -> None:
    """Shares of exp within each row less 1 for what was found, times the row's weight, in place."""
    if not _is_plain(x):
        x -= x.max(axis=1)[:, None]
    np.exp(x, out=x)
    x *= (weight / (x @ np.ones(x.shape[1], x.dtype)))[:, None]
    x[rows, found] -= weight


def lanes_of(lengths: np.ndarray, lanes: int) -> list[list[int]]:
    """Texts per lane, longest first onto the emptiest lane; longest lanes first."""
    heap = [(0, k) for k in range(min(lanes, len(lengths)))]
    out: list[list[int]] = [[] for _ in heap]
    for text in np.argsort(-lengths, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        out[k].append(text)
        heapq.heappush(heap, (used + int(lengths[text]), k))
    return sorted(out, key=lambda lane: -sum(int(lengths[t]) for t in lane))


def _laid_out(symbols: np.ndarray, lengths: np.ndarray, lanes: int):
    """(symbols, text number or -1, whether a text starts) as (step, lane) arrays."""
    starts = np.cumsum(lengths) - lengths
    plan = lanes_of(lengths, lanes)
    steps = max((int(lengths[lane].sum()) for lane in plan), default=0)
    grid = np.zeros((steps, len(plan)), np.int16)
    text = np.full((steps, len(plan)), -1, np.int32)
    fresh = np.zeros((steps, len(plan)), bool)
    for k, lane in enumerate(plan):
        at = 0
        for t in lane:
            n = int(lengths[t])
            grid[at : at + n, k] = symbols[starts[t] : starts[t] + n]
            text[at : at + n, k] = t
            fresh[at, k] = True
            at += n
    return grid, text, fresh


def score_symbols(network: Network, symbols: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Natural log-probability of each text's symbols; states go on through whole texts."""
    s, w = network.s, network.views(network.flat)
    grid, text, fresh = _laid_out(symbols, lengths, s.scoring_lanes)
    out = np.zeros(len(lengths))
    h = np.zeros((grid.shape[1], s.state), np.float32)
    for at in range(0, len(grid), s.scoring_window):
        part = slice(at, at + s.scoring_window)
        width = int((text[at] >= 0).sum())  # lanes are sorted: the running ones stand in front
        x, owner = grid[part, :width], text[part, :width]
        states, _, h = network.steps(w, x, fresh[part, :width], h[:width])
        flat, x, owner = states.reshape(-1, s.state), x.ravel(), owner.ravel()
        if owner.min() < 0:
            live = owner >= 0
            flat, x, owner = flat[live], x[live], owner[live]
        out += np.bincount(owner, network.log_chance(w, flat, x), len(lengths))
    return out


def _train_locally(network: Network, symbols: np.ndarray, lengths: np.ndarray) -> None:
    """Adam over windows of truncated backpropagation, at least `least_updates` of them."""
    s = network.s
    grid, text, fresh = _laid_out(symbols, lengths, s.lanes)
    # Adam's averages of gradients and of their squares, ten and a hundred times as great.
    mean, square, grad = np.zeros((3, len(network.flat)), network.flat.dtype)
    step = 0
    w = network.views(network.flat)
    while True:
        h = np.zeros((grid.shape[1], s.state), np.float32)
        for at in range(0, len(grid), s.window):
            part = slice(at, at + s.window)
            grad, h = network.gradient(w, grid[part], fresh[part], text[part] >= 0, h, grad)
            size = math.sqrt(float(grad @ grad))
            if size > 1:
                grad *= 1 / size
            step += 1
            mean *= 0.9
            mean += grad
            np.multiply(grad, grad, out=grad)
            square *= 0.99
            square += grad
            np.sqrt(square, out=grad)
            bent = math.sqrt(1 - 0.99**step)
            grad += 1e-5 * bent
            np.divide(mean, grad, out=grad)
            grad *= s.rate * bent / (1 - 0.9**step)
            network.flat -= grad
        if step >= s.least_updates:
            return


def _symbols_of_batch(texts: Sequence[str | None], words: Lexicon, s: LmSettings):
    """(symbols, tokens per text) of many texts, some pieces of them at a time."""
    symbols, lengths = [np.zeros(0, np.int16)], [np.zeros(0, np.int64)]
    for a, b in pieces_of(texts, _PIECE):
        hashes, group, count = tokens_of(texts[a:b], s.rare)
        symbols.append(words.symbol_of(hashes, group, 0))
        lengths.append(count)
    return np.concatenate(symbols), np.concatenate(lengths)


def turn_of(id_col: str, s: LmSettings) -> Column:
    """The round (from 0) that trains on a document."""
    return F.pmod(F.pmod(F.xxhash64(id_col, F.lit(0)), F.lit(s.slice_part)), F.lit(s.rounds))


def train(docs: DataFrame, words: Lexicon, s: LmSettings, id_col: str = "doc_id") -> Network:
    """The network, trained in rounds that share out all of `docs` and averaged after each."""
    spark = docs.sparkSession
    network = Network(s, words.shares)
    known = spark.sparkContext.broadcast(words)
    for turn in range(s.rounds):
        start = spark.sparkContext.broadcast(network.flat)

        def run(batches: Iterator[pd.DataFrame], start=start) -> Iterator[pd.DataFrame]:
            local, tokens = Network(s, known.value.shares), 0
            local.flat[:] = start.value
            for batch in batches:
                symbols, lengths = _symbols_of_batch(batch["text"].tolist(), known.value, s)
                if len(lengths):
                    _train_locally(local, symbols, lengths)
                    tokens += int(lengths.sum())
            if tokens:
                part = TaskContext.get().partitionId()
                yield pd.DataFrame(
                    {"part": [part], "tokens": [float(tokens)], "weights": [local.flat.tobytes()]}
                )

        def add(rows: pd.DataFrame) -> pd.DataFrame:
            share = rows["tokens"].to_numpy() / rows["tokens"].sum()
            total = sum(p * np.frombuffer(b, np.float32) for p, b in zip(share, rows["weights"], strict=True))
            return pd.DataFrame(
                {
                    "part": [int(rows["part"].iloc[0]) // 64],
                    "tokens": [rows["tokens"].sum()],
                    "weights": [total.astype(np.float32).tobytes()],
                }
            )

        schema = "part long, tokens double, weights binary"
        trained = docs.where(turn_of(id_col, s) == turn).select("text").mapInPandas(run, schema)
        for _ in range(2):
            trained = trained.groupBy(F.floor(F.col("part") / 64)).applyInPandas(add, schema)
        rows = trained.toPandas().sort_values("part")
        if len(rows):
            network.flat[:] = np.frombuffer(add(rows)["weights"][0], np.float32)
    return network


def score(
    docs: DataFrame,
    training: Column,
    settings: LmSettings | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    training: which rows are learned from. Scores are log10 probabilities; `base_score` is that
    of single tokens with add-one smoothing, `score` the network's.
    """
    s = settings or LmSettings()
    spark = docs.sparkSession
    given = docs.select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text"), training.alias("training")
    )
    learned = given.where("training")
    counts = stage(count_tokens(learned, s), "tokens").df
    words = lexicon(counts, s)
    network = train(learned, words, s, "id")
    known, net = spark.sparkContext.broadcast(words), spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lex = known.value
        # The last gain is that of tokens not found; symbols that are words have no rest.
        gains = np.append(lex.frequent_gain, 0.0)
        rest = np.append(lex.log_rest, np.zeros(s.symbols - s.rare))
        for batch in batches:
            texts = batch["text"].tolist()
            symbols, base, model, seen, other, lengths = [], [], [], [], [], []
            for a, b in pieces_of(texts, _PIECE):
                hashes, group, count = tokens_of(texts[a:b], s.rare)
                symbol = lex.symbol_of(hashes, group, 0)
                owner = np.repeat(np.arange(b - a), count)
                found = lex.frequent.find(hashes)
                held = found >= 0
                gain = gains[found]
                within = np.where(symbol < s.rare, gain, 0.0) - rest[symbol]
                base.append(np.bincount(owner, gain, b - a))
                model.append(np.bincount(owner, within, b - a))
                seen.append(np.bincount(owner, held, b - a))
                missing = np.split(hashes[~held].view(np.int64), np.cumsum(np.bincount(owner, ~held, b - a))[:-1].astype(np.int64))
                other.extend(missing)
                symbols.append(symbol)
                lengths.append(count)
            if not lengths:
                continue
            length = np.concatenate(lengths)
            chance = score_symbols(net.value, np.concatenate(symbols), length)
            yield pd.DataFrame(
                {
                    "row": batch["row"],
                    "id": batch["id"],
                    "n_tokens": length,
                    "known": np.concatenate(seen).astype(np.int64),
                    "base": np.concatenate(base),
                    "model": np.concatenate(model) + chance / np.log(10),
                    "other": other,
                }
            )

    kind = given.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, n_tokens long, known long, base double, model double, other array<long>"
    rows = given.select("id", "text").withColumn("row", F.monotonically_increasing_id())
    scored = stage(rows.mapInPandas(run, schema), "scored").df
    others = scored.select("row", F.explode("other").alias("token"))
    gained = (
        others.join(counts.select("token", "n"), "token")
        .groupBy("row")
        .agg(F.sum(F.log10(F.col("n") + 1.0)).alias("gain"), F.count(F.lit(1)).alias("more"))
    )
    smoothing = float(np.log10(words.tokens + words.distinct + 1.0))
    gain = F.coalesce("gain", F.lit(0.0))
    return scored.join(gained, "row", "left").select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(words.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + gain - F.col("n_tokens") * smoothing).alias("base_score"),
        (F.col("model") + gain).alias("score"),
    )
