"""Byte-level BPE by prefix dynamic programming.

BPE leaves each byte prefix with exactly one last token. `last[i]` stores it for the prefix of
`i` bytes; a token may follow another one if BPE would not merge across their seam. The
encoding is read off from the end. Appended bytes only add entries, and an edit only changes
entries up to where the table agrees with the old one again.

Nulls encode as empty texts. Rows are handled one by one: repeated rows, ties and extra columns
change nothing, an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame

from dnsloom.llm.common import mixed

_NEVER = 1 << 62
_GROUP_BYTES = 2_000_000
_DECODED_ROWS = 500
_SHORT_BYTES = 48
_SIDE_BY_SIDE = 4096
_MARKS = (".", ",", ";", ":", "!", "?")
_SPACE_THEN_BLANK = re.compile(r" \s")


class Cache:
    """A bounded dict in two generations: what was used lately survives a turn-over."""

    def __init__(self, entries: int):
        self.entries, self.new, self.old = max(1, entries // 2), {}, {}

    def turn_over(self) -> None:
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, {}

    def missing(self, keys: set) -> list:
        """Those of the keys that are not held; what the older generation holds is kept on."""
        unknown = []
        for key in keys - self.new.keys():
            value = self.old.get(key)
            if value is None:
                unknown.append(key)
            else:
                self.new[key] = value
        return unknown


class Vocabulary:
    """Tokens by rank, the trie over them, and how BPE splits each of them.

    pair_entries, piece_entries: bounds of the caches.
    """

    def __init__(self, ranks: dict[bytes, int], pair_entries=500_000, piece_entries=400_000):
        self.ranks = ranks
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=0)
        self.next_node: dict[int, int] = {}
        self.ends: list[int] = []
        self._halves: dict[int, tuple[int, int] | None] = {}
        self._seams: dict[int, bool] = {}
        self._pair_entries = pair_entries
        self._pieces, self._words = Cache(piece_entries // 4), Cache(piece_entries)
        self._many: PieceTable | None = None

    def grow_trie(self) -> None:
        """Builds the trie that encoding walks; decoding does without it."""
        if self.ends:
            return
        self.ends = [-1]
        for token, rank in self.ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                node = self.next_node.get(key, 0)
                if not node:
                    node = self.next_node[key] = len(self.ends)
                    self.ends.append(-1)
            self.ends[node] = rank

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs})

    def halves(self, rank: int) -> tuple[int, int] | None:
        """The two tokens that BPE merges into this one; None for a byte.

        A token that merging never reaches is its own half twice, and so fits nowhere.
        """
        found = self._halves.get(rank, 0)
        if found != 0:
            return found
        token = self.tokens[rank]
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best = min(
                (self.ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1)
            )
            if best[0] >= rank:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        if len(token) == 1:
            split = None
        elif len(parts) == 2 and all(p in self.ranks for p in parts):
            split = (self.ranks[parts[0]], self.ranks[parts[1]])
        else:
            split = (rank, rank)
        self._halves[rank] = split
        return split

    def reachable(self, rank: int) -> bool:
        return self.halves(rank) != (rank, rank)

    def seam_holds(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes ends with exactly these two."""
        key = left << 32 | right
        known = self._seams.get(key)
        if known is None:
            if len(self._seams) >= self._pair_entries:
                self._seams.clear()
            known = self._seams[key] = self._seam(left, right)
        return known

    def _seam(self, left: int, right: int) -> bool:
        # Undo the merges on both sides, latest first. Two neighbours that meet before either
        # is merged into its parent must not have a merge of their own that comes earlier.
        # Equal ranks are merged from the left.
        if not (self.reachable(left) and self.reachable(right)):
            return False
        left_until = right_until = _NEVER
        tokens, ranks = self.tokens, self.ranks
        while True:
            merge = ranks.get(tokens[left] + tokens[right], _NEVER)
            if merge < left_until and merge <= right_until and merge != _NEVER:
                return False
            left_halves, right_halves = self.halves(left), self.halves(right)
            left_time = left if left_halves else -1
            right_time = right if right_halves else -1
            if left_time < 0 and right_time < 0:
                return True
            if right_time >= left_time:
                right_until, right = right_time, right_halves[0]
            else:
                left_until, left = left_time, left_halves[1]

    def encode_bytes(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one piece of the split text."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        return PrefixTable(self, piece).ids()

    def encode_many(self, pieces: list[bytes]) -> list[bytes]:
        """The ids (as int32 bytes) of many pieces: short ones side by side, long ones alone."""
        if self._many is None:
            self._many = PieceTable(self)
        out: list = [None] * len(pieces)
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        short = [i for i in order if 0 < len(pieces[i]) <= _SHORT_BYTES]
        for k in range(0, len(short), _SIDE_BY_SIDE):
            chosen = short[k : k + _SIDE_BY_SIDE]
            for i, ids in zip(chosen, self._many.encode([pieces[i] for i in chosen]), strict=True):
                out[i] = ids
        for i in order:
            if out[i] is None:
                out[i] = np.array(self.encode_bytes(pieces[i]), np.int32).tobytes()
        return out

    def encode_texts(self, texts: list[str], split, at_spaces: bool) -> list[bytes]:
        """The ids of each text as int32 bytes; `split` cuts a text into pieces (findall of the pattern).

        at_spaces: a match of the pattern always starts at a space that a visible character
        follows, the letters after it belong to it, and a mark that ends the word is a match
        of its own. Words between such spaces are then looked up whole.
        """
        self._pieces.turn_over()
        self._words.turn_over()
        heads: list[list[str]] = []
        tails: list[list[str]] = []
        for text in texts:
            if not at_spaces or _SPACE_THEN_BLANK.search(text):
                heads.append(split(text))
                tails.append([])
            else:
                first, *words = text.split(" ")
                heads.append(split(first))
                tails.append(words)
        unknown = self._words.missing(set().union(*tails))
        single = {w for w in unknown if w.isalpha()}
        marked = [w for w in unknown if w[-1:] in _MARKS and w[:-1].isalpha()]
        cut = {w: split(" " + w) for w in set(unknown).difference(single, marked)}
        heads.append(list(_MARKS))
        wanted = self._pieces.missing(set().union(*heads, *cut.values()))
        single.update(self._words.missing({w[:-1] for w in marked}))
        names = [p.encode() for p in wanted] + [b" " + w.encode() for w in single]
        found = self.encode_many(names)
        pieces, words = self._pieces.new, self._words.new
        pieces.update(zip(wanted, found, strict=False))
        words.update(zip(single, found[len(wanted) :], strict=True))
        for word in marked:
            words[word] = words[word[:-1]] + pieces[word[-1]]
        for word, parts in cut.items():
            words[word] = b"".join(map(pieces.__getitem__, parts))
        return [
            b"".join(chain(map(pieces.__getitem__, h), map(words.__getitem__, t)))
            for h, t in zip(heads, tails, strict=False)
        ]


class PieceTable:
    """The prefix tables of many short pieces at once, as numpy arrays."""

    def __init__(self, vocabulary: Vocabulary):
        vocabulary.grow_trie()
        self.vocabulary = vocabulary
        keys = np.fromiter(vocabulary.next_node, np.int64, len(vocabulary.next_node))
        self.step = np.zeros(len(vocabulary.ends) << 8, np.int32)
        self.step[keys] = np.fromiter(vocabulary.next_node.values(), np.int32, len(keys))
        self.ends = np.array(vocabulary.ends, np.int32)
        self.size = np.zeros(max(vocabulary.tokens) + 1, np.int32)
        for rank, token in vocabulary.tokens.items():
            self.size[rank] = len(token)
        # Known seams: one slot per hash; what falls on a used slot takes it over.
        self.slots = np.full(1 << 20, -1, np.int64)
        self.holds = np.zeros(1 << 20, bool)

    def seams(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) << 32 | right
        slot = mixed(keys, 0) >> np.uint64(44)
        out, known = self.holds[slot], self.slots[slot] == keys
        if not known.all():
            lost = np.flatnonzero(~known)
            fresh, back = np.unique(keys[lost], return_inverse=True)
            seam = self.vocabulary.seam_holds
            value = np.array([seam(k >> 32, k & 0xFFFFFFFF) for k in fresh.tolist()], bool)
            out[lost] = value[back]
            self.slots[slot[lost]] = keys[lost]
            self.holds[slot[lost]] = out[lost]
        return out

    def encode(self, pieces: list[bytes]) -> list[bytes]:
        count, sizes = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        most = int(sizes.max())
        data = np.zeros((most, count), np.uint8)
        flat = np.frombuffer(b"".join(p.ljust(most, b"\0") for p in pieces), np.uint8)
        data[:] = flat.reshape(count, most).T
        last = np.full((most + 1, count), -1, np.int32)
        reach = self.vocabulary.reachable
        for start in range(most):
            rows = np.flatnonzero(sizes > start)
            node = np.zeros(len(rows), np.int32)
            for end in range(start + 1, min(most, start + self.vocabulary.longest) + 1):
                node = self.step[(node.astype(np.int64) << 8) | data[end - 1, rows]]
                going = (node > 0) & (sizes[rows] >= end)
                rows, node = rows[going], node[going]
                if not len(rows):
                    break
                token = self.ends[node]
                may = np.flatnonzero((token >= 0) & (last[end, rows] < 0))
                if not len(may):
                    continue
                at, token = rows[may], token[may]
                if start:
                    fits = self.seams(last[start, at], token)
                else:
                    distinct, back = np.unique(token, return_inverse=True)
                    fits = np.array([reach(t) for t in distinct.tolist()], bool)[back]
                last[end, at[fits]] = token[fits]
        ids = np.zeros((count, most), np.int32)
        used, end, rows = np.zeros(count, np.int64), sizes.copy(), np.arange(count)
        while len(rows):
            token = last[end[rows], rows]
            if (token < 0).any():
                raise ValueError("the vocabulary lacks single bytes of this text")
            used[rows] += 1
            ids[rows, most - used[rows]] = token
            end[rows] -= self.size[token]
            rows = rows[end[rows] > 0]
        whole = self.vocabulary.ranks.get
        for i, piece in enumerate(pieces):
            token = whole(piece)
            if token is not None:
                used[i], ids[i, -1] = 1, token
        stored, width = ids.tobytes(), 4 * most
        return [stored[(i + 1) * width - 4 * n : (i + 1) * width] for i, n in enumerate(used.tolist())]


class PrefixTable:
    """The last token of each prefix of some bytes; grows and is mended in place."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b""):
        vocabulary.grow_trie()
        self.vocabulary, self.data = vocabulary, bytearray()
        self.last: list[int] = [-1]
        self.recomputed = 0
        self.append(data)

    def append(self, more: bytes) -> None:
        """Adds bytes at the end: entries of shorter prefixes stay as they are."""
        start = len(self.data)
        self.data += more
        self.last += [-1] * len(more)
        self._fill(max(0, start + 1 - self.vocabulary.longest), start)

    def replace(self, start: int, stop: int, new: bytes) -> None:
        """Puts `new` in place of bytes start..stop and recomputes only what that changes."""
        tail = self.last[stop + 1 :]
        shift = start + len(new) - stop
        self.data[start:stop] = new
        self.last = self.last[: start + 1] + [-1] * (len(self.data) - start)
        done = start + len(new)
        same, longest = 0, self.vocabulary.longest
        self._fill(max(0, start + 1 - longest), start, done)
        while done < len(self.data) and same < longest:
            done += 1
            self._fill(max(0, done - longest), done - 1, done)
            same = same + 1 if self.last[done] == tail[done - shift - stop - 1] else 0
        if done < len(self.data):
            self.last[done + 1 :] = tail[done - shift - stop :]

    def _fill(self, first: int, known: int, until: int | None = None) -> None:
        """Sets the entries after `known` up to `until` from tokens that start at `first` on."""
        voc, data, last = self.vocabulary, self.data, self.last
        step, ends, seams, slow = voc.next_node.get, voc.ends, voc._seams.get, voc.seam_holds
        until = len(data) if until is None else until
        self.recomputed += until - known
        for start in range(first, until):
            before = last[start]
            if before < 0 and start:
                continue
            node = 0
            for end in range(start + 1, until + 1):
                node = step(node << 8 | data[end - 1], 0)
                if not node:
                    break
                token = ends[node]
                if token < 0 or end <= known or last[end] >= 0:
                    continue
                if start:
                    fits = seams(before << 32 | token)
                    if fits is None:
                        fits = slow(before, token)
                else:
                    fits = voc.reachable(token)
                if fits:
                    last[end] = token

    def ids(self) -> tuple[int, ...]:
        out, end = [], len(self.data)
        while end > 0:
            token = self.last[end]
            if token < 0:
                raise ValueError("the vocabulary lacks single bytes of this text")
            out.append(token)
            end -= len(self.vocabulary.tokens[token])
        out.reverse()
        return tuple(out)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a rank file, read once per Python worker."""
    if path not in _loaded:
        _loaded.clear()
        _loaded[path] = Vocabulary.load(path)
    return _loaded[path]


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about `_GROUP_BYTES` of text."""
    sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0).to_numpy()
    group = np.cumsum(sizes) // _GROUP_BYTES
    bounds = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for start, stop in zip(bounds, bounds[1:], strict=False):
        if stop > start:
            yield batch.slice(start, stop - start)


def _encoded(voc: Vocabulary, texts: pa.Array, split, at_spaces: bool) -> pa.ListArray:
    found = voc.encode_texts([t or "" for t in texts.to_pylist()], split, at_spaces)
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    ends = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(found), np.int32)))


class Decoder:
    """Bytes of token ids, gathered from one buffer that holds all tokens."""

    def __init__(self, vocabulary: Vocabulary):
        tokens = vocabulary.tokens
        table = [tokens.get(rank, b"") for rank in range(max(tokens, default=-1) + 1)]
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.begin = np.cumsum(self.size) - self.size
        self.letters = np.frombuffer(b"".join(table), np.uint8)

    def decode(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each list (a null list decodes to no bytes)."""
        count = pa.compute.fill_null(pa.compute.list_value_length(ids), 0)
        bounds = np.append(0, np.cumsum(count.to_numpy(zero_copy_only=False)))
        flat = ids.flatten().to_numpy()
        size = self.size[flat]
        ends = np.append(0, np.cumsum(size))
        place = np.arange(ends[-1]) + np.repeat(self.begin[flat] - ends[:-1], size)
        data, offsets = self.letters[place], ends[bounds].astype(np.int32)
        buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
        return pa.Array.from_buffers(pa.binary(), len(ids), buffers)


def encode(
    docs: DataFrame,
    vocab: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    at_spaces: bool = False,
    decoded: bool = False,
) -> DataFrame:
    """(id, ids array<int>[, decoded binary]): each match of `pattern` is encoded on its own,
    without special tokens.

    vocab: rank file, present on every machine (a parameter of the installation).
    at_spaces: see `Vocabulary.encode_texts`.
    decoded: also decode the ids again, in the same task.
    """
    kind = docs.schema[id_col].dataType
    names = [id_col, "ids", "decoded"] if decoded else [id_col, "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, split = vocabulary(vocab), regex.compile(pattern).findall
        decoder = Decoder(voc)
        for batch in batches:
            for part in _slices(batch, 1):
                columns = [part.column(0), _encoded(voc, part.column(1), split, at_spaces)]
                if decoded:
                    columns.append(decoder.decode(columns[1]))
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {kind.simpleString()}, ids array<int>" + ", decoded binary" * decoded
    return docs.select(id_col, text_col).mapInArrow(run, schema)


def decode(encoded: DataFrame, vocab: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded binary): the bytes that the ids stand for."""
    kind = encoded.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(vocabulary(vocab))
        for batch in batches:
            for start in range(0, batch.num_rows, _DECODED_ROWS):
                part = batch.slice(start, _DECODED_ROWS)
                columns = [part.column(0), part.column(1), decoder.decode(part.column(1))]
                yield pa.RecordBatch.from_arrays(columns, [id_col, "ids", "decoded"])

    schema = f"`{id_col}` {kind.simpleString()}, ids array<int>, decoded binary"
    return encoded.select(id_col, "ids").mapInArrow(run, schema)
