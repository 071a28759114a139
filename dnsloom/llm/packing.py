"""Packing of token sequences: first-fit decreasing over a tournament tree of free room.

A document's ids (with an end id) are cut at multiples of the sequence length; every cut piece
then goes into the first sequence with enough room, longest pieces first. Each inner node of
the tree holds the largest room below it, so that sequence is found in a logarithmic number of
steps. Pieces are dealt into randomised groups of about `group_pieces`, which are packed
independently: no task holds more than one group, however large a document or a source is.

Null texts count as empty (they still have the end id), repeated rows are packed once each,
ties in length go by id and start, extra columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

import os
import string
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.llm.common import pieces_of, span_hashes, word_spans
from dnsloom.operators.staging import stage


@dataclass(frozen=True)
class PackSettings:
    """length: tokens per sequence. group_pieces: mean number of pieces packed together.
    cached_words: bound of each Python worker's table of words."""

    length: int = 2048
    end_id: int = 1
    group_pieces: int = 8192
    cached_words: int = 300_000


class RoomTree:
    """Free room of the open sequences, with the largest room of each subtree above them."""

    def __init__(self, length: int, most: int):
        self.width = 1 << max(0, most - 1).bit_length()
        self.room = [length] * (2 * self.width)

    def place(self, need: int) -> tuple[int, int]:
        """(sequence, room it had): the first one with room for `need`, which is then used."""
        room, node = self.room, 1
        while node < self.width:
            node *= 2
            if room[node] < need:
                node += 1
        had = room[node]
        room[node] = had - need
        at = node // 2
        while at:
            largest = max(room[2 * at], room[2 * at + 1])
            if room[at] == largest:
                break
            room[at] = largest
            at //= 2
        return node - self.width, had


def first_fit(lengths: Sequence[int], length: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece, placed in the given order."""
    tree = RoomTree(length, len(lengths))
    sequences, offsets = [], []
    for need in lengths:
        sequence, had = tree.place(need)
        sequences.append(sequence)
        offsets.append(length - had)
    return sequences, offsets


# Marks that may end a word, one or a run of them.
_MARKS = string.punctuation
_MARK = "."
# Kinds of code points below _KINDS; all above are of no kind.
_LETTER, _PUNCTUATION, _KINDS = 1, 2, 0x30000
# Longer words are known by a digest: running sums do not tell all long texts apart.
_LONG = 256
_tokenizers: dict = {}


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """For each code point whether it is a folded letter or a mark; made once per Python worker."""
    kinds = np.fromiter((c.isalpha() and c == c.lower() for c in map(chr, range(_KINDS))), np.uint8, _KINDS)
    kinds[[ord(c) for c in _MARKS]] = _PUNCTUATION
    return np.append(kinds, np.uint8(0))


@lru_cache(maxsize=1)
def _gaps() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[ord(c) for c in " \n\t"]] = True
    return table


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places of runs that have these starts and sizes, one run after the other."""
    end = np.cumsum(size)
    return np.repeat(start - (end - size), size) + np.arange(end[-1] if len(end) else 0)


class _Words:
    """Ids of words by the words' hashes, which are in order."""

    def __init__(self):
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros((2, 0), np.int64)
        self.ids = np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.keys)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, or -1."""
        if not len(self.keys):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, -1)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Puts in new words, in any order; `ids` are those of all of them."""
        order = np.argsort(keys)
        start = len(self.ids) + np.cumsum(size) - size
        at = np.searchsorted(self.keys, keys[order])
        self.keys = np.insert(self.keys, at, keys[order])
        self.start = np.insert(self.start, at, start[order])
        self.size = np.insert(self.size, at, size[order])
        self.ids = np.concatenate([self.ids, ids])

    def of(self, at: np.ndarray) -> np.ndarray:
        """The ids of the words at these places, one after the other."""
        return self.ids[_ragged(self.start[at], self.size[at])]


class WordEncoder:
    """Ids of texts by a tokenizer that folds case, drops white space and keeps runs of letters
    apart from marks: words and the marks behind them are encoded once and kept, by 64-bit hashes
    that are made for all words of many texts at once. (Capital sigma folds by its context in
    Python, so texts that hold one are folded by the tokenizer alone.) A text that spells out a
    special token is encoded as a whole, as only there it stands for that token's id."""

    def __init__(self, path: str, cached_words: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        (self.mark,) = self.tokenizer.encode(_MARK, add_special_tokens=False).ids
        self.entries = max(1, cached_words // 2)
        self.new, self.old = _Words(), _Words()
        self.fresh: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str, cached_words: int) -> WordEncoder:
        if path not in _tokenizers:
            _tokenizers.clear()
            _tokenizers[path] = cls(path, cached_words)
        return _tokenizers[path]

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        whole = {i: self._whole(t) for i, t in enumerate(texts) if any(s in t for s in self.special)}
        folded = ["" if i in whole else t if "\u03a3" in t else t.lower() for i, t in enumerate(texts)]
        joined = f" {' '.join(folded)} "
        codes = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        begin, end, plain = self._units(codes)
        keys = span_hashes(codes, begin, end)
        for i in np.flatnonzero(end - begin > _LONG):
            word = joined[begin[i] : end[i]].encode()
            keys[i] = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        # The distinct words, and which of them each one is.
        order = np.argsort(keys)
        ordered = keys[order]
        first = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
        which = np.empty(len(keys), np.int64)
        which[order] = np.cumsum(first) - 1
        keys, shown = ordered[first], order[first]
        if len(self.new) >= self.entries:
            self.old, self.new = self.new, _Words()
        missing = self.new.find(keys) < 0
        kept = self.old.find(keys[missing])
        known = kept[kept >= 0]
        unknown = shown[missing][kept < 0]
        spans = zip(begin[unknown].tolist(), end[unknown].tolist(), strict=True)
        words, self.fresh = [joined[a:b] for a, b in spans], {}
        self._look_up([w for w, p in zip(words, plain[unknown].tolist(), strict=True) if p], 1000)
        self._look_up([w for w, p in zip(words, plain[unknown].tolist(), strict=True) if not p], 1)
        data = [self.fresh[word] for word in words]
        self.new.add(
            np.concatenate([self.old.keys[known], keys[missing][kept < 0]]),
            np.concatenate([self.old.size[known], np.array([len(d) // 4 for d in data], np.int64)]),
            np.concatenate([self.old.of(known), np.frombuffer(b"".join(data), "<u4")]),
        )
        at = self.new.find(keys)[which]
        data = self.new.of(at).tobytes()
        ends = np.append(0, 4 * np.cumsum(self.new.size[at]))
        starts = np.cumsum([1, *(len(t) + 1 for t in folded)])
        bound = ends[np.searchsorted(begin, starts)].tolist()
        found = [data[a:b] for a, b in zip(bound, bound[1:], strict=False)]
        for i, ids in whole.items():
            found[i] = ids
        return found

    def _units(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(begin, end, whether it is of folded letters only) of what is encoded by itself: words,
        but for those of folded letters with marks behind them the letters, then the marks."""
        begin, end = word_spans(codes, _gaps())
        kinds = _kinds().take(codes, mode="clip")
        letters = np.cumsum(kinds == _LETTER)
        other = np.where(kinds == _PUNCTUATION, 0, np.arange(len(codes)))
        stem = np.maximum.accumulate(other)[end - 1] + 1
        plain = (stem > begin) & (letters[stem - 1] - letters[begin - 1] == stem - begin)
        marked = plain & (stem < end)
        at = np.arange(len(begin)) + np.cumsum(marked) - marked
        starts, stops = np.empty((2, len(begin) + int(marked.sum())), np.int64)
        alone = np.zeros(len(starts), bool)
        starts[at], stops[at], alone[at] = begin, np.where(plain, stem, end), plain
        behind = at[marked] + 1
        starts[behind], stops[behind] = stem[marked], end[marked]
        return starts, stops, alone

    def _whole(self, text: str) -> bytes:
        self.tokenizer.encode_special_tokens = False
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        self.tokenizer.encode_special_tokens = True
        return np.array(ids, "<u4").tobytes()

    def _look_up(self, words: list[str], joined: int) -> None:
        """Encodes words; words of letters only may be `joined` in one text by a mark, at whose id
        the ids are parted again. Offsets, which cost the most, are not asked for."""
        for k in range(0, len(words), 20_000):
            parts = [words[i : i + joined] for i in range(k, min(len(words), k + 20_000), joined)]
            texts = [_MARK.join(part) for part in parts]
            for part, found in zip(
                parts, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True
            ):
                ids = np.array(found.ids, "<u4")
                stored = ids.tobytes()
                if joined == 1:
                    self.fresh[part[0]] = stored
                    continue
                marks = (4 * np.flatnonzero(ids == self.mark)).tolist()
                if len(marks) != len(part) - 1:
                    # A letter to Python is none to the tokenizer: it took a mark together with it.
                    self._look_up(part, 1)
                    continue
                starts = [0, *(at + 4 for at in marks)]
                for word, start, end in zip(part, starts, [*marks, len(stored)], strict=True):
                    self.fresh[word] = stored[start:end]


def token_pieces(
    docs: DataFrame,
    tokenizer: str,
    settings: PackSettings,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens[, ids]): each document cut at the length."""
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    most, end = settings.length, np.array([settings.end_id], "<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = WordEncoder.of(tokenizer, settings.cached_words)
        for batch in batches:
            texts = [text or "" for text in batch[text_col]]
            for a, b in pieces_of(texts):
                rows, ids = [], []
                for row, found in enumerate(encoder.encode(texts[a:b]), a):
                    data = found + end
                    for start in range(0, len(data) // 4, most):
                        part = data[4 * start : 4 * (start + most)]
                        rows.append((row, start, len(part) // 4, zlib.crc32(part), len(data) // 4))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                names = ["row", "start", "length", "ids_crc32", "doc_tokens"]
                out = pd.DataFrame(rows, columns=names)
                out.insert(0, id_col, batch[id_col].to_numpy()[out.pop("row").to_numpy()])
                yield out.assign(ids=ids) if with_ids else out

    schema += ", ids array<int>" if with_ids else ""
    return docs.select(id_col, text_col).mapInPandas(run, schema)


def pack(pieces: DataFrame, settings: PackSettings, id_col: str = "doc_id") -> DataFrame:
    """`pieces` with sequence_id and offset added.

    Equal pieces are numbered first, so that copies of one row are dealt into many groups.
    """
    names = pieces.columns
    staged = stage(pieces, "pieces")
    groups = max(1, -(-staged.rows // settings.group_pieces))
    copies = (
        staged.df.groupBy(*names)
        .agg(F.count(F.lit(1)).alias("__copies"))
        .withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies").cast("int"))))
        .drop("__copies")
    )
    place = F.xxhash64(*[F.col(n) for n in (id_col, "start", "ids_crc32")], F.col("__copy"))
    dealt = copies.withColumn("__group", F.pmod(place, F.lit(groups)))

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "start", "__copy"], ascending=[False] + 3 * [True])
        sequence, offset = first_fit(rows["length"].tolist(), settings.length)
        first = int(key[0]) << 32
        rows = rows.assign(sequence_id=np.array(sequence, np.int64) + first, offset=offset)
        return rows[[*names, "sequence_id", "offset"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("__group").applyInPandas(run, f"{fields}, sequence_id long, offset long")


def assemble(pieces: DataFrame, placed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(sequence_id, ids): the sequences themselves; `pieces` were cut with their ids.

    Rows of a sequence are at most its length in tokens, so no group is large.
    """
    keys = [id_col, "start", "ids_crc32"]
    cut = pieces.select(*keys, "ids").dropDuplicates(keys)
    joined = placed.join(cut, keys)
    return joined.groupBy("sequence_id").agg(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda piece: piece["ids"]
            )
        ).alias("ids")
    )
