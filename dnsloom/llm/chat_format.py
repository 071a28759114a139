"""Chat formatting: records of many layouts become canonical turns, then marked text.

A record's layout is known by the fingerprint of its nested field paths: a hash of the sorted
paths, list items being one path. The fingerprint selects a declarative mapping that says where
turns, roles and texts are. A record of an unknown layout is passed on as it is, with a null
layout, so that nothing is lost.

Turns are written as `### role: text</turn>` lines. Backslash, `#`, `<` (and in roles colon and
newline) get a backslash in front, so no text can hold a mark and reading back is exact. The loss
mask is the range of each assistant text, without marks.

Null roles and texts count as empty. Turns go by turn number, then role, then text; nulls first.
Repeated rows are turns of their own. Extra fields of a table change nothing, because the query
names the fields it passes; extra fields of a JSON record are a different layout. Conversations
are streamed in order, so one of any length needs the memory of one batch.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, SEPARATOR, CLOSE = "### ", ": ", "</turn>\n"
_TEXT_MARKS = re.compile(r"[\\#<]")
_ROLE_MARKS = re.compile(r"[\\#<:\n]")
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)
_PIECE = re.compile(r"### ((?:[^\\:]|\\.)*): ((?:[^\\<]|\\.)*)</turn>\n", re.DOTALL)


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    single: (role, path) pairs; a path that is absent, null or blank gives no turn.
    items: path of a list whose items are turns, with `role` and `text` inside an item.
    row: the record itself is one turn, numbered by `order`; else turns are numbered by place.
    optional: paths that may be absent. roles: other names of the canonical roles.
    """

    name: str
    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    items: str = ""
    row: bool = False
    role: str = ""
    text: str = ""
    order: str = ""
    optional: tuple[str, ...] = ()
    roles: tuple[tuple[str, str], ...] = ()

    def fingerprints(self) -> Iterator[str]:
        for n in range(len(self.optional) + 1):
            for extra in combinations(self.optional, n):
                yield fingerprint({*self.paths, *extra})


def field_paths(value: Any, prefix: str = "") -> set[str]:
    """All paths from the root to a leaf; items of a list share the path `[]`."""
    if isinstance(value, dict) and value:
        inner = ((f"{prefix}.{key}" if prefix else key, item) for key, item in value.items())
        return set().union(*(field_paths(item, path) for path, item in inner))
    if isinstance(value, list) and value:
        return set().union(*(field_paths(item, prefix + "[]") for item in value))
    return {prefix}


def fingerprint(paths: set[str]) -> str:
    return hashlib.blake2b("\n".join(sorted(paths)).encode(), digest_size=8).hexdigest()


_OTHER_ROLES = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))
LAYOUTS = (
    Layout("turn row", ("conv_id", "turn", "role", "text"), row=True, role="role", text="text", order="turn"),
    Layout("messages", ("messages[].role", "messages[].content"), items="messages", role="role", text="content"),
    Layout("conversations", ("conversations[].from", "conversations[].value"), items="conversations", role="from", text="value", roles=_OTHER_ROLES),
    Layout("prompt", ("prompt", "completion"), single=(("system", "system"), ("user", "prompt"), ("assistant", "completion")), optional=("system",)),
    Layout("prompt and response", ("prompt", "response"), single=(("system", "system"), ("user", "prompt"), ("assistant", "response")), optional=("system",)),
    Layout("question", ("question", "answer"), single=(("user", "question"), ("assistant", "answer"))),
    Layout("instruction", ("instruction", "output"), single=(("system", "system"), ("user", "instruction+input"), ("assistant", "output")), optional=("input", "system")),
    Layout("nested messages", ("data.messages[].role", "data.messages[].content"), items="data.messages", role="role", text="content"),
)


def _at(value: Any, path: str) -> Any:
    for key in path.split("."):
        value = value.get(key) if isinstance(value, dict) else None
    return value


def _as_text(value: Any) -> str:
    if value is None:
        return ""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: Any, layout: Layout) -> list[tuple[int | None, str, str]]:
    """(number, role, text) of a record's turns."""
    if layout.row:
        order = _at(record, layout.order)
        return [(order, _as_text(_at(record, layout.role)), _as_text(_at(record, layout.text)))]
    if layout.items:
        roles = dict(layout.roles)
        named = [(_as_text(_at(i, layout.role)), _at(i, layout.text)) for i in _at(record, layout.items)]
        return [(n, roles.get(r, r), _as_text(t)) for n, (r, t) in enumerate(named)]
    found = []
    for role, path in layout.single:
        parts = [_as_text(_at(record, p)) for p in path.split("+")]
        text = "\n\n".join(part for part in parts if part.strip())
        if text or role == "assistant":
            found.append((len(found), role, text))
    return found


def canonical_turns(
    records: DataFrame,
    record_col: str = "record",
    id_col: str = "conv_id",
    layouts: tuple[Layout, ...] = LAYOUTS,
) -> DataFrame:
    """(id, turn, role, text, layout) of JSON records; null layout: unknown, text is the record."""
    known = {print_: layout for layout in layouts for print_ in layout.fingerprints()}
    kind = records.schema[id_col].dataType

    def rows(record: str | None) -> list[tuple]:
        try:
            value = json.loads(record) if record is not None else None
        except ValueError:
            value = None
        layout = known.get(fingerprint(field_paths(value)))
        if layout is None:
            return [(None, None, record, None)]
        return [(*turn, layout.name) for turn in turns_of(value, layout)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [rows(record.as_py()) for record in batch.column(1)]
            owner = pa.array([i for i, part in enumerate(found) for _ in part], pa.int64())
            columns = list(zip(*(row for part in found for row in part), strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [id_col, "turn", "role", "text", "layout"]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), *arrays], names)

    schema = f"`{id_col}` {kind.simpleString()}, turn long, role string, text string, layout string"
    return records.select(id_col, record_col).mapInArrow(run, schema)


def write_turn(role: str, text: str) -> tuple[str, int, int]:
    """The marked text of a turn, and where its (escaped) text starts and ends in it."""
    head = OPEN + _ROLE_MARKS.sub(r"\\\g<0>", role) + SEPARATOR
    body = _TEXT_MARKS.sub(r"\\\g<0>", text)
    return head + body + CLOSE, len(head), len(head) + len(body)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) pairs of formatted text; raises if anything else stands in it."""
    found, at = [], 0
    while at < len(formatted):
        match = _PIECE.match(formatted, at)
        if match is None:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    return found


def format_turns(turns: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, turn, piece, start, loss_start, loss_end), in order within each conversation.

    A conversation's text is its pieces one after another, `start` is where a piece stands in
    it, and loss_start..loss_end the range under the loss mask (null: none of the piece).
    All rows of a conversation are in one partition, sorted, and come as a stream.
    """
    kind = turns.schema[id_col].dataType
    ordered = turns.repartition(id_col).sortWithinPartitions(id_col, "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, start = object(), 0
        for batch in batches:
            rows = []
            for key, role, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if key != current:
                    current, start = key, 0
                piece, a, b = write_turn(role or "", text or "")
                learned = (role or "") == "assistant"
                rows.append((piece, start, start + a if learned else None, start + b if learned else None))
                start += len(piece)
            columns = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            names = [id_col, "turn", "piece", "start", "loss_start", "loss_end"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *arrays], names)

    fields = "turn long, piece string, start long, loss_start long, loss_end long"
    wanted = ordered.select(id_col, "turn", "role", "text")
    return wanted.mapInArrow(run, f"`{id_col}` {kind.simpleString()}, {fields}")


def digests(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What reading the formatted pieces back gives: one row per conversation.

    `pieces` come straight from `format_turns`, so each conversation is one run of rows.
    """
    kind = pieces.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        keys = batch_type = None
        done: list[tuple] = []
        current: Any = None
        state: list | None = None

        def close() -> None:
            turns, n, loss, loss_n, size = state
            done.append((current, n, turns.hexdigest(), loss_n, loss.hexdigest(), size))

        def flush() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True)) or [()] * 6
            kinds = (batch_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            done.clear()
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            batch_type = batch.column(0).type
            keys, piece, start, a, b = (batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5))
            for key, text, at, first, last in zip(keys, piece, start, a, b, strict=True):
                if state is None or key != current:
                    if state is not None:
                        close()
                    current, state = key, [hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, said in read_turns(text):
                    state[0].update(f"{role}\n{said}\n".encode())
                    state[1] += 1
                if first is not None:
                    learned = unescape(text[first - at : last - at])
                    state[2].update(learned.encode())
                    state[3] += len(learned)
                state[4] += len(text)
            yield flush()
        if state is not None:
            close()
            yield flush()

    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string"
    schema = f"`{id_col}` {kind.simpleString()}, {fields}, formatted_chars long"
    return pieces.mapInArrow(run, schema)


def whole_texts(pieces: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """(id, formatted, loss_spans): conversations that are known to fit into one row each."""
    parts = F.array_sort(F.collect_list(F.struct("start", "piece", "loss_start", "loss_end")))
    return pieces.groupBy(id_col).agg(parts.alias("parts")).select(
        id_col,
        F.array_join(F.col("parts.piece"), "").alias("formatted"),
        F.transform(
            F.filter("parts", lambda p: p["loss_start"].isNotNull()),
            lambda p: F.struct(p["loss_start"], p["loss_end"]),
        ).alias("loss_spans"),
    )
