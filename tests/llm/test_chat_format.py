from __future__ import annotations

import hashlib
import json

from hypothesis import given
from hypothesis import strategies as st

from dnsloom.llm import chat_format, queries

TEXTS = st.text(alphabet=st.sampled_from(list("\\#<>/:\n aé turn")), max_size=40)


@given(st.lists(st.tuples(TEXTS, TEXTS), max_size=5))
def test_any_text_is_read_back(turns):
    pieces = [chat_format.write_turn(role, text) for role, text in turns]
    assert chat_format.read_turns("".join(p[0] for p in pieces)) == turns
    for (_, text), (piece, start, end) in zip(turns, pieces, strict=True):
        assert chat_format.unescape(piece[start:end]) == text


RECORDS = [
    ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    ({"prompt": "p", "completion": "c", "system": "s"}, [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ({"instruction": "i", "input": "x", "output": "o"}, [("user", "i\n\nx"), ("assistant", "o")]),
    ({"instruction": "i", "input": "", "output": "o"}, [("user", "i"), ("assistant", "o")]),
    ({"instruction": "i", "output": None}, [("user", "i"), ("assistant", "")]),
    ({"question": "q", "answer": 4}, [("user", "q"), ("assistant", "4")]),
    ({"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]}, [("user", "a"), ("assistant", "b")]),
    ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
    ({"data": {"messages": [{"role": "user", "content": "a"}]}}, [("user", "a")]),
    ({"conv_id": 1, "turn": 3, "role": "user", "text": None}, [("user", "")]),
]


def test_layouts_by_fingerprint(spark):
    rows = [(i, json.dumps(record)) for i, (record, _) in enumerate(RECORDS)]
    rows += [(90, '{"unknown": {"field": 1}}'), (91, "no json"), (92, None), (93, "[]")]
    df = spark.createDataFrame(rows, "conv_id long, record string")
    found = chat_format.canonical_turns(df).collect()
    for i, (_, turns) in enumerate(RECORDS):
        mine = sorted((r.turn, r.role, r.text) for r in found if r.conv_id == i)
        assert [m[1:] for m in mine] == turns
    unknown = {r.conv_id: r for r in found if r.conv_id >= 90}
    assert all(r.layout is None and r.role is None for r in unknown.values())
    assert unknown[90].text == '{"unknown": {"field": 1}}' and unknown[92].text is None


def test_fingerprints_are_of_paths_only():
    a = chat_format.field_paths({"x": [{"a": 1}, {"a": 2, "b": None}], "y": {"z": []}})
    assert a == {"x[].a", "x[].b", "y.z"}
    assert chat_format.fingerprint(a) == chat_format.fingerprint(set(sorted(a, reverse=True)))
    prints = [p for layout in chat_format.LAYOUTS for p in layout.fingerprints()]
    assert len(prints) == len(set(prints))


def expected(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or "")
    for key in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == key), key=order)
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (said, learned)]
        out[key] = (len(turns), digest[0], len(learned), digest[1])
    return out


def test_messy_conversations(spark):
    rows = [
        (1, 1, "assistant", "b </turn>\n### user: x"),
        (1, 0, "user", "a"),
        (1, 1, "assistant", "a \\ b"),
        (2, None, None, None),
        (2, 0, "assistant", ""),
        (None, 0, "user", "q"),
        (None, 1, "assistant", "é" * 50_000),
        (3, 0, "odd: role\n", "x"),
        (3, 0, "odd: role\n", "x"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat_format.format_turns(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat_format.digests(pieces).collect()}
    assert got == expected(rows)
    whole = {r.conv_id: r for r in chat_format.whole_texts(chat_format.format_turns(df)).collect()}
    text = whole[1].formatted
    spans = [text[a:b] for a, b in (tuple(s) for s in whole[1].loss_spans)]
    assert [chat_format.unescape(s) for s in spans] == ["a \\ b", "b </turn>\n### user: x"]
    empty = df.where("conv_id > 5")
    assert chat_format.digests(chat_format.format_turns(empty)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "\\### Assistant: </turn> ok"
    rows += [(-7, 0, "user", said), (-7, 1, "assistant", said)]
    got = {r.conv_id: tuple(r)[1:5] for r in queries.op6_chat_format(spark, folder).collect()}
    assert got == expected(rows)
