from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from dnsloom.llm import prefix_trie

ROWS = "conv_id long, turn long, role string, text string"


def brute(rows: list[tuple]) -> list[tuple]:
    own: dict[int, list] = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(l)] for c, l in own.items()}
    built = {}
    for c, turns in own.items():
        head = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - c % 100, [])[:head] + turns[head:])
    members: dict[tuple, list[int]] = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(turns[:d], []).append(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(map(str, sorted(c for c in convs if built[c] == node)))
        out.append(
            (
                min(convs),
                len(node),
                min(members[node[:-1]]) if node else None,
                len(convs),
                sum(len(n) == len(node) + 1 for n in below),
                sum(n not in parents for n in below),
                saved,
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(out, key=str)


def run(spark, rows: list[tuple], **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS + ", depth int, path string")
    return found(table, **options)


def found(table, **options):
    turns = prefix_trie.ordered_turns(table, "conv_id", "turn", "role", "text")
    head = F.crc32(F.col("conv").cast("string").cast("binary")) % 6
    nodes = prefix_trie.trie(prefix_trie.spliced(turns, F.col("conv") - F.col("conv") % 100, head), **options)
    return sorted((tuple(r) for r in nodes.collect()), key=str)


def conversations(rng: random.Random, n: int) -> list[tuple]:
    says = ["hello", "", None, "é́ 中文", "x" * 50]
    return [
        (c, t, rng.choice(["user", "assistant", None]), rng.choice(says))
        for c in rng.sample(range(3 * n), n)
        for t in range(rng.randint(1, 8))
    ]


@pytest.mark.parametrize("seed, entries", [(1, 50_000), (2, 40), (3, 0)])
def test_equals_brute_force(spark, seed, entries):
    """In one round, in some, and depth by depth."""
    rows = conversations(random.Random(seed), 80)
    assert run(spark, rows, entries=entries) == brute(rows)


def test_long_conversations_take_few_rounds(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(c, t, "user", f"{c % 7} {t}" if t < 20 else rng.choice("ab")) for c in (1, 8, 15, 22) for t in range(60)]
    rounds = []
    peeled = prefix_trie._peeled
    monkeypatch.setattr(prefix_trie, "_peeled", lambda *a: (rounds.append(1), peeled(*a))[1])
    assert run(spark, rows) == brute(rows)
    assert len(rounds) == 1


def test_messy_rows(spark):
    rows = [
        (0, None, "user", "first"),
        (0, 1, "user", "a"),
        (0, 1, "user", "a"),  # a repeated row stays
        (0, 1, "assistant", "b"),  # a tie: by role, then text
        (7, 5, None, None),
        (7, None, "", ""),
        (201, 0, "user", "no base"),
        (202, 0, "user", "no base"),
        (None, 0, "user", "no conversation"),
        (300, 0, "ab", "c"),
        (301, 0, "a", "bc"),
        (305, 0, "user", "z" * 100_000),
    ]
    assert run(spark, rows) == brute(rows)
    assert run(spark, [r for r in rows if r[0] is None]) == []


def test_a_third_of_all_conversations_alike(spark):
    rng = random.Random(4)
    rows = conversations(rng, 60)
    rows += [(100 * c, t, "user", f"turn {t}") for c in range(10, 40) for t in range(4)]
    nodes = run(spark, rows)
    assert nodes == brute(rows)


def test_ids_of_a_node_over_many_batches(spark):
    table = spark.range(25_000).select(
        (F.col("id") * 100).alias("conv_id"), F.lit(1).cast("long").alias("turn"), F.lit("user").alias("role"), F.lit("hi").alias("text")
    )
    leaf = [r for r in found(table) if r[1] == 1]
    text = ",".join(str(i * 100) for i in range(25_000))
    assert leaf == [(0, 1, 0, 25_000, 0, 1, 24_999 * 2, hashlib.sha256(text.encode()).hexdigest())]
