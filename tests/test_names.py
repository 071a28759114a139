from __future__ import annotations

import math
import os
import random
from collections import Counter

import pytest

from dnsloom.functions.entropy import shannon_entropy
from dnsloom.operators.names import split_names
from dnsloom.settings import ScaleSettings
from dnsloom.sources.suffix_rules import read_suffix_rules, seed_suffix_rules

CASES = {
    "kj3h4k5j234.com.": ("kj3h4k5j234.com", "", "kj3h4k5j234"),
    "a1b2c3.tunnel.evil-corp.co.uk.": ("evil-corp.co.uk", "a1b2c3.tunnel", "a1b2c3.tunnel.evil-corp"),
    "www.google.com.": ("google.com", "www", "www.google"),
    "Unknown": ("", "", "Unknown"),
    "": ("", "", ""),
    ".": ("", "", ""),
    "co.uk.": ("", "", "co.uk"),
    "foo.ck": ("", "", "foo.ck"),
    "ck.": ("", "", "ck"),
    "a.foo.ck": ("a.foo.ck", "", "a"),
    "x.www.ck": ("www.ck", "x", "x.www"),
    "a.city.kobe.jp": ("city.kobe.jp", "a", "a.city"),
    "a.b.other.kobe.jp": ("b.other.kobe.jp", "a", "a.b"),
    "4.3.2.1.in-addr.arpa.": ("1.in-addr.arpa", "4.3.2", "4.3.2.1"),
    "Evil.COM.": ("Evil.COM", "", "Evil"),
    "1.2.3.4": ("", "", "1.2.3.4"),
    "x.local.": ("", "", "x.local"),
    "_dmarc.Mail.example.org..": ("example.org", "_dmarc.Mail", "_dmarc.Mail.example"),
    "a..com": ("", "", "a..com"),
    ".example.com": ("example.com", "", "example"),
    "user@mail.example.com:53": ("example.com", "mail", "mail.example"),
    "0/25.2.0.192.in-addr.arpa": ("", "", "0/25.2.0.192.in-addr.arpa"),
}


def split(spark, names, rules, **options):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i INT, query STRING")
    rows = split_names(df, rules, **options).collect()
    return [
        (r.registrable_domain, r.subdomain, r.scoring_label) for r in sorted(rows, key=lambda r: r.i)
    ]


def test_name_cases(spark, rules):
    assert split(spark, CASES, rules) == list(CASES.values())


def test_large_rule_table_is_joined_without_broadcast(spark, rules):
    scale = ScaleSettings(broadcast_rows=1)
    assert split(spark, CASES, rules, scale=scale) == list(CASES.values())


def test_case_is_kept_unless_normalised(spark, rules):
    names = ["WwW.Evil.Com."]
    assert split(spark, names, rules) == [("Evil.Com", "WwW", "WwW.Evil")]
    assert split(spark, names, rules, normalize_case=True) == [("evil.com", "www", "www.evil")]


def test_rule_file_keeps_the_icann_section_and_adds_punycode(spark, tmp_path):
    text = """// comment
// ===BEGIN ICANN DOMAINS===
com
// spaced
*.ck
!www.ck
рф

// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
github.io
"""
    path = tmp_path / "rules.dat"
    path.write_text(text, encoding="utf-8")
    read = read_suffix_rules(spark, str(path))
    rows = {r.name: (r.normal, r.wildcard, r.exception) for r in read.df.collect()}
    assert rows == {
        "com": (True, False, False),
        "ck": (False, True, False),
        "www.ck": (False, False, True),
        "рф": (True, False, False),
        "xn--p1ai": (True, False, False),
    }
    assert (read.rows, read.depth) == (5, 2)


PUBLIC_LIST = "/usr/share/publicsuffix/public_suffix_list.dat"


def model(name, rules):
    """Longest match over a dict of rules, label by label."""
    clean = name.rstrip(".")
    labels = clean.split(".")
    depth = None
    for k in range(1, len(labels) + 1):
        normal, wildcard, exception = rules.get(".".join(labels[-k:]).lower(), (False,) * 3)
        if exception:
            depth = k - 1
            break
        if normal:
            depth = max(depth or 0, k)
        if wildcard and len(labels) > k:
            depth = max(depth or 0, k + 1)
    if depth is None or len(labels) <= depth or not labels[-depth - 1]:
        return ("", "", clean)
    sub = ".".join(labels[: -depth - 1])
    owner = labels[-depth - 1]
    return (".".join(labels[-depth - 1 :]), sub, f"{sub}.{owner}" if sub else owner)


@pytest.mark.skipif(not os.path.exists(PUBLIC_LIST), reason="no public list on this machine")
def test_whole_public_list_against_a_model(spark):
    read = read_suffix_rules(spark, PUBLIC_LIST)
    rules = {r.name: (r.normal, r.wildcard, r.exception) for r in read.df.collect()}
    assert read.rows == len(rules) > 5000
    rng = random.Random(7)
    suffixes = sorted(rules)
    names = []
    for _ in range(3000):
        head = [rng.choice("abc") * rng.randint(1, 3) for _ in range(rng.randint(0, 4))]
        names.append(".".join([*head, rng.choice(suffixes)]) + rng.choice(["", "."]))
    assert split(spark, names, read) == [model(n, rules) for n in names]


def entropies(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i INT, s STRING")
    rows = df.select("i", shannon_entropy("s").alias("e")).collect()
    return [r.e for r in sorted(rows, key=lambda r: r.i)]


def test_entropy_cases(spark):
    empty, one, four, random_like, word, newline = entropies(
        spark, ["", "aaa", "abcd", "x7q9zk3m1p8wr2nb", "google", "a\n\n\nb\n"]
    )
    assert (empty, one, four, random_like) == (0.0, 0.0, 2.0, 4.0)
    assert word < 3.5
    assert newline == pytest.approx(1.2516291673878228)


def test_entropy_against_python_and_stable_for_equal_counts(spark):
    rng = random.Random(3)
    alphabet = "abcdefghij0123456789-_.ABé\U0001f600"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(500)]

    def expected(text):
        return -sum(c / len(text) * math.log2(c / len(text)) for c in Counter(text).values())

    for got, text in zip(entropies(spark, texts), texts, strict=True):
        assert got == pytest.approx(expected(text), abs=1e-12)
    assert len(set(entropies(spark, ["google", "oggole", "xyyzxw", "abbcad"]))) == 1


def test_seed_rules_can_be_replaced(spark):
    own = seed_suffix_rules(spark, ["test"])
    assert split(spark, ["a.b.test", "a.com"], own) == [("b.test", "a", "a.b"), ("", "", "a.com")]
