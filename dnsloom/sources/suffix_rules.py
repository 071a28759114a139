"""Public suffix rules as a table `name, normal, wildcard, exception`."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.operators.staging import stage

# A small seed of public suffix rules, in the public list's notation.
SEED_RULES = [
    "com",
    "net",
    "org",
    "edu",
    "gov",
    "mil",
    "int",
    "info",
    "biz",
    "io",
    "dev",
    "app",
    "arpa",
    "in-addr.arpa",
    "ip6.arpa",
    "uk",
    "co.uk",
    "org.uk",
    "ac.uk",
    "gov.uk",
    "de",
    "fr",
    "eu",
    "us",
    "ru",
    "cn",
    "com.cn",
    "br",
    "com.br",
    "au",
    "com.au",
    "jp",
    "co.jp",
    "*.kobe.jp",
    "!city.kobe.jp",
    "*.ck",
    "!www.ck",
]


@dataclass(frozen=True)
class SuffixRules:
    """The rule table, its row count and its deepest rule in labels."""

    df: DataFrame
    rows: int
    depth: int


def _rule_table(lines: DataFrame) -> DataFrame:
    """One row per rule name from lines in the public list's notation."""
    marker = F.substring(F.col("rule"), 1, 1)
    name = F.regexp_replace(F.lower("rule"), r"^(\*\.|!)", "")
    return (
        lines.select(
            name.alias("name"),
            (~marker.isin("*", "!")).alias("normal"),
            (marker == "*").alias("wildcard"),
            (marker == "!").alias("exception"),
        )
        .groupBy("name")
        .agg(*[F.bool_or(c).alias(c) for c in ("normal", "wildcard", "exception")])
    )


def seed_suffix_rules(spark: SparkSession, rules: list[str] | None = None) -> SuffixRules:
    """The seed above, or other rules given as text."""
    kinds: dict[str, set[str]] = {}
    for rule in SEED_RULES if rules is None else rules:
        kinds.setdefault(rule.lower().removeprefix("*.").lstrip("!"), set()).add(rule[0])
    rows = [
        F.struct(
            F.lit(name).alias("name"),
            F.lit(bool(marks - {"*", "!"})).alias("normal"),
            F.lit("*" in marks).alias("wildcard"),
            F.lit("!" in marks).alias("exception"),
        )
        for name, marks in kinds.items()
    ]
    table = spark.range(1).select(F.inline(F.array(*rows)))
    depth = max(name.count(".") + 1 for name in kinds)
    return SuffixRules(table, len(kinds), depth)


def _punycode(name: str) -> str:
    labels = name.split(".")
    return ".".join(x if x.isascii() else "xn--" + x.encode("punycode").decode() for x in labels)


def _finish(table: DataFrame) -> SuffixRules:
    staged = stage(table.coalesce(1), "suffix-rules")
    depth = staged.df.agg(F.max(F.size(F.split("name", r"\.")))).first()[0] or 0
    return SuffixRules(staged.df, staged.rows, depth)


def read_suffix_rules(spark: SparkSession, path: str) -> SuffixRules:
    """Rules of the ICANN section of a public suffix list file.

    Rules with letters outside ASCII are added in their punycode form as well.
    """
    section = F.regexp_extract(
        "value", r"(?s)===BEGIN ICANN DOMAINS===(.*)===END ICANN DOMAINS===", 1
    )
    lines = (
        spark.read.text(path, wholetext=True)
        .select(F.explode(F.split(section, r"\R")).alias("line"))
        .select(F.regexp_extract("line", r"^\s*(\S*)", 1).alias("rule"))
        .where((F.col("rule") != "") & ~F.col("rule").startswith("//"))
        .where(~F.col("rule").startswith("="))
    )
    ascii_form = F.udf(_punycode, "string", useArrow=False)
    foreign = lines.where(F.col("rule").rlike(r"[^\x00-\x7f]"))
    return _finish(_rule_table(lines.unionByName(foreign.select(ascii_form("rule").alias("rule")))))
