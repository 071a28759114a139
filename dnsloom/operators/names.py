"""Public-suffix split of query names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dnsloom.settings import ScaleSettings
from dnsloom.sources.suffix_rules import SuffixRules


def split_names(
    df: DataFrame,
    rules: SuffixRules,
    name: str = "query",
    *,
    normalize_case: bool = False,
    scale: ScaleSettings | None = None,
) -> DataFrame:
    """`df` with registrable_domain, subdomain and scoring_label of column `name`.

    The last k labels (k up to the deepest rule) are looked up in the rule table, whose row
    count is known: within `scale.broadcast_rows` it is broadcast once for all k. The
    deepest match is the suffix; an exception rule wins. There is no default rule: under an
    unlisted top level, for an address and for a bare suffix the domain and the subdomain
    are '' and the whole name is the scoring label.
    """
    scale = scale or ScaleSettings()
    clean = f"trim(TRAILING '.' FROM `{name}`)"
    # A name may carry URL-like punctuation; the suffix is searched in its host part.
    host = """CASE WHEN __clean RLIKE '[/?#@:]'
        THEN trim(TRAILING '.' FROM regexp_extract(__clean, '^(?:[^/?#]*@)?([^/?#:@]*)', 1))
        ELSE __clean END"""
    work = (
        df.selectExpr("*", f"{f'lower({clean})' if normalize_case else clean} AS __clean")
        .selectExpr("*", f"{host} AS __host")
        .selectExpr("*", "length(__host) - length(replace(__host, '.', '')) + 1 AS __labels")
    )

    table = F.broadcast(rules.df) if rules.rows <= scale.broadcast_rows else rules.df
    matched, exempt = [], []
    for k in range(1, rules.depth + 1):
        rule = f"__rule{k}"
        tail = f"CASE WHEN __labels >= {k} THEN lower(substring_index(__host, '.', -{k})) END"
        work = work.join(table.alias(rule), F.expr(f"{tail} = {rule}.name"), "left")
        matched.append(f"CASE WHEN {rule}.normal THEN {k} END")
        matched.append(f"CASE WHEN {rule}.wildcard AND __labels > {k} THEN {k + 1} END")
        exempt.append(f"CASE WHEN {rule}.exception THEN {k - 1} END")
    suffix = f"coalesce({', '.join(exempt)}, greatest({', '.join(matched)}))"

    kept = [f"`{c}`" for c in df.columns]
    owned = "CASE WHEN __labels > __suffix THEN substring_index(__host, '.', -(__suffix + 1)) END"
    return (
        work.selectExpr(*kept, "__clean", "__host", "__labels", f"{suffix} AS __suffix")
        .selectExpr(*kept, "__clean", "__host", f"{owned} AS __owned")
        .selectExpr(
            *kept,
            "__clean",
            # an empty label in front of the suffix is no domain
            "CASE WHEN NOT startswith(__owned, '.') THEN __owned END AS __owned",
            "substring(__host, 1, greatest(length(__host) - length(__owned) - 1, 0)) AS __sub",
            "substring_index(__owned, '.', 1) AS __label",
        )
        .selectExpr(
            *kept,
            "coalesce(__owned, '') AS registrable_domain",
            "CASE WHEN __owned IS NOT NULL THEN __sub ELSE '' END AS subdomain",
            """CASE WHEN __owned IS NULL THEN __clean
                    WHEN __sub != '' THEN concat(__sub, '.', __label)
                    ELSE __label END AS scoring_label""",
        )
    )
