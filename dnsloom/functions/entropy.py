"""Shannon entropy of a string, in bits per character."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shannon_entropy(name: str) -> Column:
    """Entropy of the characters of the text column `name`; 0.0 for the empty string.

    The characters are sorted, so equal ones stand together, and only runs of two or
    more contribute to sum(k * log2(k)). The run lengths are summed in sorted order:
    two names with the same letter counts get the same bits, so a host that sends only
    such names has a standard deviation of exactly 0.
    """
    n = f"length(`{name}`)"
    runs = rf"""regexp_extract_all(
        array_join(sort_array(split(`{name}`, '')), ''), '(?s)(.)\\1+', 0)"""
    repeated = f"""aggregate(
        sort_array(transform({runs}, run -> length(run))), 0D, (total, k) -> total + k * log2(k))"""
    return F.expr(f"CASE WHEN {n} > 0 THEN ({n} * log2({n}) - {repeated}) / {n} ELSE 0D END")
