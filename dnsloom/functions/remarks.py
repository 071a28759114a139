"""Remark texts, severity and alert texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsloom.settings import SEVERITY_LEVELS, DetectionSettings

# Remark texts.
HIGH_ENTROPY = "High entropy domain name - Possible DGA or DNS Tunneling"
REFUSED = "DNS query refused by the server"
FAILED = "Unsuccessful DNS response - Possible misconfiguration or attack"
NORMAL = "Normal query"


_SPLITTER = 134217729.0  # 2**27 + 1: cuts a double into two halves of 26 bits
_EXACT_BELOW = 1e9


def fixed_decimals(value: Column, places: int) -> Column:
    """`value` with `places` decimals, rounded from its exact binary value; exact ties go to
    the even digit, and the sign is kept at zero. (From 1e9 on: from its shortest decimal.)

    The scaled value is held as a double and the error of that product, which is exact because
    the halves of the value times a small power of ten fit into a double.
    """
    factor = float(10**places)
    size = F.abs(value)
    high = size * _SPLITTER - (size * _SPLITTER - size)
    scaled = size * factor
    error = (high * factor - scaled) + (size - high) * factor
    whole = F.floor(scaled)
    over = scaled - whole
    up = (over > 0.5) | ((over == 0.5) & ((error > 0) | ((error == 0) & (whole % 2 == 1))))
    digits = whole + F.when(up, 1).otherwise(0)
    unit = 10**places
    whole_part = F.floor(digits / F.lit(unit)).cast("string")
    fraction = F.lpad((digits % unit).cast("string"), places, "0")
    number = F.concat(whole_part, F.lit("."), fraction)
    exact = F.concat(F.when(value < 0, F.lit("-")).otherwise(F.lit("")), number)
    return F.when(size < _EXACT_BELOW, exact).otherwise(F.format_string(f"%.{places}f", value))


def z_score(entropy: Column, mean: Column, stdev: Column) -> Column:
    """Standard deviations above the mean; NULL without a baseline or a spread."""
    return F.when(stdev != 0, (entropy - mean) / stdev)


def base_remark(
    entropy: Column, flags: Column, settings: DetectionSettings, z: Column | None = None
) -> Column:
    """First matching finding of one record: entropy, z-score, refused, failed, normal."""
    found = F.when(entropy > settings.entropy_threshold, F.lit(HIGH_ENTROPY))
    if z is not None:
        found = found.when(
            z > settings.z_score_threshold,
            F.concat(
                F.lit("Entropy anomalous for this host (z="),
                fixed_decimals(z, 2),
                F.lit(") - Possible DGA or DNS Tunneling"),
            ),
        )
    rcode = flags.getField("rcode")
    return (
        found.when(rcode == "REFUSED", F.lit(REFUSED))
        .when((flags.getField("qr") == "RESPONSE") & (rcode != "NOERROR"), F.lit(FAILED))
        .otherwise(F.lit(NORMAL))
    )


def burst_note(unique_count: Column, domain: Column, window_seconds: int) -> Column:
    """NULL when `unique_count` is NULL."""
    return F.concat(
        unique_count.cast("string"),
        F.lit(" unique subdomains under "),
        domain,
        F.lit(f" within {window_seconds}s - possible DNS tunneling"),
    )


def nxdomain_note(client: Column, ratio: Column, responses: Column, threshold: float) -> Column:
    """NULL when the ratio is NULL or under the threshold."""
    return F.when(
        ratio >= threshold,
        F.concat(
            F.lit("host "),
            client,
            F.lit(" has a high NXDOMAIN ratio ("),
            F.bround(ratio * 100).cast("int").cast("string"),
            F.lit("% of "),
            responses.cast("string"),
            F.lit(" responses) - possible DGA client"),
        ),
    )


def join_notes(*parts: Column) -> Column:
    """Remark and notes in one text; NULL notes vanish."""
    return F.concat_ws(" | ", *parts)


def severity(remark: Column, is_malicious: Column) -> Column:
    """Severity from the finished remark and the verdict flag (NULL counts as false)."""
    text = F.lower(F.coalesce(remark, F.lit("")))

    def mentions(*words: str) -> Column:
        return F.greatest(*[text.contains(w) for w in words], F.lit(False))

    return (
        F.when(F.coalesce(is_malicious, F.lit(False)), F.lit("critical"))
        .when(mentions("dga", "tunneling", "nxdomain ratio"), F.lit("high"))
        .when(mentions("refused", "misconfiguration", "attack"), F.lit("medium"))
        .otherwise(F.lit("info"))
    )


def at_least(level: Column, minimum: str) -> Column:
    """True where severity `level` ranks at or above `minimum`."""
    return level.isin(SEVERITY_LEVELS[SEVERITY_LEVELS.index(minimum) :])


def alert_message(level: Column, query: Column, source: Column, target: Column, remark: Column) -> Column:
    def known(value: Column) -> Column:
        return F.coalesce(value, F.lit("?"))

    return F.concat(
        F.lit("["),
        F.upper(level),
        F.lit("] DNS anomaly: "),
        known(query),
        F.lit(" (source "),
        known(source),
        F.lit(" -> "),
        known(target),
        F.lit(")\n"),
        F.coalesce(remark, F.lit("")),
    )


def webhook_payload(message: Column) -> Column:
    """The message under both keys that common chat webhooks read."""
    return F.to_json(F.struct(message.alias("text"), message.alias("content")))
