"""CEF lines and STIX indicator ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dnsloom.functions.remarks import fixed_decimals
from dnsloom.settings import ForwardSettings

# CEF severity scale, signature, header name length, fallback name.
CEF_SEVERITY = {"info": 1, "medium": 4, "high": 7, "critical": 10}
CEF_SIGNATURE = "dns-anomaly"
CEF_NAME_LENGTH = 200
CEF_DEFAULT_NAME = "DNS event"
# Fixed value: the DNS namespace of RFC 4122.
DNS_NAMESPACE_HEX = "6ba7b8109dad11d180b400c04fd430c8"


def _escape(text: Column, special: str) -> Column:
    escaped = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    escaped = F.replace(escaped, F.lit(special), F.lit("\\" + special))
    return F.translate(escaped, "\r\n", "  ")


def escape_header(text: Column) -> Column:
    return _escape(text, "|")


def escape_extension(text: Column) -> Column:
    return _escape(text, "=")


def cef_severity(level: Column) -> Column:
    number = F.lit(None).cast("int")
    for name, value in CEF_SEVERITY.items():
        number = F.when(level == name, F.lit(value)).otherwise(number)
    return F.coalesce(number, F.lit(1))


def cef_line(
    *,
    source: Column,
    target: Column,
    query: Column,
    remark: Column,
    domain: Column,
    entropy: Column,
    level: Column,
    settings: ForwardSettings,
) -> Column:
    """One CEF:0 line; extension pairs without a value are left out."""

    def pair(key: str, value: Column) -> Column:
        return F.when(value != "", F.concat(F.lit(f"{key}="), escape_extension(value)))

    name = F.coalesce(F.nullif(remark, F.lit("")), F.lit(CEF_DEFAULT_NAME))
    header = F.concat_ws(
        "|",
        F.lit("CEF:0"),
        F.lit(settings.vendor),
        F.lit(settings.product),
        F.lit(settings.version),
        F.lit(CEF_SIGNATURE),
        F.substring(escape_header(name), 1, CEF_NAME_LENGTH),
        cef_severity(level).cast("string"),
    )
    extension = F.concat_ws(
        " ",
        pair("src", source),
        pair("dst", target),
        pair("request", query),
        pair("msg", remark),
        F.lit("cs1Label=registrableDomain"),
        pair("cs1", domain),
        F.lit("cn1Label=entropy"),
        pair("cn1", fixed_decimals(entropy, 4)),
        F.lit("cs2Label=severity"),
        pair("cs2", level),
    )
    return F.concat(header, F.lit("|"), extension)


def indicator_id(domain: Column) -> Column:
    """`indicator--` and the RFC 4122 version-5 UUID of `domain` in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit(DNS_NAMESPACE_HEX)), F.encode(domain, "UTF-8")))
    variant_digit = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int")
    variant = F.lower(F.hex((variant_digit.bitwiseAND(F.lit(3)) + 8).cast("long")))
    return F.concat(
        F.lit("indicator--"),
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
