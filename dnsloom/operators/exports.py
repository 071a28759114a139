"""Output forms of finished records: CSV rows, JSON, CEF, alerts, report text, STIX."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dnsloom.functions import interchange, remarks
from dnsloom.functions.flags import HEADER_BITS, flags_text
from dnsloom.schema import RECORD_SCHEMA
from dnsloom.settings import AlertSettings, ForwardSettings

# Columns of the flat form, in order.
FLAT_COLUMNS = [
    "timestamp",
    "source_ip",
    "destination_ip",
    "query",
    "registrable_domain",
    "subdomain",
    "entropy",
    "entropy_z_score",
    "qdcount",
    "ancount",
    "nscount",
    "arcount",
    "flags_qr",
    "flags_opcode",
    "flags_aa",
    "flags_tc",
    "flags_rd",
    "flags_ra",
    "flags_rcode",
    "subdomain_burst",
    "subdomain_burst_unique_count",
    "host_nxdomain_ratio",
    "threat_intel_is_malicious",
    "threat_intel_source",
    "threat_intel_detail",
    "severity",
    "remark",
]
STIX_SPEC_VERSION = "2.1"


def with_severity(records: DataFrame) -> DataFrame:
    level = remarks.severity(F.col("remark"), F.col("threat_intel.is_malicious"))
    return records.withColumn("severity", level)


def flatten(records: DataFrame, *also: str | Column) -> DataFrame:
    """The 27 flat columns; a NULL verdict gives NULL columns, checked_at is left out.

    also: further columns to keep, in front.
    """
    nested = {f"flags_{k}": F.col(f"flags.{k}") for k in HEADER_BITS}
    nested |= {
        f"threat_intel_{k}": F.col(f"threat_intel.{k}") for k in ("is_malicious", "source", "detail")
    }
    return records.select(*also, *[nested.get(c, F.col(c)).alias(c) for c in FLAT_COLUMNS])


# Quotes are doubled, blanks and empty texts stay as they are: any CSV reader reads it back.
_CSV = {
    "header": True,
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "emptyValue": "",
}


def write_csv(records: DataFrame, path: str) -> None:
    """The flat columns; booleans are True and False, NULL and empty text are empty fields."""
    flat = flatten(records)
    spelled = [
        F.initcap(F.col(f.name).cast("string")).alias(f.name)
        if f.dataType.simpleString() == "boolean"
        else F.col(f.name)
        for f in flat.schema
    ]
    flat.select(*spelled).write.options(**_CSV).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """What `write_csv` wrote, typed; only the two name columns have empty texts for NULL."""
    schema = flatten(spark.createDataFrame([], RECORD_SCHEMA)).schema
    rows = spark.read.schema(schema).options(**_CSV, multiLine=True).csv(path)
    return rows.fillna("", subset=["registrable_domain", "subdomain", "query"])


def write_json(records: DataFrame, path: str) -> None:
    """Nested JSON lines; NULL fields are kept."""
    records.write.json(path, ignoreNullFields=False)


def alerts(records: DataFrame, settings: AlertSettings | None = None) -> DataFrame:
    """seq, severity, message, payload of records at or above the alert level.

    The level is worked out from remark and verdict, whatever the severity column says.
    """
    settings = settings or AlertSettings(enabled=True)
    if not settings.enabled:
        records = records.where(F.lit(False))
    level = remarks.severity(F.col("remark"), F.col("threat_intel.is_malicious"))
    message = remarks.alert_message(
        F.col("severity"), F.col("query"), F.col("source_ip"), F.col("destination_ip"), F.col("remark")
    )
    return (
        records.withColumn("severity", level)
        .where(remarks.at_least(F.col("severity"), settings.min_severity))
        .select("seq", "severity", message.alias("message"))
        .withColumn("payload", remarks.webhook_payload(F.col("message")))
    )


def cef_lines(records: DataFrame, settings: ForwardSettings | None = None) -> DataFrame:
    """seq, severity, line of records at or above the forwarding level."""
    settings = settings or ForwardSettings(enabled=True)
    if not settings.enabled:
        records = records.where(F.lit(False))
    derived = remarks.severity(F.col("remark"), F.col("threat_intel.is_malicious"))
    level = F.coalesce(F.nullif("severity", F.lit("")), derived)
    line = interchange.cef_line(
        source=F.col("source_ip"),
        target=F.col("destination_ip"),
        query=F.col("query"),
        remark=F.col("remark"),
        domain=F.col("registrable_domain"),
        entropy=F.col("entropy"),
        level=F.col("severity"),
        settings=settings,
    )
    return (
        records.withColumn("severity", level)
        .where(remarks.at_least(F.col("severity"), settings.min_severity))
        .select("seq", "severity", line.alias("line"))
    )


def write_cef(records: DataFrame, path: str, settings: ForwardSettings | None = None) -> None:
    cef_lines(records, settings).select("line").write.text(path)


def report_blocks(records: DataFrame) -> DataFrame:
    """seq and one text block per record."""
    z = F.coalesce(remarks.fixed_decimals(F.col("entropy_z_score"), 2), F.lit("N/A"))
    z = F.when(F.col("entropy_z_score").isNull(), F.lit("N/A")).otherwise(z)
    # The lines of a block.
    block = F.concat_ws(
        "\n",
        F.concat(F.lit("Query: "), F.col("query")),
        F.concat(
            F.lit("Source: "), F.col("source_ip"), F.lit(" -> Destination: "), F.col("destination_ip")
        ),
        F.concat(
            F.lit("Entropy: "),
            remarks.fixed_decimals(F.col("entropy"), 4),
            F.lit(" (z-score: "),
            z,
            F.lit(")"),
        ),
        F.lit("Flags:"),
        flags_text(F.col("flags")),
        F.concat(F.lit("Remark: "), F.col("remark")),
        F.lit("-------------------------------------------------"),
    )
    return records.select("seq", block.alias("block"))


def write_report(records: DataFrame, path: str) -> None:
    """Blocks in record order; the part files read in name order are the report."""
    report_blocks(records).orderBy("seq").select("block").write.text(path)


def stix_indicators(records: DataFrame, timestamp: str) -> DataFrame:
    """One indicator per confirmed malicious domain, from the first verdict seen."""
    confirmed = records.where(
        F.col("threat_intel.is_malicious") & (F.col("registrable_domain") != "")
    )
    first = F.min_by(F.struct("threat_intel.source", "threat_intel.detail"), F.col("seq"))
    domains = confirmed.groupBy(F.col("registrable_domain").alias("domain")).agg(
        F.min("seq").alias("first_seq"), first.alias("verdict")
    )
    domain = F.col("domain")
    # Names and texts of an indicator.
    return domains.select(
        "first_seq",
        F.lit("indicator").alias("type"),
        F.lit(STIX_SPEC_VERSION).alias("spec_version"),
        interchange.indicator_id(domain).alias("id"),
        F.lit(timestamp).alias("created"),
        F.lit(timestamp).alias("modified"),
        F.concat(F.lit("Malicious domain: "), domain).alias("name"),
        F.concat(
            F.lit("Flagged by "), F.col("verdict.source"), F.lit(": "), F.col("verdict.detail")
        ).alias("description"),
        F.array(F.lit("malicious-activity")).alias("indicator_types"),
        F.concat(F.lit("[domain-name:value = '"), domain, F.lit("']")).alias("pattern"),
        F.lit("stix").alias("pattern_type"),
        F.lit(timestamp).alias("valid_from"),
    )


def stix_bundle(records: DataFrame, timestamp: str, bundle_uuid: str) -> DataFrame:
    """The lines of one bundle document: part (0 head, 1 indicator, 2 tail), first_seq, line.

    In (part, first_seq) order the lines are one JSON document. The indicators stay rows, so
    a bundle of any size is written by many tasks; only the position of the first indicator,
    which takes no leading comma, is known to all.
    """
    indicators = stix_indicators(records, timestamp)
    objects = F.to_json(F.struct(*[F.col(c) for c in indicators.columns if c != "first_seq"]))
    bodies = indicators.select(F.lit(1).alias("part"), "first_seq", objects.alias("body"))
    first = indicators.agg(F.min("first_seq").alias("at")).scalar()
    lead = F.when(F.col("first_seq") == first, F.lit("")).otherwise(F.lit(","))
    lines = bodies.select("part", "first_seq", F.concat(lead, F.col("body")).alias("line"))
    frame = records.sparkSession.range(1).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(part).alias("part"),
                        F.lit(0).cast("long").alias("first_seq"),
                        F.lit(text).alias("line"),
                    )
                    for part, text in (
                        (0, f'{{"type":"bundle","id":"bundle--{bundle_uuid}","objects":['),
                        (2, "]}"),
                    )
                ]
            )
        )
    )
    return frame.unionByName(lines)


def write_stix_bundle(records: DataFrame, path: str, timestamp: str, bundle_uuid: str) -> None:
    """The part files read in name order are the document."""
    lines = stix_bundle(records, timestamp, bundle_uuid)
    lines.orderBy("part", "first_seq").select("line").write.text(path)
