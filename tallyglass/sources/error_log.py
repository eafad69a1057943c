"""Multi-line error logs: scan, signature, rollup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARCHIVES = r"(?i)\.(gz|bz2|zip)$"
HEADER = r"^\[([^\]]*)\]\s*"
SEVERITY = (
    r"(?i)\bPHP (Parse error|Fatal error|Recoverable fatal error|Warning|Notice|Deprecated"
    r"|Strict (?:Standards|notice))\b:?"
)
CLI_EVAL = r"(?mi)^#\d+\s+phar://.*/wp-cli/eval-command/src/Eval(?:File)?_Command\.php(?:\(\d+\))?"


def split_records(chunks: DataFrame) -> DataFrame:
    """Records from text split at a line break before '[': the bracket goes back on.

    Text before the first bracketed line of a file belongs to no record.
    """
    value = F.col("value")
    raw = F.when(value.startswith("["), value).otherwise(F.concat(F.lit("["), value))
    keep = [c for c in chunks.columns if c != "value"]
    out = chunks.select(F.regexp_replace(raw, r"\s+$", "").alias("raw"), *keep)
    return with_time(out.filter(F.col("raw").rlike(HEADER)))


def with_time(records: DataFrame) -> DataFrame:
    stamp = F.regexp_extract("raw", HEADER, 1)
    return records.withColumn("ts", F.try_to_timestamp(stamp, F.lit("dd-MMM-yyyy HH:mm:ss VV")))


def read_error_log(spark: SparkSession, path: str, base: str | None = None, include_rotated: bool = False) -> DataFrame:
    """Records of one log, or with its rotated siblings ``base.*`` and ``base-*``, archives skipped.

    ``mtime`` orders rotated files, newest first.
    """
    chunks = spark.read.option("lineSep", "\n[").text(path).select(
        "value", F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_modification_time").alias("mtime")
    )
    if base is not None:
        name = F.col("file_name")
        mine = name == base
        if include_rotated:
            mine = mine | ((name.startswith(f"{base}.") | name.startswith(f"{base}-")) & ~name.rlike(ARCHIVES))
        chunks = chunks.filter(mine)
    return split_records(chunks)


def severity_of(label: Column) -> Column:
    low = F.lower(label)
    out = F.when(low.contains("parse"), "parse")
    for word in ("fatal", "warning", "deprecated", "strict"):
        out = out.when(low.contains(word), word)
    return out.otherwise("notice")


def with_error_signature(records: DataFrame) -> DataFrame:
    """Severity, location, sample and a signature free of ids, addresses and numbers.

    Records that are not PHP errors are dropped.
    """
    first = F.regexp_extract("raw", r"^([^\n]*)", 1)
    out = records.withColumn("_first", first).withColumn("_body", F.regexp_replace(F.col("_first"), HEADER, ""))
    out = out.filter(F.col("_body").rlike(SEVERITY))
    message = F.regexp_replace(F.col("_body"), r"(?i)^.*?\bPHP [^:]+:\s*", "")
    message = F.trim(F.regexp_replace(F.regexp_replace(message, r"<[^>]*>", ""), r"\s+", " "))
    thrown = r"thrown in (.+?) on line (\d+)"
    plain = r" in (.+?) on line (\d+)"
    has_thrown = F.col("raw").rlike(thrown)
    pick = lambda group: F.when(has_thrown, F.regexp_extract("raw", thrown, group)).otherwise(
        F.regexp_extract("_first", plain, group)
    )
    out = out.select(
        *records.columns,
        severity_of(F.regexp_extract("_body", SEVERITY, 1)).alias("severity"),
        message.alias("_message"),
        pick(1).alias("origin_path"),
        pick(2).alias("_line"),
    )
    base = F.regexp_extract("origin_path", r"([^/]*)$", 1)
    norm = F.regexp_replace("_message", r" in .+? on line \d+.*$", "")
    for pattern, text in ((r"0x[0-9a-fA-F]+", "0xADDR"), (r"(?i)\bid[=: ]+\d+", "id=N"), (r"\d+", "N"), (r"\s+", " ")):
        norm = F.regexp_replace(norm, pattern, text)
    out = out.withColumn("message", F.trim(norm)).withColumn("_base", base)
    sample = F.col("_message")
    return out.select(
        *records.columns,
        "severity",
        "message",
        F.when(F.col("_base") == "", "(unknown)")
        .otherwise(F.concat("_base", F.when(F.col("_line") != "", F.concat(F.lit(":"), F.col("_line"))).otherwise("")))
        .alias("file"),
        F.md5(F.concat_ws("|", "severity", "_base", "message")).alias("signature"),
        F.when(F.char_length(sample) > 160, F.concat(F.substring(sample, 1, 157), F.lit("..."))).otherwise(sample).alias("sample"),
        "origin_path",
    )


def with_production_flag(entries: DataFrame, roots: list[str]) -> DataFrame:
    """Path under a production root, or no path or roots at all, and no console-eval frame below."""
    path = F.col("origin_path")
    inside = F.lit(not roots) | (path == "")
    for root in roots:
        inside = inside | path.startswith(root.rstrip("/") + "/") | (path == root.rstrip("/"))
    stack = F.regexp_extract("raw", r"(?s)^[^\n]*(\n.*)$", 1)
    return entries.withColumn("from_production", inside & ~stack.rlike(CLI_EVAL))


def parse_errors(records: DataFrame, roots: list[str] | None = None) -> DataFrame:
    return with_production_flag(with_error_signature(records), roots or [])


DAILY = ["snapshot_day", "signature", "severity", "file_line", "sample_message", "count", "first_seen", "last_seen"]


def rollup_errors(entries: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Per day and signature: summed count, widest time span, newest severity, place and sample."""
    rows = entries.filter(F.col("ts").isNotNull()).select(
        F.to_date("ts").alias("snapshot_day"), "signature", "severity", F.col("file").alias("file_line"),
        F.col("sample").alias("sample_message"), F.lit(1).cast("bigint").alias("count"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"),
    )
    if existing is not None:
        rows = rows.unionByName(existing.select(*DAILY))
    newest = F.max(F.struct("last_seen", "severity", "file_line", "sample_message"))
    out = rows.groupBy("snapshot_day", "signature").agg(
        newest.alias("_n"), F.sum("count").alias("count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )
    return out.select(
        "snapshot_day", "signature", F.col("_n.severity").alias("severity"), F.col("_n.file_line").alias("file_line"),
        F.col("_n.sample_message").alias("sample_message"), "count", "first_seen", "last_seen",
    )
