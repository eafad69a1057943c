"""Retention, privacy and repair jobs over the stored (bronze) event table.

Each job is a pure frame-to-frame step; :func:`apply_to_days` applies one to a stored
table, reading and replacing only the days it touches.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import urls
from .events import payload_field
from .folders import drop_folder

EMAIL_TYPES = ["email_sent", "email_failed"]
EMAIL_KEPT = "recipient_count bigint, context string, error_code string, user_id bigint, is_bot boolean"
#: Where Spark keeps the rows whose partition column is null.
NULL_FOLDER = "__HIVE_DEFAULT_PARTITION__"
NOT_FOUND_DAYS, EMAIL_DAYS, LINK_PAGE_DAYS = 90, 30, 90


def apply_to_days(
    spark: SparkSession, path: str, staging: str, hit: Column, change: Callable[[DataFrame], DataFrame], by: str = "event_date"
) -> int:
    """Rewrites the days of a stored table that hold rows of ``hit``, by ``change``; returns their number.

    The days come from the old rows, so a day that loses its last row is removed and days without a
    hit are neither read nor written. Days are bounded by the calendar; rows without one have a day of their own.
    """
    rows = spark.read.parquet(path)
    days = [r[0] for r in rows.filter(hit).select(by).distinct().collect()]
    if not days:
        return 0
    known = [d for d in days if d is not None]
    mine = F.col(by).isin(known) if None not in days else F.col(by).isin(known) | F.col(by).isNull()
    change(rows.filter(mine)).write.mode("overwrite").partitionBy(by).parquet(staging)
    staged = spark.read.schema(rows.schema).parquet(staging)
    left = {r[0] for r in staged.select(by).distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    for day in days:
        if day not in left:
            drop_folder(spark, f"{path}/{by}={NULL_FOLDER if day is None else day}")
    return len(days)


def purge_days(spark: SparkSession, path: str, staging: str, types: list[str], older_than: datetime) -> int:
    old = F.coalesce(P.of_type(types) & (F.col("created_at") < F.lit(older_than)), F.lit(False))
    return apply_to_days(spark, path, staging, old, lambda rows: rows.filter(~old))


def scrub_days(spark: SparkSession, path: str, staging: str, types: list[str] = EMAIL_TYPES) -> int:
    return apply_to_days(spark, path, staging, F.coalesce(P.of_type(types), F.lit(False)), lambda rows: scrub_email_pii(rows, types))


def erase_days(spark: SparkSession, path: str, staging: str, user_id: int, types: list[str] = EMAIL_TYPES) -> int:
    mine = F.coalesce(P.of_type(types) & (F.col("user_id") == user_id), F.lit(False))
    return apply_to_days(spark, path, staging, mine, lambda rows: rows.filter(~mine))


def purge(rows: DataFrame, types: list[str], older_than: datetime) -> tuple[DataFrame, DataFrame]:
    """(rows kept, one-row frame with the number purged)."""
    old = P.of_type(types) & (F.col("created_at") < F.lit(older_than))
    return rows.filter(~F.coalesce(old, F.lit(False))), rows.filter(old).agg(F.count("*").alias("purged"))


def purge_404(rows: DataFrame, as_of: datetime, days: int = NOT_FOUND_DAYS) -> tuple[DataFrame, DataFrame]:
    return purge(rows, ["404_error"], as_of - timedelta(days=days))


def purge_email(rows: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    return purge(rows, EMAIL_TYPES, as_of - timedelta(days=EMAIL_DAYS))


def purge_link_pages(counters: DataFrame, as_of: datetime) -> tuple[DataFrame, DataFrame]:
    old = F.col("stat_date") < F.lit((as_of - timedelta(days=LINK_PAGE_DAYS)).date())
    return counters.filter(~old), counters.filter(old).agg(F.count("*").alias("purged"))


def scrub_email_pii(rows: DataFrame, types: list[str] = EMAIL_TYPES) -> DataFrame:
    """Keeps only the harmless payload keys of e-mail rows; their broken payloads go."""
    mine = P.of_type(types)
    # The parser stops at the end of the object, so text after it is looked for separately.
    good = F.json_object_keys("event_data").isNotNull() & F.col("event_data").rlike(r"\}\s*$")
    clean = F.to_json(F.from_json("event_data", EMAIL_KEPT))
    return rows.filter(~mine | good).withColumn("event_data", F.when(mine, clean).otherwise(F.col("event_data")))


def minimize_email(recipients: Column, context: Column, max_count: int = 0, max_chars: int = 0) -> tuple[Column, Column]:
    """Recipient count and context identifier; bounded only where a bound is given."""
    parts = F.filter(F.split(F.coalesce(recipients, F.lit("")), r"\s*,\s*"), lambda x: x != "")
    name = F.regexp_replace(F.lower(F.coalesce(context, F.lit(""))), r"[^a-z0-9:_\-]", "")
    count, label = F.size(parts), F.when(name == "", "unknown").otherwise(name)
    return (
        F.least(count, F.lit(max_count)) if max_count > 0 else count,
        F.substring(label, 1, max_chars) if max_chars > 0 else label,
    )


EXPORTED = ["recipient_count", "context", "error_code"]


def export_user_events(rows: DataFrame, user_id: int, max_id: int, types: list[str] = EMAIL_TYPES) -> DataFrame:
    """One data subject's outcome rows up to an id boundary."""
    mine = rows.filter(P.of_type(types) & (F.col("user_id") == user_id) & (F.col("id") <= max_id))
    return mine.select("id", "event_type", "created_at", *[payload_field(f).alias(f) for f in EXPORTED]).orderBy("id")


def erase_user_events(rows: DataFrame, user_id: int, types: list[str] = EMAIL_TYPES) -> DataFrame:
    mine = P.of_type(types) & (F.col("user_id") == user_id)
    return rows.filter(~F.coalesce(mine, F.lit(False)))


def _without_flag() -> Column:
    keys = F.json_object_keys("event_data")
    return keys.isNotNull() & ~F.array_contains(keys, "is_bot")


def backfill_is_bot(rows: DataFrame, event_type: str | None = None, blog_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """Flags rows whose payload has no ``is_bot`` by whether a visitor is known.

    The key is put in front of the closing brace, so every other value keeps its type.
    """
    hit = _without_flag() & P.scoped(blog_id)
    if event_type:
        hit = hit & P.of_type(event_type)
    hit = F.coalesce(hit, F.lit(False))
    flag = F.concat(F.lit('"is_bot":'), (~P.identified()).cast("string"), F.lit("}"))
    empty = F.col("event_data").rlike(r"^\s*\{\s*\}\s*$")
    body = F.regexp_replace("event_data", r"\}\s*$", "")
    filled = F.concat(body, F.when(empty, "").otherwise(","), flag)
    out = rows.withColumn("event_data", F.when(hit, filled).otherwise(F.col("event_data")))
    totals = rows.agg(
        F.count("*").alias("scanned"),
        F.count_if(hit & P.identified()).alias("set_human"),
        F.count_if(hit & ~P.identified()).alias("set_bot"),
    )
    return out, totals


def fix_pageview_is_bot(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A pageview with a visitor is never a bot: true becomes false."""
    flag = payload_field("is_bot")
    hit = P.of_type("pageview") & P.identified() & F.coalesce(flag == "true", F.lit(False))
    fixed = F.regexp_replace("event_data", r'"is_bot"\s*:\s*true', '"is_bot":false')
    out = rows.withColumn("event_data", F.when(hit, fixed).otherwise(F.col("event_data")))
    return out, rows.agg(F.count_if(P.of_type("pageview")).alias("scanned"), F.count_if(hit).alias("corrected"))


def redact_source_urls(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Source URLs down to origin and path; unreadable ones become empty."""
    url = F.coalesce("source_url", F.lit(""))
    clean = urls.canonical_url(url)
    totals = rows.agg(
        F.count("*").alias("scanned"),
        F.count_if((clean != "") & (clean != url)).alias("redacted"),
        F.count_if((clean == "") & (url != "")).alias("invalid"),
    )
    return rows.withColumn("source_url", clean), totals
