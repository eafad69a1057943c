"""Rows that came behind the watermark, merged into the counters and sessions they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import sessions as OS
from ..sources.folders import drop_folder, folder_exists

SESSION = "visitor_id string, session_start bigint, session_last bigint, rows bigint"
SESSION_NAMES = ["visitor_id", "session_start", "session_last", "rows"]


def add_late_counts(stored: DataFrame, late: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Stored counters with those of late rows; only keys that late rows have change."""
    both = stored.select(*keys, count).unionByName(late.select(*keys, count))
    return both.groupBy(*keys).agg(F.sum(count).alias(count))


def _days(first: Column, last: Column) -> Column:
    return F.explode(F.sequence(F.floor(first / 86400), F.floor(last / 86400)))


def late_points(late: DataFrame, gap: int) -> DataFrame:
    """Late pageviews folded into their own short runs, as sessions are."""
    rows = late.filter(P.of_type("pageview") & P.identified()).select("visitor_id", "ts", F.lit(0).cast("bigint").alias("id"))
    return OS.session_table(rows, gap).select("visitor_id", "session_start", "session_last", "rows")


def merged_sessions(stored: DataFrame, late: DataFrame, gap: int) -> tuple[DataFrame, DataFrame]:
    """(stored sessions to remove, sessions to put in their place).

    A late row joins every stored session that it lies no further than the gap from, and so may join two.
    Sessions further away keep out: they lie further from each other than the gap. Neighbours meet by
    visitor and day, so the rest of a visitor's sessions is not looked at.
    """
    runs = late_points(late, gap)
    near = runs.select("visitor_id", F.col("session_start").alias("low"), F.col("session_last").alias("high"), _days(F.col("session_start") - gap, F.col("session_last") + gap).alias("day"))
    there = stored.select(*SESSION_NAMES, _days(F.col("session_start"), F.col("session_last")).alias("day"))
    meets = (F.col("session_start") <= F.col("high") + gap) & (F.col("session_last") >= F.col("low") - gap)
    touched = there.join(near, ["visitor_id", "day"]).filter(meets).select(*SESSION_NAMES).distinct()
    parts = touched.unionByName(runs)
    spans = parts.select("visitor_id", F.col("session_start").alias("_first"), F.col("session_last").alias("_last"), "rows")
    return touched, joined_spans(spans, gap)


def joined_spans(spans: DataFrame, gap: int) -> DataFrame:
    """Joins spans of one visitor that overlap or lie no further apart than the gap."""
    by_start = Window.partitionBy("visitor_id").orderBy("_first", "_last")
    reach = F.max("_last").over(by_start.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("_first") - reach > gap, F.lit(True)), F.col("_first"))
    marked = spans.withColumn("_begin", begins)
    start = F.last("_begin", ignorenulls=True).over(by_start.rowsBetween(Window.unboundedPreceding, 0))
    out = marked.withColumn("session_start", start).groupBy("visitor_id", "session_start")
    return out.agg(F.max("_last").alias("session_last"), F.sum("rows").alias("rows")).select(*SESSION_NAMES)


def store_sessions(sessions: DataFrame, path: str) -> None:
    """Sessions by the day of their start."""
    day = F.to_date(F.timestamp_seconds("session_start"))
    sessions.select(*SESSION_NAMES, day.alias("session_day")).write.mode("append").partitionBy("session_day").parquet(path)


def merge_late_sessions(spark: SparkSession, path: str, late: DataFrame, staging: str, gap: int) -> int:
    """Replaces the sessions that late rows touch in a table of :func:`store_sessions`; returns the days rewritten.

    Only days of removed and of new sessions are read and written. The new days are staged first, so a run
    that fails can be repeated with the same ``staging``: what was staged is then put in place.
    """
    plan, ready = f"{staging}/plan", f"{staging}/days"
    stored = spark.read.schema(SESSION + ", session_day date").parquet(path)
    if not folder_exists(spark, f"{plan}/_SUCCESS"):
        gone, fresh = merged_sessions(stored, late, gap)
        gone.withColumn("gone", F.lit(True)).unionByName(fresh.withColumn("gone", F.lit(False))).write.mode("overwrite").parquet(plan)
    changes = spark.read.schema(SESSION + ", gone boolean").parquet(plan).withColumn("session_day", F.to_date(F.timestamp_seconds("session_start")))
    days = [r[0] for r in changes.select("session_day").distinct().collect()]  # bounded by the calendar
    if not days:
        return 0
    if not folder_exists(spark, f"{ready}/_SUCCESS"):
        kept = stored.filter(F.col("session_day").isin(days)).join(changes.filter("gone").select("visitor_id", "session_start"), ["visitor_id", "session_start"], "left_anti")
        fresh = changes.filter("NOT gone").select(*SESSION_NAMES, "session_day")
        kept.select(*SESSION_NAMES, "session_day").unionByName(fresh).repartition("session_day").write.mode("overwrite").partitionBy("session_day").parquet(ready)
    staged = spark.read.schema(SESSION + ", session_day date").parquet(ready)
    left = {r[0] for r in staged.select("session_day").distinct().collect()}
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_day").parquet(path)
    for day in days:
        if day not in left:
            drop_folder(spark, f"{path}/session_day={day}")
    return len(days)
