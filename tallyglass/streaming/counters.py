"""Daily link-page counters and sessions over the event stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from . import batches as MB


def count_link_views(stream: DataFrame, target: str, checkpoint: str, delay: str = "2 days") -> None:
    """Counts per page and day; each batch writes the new totals of the days it changed."""
    rows = stream.filter(P.of_type("pageview") & (F.col("post_id") > 0)).select(
        "created_at", F.col("post_id").alias("link_page_id")
    )
    counted = rows.withWatermark("created_at", delay).groupBy(
        "link_page_id", F.window("created_at", "1 day").alias("w")
    ).agg(F.count("*").alias("view_count"))
    out = counted.select("link_page_id", F.to_date("w.start").alias("stat_date"), "view_count")
    MB.run(out, lambda rows, batch_id: MB.put(rows, target, batch_id), checkpoint, mode="update")


def count_link_clicks(stream: DataFrame, target: str, checkpoint: str, delay: str = "2 days") -> None:
    """Counts per page, day, address and text of outbound links, as :func:`count_link_views`."""
    rows = stream.filter(P.of_type("outbound_click") & (F.col("post_id") > 0)).select(
        "created_at", F.col("post_id").alias("link_page_id"), F.col("dest_url").alias("link_url"),
        F.coalesce("dest_host", F.lit("")).alias("link_text"),
    )
    counted = rows.withWatermark("created_at", delay).groupBy(
        "link_page_id", "link_url", "link_text", F.window("created_at", "1 day").alias("w")
    ).agg(F.count("*").alias("click_count"))
    out = counted.select("link_page_id", F.to_date("w.start").alias("stat_date"), "link_url", "link_text", "click_count")
    MB.run(out, lambda rows, batch_id: MB.put(rows, target, batch_id), checkpoint, mode="update")


def link_clicks(spark: SparkSession, target: str) -> DataFrame:
    stored = spark.read.parquet(target)
    return stored.groupBy("link_page_id", "stat_date", "link_url", "link_text").agg(F.max_by("click_count", "batch").alias("click_count"))


def link_views(spark: SparkSession, target: str) -> DataFrame:
    """Current totals: those of the last batch that touched each counter."""
    stored = spark.read.parquet(target)
    return stored.groupBy("link_page_id", "stat_date").agg(F.max_by("view_count", "batch").alias("view_count"))


def stream_sessions(stream: DataFrame, target: str, checkpoint: str, gap_secs: int, delay: str) -> None:
    """Sessions of known visitors, written once each when the watermark has passed their end."""
    rows = stream.filter(P.of_type("pageview") & P.identified()).select("visitor_id", "created_at", "ts")
    sessions = rows.withWatermark("created_at", delay).groupBy(
        "visitor_id", F.session_window("created_at", f"{gap_secs} seconds").alias("w")
    ).agg(F.count("*").alias("rows"), F.min("ts").alias("session_start"), F.max("ts").alias("session_last"))
    out = sessions.select("visitor_id", "session_start", "session_last", "rows")
    out.writeStream.outputMode("append").format("parquet").option("path", target).option(
        "checkpointLocation", checkpoint
    ).trigger(availableNow=True).start().awaitTermination()
