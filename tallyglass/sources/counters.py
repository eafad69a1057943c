"""Daily counters for link pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIEW_KEYS = ["link_page_id", "stat_date"]
CLICK_KEYS = ["link_page_id", "stat_date", "link_url", "link_text"]


def link_views(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("event_type") == "pageview") & (F.col("post_id") > 0))
    return rows.select(F.col("post_id").alias("link_page_id"), F.to_date("created_at").alias("stat_date"))


def link_clicks(events: DataFrame) -> DataFrame:
    rows = events.filter((F.col("event_type") == "outbound_click") & (F.col("post_id") > 0))
    return rows.select(
        F.col("post_id").alias("link_page_id"), F.to_date("created_at").alias("stat_date"),
        F.col("dest_url").alias("link_url"), F.coalesce("dest_host", F.lit("")).alias("link_text"),
    )


def rollup(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias(count))


def merge(existing: DataFrame | None, fresh: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Adds new counts to stored ones."""
    if existing is None:
        return fresh
    both = existing.select(*keys, count).unionByName(fresh.select(*keys, count))
    return both.groupBy(*keys).agg(F.sum(count).alias(count))


def rollup_link_views(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return merge(existing, rollup(link_views(events), VIEW_KEYS, "view_count"), VIEW_KEYS, "view_count")


def rollup_link_clicks(events: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    return merge(existing, rollup(link_clicks(events), CLICK_KEYS, "click_count"), CLICK_KEYS, "click_count")
