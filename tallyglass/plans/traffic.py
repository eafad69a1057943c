"""Event volume, the event browser and bot-filter impact."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.stats import half_up
from ..functions.windows import relative

SORTABLE = ("id", "event_type", "blog_id", "user_id", "created_at")


def in_scope(
    events: DataFrame, as_of: datetime, days: int, event_type: str | None = None, blog_id: int = 0
) -> DataFrame:
    rows = relative(days, as_of).rows_of(events).filter(P.scoped(blog_id))
    return rows.filter(P.of_type(event_type)) if event_type else rows


def analytics_summary(
    events: DataFrame, as_of: datetime, days: int = 28, event_type: str | None = None, blog_id: int = 0
) -> DataFrame:
    """Raw volume per type with its daily average."""
    counted = in_scope(events, as_of, days, event_type, blog_id).groupBy("event_type").agg(
        F.count("*").alias("count")
    )
    average = half_up(F.col("count") / F.lit(float(days)), 1) if days > 0 else F.col("count").cast("double")
    return counted.select("event_type", "count", average.alias("daily_avg")).orderBy(
        F.desc("count"), "event_type"
    )


def summary_total(events: DataFrame, as_of: datetime, days: int = 28, blog_id: int = 0) -> DataFrame:
    return in_scope(events, as_of, days, None, blog_id).agg(F.count("*").alias("total_events"))


def by_date(events: DataFrame, as_of: datetime, days: int, event_type: str, blog_id: int = 0) -> DataFrame:
    return (
        in_scope(events, as_of, days, event_type, blog_id)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("count"))
        .orderBy("date")
    )


def top_values(rows: DataFrame, key: Column, name: str, limit: int) -> DataFrame:
    """Most frequent non-empty values, ties in key order."""
    return (
        rows.select(key.alias(name))
        .filter(F.col(name) != "")
        .groupBy(name)
        .agg(F.count("*").alias("count"))
        .orderBy(F.desc("count"), name)
        .limit(limit)
    )


def by_source(events: DataFrame, as_of: datetime, days: int, event_type: str, limit: int = 20) -> DataFrame:
    return top_values(in_scope(events, as_of, days, event_type), F.col("source_url"), "source_url", limit)


def by_context(events: DataFrame, as_of: datetime, days: int, event_type: str, limit: int = 20) -> DataFrame:
    return top_values(in_scope(events, as_of, days, event_type), F.col("context"), "context", limit)


def analytics_meta(events: DataFrame) -> DataFrame:
    """Every event type and blog present, as (kind, value) rows, from one scan."""
    pairs = events.groupBy("event_type", "blog_id").agg(F.count("*").alias("_n"))
    return (
        pairs.select(
            F.explode(
                F.array(
                    F.struct(F.lit("event_type").alias("kind"), F.col("event_type").alias("value")),
                    F.struct(F.lit("blog_id").alias("kind"), F.col("blog_id").cast("string").alias("value")),
                )
            ).alias("m")
        )
        .select("m.kind", "m.value")
        .distinct()
    )


def filter_events(
    events: DataFrame,
    event_type: str | None = None,
    blog_id: int = 0,
    user_id: int = 0,
    since: datetime | None = None,
    until_day: datetime | None = None,
    search: str | None = None,
) -> DataFrame:
    """Row-browser filters; the last day is included to 23:59:59."""
    cond = P.scoped(blog_id, user_id)
    if event_type:
        cond = cond & P.of_type(event_type)
    if since is not None:
        cond = cond & (F.col("created_at") >= F.lit(since))
    if until_day is not None:
        cond = cond & (F.col("created_at") <= F.lit(until_day + timedelta(days=1, seconds=-1)))
    if search:
        cond = cond & P.payload_contains(search)
    return events.filter(cond)


def browse_events(
    rows: DataFrame,
    order_by: str = "created_at",
    descending: bool = True,
    limit: int = 50,
    offset: int = 0,
) -> DataFrame:
    """One page in a whitelisted order, ties by id in the same direction."""
    key = order_by if order_by in SORTABLE else "created_at"
    order = [F.desc(key), F.desc("id")] if descending else [F.asc(key), F.asc("id")]
    return rows.orderBy(*order).offset(offset).limit(limit)


def page_before(rows: DataFrame, before_id: int, limit: int) -> DataFrame:
    """Keyset page walking ids downwards."""
    return rows.filter(F.col("id") < before_id).orderBy(F.desc("id")).limit(limit)


def page_after(rows: DataFrame, cursor: tuple[datetime, int], limit: int) -> DataFrame:
    """Keyset page walking (created_at, id) upwards."""
    ts, row_id = F.lit(cursor[0]), F.lit(cursor[1])
    return rows.filter(P.after(F.col("created_at"), F.col("id"), ts, row_id)).orderBy("created_at", "id").limit(limit)


def _impact_rows(events: DataFrame, as_of: datetime, days: int, event_type: str | None, blog_id: int) -> DataFrame:
    rows = in_scope(events, as_of, days, event_type, blog_id).filter(P.bot_is_true())
    person = F.coalesce(F.when(F.col("user_id") != 0, F.col("user_id")), F.col("payload_user_id"), F.lit(0))
    return rows.withColumn("effective_user", person).filter(F.col("effective_user") > 0)


def bot_filter_impact(
    events: DataFrame, as_of: datetime, days: int = 28, event_type: str | None = None, blog_id: int = 0
) -> DataFrame:
    """Known users whose rows are stamped as bots, per type."""
    return (
        _impact_rows(events, as_of, days, event_type, blog_id)
        .groupBy("event_type")
        .agg(F.count("*").alias("events"), F.count_distinct("effective_user").alias("users"))
        .orderBy(F.desc("events"), "event_type")
    )


def bot_filter_totals(
    events: DataFrame, as_of: datetime, days: int = 28, blog_id: int = 0, event_type: str | None = None
) -> DataFrame:
    return _impact_rows(events, as_of, days, event_type, blog_id).agg(
        F.count("*").alias("events"), F.count_distinct("effective_user").alias("users")
    )


def bot_filter_examples(
    events: DataFrame, as_of: datetime, days: int = 28, examples: int = 10, blog_id: int = 0, event_type: str | None = None
) -> DataFrame:
    return (
        _impact_rows(events, as_of, days, event_type, blog_id)
        .select("id", "event_type", "blog_id", "effective_user", "created_at")
        .orderBy(F.desc("created_at"), F.desc("id"))
        .limit(examples)
    )


def post_views(events: DataFrame) -> DataFrame:
    """All-time pageviews per post."""
    return (
        events.filter(P.of_type("pageview") & (F.col("post_id") > 0))
        .groupBy("blog_id", "post_id")
        .agg(F.count("*").alias("views"))
    )
