"""Surface growth, demand drill and link-page analytics over external and counter feeds."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up, ratio

SEARCH_LAG_DAYS = 3


def check_feed(feed: DataFrame, hosts: DataFrame, start: date, end: date) -> DataFrame:
    """Completeness of a daily feed per host: every day present, and none that the feed marks as ``truncated``."""
    days = (end - start).days + 1
    inside = feed.filter(F.col("date").between(F.lit(start), F.lit(end)))
    cut = F.coalesce("truncated", F.lit(False)) if "truncated" in feed.columns else F.lit(False)
    per_day = inside.groupBy("host", "date").agg(F.sum("sessions").alias("sessions"), F.bool_or(cut).alias("cut"))
    seen = per_day.groupBy("host").agg(
        F.count("*").alias("days"), F.bool_or("cut").alias("cut"), F.sum("sessions").alias("sessions")
    )
    out = hosts.select("host").join(seen, "host", "left")
    n = F.coalesce("days", F.lit(0))
    reason = F.when(F.col("cut"), "truncated_feed").when(n < days, "truncated_series")
    return out.select(
        "host",
        n.alias("days"),
        F.when(reason.isNull(), "measured").otherwise("not_instrumented").alias("status"),
        F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(reason.isNull(), F.col("sessions")).alias("sessions"),
    )


def surface_supply(content: DataFrame, surfaces: DataFrame, as_of: datetime, weeks: int = 4) -> DataFrame:
    """Items published in the window against everything published before it."""
    since = F.lit(as_of - timedelta(weeks=weeks))
    live = content.filter(F.col("status") == "publish")
    counts = surfaces.join(live, ["blog_id", "post_type"], "left").groupBy("surface", "blog_id", "post_type", "host").agg(
        F.count_if(F.col("published_at") >= since).alias("new_in_window"),
        F.count_if(F.col("published_at") < since).alias("prior_total"),
    )
    growth = F.col("new_in_window").cast("double") / F.when(F.col("prior_total") > 0, F.col("prior_total")) / weeks * 100
    return counts.select(
        "surface", "host", "new_in_window", "prior_total",
        half_up(F.col("new_in_window") / F.lit(float(weeks)), 2).alias("per_week"),
        half_up(growth, 3).alias("pct_per_week"),
    )


def surface_demand(
    daily: DataFrame, traffic: DataFrame, surfaces: DataFrame, as_of: date, weeks: int = 4
) -> DataFrame:
    """Slope of organic sessions between two equal windows.

    Falls back to all sessions for both windows when either has no source rows.
    """
    days = weeks * 7
    cur = (as_of - timedelta(days=days), as_of - timedelta(days=1))
    prev = (as_of - timedelta(days=2 * days), as_of - timedelta(days=days + 1))
    hosts = surfaces.select("host").distinct()
    now = check_feed(daily, hosts, *cur).select("host", F.col("status").alias("s1"), F.col("sessions").alias("current_sessions"))
    old = check_feed(daily, hosts, *prev).select("host", F.col("status").alias("s0"), F.col("sessions").alias("previous_sessions"))
    period = F.when(F.col("date").between(*map(F.lit, cur)), "c").when(F.col("date").between(*map(F.lit, prev)), "p")
    organic = F.lower(F.coalesce("medium", F.lit(""))).contains("organic")
    sources = traffic.withColumn("_w", period).filter(F.col("_w").isNotNull()).groupBy("host").agg(
        *[F.count_if(F.col("_w") == w).alias(f"{w}_rows") for w in "cp"],
        *[F.coalesce(F.sum(F.when((F.col("_w") == w) & organic, F.col("sessions"))), F.lit(0)).alias(f"{w}_org") for w in "cp"],
        F.coalesce(F.sum(F.when(F.col("_w") == "c", F.col("sessions"))), F.lit(0)).alias("c_all"),
    )
    out = surfaces.select("surface", "host").join(now, "host").join(old, "host").join(sources, "host", "left")
    ok = (F.col("s1") == "measured") & (F.col("s0") == "measured")
    by_source = F.coalesce((F.col("c_rows") > 0) & (F.col("p_rows") > 0), F.lit(False))
    c = F.when(by_source, F.col("c_org")).otherwise(F.col("current_sessions"))
    p = F.when(by_source, F.col("p_org")).otherwise(F.col("previous_sessions"))
    slope = half_up((c - p).cast("double") / F.when(p > 0, p) * 100, 2)
    shown = lambda col: F.when(ok, col)
    out = out.select(
        "surface", "host", ok.alias("measured"),
        shown(F.when(by_source, "organic").otherwise("all_sessions")).alias("basis"),
        shown(F.when(by_source, ratio(F.col("c_org"), F.col("c_all"), 4))).alias("organic_share"),
        shown(F.col("current_sessions")).alias("current_sessions"),
        shown(F.col("previous_sessions")).alias("previous_sessions"),
        shown(c).alias("current_organic"), shown(p).alias("previous_organic"),
        shown(slope).alias("slope_pct"),
    )
    return out.select(
        "*",
        half_up(F.col("slope_pct") / F.lit(float(weeks)), 3).alias("pct_per_week"),
        F.when(F.col("measured"), F.col("slope_pct").isNull() & (F.col("current_organic") > 0)).alias("is_new_traffic"),
    )


def rank_surfaces(growth: DataFrame) -> DataFrame:
    """Measured surfaces by weekly growth; the rest stay listed, unranked.

    The window runs over one row per surface.
    """
    measured = F.col("pct_per_week").isNotNull()
    order = Window.orderBy(F.desc_nulls_last("pct_per_week"), "surface")
    return growth.select(
        "surface", "pct_per_week",
        F.when(measured, F.row_number().over(order)).alias("position"),
        F.when(~measured, "no_measured_growth").alias("reason"),
    )


def fastest(growth: DataFrame) -> DataFrame:
    return rank_surfaces(growth).filter(F.col("position") == 1).select("surface", "pct_per_week")


# ---- demand drill ---------------------------------------------------------------------


def drill_windows(as_of: date, weeks: int = 4) -> tuple[tuple[date, date], tuple[date, date]]:
    """Current window ending three days back, and the equal one before it."""
    end = as_of - timedelta(days=SEARCH_LAG_DAYS)
    start = end - timedelta(days=weeks * 7 - 1)
    return (start, end), (start - timedelta(days=weeks * 7), start - timedelta(days=1))


def demand_changes(current: DataFrame, prior: DataFrame, min_clicks: int = 1) -> DataFrame:
    """Full outer comparison by key: a missing side has 0 clicks and no position."""
    side = lambda df, s: df.filter(F.col("key") != "").select(
        "key", F.col("clicks").alias(f"clicks_{s}"), F.col("impressions").alias(f"impressions_{s}"),
        half_up(F.col("position"), 1).alias(f"position_{s}"),
    )
    both = side(current, "current").join(side(prior, "prior"), "key", "full_outer").na.fill(
        0, ["clicks_current", "clicks_prior", "impressions_current", "impressions_prior"]
    )
    both = both.filter((F.col("clicks_current") >= min_clicks) | (F.col("clicks_prior") >= min_clicks))
    return both.select(
        F.col("key").alias("target"), "clicks_current", "clicks_prior",
        (F.col("clicks_current") - F.col("clicks_prior")).alias("net_click_change"),
        "impressions_current", "impressions_prior", "position_current", "position_prior",
        half_up(F.col("position_current") - F.col("position_prior"), 1).alias("position_change"),
    )


def decliners(changes: DataFrame, limit: int = 25) -> DataFrame:
    return changes.filter(F.col("net_click_change") < 0).orderBy("net_click_change", "target").limit(limit)


def risers(changes: DataFrame, limit: int = 25) -> DataFrame:
    return changes.filter(F.col("net_click_change") > 0).orderBy(F.desc("net_click_change"), "target").limit(limit)


def demand_totals(changes: DataFrame) -> DataFrame:
    net = F.col("net_click_change")
    return changes.agg(
        F.count("*").alias("contributors"), F.coalesce(F.sum(net), F.lit(0)).alias("net_click_total"),
        F.count_if(net < 0).alias("decliner_count"), F.count_if(net > 0).alias("riser_count"),
    )


# ---- link pages -----------------------------------------------------------------------


def link_page_daily(views: DataFrame, clicks: DataFrame, end: date, days: int = 30) -> DataFrame:
    """Every date of the range for every page with a counter, zeros filled."""
    start = end - timedelta(days=days - 1)
    inside = F.col("stat_date").between(F.lit(start), F.lit(end))
    v = views.filter(inside).groupBy("link_page_id", "stat_date").agg(F.sum("view_count").alias("views"))
    c = clicks.filter(inside).groupBy("link_page_id", "stat_date").agg(F.sum("click_count").alias("clicks"))
    pages = v.select("link_page_id").unionByName(c.select("link_page_id")).distinct()
    calendar = pages.select("link_page_id", F.explode(F.sequence(F.lit(start), F.lit(end))).alias("stat_date"))
    keys = ["link_page_id", "stat_date"]
    return calendar.join(v, keys, "left").join(c, keys, "left").na.fill(0, ["views", "clicks"])


def link_page_totals(daily: DataFrame) -> DataFrame:
    return daily.groupBy("link_page_id").agg(F.sum("views").alias("views"), F.sum("clicks").alias("clicks"))


def top_links(clicks: DataFrame, end: date, days: int = 30, limit: int = 20) -> DataFrame:
    """Most clicked links of every page. Spark trims each page's groups before it shuffles them."""
    start = end - timedelta(days=days - 1)
    rows = clicks.filter(F.col("stat_date").between(F.lit(start), F.lit(end)))
    summed = rows.groupBy("link_page_id", "link_url", "link_text").agg(F.sum("click_count").alias("clicks"))
    order = Window.partitionBy("link_page_id").orderBy(F.desc("clicks"), "link_url", "link_text")
    return summed.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)
