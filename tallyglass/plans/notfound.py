"""404, scanner and attack reports.

Every report groups by URL before it classifies, so the regex catalogue runs once
per distinct URL and a much-requested URL is folded on the map side. The URL that
gets classified is an aggregate of its group (``max`` of equal values): a filter on
a grouping key would be pushed below the aggregate and classify every row.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import predicates as P
from ..functions import rules, urls
from ..functions.stats import half_up, ratio
from .traffic import in_scope


def hits_404(events: DataFrame, as_of: datetime, days: int, blog_id: int = 0) -> DataFrame:
    return in_scope(events, as_of, days, "404_error", blog_id)


def filter_404_capture(requests: DataFrame, is_human: Column) -> DataFrame:
    """Requests worth storing: made by a person and not under the events calendar."""
    return requests.filter(is_human & ~F.col("requested_url").rlike("^/event/"))


def by_url(events: DataFrame, as_of: datetime, days: int, blog_id: int = 0) -> DataFrame:
    return (
        hits_404(events, as_of, days, blog_id)
        .groupBy("requested_url")
        .agg(
            F.max("requested_url").alias("url"),
            F.count("*").alias("hits"),
            F.max("created_at").alias("last_seen"),
        )
        .drop("requested_url")
    )


def without_redirects(rows: DataFrame, redirects: DataFrame) -> DataFrame:
    """Drop URLs that have an active redirect; rows without a URL stay."""
    return rows.join(redirects.select("url"), "url", "left_anti")


def summary_404(events: DataFrame, as_of: datetime, days: int = 7, blog_id: int = 0) -> DataFrame:
    total = F.count("*")
    per_day = half_up(total / F.lit(float(days)), 2) if days > 0 else total.cast("double")
    return hits_404(events, as_of, days, blog_id).agg(
        total.alias("total"),
        F.count_distinct("requested_url").alias("unique_urls"),
        F.count_distinct("ip_hash").alias("unique_ips"),
        per_day.alias("per_day_avg"),
    )


def daily_404(events: DataFrame, as_of: datetime, days: int = 7, blog_id: int = 0) -> DataFrame:
    return (
        hits_404(events, as_of, days, blog_id)
        .groupBy(F.to_date("created_at").alias("date"))
        .agg(F.count("*").alias("hits"))
        .orderBy(F.desc("date"))
    )


def top_urls_404(
    events: DataFrame, redirects: DataFrame, as_of: datetime, days: int = 7, limit: int = 30, min_hits: int = 2,
    blog_id: int = 0,
) -> DataFrame:
    rows = by_url(events, as_of, days, blog_id).filter(F.col("hits") >= min_hits)
    ranked = without_redirects(rows, redirects).orderBy(F.desc("hits"), "url").limit(limit)
    return ranked.withColumn("category", C.not_found_category(F.col("url")))


def patterns_404(
    events: DataFrame, redirects: DataFrame, as_of: datetime, days: int = 7, blog_id: int = 0
) -> DataFrame:
    """Hits per category with its share of all non-redirected hits."""
    rows = without_redirects(by_url(events, as_of, days, blog_id), redirects)
    grouped = (
        rows.withColumn("category", C.not_found_category(F.coalesce("url", F.lit(""))))
        .groupBy("category")
        .agg(F.sum("hits").alias("hits"), F.count("*").alias("unique_urls"))
    )
    total = grouped.agg(F.sum("hits")).scalar()
    return grouped.select(
        "category",
        "hits",
        "unique_urls",
        half_up(F.col("hits") / total * 100, 1).alias("pct"),
        C.is_actionable(F.col("category")).alias("actionable"),
    ).orderBy(F.desc("hits"), "category")


def drill_404(
    events: DataFrame,
    redirects: DataFrame,
    content: DataFrame,
    as_of: datetime,
    category: str,
    days: int = 7,
    limit: int = 20,
    blog_id: int = 0,
) -> DataFrame:
    """URLs of one category; redirectable categories also name the post they most likely meant."""
    rows = without_redirects(by_url(events, as_of, days, blog_id), redirects)
    picked = (
        rows.filter(C.not_found_category(F.col("url")) == category).orderBy(F.desc("hits"), "url").limit(limit)
    )
    if category not in rules.REDIRECTABLE_404:
        return picked
    return with_post_by_slug(picked.withColumn("slug", urls.slug_of_404(F.col("url"))), content)


def with_post_by_slug(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Adds the published post or page that owns each slug."""
    posts = (
        content.filter((F.col("status") == "publish") & F.col("post_type").isin("post", "page"))
        .groupBy("slug")
        .agg(F.min("post_id").alias("post_id"))
    )
    return rows.join(posts, "slug", "left").withColumn("fixable", F.col("post_id").isNotNull())


def list_404(events: DataFrame, as_of: datetime, days: int = 7, limit: int = 50, blog_id: int = 0) -> DataFrame:
    return (
        hits_404(events, as_of, days, blog_id)
        .select(
            "id",
            F.col("requested_url").alias("url"),
            F.coalesce("user_agent", F.lit("")).alias("user_agent"),
            F.coalesce("ip_hash", F.lit("")).alias("ip_hash"),
            F.col("created_at").alias("date"),
            "blog_id",
        )
        .orderBy(F.desc("date"), F.desc("id"))
        .limit(limit)
    )


def top_ips_404(events: DataFrame, as_of: datetime, days: int = 7, limit: int = 15, blog_id: int = 0) -> DataFrame:
    """Busiest clients with their most frequent user agent, ties by agent."""
    rows = hits_404(events, as_of, days, blog_id)
    ranked = (
        rows.groupBy("ip_hash")
        .agg(
            F.count("*").alias("hits"),
            F.count_distinct("requested_url").alias("unique_urls"),
            F.min("created_at").alias("first_seen"),
            F.max("created_at").alias("last_seen"),
        )
        .orderBy(F.desc("hits"), F.asc_nulls_first("ip_hash"))
        .limit(limit)
    )
    # only the clients that are shown need their agents
    shown = rows.join(ranked.select(F.col("ip_hash").alias("_ip")), F.col("ip_hash").eqNullSafe(F.col("_ip")), "left_semi")
    agents = shown.groupBy("ip_hash", "user_agent").agg(F.count("*").alias("n"))
    common = agents.groupBy("ip_hash").agg(
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("user_agent").alias("ua")))["ua"].alias("top_ua")
    )
    return ranked.join(common, "ip_hash", "left").withColumn("top_ua", F.coalesce("top_ua", F.lit("")))


def scanner_hits(events: DataFrame, as_of: datetime, days: int = 7, blog_id: int = 0) -> DataFrame:
    """Hits per URL, client and day, with the scanner verdict of the URL."""
    rows = (
        hits_404(events, as_of, days, blog_id)
        .groupBy("requested_url", "ip_hash", F.to_date("created_at").alias("day"))
        .agg(F.coalesce(F.max("requested_url"), F.lit("")).alias("url"), F.count("*").alias("hits"))
        .drop("requested_url")
        .withColumn("category", C.not_found_category(F.col("url")))
    )
    return rows.withColumn("scanner", C.is_scanner(F.col("category")))


def scanner_404(
    events: DataFrame, as_of: datetime, group_by: str = "category", days: int = 7, limit: int = 0, blog_id: int = 0
) -> DataFrame:
    keys = {
        "category": F.col("category"),
        "day": F.col("day").cast("string"),
        "ip": F.coalesce(F.when(F.col("ip_hash") != "", F.col("ip_hash")), F.lit("(unknown)")),
        "url": F.col("url"),
    }
    rows = (
        scanner_hits(events, as_of, days, blog_id)
        .filter("scanner")
        .groupBy(keys[group_by].alias("key"))
        .agg(F.sum("hits").alias("count"))
    )
    order = [F.desc("key")] if group_by == "day" else [F.desc("count"), F.asc("key")]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows


def scanner_404_totals(
    events: DataFrame, as_of: datetime, group_by: str = "category", days: int = 7, limit: int = 0, blog_id: int = 0
) -> DataFrame:
    grouped = {"category": "category", "day": "day", "ip": "ip_hash", "url": "url"}[group_by]
    key = F.col(grouped)
    if group_by == "ip":
        key = F.coalesce(F.when(key != "", key), F.lit("(unknown)"))
    totals = scanner_hits(events, as_of, days, blog_id).agg(
        F.coalesce(F.sum(F.when(F.col("scanner"), F.col("hits"))), F.lit(0)).alias("scanner_total"),
        F.coalesce(F.sum(F.when(~F.col("scanner"), F.col("hits"))), F.lit(0)).alias("benign_total"),
        F.count_distinct(F.when(F.col("scanner"), key)).alias("distinct"),
    )
    total = F.col("scanner_total") + F.col("benign_total")
    return totals.select(
        "scanner_total",
        "benign_total",
        total.alias("total"),
        ratio(F.col("scanner_total") * 100, total, 1, 0.0).alias("scanner_pct"),
        "distinct",
        (F.lit(limit > 0) & (F.col("distinct") > limit)).alias("truncated"),
    )


ATTACK_KEYS = {
    "pattern": lambda: F.col("classification"),
    "day": lambda: F.to_date("created_at").cast("string"),
    "ip": lambda: F.col("ip"),
    "url": lambda: F.col("source_url"),
}


def attack_summary(
    events: DataFrame, as_of: datetime, group_by: str = "pattern", days: int = 28, limit: int = 25, blog_id: int = 0
) -> DataFrame:
    rows = (
        in_scope(events, as_of, days, "search_attack", blog_id)
        .groupBy(ATTACK_KEYS[group_by]().alias("key"))
        .agg(F.count("*").alias("count"))
        .withColumn("key", F.coalesce("key", F.lit("(null)")))
    )
    order = [F.desc("key")] if group_by == "day" else [F.desc("count"), F.asc("key")]
    rows = rows.orderBy(*order)
    return rows.limit(limit) if limit > 0 else rows


def attack_summary_totals(
    events: DataFrame, as_of: datetime, group_by: str = "pattern", days: int = 28, limit: int = 25, blog_id: int = 0
) -> DataFrame:
    """Totals; ``distinct`` skips rows without a key, ``truncated`` counts their group."""
    key = ATTACK_KEYS[group_by]()
    groups = F.count_distinct(key) + F.coalesce(F.max(key.isNull().cast("int")), F.lit(0))
    return in_scope(events, as_of, days, "search_attack", blog_id).agg(
        F.count("*").alias("total"),
        F.count_distinct(key).alias("distinct"),
        (F.lit(limit > 0) & (groups > limit)).alias("truncated"),
    )
