"""Content revenue, revenue pages and delivery coverage."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls
from ..functions.stats import half_up, ratio
from ..operators import revenue as R
from ..operators.quantiles import exact_median
from ..operators.reuse import Shared


def rollup_by_format(resolved: DataFrame) -> DataFrame:
    rows = resolved.filter("editorial")
    return R.rollup(rows, F.col("format").alias("bucket")).orderBy(F.desc("dollars_per_page"), "bucket")


def rollup_by_category(resolved: DataFrame) -> DataFrame:
    """A page counts in every one of its categories."""
    rows = resolved.filter("editorial").withColumn("bucket", F.explode("categories"))
    return R.rollup(rows, F.col("bucket")).orderBy(F.desc("dollars_per_page"), "bucket")


def cohort_totals(resolved: DataFrame) -> DataFrame:
    """Content, non-editorial and unresolved rows as disjoint cohorts."""
    return R.rollup(resolved, R.cohort().alias("cohort"))


def unresolved_by_route(resolved: DataFrame) -> DataFrame:
    rows = resolved.filter(~F.col("is_content"))
    return R.rollup(rows, F.col("route_family")).drop("dollars_per_page").orderBy(F.desc("views"), "route_family")


def non_editorial_by_type(resolved: DataFrame) -> DataFrame:
    rows = resolved.filter(F.col("is_content") & ~F.col("editorial"))
    bucket = F.concat(F.lit("blog-"), F.col("content_blog_id").cast("string"), F.lit(":"), F.col("post_type"))
    return R.rollup(rows, bucket.alias("bucket")).orderBy(F.desc("dollars_per_page"), "bucket")


# ---- pages ----------------------------------------------------------------------------

SORT_KEYS = {
    "views": F.col, "revenue": F.col, "dollars_per_page": F.col, "derived_rpm": F.col, "source_rpm": F.col,
    "cpm": F.col, "viewability": F.col, "fill_rate": F.col, "impressions_per_pageview": F.col,
    "benchmark_opportunity": lambda _: F.when(
        F.col("benchmark_score").isNotNull(),
        F.when(F.col("benchmark_opportunity"), 1_000_000.0).otherwise(0.0) + F.col("benchmark_score"),
    ),
}
RATES = {
    "source_rpm": "rpm", "cpm": "cpm", "viewability": "viewability", "fill_rate": "fill_rate",
    "impressions_per_pageview": "impressions_per_pageview",
}
MIN_BENCHMARK = 5
OPPORTUNITY = 1.5


def page_table(resolved: DataFrame) -> DataFrame:
    """One row per page: volumes are summed, rates are plain means of the page's rows."""
    means = [(F.sum(f"sum_{src}") / F.sum("rows")).alias(f"_{name}") for name, src in RATES.items()]
    text = lambda col: F.max(F.coalesce(F.when(F.col("is_content"), F.col(col)), F.lit("")))
    folded = resolved.groupBy("page_key", "is_content").agg(
        F.max(F.when(F.col("is_content"), F.col("stored_post_id")).otherwise(0)).alias("post_id"),
        F.max(F.when(F.col("is_content"), F.col("content_blog_id")).otherwise(0)).alias("content_blog_id"),
        text("title").alias("title"),
        F.max("page_url").alias("url"),
        F.max(F.when(F.col("is_content"), urls.route_path(F.col("content_url"))).otherwise("")).alias("path"),
        F.max(F.when(F.col("is_content"), F.array_join("categories", ",")).otherwise("")).alias("categories"),
        text("format").alias("format"),
        F.max(F.coalesce("route_family", F.lit(""))).alias("route_family"),
        F.max(F.to_date("published_at")).alias("published_date"),
        F.sum("views").alias("views"),
        F.sum("revenue").alias("_rev"),
        *means,
        R.aggregate_status().alias("_status"),
        F.max("policy_conflict").alias("policy_conflict"),
    )
    revenue = half_up(F.col("_rev"), 4)
    return folded.select(
        "page_key",
        F.when(F.col("is_content"), "resolved").otherwise("unresolved").alias("cohort"),
        "post_id", "content_blog_id", "title", "url", "path", "categories", "format", "route_family", "published_date",
        "views",
        revenue.alias("revenue"),
        R.per_thousand(F.col("_rev"), F.col("views"), 4).alias("derived_rpm"),
        *[half_up(F.col(f"_{name}"), 4).alias(name) for name in RATES],
        revenue.alias("dollars_per_page"),
        (F.col("views") <= 0).alias("zero_views"),
        F.when(F.col("_status") == "mixed", "unknown").otherwise(F.col("_status")).alias("revenue_status"),
        "policy_conflict",
    )


def with_benchmark(pages: DataFrame) -> DataFrame:
    """Score against the median of policy-confirmed pages with views; needs at least five."""
    base = pages.filter((F.col("views") > 0) & (F.col("revenue_status") == "applicable"))
    rpm = exact_median(base, "derived_rpm").select(F.struct("median", "n")).scalar()
    views = exact_median(base, "views").select("median").scalar()
    out = pages.withColumn("_rpm", rpm).withColumn("_views", views)
    usable = (F.col("_rpm.n") >= MIN_BENCHMARK) & (F.col("revenue_status") == "applicable") & (F.col("views") > 0)
    score = F.when(usable & (F.col("_rpm.median") <= 0), 0.0).when(
        usable, ratio(F.col("derived_rpm"), F.col("_rpm.median"), 4)
    )
    out = out.withColumn("benchmark_score", score)
    hit = (F.col("benchmark_score") >= OPPORTUNITY) & (F.col("views") >= F.col("_views"))
    return out.withColumn("benchmark_opportunity", F.coalesce(hit, F.lit(False))).drop("_rpm", "_views")


def sort_pages(pages: DataFrame, sort_by: str = "derived_rpm", order: str = "desc", limit: int = 50) -> DataFrame:
    """Missing values last in both directions, ties by page key."""
    key = SORT_KEYS.get(sort_by, SORT_KEYS["derived_rpm"])(sort_by if sort_by in SORT_KEYS else "derived_rpm")
    ordered = key.asc_nulls_last() if order == "asc" else key.desc_nulls_last()
    out = pages.orderBy(ordered, "page_key")
    return out.limit(limit) if limit > 0 else out


class RevenuePages(Shared):
    """Page ranking of one cohort: pages first, then the cohort, then the view threshold."""

    def __init__(self, resolved: DataFrame, cohort: str = "resolved", min_views: int = 0):
        super().__init__()
        self.pages = self.keep("pages", lambda: page_table(resolved))
        self.mine = F.lit(True) if cohort == "all" else F.col("cohort") == cohort
        self.kept = self.mine & (F.col("views") >= min_views)

    def ranked(self, sort_by: str = "derived_rpm", order: str = "desc", limit: int = 50) -> DataFrame:
        return sort_pages(with_benchmark(self.pages.filter(self.kept)), sort_by, order, limit)

    def totals(self, limit: int = 50) -> DataFrame:
        """Totals of the cohort before the limit."""
        base = self.kept & (F.col("views") > 0) & (F.col("revenue_status") == "applicable")
        revenue = F.sum(F.when(self.kept, F.col("revenue").cast("decimal(28,4)")))
        out = self.pages.agg(
            F.count_if(self.kept).alias("pages_before_limit"),
            F.count_if(self.mine).alias("cohort_pages"),
            F.count_if(self.kept & F.col("zero_views")).alias("zero_views_pages"),
            F.coalesce(F.sum(F.when(self.kept, F.col("views"))), F.lit(0)).alias("views"),
            half_up(F.coalesce(revenue, F.lit(0)), 4).alias("revenue"),
            F.count_if(F.col("cohort") == "resolved").alias("resolved_pages"),
            F.count_if(F.col("cohort") == "unresolved").alias("unresolved_pages"),
            (F.count_if(base) >= MIN_BENCHMARK).alias("benchmark_computed"),
        )
        n = F.col("pages_before_limit")
        shown = F.least(n, F.lit(limit)) if limit > 0 else n
        return out.withColumn("pages_returned", shown.cast("bigint")).withColumn("truncated", shown < n)


# ---- delivery coverage ----------------------------------------------------------------

ALIGNED = (0.8, 1.2)
EXTREME = (0.5, 1.5)
BLOCKED_REASONS = ["site_disabled", "route_blocked", "member_benefit"]


def delivery_policy_status() -> Column:
    on = F.col("site_enabled") & F.col("serve_ads") & F.col("integration_available")
    blocked = F.coalesce(~F.col("site_enabled"), F.lit(False)) | F.coalesce(
        F.col("reason").isin(BLOCKED_REASONS), F.lit(False)
    )
    return F.when(blocked, "blocked").when(on, "applicable").otherwise("unknown")


def snapshot_windows(snapshots: DataFrame, start: date, end: date) -> DataFrame:
    """Per blog: do the dated snapshots tile the window exactly, one batch per period?

    Works on one row per (blog, period).
    """
    dated = snapshots.filter(
        F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
        & (F.col("period_start") >= F.lit(start)) & (F.col("period_end") <= F.lit(end))
    )
    periods = dated.groupBy("blog_id", "period_start", "period_end").agg(
        F.count_distinct("import_batch").alias("batches")
    )
    order = Window.partitionBy("blog_id").orderBy("period_start", "period_end")
    broken = F.col("period_start") != F.date_add(F.lag("period_end").over(order), 1)
    out = periods.withColumn("_broken", F.coalesce(broken, F.lit(False))).groupBy("blog_id").agg(
        F.count("*").alias("periods"),
        F.max(F.col("batches") > 1).alias("_dup"),
        F.min("period_start").alias("_s"),
        F.max_by("period_end", F.struct("period_start", "period_end")).alias("_e"),
        F.max("_broken").alias("_gap"),
    )
    reason = (
        F.when(F.col("_dup"), "duplicate_batches")
        .when((F.col("_s") != F.lit(start)) | (F.col("_e") != F.lit(end)), "boundary_mismatch")
        .when(F.col("_gap"), "gap_or_overlap")
        .otherwise("")
    )
    return out.select("blog_id", "periods", reason.alias("window_reason"), (reason == "").alias("exact"))


def source_summary(rows: DataFrame) -> DataFrame:
    """Views per blog by policy status and by resolution; ``rows`` carry status and resolved."""
    views = F.greatest(F.col("pageviews"), F.lit(0))
    add = lambda cond: F.coalesce(F.sum(F.when(cond, views)), F.lit(0))
    return rows.groupBy("blog_id").agg(
        F.sum(views).alias("pageviews"),
        F.sum(F.greatest(F.col("sessions"), F.lit(0))).alias("sessions"),
        add(F.col("status") == "applicable").alias("applicable_views"),
        add(F.col("status") == "blocked").alias("blocked_views"),
        add(~F.col("status").isin("applicable", "blocked")).alias("unknown_views"),
        add(F.col("resolved")).alias("resolved_views"),
        add(~F.col("resolved")).alias("unresolved_views"),
        F.count("*").alias("rows"),
    )


def route_views(rows: DataFrame, path_col: str) -> DataFrame:
    return rows.groupBy("blog_id", C.revenue_route(F.col(path_col)).alias("route_family")).agg(
        F.sum(F.greatest(F.col("pageviews"), F.lit(0))).alias("views")
    )


def blog_views(rows: DataFrame, views: str, prefix: str) -> DataFrame:
    return rows.groupBy("blog_id").agg(
        F.sum(F.greatest(F.col(views), F.lit(0))).alias(f"{prefix}_applicable"), F.count("*").alias(f"{prefix}_rows")
    )


def delivery_coverage(ga: DataFrame, snapshots: DataFrame, policy: DataFrame, start: date, end: date) -> DataFrame:
    """Ad-network views over analytics views per site; unknown is never read as zero."""
    sites = policy.withColumn("status", delivery_policy_status())
    inside = snapshots.filter((F.col("period_start") >= F.lit(start)) & (F.col("period_end") <= F.lit(end)))
    windows = snapshot_windows(snapshots, start, end)
    out = (
        sites.join(blog_views(ga, "pageviews", "ga"), "blog_id", "left").join(blog_views(inside, "views", "net"), "blog_id", "left")
        .join(windows, "blog_id", "left")
    )
    # A site has one status, so its views are folded before they meet it.
    for name in ("ga_applicable", "net_applicable"):
        out = out.withColumn(name, F.when(F.col("status") == "applicable", F.col(name)).when(F.col(name).isNotNull(), 0))
    ready = (F.col("status") == "applicable") & F.coalesce("exact", F.lit(False))
    den, num = F.coalesce("ga_applicable", F.lit(0)), F.coalesce("net_applicable", F.lit(0))
    rate = F.when(ready, ratio(num, den, 4))
    out = out.withColumn("coverage_ratio", rate)
    lone = ready & (den == 0) & (num > 0)
    r = F.col("coverage_ratio")
    return out.select(
        "blog_id",
        F.when(F.col("status") == "blocked", "blocked")
        .when(r.between(*ALIGNED), "aligned")
        .when(r.isNotNull() | lone, "warning")
        .otherwise("unknown")
        .alias("status"),
        r,
        half_up(r * 100, 2).alias("coverage_percent"),
        F.coalesce((r < EXTREME[0]) | (r > EXTREME[1]), lone).alias("extreme_divergence"),
        F.when(ready, den).alias("ga_applicable_views"),
        F.when(ready, num).alias("network_applicable_views"),
        F.coalesce("window_reason", F.lit("no_dated_snapshot")).alias("snapshot_reason"),
    )
