"""Revenue rows: scope, content resolution, ad policy and rollups."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls
from ..functions.stats import half_up, ratio

ALL_TIME = "all-time"


def revenue_scope(
    rows: DataFrame,
    blog_id: int,
    import_batch: str = "",
    period_label: str = "",
    period_start: date | None = None,
    period_end: date | None = None,
    restrict_import_batch: bool = False,
) -> DataFrame:
    """Snapshot rows of one blog; the keys are partition columns, so partitions prune."""
    cond = F.col("blog_id") == blog_id
    if import_batch or restrict_import_batch:
        cond = cond & (F.col("import_batch") == import_batch)
    if period_label:
        cond = cond & (F.col("period_label") == period_label)
    if period_start and period_end:
        cond = cond & (F.col("period_start") >= F.lit(period_start)) & (F.col("period_end") <= F.lit(period_end))
    return rows.filter(cond)


def content_dim(posts: DataFrame, terms: DataFrame) -> DataFrame:
    """Published content with its category slugs in term order, and its format."""
    slugs = terms.groupBy("blog_id", "post_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("ord", "slug"))), lambda t: t["slug"]).alias("categories")
    )
    live = posts.filter(F.col("status") == "publish").join(slugs, ["blog_id", "post_id"], "left")
    named = live.withColumn("categories", F.coalesce("categories", F.array(F.lit("uncategorized"))))
    return named.withColumn("format", C.content_format(F.col("url"), F.col("categories"), F.col("title")))


def policy_status(serve_ads: Column) -> Column:
    return F.when(serve_ads, "applicable").when(~serve_ads, "not_applicable").otherwise("unknown")


def normal_policy(policy: DataFrame) -> DataFrame:
    reason = F.coalesce(F.when(F.col("reason") != "", F.col("reason")), F.lit("unknown"))
    return policy.withColumn("reason", reason)


def aggregate_status(status: str = "policy_status") -> Column:
    """The one status present, ``mixed`` for several, ``unknown`` for none."""
    one = F.min(status) == F.max(status)
    return F.coalesce(F.when(one, F.min(status)).otherwise(F.when(F.min(status).isNotNull(), "mixed")), F.lit("unknown"))


RATES = ("rpm", "cpm", "viewability", "fill_rate", "impressions_per_pageview")


def fold_pages(rows: DataFrame) -> DataFrame:
    """Snapshot rows folded to one per page as stored, combined before any shuffle.

    Content, route and policy lookups then run once per page, not once per page and
    period. Sums and counts stand in for the rows.
    """
    positive = F.col("revenue") > 0
    return rows.groupBy("slug", "url", "post_id", "content_blog_id").agg(
        F.count("*").alias("rows"),
        F.sum("views").alias("views"),
        F.sum("revenue").alias("revenue"),
        F.count_if(positive).alias("positive_rows"),
        F.coalesce(F.sum(F.when(positive, F.col("revenue"))), F.lit(0).cast("decimal(28,4)")).alias("positive_revenue"),
        *[F.sum(F.coalesce(r, F.lit(0.0))).alias(f"sum_{r}") for r in RATES],
    )


def _as_folded(rows: DataFrame) -> DataFrame:
    """Single rows with the columns of folded ones."""
    if "positive_rows" in rows.columns:
        return rows
    positive = F.col("revenue") > 0
    return rows.select(
        "*",
        F.lit(1).cast("bigint").alias("rows"),
        positive.cast("bigint").alias("positive_rows"),
        F.when(positive, F.col("revenue")).otherwise(0).alias("positive_revenue"),
        *[F.coalesce(r, F.lit(0.0)).alias(f"sum_{r}") for r in RATES],
    )


def resolve_rows(
    rows: DataFrame, dim: DataFrame, policy: DataFrame, blog_id: int = 1, hostname: str = "", entry_blog: int = 1
) -> DataFrame:
    """Revenue rows, folded or single, with published content, page key, route family and ad policy.

    A stored post that is no longer published stays in, as unresolved.
    """
    content_blog = F.coalesce(F.when(F.col("content_blog_id") > 0, F.col("content_blog_id")), F.lit(blog_id))
    source_url = F.coalesce(F.when(F.col("url") != "", F.col("url")), F.col("slug"))
    rows = _as_folded(rows)
    keyed = rows.withColumn("stored_post_id", F.col("post_id")).withColumn("content_blog_id", content_blog)
    keyed = keyed.withColumn("source_url", source_url).drop("post_id", "url")
    spread = ("slug", "source_url", "period_label", "import_batch")
    # Rows without a post probe with a key of their own instead of piling up under NULL.
    probe = F.when(F.col("stored_post_id") > 0, F.col("stored_post_id")).otherwise(
        -1 - F.pmod(F.xxhash64(*[c for c in spread if c in rows.columns]), F.lit(1 << 40))
    )
    right = dim.select(
        F.col("blog_id").alias("content_blog_id"), F.col("post_id").alias("_probe"),
        "post_type", "format", "categories", "title", F.col("url").alias("content_url"), "published_at",
        F.lit(True).alias("_hit"),
    )
    out = keyed.withColumn("_probe", probe).join(right, ["content_blog_id", "_probe"], "left").drop("_probe")
    is_content = F.coalesce("_hit", F.lit(False))
    out = out.withColumn("is_content", is_content).drop("_hit")
    page = F.when(
        F.col("is_content"),
        F.concat(F.lit("p"), F.col("content_blog_id").cast("string"), F.lit(":"), F.col("stored_post_id").cast("string")),
    ).otherwise(F.concat(F.lit("u"), F.md5("slug")))
    out = out.withColumn("page_key", page).withColumn(
        "page_url", F.when(F.col("is_content"), F.col("content_url")).otherwise(F.col("source_url"))
    )
    if hostname:
        out = host_scope(out, hostname)
    out = out.join(normal_policy(policy).select(F.col("blog_id").alias("content_blog_id"), "serve_ads", "reason"),
                   "content_blog_id", "left")
    return out.select(
        "*",
        F.when(~F.col("is_content"), C.revenue_route(F.col("source_url"))).alias("route_family"),
        (F.col("is_content") & C.format_eligible(F.col("content_blog_id"), F.col("post_type"), entry_blog)).alias(
            "editorial"
        ),
        policy_status(F.col("serve_ads")).alias("policy_status"),
        F.when(~F.col("serve_ads"), F.col("positive_rows")).otherwise(0).alias("conflict_rows"),
    ).withColumn("policy_conflict", F.col("conflict_rows") > 0)


def host_scope(resolved: DataFrame, hostname: str) -> DataFrame:
    """Resolved rows by their canonical host, unresolved ones only by an absolute source URL."""
    wanted = urls.normal_hostname(F.lit(hostname))
    return resolved.filter((wanted != "") & (urls.url_hostname(F.col("page_url")) == wanted))


def cohort() -> Column:
    return F.when(~F.col("is_content"), "unresolved").when(F.col("editorial"), "content").otherwise("non_editorial")


def per_thousand(revenue: Column, views: Column, places: int) -> Column:
    value = revenue.cast("double") / (F.when(views > 0, views.cast("double")) / 1000.0)
    return F.coalesce(half_up(value, places), F.lit(0.0))


def rollup(rows: DataFrame, *keys: Column) -> DataFrame:
    """Pages, views, revenue and rates per bucket; a page counts once however many rows it has."""
    folded = rows.groupBy(*keys).agg(
        F.count_distinct("page_key").alias("pages"),
        F.coalesce(F.sum("views"), F.lit(0)).alias("views"),
        F.coalesce(F.sum("revenue"), F.lit(0).cast("decimal(28,4)")).alias("_rev"),
        aggregate_status().alias("revenue_status"),
        F.sum("conflict_rows").alias("policy_conflicts"),
    )
    names = [c for c in folded.columns if c not in ("pages", "views", "_rev", "revenue_status", "policy_conflicts")]
    return folded.select(
        *names,
        "pages",
        "views",
        half_up(F.col("_rev"), 2).alias("revenue"),
        per_thousand(F.col("_rev"), F.col("views"), 2).alias("rpm"),
        ratio(F.col("_rev"), F.col("pages"), 2, 0.0).alias("dollars_per_page"),
        "revenue_status",
        "policy_conflicts",
    )


def page_identity() -> Column:
    return F.when(F.col("post_id") > 0, F.concat(F.lit("p"), F.col("post_id").cast("string"))).otherwise(
        F.concat(F.lit("u"), F.col("slug"))
    )


def scope_totals(rows: DataFrame) -> DataFrame:
    return rows.agg(F.count("*").alias("rows"), F.sum("views").alias("views"), half_up(F.sum("revenue"), 4).alias("revenue"))


def batches(rows: DataFrame) -> DataFrame:
    """Snapshot list: one row per period and batch."""
    return rows.groupBy("period_label", "import_batch").agg(
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        F.count("*").alias("rows"),
        F.sum("views").alias("views"),
        half_up(F.sum("revenue"), 4).alias("revenue"),
    )


def default_scope(listed: DataFrame) -> DataFrame:
    """Freshest dated (period, batch), else the all-time bucket; ties by batch then label."""
    dated = (F.col("period_label") != ALL_TIME) & F.col("period_end").isNotNull()
    usable = listed.filter(dated | (F.col("period_label") == ALL_TIME))
    order = [F.desc_nulls_last(F.when(dated, F.col("period_end"))), F.asc("import_batch"), F.asc("period_label")]
    return usable.orderBy(*order).limit(1).select("period_label", "import_batch", "period_end")


def in_default_scope(rows: DataFrame) -> DataFrame:
    return rows.join(default_scope(batches(rows)).select("period_label", "import_batch"),
                     ["period_label", "import_batch"], "left_semi")


def timeseries(rows: DataFrame, include_alltime: bool = False) -> DataFrame:
    """Revenue per period in order, all-time last, with the change from the point before.

    The window runs over one row per period.
    """
    rows = rows if include_alltime else rows.filter(F.col("period_label") != ALL_TIME)
    points = rows.groupBy("period_label").agg(
        F.min("period_start").alias("period_start"),
        F.max("period_end").alias("period_end"),
        F.count_distinct(page_identity()).alias("pages"),
        F.sum("views").alias("views"),
        F.sum("revenue").alias("_rev"),
    )
    order = Window.orderBy((F.col("period_label") == ALL_TIME).cast("int"), F.asc_nulls_first("period_start"), "period_label")
    prev = F.lag("_rev").over(order)
    change = F.col("_rev").cast("double") - F.col("_prev").cast("double")
    return points.withColumn("_prev", prev).withColumn("_at", F.row_number().over(order)).select(
        F.col("_at").alias("position"),
        F.col("period_label").alias("period"),
        "period_start",
        "period_end",
        "pages",
        "views",
        half_up(F.col("_rev"), 2).alias("revenue"),
        per_thousand(F.col("_rev"), F.col("views"), 2).alias("rpm"),
        ratio(F.col("_rev"), F.col("pages"), 2, 0.0).alias("dollars_per_page"),
        half_up(change, 2).alias("mom_delta"),
        F.when(F.col("_prev") > 0, half_up(change / F.col("_prev").cast("double") * 100, 1)).alias("mom_pct"),
    )


def peak(series: DataFrame) -> DataFrame:
    """First period with the highest revenue."""
    return series.agg(
        F.min_by(F.struct("period", "revenue"), F.struct((-F.col("revenue")).alias("r"), F.col("position"))).alias("p")
    ).select("p.period", "p.revenue")


def aggregate_metrics(rows: DataFrame, *keys: str, **more: Column) -> DataFrame:
    """Folds duplicate input rows: rates weigh by inferred impressions, else views, else equally.

    ``more`` are further aggregates by name, taken in the same pass.
    """
    views = F.greatest(F.coalesce("views", F.lit(0)), F.lit(0))
    per_view = F.greatest(F.coalesce("impressions_per_pageview", F.lit(0.0)), F.lit(0.0))
    weight = views * per_view
    total_views, total_weight = F.sum(views), F.sum(weight)
    rev = F.sum(F.coalesce("revenue", F.lit(0)))

    def weighted(metric: str) -> Column:
        value = F.coalesce(metric, F.lit(0.0))
        return (
            F.when(total_weight > 0, F.sum(value * weight) / total_weight)
            .when(total_views > 0, F.sum(value * views) / total_views)
            .otherwise(F.avg(value))
        )

    return rows.groupBy(*keys).agg(
        total_views.alias("views"),
        rev.cast("decimal(18,4)").alias("revenue"),
        F.when(total_views > 0, rev.cast("double") / total_views * 1000).otherwise(0.0).alias("rpm"),
        F.when(total_views > 0, total_weight / total_views).otherwise(0.0).alias("impressions_per_pageview"),
        *[weighted(m).alias(m) for m in ("cpm", "viewability", "fill_rate")],
        *[c.alias(n) for n, c in more.items()],
    )
