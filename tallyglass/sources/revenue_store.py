"""Revenue snapshots: CSV scan, identity, ingestion plan and atomic partition write."""

from __future__ import annotations

import re
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import urls
from ..operators.revenue import aggregate_metrics
from .folders import folder_exists

# CSV headers, lower-cased and stripped to letters and digits, and the field each names.
HEADERS = {
    "slug": "slug", "url": "slug", "page": "slug", "pagepath": "slug", "path": "slug",
    "views": "views", "pageviews": "views", "sessions": "views",
    "revenue": "revenue", "earnings": "revenue", "estimatedrevenue": "revenue",
    "rpm": "rpm", "pagerpm": "rpm", "cpm": "cpm", "viewability": "viewability", "fillrate": "fill_rate",
    "impressionsperpageview": "impressions_per_pageview", "impressionsperpv": "impressions_per_pageview",
}
RATES = ["rpm", "cpm", "viewability", "fill_rate", "impressions_per_pageview"]
SNAPSHOT = r"^[a-z0-9][a-z0-9_-]{0,63}$"
KEYS = ["blog_id", "period_label", "import_batch"]
PREFIX = 51


def period_range(period: Column) -> tuple[Column, Column, Column]:
    """(label, first day, last day) of YYYY-MM, YYYY or free-form period tokens."""
    token = F.trim(F.coalesce(period, F.lit("")))
    month, year = token.rlike(r"^\d{4}-\d{2}$"), token.rlike(r"^\d{4}$")
    first = F.concat(token, F.when(month, "-01").otherwise("-01-01")).try_cast("date")
    start = F.when(month | year, first)
    end = F.when(month, F.last_day(first)).when(year, F.concat(token, F.lit("-12-31")).try_cast("date"))
    return F.when(token == "", "all-time").otherwise(token), start, end


def sanitize_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"[^a-z0-9_\-]", "")


def snapshot_identity(source: Column, site: Column, blog_id: Column, period: Column) -> Column:
    """Readable prefix plus a fingerprint of the exact inputs, the same on every run."""
    source, site = F.lower(F.trim(source)), F.lower(F.trim(site))
    label, start, end = period_range(period)
    day = lambda d: F.coalesce(d.cast("string"), F.lit(""))
    print_of = F.concat_ws("\0", source, site, blog_id.cast("string"), label, day(start), day(end))
    named = lambda text, default: F.coalesce(
        F.when(sanitize_key(text) != "", sanitize_key(text)), F.lit(default)
    )
    parts = F.concat_ws(
        "-", named(source, "source"), named(site, "site"),
        F.when(blog_id > 0, F.concat(F.lit("b"), blog_id.cast("string"))), sanitize_key(label),
    )
    prefix = F.regexp_replace(F.substring(F.regexp_replace(parts, r"^-+|-+$", ""), 1, PREFIX), r"^-+|-+$", "")
    return F.concat(prefix, F.lit("-"), F.substring(F.sha2(print_of, 256), 1, 12))


def read_revenue_csv(spark: SparkSession, path: str, period: str, blog_id: int) -> DataFrame:
    """Rows of a loosely headed CSV; columns are named on the driver, values cleaned in Spark."""
    raw = spark.read.option("header", True).csv(path)
    found: dict[str, Column] = {}
    for header in raw.columns:
        field = HEADERS.get(re.sub(r"[^a-z0-9]", "", header.lower()))
        if field and field not in found:
            found[field] = F.col(f"`{header}`")
    if "slug" not in found:
        raise ValueError("the file has no column that names the page")
    number = lambda f: urls.clean_number(found[f]) if f in found else F.lit(0.0)
    label, start, end = period_range(F.lit(period))
    return raw.select(
        F.lit(blog_id).alias("blog_id"),
        F.trim(found["slug"]).alias("slug"),
        number("views").cast("bigint").alias("views"),
        number("revenue").cast("decimal(12,4)").alias("revenue"),
        *[number(f).alias(f) for f in RATES],
        label.alias("period_label"), start.alias("period_start"), end.alias("period_end"),
    ).filter(F.coalesce(F.col("slug"), F.lit("")) != "")


def normalize_revenue(rows: DataFrame, *by: str) -> DataFrame:
    """One row per slug, within each value of ``by``: pages named by slug or URL, duplicates folded to their lowest positive post_id.

    A name without a slug is dropped, but for the path of the home page, and so is a row without a value of ``by``.
    """
    named = F.coalesce(F.when(F.trim("slug") != "", F.col("slug")), F.col("url"))
    raw = rows.withColumn("_raw", named).dropna(subset=[*by])
    slug, home = urls.slug_key(F.col("_raw")), urls.frontend_path(F.col("_raw")) == "/"
    # Names to drop fold under a NULL slug, not by a filter, which Catalyst would evaluate below an aggregate that made the rows.
    keyed = raw.withColumn("slug", F.when(slug != "", slug).when(home, ""))
    lowest = F.coalesce(F.min(F.when(F.col("post_id") > 0, F.col("post_id"))), F.max("post_id"))
    shown = F.min(F.coalesce(urls.frontend_path(F.col("_raw")), F.trim("_raw")))
    folded = aggregate_metrics(keyed, *by, "slug", post_id=lowest, page_url=shown, _named=F.count("slug"))
    return folded.filter(F.col("_named") > 0).drop("_named")


def resolve_paths(rows: DataFrame, content: DataFrame) -> DataFrame:
    """Each path with the content it names: one match resolves, none or several do not."""
    owners = content.filter(F.col("status") == "publish").groupBy(
        urls.frontend_path(F.regexp_replace("url", r"^[a-z]+://[^/]+", "")).alias("path")
    ).agg(F.count("*").alias("matches"), F.min("post_id").alias("post_id"), F.min("blog_id").alias("content_blog_id"))
    out = rows.select("path").distinct().join(owners, "path", "left")
    n = F.coalesce("matches", F.lit(0))
    only = lambda col: F.when(n == 1, F.col(col)).alias(col)
    status = F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("missing")
    return out.select("path", n.alias("matches"), only("post_id"), only("content_blog_id"), status.alias("status"))


def require_complete(paths: DataFrame, resolved: DataFrame) -> None:
    """Stops an ingest unless every path came back exactly once."""
    back = resolved.groupBy("path").agg(F.count("*").alias("n"))
    wrong = paths.select("path").distinct().join(back, "path", "left").filter(F.coalesce("n", F.lit(0)) != 1)
    if not wrong.isEmpty():
        raise ValueError("path resolution is incomplete; nothing was written")


def ingestion_plan(incoming: DataFrame, existing: DataFrame, mode: str = "replace", by: tuple[str, ...] = ()) -> DataFrame:
    """insert / replace / delete per slug, within each value of ``by``; additive runs never delete."""
    keys = [*by, "slug"]
    new = incoming.select(*keys, F.lit(True).alias("_new"))
    old = existing.select(*keys, F.lit(True).alias("_old")).distinct()
    both = new.join(old, keys, "full_outer" if mode == "replace" else "left")
    action = F.when(F.col("_new").isNull(), "delete").when(F.col("_old").isNull(), "insert").otherwise("replace")
    return both.select(*keys, action.alias("action"))


def plan_counts(plan: DataFrame, *by: str) -> DataFrame:
    counts = [F.count_if(F.col("action") == a).alias(f"{a}s") for a in ("insert", "replace", "delete")]
    return plan.groupBy(*by).agg(*counts) if by else plan.agg(*counts)


def ingest_revenue(
    rows: DataFrame,
    target: str,
    staging: str,
    blog_id: int,
    period: str,
    source: str,
    site: str,
    mode: str = "replace",
    snapshot: str | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Writes one snapshot partition and returns the plan's counts.

    Replace makes the partition equal to ``rows``; additive keeps what it does not
    touch and needs a label of its own. The new partition is staged in full and then
    swapped in, so a failed run leaves the old one.
    """
    spark = rows.sparkSession
    if mode not in ("replace", "additive"):
        raise ValueError("mode is replace or additive")
    incoming = normalize_revenue(rows)
    if incoming.isEmpty():
        raise ValueError("an empty snapshot is refused")
    label, start, end = period_range(F.lit(period))
    identity = snapshot_identity(F.lit(source), F.lit(site), F.lit(blog_id), F.lit(period))
    own = spark.range(1).select(identity.alias("i"), label.alias("l")).first()
    batch = own["i"]
    if mode == "additive":
        if not snapshot or not re.match(SNAPSHOT, snapshot):
            raise ValueError("additive ingestion needs an explicit snapshot label")
        if snapshot == batch:
            raise ValueError("an additive snapshot must differ from the replace identity")
        batch = snapshot
    full = incoming.select(
        "slug", "post_id", "views", "revenue", *RATES, start.alias("period_start"), end.alias("period_end"),
        F.lit(blog_id).alias("blog_id"), F.lit(own["l"]).alias("period_label"), F.lit(batch).alias("import_batch"),
    )
    existing = stored_snapshot(spark, target, full, blog_id, own["l"], batch)
    counts = plan_counts(ingestion_plan(full, existing, mode))
    if dry_run:
        return counts
    result = spark.createDataFrame(counts.collect(), counts.schema)  # one row, read before the swap
    kept = full if mode == "replace" else full.unionByName(existing.join(full.select("slug"), "slug", "left_anti"))
    kept.write.mode("overwrite").partitionBy(*KEYS).parquet(staging)
    staged = spark.read.schema(full.schema).parquet(staging)
    staged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(target)
    return result


def stored_snapshot(spark: SparkSession, target: str, like: DataFrame, blog_id: int, label: str, batch: str) -> DataFrame:
    """Rows of one stored partition, or none where the table does not exist yet."""
    if not folder_exists(spark, target):
        return like.limit(0)
    rows = spark.read.schema(like.schema).parquet(target)
    return rows.filter(
        (F.col("blog_id") == blog_id) & (F.col("period_label") == label) & (F.col("import_batch") == batch)
    )


PERIOD_SCHEMA = (
    "slug string, post_id bigint, views bigint, revenue decimal(18,4), rpm double, cpm double, viewability double, "
    "fill_rate double, impressions_per_pageview double, url string, content_blog_id int, canonical_url string, "
    "imported_at timestamp, period_start date, period_end date, blog_id int, period_label string, import_batch string"
)


def staged(rows: DataFrame, path: str) -> DataFrame:
    """The rows, written once and read back."""
    rows.write.mode("overwrite").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def with_content(rows: DataFrame, content: DataFrame, blog_id: int, staging: str) -> DataFrame:
    """Adds ``content_blog_id`` and ``canonical_url``, and the post of rows that name none.

    A post that a row names itself belongs to the snapshot's blog. The paths of the others are
    resolved once each, into a folder under ``staging``; the home page stays without a post. An answer that
    misses a path, or gives it twice, stops the ingest before the store is opened. Rows that ask for nothing
    probe with a key of their own, so that they do not meet under NULL in one task.
    """
    pages = content.filter(F.col("status") == "publish").select(
        F.col("post_id").alias("_post"), F.col("blog_id").cast("int").alias("_blog"), F.col("url").alias("_link")
    )
    path = F.when((F.coalesce("post_id", F.lit(0)) <= 0) & (F.col("slug") != ""), urls.frontend_path(F.concat(F.lit("/"), F.col("slug"))))
    asked = rows.withColumn("path", F.coalesce(path, F.concat(F.lit("#"), F.col("slug"))))
    paths = staged(asked.filter(F.col("path").startswith("/")).select("path").distinct(), f"{staging}/paths")
    answers = staged(resolve_paths(paths, content), f"{staging}/answers")
    require_complete(paths, answers)
    found = answers.filter(F.col("status") == "resolved").select(
        "path", F.col("post_id").alias("_found"), F.col("content_blog_id").cast("int").alias("_found_blog")
    )
    out = asked.join(found, "path", "left")
    own = F.coalesce("post_id", F.lit(0)) > 0
    out = out.withColumns({
        "content_blog_id": F.when(own, F.lit(blog_id)).otherwise(F.col("_found_blog")),
        "post_id": F.when(own, F.col("post_id")).otherwise(F.coalesce("_found", "post_id")),
    })
    named = pages.groupBy("_post", "_blog").agg(F.min("_link").alias("canonical_url"))
    known = F.col("post_id").isNotNull() & F.col("content_blog_id").isNotNull()
    out = out.withColumns({
        "_key": F.when(known, F.col("post_id")).otherwise(F.xxhash64("slug")), "_own": F.when(known, F.col("content_blog_id")),
    })
    out = out.join(named, (F.col("_key") == F.col("_post")) & (F.col("_own") == F.col("_blog")), "left")
    return out.withColumnRenamed("page_url", "url").drop("path", "_found", "_found_blog", "_key", "_own", "_post", "_blog")


def by_period(rows: DataFrame) -> DataFrame:
    """Rows of a period side by side, so that each writes few files; a large period is split over tasks."""
    return rows.hint("rebalance", "period_label")


def ingest_periods(
    rows: DataFrame,
    content: DataFrame,
    target: str,
    staging: str,
    blog_id: int,
    source: str,
    site: str,
    imported_at: datetime,
    period: str = "period",
    mode: str = "replace",
    snapshot: str | None = None,
    dry_run: bool = False,
) -> DataFrame:
    """Writes the snapshots of all periods in ``rows`` at once; returns inserts, replaces and deletes per ``period_label``.

    The column ``period`` holds the period of each row. Every period is a partition with the identity
    :func:`ingest_revenue` would give it, and follows the same rules for replace and additive runs; periods that
    ``rows`` does not hold stay as they are. Names, posts and canonical addresses are resolved inside, before the
    store is opened. Plan and stored rows come from one staged table, which is then swapped in by partition.
    """
    spark = rows.sparkSession
    if mode not in ("replace", "additive"):
        raise ValueError("mode is replace or additive")
    if mode == "additive" and (not snapshot or not re.match(SNAPSHOT, snapshot)):
        raise ValueError("additive ingestion needs an explicit snapshot label")
    dated = rows.withColumn("period_label", period_range(F.col(period))[0]).drop("period_start", "period_end", "import_batch", "blog_id")
    named = staged(normalize_revenue(dated, "period_label"), f"{staging}/named")
    _, start, end = period_range(F.col("period_label"))
    identity = snapshot_identity(F.lit(source), F.lit(site), F.lit(blog_id), F.col("period_label"))
    if mode == "additive" and not named.select("period_label").distinct().filter(identity == snapshot).isEmpty():
        raise ValueError("an additive snapshot must differ from the replace identity")
    batch = identity if mode == "replace" else F.lit(snapshot)
    schema = spark.createDataFrame([], PERIOD_SCHEMA).schema
    full = with_content(named, content, blog_id, staging).withColumns(
        {"blog_id": F.lit(blog_id), "import_batch": batch, "imported_at": F.lit(imported_at), "period_start": start, "period_end": end}
    )
    full.select(*[F.col(f.name).cast(f.dataType) for f in schema]).write.mode("overwrite").parquet(f"{staging}/incoming")
    incoming = spark.read.schema(schema).parquet(f"{staging}/incoming")
    if incoming.isEmpty():
        raise ValueError("an empty snapshot is refused")
    scope = ["period_label", "import_batch"]
    periods = incoming.select(*scope).distinct()
    old = spark.read.schema(schema).parquet(target) if folder_exists(spark, target) else incoming.limit(0)
    existing = old.filter(F.col("blog_id") == blog_id).join(F.broadcast(periods), scope, "left_semi")  # one row for each period
    counts = plan_counts(ingestion_plan(incoming, existing, mode, ("period_label",)), "period_label")
    if dry_run:
        return counts
    counts.write.mode("overwrite").parquet(f"{staging}/counts")  # before the swap changes what is there
    final = incoming
    if mode == "additive":
        kept = existing.join(incoming.select("period_label", "slug"), ["period_label", "slug"], "left_anti")
        incoming.unionByName(kept.select(*incoming.columns)).write.mode("overwrite").parquet(f"{staging}/final")
        final = spark.read.schema(schema).parquet(f"{staging}/final")
    by_period(final).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*KEYS).parquet(target)
    return spark.read.schema(counts.schema).parquet(f"{staging}/counts")
