"""Revenue rollups, pages, series and delivery coverage."""

from datetime import date

from pyspark.sql import functions as F

from ..functions import classify as C
from ..operators import revenue as R
from ..operators.quantiles import exact_median
from ..plans import revenue as PR
from ..sources import bind as B
from . import query
from . import rules_sql as S

DIM = f"""SELECT c.*, {S.content_format("url", "cats", "title")} AS format FROM (SELECT p.*, coalesce(t.cats, ['uncategorized']) AS cats FROM content p
 LEFT JOIN (SELECT blog_id, post_id, list(slug ORDER BY ord) AS cats FROM terms GROUP BY 1, 2) t ON t.blog_id = p.blog_id AND t.post_id = p.post_id
 WHERE status = 'publish') c"""
RES0 = """SELECT r.*, coalesce(r.content_blog_id, 1) AS cb, coalesce(nullif(r.url, ''), r.slug) AS source_url, d.post_id IS NOT NULL AS is_content,
 d.post_type AS ptype, d.format, d.cats, d.title, d.url AS content_url, d.published_at FROM revenue r
 LEFT JOIN d ON d.blog_id = coalesce(r.content_blog_id, 1) AND d.post_id = r.post_id"""
RES = f"""SELECT x.*, p.serve_ads, CASE WHEN is_content THEN concat('p', CAST(cb AS STRING), ':', CAST(x.post_id AS STRING)) ELSE concat('u', md5(slug)) END AS page_key,
 CASE WHEN is_content THEN content_url ELSE source_url END AS page_url, CASE WHEN NOT is_content THEN {S.revenue_route("source_url")} END AS route_family,
 is_content AND cb = 1 AND ptype = 'post' AS editorial, CASE WHEN serve_ads THEN 'applicable' WHEN NOT serve_ads THEN 'not_applicable' ELSE 'unknown' END AS st,
 coalesce(NOT serve_ads AND revenue > 0, false) AS conflict FROM res0 x LEFT JOIN policy p ON p.blog_id = x.cb"""
RV = {"d": DIM, "res0": RES0, "res": RES}
T4 = ("content", "terms", "revenue", "policy")
RPM2 = "CASE WHEN sum(views) > 0 THEN " + B.sql_round("CAST(sum(revenue) AS DOUBLE) / (CAST(sum(views) AS DOUBLE) / 1000.0)", 2) + " ELSE 0.0 END"
ROLL = f"""count(DISTINCT page_key) AS pages, CAST(sum(views) AS BIGINT) AS views, {B.sql_round("sum(revenue)", 2)} AS revenue, {RPM2} AS rpm,
 {B.sql_ratio("sum(revenue)", "count(DISTINCT page_key)", 2, "0.0")} AS dollars_per_page,
 CASE WHEN min(st) = max(st) THEN min(st) ELSE 'mixed' END AS revenue_status, count(*) FILTER (conflict) AS policy_conflicts"""


def resolved(spark, sf, fold=True, **kw):
    dim = R.content_dim(B.content(spark, sf), B.content_terms(spark, sf))
    rows = B.revenue(spark, sf)
    return R.resolve_rows(R.fold_pages(rows) if fold else rows, dim, B.policy(spark, sf), **kw)


def _bucket(key: str, where: str, name: str = "bucket") -> str:
    return B.duck(f"SELECT {key} AS {name}, {ROLL} FROM res WHERE {where} GROUP BY 1", *T4, **RV)


FORMATS = _bucket("format", "editorial")


@query("r28_content_revenue__by_format", FORMATS)
def _(spark, sf):
    return PR.rollup_by_format(resolved(spark, sf))


@query("a18_rollup_bucket", FORMATS)
def _(spark, sf):
    return PR.rollup_by_format(resolved(spark, sf))


@query(
    "r28_content_revenue__by_category",
    B.duck(f"SELECT cat AS bucket, {ROLL} FROM (SELECT *, unnest(cats) AS cat FROM res WHERE editorial) GROUP BY 1", *T4, **RV),
)
def _(spark, sf):
    return PR.rollup_by_category(resolved(spark, sf))


COHORTS = _bucket("CASE WHEN NOT is_content THEN 'unresolved' WHEN editorial THEN 'content' ELSE 'non_editorial' END", "true", "cohort")


@query("r28_content_revenue__totals", COHORTS)
def _(spark, sf):
    return PR.cohort_totals(resolved(spark, sf))


@query("u03_disjoint_cohorts", COHORTS)
def _(spark, sf):
    return PR.cohort_totals(resolved(spark, sf))


@query(
    "r28_content_revenue__unresolved",
    B.duck(f"SELECT * EXCLUDE (dollars_per_page) FROM (SELECT route_family, {ROLL} FROM res WHERE NOT is_content GROUP BY 1)", *T4, **RV),
)
def _(spark, sf):
    return PR.unresolved_by_route(resolved(spark, sf))


@query(
    "r28_content_revenue__non_editorial",
    _bucket("concat('blog-', CAST(cb AS STRING), ':', ptype)", "is_content AND NOT editorial"),
)
def _(spark, sf):
    return PR.non_editorial_by_type(resolved(spark, sf))


@query(
    "j12_revenue_content_policy_join",
    B.duck("""SELECT slug, period_label, import_batch, is_content, page_key, format, route_family, editorial, st AS policy_status, conflict AS policy_conflict
    FROM res""", *T4, **RV),
)
def _(spark, sf):
    return resolved(spark, sf, fold=False).select(
        "slug", "period_label", "import_batch", "is_content", "page_key", "format", "route_family", "editorial",
        "policy_status", "policy_conflict",
    )


@query(
    "f11_host_scope",
    B.duck(r"""SELECT slug, period_label, import_batch, page_key FROM res WHERE regexp_matches(page_url, '^(https?:)?//')
    AND regexp_replace(lower(regexp_extract(page_url, '^[a-z]*:?//([^/?#:]*)', 1)), '^www\.', '') = 'site2.example.com'""", *T4, **RV),
)
def _(spark, sf):
    rows = resolved(spark, sf, fold=False, hostname="https://WWW.Site2.example.com/")
    return rows.select("slug", "period_label", "import_batch", "page_key")


@query(
    "e22_policy_status",
    B.duck("""SELECT cb AS content_blog_id, CASE WHEN min(st) = max(st) THEN min(st) ELSE 'mixed' END AS status, count(*) FILTER (conflict) AS conflicts
    FROM res GROUP BY 1 UNION ALL SELECT 0, CASE WHEN min(st) = max(st) THEN min(st) ELSE 'mixed' END, count(*) FILTER (conflict) FROM res""", *T4, **RV),
)
def _(spark, sf):
    rows = resolved(spark, sf)
    cols = [R.aggregate_status().alias("status"), F.sum("conflict_rows").alias("conflicts")]
    per = rows.groupBy("content_blog_id").agg(*cols)
    return per.unionByName(rows.agg(*cols).withColumn("content_blog_id", F.lit(0)))


@query(
    "e11_revenue_route",
    B.duck(f"SELECT slug, {S.revenue_route('slug')} AS route_family FROM (SELECT DISTINCT slug FROM revenue)", "revenue"),
)
def _(spark, sf):
    slugs = B.revenue(spark, sf).select("slug").distinct()
    return slugs.withColumn("route_family", C.revenue_route(F.col("slug")))


DIM_SQL = B.duck("SELECT blog_id, post_id, format, array_to_string(cats, ',') AS categories FROM d", "content", "terms", d=DIM)


@query("io19_content_dimension", DIM_SQL)
def _(spark, sf):
    dim = R.content_dim(B.content(spark, sf), B.content_terms(spark, sf))
    return dim.select("blog_id", "post_id", "format", F.array_join("categories", ",").alias("categories"))


@query("e14_content_format", DIM_SQL)
def _(spark, sf):
    dim = R.content_dim(B.content(spark, sf), B.content_terms(spark, sf))
    return dim.select("blog_id", "post_id", "format", F.array_join("categories", ",").alias("categories"))


# ---- scope and series -----------------------------------------------------------------

REVCOLS = "blog_id, slug, period_label, import_batch, views, revenue"


@query(
    "io04_revenue_scope",
    B.duck(f"""SELECT {REVCOLS} FROM revenue WHERE blog_id = 1 AND import_batch = 'r-1997' AND period_start >= DATE '1997-03-01'
    AND period_end <= DATE '1997-08-31'""", "revenue"),
)
def _(spark, sf):
    scope = R.revenue_scope(
        B.revenue(spark, sf), 1, "r-1997", period_start=date(1997, 3, 1), period_end=date(1997, 8, 31)
    )
    return scope.select(*REVCOLS.split(", "))


@query(
    "a14_scope_totals",
    B.duck(f"SELECT count(*) AS rows, CAST(sum(views) AS BIGINT) AS views, {B.sql_round('sum(revenue)', 4)} AS revenue FROM revenue", "revenue"),
)
def _(spark, sf):
    return R.scope_totals(B.revenue(spark, sf))


BATCHES = f"""SELECT period_label, import_batch, min(period_start) AS period_start, max(period_end) AS period_end, count(*) AS rows,
 CAST(sum(views) AS BIGINT) AS views, {B.sql_round("sum(revenue)", 4)} AS revenue FROM revenue GROUP BY 1, 2"""


@query("a14_scope_totals__batches", B.duck(BATCHES, "revenue"))
def _(spark, sf):
    return R.batches(B.revenue(spark, sf))


SCOPE = """SELECT period_label, import_batch, period_end FROM b ORDER BY CASE WHEN period_label <> 'all-time' THEN period_end END DESC NULLS LAST,
 import_batch, period_label LIMIT 1"""


@query("t08_default_scope", B.duck(SCOPE, "revenue", b=BATCHES))
def _(spark, sf):
    return R.default_scope(R.batches(B.revenue(spark, sf)))


PAGEID = "CASE WHEN post_id > 0 THEN concat('p', CAST(post_id AS STRING)) ELSE concat('u', slug) END"
SERIES = f"""SELECT row_number() OVER o AS position, period_label AS period, period_start, period_end, pages, views, {B.sql_round("rev", 2)} AS revenue,
 CASE WHEN views > 0 THEN {B.sql_round("CAST(rev AS DOUBLE) / (CAST(views AS DOUBLE) / 1000.0)", 2)} ELSE 0.0 END AS rpm,
 {B.sql_ratio("rev", "pages", 2, "0.0")} AS dollars_per_page, {B.sql_round("CAST(rev AS DOUBLE) - CAST(lag(rev) OVER o AS DOUBLE)", 2)} AS mom_delta,
 CASE WHEN lag(rev) OVER o > 0 THEN {B.sql_round("(CAST(rev AS DOUBLE) - CAST(lag(rev) OVER o AS DOUBLE)) / CAST(lag(rev) OVER o AS DOUBLE) * 100", 1)} END AS mom_pct
 FROM (SELECT period_label, min(period_start) AS period_start, max(period_end) AS period_end, count(DISTINCT {PAGEID}) AS pages,
  CAST(sum(views) AS BIGINT) AS views, sum(revenue) AS rev FROM revenue GROUP BY 1) WINDOW o AS (ORDER BY (period_label = 'all-time')::INT, period_start NULLS FIRST, period_label)"""


@query("r29_revenue_timeseries", B.duck(SERIES, "revenue"))
def _(spark, sf):
    return R.timeseries(B.revenue(spark, sf), include_alltime=True)


@query("w13_period_series", B.duck(SERIES.replace("FROM revenue GROUP", "FROM revenue WHERE period_label <> 'all-time' GROUP"), "revenue"))
def _(spark, sf):
    return R.timeseries(B.revenue(spark, sf))


@query(
    "r29_revenue_timeseries__peak",
    B.duck("SELECT period, revenue FROM s ORDER BY revenue DESC, position LIMIT 1", "revenue", s=SERIES),
)
def _(spark, sf):
    return R.peak(R.timeseries(B.revenue(spark, sf), include_alltime=True))


@query(
    "a13_distinct_page_key",
    B.duck(f"SELECT period_label, count(DISTINCT {PAGEID}) AS pages FROM revenue GROUP BY 1", "revenue"),
)
def _(spark, sf):
    return B.revenue(spark, sf).groupBy("period_label").agg(F.count_distinct(R.page_identity()).alias("pages"))


# ---- pages ----------------------------------------------------------------------------

_AVG = ", ".join(f"{B.sql_round(f'avg(coalesce({src}, 0.0))', 4)} AS {name}" for name, src in PR.RATES.items())
PAGES = f"""SELECT page_key, CASE WHEN is_content THEN 'resolved' ELSE 'unresolved' END AS cohort, max(CASE WHEN is_content THEN post_id ELSE 0 END) AS post_id,
 max(CASE WHEN is_content THEN cb ELSE 0 END) AS content_blog_id, max(CASE WHEN is_content THEN title ELSE '' END) AS title, max(page_url) AS url,
 max(CASE WHEN is_content THEN regexp_extract(content_url, '{S.SPLIT}', 3) ELSE '' END) AS path, max(CASE WHEN is_content THEN array_to_string(cats, ',') ELSE '' END) AS categories,
 max(CASE WHEN is_content THEN format ELSE '' END) AS format, max(coalesce(route_family, '')) AS route_family, max(CAST(published_at AS DATE)) AS published_date,
 CAST(sum(views) AS BIGINT) AS views, {B.sql_round("sum(revenue)", 4)} AS revenue,
 CASE WHEN sum(views) > 0 THEN {B.sql_round("CAST(sum(revenue) AS DOUBLE) / (CAST(sum(views) AS DOUBLE) / 1000.0)", 4)} ELSE 0.0 END AS derived_rpm, {_AVG},
 {B.sql_round("sum(revenue)", 4)} AS dollars_per_page, sum(views) <= 0 AS zero_views,
 CASE WHEN min(st) = max(st) THEN min(st) ELSE 'unknown' END AS revenue_status, bool_or(conflict) AS policy_conflict FROM res GROUP BY page_key, is_content"""


def _pages_sql(cohort: str, min_views: int) -> dict[str, str]:
    return {
        **RV,
        "pg": PAGES,
        "pc": f"SELECT * FROM pg WHERE {'true' if cohort == 'all' else f'cohort = {S.lit(cohort)}'} AND views >= {min_views}",
        "md": "SELECT median(derived_rpm) AS mr, median(views) AS mv, count(*) AS n FROM pc WHERE views > 0 AND revenue_status = 'applicable'",
        "ps": f"""SELECT pc.*, CASE WHEN n >= 5 AND revenue_status = 'applicable' AND views > 0 THEN CASE WHEN mr <= 0 THEN 0.0 ELSE {B.sql_round("derived_rpm / mr", 4)} END END AS benchmark_score,
          mv FROM pc, md""",
        "pb": "SELECT * EXCLUDE (mv), coalesce(benchmark_score >= 1.5 AND views >= mv, false) AS benchmark_opportunity FROM ps",
    }


@query(
    "r30_revenue_pages",
    B.duck("SELECT * FROM pb ORDER BY derived_rpm DESC NULLS LAST, page_key LIMIT 50", *T4, **_pages_sql("resolved", 0)),
)
def _(spark, sf):
    return PR.RevenuePages(resolved(spark, sf)).ranked()


@query(
    "r30_revenue_pages__unresolved",
    B.duck("SELECT * FROM pb ORDER BY views ASC NULLS LAST, page_key LIMIT 20", *T4, **_pages_sql("unresolved", 2500000)),
)
def _(spark, sf):
    return PR.RevenuePages(resolved(spark, sf), "unresolved", 2500000).ranked("views", "asc", 20)


@query(
    "r30_revenue_pages__default_scope",
    B.duck("SELECT * FROM pb ORDER BY cpm DESC NULLS LAST, page_key LIMIT 50", *T4,
           b=BATCHES, sc=SCOPE, **{**_pages_sql("all", 50000), "res0": RES0.replace("FROM revenue r", "FROM (SELECT revenue.* FROM revenue JOIN sc USING (period_label, import_batch)) r")}),
)
def _(spark, sf):
    dim = R.content_dim(B.content(spark, sf), B.content_terms(spark, sf))
    rows = R.resolve_rows(R.fold_pages(R.in_default_scope(B.revenue(spark, sf))), dim, B.policy(spark, sf))
    return PR.RevenuePages(rows, "all", 50000).ranked("cpm")


@query(
    "t05_sort_by_opportunity",
    B.duck("""SELECT page_key, benchmark_score, benchmark_opportunity FROM pb ORDER BY CASE WHEN benchmark_opportunity THEN 1000000.0 ELSE 0.0 END + benchmark_score
    DESC NULLS LAST, page_key""", *T4, **_pages_sql("all", 0)),
)
def _(spark, sf):
    rows = PR.RevenuePages(resolved(spark, sf), "all").ranked("benchmark_opportunity", limit=0)
    return rows.select("page_key", "benchmark_score", "benchmark_opportunity")


@query(
    "r30_revenue_pages__totals",
    B.duck(f"""SELECT n AS pages_before_limit, least(n, 50) AS pages_returned, n > 50 AS truncated, * EXCLUDE (n) FROM (SELECT (SELECT count(*) FROM pc) AS n,
    (SELECT count(*) FROM pg WHERE cohort = 'resolved') AS cohort_pages, (SELECT count(*) FROM pc WHERE zero_views) AS zero_views_pages,
    (SELECT CAST(sum(views) AS BIGINT) FROM pc) AS views, (SELECT {B.sql_round("sum(CAST(revenue AS DECIMAL(28,4)))", 4)} FROM pc) AS revenue,
    (SELECT count(*) FROM pg WHERE cohort = 'resolved') AS resolved_pages, (SELECT count(*) FROM pg WHERE cohort = 'unresolved') AS unresolved_pages,
    (SELECT n >= 5 FROM md) AS benchmark_computed)""", *T4, **_pages_sql("resolved", 500000)),
)
def _(spark, sf):
    return PR.RevenuePages(resolved(spark, sf), "resolved", 500000).totals()


MEANS = B.duck("SELECT page_key, views, source_rpm, cpm, viewability, fill_rate, impressions_per_pageview FROM pg", *T4, **RV, pg=PAGES)


@query("a16_plain_mean_rates", MEANS)
def _(spark, sf):
    return PR.page_table(resolved(spark, sf)).select("page_key", "views", *PR.RATES)


@query("a17_exact_median", "SELECT median(l_extendedprice) AS median, count(*) AS n FROM lineitem")
def _(spark, sf):
    return exact_median(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_extendedprice")


def _wavg(m: str) -> str:
    v = f"coalesce({m}, 0.0)"
    return B.sql_round(f"CASE WHEN sum(w) > 0 THEN sum({v} * w) / sum(w) WHEN sum(views) > 0 THEN sum({v} * views) / sum(views) ELSE avg({v}) END", 4)


@query(
    "a15_weighted_rates",
    B.duck(f"""SELECT slug, CAST(sum(views) AS BIGINT) AS views, CAST(sum(revenue) AS DOUBLE) AS revenue, {B.sql_round("CASE WHEN sum(views) > 0 THEN CAST(sum(revenue) AS DOUBLE) / sum(views) * 1000 ELSE 0 END", 4)} AS rpm,
    {B.sql_round("CASE WHEN sum(views) > 0 THEN sum(w) / sum(views) ELSE 0 END", 4)} AS impressions_per_pageview, {", ".join(f"{_wavg(m)} AS {m}" for m in ("cpm", "viewability", "fill_rate"))}
    FROM (SELECT *, views * coalesce(impressions_per_pageview, 0.0) AS w FROM revenue) GROUP BY 1""", "revenue"),
)
def _(spark, sf):
    out = R.aggregate_metrics(B.revenue(spark, sf), "slug")
    rates = [R.half_up(F.col(m), 4).alias(m) for m in ("rpm", "impressions_per_pageview", "cpm", "viewability", "fill_rate")]
    return out.select("slug", "views", F.col("revenue").cast("double").alias("revenue"), *rates)


# ---- delivery coverage ----------------------------------------------------------------

START, END = date(1997, 1, 1), date(1997, 3, 31)
GA_SQL = """SELECT CAST(1 + o_custkey % 7 AS INT) AS blog_id, concat('/', lower(o_orderpriority), '/', lower(o_orderstatus)) AS path,
 CAST(count(*) * 5 AS BIGINT) AS pageviews, count(DISTINCT o_custkey) AS sessions FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01' GROUP BY 1, 2"""
SNAP_SQL = """SELECT CAST(1 + l_suppkey % 7 AS INT) AS blog_id, l_partkey AS post_id, CASE WHEN l_tax > 0 THEN 1 END AS content_blog_id,
 CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start, last_day(CAST(l_shipdate AS DATE)) AS period_end,
 CASE WHEN l_suppkey % 7 = 4 THEN l_returnflag ELSE 'm' END AS import_batch, CAST(l_quantity AS BIGINT) AS views FROM lineitem
 WHERE l_shipdate >= DATE '1996-06-01' AND l_shipdate < DATE '1998-01-01' AND NOT (l_suppkey % 7 = 1 AND month(l_shipdate) = 2) AND NOT (l_suppkey % 7 = 6 AND month(l_shipdate) = 3)"""
DPOL_SQL = """SELECT blog_id, site_enabled, CASE WHEN blog_id = 4 THEN NULL ELSE true END AS serve_ads, true AS integration_available, reason FROM policy"""
DSTAT = """SELECT *, CASE WHEN NOT site_enabled OR reason IN ('site_disabled', 'route_blocked', 'member_benefit') THEN 'blocked'
 WHEN site_enabled AND serve_ads AND integration_available THEN 'applicable' ELSE 'unknown' END AS pst FROM dpol"""
WIN = """SELECT blog_id, count(*) AS periods, CASE WHEN max(nb) > 1 THEN 'duplicate_batches' WHEN min(period_start) <> DATE '1997-01-01' OR max(period_end) <> DATE '1997-03-31'
 THEN 'boundary_mismatch' WHEN bool_or(broken) THEN 'gap_or_overlap' ELSE '' END AS window_reason FROM
 (SELECT *, coalesce(period_start <> lag(period_end) OVER (PARTITION BY blog_id ORDER BY period_start) + 1, false) AS broken FROM
  (SELECT blog_id, period_start, period_end, count(DISTINCT import_batch) AS nb FROM snap WHERE period_start >= DATE '1997-01-01' AND period_end <= DATE '1997-03-31' GROUP BY 1, 2, 3))
 GROUP BY 1"""
DC = {"ga": GA_SQL, "snap": SNAP_SQL, "dpol": DPOL_SQL, "dst": DSTAT, "win": WIN}


def ga(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet").filter("o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-04-01'")
    return o.groupBy(
        (1 + F.col("o_custkey") % 7).cast("int").alias("blog_id"),
        F.concat(F.lit("/"), F.lower("o_orderpriority"), F.lit("/"), F.lower("o_orderstatus")).alias("path"),
    ).agg((F.count("*") * 5).alias("pageviews"), F.count_distinct("o_custkey").alias("sessions"))


def snapshots(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").filter(
        "l_shipdate >= DATE '1996-06-01' AND l_shipdate < DATE '1998-01-01' AND NOT (l_suppkey % 7 = 1 AND month(l_shipdate) = 2) "
        "AND NOT (l_suppkey % 7 = 6 AND month(l_shipdate) = 3)"
    )
    return line.selectExpr(
        "CAST(1 + l_suppkey % 7 AS INT) AS blog_id", "l_partkey AS post_id", "CASE WHEN l_tax > 0 THEN 1 END AS content_blog_id",
        "CAST(date_trunc('month', l_shipdate) AS DATE) AS period_start", "last_day(CAST(l_shipdate AS DATE)) AS period_end",
        "CASE WHEN l_suppkey % 7 = 4 THEN l_returnflag ELSE 'm' END AS import_batch", "CAST(l_quantity AS BIGINT) AS views",
    )


def delivery_policy(spark, sf):
    return B.policy(spark, sf).select(
        "blog_id", "site_enabled", F.when(F.col("blog_id") == 4, F.lit(None).cast("boolean")).otherwise(F.lit(True)).alias("serve_ads"),
        F.lit(True).alias("integration_available"), "reason",
    )


DELIVERY = B.duck(f"""SELECT blog_id, CASE WHEN pst = 'blocked' THEN 'blocked' WHEN r BETWEEN 0.8 AND 1.2 THEN 'aligned' WHEN r IS NOT NULL OR lone THEN 'warning' ELSE 'unknown' END AS status,
    r AS coverage_ratio, {B.sql_round("r * 100", 2)} AS coverage_percent, coalesce(r < 0.5 OR r > 1.5, lone) AS extreme_divergence,
    CASE WHEN ready THEN g END AS ga_applicable_views, CASE WHEN ready THEN m END AS network_applicable_views, coalesce(window_reason, 'no_dated_snapshot') AS snapshot_reason FROM
    (SELECT *, CASE WHEN ready THEN {B.sql_ratio("m", "g", 4)} END AS r, ready AND g = 0 AND m > 0 AS lone FROM
     (SELECT dst.blog_id, pst, window_reason, CAST(coalesce(gv, 0) AS BIGINT) AS g, CAST(coalesce(mv, 0) AS BIGINT) AS m, pst = 'applicable' AND coalesce(window_reason = '', false) AS ready FROM dst
      LEFT JOIN (SELECT blog_id, sum(pageviews) AS gv FROM ga GROUP BY 1) a ON a.blog_id = dst.blog_id
      LEFT JOIN (SELECT blog_id, sum(views) AS mv FROM snap WHERE period_start >= DATE '1997-01-01' AND period_end <= DATE '1997-03-31' GROUP BY 1) b ON b.blog_id = dst.blog_id
      LEFT JOIN win ON win.blog_id = dst.blog_id))""", "policy", **DC)


@query("r32_delivery_coverage", DELIVERY)
def _(spark, sf):
    return PR.delivery_coverage(ga(spark, sf), snapshots(spark, sf), delivery_policy(spark, sf), START, END)


@query("j18_cross_source_site_join", DELIVERY)
def _(spark, sf):
    return PR.delivery_coverage(ga(spark, sf), snapshots(spark, sf), delivery_policy(spark, sf), START, END)


@query("w17_snapshot_contiguity", B.duck("SELECT *, window_reason = '' AS exact FROM win", "policy", snap=SNAP_SQL, win=WIN))
def _(spark, sf):
    return PR.snapshot_windows(snapshots(spark, sf), START, END)


@query(
    "a22_source_summary",
    B.duck("""SELECT s.blog_id, CAST(sum(views) AS BIGINT) AS pageviews, CAST(0 AS BIGINT) AS sessions, CAST(coalesce(sum(views) FILTER (pst = 'applicable'), 0) AS BIGINT) AS applicable_views,
    CAST(coalesce(sum(views) FILTER (pst = 'blocked'), 0) AS BIGINT) AS blocked_views, CAST(coalesce(sum(views) FILTER (pst = 'unknown'), 0) AS BIGINT) AS unknown_views,
    CAST(coalesce(sum(views) FILTER (post_id > 0 AND content_blog_id > 0), 0) AS BIGINT) AS resolved_views,
    CAST(coalesce(sum(views) FILTER (NOT coalesce(post_id > 0 AND content_blog_id > 0, false)), 0) AS BIGINT) AS unresolved_views, count(*) AS rows
    FROM snap s JOIN dst ON dst.blog_id = s.blog_id GROUP BY 1""", "policy", **DC),
)
def _(spark, sf):
    side = delivery_policy(spark, sf).withColumn("status", PR.delivery_policy_status()).select("blog_id", "status")
    known = F.coalesce((F.col("post_id") > 0) & (F.col("content_blog_id") > 0), F.lit(False))
    rows = snapshots(spark, sf).join(side, "blog_id").withColumn("pageviews", F.col("views"))
    return PR.source_summary(rows.withColumn("sessions", F.lit(0)).withColumn("resolved", known))
