"""Revenue integrity checks."""

from datetime import date

from pyspark.sql import functions as F

from ..plans import diagnostics as D
from ..sources import bind as B
from . import query
from .revenue import BATCHES, RV, T4, resolved

AS_OF = date(2001, 12, 20)
DRPM = f"CASE WHEN views > 0 THEN {B.sql_round('CAST(revenue AS DOUBLE) / (CAST(views AS DOUBLE) / 1000.0)', 4)} ELSE 0.0 END"
_W = "CASE WHEN coalesce({}, false) THEN 'warning' ELSE 'pass' END"

ISSUES = [f"CASE WHEN isnan({c}) OR isinf({c}) THEN 'non_finite_{n}' END" for n, c in (
    ("revenue", "CAST(revenue AS DOUBLE)"), ("source_rpm", "c_rpm"), ("derived_rpm", "drpm"), ("cpm", "c_cpm"),
    ("viewability", "viewability"), ("fill_rate", "fill_rate"), ("impressions_per_pageview", "impressions_per_pageview"))]
ISSUES += ["CASE WHEN views < 0 THEN 'negative_views' END", "CASE WHEN views > 1000000000 THEN 'high_views' END"]
ISSUES += [f"CASE WHEN {c} < 0 THEN 'negative_{n}' END" for n, c in (("revenue", "revenue"), ("source_rpm", "c_rpm"), ("derived_rpm", "drpm"), ("cpm", "c_cpm"))]
ISSUES += [f"CASE WHEN {c} NOT BETWEEN 0 AND 100 THEN '{c}_out_of_range' END" for c in ("viewability", "fill_rate")]
ISSUES += ["CASE WHEN impressions_per_pageview NOT BETWEEN 0 AND 1000 THEN 'impressions_out_of_range' END"]

CTES = {
    **RV,
    "b": BATCHES,
    "rr": f"SELECT *, coalesce(rpm, 0.0) AS c_rpm, coalesce(cpm, 0.0) AS c_cpm, {DRPM} AS drpm FROM res",
    "mon": "SELECT DISTINCT period_label FROM revenue WHERE regexp_matches(period_label, '^\\d{4}-\\d{2}$')",
    "gap": """SELECT strftime(m, '%Y-%m') AS period_label FROM (SELECT unnest(generate_series((SELECT min(CAST(concat(period_label, '-01') AS DATE)) FROM mon),
      (SELECT max(CAST(concat(period_label, '-01') AS DATE)) FROM mon), INTERVAL 1 MONTH)) AS m) WHERE strftime(m, '%Y-%m') NOT IN (SELECT period_label FROM mon)""",
    "iss": f"SELECT slug, period_label, import_batch, list_filter([{', '.join(ISSUES)}], lambda x: x IS NOT NULL) AS issues, c_rpm > 1000 OR drpm > 1000 OR c_cpm > 1000 AS high_rate FROM rr",
    "fp": "SELECT page_key, editorial, max(format) AS format FROM rr WHERE is_content GROUP BY 1, 2",
}
MONEY = lambda expr: B.sql_round(f"coalesce({expr}, 0)", 4)

CHECK_SQL = {
    "d01_freshness": ("freshness", f"""SELECT 'latest_period_freshness' AS check, CASE WHEN count(*) = 0 THEN 'fail' WHEN max(period_end) IS NULL OR DATE '{AS_OF}' - max(period_end) > 45
      THEN 'warning' ELSE 'pass' END AS status, count(*) AS periods, (SELECT period_label FROM b WHERE period_end IS NOT NULL ORDER BY period_end DESC, period_label LIMIT 1) AS latest_period,
      max(period_end) AS latest_period_end, DATE '{AS_OF}' - max(period_end) AS data_age_days FROM b"""),
    "d02_missing_periods": ("missing", f"""SELECT 'missing_periods' AS check, {_W.format("(SELECT count(*) FROM gap) > 0")} AS status, (SELECT count(*) FROM mon) AS dated_periods,
      (SELECT count(*) FROM gap) AS missing_periods, (SELECT coalesce(string_agg(period_label, ',' ORDER BY period_label), '') FROM gap) AS missing"""),
    "d03_duplicate_batches": ("duplicate_batches", f"""SELECT 'duplicate_period_batches' AS check, {_W.format("count(*) FILTER (n > 1) > 0")} AS status, count(*) AS period_labels,
      count(*) FILTER (n > 1) AS duplicate_labels FROM (SELECT period_label, count(DISTINCT import_batch) AS n FROM b WHERE period_label <> '' GROUP BY 1)"""),
    "d04_totals_reconciliation": ("reconciliation", f"""SELECT 'totals_reconciliation' AS check, CASE WHEN row_rows = 0 AND independent_rows = 0 THEN 'warning' WHEN row_rows = independent_rows
      AND row_views = independent_views AND abs(row_revenue - independent_revenue) < 0.01 THEN 'pass' ELSE 'fail' END AS status, * FROM
      (SELECT count(*) AS row_rows, CAST(sum(views) AS BIGINT) AS row_views, {MONEY("sum(revenue)")} AS row_revenue, (SELECT count(*) FROM revenue) AS independent_rows,
       (SELECT CAST(sum(views) AS BIGINT) FROM revenue) AS independent_views, (SELECT {MONEY("sum(revenue)")} FROM revenue) AS independent_revenue FROM rr)"""),
    "d05_cohort_partition": ("partition", f"""SELECT 'content_unresolved_reconciliation' AS check, {_W.format("stale_post_id_rows > 0")} AS status, true AS partition_complete, * FROM
      (SELECT count(*) AS raw_rows, count(DISTINCT page_key) FILTER (is_content) AS resolved_pages, count(DISTINCT page_key) FILTER (NOT is_content) AS unresolved_pages,
       count(*) FILTER (is_content) AS content_rows, count(*) FILTER (NOT is_content) AS unresolved_rows, count(*) FILTER (NOT is_content AND post_id > 0) AS stale_post_id_rows,
       CAST(sum(views) AS BIGINT) AS partition_views, {MONEY("sum(revenue)")} AS partition_revenue FROM rr)"""),
    "d06_resolution_coverage": ("resolution", f"""SELECT 'resolution_coverage' AS check, {_W.format("unresolved_pages / total_pages > 0.5")} AS status, *, {B.sql_ratio("unresolved_pages", "total_pages", 4, "0.0")} AS unresolved_ratio FROM
      (SELECT count(DISTINCT page_key) AS total_pages, count(DISTINCT page_key) FILTER (is_content) AS resolved_pages, count(DISTINCT page_key) FILTER (NOT is_content) AS unresolved_pages,
       CAST(coalesce(sum(views) FILTER (is_content), 0) AS BIGINT) AS resolved_views, CAST(coalesce(sum(views) FILTER (NOT is_content), 0) AS BIGINT) AS unresolved_views FROM rr)"""),
    "d07_format_coverage": ("formats", f"""SELECT 'format_coverage' AS check, {_W.format("uncategorized_pages / eligible_editorial_pages > 0.3")} AS status, *, {B.sql_ratio("uncategorized_pages", "eligible_editorial_pages", 4, "0.0")} AS uncategorized_ratio FROM
      (SELECT count(*) AS resolved_pages, count(*) FILTER (editorial) AS eligible_editorial_pages, count(*) FILTER (NOT editorial) AS non_editorial_pages,
       count(*) FILTER (editorial AND format = 'uncategorized') AS uncategorized_pages FROM fp)"""),
    "d08_zero_view_revenue": ("zero_views", f"""SELECT 'zero_view_revenue' AS check, {_W.format("count(*) > 0")} AS status, count(*) AS rows, {MONEY("sum(revenue)")} AS revenue FROM rr WHERE views <= 0 AND revenue > 0"""),
    "d09_views_zero_revenue": ("zero_revenue", f"""SELECT 'views_zero_revenue' AS check, {_W.format("rows / n > 0.2")} AS status, rows, views, {B.sql_ratio("rows", "n", 4, "0.0")} AS ratio FROM
      (SELECT count(*) FILTER (views > 0 AND revenue <= 0) AS rows, CAST(coalesce(sum(views) FILTER (views > 0 AND revenue <= 0), 0) AS BIGINT) AS views, count(*) AS n FROM rr)"""),
    "d10_impossible_values": ("impossible", """SELECT 'negative_impossible_values' AS check, CASE WHEN bad_rows > 0 THEN 'fail' WHEN high_rate_rows > 0 THEN 'warning' ELSE 'pass' END AS status, * FROM
      (SELECT count(*) FILTER (len(issues) > 0) AS bad_rows, count(*) FILTER (high_rate) AS high_rate_rows FROM iss)"""),
    "d11_rpm_variance": ("rpm_variance", f"""SELECT 'rpm_variance' AS check, {_W.format("divergent_rows / viewed_rows > 0.1")} AS status, *, {B.sql_ratio("divergent_rows", "viewed_rows", 4, "0.0")} AS ratio FROM
      (SELECT count(*) AS viewed_rows, count(*) FILTER (abs(drpm - c_rpm) / greatest(abs(c_rpm), 0.0001) > 0.2) AS divergent_rows FROM rr WHERE views > 0)"""),
    "d12_provenance": ("provenance", f"""SELECT 'provenance_coverage' AS check, {_W.format("missing_batch + missing_period > 0")} AS status, * FROM (SELECT count(*) AS rows,
      count(*) FILTER (coalesce(import_batch, '') = '') AS missing_batch, count(*) FILTER (coalesce(period_label, '') = '') AS missing_period FROM rr)"""),
    "d13_ad_policy": ("ad_policy", f"""SELECT 'ad_policy_consistency' AS check, {_W.format("conflict_rows > 0 OR unknown_rows > 0")} AS status, * FROM (SELECT count(serve_ads) AS instrumented_rows,
      count(*) FILTER (serve_ads IS NULL) AS unknown_rows, count(*) FILTER (conflict) AS conflict_rows, {MONEY("sum(revenue) FILTER (conflict)")} AS conflict_revenue FROM rr)"""),
}


def diagnostics(spark, sf):
    return D.Diagnostics(B.revenue(spark, sf), resolved(spark, sf), AS_OF)


for _name, (_method, _sql) in CHECK_SQL.items():

    def _check(spark, sf, method=_method):
        return getattr(diagnostics(spark, sf), method)()

    query(_name, B.duck(_sql, *T4, **CTES))(_check)

ALL = " UNION ALL ".join(f'SELECT "check", status FROM ({sql})' for _, sql in CHECK_SQL.values())


@query("r31_revenue_diagnostics", B.duck(ALL, *T4, **CTES))
def _(spark, sf):
    return diagnostics(spark, sf).report()


@query(
    "r31_revenue_diagnostics__overall",
    B.duck("""SELECT *, CASE WHEN failed > 0 THEN 'fail' WHEN warnings > 0 THEN 'warning' ELSE 'pass' END AS overall_status FROM (SELECT count(*) FILTER (status = 'pass') AS passed,
    count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'fail') AS failed, count(*) AS total FROM allc)""", *T4, **CTES, allc=ALL),
)
def _(spark, sf):
    return diagnostics(spark, sf).overall()


@query(
    "d08_zero_view_revenue__samples",
    B.duck("SELECT slug, period_label, import_batch, revenue FROM rr WHERE views <= 0 AND revenue > 0 ORDER BY revenue DESC, slug, period_label, import_batch LIMIT 5", *T4, **CTES),
)
def _(spark, sf):
    return diagnostics(spark, sf).zero_view_rows()


@query(
    "d10_impossible_values__issues",
    B.duck("SELECT slug, period_label, import_batch, array_to_string(issues, ',') AS issues FROM iss WHERE len(issues) > 0", *T4, **CTES),
)
def _(spark, sf):
    rows = diagnostics(spark, sf).issues().filter(F.size("issues") > 0)
    return rows.select("slug", "period_label", "import_batch", F.array_join("issues", ",").alias("issues"))


@query(
    "d06_resolution_coverage__by_route",
    B.duck("""SELECT route_family, count(*) AS pages FROM (SELECT page_key, arg_min(route_family, source_url) AS route_family
    FROM rr WHERE NOT is_content GROUP BY 1) GROUP BY 1""", *T4, **CTES),
)
def _(spark, sf):
    return diagnostics(spark, sf).resolution_by_route()


# The bound series has no gap, so the months of May are left out to show some.
SPARSE = "period_label NOT LIKE '%-05'"


@query(
    "w16_missing_months",
    B.duck("""SELECT strftime(m, '%Y-%m') AS period_label FROM (SELECT unnest(generate_series((SELECT min(CAST(concat(period_label, '-01') AS DATE)) FROM s),
    (SELECT max(CAST(concat(period_label, '-01') AS DATE)) FROM s), INTERVAL 1 MONTH)) AS m) WHERE strftime(m, '%Y-%m') NOT IN (SELECT period_label FROM s)""",
           "revenue", s=f"SELECT DISTINCT period_label FROM revenue WHERE {SPARSE} AND period_label <> 'all-time'"),
)
def _(spark, sf):
    return D.missing_periods(B.revenue(spark, sf).filter(SPARSE))
