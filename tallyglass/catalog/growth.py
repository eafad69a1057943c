"""Surface growth, demand drill, link pages."""

from datetime import date, timedelta

from pyspark.sql import functions as F

from ..plans import growth as G
from ..sources import bind as B
from ..sources import counters as C
from . import query

GROWTH_AS_OF = date(1997, 3, 1)
SURFACES = [("main", 1, "post", "site1.example.com"), ("events", 2, "post", "site2.example.com"),
            ("community", 3, "page", "site3.example.com"), ("shop", 9, "post", "site9.example.com")]
SURF_SQL = "SELECT * FROM (VALUES " + ", ".join(map(str, SURFACES)) + ") s(surface, blog_id, post_type, host)"
DAILY_SQL = "SELECT concat('site', CAST(1 + o_custkey % 3 AS STRING), '.example.com') AS host, CAST(o_orderdate AS DATE) AS date, 1 AS sessions FROM orders"
TRAFFIC_SQL = """SELECT concat('site', CAST(1 + o_custkey % 3 AS STRING), '.example.com') AS host, CAST(o_orderdate AS DATE) AS date,
 CASE o_orderstatus WHEN 'F' THEN 'organic' WHEN 'O' THEN 'Organic Social' ELSE 'referral' END AS medium, 1 AS sessions FROM orders WHERE o_custkey % 3 <> 1"""


def surfaces(spark):
    return spark.createDataFrame(SURFACES, "surface string, blog_id int, post_type string, host string")


def orders(spark, sf):
    o = spark.read.parquet(f"{sf}/orders.parquet")
    return o.select(
        F.concat(F.lit("site"), (1 + F.col("o_custkey") % 3).cast("string"), F.lit(".example.com")).alias("host"),
        F.to_date("o_orderdate").alias("date"), F.lit(1).alias("sessions"), "o_custkey",
        F.when(F.col("o_orderstatus") == "F", "organic").when(F.col("o_orderstatus") == "O", "Organic Social")
        .otherwise("referral").alias("medium"),
    )


def _feed_sql(a: str, b: str, days: int) -> str:
    return f"""SELECT h.host, coalesce(days, 0) AS days, CASE WHEN coalesce(days, 0) >= {days} THEN 'measured' ELSE 'not_instrumented' END AS status,
    CASE WHEN coalesce(days, 0) < {days} THEN 'truncated_series' ELSE '' END AS reason,
    CASE WHEN coalesce(days, 0) >= {days} THEN sessions END AS sessions FROM (SELECT DISTINCT host FROM surf) h LEFT JOIN
    (SELECT host, count(DISTINCT date) AS days, CAST(sum(sessions) AS BIGINT) AS sessions FROM daily WHERE date BETWEEN DATE '{a}' AND DATE '{b}' GROUP BY 1) d ON d.host = h.host"""


@query("io18_feed_completeness", B.duck(_feed_sql("1997-02-01", "1997-02-28", 28), "content", surf=SURF_SQL, daily=DAILY_SQL))
def _(spark, sf):
    return G.check_feed(orders(spark, sf), surfaces(spark), date(1997, 2, 1), date(1997, 2, 28))


SUPPLY_SQL = f"""SELECT surface, host, n AS new_in_window, p AS prior_total, {B.sql_round("n / 4.0", 2)} AS per_week,
 CASE WHEN p > 0 THEN {B.sql_round("CAST(n AS DOUBLE) / p / 4 * 100", 3)} END AS pct_per_week FROM
 (SELECT surface, host, count(*) FILTER (published_at >= {B.AS_OF_SQL} - INTERVAL 28 DAY) AS n, count(*) FILTER (published_at < {B.AS_OF_SQL} - INTERVAL 28 DAY) AS p
  FROM surf LEFT JOIN (SELECT * FROM content WHERE status = 'publish') c ON c.blog_id = surf.blog_id AND c.post_type = surf.post_type GROUP BY 1, 2)"""


@query("r24_surface_growth__supply", B.duck(SUPPLY_SQL, "content", surf=SURF_SQL))
def _(spark, sf):
    return G.surface_supply(B.content(spark, sf), surfaces(spark), B.AS_OF)


DEMAND_SQL = f"""SELECT *, {B.sql_round("slope_pct / 4.0", 3)} AS pct_per_week, CASE WHEN measured THEN slope_pct IS NULL AND current_organic > 0 END AS is_new_traffic FROM
 (SELECT surface, host, ok AS measured, CASE WHEN ok THEN CASE WHEN src THEN 'organic' ELSE 'all_sessions' END END AS basis,
  CASE WHEN ok AND src THEN {B.sql_ratio("corg", "call", 4)} END AS organic_share, CASE WHEN ok THEN cs END AS current_sessions, CASE WHEN ok THEN ps END AS previous_sessions,
  CASE WHEN ok THEN c END AS current_organic, CASE WHEN ok THEN p END AS previous_organic, CASE WHEN ok AND p > 0 THEN {B.sql_round("CAST(c - p AS DOUBLE) / p * 100", 2)} END AS slope_pct FROM
  (SELECT *, CASE WHEN src THEN corg ELSE cs END AS c, CASE WHEN src THEN porg ELSE ps END AS p FROM
   (SELECT surface, surf.host, f1.status = 'measured' AND f0.status = 'measured' AS ok, f1.sessions AS cs, f0.sessions AS ps, coalesce(cr > 0 AND pr > 0, false) AS src,
     CAST(corg AS BIGINT) AS corg, CAST(porg AS BIGINT) AS porg, call FROM surf JOIN f1 ON f1.host = surf.host JOIN f0 ON f0.host = surf.host LEFT JOIN
    (SELECT host, count(*) FILTER (w = 'c') AS cr, count(*) FILTER (w = 'p') AS pr, coalesce(sum(sessions) FILTER (w = 'c' AND contains(lower(medium), 'organic')), 0) AS corg,
      coalesce(sum(sessions) FILTER (w = 'p' AND contains(lower(medium), 'organic')), 0) AS porg, sum(sessions) FILTER (w = 'c') AS call FROM
     (SELECT *, CASE WHEN date BETWEEN DATE '1997-02-01' AND DATE '1997-02-28' THEN 'c' WHEN date BETWEEN DATE '1997-01-04' AND DATE '1997-01-31' THEN 'p' END AS w FROM traffic)
     WHERE w IS NOT NULL GROUP BY 1) t ON t.host = surf.host)))"""
DM = {"surf": SURF_SQL, "daily": DAILY_SQL, "traffic": TRAFFIC_SQL, "f1": _feed_sql("1997-02-01", "1997-02-28", 28), "f0": _feed_sql("1997-01-04", "1997-01-31", 28)}


@query("r24_surface_growth__demand", B.duck(DEMAND_SQL, "content", **DM))
def _(spark, sf):
    o = orders(spark, sf)
    return G.surface_demand(o, o.filter("o_custkey % 3 <> 1"), surfaces(spark), GROWTH_AS_OF)


RANK_SQL = """SELECT surface, pct_per_week, CASE WHEN pct_per_week IS NOT NULL THEN row_number() OVER (ORDER BY pct_per_week DESC NULLS LAST, surface) END AS position,
 CASE WHEN pct_per_week IS NULL THEN 'no_measured_growth' END AS reason FROM sup"""


@query("r24_surface_growth__ranking", B.duck(RANK_SQL, "content", surf=SURF_SQL, sup=SUPPLY_SQL))
def _(spark, sf):
    return G.rank_surfaces(G.surface_supply(B.content(spark, sf), surfaces(spark), B.AS_OF))


@query("t07_rank_measured", B.duck(RANK_SQL, "content", surf=SURF_SQL, sup=SUPPLY_SQL))
def _(spark, sf):
    return G.rank_surfaces(G.surface_supply(B.content(spark, sf), surfaces(spark), B.AS_OF))


@query(
    "r24_surface_growth__fastest",
    B.duck("SELECT surface, pct_per_week FROM sup WHERE pct_per_week IS NOT NULL ORDER BY 2 DESC, 1 LIMIT 1", "content", surf=SURF_SQL, sup=SUPPLY_SQL),
)
def _(spark, sf):
    return G.fastest(G.surface_supply(B.content(spark, sf), surfaces(spark), B.AS_OF))


# ---- demand drill ---------------------------------------------------------------------

CUR, PRIOR = G.drill_windows(date(1997, 3, 31))


def _gsc_sql(w) -> str:
    return f"""SELECT concat('/post-', CAST(l_partkey AS STRING)) AS key, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS clicks, count(*) * 40 AS impressions,
    CAST(sum(l_linenumber) AS DOUBLE) / count(*) AS position FROM lineitem WHERE l_shipdate >= DATE '{w[0]}' AND l_shipdate < DATE '{w[1] + timedelta(days=1)}' GROUP BY 1"""


def gsc(spark, sf, w):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").filter(
        (F.col("l_shipdate") >= F.lit(w[0])) & (F.col("l_shipdate") < F.lit(w[1] + timedelta(days=1)))
    )
    return rows.groupBy(F.concat(F.lit("/post-"), F.col("l_partkey").cast("string")).alias("key")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("clicks"), (F.count("*") * 40).alias("impressions"),
        (F.sum("l_linenumber").cast("double") / F.count("*")).alias("position"),
    )


def changes(spark, sf, min_clicks=20):
    return G.demand_changes(gsc(spark, sf, CUR), gsc(spark, sf, PRIOR), min_clicks)


CH_SQL = f"""SELECT coalesce(a.key, b.key) AS target, coalesce(a.clicks, 0) AS clicks_current, coalesce(b.clicks, 0) AS clicks_prior, coalesce(a.clicks, 0) - coalesce(b.clicks, 0) AS net_click_change,
 coalesce(a.impressions, 0) AS impressions_current, coalesce(b.impressions, 0) AS impressions_prior, {B.sql_round("a.position", 1)} AS position_current, {B.sql_round("b.position", 1)} AS position_prior,
 {B.sql_round(B.sql_round("a.position", 1) + " - " + B.sql_round("b.position", 1), 1)} AS position_change FROM cur a FULL JOIN pri b ON a.key = b.key
 WHERE coalesce(a.clicks, 0) >= 20 OR coalesce(b.clicks, 0) >= 20"""
DD = {"cur": _gsc_sql(CUR), "pri": _gsc_sql(PRIOR), "ch": CH_SQL}

for _name in ("j10_full_outer_windows", "u02_union_of_keys"):
    query(_name, B.duck("SELECT * FROM ch", "content", **DD))(lambda spark, sf: changes(spark, sf))


@query("r26_demand_drill__decliners", B.duck("SELECT * FROM ch WHERE net_click_change < 0 ORDER BY net_click_change, target LIMIT 25", "content", **DD))
def _(spark, sf):
    return G.decliners(changes(spark, sf))


for _name in ("r26_demand_drill__risers", "t06_decliner_riser_split"):
    query(_name, B.duck("SELECT * FROM ch WHERE net_click_change > 0 ORDER BY net_click_change DESC, target LIMIT 25", "content", **DD))(
        lambda spark, sf: G.risers(changes(spark, sf))
    )


@query(
    "r26_demand_drill__totals",
    B.duck("""SELECT count(*) AS contributors, CAST(sum(net_click_change) AS BIGINT) AS net_click_total, count(*) FILTER (net_click_change < 0) AS decliner_count,
    count(*) FILTER (net_click_change > 0) AS riser_count FROM ch""", "content", **DD),
)
def _(spark, sf):
    return G.demand_totals(changes(spark, sf))


# ---- link pages -----------------------------------------------------------------------

LV = "SELECT post_id AS link_page_id, CAST(created_at AS DATE) AS stat_date, count(*) AS view_count FROM e WHERE event_type = 'pageview' AND post_id > 0 GROUP BY 1, 2"
LC = """SELECT post_id AS link_page_id, CAST(created_at AS DATE) AS stat_date, dest_url AS link_url, coalesce(dest_host, '') AS link_text, count(*) AS click_count FROM e
 WHERE event_type = 'outbound_click' AND post_id > 0 GROUP BY 1, 2, 3, 4"""
END = date(2024, 1, 30)
DAYS_SQL = """SELECT link_page_id, CAST(d AS DATE) AS stat_date, CAST(coalesce(views, 0) AS BIGINT) AS views, CAST(coalesce(clicks, 0) AS BIGINT) AS clicks FROM
 (SELECT link_page_id, unnest(generate_series(DATE '2024-01-11', DATE '2024-01-30', INTERVAL 1 DAY)) AS d FROM (SELECT link_page_id FROM lv WHERE stat_date >= DATE '2024-01-11' UNION
  SELECT link_page_id FROM lc WHERE stat_date >= DATE '2024-01-11')) p
 LEFT JOIN (SELECT link_page_id AS i, stat_date AS s, sum(view_count) AS views FROM lv GROUP BY 1, 2) v ON v.i = link_page_id AND v.s = d
 LEFT JOIN (SELECT link_page_id AS i, stat_date AS s, sum(click_count) AS clicks FROM lc GROUP BY 1, 2) c ON c.i = link_page_id AND c.s = d"""


def daily(spark, sf):
    e = B.events(spark, sf)
    return G.link_page_daily(C.rollup_link_views(e), C.rollup_link_clicks(e), END, 20)


for _name in ("r27_link_page_analytics__daily", "j14_calendar_gap_fill"):
    query(_name, B.duck(DAYS_SQL, lv=LV, lc=LC))(lambda spark, sf: daily(spark, sf))


@query(
    "r27_link_page_analytics__totals",
    B.duck("SELECT link_page_id, CAST(sum(views) AS BIGINT) AS views, CAST(sum(clicks) AS BIGINT) AS clicks FROM d GROUP BY 1", lv=LV, lc=LC, d=DAYS_SQL),
)
def _(spark, sf):
    return G.link_page_totals(daily(spark, sf))


@query(
    "r27_link_page_analytics__top_links",
    B.duck("""SELECT * FROM (SELECT link_page_id, link_url, link_text, CAST(sum(click_count) AS BIGINT) AS clicks,
    row_number() OVER (PARTITION BY link_page_id ORDER BY sum(click_count) DESC, link_url, link_text) AS position FROM lc WHERE stat_date >= DATE '2024-01-11' GROUP BY 1, 2, 3)
    WHERE position <= 20""", lc=LC),
)
def _(spark, sf):
    return G.top_links(C.rollup_link_clicks(B.events(spark, sf)), END, 20)


@query("io10_link_counters__views", B.duck("SELECT * FROM lv", lv=LV))
def _(spark, sf):
    e = B.events(spark, sf)
    stored = C.rollup_link_views(e.filter("created_at < '2024-01-15'"))
    return C.rollup_link_views(e.filter("created_at >= '2024-01-15'"), stored)


@query("io10_link_counters__clicks", B.duck("SELECT * FROM lc", lc=LC))
def _(spark, sf):
    e = B.events(spark, sf)
    stored = C.rollup_link_clicks(e.filter("created_at < '2024-01-15'"))
    return C.rollup_link_clicks(e.filter("created_at >= '2024-01-15'"), stored)
