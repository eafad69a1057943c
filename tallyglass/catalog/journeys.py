"""Route transitions, retention and stickiness."""

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.windows import relative, resolve
from ..operators import sessions as OS
from ..plans import journeys as J
from ..sources import bind as B
from . import query
from . import rules_sql as S
from .traffic import SINCE28

UNTIL = J.epoch(B.AS_OF)


def _route_ctes(gap: int, days: int = 20) -> dict[str, str]:
    since = J.epoch(B.AS_OF - timedelta(days=days))
    return {
        "p": f"""SELECT id, visitor_id, blog_id, ts, {S.route_family("route_family", "post_id")} AS fam FROM e
         WHERE event_type = 'pageview' AND visitor_id <> '' AND ts BETWEEN {since - gap} AND {UNTIL}""",
        "g": f"""SELECT *, concat(CAST(blog_id AS STRING), ':', fam) AS node, CASE WHEN ts - lag(ts) OVER w <= {gap} THEN 0 ELSE 1 END AS brk
         FROM p WINDOW w AS (PARTITION BY visitor_id ORDER BY ts, id)""",
        "q": "SELECT *, sum(brk) OVER (PARTITION BY visitor_id ORDER BY ts, id) AS sess FROM g",
        "z": f"""SELECT visitor_id, sess, min(ts) AS s0, max(ts) AS s1, count(*) AS n, arg_min(node, struct_pack(a := ts, b := id)) AS first_node,
         arg_max(node, struct_pack(a := ts, b := id)) AS last_node FROM q GROUP BY 1, 2 HAVING min(ts) BETWEEN {since} AND {UNTIL}""",
        "acq": "SELECT visitor_id, min(ts) AS a FROM e WHERE event_type = 'pageview' AND visitor_id <> '' GROUP BY 1",
        "c": "SELECT z.*, CASE WHEN a BETWEEN s0 AND s1 THEN 'first_time' ELSE 'returning' END AS cohort FROM z JOIN acq USING (visitor_id)",
        "r": """SELECT q.*, cohort, lead(node) OVER w AS n1, lead(node, 2) OVER w AS n2, lead(q.blog_id) OVER w AS b1 FROM q
         JOIN c ON q.visitor_id = c.visitor_id AND q.sess = c.sess WINDOW w AS (PARTITION BY q.visitor_id, q.sess ORDER BY ts, id)""",
    }


RC = _route_ctes(B.GAP_12H)
COUNTS = """SELECT * FROM (SELECT count(*) AS sessions, count(*) FILTER (cohort = 'first_time') AS first_time_sessions,
 count(*) FILTER (cohort = 'returning') AS returning_sessions, count(*) FILTER (n = 1) AS direct_terminal_sessions FROM c),
 (SELECT count(n1) AS transitions, count(*) FILTER (b1 = blog_id) AS same_surface_transitions,
  count(*) FILTER (b1 <> blog_id) AS cross_surface_transitions, count(n2) AS sequence_windows FROM r)"""


def report(spark, sf, **kw):
    return J.RouteReport(B.events(spark, sf), B.AS_OF, **{"days": 20, "gap": B.GAP_12H, **kw})


@query("r17_route_transitions__counts", B.duck(COUNTS, **RC))
def _(spark, sf):
    return report(spark, sf).counts()


@query("r17_route_transitions__counts_30m", B.duck(COUNTS, **_route_ctes(B.GAP_30M)))
def _(spark, sf):
    return report(spark, sf, gap=B.GAP_30M).counts()


TRANS = B.duck("""SELECT node AS "from", n1 AS "to", blog_id = b1 AS same_surface, count(*) AS count FROM r
    WHERE n1 IS NOT NULL GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2 LIMIT 25""", **RC)


@query("r17_route_transitions", TRANS)
def _(spark, sf):
    return report(spark, sf).transitions()


@query(
    "r17_route_transitions__first_time",
    B.duck("""SELECT node AS "from", n1 AS "to", blog_id = b1 AS same_surface, count(*) AS count FROM r
    WHERE n1 IS NOT NULL AND cohort = 'first_time' GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2 LIMIT 25""", **RC),
)
def _(spark, sf):
    return report(spark, sf, cohort="first_time").transitions()


@query(
    "r17_route_transitions__sequences",
    B.duck("""SELECT concat(node, '>', n1, '>', n2) AS path, count(*) AS count FROM r WHERE n2 IS NOT NULL
    GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""", **RC),
)
def _(spark, sf):
    return report(spark, sf).sequences()


@query(
    "r17_route_transitions__entries",
    B.duck("SELECT first_node AS route, count(*) AS count FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", **RC),
)
def _(spark, sf):
    return report(spark, sf).entries()


@query(
    "r17_route_transitions__terminals",
    B.duck("SELECT last_node AS route, count(*) AS count FROM c GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", **RC),
)
def _(spark, sf):
    return report(spark, sf).terminals()


_COVER = f"ts BETWEEN {J.epoch(B.AS_OF - timedelta(days=20))} AND {UNTIL}"


@query(
    "r17_route_transitions__coverage",
    B.duck(f"""SELECT *, {B.sql_ratio("identified_pageviews", "total_pageviews", 4, "0.0")} AS identity_coverage_rate,
    (SELECT count(*) FROM p) AS loaded_identified_pageviews FROM
    (SELECT count(*) AS total_pageviews, count(*) FILTER (visitor_id <> '') AS identified_pageviews,
     count(*) FILTER (visitor_id IS NULL) AS anonymous_pageviews, count(route_family) AS explicit_route_family_pageviews,
     count(*) FILTER (route_family IS NULL AND post_id > 0) AS inferred_singular_pageviews,
     count(*) FILTER (route_family IS NULL AND coalesce(post_id, 0) = 0) AS historical_unclassified_pageviews
     FROM e WHERE event_type = 'pageview' AND {_COVER})""", **RC),
)
def _(spark, sf):
    return report(spark, sf).coverage()


@query(
    "w01_sessionize",
    B.duck("""SELECT id, visitor_id, min(ts) OVER (PARTITION BY visitor_id, sess) AS session_start FROM q""", **RC),
)
def _(spark, sf):
    return OS.sessionize(report(spark, sf).rows, B.GAP_12H).select("id", "visitor_id", "session_start")


@query(
    "w02_boundary_context",
    B.duck("SELECT visitor_id, s0 AS session_start, s1 AS session_last, n AS rows FROM z", **{k: RC[k] for k in "pgqz"}),
)
def _(spark, sf):
    return report(spark, sf).sessions().select("visitor_id", "session_start", "session_last", "rows")


@query(
    "w03_transitions",
    B.duck("""SELECT node AS "from", n1 AS "to", count(*) AS count FROM r WHERE n1 IS NOT NULL GROUP BY 1, 2""", **RC),
)
def _(spark, sf):
    t = OS.transitions(report(spark, sf).trails(1))
    return t.groupBy(J.node_key(F.col("from_node")).alias("from"), J.node_key(F.col("to_node")).alias("to")).agg(
        F.count("*").alias("count")
    )


@query(
    "w04_sequences",
    B.duck("SELECT concat(node, '>', n1, '>', n2) AS path, count(*) AS count FROM r WHERE n2 IS NOT NULL GROUP BY 1", **RC),
)
def _(spark, sf):
    return report(spark, sf, limit=2**31 - 1).sequences()


@query(
    "w05_entries_terminals",
    B.duck("SELECT first_node AS entry, last_node AS terminal, n = 1 AS direct, count(*) AS count FROM c GROUP BY 1, 2, 3", **RC),
)
def _(spark, sf):
    s = report(spark, sf).sessions()
    node = lambda e: F.concat_ws(":", F.col(f"{e}_blog_id").cast("string"), F.col(f"{e}_route_family"))
    return s.groupBy(node("first").alias("entry"), node("last").alias("terminal"), (F.col("rows") == 1).alias("direct")).agg(
        F.count("*").alias("count")
    )


@query(
    "w06_session_cohort",
    B.duck("SELECT visitor_id, s0 AS session_start, cohort FROM c", **RC),
)
def _(spark, sf):
    return report(spark, sf).sessions().select("visitor_id", "session_start", "cohort")


@query("j03_acquisition_lookup", B.duck("SELECT visitor_id, a AS acquisition_ts FROM acq", acq=RC["acq"]))
def _(spark, sf):
    return OS.acquisitions(J.known_pageviews(B.events(spark, sf)))


@query("t02_ranked_with_key_ties", TRANS)
def _(spark, sf):
    return report(spark, sf).transitions()


_RECENT = {
    "p0": RC["p"],
    "p1": "SELECT * FROM p0 ORDER BY ts DESC, id DESC LIMIT 401",
    "cut": f"SELECT CASE WHEN count(*) > 400 THEN min(ts) ELSE 0 END AS t0, arg_min(id, struct_pack(a := ts, b := id)) AS i0, CASE WHEN count(*) > 400 THEN min(ts) + {B.GAP_12H} ELSE 0 END AS since FROM p1",
    "p": "SELECT p1.* FROM p1, cut WHERE ts > t0 OR (ts = t0 AND id > i0)",
    "g": RC["g"], "q": RC["q"],
    "z": "SELECT visitor_id, sess, min(ts) AS s0, max(ts) AS s1, count(*) AS n FROM q GROUP BY 1, 2 HAVING min(ts) >= (SELECT since FROM cut)",
}


@query(
    "t04_recent_sample",
    B.duck("SELECT visitor_id, s0 AS session_start, n AS rows FROM z", **_RECENT),
)
def _(spark, sf):
    return report(spark, sf, recent=400).sessions().select("visitor_id", "session_start", "rows")


# ---- retention ------------------------------------------------------------------------

PV = f"SELECT *, CAST(created_at AS DATE) AS day FROM e WHERE event_type = 'pageview' AND created_at >= {SINCE28}"
PER = "SELECT visitor_id, count(DISTINCT day) AS d, count(DISTINCT blog_id) AS s FROM pv WHERE visitor_id <> '' GROUP BY 1"
RETURN = B.duck(f"""SELECT count(*) AS total_visitors, count(*) FILTER (d >= 2) AS returning_visitors,
    {B.sql_ratio("count(*) FILTER (d >= 2)", "count(*)", 4, "0.0")} AS rate FROM per""", pv=PV, per=PER)


@query("r16_retention__return_rate", RETURN)
def _(spark, sf):
    return J.return_rate(B.events(spark, sf), relative(28, B.AS_OF))


@query("a09_two_level_visitor_days", RETURN)
def _(spark, sf):
    return J.return_rate(B.events(spark, sf), relative(28, B.AS_OF))


@query(
    "r16_retention__cross_site",
    B.duck(f"""SELECT count(*) AS total_visitors, count(*) FILTER (d >= 2 AND s >= 2) AS cross_site_visitors,
    {B.sql_ratio("count(*) FILTER (d >= 2 AND s >= 2)", "count(*)", 4, "0.0")} AS rate FROM per""", pv=PV, per=PER),
)
def _(spark, sf):
    return J.cross_site_return(B.events(spark, sf), relative(28, B.AS_OF))


DEPTH = B.duck(f"""SELECT {B.sql_ratio("sum(n)", "count(*)", 2)} AS avg_pageviews_per_visitor_day, max(n) AS max_pageviews_per_visitor_day
    FROM (SELECT visitor_id, day, count(*) AS n FROM pv WHERE visitor_id <> '' GROUP BY 1, 2)""", pv=PV)


@query("r16_retention__session_depth", DEPTH)
def _(spark, sf):
    return J.session_depth(B.events(spark, sf), relative(28, B.AS_OF))


@query("a10_visitor_day_average", DEPTH)
def _(spark, sf):
    return J.session_depth(B.events(spark, sf), relative(28, B.AS_OF))


_AS_OF_COHORT = B.AS_OF - timedelta(days=3)
ACQ = """SELECT visitor_id, min(created_at) AS f, CAST(date_trunc('week', min(created_at)) AS DATE) AS wk FROM e
 WHERE event_type = 'pageview' AND visitor_id <> '' AND created_at < TIMESTAMP '2024-01-28' GROUP BY 1
 HAVING min(created_at) >= TIMESTAMP '2024-01-28' - INTERVAL 56 DAY"""
FLAGS = """SELECT a.visitor_id, wk, coalesce(bool_or(created_at < wk + INTERVAL 14 DAY), false) AS w1,
 coalesce(bool_or(created_at >= wk + INTERVAL 14 DAY), false) AS w2 FROM a LEFT JOIN
 (SELECT * FROM e WHERE event_type = 'pageview' AND created_at < TIMESTAMP '2024-01-28') x ON a.visitor_id = x.visitor_id
 AND created_at >= wk + INTERVAL 7 DAY AND created_at < wk + INTERVAL 21 DAY GROUP BY 1, 2"""
COHORT = B.duck(f"""SELECT strftime(wk, '%G%V') AS cohort_week, wk AS cohort_week_start, n AS cohort_size, m1 AS w1_mature, m2 AS w2_mature,
    CASE WHEN m1 THEN r1 END AS returned_w1, CASE WHEN m2 THEN r2 END AS returned_w2,
    CASE WHEN m1 THEN {B.sql_ratio("r1", "n", 4)} END AS retention_w1, CASE WHEN m2 THEN {B.sql_ratio("r2", "n", 4)} END AS retention_w2
    FROM (SELECT wk, count(*) AS n, count(*) FILTER (w1) AS r1, count(*) FILTER (w2) AS r2,
     TIMESTAMP '2024-01-28' >= wk + INTERVAL 14 DAY AS m1, TIMESTAMP '2024-01-28' >= wk + INTERVAL 21 DAY AS m2 FROM f GROUP BY 1)""",
    a=ACQ, f=FLAGS)


@query("r16_retention__cohorts", COHORT)
def _(spark, sf):
    return J.retention_cohorts(B.events(spark, sf), _AS_OF_COHORT)


@query("w11_retention_cohorts", COHORT)
def _(spark, sf):
    return J.retention_cohorts(B.events(spark, sf), _AS_OF_COHORT)


@query("w12_horizon_censoring", COHORT)
def _(spark, sf):
    return J.retention_cohorts(B.events(spark, sf), _AS_OF_COHORT)


@query(
    "j02_range_left_join",
    B.duck("SELECT visitor_id, wk AS cohort_week_start, w1 AS active_w1, w2 AS active_w2 FROM f", a=ACQ, f=FLAGS),
)
def _(spark, sf):
    return J.cohort_members(B.events(spark, sf), _AS_OF_COHORT)


@query(
    "r16_retention__referrers",
    B.duck("SELECT referrer_host, count(*) AS landings FROM pv WHERE referrer_host IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25", pv=PV),
)
def _(spark, sf):
    return J.referrers(B.events(spark, sf), relative(28, B.AS_OF))


COVER = B.duck("""SELECT count(*) AS total_pageviews, count(*) FILTER (post_id > 0) AS post_backed_pageviews,
    count(*) FILTER (view_kind = 'route') AS route_pageviews,
    count(*) FILTER (coalesce(post_id, 0) = 0 AND view_kind IS NULL) AS historical_unclassified_pageviews FROM pv""", pv=PV)


@query("r16_retention__coverage", COVER)
def _(spark, sf):
    return J.collection_coverage(B.events(spark, sf), relative(28, B.AS_OF))


@query("a11_conditional_coverage_counts", COVER)
def _(spark, sf):
    return J.collection_coverage(B.events(spark, sf), relative(28, B.AS_OF))


SURFACES = [2, 3, 4]
_P14 = "CASE WHEN created_at >= TIMESTAMP '2024-01-17' THEN 'current' WHEN created_at >= TIMESTAMP '2024-01-03' THEN 'prior' END"


@query(
    "r25_surface_stickiness",
    B.duck(f"""SELECT blog_id, cr AS return_rate, pr AS prior_return_rate, cd AS session_depth, pd AS prior_session_depth,
    ct AS total_visitors, cret AS returning_visitors, pt AS prior_total, {B.sql_round("cr - pr", 4)} AS return_rate_delta,
    {B.sql_round("cd - pd", 4)} AS session_depth_delta, ct - cret AS new_visitors, ct - pt AS total_delta FROM
    (SELECT blog_id, max(rate) FILTER (period = 'current') AS cr, max(rate) FILTER (period = 'prior') AS pr,
      max(depth) FILTER (period = 'current') AS cd, max(depth) FILTER (period = 'prior') AS pd,
      max(total) FILTER (period = 'current') AS ct, max(total) FILTER (period = 'prior') AS pt,
      max(ret) FILTER (period = 'current') AS cret FROM s GROUP BY 1)""",
    v=f"""SELECT blog_id, period, visitor_id, count(DISTINCT day) AS d, count(*) AS n FROM (SELECT *, {_P14} AS period,
     CAST(created_at AS DATE) AS day FROM e WHERE event_type = 'pageview' AND visitor_id <> '' AND blog_id IN (2, 3, 4))
     WHERE period IS NOT NULL GROUP BY 1, 2, 3""",
    s=f"""SELECT blog_id, period, count(*) AS total, count(*) FILTER (d >= 2) AS ret,
     {B.sql_ratio("count(*) FILTER (d >= 2)", "count(*)", 4)} AS rate, {B.sql_ratio("sum(n)", "sum(d)", 2)} AS depth FROM v GROUP BY 1, 2"""),
)
def _(spark, sf):
    return J.surface_stickiness(B.events(spark, sf), SURFACES, B.AS_OF, 14)


@query(
    "r25_surface_stickiness__activity",
    B.duck(f"""SELECT blog_id, post_type, c AS current, p AS prior, c - p AS delta, {B.sql_round("c / 2.0", 2)} AS per_week FROM
    (SELECT blog_id, post_type, count(*) FILTER (published_at >= TIMESTAMP '2024-01-17') AS c,
     count(*) FILTER (published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-01-17') AS p
     FROM content WHERE status = 'publish' AND blog_id IN (2, 3, 4) AND post_type = 'post' GROUP BY 1, 2)""", "content"),
)
def _(spark, sf):
    return J.surface_activity(B.content(spark, sf), [(b, "post") for b in SURFACES], B.AS_OF, 14)


def _xs(cond: str) -> str:
    return f"""SELECT {B.sql_ratio("count(*) FILTER (d >= 2 AND s >= 2)", "count(*)", 4, "0.0")} AS r FROM
    (SELECT visitor_id, count(DISTINCT blog_id) AS s, count(DISTINCT CAST(created_at AS DATE)) AS d FROM e
     WHERE event_type = 'pageview' AND visitor_id <> '' AND {cond} GROUP BY 1)"""


@query(
    "r25_surface_stickiness__cross_surface",
    B.duck(f"SELECT a.r AS current, b.r AS prior, {B.sql_round('a.r - b.r', 4)} AS delta FROM a, b",
           a=_xs("created_at >= TIMESTAMP '2024-01-17'"),
           b=_xs("created_at >= TIMESTAMP '2024-01-03' AND created_at < TIMESTAMP '2024-01-17'")),
)
def _(spark, sf):
    return J.cross_surface_trend(B.events(spark, sf), B.AS_OF, 14)
