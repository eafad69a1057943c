"""Volume reports and the plain filters."""

from datetime import datetime

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.windows import exact, relative, resolve
from ..plans import traffic as T
from ..sources import bind as B
from . import query

SINCE28 = f"{B.AS_OF_SQL} - INTERVAL 28 DAY"


@query(
    "r01_analytics_summary",
    B.duck(f"""SELECT event_type, count(*) AS count, {B.sql_round("count(*) / 28.0", 1)} AS daily_avg
    FROM e WHERE created_at >= {SINCE28} GROUP BY 1 ORDER BY 2 DESC, 1"""),
)
def _(spark, sf):
    return T.analytics_summary(B.events(spark, sf), B.AS_OF)


@query("r01_analytics_summary__total", B.duck(f"SELECT count(*) AS total_events FROM e WHERE created_at >= {SINCE28}"))
def _(spark, sf):
    return T.summary_total(B.events(spark, sf), B.AS_OF)


@query(
    "a01_type_counts_all_time",
    B.duck("SELECT event_type, count(*) AS count, CAST(count(*) AS DOUBLE) AS daily_avg FROM e GROUP BY 1"),
)
def _(spark, sf):
    return T.analytics_summary(B.events(spark, sf), B.AS_OF, days=0)


@query(
    "a02_count_by_day",
    B.duck(f"""SELECT CAST(created_at AS DATE) AS date, count(*) AS count FROM e
    WHERE event_type = 'pageview' AND created_at >= {SINCE28} GROUP BY 1"""),
)
def _(spark, sf):
    return T.by_date(B.events(spark, sf), B.AS_OF, 28, "pageview")


@query(
    "a03_count_by_source",
    B.duck(f"""SELECT source_url, count(*) AS count FROM e WHERE event_type = 'pageview' AND source_url <> ''
    AND created_at >= {SINCE28} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
)
def _(spark, sf):
    return T.by_source(B.events(spark, sf), B.AS_OF, 28, "pageview")


@query(
    "a04_count_by_context",
    B.duck(f"""SELECT context, count(*) AS count FROM e WHERE event_type = 'newsletter_signup' AND context <> ''
    AND created_at >= {SINCE28} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"""),
)
def _(spark, sf):
    return T.by_context(B.events(spark, sf), B.AS_OF, 28, "newsletter_signup")


META_SQL = B.duck("""SELECT DISTINCT 'event_type' AS kind, event_type AS value FROM e
UNION ALL SELECT DISTINCT 'blog_id', CAST(blog_id AS STRING) FROM e""")


@query("r02_analytics_meta", META_SQL)
def _(spark, sf):
    return T.analytics_meta(B.events(spark, sf))


@query("a05_distinct_types_and_blogs", META_SQL)
def _(spark, sf):
    return T.analytics_meta(B.events(spark, sf))


BROWSE = "id, event_type, source_url, blog_id, user_id, visitor_id, created_at"


@query(
    "r03_browse_events",
    B.duck(f"""SELECT {BROWSE} FROM e WHERE event_type = 'pageview' AND blog_id = 2
    AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25 23:59:59'
    ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10"""),
)
def _(spark, sf):
    rows = T.filter_events(
        B.events(spark, sf), "pageview", 2, since=datetime(2024, 1, 5), until_day=datetime(2024, 1, 25)
    )
    return T.browse_events(rows.select(*BROWSE.split(", ")), offset=10)


@query(
    "r03_browse_events__count",
    B.duck("""SELECT count(*) AS total FROM e WHERE event_type = 'pageview' AND blog_id = 2
    AND created_at >= TIMESTAMP '2024-01-05' AND created_at <= TIMESTAMP '2024-01-25 23:59:59'"""),
)
def _(spark, sf):
    rows = T.filter_events(
        B.events(spark, sf), "pageview", 2, since=datetime(2024, 1, 5), until_day=datetime(2024, 1, 25)
    )
    return rows.agg(F.count("*").alias("total"))


@query(
    "t01_sorted_page",
    B.duck(f"SELECT {BROWSE} FROM e ORDER BY event_type, id LIMIT 100 OFFSET 300"),
)
def _(spark, sf):
    return T.browse_events(B.events(spark, sf).select(*BROWSE.split(", ")), "event_type", False, 100, 300)


IMPACT = f"""SELECT *, coalesce(nullif(user_id, 0), payload_user_id, 0) AS effective_user FROM e
WHERE is_bot = 'true' AND created_at >= {SINCE28} AND coalesce(nullif(user_id, 0), payload_user_id, 0) > 0"""


@query(
    "r13_bot_filter_impact",
    B.duck("SELECT event_type, count(*) AS events, count(DISTINCT effective_user) AS users FROM i GROUP BY 1", i=IMPACT),
)
def _(spark, sf):
    return T.bot_filter_impact(B.events(spark, sf), B.AS_OF)


@query(
    "r13_bot_filter_impact__totals",
    B.duck("SELECT count(*) AS events, count(DISTINCT effective_user) AS users FROM i", i=IMPACT),
)
def _(spark, sf):
    return T.bot_filter_totals(B.events(spark, sf), B.AS_OF)


@query(
    "r13_bot_filter_impact__examples",
    B.duck("""SELECT id, event_type, blog_id, effective_user, created_at FROM i
    ORDER BY created_at DESC, id DESC LIMIT 10""", i=IMPACT),
)
def _(spark, sf):
    return T.bot_filter_examples(B.events(spark, sf), B.AS_OF)


@query(
    "r35_post_views",
    B.duck("SELECT blog_id, post_id, count(*) AS views FROM e WHERE event_type = 'pageview' AND post_id > 0 GROUP BY 1, 2"),
)
def _(spark, sf):
    return T.post_views(B.events(spark, sf))


# ---- plain filters --------------------------------------------------------------------

FILTERS = {
    "f01_type_filter": (
        lambda: P.of_type(["search", "404_error"]),
        "event_type IN ('search', '404_error')",
    ),
    "f02_blog_user_filter": (lambda: P.scoped(3, 12), "blog_id = 3 AND user_id = 12"),
    "f03_relative_window": (lambda: relative(7, B.AS_OF).on(), f"created_at >= {B.AS_OF_SQL} - INTERVAL 7 DAY"),
    "f04_exact_window": (
        lambda: exact("2024-01-10", "2024-01-12").on(),
        "created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-13'",
    ),
    "f04_exact_window__previous": (
        lambda: exact("2024-01-10", "2024-01-12").previous().on(),
        "created_at >= TIMESTAMP '2024-01-07' AND created_at < TIMESTAMP '2024-01-10'",
    ),
    "f04_exact_window__shifted": (
        lambda: resolve(B.AS_OF, days=7, end_days_ago=7).on(),
        f"created_at >= {B.AS_OF_SQL} - INTERVAL 14 DAY AND created_at < {B.AS_OF_SQL} - INTERVAL 7 DAY",
    ),
    "f06_bot_is_true": (lambda: P.bot_is_true(), "coalesce(is_bot = 'true', false)"),
    "f07_not_bot": (lambda: P.bot_is_not_true(), "NOT coalesce(is_bot = 'true', false)"),
    "f07_not_bot__unclassified": (lambda: P.bot_unclassified(), "is_bot IS NULL"),
    "f08_explicit_human": (lambda: P.explicit_human(), "is_bot = 'false'"),
    "f09_truthy_bot": (lambda: P.bot_is_truthy(), "is_bot IS NOT NULL AND is_bot NOT IN ('false', '0', '', '[]')"),
    "f10_identified": (lambda: P.identified(), "visitor_id IS NOT NULL AND visitor_id <> ''"),
    "f17_exclude_auto_signup": (
        lambda: ~P.automatic_signup(),
        "NOT (event_type = 'newsletter_signup' AND context = 'registration')",
    ),
}


def _filter_query(cond):
    return lambda spark, sf: B.events(spark, sf).filter(cond()).select("id", "event_type", "created_at")


for _name, (_cond, _sql) in FILTERS.items():
    query(_name, B.duck(f"SELECT id, event_type, created_at FROM e WHERE {_sql}"))(_filter_query(_cond))


@query(
    "f05_payload_search",
    B.duck("SELECT id FROM e WHERE context LIKE '%side%'"),
)
def _(spark, sf):
    return T.filter_events(B.bronze(spark, sf), search='"context":"side').select("id")


@query(
    "f10_identified__uuid4",
    B.duck(f"SELECT id, v FROM u WHERE regexp_matches(v, '{P.UUID4}')",
           u="""SELECT id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', CASE WHEN id % 2 = 0 THEN '4' ELSE '1' END,
           substr(h, 14, 3), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS v
           FROM (SELECT id, md5(CAST(id AS STRING)) AS h FROM e)"""),
)
def _(spark, sf):
    v = """concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', CASE WHEN id % 2 = 0 THEN '4' ELSE '1' END,
           substr(h, 14, 3), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS v"""
    ids = B.events(spark, sf).selectExpr("id", "md5(CAST(id AS STRING)) AS h").selectExpr("id", v)
    return ids.filter(P.valid_uuid4("v"))


@query(
    "f15_keyset_page__before",
    B.duck("SELECT id, event_type FROM e WHERE id < 5000 ORDER BY id DESC LIMIT 200"),
)
def _(spark, sf):
    return T.page_before(B.events(spark, sf).select("id", "event_type"), 5000, 200)


@query(
    "f15_keyset_page__after",
    B.duck("""SELECT id, created_at FROM e WHERE created_at > TIMESTAMP '2024-01-12 08:00:00'
    OR (created_at = TIMESTAMP '2024-01-12 08:00:00' AND id > 77) ORDER BY created_at, id LIMIT 200"""),
)
def _(spark, sf):
    return T.page_after(B.events(spark, sf).select("id", "created_at"), (datetime(2024, 1, 12, 8), 77), 200)
