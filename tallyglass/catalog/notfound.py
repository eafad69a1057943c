"""404, attack, search, bridge and outbound reports."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..plans import engagement as G
from ..plans import notfound as N
from ..sources import bind as B
from . import query
from . import rules_sql as S
from .traffic import SINCE28

SINCE7 = f"{B.AS_OF_SQL} - INTERVAL 7 DAY"
H = f"SELECT *, requested_url AS url FROM e WHERE event_type = '404_error' AND created_at >= {SINCE7}"
BYURL = "SELECT url, count(*) AS hits, max(created_at) AS last_seen FROM h GROUP BY 1"
REDIRECTS = "SELECT concat('/post-', CAST(p_partkey AS STRING)) AS url FROM part WHERE p_type = 'PROMO' UNION ALL SELECT NULL"
KEPT = "SELECT u.* FROM u LEFT JOIN r ON u.url = r.url WHERE r.url IS NULL"
BASE = {"h": H, "u": BYURL, "r": REDIRECTS, "n": KEPT}


def redirects(spark, sf):
    part = spark.read.parquet(f"{sf}/part.parquet").filter("p_type = 'PROMO'")
    return part.selectExpr("concat('/post-', CAST(p_partkey AS STRING)) AS url")


@query(
    "r04_summary_404",
    B.duck(f"""SELECT count(*) AS total, count(DISTINCT url) AS unique_urls, count(DISTINCT ip_hash) AS unique_ips,
    {B.sql_round("count(*) / 7.0", 2)} AS per_day_avg FROM h""", h=H),
)
def _(spark, sf):
    return N.summary_404(B.events(spark, sf), B.AS_OF)


@query("r04_summary_404__daily", B.duck("SELECT CAST(created_at AS DATE) AS date, count(*) AS hits FROM h GROUP BY 1", h=H))
def _(spark, sf):
    return N.daily_404(B.events(spark, sf), B.AS_OF)


@query(
    "a06_distinct_payload_values",
    B.duck("""SELECT count(*) AS total, count(DISTINCT requested_url) AS unique_urls, count(DISTINCT ip_hash) AS unique_ips,
    CAST(count(*) AS DOUBLE) AS per_day_avg FROM e WHERE event_type = '404_error'"""),
)
def _(spark, sf):
    return N.summary_404(B.events(spark, sf), B.AS_OF, days=0)


@query(
    "r05_top_urls_404",
    B.duck(f"""SELECT url, hits, last_seen, {S.category_404("url")} AS category FROM
    (SELECT * FROM n WHERE hits >= 2 ORDER BY hits DESC, url LIMIT 30)""", **BASE),
)
def _(spark, sf):
    return N.top_urls_404(B.events(spark, sf), redirects(spark, sf), B.AS_OF)


PATTERNS = B.duck(f"""SELECT category, CAST(sum(hits) AS BIGINT) AS hits, count(*) AS unique_urls,
    {B.sql_round("sum(hits) / (SELECT sum(hits) FROM n) * 100", 1)} AS pct,
    {S.members("category", S.R.ACTIONABLE_404)} AS actionable
    FROM (SELECT *, {S.category_404("url")} AS category FROM n) GROUP BY category""", **BASE)


@query("r06_patterns_404", PATTERNS)
def _(spark, sf):
    return N.patterns_404(B.events(spark, sf), redirects(spark, sf), B.AS_OF)


@query("a08_classify_distinct_then_group", PATTERNS)
def _(spark, sf):
    return N.patterns_404(B.events(spark, sf), redirects(spark, sf), B.AS_OF)


SLUG_SQL = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(
 regexp_replace(regexp_replace(regexp_extract(url, '^([^?]*)', 1), '(?i)\.html$', ''), '^/\d{4}/\d{2}/', '/'),
 '([^/]*)/*$', 1)), '[^a-z0-9_\-\s]', '', 'g'), '[\s\-]+', '-', 'g'), '^-+|-+$', '', 'g')"""
POSTS = "SELECT slug, min(post_id) AS post_id FROM content WHERE status = 'publish' AND post_type IN ('post', 'page') GROUP BY 1"

for _category in ("content", "date-prefix", "legacy-html"):

    def _drill(spark, sf, category=_category):
        return N.drill_404(B.events(spark, sf), redirects(spark, sf), B.content(spark, sf), B.AS_OF, category)

    query(
        f"r07_drill_404__{_category.replace('-', '_')}",
        B.duck(f"""SELECT d.*, post_id, post_id IS NOT NULL AS fixable FROM
        (SELECT url, hits, last_seen, {SLUG_SQL} AS slug FROM n WHERE {S.category_404("url")} = '{_category}'
         ORDER BY hits DESC, url LIMIT 20) d LEFT JOIN p USING (slug)""", "e", "content", p=POSTS, **BASE),
    )(_drill)


@query(
    "r07_drill_404__scanner",
    B.duck(f"""SELECT url, hits, last_seen FROM n WHERE {S.category_404("url")} = 'scanner-path-probe'
    ORDER BY hits DESC, url LIMIT 20""", **BASE),
)
def _(spark, sf):
    return N.drill_404(B.events(spark, sf), redirects(spark, sf), B.content(spark, sf), B.AS_OF, "scanner-path-probe")


@query(
    "j04_anti_join_redirects",
    B.duck("SELECT * FROM n", **BASE),
)
def _(spark, sf):
    return N.without_redirects(N.by_url(B.events(spark, sf), B.AS_OF, 7), redirects(spark, sf))


@query(
    "j13_post_by_slug",
    B.duck(f"""SELECT d.*, post_id, post_id IS NOT NULL AS fixable FROM (SELECT url, hits, {SLUG_SQL} AS slug FROM u) d
    LEFT JOIN p USING (slug)""", "e", "content", p=POSTS, h=H, u=BYURL),
)
def _(spark, sf):
    rows = N.by_url(B.events(spark, sf), B.AS_OF, 7).select("url", "hits")
    return N.with_post_by_slug(rows.withColumn("slug", N.urls.slug_of_404(F.col("url"))), B.content(spark, sf))


@query(
    "r08_list_404",
    B.duck("""SELECT id, url, coalesce(user_agent, '') AS user_agent, coalesce(ip_hash, '') AS ip_hash,
    created_at AS date, blog_id FROM h ORDER BY created_at DESC, id DESC LIMIT 50""", h=H),
)
def _(spark, sf):
    return N.list_404(B.events(spark, sf), B.AS_OF)


TOP_IPS = B.duck("""SELECT t.*, coalesce(ua, '') AS top_ua FROM
    (SELECT ip_hash, count(*) AS hits, count(DISTINCT url) AS unique_urls, min(created_at) AS first_seen,
     max(created_at) AS last_seen FROM h GROUP BY 1 ORDER BY 2 DESC, 1 NULLS FIRST LIMIT 15) t
    LEFT JOIN (SELECT ip_hash, user_agent AS ua, row_number() OVER (PARTITION BY ip_hash ORDER BY count(*) DESC, user_agent) AS rn
     FROM h GROUP BY 1, 2) m ON t.ip_hash = m.ip_hash AND rn = 1""", h=H)


@query("r09_top_ips_404", TOP_IPS)
def _(spark, sf):
    return N.top_ips_404(B.events(spark, sf), B.AS_OF)


@query("a07_group_with_mode", TOP_IPS)
def _(spark, sf):
    return N.top_ips_404(B.events(spark, sf), B.AS_OF)


SCAN = f"""SELECT *, {S.members("cat", S.R.SCANNER_404)} AS scanner FROM
(SELECT *, CAST(created_at AS DATE) AS day, {S.category_404("url")} AS cat FROM h)"""
SCAN_KEYS = {
    "category": "cat", "day": "CAST(day AS STRING)", "ip": "coalesce(nullif(ip_hash, ''), '(unknown)')", "url": "url",
}
for _group, _key in SCAN_KEYS.items():
    _order = "1 DESC" if _group == "day" else "2 DESC, 1"

    def _scan(spark, sf, group=_group):
        return N.scanner_404(B.events(spark, sf), B.AS_OF, group, limit=15)

    def _scan_totals(spark, sf, group=_group):
        return N.scanner_404_totals(B.events(spark, sf), B.AS_OF, group, limit=15)

    query(
        f"r10_scanner_404__{_group}",
        B.duck(f"SELECT {_key} AS key, count(*) AS count FROM s WHERE scanner GROUP BY 1 ORDER BY {_order} LIMIT 15", h=H, s=SCAN),
    )(_scan)
    query(
        f"r10_scanner_404__{_group}_totals",
        B.duck(f"""SELECT count(*) FILTER (scanner) AS scanner_total, count(*) FILTER (NOT scanner) AS benign_total,
        count(*) AS total, {B.sql_ratio("count(*) FILTER (scanner) * 100", "count(*)", 1, "0.0")} AS scanner_pct,
        count(DISTINCT CASE WHEN scanner THEN {_key} END) AS distinct,
        count(DISTINCT CASE WHEN scanner THEN {_key} END) > 15 AS truncated FROM s""", h=H, s=SCAN),
    )(_scan_totals)

ATTACK = f"SELECT * FROM e WHERE event_type = 'search_attack' AND created_at >= {SINCE28}"
ATTACK_KEYS = {"pattern": "classification", "day": "CAST(CAST(created_at AS DATE) AS STRING)", "ip": "ip", "url": "source_url"}
for _group, _key in ATTACK_KEYS.items():
    _order = "1 DESC" if _group == "day" else "2 DESC, 1"

    def _attack(spark, sf, group=_group):
        return N.attack_summary(B.events(spark, sf), B.AS_OF, group)

    def _attack_totals(spark, sf, group=_group):
        return N.attack_summary_totals(B.events(spark, sf), B.AS_OF, group)

    query(
        f"r11_attack_summary__{_group}",
        B.duck(f"SELECT coalesce({_key}, '(null)') AS key, count(*) AS count FROM a GROUP BY 1 ORDER BY {_order} LIMIT 25", a=ATTACK),
    )(_attack)
    query(
        f"r11_attack_summary__{_group}_totals",
        B.duck(f"""SELECT count(*) AS total, count(DISTINCT {_key}) AS distinct,
        (SELECT count(*) FROM (SELECT DISTINCT {_key} FROM a)) > 25 AS truncated FROM a""", a=ATTACK),
    )(_attack_totals)


@query(
    "t03_distinct_before_limit",
    B.duck("SELECT count(*) AS total, count(DISTINCT source_url) AS distinct, count(DISTINCT source_url) > 25 AS truncated FROM a", a=ATTACK),
)
def _(spark, sf):
    return N.attack_summary_totals(B.events(spark, sf), B.AS_OF, "url")


# ---- search gaps ----------------------------------------------------------------------

SEARCH = f"""SELECT * FROM e WHERE event_type = 'search' AND created_at >= {SINCE28} AND NOT coalesce(is_bot = 'true', false)
AND search_term IS NOT NULL"""
TERMS = f"""SELECT term, {S.payload("raw", "clean", "pattern_name")} IS NOT NULL AND term <> '' AS attack FROM
(SELECT search_term AS term, {S.unslash("search_term")} AS raw, {S.decoded("search_term")} AS clean
 FROM (SELECT DISTINCT search_term FROM s))"""
KEPT_S = "SELECT s.*, search_term AS term FROM s JOIN t ON s.search_term = t.term WHERE NOT attack"
SG = {"s": SEARCH, "t": TERMS, "k": KEPT_S}


def _gap_sql(max_results: int, low: bool) -> str:
    inner = f"""SELECT term, min(result_count) AS m, count(*) FILTER (result_count = 0) AS z, count(*) FILTER (result_count > 0) AS l
    FROM k WHERE result_count BETWEEN 0 AND {max_results} AND term <> '' GROUP BY 1"""
    if low:
        return B.duck(f"SELECT term, l AS count, m AS min_results FROM ({inner}) WHERE m > 0 ORDER BY 2 DESC, 1 LIMIT 25", **SG)
    return B.duck(f"SELECT term, z AS count FROM ({inner}) WHERE m = 0 ORDER BY 2 DESC, 1 LIMIT 25", **SG)


@query("r12_search_gaps", _gap_sql(0, False))
def _(spark, sf):
    return G.search_gaps(G.search_terms(B.events(spark, sf), B.AS_OF))


@query("r12_search_gaps__low_results", _gap_sql(2, True))
def _(spark, sf):
    return G.search_low_results(G.search_terms(B.events(spark, sf), B.AS_OF, max_results=2))


@query(
    "r12_search_gaps__by_source",
    B.duck("""SELECT coalesce(search_source, 'unknown') AS source, count(*) AS count,
    count(*) FILTER (result_count = 0) AS zero_result_count FROM k GROUP BY 1""", **SG),
)
def _(spark, sf):
    return G.search_by_source(G.search_terms(B.events(spark, sf), B.AS_OF))


@query(
    "r12_search_gaps__totals",
    B.duck(f"""SELECT total_searches, total_searches - unclassified AS classified_human, unclassified, zero_result_total,
    zero_result_distinct, {B.sql_ratio("zero_result_total * 100", "total_searches", 2, "0.0")} AS zero_result_rate,
    attacks + blank AS excluded_bot, attacks AS excluded_attack_searches, attack_terms AS excluded_attack_terms FROM
    (SELECT count(*) AS total_searches, count(*) FILTER (is_bot IS NULL) AS unclassified,
      count(*) FILTER (result_count = 0 AND term <> '') AS zero_result_total,
      count(DISTINCT CASE WHEN result_count = 0 AND term <> '' THEN term END) AS zero_result_distinct,
      count(*) FILTER (result_count = 0 AND term = '') AS blank FROM k),
    (SELECT count(*) AS attacks, count(DISTINCT term) AS attack_terms FROM s JOIN t ON s.search_term = t.term WHERE attack)""", **SG),
)
def _(spark, sf):
    return G.search_totals(G.search_terms(B.events(spark, sf), B.AS_OF))


@query("a12_per_term_minimum", _gap_sql(3, False))
def _(spark, sf):
    return G.search_gaps(G.search_terms(B.events(spark, sf), B.AS_OF, max_results=3))


@query(
    "j05_anti_join_terms",
    B.duck("SELECT term, count(*) AS n FROM k GROUP BY 1", **SG),
)
def _(spark, sf):
    terms = G.search_terms(B.events(spark, sf), B.AS_OF)
    kept = G.without_terms(terms, terms.filter("attack"))
    return kept.groupBy("term").agg(F.sum("searches").alias("n"))


# ---- bridge and outbound --------------------------------------------------------------

BR = f"SELECT * FROM e WHERE event_type IN ('bridge_click', 'bridge_impression') AND created_at >= {SINCE28}"
HB = "SELECT * FROM b WHERE is_bot IS NULL OR is_bot IN ('false', '0', '', '[]')"
CL, IM = "count(*) FILTER (event_type = 'bridge_click')", "count(*) FILTER (event_type = 'bridge_impression')"


@query(
    "r14_bridge_ctr",
    B.duck(f"""SELECT coalesce(nullif(dest_site, ''), '(unknown)') AS dest_site, {CL} AS clicks, {IM} AS impressions,
    {B.sql_ratio(CL, IM, 4, "0.0")} AS ctr FROM hb GROUP BY 1""", b=BR, hb=HB),
)
def _(spark, sf):
    return G.bridge_ctr(B.events(spark, sf), B.AS_OF)


@query(
    "r14_bridge_ctr__coverage",
    B.duck(f"""SELECT *, CASE WHEN eligible_rows = 0 THEN 'not_observed' WHEN rows_missing_dest_site = 0 THEN 'measured'
    WHEN rows_missing_dest_site = eligible_rows THEN 'not_instrumented' ELSE 'partial' END AS destination_status,
    CASE WHEN eligible_rows = 0 THEN 'not_observed' WHEN anonymous_rows = 0 THEN 'complete' WHEN identified_rows = 0
    THEN 'unavailable' ELSE 'partial' END AS identity_status,
    CASE WHEN loaded_rows = 0 THEN 'not_observed' ELSE 'observed' END AS status FROM
    (SELECT {CL} AS clicks, {IM} AS impressions, {B.sql_ratio(CL, IM, 4, "0.0")} AS ctr,
     (SELECT count(*) FROM b) AS loaded_rows, count(*) AS eligible_rows, (SELECT count(*) FROM b) - count(*) AS bot_rows_excluded,
     count(*) FILTER (visitor_id <> '') AS identified_rows, count(*) FILTER (visitor_id IS NULL OR visitor_id = '') AS anonymous_rows,
     count(*) FILTER (dest_site IS NULL OR dest_site = '') AS rows_missing_dest_site FROM hb)""", b=BR, hb=HB),
)
def _(spark, sf):
    return G.bridge_coverage(B.events(spark, sf), B.AS_OF)


OUT = f"""SELECT id, created_at, source_url, lower(coalesce(dest_host, '')) AS dest_host,
CASE WHEN coalesce(category, '') <> '' THEN category ELSE {S.substring_rules("lower(coalesce(dest_host, ''))", S.R.OUTBOUND_RULES, "other")} END AS category
FROM e WHERE event_type = 'outbound_click' AND is_bot = 'false' AND created_at >= {SINCE28}"""


def _outbound(spark, sf, **kw):
    return G.outbound_rows(B.events(spark, sf), B.AS_OF, **kw)


@query(
    "r15_outbound_clicks__by_category",
    B.duck(f"""SELECT category, count(*) AS clicks, {B.sql_ratio("count(*)", "(SELECT count(*) FROM o)", 4)} AS share
    FROM o GROUP BY 1""", o=OUT),
)
def _(spark, sf):
    return G.outbound_by_category(_outbound(spark, sf))


@query(
    "r15_outbound_clicks__by_destination",
    B.duck("""SELECT dest_host, arg_min(category, struct_pack(a := created_at, b := id)) AS category, count(*) AS clicks FROM o
    WHERE dest_host <> '' GROUP BY 1 ORDER BY 3 DESC, 1 LIMIT 25""", o=OUT),
)
def _(spark, sf):
    return G.outbound_by_destination(_outbound(spark, sf))


@query(
    "r15_outbound_clicks__by_source",
    B.duck(f"""SELECT {S.canonical_url("source_url")} AS source_url, count(*) AS clicks FROM o
    WHERE {S.canonical_url("source_url")} <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25""", o=OUT),
)
def _(spark, sf):
    return G.outbound_by_source(_outbound(spark, sf))


@query(
    "r15_outbound_clicks__totals",
    B.duck("""SELECT count(*) AS total, count(*) FILTER (dest_host = '') AS rows_missing_dest_host,
    CASE WHEN count(*) > 0 AND count(*) FILTER (dest_host = '') = count(*) THEN 'missing_destination_dimensions' END AS diagnostic
    FROM o WHERE category = 'social'""", o=OUT),
)
def _(spark, sf):
    return G.outbound_totals(_outbound(spark, sf, category="social"))


@query(
    "f16_404_capture",
    B.duck(f"""SELECT id, requested_url FROM e WHERE event_type = '404_error' AND NOT starts_with(requested_url, '/event/')
    AND (coalesce(user_id, 0) > 0 OR ({S.ua_class("user_agent")} = 'browser' AND visitor_id IS NOT NULL))"""),
)
def _(spark, sf):
    e = B.events(spark, sf).filter("event_type = '404_error'")
    v = C.verdict(
        F.col("user_agent"), F.col("visitor_id").isNotNull(), F.lit("web"), F.coalesce("user_id", F.lit(0)) > 0
    )
    return N.filter_404_capture(e, v["is_human"]).select("id", "requested_url")


@query(
    "e13_outbound_capture",
    B.duck(r"""SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM pages)
    WHERE host <> 'example.net' AND NOT ends_with(host, '.example.net')""", "content"),
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", N.urls.host(F.col("url")).alias("host"))
    own = spark.createDataFrame([("example.net",)], "host string")
    return G.filter_outbound(pages, "host", own)


# ---- the same reports for one blog ----------------------------------------------------

BLOG = 2


def one_blog(sql: str) -> str:
    """The text of a report over the events of one blog."""
    return sql.replace("FROM e WHERE", f"FROM e WHERE blog_id = {BLOG} AND")


@query("r06_patterns_404__one_blog", one_blog(PATTERNS))
def _(spark, sf):
    return N.patterns_404(B.events(spark, sf), redirects(spark, sf), B.AS_OF, blog_id=BLOG)


@query("r09_top_ips_404__one_blog", one_blog(TOP_IPS))
def _(spark, sf):
    return N.top_ips_404(B.events(spark, sf), B.AS_OF, blog_id=BLOG)


@query("r12_search_gaps__one_blog", one_blog(_gap_sql(0, False)))
def _(spark, sf):
    return G.search_gaps(G.search_terms(B.events(spark, sf), B.AS_OF, blog_id=BLOG))
