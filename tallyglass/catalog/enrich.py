"""Enrichment operators over whole tables."""

from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import urls
from ..sources import bind as B
from . import query
from . import rules_sql as S


@query("e01_ua_class", B.duck(f"SELECT id, user_agent, {S.ua_class('user_agent')} AS ua_class FROM e"))
def _(spark, sf):
    return B.events(spark, sf).select("id", "user_agent", C.ua_class(F.col("user_agent")).alias("ua_class"))


@query(
    "e02_request_verdict",
    B.duck(f"""SELECT id, human AS is_human, NOT human AS is_bot, {S.ua_class("user_agent")} AS ua_class FROM
    (SELECT *, coalesce(user_id, 0) > 0 OR (CASE WHEN id % 5 = 0 THEN 'rest' ELSE 'web' END = 'web' AND {S.ua_class("user_agent")} = 'browser' AND visitor_id IS NOT NULL) AS human FROM e)"""),
)
def _(spark, sf):
    origin = F.when(F.col("id") % 5 == 0, "rest").otherwise("web")
    v = C.verdict(F.col("user_agent"), F.col("visitor_id").isNotNull(), origin, F.coalesce("user_id", F.lit(0)) > 0)
    out = B.events(spark, sf).select("id", v.alias("v"))
    return out.select("id", "v.is_human", "v.is_bot", "v.ua_class")


def _requested(spark, sf):
    """Distinct requested URLs of the events and the paths of all crawled pages."""
    e = B.events(spark, sf).select(F.col("requested_url").alias("url"))
    p = spark.read.parquet(f"{sf}/pages.parquet").select(F.regexp_replace("url", r"^[a-z]+://[^/]+", "").alias("url"))
    return e.unionByName(p).distinct()


URLS = r"SELECT DISTINCT url FROM (SELECT requested_url AS url FROM e UNION ALL SELECT regexp_replace(url, '^[a-z]+://[^/]+', '') FROM pages)"


@query("e03_404_category", B.duck(f"SELECT url, {S.category_404('url')} AS category FROM u", u=URLS))
def _(spark, sf):
    return _requested(spark, sf).withColumn("category", C.not_found_category(F.col("url")))


@query(
    "e04_404_flags",
    B.duck(f"""SELECT url, {S.members("c", S.R.ACTIONABLE_404)} AS actionable, {S.members("c", S.R.SCANNER_404)} AS scanner FROM
    (SELECT url, {S.category_404("url")} AS c FROM u)""", u=URLS),
)
def _(spark, sf):
    rows = _requested(spark, sf).withColumn("c", C.not_found_category(F.col("url")))
    return rows.select("url", C.is_actionable(F.col("c")).alias("actionable"), C.is_scanner(F.col("c")).alias("scanner"))


SLUG = r"""regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(
 regexp_replace(regexp_replace(regexp_extract(url, '^([^?]*)', 1), '(?i)\.html$', ''), '^/\d{4}/\d{2}/', '/'),
 '([^/]*)/*$', 1)), '[^a-z0-9_\-\s]', '', 'g'), '[\s\-]+', '-', 'g'), '^-+|-+$', '', 'g')"""


@query("e05_404_slug", B.duck(f"SELECT url, {SLUG} AS slug FROM u", u=URLS))
def _(spark, sf):
    return _requested(spark, sf).withColumn("slug", urls.slug_of_404(F.col("url")))


TERMS = f"""SELECT term, {S.unslash("term")} AS raw, {S.decoded("term")} AS clean FROM (SELECT DISTINCT search_term AS term FROM e
 UNION SELECT text FROM benchmark UNION SELECT text FROM conversations)"""


def _terms(spark, sf):
    """Search terms of the events, with benchmark and conversation texts as whole harmless inputs."""
    e = B.events(spark, sf).select(F.col("search_term").alias("term"))
    for table in ("benchmark", "conversations"):
        e = e.unionByName(spark.read.parquet(f"{sf}/{table}.parquet").select(F.col("text").alias("term")))
    return e.distinct()


@query(
    "e06_search_payload",
    B.duck(f"""SELECT term, CASE WHEN term <> '' THEN {S.payload("raw", "clean", "pattern_name")} END AS pattern_name,
    CASE WHEN term <> '' THEN {S.payload("raw", "clean", "pattern_family")} END AS pattern_family,
    CASE WHEN term <> '' THEN {S.payload("raw", "clean", "matched_token")} END AS matched_token FROM t""", t=TERMS),
)
def _(spark, sf):
    out = _terms(spark, sf).withColumn("p", C.search_payload(F.col("term")))
    return out.select("term", "p.pattern_name", "p.pattern_family", "p.matched_token")


@query(
    "e07_search_source",
    B.duck(r"""SELECT id, CASE WHEN id % 9 = 0 THEN 'bbpress_forum' WHEN trim(coalesce(source_url, '')) = '' THEN 'unknown'
    WHEN regexp_matches(lower(source_url), '/search/|\?s=|&s=|/page/|\?paged=|&paged=') THEN 'archive' ELSE 'nav' END AS source FROM e"""),
)
def _(spark, sf):
    uri = F.when(F.col("id") % 9 == 0, "/forums/?BBP_search=x").otherwise("/")
    return B.events(spark, sf).select("id", C.search_source(F.col("source_url"), uri).alias("source"))


@query(
    "e08_referrer_host",
    f"""SELECT page_id, nullif(CASE WHEN h = 'spam-farm.example.org' THEN '' ELSE h END, '') AS referrer_host FROM
    (SELECT page_id, regexp_replace({S.host("url")}, '^www\\.', '') AS h FROM pages)""",
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    return pages.select("page_id", urls.referrer_host(F.col("url"), F.lit("WWW.spam-farm.example.org")).alias("referrer_host"))


@query("e09_canonical_url", f"SELECT page_id, {S.canonical_url('url')} AS url FROM pages")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", urls.canonical_url(F.col("url")).alias("url"))


@query("e10_route_family", B.duck(f"SELECT id, {S.route_family('route_family', 'post_id')} AS route_family FROM e"))
def _(spark, sf):
    return B.events(spark, sf).select("id", C.route_family(F.col("route_family"), F.col("post_id")).alias("route_family"))


LOWER_HOST = "lower(coalesce(h, ''))"
HOSTS = f"SELECT DISTINCT h FROM (SELECT dest_host AS h FROM e UNION ALL SELECT {S.host('url')} FROM pages)"


@query(
    "e12_outbound_category",
    B.duck(f"SELECT h, {S.substring_rules(LOWER_HOST, S.R.OUTBOUND_RULES, "other")} AS category FROM x", x=HOSTS),
)
def _(spark, sf):
    hosts = B.events(spark, sf).select(F.col("dest_host").alias("h")).unionByName(
        spark.read.parquet(f"{sf}/pages.parquet").select(urls.host(F.col("url")).alias("h"))
    ).distinct()
    return hosts.withColumn("category", C.outbound_category(F.col("h")))


@query(
    "e18_hostname",
    r"""SELECT page_id, regexp_replace(lower(regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)), '^www\.', '') AS host FROM pages""",
)
def _(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    # Every third page is given as a bare host with port and trailing dot.
    bare = F.concat(F.upper(F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1)), F.lit(".:8080"))
    value = F.when(F.col("page_id") % 3 == 0, bare).otherwise(F.col("url"))
    return pages.select("page_id", urls.normal_hostname(value).alias("host"))


@query(
    "x01_rule_catalogue_argument",
    B.duck("""SELECT id, CASE WHEN contains(lower(coalesce(user_agent, '')), 'firefox') THEN 'bot' WHEN trim(coalesce(user_agent, '')) = '' THEN 'empty' ELSE 'browser' END AS ua_class,
    CASE WHEN starts_with(requested_url, '/post-') THEN 'post' ELSE 'rest' END AS category, CASE WHEN contains(lower(coalesce(dest_host, '')), 'example') THEN 'own' ELSE 'else' END AS outbound FROM e"""),
)
def _(spark, sf):
    return B.events(spark, sf).select(
        "id", C.ua_class(F.col("user_agent"), ["firefox"]).alias("ua_class"),
        C.not_found_category(F.col("requested_url"), [("post", "prefix", ["/post-"])], "rest").alias("category"),
        C.outbound_category(F.col("dest_host"), [("own", ["example"])], "else").alias("outbound"),
    )
