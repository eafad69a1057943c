"""Binds the supplied test tables to the analytics model.

Each binding is a list of SQL expressions that Spark and DuckDB read alike; the
few spellings that differ are filled in per engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = datetime(2024, 1, 31)
AS_OF_SQL = "TIMESTAMP '2024-01-31 00:00:00'"
GAP_30M = 1800
GAP_12H = 43200
ENTRY_HOST = "site1.example.com"

SPARK = {
    "k": "CAST(get_json_object(props, '$.k') AS INT)",
    "epoch": "unix_timestamp(CAST(ts AS TIMESTAMP))",
    "day": "to_date({})",
}
DUCK = {
    "k": "CAST(json_extract_string(props, '$.k') AS INT)",
    "epoch": "CAST(floor(epoch(ts)) AS BIGINT)",
}


def _text(value: str | None) -> str:
    if value is None:
        return "CAST(NULL AS STRING)"
    return value[1:] if value.startswith("=") else "'" + value.replace("'", "''") + "'"


def pick_spark(expr: str, values: list[str | None]) -> str:
    """Value number ``expr % len(values)``; reads ``expr`` once, so a pushed-down filter parses the payload once."""
    return f"elt(CAST(({expr}) % {len(values)} AS INT) + 1, {', '.join(map(_text, values))})"


def pick_duck(expr: str, values: list[str | None]) -> str:
    """The same as CASE; a value starting with '=' is an expression."""
    arms = []
    for i, value in enumerate(values):
        if value is None:
            continue
        arms.append(f"WHEN {i} THEN {_text(value)}")
    return f"CASE ({expr}) % {len(values)} {' '.join(arms)} END"


REQUESTED = [
    "=concat('/post-', CAST(k AS STRING))", "=concat('/2023/04/post-', CAST(k AS STRING))",
    "=concat('/old/post-', CAST(k AS STRING), '.html')", "/.env", "/.git/config",
    "/wp-config.php.bak", "/backup.zip", "/etc/passwd", "/%2e%2e%2fetc%2fpasswd",
    "=concat('/events/', CAST(user_id AS STRING), '/package.json')", "/wp-json/wp/v2/users",
    "/mediakit/", "/Kontakt", "/wp-content/uploads/2020/a.jpg", "/wp-content/plugins/x/readme.txt",
    "/wp-includes/wlwmanifest.xml", "/wp-login.php", "/xx.PHP7", "/ads.txt", "/admin/",
    "/?author=1", "/Sitemap.xml", "=concat('/t/thread-', CAST(user_id AS STRING))",
    "=concat('/events/show-', CAST(k AS STRING))", "/festival/summer", "/JOIN/",
    "=concat('/search?q=1+union+select+', CAST(user_id AS STRING))", "/WEB-INF/web.xml",
    "/x.jspx", "=concat('/artist/band-', CAST(user_id AS STRING), '/')",
]
SEARCHES = [
    "=concat('band ', CAST(user_id % 40 AS STRING))", "=concat('festival ', CAST(k AS STRING))",
    "1' waitfor delay '0:0:5'--", "sleep(5)", "", "<script>alert(1)</script>", "Gemma",
    "%3Cscript%3Ex", "memphis", "(select(0)from(select(sleep(3))))", "../../etc/passwd",
    "=concat('Grateful Dead ', CAST(k % 3 AS STRING))", "1&#039;&quot;1000", "Gemfile.lock",
    "@@z5T3X", None, "x%2527%2522", "print(md5(31337))", "jazz", "javascript:alert(1)",
    "=concat('a very long phrase that a person would hardly ever type into the box ', CAST(k AS STRING))",
    "the/page/page/3/0qah8bhh2pp4.jsp", "&lt;script&gt;",
]
AGENTS = [
    "Mozilla/5.0 (X11; Linux x86_64) Firefox/122.0", "Googlebot/2.1", "",
    "python-requests/2.31", "Mozilla/5.0 (iPhone) Safari/604.1",
]
DESTINATIONS = [
    "open.spotify.com", "www.Instagram.com", "netflix.com", "dice.fm", "band.bandcamp.com",
    "shop.bigcartel.com", "example.org", None, "", "www.ticketmaster.com",
]

POST_URL = "=concat('https://site', CAST(1 + k % 7 AS STRING), '.example.com/post-', CAST(k AS STRING), '/')"
POST_URL_WWW = "=concat('https://www.site1.example.com/post-', CAST(k AS STRING), '/?utm=x')"
SEARCH_URL = "=concat('https://site', CAST(1 + k % 7 AS STRING), '.example.com/search/?s=', CAST(user_id AS STRING))"


def event_columns(pick) -> dict[str, str]:
    return {
        "id": "event_id",
        "event_type": (
            "CASE event_type WHEN 'view' THEN 'pageview' WHEN 'click' THEN "
            + pick("k", ["bridge_impression", "bridge_click", "outbound_click", "search"])
            + " WHEN 'signup' THEN "
            + pick("k", ["newsletter_signup", "user_registration", "experiment_assignment", "experiment_exposure"])
            + " WHEN 'purchase' THEN "
            + pick("k", ["artist_signup_started", "artist_profile_created", "artist_profile_first_publish"])
            + " ELSE CASE WHEN k % 5 = 0 THEN 'search_attack' ELSE '404_error' END END"
        ),
        "created_at": "CAST(date_trunc('second', ts) AS TIMESTAMP)",
        "ts": "{epoch}",
        "blog_id": "CAST(1 + k % 7 AS INT)",
        "user_id": "CASE WHEN event_id % 3 = 0 THEN user_id END",
        "payload_user_id": "CASE WHEN event_id % 17 = 0 THEN 0 WHEN event_id % 19 = 0 THEN user_id END",
        "visitor_id": (
            "CASE WHEN event_id % 11 = 0 THEN NULL WHEN user_id % 10 < 2 "
            "THEN concat('s', CAST(CAST(floor(user_id / 10) AS BIGINT) AS STRING)) "
            "ELSE concat('v', CAST(user_id AS STRING)) END"
        ),
        "is_bot": pick("k", ["true", None, *["false"] * 8]),
        "source_url": pick("k", [POST_URL, POST_URL, POST_URL, POST_URL_WWW, "", POST_URL, SEARCH_URL, POST_URL]),
        "post_id": "CASE WHEN k % 4 <> 0 THEN CAST(k AS BIGINT) END",
        "route_family": pick("k", ["home", "archive", "singular", "directory", None, "search"]),
        "view_kind": "CASE WHEN k % 4 = 0 AND k % 3 <> 0 THEN 'route' END",
        "referrer_host": pick("k", [None, "google.com", "facebook.com", None, "site2.example.com", "news.example.org", "chatgpt.com"]),
        "context": pick("k", ["registration", "popup", "popup", "popup", "footer", "popup", "popup", "sidebar"]),
        "search_term": pick("user_id + k", SEARCHES),
        "result_count": "CAST(k % 5 AS BIGINT)",
        "search_source": pick("k", ["nav", "archive", None]),
        "requested_url": pick("user_id + k", REQUESTED),
        "classification": pick("user_id + k", ["time_based_sqli", "boolean_sqli", "xss_script_tag", None]),
        "pattern_family": pick("user_id + k", ["sqli", "sqli", "xss", None]),
        "ip": "CASE WHEN k % 3 <> 0 THEN concat('10.0.0.', CAST(user_id % 50 AS STRING)) END",
        "ip_hash": "CASE WHEN k % 13 <> 0 THEN md5(CAST(user_id % 60 AS STRING)) END",
        "user_agent": pick("event_id + k", AGENTS),
        "dest_host": pick("user_id + k", DESTINATIONS),
        "dest_url": (
            "concat('https://', coalesce(" + pick("user_id + k", DESTINATIONS) + ", ''), '/p/', CAST(k AS STRING), '?q=1')"
        ),
        "category": "CASE WHEN k % 3 = 0 THEN 'merch' END",
        "dest_site": pick("user_id + k", ["events", "community", "artist", "", None]),
        "experiment_key": "CASE WHEN k % 25 = 2 THEN 'other-test' ELSE 'card-holdout' END",
        "definition_version": "CAST(CASE WHEN k % 23 = 0 THEN 2 WHEN k % 29 = 2 THEN 0 ELSE 1 END AS BIGINT)",
        "assignment_policy": "CASE WHEN k % 31 = 2 THEN 'Bad Policy' ELSE 'visitor-hash' END",
        "variant": (
            "CASE WHEN (user_id % 2 = 0) <> (k % 20 = 2) THEN 'control' ELSE 'treatment' END"
        ),
        "surface": "CASE WHEN k % 37 = 3 THEN 'sidebar-card' ELSE 'post-card' END",
    }


CATEGORY_SLUGS = [
    "lyrics", "guitars", "history", "charleston", "interviews", "quiz", "playlists", "guides",
    "news", "misc", "live-music", "opinion",
]
_BRAND = "CAST(replace(p_brand, 'Brand#', '') AS INT)"
CONTENT_COLUMNS: dict[str, str] = {
    "blog_id": "CAST(1 + p_partkey % 7 AS INT)",
    "post_id": "p_partkey",
    "post_type": "CASE WHEN p_size % 9 = 0 THEN 'page' ELSE 'post' END",
    "status": "CASE WHEN p_size % 11 = 0 THEN 'draft' ELSE 'publish' END",
    "author_id": "CAST(p_size % 6 AS BIGINT)",
    "title": (
        "CASE WHEN p_size % 10 = 0 THEN concat('Top 5 ', p_name) WHEN p_size % 10 = 1 "
        "THEN concat(p_name, ' quiz') ELSE p_name END"
    ),
    "slug": "concat('post-', CAST(p_partkey AS STRING))",
    "url": (
        "concat('https://site', CAST(1 + p_partkey % 7 AS STRING), '.example.com/post-', "
        "CAST(p_partkey AS STRING), CASE WHEN p_size % 13 = 0 THEN '.html' ELSE '/' END)"
    ),
    "published_at": "TIMESTAMP '2023-12-15 00:00:00' + INTERVAL 1 DAY * CAST(p_partkey % 45 AS INT)",
}
TERM_COLUMNS: dict[str, str] = {
    "blog_id": "CAST(1 + p_partkey % 7 AS INT)",
    "post_id": "p_partkey",
    "term_id": f"CAST({_BRAND} AS BIGINT)",
    "slug": pick_duck(_BRAND, CATEGORY_SLUGS),
    "name": "p_brand",
    "ord": "1",
}
TYPE_TERM_COLUMNS: dict[str, str] = {
    "blog_id": "CAST(1 + p_partkey % 7 AS INT)",
    "post_id": "p_partkey",
    "term_id": "CAST(100 + length(p_type) AS BIGINT)",
    "slug": "lower(p_type)",
    "name": "p_type",
    "ord": "2",
}
# One row per page, month and batch.
REVENUE_SOURCE = """
SELECT l_partkey AS pk, CAST({month} AS STRING) AS period_label, l_returnflag AS flag,
       CAST(sum(CAST(l_quantity AS BIGINT) * 50000) AS BIGINT) AS q,
       CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(12,4))) AS DECIMAL(18,4)) AS rev,
       CAST(count(*) AS BIGINT) AS lines, min(l_linenumber) AS ln
FROM lineitem GROUP BY 1, 2, 3
"""
REVENUE_COLUMNS: dict[str, str] = {
    "blog_id": "CAST(1 AS INT)",
    "slug": (
        "CASE WHEN pk % 19 = 0 THEN concat('category/c', CAST(pk AS STRING)) "
        "WHEN pk % 23 = 0 THEN concat('old/p', CAST(pk AS STRING), '.html') "
        "WHEN pk % 29 = 0 THEN 'login' ELSE concat('post-', CAST(pk AS STRING)) END"
    ),
    "url": (
        "CASE WHEN pk % 2 = 0 THEN concat('https://www.site', CAST(1 + pk % 3 AS STRING), '.example.com/x', "
        "CAST(pk AS STRING), '/') WHEN pk % 31 = 0 THEN '/' END"
    ),
    "post_id": "CASE WHEN pk % 19 = 0 OR pk % 23 = 0 OR pk % 29 = 0 THEN NULL ELSE pk END",
    "content_blog_id": (
        "CASE WHEN pk % 19 = 0 OR pk % 23 = 0 OR pk % 29 = 0 THEN NULL "
        "WHEN pk % 5 = 0 THEN NULL ELSE CAST(1 + pk % 7 AS INT) END"
    ),
    "views": "CASE WHEN pk % 41 = 0 THEN CAST(0 AS BIGINT) ELSE q END",
    "revenue": "CASE WHEN pk % 43 = 0 THEN CAST(0 AS DECIMAL(18,4)) ELSE rev END",
    "rpm": "CASE WHEN pk % 47 = 0 THEN NULL ELSE CAST(8 + pk % 30 + ln / 10.0 AS DOUBLE) END",
    "cpm": "CASE WHEN pk % 53 = 0 THEN NULL ELSE CAST(2 + pk % 11 AS DOUBLE) END",
    "viewability": "CASE WHEN pk % 59 = 0 THEN 140.0 ELSE CAST(50 + pk % 40 AS DOUBLE) END",
    "fill_rate": "CAST(60 + pk % 35 AS DOUBLE)",
    "impressions_per_pageview": "CAST(1 + pk % 6 AS DOUBLE)",
    "period_label": (
        "CASE WHEN flag = 'R' AND pk % 61 = 0 THEN 'all-time' ELSE period_label END"
    ),
    "period_start": "CASE WHEN flag = 'R' AND pk % 61 = 0 THEN NULL ELSE CAST(concat(period_label, '-01') AS DATE) END",
    "period_end": (
        "CASE WHEN flag = 'R' AND pk % 61 = 0 THEN NULL ELSE last_day(CAST(concat(period_label, '-01') AS DATE)) END"
    ),
    "import_batch": "CASE WHEN flag = 'A' THEN concat('m-', period_label) WHEN flag = 'N' THEN concat('m-', period_label) ELSE concat('r-', substr(period_label, 1, 4)) END",
}


def _select(columns: dict[str, str], engine: dict[str, str]) -> list[str]:
    fill = lambda text: text.replace("{epoch}", engine["epoch"])
    return [f"{fill(expr)} AS {name}" for name, expr in columns.items()]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- Spark side -----------------------------------------------------------------------


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed event view; columns a report does not read are pruned before the JSON read."""
    raw = _table(spark, sf_dir, "events").selectExpr("*", f"{SPARK['k']} AS k")
    return raw.selectExpr(*_select(event_columns(pick_spark), SPARK))


PAYLOAD = [
    "user_id", "is_bot", "post_id", "route_family", "view_kind", "referrer_host", "context", "search_term",
    "result_count", "requested_url", "ip_hash", "user_agent", "dest_host", "dest_site",
    "experiment_key", "definition_version", "assignment_policy", "variant", "surface",
]


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stored: eight columns with the payload as JSON text."""
    e = events(spark, sf_dir)
    fields = [
        F.col("payload_user_id").alias("user_id") if f == "user_id"
        else (F.col("is_bot") == "true").alias("is_bot") if f == "is_bot"
        else F.col(f)
        for f in PAYLOAD
    ]
    return e.select(
        "id", "event_type", F.to_json(F.struct(*fields)).alias("event_data"), "source_url",
        "blog_id", "user_id", "visitor_id", "created_at",
    )


def content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").selectExpr(*_select(CONTENT_COLUMNS, SPARK))


def content_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = _table(spark, sf_dir, "part")
    return part.selectExpr(*_select(TERM_COLUMNS, SPARK)).unionByName(
        part.selectExpr(*_select(TYPE_TERM_COLUMNS, SPARK))
    )


def revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _table(spark, sf_dir, "lineitem")
    per_page = line.groupBy(
        F.col("l_partkey").alias("pk"),
        F.date_format("l_shipdate", "yyyy-MM").alias("period_label"),
        F.col("l_returnflag").alias("flag"),
    ).agg(
        F.sum(F.col("l_quantity").cast("bigint") * 50000).alias("q"),
        F.sum((F.col("l_extendedprice") * (1 - F.col("l_discount"))).cast("decimal(12,4)"))
        .cast("decimal(18,4)").alias("rev"),
        F.min("l_linenumber").alias("ln"),
    )
    return per_page.selectExpr(*_select(REVENUE_COLUMNS, SPARK))


def policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ad policy per content blog, from the suppliers' regions."""
    supplier, nation = _table(spark, sf_dir, "supplier"), _table(spark, sf_dir, "nation")
    per_blog = (
        supplier.join(nation, supplier.s_nationkey == nation.n_nationkey)
        .groupBy((1 + F.col("s_suppkey") % 7).cast("int").alias("blog_id"))
        .agg(F.count_if(F.col("n_regionkey") == 2).alias("asia"), F.count("*").alias("n"))
    )
    return per_blog.select(
        "blog_id",
        (F.col("blog_id") != 6).alias("site_enabled"),
        F.when(F.col("blog_id") == 4, F.lit(None).cast("boolean"))
        .otherwise((F.col("blog_id") != 3) & (F.col("asia") < F.col("n")))
        .alias("serve_ads"),
        F.when(F.col("blog_id") == 4, F.lit("")).otherwise(F.lit("site-policy")).alias("reason"),
    )


# ---- DuckDB side ----------------------------------------------------------------------

_NL = ",\n  "
EVENTS_SQL = (
    f"SELECT {_NL.join(_select(event_columns(pick_duck), DUCK))} FROM (SELECT *, {DUCK['k']} AS k FROM events)"
)
CONTENT_SQL = f"SELECT {_NL.join(_select(CONTENT_COLUMNS, DUCK))} FROM part"
TERMS_SQL = (
    f"SELECT {_NL.join(_select(TERM_COLUMNS, DUCK))} FROM part UNION ALL "
    f"SELECT {_NL.join(_select(TYPE_TERM_COLUMNS, DUCK))} FROM part"
)
REVENUE_SQL = (
    f"SELECT {_NL.join(_select(REVENUE_COLUMNS, DUCK))} FROM ("
    + REVENUE_SOURCE.replace("{month}", "strftime(l_shipdate, '%Y-%m')")
    + ")"
)
POLICY_SQL = """
SELECT blog_id, blog_id <> 6 AS site_enabled,
       CASE WHEN blog_id = 4 THEN NULL ELSE blog_id <> 3 AND asia < n END AS serve_ads,
       CASE WHEN blog_id = 4 THEN '' ELSE 'site-policy' END AS reason
FROM (SELECT CAST(1 + s_suppkey % 7 AS INT) AS blog_id, count(*) FILTER (n_regionkey = 2) AS asia, count(*) AS n
      FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1)
"""
BOUND = {
    "e": EVENTS_SQL, "content": CONTENT_SQL, "terms": TERMS_SQL, "revenue": REVENUE_SQL,
    "policy": POLICY_SQL,
}


def duck(body: str, *bound: str, **ctes: str) -> str:
    """DuckDB text: the named bound tables and further CTEs, then ``body``."""
    parts = [f"{name} AS MATERIALIZED ({BOUND[name]})" for name in (bound or ("e",))]
    parts += [f"{name} AS ({text})" for name, text in ctes.items()]
    return "WITH " + ",\n".join(parts) + "\n" + body


def sql_round(expr: str, places: int) -> str:
    return f"CAST(round(CAST({expr} AS DECIMAL(28,10)), {places}) AS DOUBLE)"


def sql_ratio(num: str, den: str, places: int, empty: str = "NULL") -> str:
    """DuckDB twin of :func:`tallyglass.functions.stats.ratio`."""
    value = sql_round(f"CAST({num} AS DOUBLE) / CAST({den} AS DOUBLE)", places)
    return f"CASE WHEN ({den}) <> 0 THEN {value} ELSE {empty} END"
