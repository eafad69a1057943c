"""Scans, sinks and maintenance jobs: written to the scratch folder, read back and compared."""

from datetime import timedelta

from pyspark.sql import functions as F

from ..operators import revenue as R
from ..session import scratch_dir
from ..sources import bind as B
from ..sources import events as EV
from ..sources import maintenance as M
from ..sources import revenue_store as RS
from . import query
from . import rules_sql as S
from .people import types_in

SILVER = "id, event_type, source_url, blog_id, user_id, visitor_id, created_at, ts, payload_user_id, is_bot, post_id, route_family, context, search_term, result_count, definition_version, variant"


@query("io01_event_scan", B.duck(f"SELECT {SILVER} FROM e"))
def _(spark, sf):
    path = scratch_dir(spark, "bronze")
    B.bronze(spark, sf).write.parquet(path)
    return EV.read_events(spark, path).select(*SILVER.split(", "))


UUID = """concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', CASE WHEN id % 4 = 0 THEN '1' ELSE '4' END, substr(h, 14, 3), '-a', substr(h, 18, 3), '-', substr(h, 21, 12))"""
RAWTYPE = "CASE WHEN id % 41 = 0 THEN '  ' WHEN id % 7 = 0 THEN concat(' ', upper(event_type)) ELSE event_type END"
ORIGIN = "CASE WHEN id % 5 = 0 THEN 'rest' ELSE 'web' END"


def raw_events(spark, sf):
    e = B.events(spark, sf).selectExpr("*", "md5(CAST(id AS STRING)) AS h")
    return e.selectExpr(
        "id", f"{RAWTYPE} AS event_type", "source_url", "blog_id", "user_id", f"CASE WHEN id % 6 = 0 THEN 'x' ELSE {UUID} END AS visitor_id",
        "created_at", "search_term", "user_agent", f"{ORIGIN} AS request_origin",
    )


STAMP = f"""SELECT id, created_at, blog_id, user_id, vis AS visitor_id, CASE WHEN typ = 'search' AND term <> '' AND pname IS NOT NULL THEN 'search_attack' ELSE typ END AS event_type,
 {S.canonical_url("source_url")} AS source_url, CASE WHEN typ = 'search' THEN src END AS search_source,
 CASE WHEN coalesce(user_id, 0) > 0 OR (origin = 'web' AND {S.ua_class("user_agent")} = 'browser' AND vis IS NOT NULL) THEN 'false' ELSE 'true' END AS is_bot,
 CASE WHEN typ = 'search' AND term <> '' THEN pname END AS classification, CASE WHEN typ = 'search' AND term <> '' THEN pfam END AS pattern_family,
 CASE WHEN typ = 'search' AND term <> '' THEN ptok END AS matched_token FROM
 (SELECT *, {S.payload("raw", "clean", "pattern_name")} AS pname, {S.payload("raw", "clean", "pattern_family")} AS pfam, {S.payload("raw", "clean", "matched_token")} AS ptok,
   CASE WHEN trim(source_url) = '' THEN 'unknown' WHEN regexp_matches(lower(source_url), '/search/|\\?s=|&s=|/page/|\\?paged=|&paged=') THEN 'archive' ELSE 'nav' END AS src FROM
  (SELECT *, search_term AS term, {S.unslash("search_term")} AS raw, {S.decoded("search_term")} AS clean, CASE WHEN id % 6 = 0 OR id % 4 = 0 THEN NULL ELSE {UUID} END AS vis,
    {ORIGIN} AS origin, CASE WHEN id % 41 = 0 THEN '' ELSE event_type END AS typ FROM (SELECT *, md5(CAST(id AS STRING)) AS h FROM e)))
 WHERE typ <> ''"""


@query("io02_stamped_append", B.duck(STAMP))
def _(spark, sf):
    """Two appends of half the rows each."""
    path = scratch_dir(spark, "events")
    raw = raw_events(spark, sf)
    for cond in ("created_at < '2024-01-16'", "created_at >= '2024-01-16'"):
        EV.append_events(EV.stamp_events(raw.filter(cond)), path)
    return spark.read.parquet(path).select(
        "id", "created_at", "blog_id", "user_id", "visitor_id", "event_type", "source_url", "search_source", "is_bot",
        "classification", "pattern_family", "matched_token",
    )


@query(
    "io03_revenue_csv",
    B.duck("""SELECT CAST(1 AS INT) AS blog_id, slug, views, CAST(revenue AS DOUBLE) AS revenue, coalesce(rpm, 0.0) AS rpm, coalesce(cpm, 0.0) AS cpm, '1998' AS period_label,
    DATE '1998-01-01' AS period_start, DATE '1998-12-31' AS period_end FROM revenue WHERE slug <> 'login'""", "revenue"),
)
def _(spark, sf):
    """Money with currency signs and separators, blank pages, one unknown column."""
    path = scratch_dir(spark, "csv")
    rows = B.revenue(spark, sf)
    rows.select(
        F.when(F.col("slug") == "login", " ").otherwise(F.col("slug")).alias("Page Path"),
        F.format_number("views", 0).alias("Page Views"),
        F.concat(F.lit("$"), F.format_number(F.col("revenue").cast("double"), 4)).alias("Estimated Revenue"),
        F.col("rpm").alias("Page RPM"), F.concat(F.col("cpm").cast("string"), F.lit(" ")).alias("CPM"), F.lit("x").alias("Notes"),
    ).write.option("header", True).csv(path)
    out = RS.read_revenue_csv(spark, path, "1998", 1)
    return out.select("blog_id", "slug", "views", F.col("revenue").cast("double").alias("revenue"), "rpm", "cpm", "period_label", "period_start", "period_end")


def snapshot_rows(spark, sf, where):
    return B.revenue(spark, sf).filter(where)


RCOLS = "slug, views, CAST(revenue AS DOUBLE) AS revenue, import_batch, period_label"
AGG = """SELECT slug, period_label, CAST(sum(views) AS BIGINT) AS views, CAST(sum(revenue) AS DOUBLE) AS revenue FROM revenue WHERE {} GROUP BY 1, 2"""
OLD, NEW = "post_id % 4 <> 0", "post_id % 3 <> 0 OR post_id IS NULL"
# Every period of the first run comes again in the second, so stale rows of all of them are known.
BOTH = "n FULL JOIN (SELECT * FROM o WHERE period_label IN (SELECT period_label FROM n)) o ON o.slug = n.slug AND o.period_label = n.period_label"
COUNTS = f"""SELECT coalesce(n.period_label, o.period_label) AS period_label, count(*) FILTER (o.slug IS NULL) AS inserts,
 count(*) FILTER (o.slug IS NOT NULL AND n.slug IS NOT NULL) AS replaces, count(*) FILTER (n.slug IS NULL) AS deletes FROM {BOTH} GROUP BY 1"""
FIRST = "try_cast(concat(period_label, '-01') AS DATE)"  # of a month; other periods have no dates
BATCH = f"""concat('feed-site1examplecom-b1-', period_label, '-', substr(sha256(concat_ws(chr(0), 'feed', 'site1.example.com', '1', period_label,
 coalesce(CAST({FIRST} AS STRING), ''), coalesce(CAST(last_day({FIRST}) AS STRING), ''))), 1, 12))"""
SCOPE = dict(blog_id=1, source="Feed", site="Site1.example.com", period="period_label", imported_at=B.AS_OF)


def ingest(spark, sf, target, stage, where, **more):
    rows = snapshot_rows(spark, sf, where).withColumn("period", F.col("period_label"))
    return RS.ingest_periods(rows, B.content(spark, sf), target, f"{target}-stage{stage}", **{**SCOPE, "period": "period", **more})


@query("io05_replace_snapshot", B.duck(f"SELECT slug, views, revenue, {BATCH} AS import_batch, period_label FROM n", "revenue", n=AGG.format(NEW)))
def _(spark, sf):
    target = scratch_dir(spark, "revenue")
    for i, where in enumerate((OLD, NEW)):
        ingest(spark, sf, target, i, where)
    return spark.read.parquet(target).selectExpr(*RCOLS.split(", "))


@query("io05_replace_snapshot__counts", B.duck(COUNTS, "revenue", o=AGG.format(OLD), n=AGG.format(NEW)))
def _(spark, sf):
    target = scratch_dir(spark, "revenue")
    ingest(spark, sf, target, 0, OLD)
    return ingest(spark, sf, target, 1, NEW, dry_run=True)


@query(
    "io06_additive_snapshot",
    B.duck(f"""SELECT coalesce(n.slug, o.slug) AS slug, coalesce(n.views, o.views) AS views, coalesce(n.revenue, o.revenue) AS revenue, 'extra-1' AS import_batch,
    coalesce(n.period_label, o.period_label) AS period_label FROM {BOTH}""", "revenue", o=AGG.format(OLD), n=AGG.format(NEW)),
)
def _(spark, sf):
    target = scratch_dir(spark, "revenue")
    for i, where in enumerate((OLD, NEW)):
        ingest(spark, sf, target, i, where, mode="additive", snapshot="extra-1")
    return spark.read.parquet(target).selectExpr(*RCOLS.split(", "))


@query(
    "io05_resolved_content",
    B.duck(f"""SELECT slug, n.period_label, CASE WHEN pid > 0 THEN pid WHEN m = 1 THEN fid ELSE pid END AS post_id, CASE WHEN pid > 0 THEN 1 WHEN m = 1 THEN fbid END AS content_blog_id, page AS url, link AS canonical_url FROM
    (SELECT slug, period_label, coalesce(min(post_id) FILTER (post_id > 0), max(post_id)) AS pid, min(coalesce(nullif(slug, ''), '')) AS page FROM revenue GROUP BY 1, 2) n
    LEFT JOIN (SELECT trim(regexp_extract(url, '{S.SPLIT}', 3), '/') AS cp, count(*) AS m, min(post_id) AS fid, min(blog_id) AS fbid FROM content WHERE status = 'publish' GROUP BY 1) f ON f.cp = n.slug AND n.slug <> '' AND coalesce(pid, 0) <= 0
    LEFT JOIN (SELECT post_id AS lp, blog_id AS lb, min(url) AS link FROM content WHERE status = 'publish' GROUP BY 1, 2) l
      ON lp = CASE WHEN pid > 0 THEN pid WHEN m = 1 THEN fid END AND lb = CASE WHEN pid > 0 THEN 1 WHEN m = 1 THEN fbid END""", "revenue", "content"),
)
def _(spark, sf):
    """What the ingest resolves itself: the stored rows name their content and its address."""
    target = scratch_dir(spark, "revenue")
    ingest(spark, sf, target, 0, "true")
    return spark.read.parquet(target).select("slug", "period_label", "post_id", "content_blog_id", "url", "canonical_url")


@query(
    "j11_snapshot_plan",
    B.duck(f"""SELECT coalesce(n.period_label, o.period_label) AS period_label, coalesce(n.slug, o.slug) AS slug, CASE WHEN n.slug IS NULL THEN 'delete' WHEN o.slug IS NULL THEN 'insert' ELSE 'replace' END AS action
    FROM n FULL JOIN o ON o.slug = n.slug AND o.period_label = n.period_label""", "revenue", o=AGG.format(OLD), n=AGG.format(NEW)),
)
def _(spark, sf):
    old, new = (RS.normalize_revenue(snapshot_rows(spark, sf, w), "period_label") for w in (OLD, NEW))
    return RS.ingestion_plan(new, old, by=("period_label",))


PATHS = "SELECT DISTINCT CASE WHEN pk % 9 = 0 THEN '/' ELSE concat('/post-', CAST(pk AS STRING), '/') END AS path FROM (SELECT l_partkey AS pk FROM lineitem)"


@query(
    "j16_path_resolution",
    B.duck(f"""SELECT path, coalesce(m, 0) AS matches, CASE WHEN m = 1 THEN pid END AS post_id, CASE WHEN m = 1 THEN bid END AS content_blog_id,
    CASE WHEN m = 1 THEN 'resolved' WHEN m > 1 THEN 'ambiguous' ELSE 'missing' END AS status FROM p LEFT JOIN
    (SELECT concat('/', trim(regexp_extract(url, '{S.SPLIT}', 3), '/'), '/') AS cp, count(*) AS m, min(post_id) AS pid, min(blog_id) AS bid FROM content WHERE status = 'publish' GROUP BY 1) ON cp = path""",
           "content", p=PATHS),
)
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    paths = line.selectExpr("CASE WHEN l_partkey % 9 = 0 THEN '/' ELSE concat('/post-', CAST(l_partkey AS STRING), '/') END AS path").distinct()
    out = RS.resolve_paths(paths, B.content(spark, sf))
    RS.require_complete(paths, out)
    return out


@query(
    "e17_snapshot_identity",
    """SELECT blog, period, concat(rtrim(substr(concat('ad-feed-site', CAST(blog AS STRING), 'examplecom-b', CAST(blog AS STRING), '-', period), 1, 51), '-'), '-',
    substr(sha256(concat_ws(chr(0), 'ad-feed', concat('site', CAST(blog AS STRING), '.example.com'), CAST(blog AS STRING), period, concat(period, '-01'), CAST(last_day(CAST(concat(period, '-01') AS DATE)) AS STRING))), 1, 12)) AS batch
    FROM (SELECT DISTINCT CAST(1 + l_suppkey % 7 AS INT) AS blog, strftime(l_shipdate, '%Y-%m') AS period FROM lineitem)""",
)
def _(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    keys = line.select((1 + F.col("l_suppkey") % 7).cast("int").alias("blog"), F.date_format("l_shipdate", "yyyy-MM").alias("period")).distinct()
    site = F.concat(F.lit("Site"), F.col("blog").cast("string"), F.lit(".example.com"))
    return keys.withColumn("batch", RS.snapshot_identity(F.lit(" Ad-Feed"), site, F.col("blog"), F.col("period")))


# ---- retention, privacy, repair -------------------------------------------------------

CUT = "TIMESTAMP '2024-01-21'"
MAIL = ["newsletter_signup", "user_registration"]


def stored(spark, sf, types, where="true"):
    """A bronze table by day in the scratch folder, and before its first day one that holds rows of ``types`` alone."""
    path = scratch_dir(spark, "stored")
    rows = B.bronze(spark, sf)
    lone = rows.filter(F.col("event_type").isin(types)).filter(where).withColumn("created_at", F.to_timestamp(F.lit("2023-11-30")))
    every = rows.unionByName(lone).withColumn("event_date", F.to_date("created_at"))
    every.write.partitionBy("event_date").parquet(path)
    return path


@query("io11_retention_purge", B.duck(f"SELECT id, event_type, created_at FROM e WHERE NOT (event_type = '404_error' AND created_at < {CUT})"))
def _(spark, sf):
    path = stored(spark, sf, ["404_error"])
    M.purge_days(spark, path, f"{path}-stage", ["404_error"], B.AS_OF - timedelta(days=10))
    return spark.read.parquet(path).select("id", "event_type", "created_at")


@query("io11_retention_purge__dry_run", B.duck(f"SELECT count(*) AS purged FROM e WHERE event_type = '404_error' AND created_at < {CUT}"))
def _(spark, sf):
    return M.purge_404(B.bronze(spark, sf), B.AS_OF, days=10)[1]


@query(
    "io12_scrub_email_pii",
    B.duck(f"""SELECT id, event_type, context, CASE WHEN {types_in(MAIL)} THEN NULL ELSE variant END AS variant, CASE WHEN {types_in(MAIL)} THEN false ELSE id % 13 = 0 END AS broken
    FROM e WHERE NOT ({types_in(MAIL)} AND id % 13 = 0)"""),
)
def _(spark, sf):
    broken = F.when(F.col("id") % 13 == 0, F.concat(F.col("event_data"), F.lit("x"))).otherwise(F.col("event_data"))
    rows = B.bronze(spark, sf).withColumn("context", EV.payload_field("context")).withColumn("variant", EV.payload_field("variant"))
    out = M.scrub_email_pii(rows.withColumn("event_data", broken), MAIL)
    mail = F.col("event_type").isin(MAIL)
    return out.select(
        "id", "event_type",
        F.when(mail, EV.payload_field("context")).otherwise(F.col("context")).alias("context"),
        F.when(mail, EV.payload_field("variant")).otherwise(F.col("variant")).alias("variant"),
        (~F.col("event_data").rlike(r"\}$")).alias("broken"),
    )


@query(
    "io13_subject_export",
    B.duck(f"SELECT id, event_type, created_at, CAST(NULL AS STRING) AS recipient_count, context, CAST(NULL AS STRING) AS error_code FROM e WHERE {types_in(MAIL)} AND user_id = 42 AND id <= 9000"),
)
def _(spark, sf):
    return M.export_user_events(B.bronze(spark, sf), 42, 9000, MAIL)


@query("io14_subject_erase", B.duck(f"SELECT id, event_type FROM e WHERE NOT coalesce({types_in(MAIL)} AND user_id = 42, false)"))
def _(spark, sf):
    path = stored(spark, sf, MAIL, "user_id = 42")
    M.erase_days(spark, path, f"{path}-stage", 42, MAIL)
    return spark.read.parquet(path).select("id", "event_type")


@query(
    "io15_is_bot_backfill",
    B.duck("SELECT id, coalesce(is_bot, CASE WHEN event_type = 'search' THEN CASE WHEN visitor_id <> '' THEN 'false' ELSE 'true' END END) AS is_bot, context FROM e"),
)
def _(spark, sf):
    out, _totals = M.backfill_is_bot(B.bronze(spark, sf), "search")
    return out.select("id", EV.payload_field("is_bot").alias("is_bot"), EV.payload_field("context").alias("context"))


@query(
    "io15_is_bot_backfill__totals",
    B.duck("""SELECT count(*) AS scanned, count(*) FILTER (is_bot IS NULL AND event_type = 'search' AND visitor_id <> '') AS set_human,
    count(*) FILTER (is_bot IS NULL AND event_type = 'search' AND visitor_id IS NULL) AS set_bot FROM e"""),
)
def _(spark, sf):
    return M.backfill_is_bot(B.bronze(spark, sf), "search")[1]


@query(
    "io16_pageview_is_bot_fix",
    B.duck("SELECT id, CASE WHEN event_type = 'pageview' AND visitor_id <> '' AND is_bot = 'true' THEN 'false' ELSE is_bot END AS is_bot FROM e"),
)
def _(spark, sf):
    return M.fix_pageview_is_bot(B.bronze(spark, sf))[0].select("id", EV.payload_field("is_bot").alias("is_bot"))


@query(
    "io16_pageview_is_bot_fix__totals",
    B.duck("""SELECT count(*) FILTER (event_type = 'pageview') AS scanned, count(*) FILTER (event_type = 'pageview' AND visitor_id <> '' AND is_bot = 'true') AS corrected FROM e"""),
)
def _(spark, sf):
    return M.fix_pageview_is_bot(B.bronze(spark, sf))[1]


PURL = "SELECT page_id, CASE WHEN page_id % 10 = 3 THEN replace(url, 'http', 'ftp') WHEN page_id % 10 = 4 THEN '' ELSE url END AS source_url FROM pages"


def page_urls(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").selectExpr(
        "page_id", "CASE WHEN page_id % 10 = 3 THEN replace(url, 'http', 'ftp') WHEN page_id % 10 = 4 THEN '' ELSE url END AS source_url"
    )


@query("io17_source_url_redaction", B.duck(f"SELECT page_id, {S.canonical_url('source_url')} AS source_url FROM p", "content", p=PURL))
def _(spark, sf):
    return M.redact_source_urls(page_urls(spark, sf))[0]


@query(
    "io17_source_url_redaction__totals",
    B.duck("""SELECT count(*) AS scanned, count(*) FILTER (c <> '' AND c <> u) AS redacted, count(*) FILTER (c = '' AND u <> '') AS invalid FROM c""",
           "content", p=PURL, c=f"SELECT source_url AS u, {S.canonical_url('source_url')} AS c FROM p"),
)
def _(spark, sf):
    return M.redact_source_urls(page_urls(spark, sf))[1]


# ---- admission ------------------------------------------------------------------------

SITES = [("site1.example.com", "main"), ("site2.example.com", "events"), ("site3.example.com", "community")]
DATA = """CASE WHEN id % 17 = 0 THEN 'not json' WHEN event_type = 'outbound_click' THEN concat('{"dest_host":"', coalesce(dest_host, ''), '","dest_url":"', CASE WHEN id % 7 = 0 THEN 'ftp://x/' ELSE dest_url END, '","is_bot":true}')
 ELSE concat('{"dest_site":', CASE WHEN id % 11 = 0 THEN '12' ELSE concat('"', coalesce(dest_site, ''), '"') END, ',"source_post":', CASE WHEN id % 13 = 0 THEN '"abc"' ELSE CAST(blog_id AS STRING) END,
  CASE WHEN id % 19 = 0 THEN ',"extra":1' ELSE '' END, ',"term":"', CASE WHEN id % 23 = 0 THEN repeat('t', 201) ELSE 'jazz' END, '"}') END"""
HOST = "CASE WHEN id % 5 = 0 THEN 'evil.example.net' ELSE concat('site', CAST(blog_id AS STRING), '.example.com') END"
SRC = "CASE WHEN id % 29 = 0 THEN '' WHEN id % 31 = 0 THEN 'https://site2.example.com/a' ELSE concat('https://site', CAST(blog_id AS STRING), '.example.com/p//q?z=1') END"
ADMIT = f"""SELECT id, event_type, CASE WHEN event_type NOT IN ('bridge_click', 'bridge_impression', 'outbound_click', 'share_click') THEN 'unsupported_type'
 WHEN o NOT IN ('site1.example.com', 'site2.example.com', 'site3.example.com') THEN 'invalid_event_origin' WHEN s <> '' AND {S.host("s")} <> o THEN 'invalid_event_source' WHEN s = '' THEN 'invalid_event_source'
 WHEN d = 'not json' THEN 'invalid_event_data' WHEN event_type <> 'outbound_click' AND id % 19 = 0 THEN 'unsupported_field'
 WHEN event_type <> 'outbound_click' AND (id % 11 = 0 OR id % 13 = 0 OR id % 23 = 0) THEN 'invalid_event_field' WHEN event_type = 'outbound_click' AND (id % 7 = 0 OR {S.canonical_url("dest_url")} = '') THEN 'invalid_url'
 WHEN event_type <> 'outbound_click' AND coalesce(dest_site, '') NOT IN ('', 'main', 'events', 'community') THEN 'unknown_site' END AS reject_reason FROM
 (SELECT *, {DATA} AS d, {HOST} AS o, {SRC} AS s FROM e)"""


def browser_events(spark, sf):
    return B.events(spark, sf).selectExpr("id", "event_type", f"{DATA} AS event_data", f"{SRC} AS source_url", f"{HOST} AS origin_host")


def sites(spark):
    return spark.createDataFrame(SITES, "host string, site string")


@query("io20_admission_quarantine", B.duck(f"SELECT * FROM ({ADMIT}) WHERE reject_reason IS NOT NULL"))
def _(spark, sf):
    return EV.admit_events(browser_events(spark, sf), sites(spark))[1].select("id", "event_type", "reject_reason")


@query(
    "io20_admission_quarantine__accepted",
    B.duck(f"""SELECT id, a.event_type, CASE WHEN a.event_type <> 'outbound_click' THEN coalesce(dest_site, '') END AS dest_site, CASE WHEN a.event_type <> 'outbound_click' THEN blog_id END AS source_post,
    CASE WHEN a.event_type = 'outbound_click' THEN {S.canonical_url("dest_url")} END AS dest_url, CAST(NULL AS STRING) AS is_bot, {S.canonical_url(SRC)} AS source_url
    FROM ({ADMIT}) a JOIN (SELECT * EXCLUDE (event_type) FROM e) USING (id) WHERE reject_reason IS NULL"""),
)
def _(spark, sf):
    ok = EV.admit_events(browser_events(spark, sf), sites(spark))[0]
    return ok.select(
        "id", "event_type", EV.payload_field("dest_site").alias("dest_site"), EV.payload_field("source_post", "int").alias("source_post"),
        EV.payload_field("dest_url").alias("dest_url"), EV.payload_field("is_bot").alias("is_bot"), "source_url",
    )


XDATA = """concat('{"experiment_key":"', experiment_key, '","definition_version":', CAST(definition_version AS STRING), ',"assignment_policy":"', assignment_policy, '","variant":"', variant,
 '"', CASE WHEN id % 19 = 0 THEN '' ELSE concat(',"surface":"', surface, '"') END, '}')"""


@query(
    "io21_experiment_admission",
    B.duck("""SELECT id, CASE WHEN id % 19 = 0 THEN 'invalid_fields' WHEN assignment_policy = 'Bad Policy' THEN 'invalid_identifier' WHEN definition_version = 0 THEN 'invalid_version'
    WHEN visitor_id IS NULL AND coalesce(user_id, 0) <= 0 THEN 'no_identity' END AS reject_reason FROM e WHERE event_type IN ('experiment_assignment', 'experiment_exposure')"""),
)
def _(spark, sf):
    rows = B.events(spark, sf).filter("event_type IN ('experiment_assignment', 'experiment_exposure')").selectExpr("id", "visitor_id", "user_id", f"{XDATA} AS event_data")
    ok, bad = EV.admit_experiment_rows(rows)
    return ok.select("id", F.lit(None).cast("string").alias("reject_reason")).unionByName(bad.select("id", "reject_reason"))


@query(
    "e21_email_minimiser",
    """SELECT conv_id, turn, len(list_filter(string_split_regex(text, '\\s*,\\s*'), lambda x: x <> ''))::INTEGER AS recipients,
    coalesce(nullif(regexp_replace(lower(text), '[^a-z0-9:_\\-]', '', 'g'), ''), 'unknown') AS context FROM conversations""",
)
def _(spark, sf):
    rows = spark.read.parquet(f"{sf}/conversations.parquet")
    count, context = M.minimize_email(F.col("text"), F.col("text"))
    return rows.select("conv_id", "turn", count.alias("recipients"), context.alias("context"))


@query(
    "e16_revenue_normalisers",
    r"""SELECT page_id, path, slug_key, number FROM (SELECT page_id, CASE WHEN p = '' THEN '/' ELSE concat('/', p, '/') END AS path, p AS slug_key, CAST(regexp_replace(html, '[^0-9]', '', 'g') AS DOUBLE) AS number
    FROM (SELECT *, trim(regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1), '/') AS p FROM pages))""",
)
def _(spark, sf):
    from ..functions import urls

    pages = spark.read.parquet(f"{sf}/pages.parquet")
    rest = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    digits = F.regexp_replace("html", r"[^0-9]", "")
    return pages.select(
        "page_id", urls.frontend_path(rest).alias("path"), urls.slug_key(rest).alias("slug_key"),
        urls.clean_number(F.concat(F.lit("$ "), digits, F.lit(" USD"))).alias("number"),
    )
