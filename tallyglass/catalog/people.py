"""Activation funnel, conversion map, outcomes and crosslinks."""

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions.rules import ACTIVATION_STEPS, CONVERSION_OUTCOMES
from ..operators import identity as ID
from ..plans import people as PP
from ..plans.journeys import epoch
from ..sources import bind as B
from . import query
from .rules_sql import SPLIT, host, lit

FRICTION, ACCESS = ["user_registration", "artist_profile_duplicate_created"], ["newsletter_signup"]
SINCE, UNTIL = epoch(B.AS_OF - timedelta(days=28)), epoch(B.AS_OF)
EU = "coalesce(payload_user_id, user_id, 0)"


def bridge_sql(rows: str) -> str:
    return f"""SELECT visitor_id, min({EU}) AS bu FROM {rows} WHERE {EU} > 0 AND visitor_id <> '' GROUP BY 1
    HAVING count(DISTINCT {EU}) = 1"""


def person_sql(rows: str, bridge: str, fallback: str = "''") -> str:
    return f"""SELECT x.*, CASE WHEN {EU} > 0 THEN concat('user:', CAST({EU} AS STRING)) WHEN bu IS NOT NULL
    THEN concat('user:', CAST(bu AS STRING)) WHEN x.visitor_id <> '' THEN concat('visitor:', x.visitor_id) ELSE {fallback} END AS person
    FROM {rows} x LEFT JOIN {bridge} b ON x.visitor_id = b.visitor_id"""


def types_in(types) -> str:
    return f"event_type IN ({', '.join(map(lit, types))})"


FU = {
    "r": f"SELECT * FROM e WHERE {types_in([*ACTIVATION_STEPS, *FRICTION, *ACCESS])} AND ts BETWEEN {SINCE} AND {UNTIL}",
    "b": bridge_sql("r"),
    "p": f"SELECT * FROM ({person_sql('r', 'b')}) WHERE person <> ''",
}


def _step(i: int) -> str:
    if i == 0:
        return f"SELECT person, min(ts * 1000000000 + id) AS at FROM p WHERE event_type = {lit(ACTIVATION_STEPS[0])} GROUP BY 1"
    return f"""SELECT p.person, min(ts * 1000000000 + id) AS at FROM p JOIN s{i - 1} ON p.person = s{i - 1}.person
    AND ts * 1000000000 + id > s{i - 1}.at WHERE event_type = {lit(ACTIVATION_STEPS[i])} GROUP BY 1"""


STEPS = {**FU, "s0": _step(0), "s1": _step(1), "s2": _step(2)}
STEPS["n"] = " UNION ALL ".join(
    f"SELECT {i} AS index, {lit(s)} AS event_type, (SELECT count(*) FROM s{i}) AS people" for i, s in enumerate(ACTIVATION_STEPS)
)
STEP_SQL = B.duck(f"""SELECT index, event_type, people, CASE WHEN index = 0 THEN 1.0::DOUBLE ELSE {B.sql_ratio("people", "prev", 4, "0.0")} END AS conversion_from_prev,
    {B.sql_ratio("people", "top", 4, "0.0")} AS conversion_from_top FROM
    (SELECT *, lag(people) OVER (ORDER BY index) AS prev, first_value(people) OVER (ORDER BY index) AS top FROM n)""", **STEPS)
SUMMARY_SQL = B.duck(f"""SELECT {B.sql_ratio("(SELECT people FROM n WHERE index = 2)", "(SELECT people FROM n WHERE index = 0)", 4, "0.0")} AS overall_conversion,
    from_step, event_type AS to_step, prev - people AS dropped, {B.sql_round("1 - people / prev", 4)} AS drop_rate FROM
    (SELECT *, lag(people) OVER (ORDER BY index) AS prev, lag(event_type) OVER (ORDER BY index) AS from_step FROM n)
    WHERE prev > 0 ORDER BY 1 - people / prev DESC, index LIMIT 1""", **STEPS)


def funnel(spark, sf):
    return PP.ActivationFunnel(B.events(spark, sf), B.AS_OF, friction=FRICTION, access=ACCESS)


@query("r20_activation_funnel", STEP_SQL)
def _(spark, sf):
    return funnel(spark, sf).steps()


@query("w09_ordered_funnel", B.duck("SELECT * FROM n", **STEPS))
def _(spark, sf):
    return funnel(spark, sf).counted()


@query("r20_activation_funnel__summary", SUMMARY_SQL)
def _(spark, sf):
    return funnel(spark, sf).summary()


@query("w10_funnel_rates", SUMMARY_SQL)
def _(spark, sf):
    return funnel(spark, sf).summary()


@query(
    "r20_activation_funnel__reach",
    B.duck("""SELECT kind, k.event_type, count(DISTINCT person) AS people, count(person) AS events FROM
    (VALUES ('anomaly', 'user_registration'), ('anomaly', 'artist_profile_duplicate_created'), ('access', 'newsletter_signup')) k(kind, event_type)
    LEFT JOIN p ON p.event_type = k.event_type GROUP BY 1, 2""", **FU),
)
def _(spark, sf):
    return funnel(spark, sf).reach()


@query("j06_identity_bridge", B.duck("SELECT visitor_id, bu AS bridged_user FROM b", b=bridge_sql("e")))
def _(spark, sf):
    return ID.identity_bridge(B.events(spark, sf))


@query(
    "j06_identity_bridge__ambiguous",
    B.duck(f"""SELECT count(*) FILTER (n = 1) AS unambiguous_identity_bridges, count(*) FILTER (n > 1) AS ambiguous_visitor_ids FROM
    (SELECT visitor_id, count(DISTINCT {EU}) AS n FROM e WHERE {EU} > 0 AND visitor_id <> '' GROUP BY 1)"""),
)
def _(spark, sf):
    return ID.ambiguous_visitors(B.events(spark, sf))


@query(
    "e15_person_key",
    B.duck(f"SELECT id, person FROM ({person_sql('e', 'b', chr(39) + 'event:' + chr(39) + ' || CAST(x.id AS STRING)')})", b=bridge_sql("e")),
)
def _(spark, sf):
    e = B.events(spark, sf)
    return ID.with_person(e, ID.identity_bridge(e), event_fallback=True).select("id", "person")


# ---- conversion map -------------------------------------------------------------------

GAP = B.GAP_12H
MATURE = epoch(B.AS_OF - timedelta(days=7))
POSTS = "SELECT * FROM content WHERE blog_id = 1 AND post_type = 'post' AND status = 'publish'"
CM = {
    "posts": POSTS,
    "pv0": f"SELECT * FROM e WHERE event_type = 'pageview' AND visitor_id <> '' AND ts >= {SINCE - GAP} AND ts < {UNTIL}",
    "pv": "SELECT * FROM pv0 WHERE visitor_id IN (SELECT visitor_id FROM pv0 WHERE blog_id = 1)",
    "g": f"SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY visitor_id ORDER BY ts, id) <= {GAP} THEN 0 ELSE 1 END AS brk FROM pv",
    "q": "SELECT *, sum(brk) OVER (PARTITION BY visitor_id ORDER BY ts, id) AS sess FROM g",
    "z": """SELECT visitor_id, sess, min(ts) AS s0, max(ts) AS s1, arg_min(blog_id, struct_pack(a := ts, b := id)) AS fb,
      arg_min(coalesce(post_id, -1), struct_pack(a := ts, b := id)) AS fp FROM q GROUP BY 1, 2""",
    "j0": f"""SELECT visitor_id, min(sess) AS es FROM z WHERE fb = 1 AND s0 BETWEEN {SINCE} AND {MATURE}
      AND fp IN (SELECT post_id FROM posts) GROUP BY 1""",
    "j": f"""SELECT j0.visitor_id, es, s0 AS entry_ts, s1 + {GAP} AS through, fp AS post_id FROM j0 JOIN z ON z.visitor_id = j0.visitor_id AND sess = es""",
    "f": """SELECT j.visitor_id, j.post_id, entry_ts, through, bool_or(sess > es) AS returned,
      bool_or(sess = es AND q.blog_id = 2) AS events_same, bool_or(sess = es AND q.blog_id = 3) AS community_same, bool_or(sess = es AND q.blog_id = 4) AS artist_same,
      bool_or(sess = es AND q.blog_id IN (2,3,4)) AS any_same,
      bool_or(sess > es AND q.blog_id = 2) AS events_return, bool_or(sess > es AND q.blog_id = 3) AS community_return, bool_or(sess > es AND q.blog_id = 4) AS artist_return,
      bool_or(sess > es AND q.blog_id IN (2,3,4)) AS any_return, bool_or(sess >= es AND q.blog_id IN (2,3,4)) AS "any"
      FROM j JOIN q ON q.visitor_id = j.visitor_id GROUP BY 1, 2, 3, 4""",
}
_FLAGS = [f"{n}_{s}" for s in ("same", "return") for n in ("events", "community", "artist", "any")]
RATES = ", ".join(
    ["count(*) AS entry_sessions", 'count(*) FILTER ("any") AS reached_any',
     B.sql_ratio('count(*) FILTER ("any")', "count(*)", 4, "0.0") + " AS reached_any_rate"]
    + [B.sql_ratio(f"count(*) FILTER ({f})", "count(*)", 4, "0.0") + f" AS {f}_rate" for f in _FLAGS]
    + [B.sql_ratio("count(*) FILTER (returned)", "count(*)", 4, "0.0") + " AS returned_rate", "count(*) FILTER (returned) AS returned_count"]
)
PATH = f"regexp_extract(url, '{SPLIT}', 3)"


def conversion(spark, sf, **kw):
    return PP.ConversionMap(
        B.events(spark, sf), B.content(spark, sf), B.content_terms(spark, sf), B.AS_OF, gap=GAP,
        entry_host=B.ENTRY_HOST, **kw,
    )


OVERALL = B.duck(f"SELECT {RATES} FROM f", "e", "content", **CM)


@query("r18_conversion_map", OVERALL)
def _(spark, sf):
    return conversion(spark, sf).overall()


@query("a24_reach_flags", OVERALL)
def _(spark, sf):
    return conversion(spark, sf).overall()


@query(
    "w08_return_reach",
    B.duck(f"SELECT visitor_id, returned, {', '.join(_FLAGS)} FROM f", "e", "content", **CM),
)
def _(spark, sf):
    return conversion(spark, sf).journeys().select("visitor_id", "returned", *_FLAGS)


ENTRY = B.duck("SELECT visitor_id, post_id, entry_ts, through AS same_session_through FROM f", "e", "content", **CM)


@query("w07_entry_journeys", ENTRY)
def _(spark, sf):
    return conversion(spark, sf).journeys().select("visitor_id", "post_id", "entry_ts", "same_session_through")


@query("f13_mature_entries", ENTRY)
def _(spark, sf):
    return conversion(spark, sf).journeys().select("visitor_id", "post_id", "entry_ts", "same_session_through")


@query(
    "j01_left_semi_entry_visitors",
    B.duck("SELECT id, visitor_id, ts FROM pv", "e", "content", **{k: CM[k] for k in ("pv0", "pv")}),
)
def _(spark, sf):
    return conversion(spark, sf).pageviews().select("id", "visitor_id", "ts")


BY_ARTICLE = f"""SELECT a.*, coalesce(title, '(unknown)') AS title, coalesce(slug, '') AS slug, coalesce({PATH}, '') AS path FROM
 (SELECT post_id, {RATES} FROM f GROUP BY 1 ORDER BY entry_sessions DESC, 1 LIMIT 25) a LEFT JOIN posts USING (post_id)"""


@query("r18_conversion_map__by_article", B.duck(BY_ARTICLE, "e", "content", **CM))
def _(spark, sf):
    return conversion(spark, sf).by_article()


BY_CATEGORY = f"""SELECT term_id, t.name AS category, {RATES} FROM f JOIN (SELECT * FROM terms WHERE blog_id = 1) t
 ON t.post_id = f.post_id GROUP BY 1, 2 HAVING count(*) >= 2"""


@query("r18_conversion_map__by_category", B.duck(BY_CATEGORY, "e", "content", "terms", **CM))
def _(spark, sf):
    return conversion(spark, sf).by_category(min_entry_sessions=2)


@query("j19_category_fan_out", B.duck(BY_CATEGORY.replace(">= 2", ">= 1"), "e", "content", "terms", **CM))
def _(spark, sf):
    return conversion(spark, sf).by_category()


@query("f14_having_thresholds", B.duck(BY_CATEGORY.replace(">= 2", ">= 5"), "e", "content", "terms", **CM))
def _(spark, sf):
    return conversion(spark, sf).by_category(min_entry_sessions=5)


def _outcome_ctes(author: int) -> dict[str, str]:
    mine = f"author_id = {author}" if author else "true"
    scope = "WHERE direct_post IS NOT NULL OR has_journey" if author else ""
    base = {k: (v.replace("SELECT post_id FROM posts)", f"SELECT post_id FROM posts WHERE {mine})")) for k, v in CM.items()}
    return {
        **base,
        "o0": f"""SELECT *, coalesce(event_type = 'newsletter_signup' AND context = 'registration', false) AS excluded FROM e
          WHERE {types_in(CONVERSION_OUTCOMES)} AND ts >= {SINCE} AND ts < {UNTIL}""",
        "ok": "SELECT * FROM o0 WHERE NOT excluded",
        "b": bridge_sql("ok"),
        "o1": person_sql("o0", "b", "concat('event:', CAST(x.id AS STRING))"),
        "o2": f"""SELECT o1.*, resolved, CASE WHEN {mine.replace('author_id', 'pauthor')} THEN resolved END AS direct_post FROM o1 LEFT JOIN
          (SELECT rtrim({PATH}, '/') AS ppath, min(post_id) AS resolved, arg_min(author_id, post_id) AS pauthor FROM posts GROUP BY 1)
          ON ppath = rtrim(regexp_extract(source_url, '{SPLIT}', 3), '/') AND regexp_replace({host('source_url')}, '^www\\.', '') = '{B.ENTRY_HOST}'""",
        "o3": """SELECT o2.*, f.post_id AS jpost, entry_ts IS NOT NULL AS has_journey, CASE WHEN ts >= entry_ts THEN
          CASE WHEN ts <= through THEN 'same_session' ELSE 'later_session' END END AS stage FROM o2 LEFT JOIN f USING (visitor_id)""",
        "o": f"SELECT * FROM o3 {scope}",
        "rec": f"""SELECT event_type, person, count(*) AS n, bool_or(trim(source_url) <> '') AS src,
          bool_or({'true' if author else 'false'} AND resolved IS NOT NULL AND direct_post IS NULL) AS outside,
          arg_min(direct_post, ts * 1000000000 + id) FILTER (direct_post IS NOT NULL) AS direct_post, bool_or(coalesce(visitor_id <> '', false)) AS vis,
          bool_or(has_journey AND stage IS NULL) AS bef, arg_min(stage, ts * 1000000000 + id) FILTER (stage IS NOT NULL) AS stage,
          arg_min(jpost, ts * 1000000000 + id) FILTER (stage IS NOT NULL) AS jpost FROM o WHERE NOT excluded GROUP BY 1, 2""",
        "cov0": """SELECT k.event_type, gap, coalesce(stored_events, 0) AS stored_events, coalesce(automatic_registration_excluded, 0) AS automatic_registration_excluded,
          coalesce(deduplicated_outcomes, 0) AS deduplicated_outcomes, CAST(coalesce(duplicate_events, 0) AS BIGINT) AS duplicate_events,
          coalesce(with_source_url, 0) AS with_source_url, coalesce(direct_source_attributed, 0) AS direct_source_attributed,
          coalesce(missing_source_url, 0) AS missing_source_url, coalesce(unresolved_source_url, 0) AS unresolved_source_url,
          coalesce(source_outside_scope, 0) AS source_outside_scope, coalesce(with_visitor_identity, 0) AS with_visitor_identity,
          coalesce(missing_visitor_identity, 0) AS missing_visitor_identity, coalesce(visitor_journey_attributed, 0) AS visitor_journey_attributed,
          coalesce(identity_without_eligible_journey, 0) AS identity_without_eligible_journey, coalesce(outcome_before_entry, 0) AS outcome_before_entry
          FROM (VALUES ('newsletter_signup', false), ('user_registration', false), ('onboarding_completed', true), ('artist_profile_first_publish', true)) k(event_type, gap)
          LEFT JOIN (SELECT event_type, count(*) AS stored_events, count(*) FILTER (excluded) AS automatic_registration_excluded FROM o GROUP BY 1) a ON a.event_type = k.event_type
          LEFT JOIN (SELECT event_type, count(*) AS deduplicated_outcomes, sum(n) - count(*) AS duplicate_events,
            count(*) FILTER (direct_post IS NOT NULL OR (NOT outside AND src)) AS with_source_url, count(direct_post) AS direct_source_attributed,
            count(*) FILTER (direct_post IS NULL AND NOT outside AND NOT src) AS missing_source_url,
            count(*) FILTER (direct_post IS NULL AND NOT outside AND src) AS unresolved_source_url,
            count(*) FILTER (direct_post IS NULL AND outside) AS source_outside_scope,
            count(*) FILTER (stage IS NOT NULL OR vis) AS with_visitor_identity, count(*) FILTER (stage IS NULL AND NOT vis) AS missing_visitor_identity,
            count(stage) AS visitor_journey_attributed, count(*) FILTER (stage IS NULL AND vis AND NOT bef) AS identity_without_eligible_journey,
            count(*) FILTER (stage IS NULL AND vis AND bef) AS outcome_before_entry FROM rec GROUP BY 1) t ON t.event_type = k.event_type""",
        "cov": """SELECT *, CASE WHEN stored_events = 0 THEN 'not_observed' ELSE 'observed' END AS instrumentation_status,
          CASE WHEN deduplicated_outcomes = 0 THEN CASE WHEN gap THEN 'not_instrumented' ELSE 'measured' END WHEN with_source_url = 0 THEN 'not_instrumented'
           WHEN direct_source_attributed = deduplicated_outcomes THEN 'measured' ELSE 'partial' END AS direct_source_status,
          CASE WHEN deduplicated_outcomes = 0 THEN CASE WHEN gap THEN 'not_instrumented' ELSE 'measured' END WHEN with_visitor_identity = 0 THEN 'not_instrumented'
           WHEN with_visitor_identity = deduplicated_outcomes THEN 'measured' ELSE 'partial' END AS visitor_journey_status FROM cov0""",
        "sig": """SELECT event_type, direct_post AS post_id, 'direct_source' AS lens FROM rec WHERE direct_post > 0 UNION ALL
          SELECT event_type, jpost, stage FROM rec WHERE jpost > 0 AND stage IS NOT NULL""",
    }


OC = _outcome_ctes(0)
COV_SQL = "SELECT * EXCLUDE (gap) FROM cov"


@query("r19_conversion_outcomes__coverage", B.duck(COV_SQL, "e", "content", **OC))
def _(spark, sf):
    return conversion(spark, sf).coverage()


@query("r19_conversion_outcomes__author_scope", B.duck(COV_SQL, "e", "content", **_outcome_ctes(3)))
def _(spark, sf):
    return conversion(spark, sf, author_id=3).coverage()


@query(
    "r19_conversion_outcomes",
    B.duck("""SELECT event_type, CASE WHEN direct_source_status <> 'not_instrumented' THEN coalesce(d, 0) END AS direct_source, direct_source_status,
    CASE WHEN visitor_journey_status <> 'not_instrumented' THEN coalesce(s, 0) END AS same_session,
    CASE WHEN visitor_journey_status <> 'not_instrumented' THEN coalesce(l, 0) END AS later_session, visitor_journey_status FROM cov LEFT JOIN
    (SELECT event_type, count(direct_post) AS d, count(*) FILTER (stage = 'same_session') AS s, count(*) FILTER (stage = 'later_session') AS l
     FROM rec GROUP BY 1) USING (event_type)""", "e", "content", **OC),
)
def _(spark, sf):
    return conversion(spark, sf).outcomes_overall()


_LC = "count(*) AS attribution_signals, " + ", ".join(f"count(*) FILTER (lens = '{x}') AS {x}" for x in PP.LENSES)


@query(
    "r19_conversion_outcomes__by_article",
    B.duck(f"""SELECT a.*, coalesce(title, '(unknown)') AS title, coalesce(slug, '') AS slug, coalesce({PATH}, '') AS path FROM
    (SELECT post_id, {_LC} FROM sig GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25) a LEFT JOIN posts USING (post_id)""", "e", "content", **OC),
)
def _(spark, sf):
    return conversion(spark, sf).outcomes_by_article()


@query(
    "r19_conversion_outcomes__by_category",
    B.duck(f"""SELECT term_id, t.name AS category, {_LC} FROM sig JOIN (SELECT * FROM terms WHERE blog_id = 1) t
    ON t.post_id = sig.post_id GROUP BY 1, 2""", "e", "content", "terms", **OC),
)
def _(spark, sf):
    return conversion(spark, sf).outcomes_by_category()


@query(
    "j07_journey_outcome_range_join",
    B.duck("SELECT id, event_type, has_journey, stage FROM o", "e", "content", **OC),
)
def _(spark, sf):
    return conversion(spark, sf).outcome_rows().select("id", "event_type", "has_journey", "stage")


@query(
    "j17_direct_source_article",
    B.duck("SELECT id, resolved AS resolved_post, direct_post FROM o", "e", "content", **OC),
)
def _(spark, sf):
    return conversion(spark, sf).outcome_rows().select("id", "resolved_post", "direct_post")


# ---- crosslinks -----------------------------------------------------------------------

EDGES = "SELECT l_suppkey AS source_id, l_partkey AS target_id FROM lineitem"
#: The median page of the test tables has some 30 links.
MAX_INBOUND = 28
INBOUND = """SELECT post_id, coalesce(n, 0) AS inbound_links, coalesce(n, 0) = 0 AS orphan FROM posts LEFT JOIN
 (SELECT target_id, count(*) AS n FROM edges WHERE target_id > 0 AND target_id <> source_id GROUP BY 1) ON target_id = post_id"""


def graph(spark, sf):
    line = spark.read.parquet(f"{sf}/lineitem.parquet")
    edges = line.select(F.col("l_suppkey").alias("source_id"), F.col("l_partkey").alias("target_id"))
    nodes = B.content(spark, sf).filter("blog_id = 1 AND post_type = 'post' AND status = 'publish'")
    return PP.inbound_links(nodes, edges)


@query("a21_inbound_link_counts", B.duck(INBOUND, "content", posts=POSTS, edges=EDGES))
def _(spark, sf):
    return graph(spark, sf)


CROSS = B.duck(f"""SELECT post_id, title, slug, entry_sessions, returned_count AS returned, returned_rate, reached_any, inbound_links, orphan,
    {B.sql_round("returned_count / (inbound_links + 1)", 2)} AS score FROM art JOIN inb USING (post_id)
    WHERE returned_count >= 1 AND inbound_links <= {MAX_INBOUND} ORDER BY score DESC, returned DESC, post_id LIMIT 25""",
    "e", "content", **CM, edges=EDGES, inb=INBOUND, art=BY_ARTICLE.replace("LIMIT 25", ""))


@query("r23_crosslink_targets", CROSS)
def _(spark, sf):
    return PP.crosslink_targets(conversion(spark, sf).by_article(top=None), graph(spark, sf), max_inbound=MAX_INBOUND)


@query("j09_articles_with_link_graph", CROSS)
def _(spark, sf):
    return PP.crosslink_targets(conversion(spark, sf).by_article(top=None), graph(spark, sf), max_inbound=MAX_INBOUND)
