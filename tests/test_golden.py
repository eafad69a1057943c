"""Hand-made rows with known results."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyglass.functions import classify as C
from tallyglass.functions import predicates as P
from tallyglass.functions import urls
from tallyglass.functions.stats import lift, wilson_interval
from tallyglass.functions.windows import exact, relative, resolve
from tallyglass.operators import funnel as FN
from tallyglass.operators import identity as ID
from tallyglass.operators import sessions as S
from tallyglass.plans import journeys as J
from tallyglass.plans import revenue as PR
from tallyglass.sources import revenue_store as RS
from tallyglass.functions import urls as UR
from tallyglass.plans import errors as ER
from tallyglass.plans import growth as GR

ROUTES = [
    ("", 1, "home", 90), ("v1", 1, "singular", 100), ("v1", 1, "singular", 110), ("v1", 7, "home", 120),
    ("v1", 2, "directory", 2001), ("v2", 1, "taxonomy-archive", 100), ("v2", 1, "home", 1900),
    ("v3", 4, "app-account", 100), ("v4", 9, "unclassified", 100),
]
ACQUIRED = [("v1", 100), ("v2", 50), ("v3", 100), ("v4", 100)]


def route_rows(spark, rows):
    data = [(i, *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "id bigint, visitor_id string, blog_id int, route_family string, ts bigint")


def test_route_sessions(spark):
    rows = route_rows(spark, ROUTES).filter(P.identified())
    acq = spark.createDataFrame(ACQUIRED, "visitor_id string, acquisition_ts bigint")
    table = S.with_cohort(S.session_table(rows, 1800), acq).collect()
    assert len(table) == 5
    assert sum(r["cohort"] == "first_time" for r in table) == 3
    assert sum(r["rows"] == 1 for r in table) == 3


def test_transitions_and_sequences(spark):
    rows = route_rows(spark, ROUTES).filter(P.identified())
    trails = S.sessionize(rows, 1800, node=["blog_id", "route_family"], depth=2)
    pairs = S.transitions(trails).collect()
    assert len(pairs) == 3
    assert sum(p["from_node"]["blog_id"] == p["to_node"]["blog_id"] for p in pairs) == 2
    assert S.sequences(trails, 3).count() == 1


def test_boundary_session_is_dropped_whole(spark):
    rows = route_rows(spark, [("v", 1, "home", 90), ("v", 1, "home", 110), ("v", 1, "singular", 2000)])
    kept = S.starting_between(S.session_table(rows, 1800, ends=["route_family"]), 100, 10_000).collect()
    assert [r["first_route_family"] for r in kept] == ["singular"]


@pytest.mark.parametrize("width", [1, 60, 300, 100_000])
def test_sessions_do_not_depend_on_the_slice(spark, width):
    """One visitor holds nearly all rows, many of them in the same second."""
    data = [("hot", 1, "a", (i * i * 37) % 9000) for i in range(400)] + [("cold", 1, "a", i * 2500) for i in range(5)]
    rows = route_rows(spark, data)
    got = {(r["id"], r["session_start"]) for r in S.sessionize(rows, 600, slice_secs=width).collect()}
    want, last = set(), {}
    for i, (visitor, _, _, ts) in sorted(enumerate(data), key=lambda x: (x[1][0], x[1][3], x[0])):
        start, prev = last.get(visitor, (ts, ts))
        start = ts if ts - prev > 600 else start
        last[visitor] = (start, ts)
        want.add((i, start))
    assert got == want


def test_trails_cross_slices(spark):
    data = [("v", i % 3, f"r{i}", i * 50) for i in range(40)]
    rows = route_rows(spark, data)
    a = S.sequences(S.sessionize(rows, 600, node=["blog_id", "route_family"], depth=3, slice_secs=60), 4)
    paths = sorted([n["route_family"] for n in r["path"]] for r in a.collect())
    assert paths == sorted([f"r{j}" for j in range(i, i + 4)] for i in range(37))


def test_cohort_censoring(spark):
    rows = spark.createDataFrame([(date(2026, 1, 5), 2, 1, 0)], "cohort_week_start date, cohort_size bigint, returned_w1 bigint, returned_w2 bigint")
    row = J.censor_cohorts(rows, datetime(2026, 2, 1)).first()
    assert (row["retention_w1"], row["retention_w2"]) == (0.5, 0.0)
    late = spark.createDataFrame([(date(2026, 1, 19), 1, 0, 0)], rows.schema)
    row = J.censor_cohorts(late, datetime(2026, 1, 30)).first()
    assert row["cohort_week"] == "202604" and row["returned_w1"] is None and row["retention_w2"] is None


def funnel_rows(spark, rows):
    return spark.createDataFrame(rows, "person string, event_type string, ts bigint, id bigint")


def test_funnel_counts_and_rates(spark):
    rows = funnel_rows(spark, [
        ("a", "s1", 1, 1), ("a", "s2", 2, 2), ("a", "s3", 3, 3), ("b", "s1", 1, 4), ("b", "s2", 5, 5), ("c", "s1", 9, 6),
    ])
    steps = FN.ordered_funnel(rows, ["s1", "s2", "s3"])
    out = FN.funnel_rates(steps).orderBy("index").collect()
    assert [r["people"] for r in out] == [3, 2, 1]
    assert [r["conversion_from_prev"] for r in out] == [1.0, 0.6667, 0.5]
    assert out[2]["conversion_from_top"] == 0.3333
    worst = FN.funnel_summary(steps).first()
    assert (worst["from_step"], worst["to_step"], worst["dropped"], worst["drop_rate"]) == ("s2", "s3", 1, 0.5)


def test_funnel_disorder_and_ties(spark):
    rows = funnel_rows(spark, [
        ("a", "s2", 1, 1), ("a", "s1", 2, 2), ("a", "s1", 2, 3), ("a", "s2", 2, 4), ("a", "s3", 2, 3), ("a", "s3", 2, 9),
        ("b", "s3", 1, 1),
    ])
    assert [r["people"] for r in FN.ordered_funnel(rows, ["s1", "s2", "s3"]).orderBy("index").collect()] == [1, 1, 1]


def test_identity_bridge(spark):
    rows = spark.createDataFrame(
        [(1, "v", 5, None), (2, "v", None, None), (3, "w", 6, None), (4, "w", 7, None), (5, "w", None, None),
         (6, None, None, None), (7, "v", 5, 0)],
        "id bigint, visitor_id string, user_id bigint, payload_user_id bigint",
    )
    got = {r["id"]: r["person"] for r in ID.with_person(rows, ID.identity_bridge(rows)).collect()}
    assert got == {1: "user:5", 2: "user:5", 3: "user:6", 4: "user:7", 5: "visitor:w", 6: "", 7: "user:5"}


@pytest.mark.parametrize(
    "pair, expected",
    [
        ((80, 100, 50, 100), (0.3, 0.1691, 0.417, 0.6, 0.2851, 0.992, "measured")),
        ((2, 5, 1, 5), (0.2, -0.3098, 0.604, 1.0, -0.744, 14.6235, "measured")),
        ((0, 10, 2, 10), (-0.2, -0.5098, 0.1124, -1.0, None, None, "insufficient_data")),
        ((1, 1, 1, 1), (0.0, -0.7935, 0.7935, 0.0, None, None, "insufficient_data")),
        ((1, 0, 1, 1), (None, None, None, None, None, None, "zero_denominator")),
    ],
)
def test_lift(spark, pair, expected):
    df = spark.createDataFrame([pair], "a bigint, b bigint, c bigint, d bigint")
    cols = lift(F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.lit(False))
    names = ["absolute", "absolute_lower", "absolute_upper", "relative", "relative_lower", "relative_upper", "status"]
    row = df.select(*[cols[f"lift_{n}"].alias(n) for n in names]).first()
    assert tuple(row) == expected


def test_wilson(spark):
    lo, hi = wilson_interval(F.lit(5), F.lit(10))
    assert tuple(spark.range(1).select(lo, hi).first()) == (0.2366, 0.7634)


@pytest.mark.parametrize(
    "url, category",
    [
        ("/etc/passwd", "scanner-path-probe"), ("/Gemfile", "scanner-path-probe"), ("/x.jspx", "scanner-path-probe"),
        ("/%2e%2e%2fetc%2fpasswd", "scanner-path-probe"), ("/.env", "secret-probe"), ("/wp-login.php", "php-probe"),
        ("/2023/04/my-post", "date-prefix"), ("/t/community-topic", "community-thread"), ("?author=1", "author-enum"),
        ("/some-real-post-slug", "content"), ("/backup.zip", "config-probe"), ("/KONTAKT/", "ad-sponsor-probe"),
        ("/join/", "join-page"), ("/events/a", "events"),
    ],
)
def test_404_categories(spark, url, category):
    assert spark.range(1).select(C.not_found_category(F.lit(url))).first()[0] == category


@pytest.mark.parametrize(
    "term, pattern",
    [
        ("Gem", None), ("Gemma", None), ("memphis", None), ("Grateful Dead", None), ("sleep(5)", "time_based_sqli"),
        ("%253Cscript%253E", "xss_script_tag"), ("1&#039;&quot;1000", "scanner_quote_probe"), ("the/Gemfile", "dependency_manifest_probe"),
        ("x" * 300, "length_abuse"), ("100%zz", None), ("a+b", None), ("../../x", "path_traversal"), ("", None),
    ],
)
def test_search_payloads(spark, term, pattern):
    row = spark.createDataFrame([(term,)], "t string").select(C.search_payload(F.col("t")).alias("p")).first()
    assert (row["p"]["pattern_name"] if row["p"] else None) == pattern


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://User@Example.COM.:8080//a//b?q=1#x", "https://example.com:8080/a/b"), ("/a//b?x", "/a/b"),
        ("ftp://x/y", ""), ("", ""), ("https://x.org", "https://x.org/"), ("not a url", ""), ("//x.org/a", ""),
    ],
)
def test_canonical_url(spark, url, expected):
    assert spark.range(1).select(urls.canonical_url(F.lit(url))).first()[0] == expected


def test_benchmark(spark):
    rows = [(f"p{i}", rpm, 1000.0 * (i + 0)) for i, rpm in enumerate([10, 20, 30, 40, 50, 300], start=1)]
    pages = spark.createDataFrame(
        [(k, float(r), int(v), "applicable") for k, r, v in rows], "page_key string, derived_rpm double, views bigint, revenue_status string"
    )
    out = {r["page_key"]: r for r in PR.with_benchmark(pages).collect()}
    assert [k for k, r in out.items() if r["benchmark_opportunity"]] == ["p6"]
    assert out["p6"]["benchmark_score"] == 8.5714


def test_snapshot_identity(spark):
    made = spark.range(1).select(
        RS.snapshot_identity(F.lit("Feed"), F.lit("Example.org"), F.lit(1), F.lit("2026-05")).alias("i"),
        *[c.alias(n) for n, c in zip("lse", RS.period_range(F.lit("2026-05")))],
    ).first()
    assert __import__("re").match(r"^feed-exampleorg-b1-2026-05-[a-f0-9]{12}$", made["i"])
    assert (made["l"], str(made["s"]), str(made["e"])) == ("2026-05", "2026-05-01", "2026-05-31")


def test_windows():
    assert exact("2024-01-10", "2024-01-12").days == 3
    assert relative(0, datetime(2024, 1, 1)).since is None
    assert resolve(datetime(2024, 1, 31), 7, end_days_ago=7).until == datetime(2024, 1, 24)
    assert exact("2022-01-01", "2024-01-01").days == 731  # no window is too long
    with pytest.raises(ValueError):
        exact("2024-02-02", "2024-02-01")
    with pytest.raises(ValueError):
        resolve(datetime(2024, 1, 31), start="2024-01-01")


@pytest.mark.parametrize(
    "flag, is_true, not_true, human, truthy",
    [("true", True, False, False, True), ("false", False, True, True, False), (None, False, True, False, False), ("1", False, True, False, True), ("0", False, True, False, False)],
)
def test_bot_flag_readings(spark, flag, is_true, not_true, human, truthy):
    df = spark.createDataFrame([(flag,)], "is_bot string")
    got = df.select(P.bot_is_true(), P.bot_is_not_true(), P.explicit_human(), P.bot_is_truthy()).first()
    assert tuple(got) == (is_true, not_true, human, truthy)


def test_no_cap_changes_results(spark):
    """Large feeds, long ranges, long URLs and a limit of 0 give whole results."""
    feed = spark.range(12_000).select(F.lit("h").alias("host"), F.expr("date_add(DATE'2024-01-01', CAST(id % 7 AS INT))").alias("date"), F.lit(1).alias("sessions"))
    hosts = spark.createDataFrame([("h",)], "host string")
    row = GR.check_feed(feed, hosts, date(2024, 1, 1), date(2024, 1, 7)).first()
    assert (row["status"], row["sessions"]) == ("measured", 12_000)
    cut = GR.check_feed(feed.withColumn("truncated", F.lit(True)), hosts, date(2024, 1, 1), date(2024, 1, 7)).first()
    assert (cut["status"], cut["reason"]) == ("not_instrumented", "truncated_feed")
    clicks = spark.createDataFrame([(1, date(2024, 1, 1), 5)], "link_page_id int, stat_date date, click_count long")
    views = clicks.withColumnRenamed("click_count", "view_count")
    assert GR.link_page_daily(views, clicks, date(2024, 4, 29), days=120).count() == 120
    base = "https://a.example/" + "x" * 600
    pair = spark.createDataFrame([(base + "1",), (base + "2",)], "u string").select(UR.canonical_url(F.col("u")).alias("u"))
    assert pair.distinct().count() == 2
    many = spark.range(40).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("signature"), F.lit(3).alias("count"), F.lit(1).alias("active_count"))
    assert ER.error_summary(many, limit=0).count() == 40 and ER.error_totals(many, limit=0).first()["truncated"] is False


def test_plain_urls_are_told_by_one_pattern(spark):
    """The short way gives what taking a URL apart gives, and leaves every other URL to that."""
    plain = {"https://a.b-c.example/x/y": None, "http://a/": None, "https://a.example/x@y/?a=//b#c": "https://a.example/x@y/", "http://a.example/x#\ny ": "http://a.example/x"}
    apart = {
        "https://a.example": "https://a.example/", "https://a.example./x": "https://a.example/x", "https://A.example/x": "https://a.example/x",
        "https://a.example//x": "https://a.example/x", "https://u@a.example:80/x": "https://a.example:80/x", " https://a.example/x ": "https://a.example/x",
        "https://a.example/x\0": "", "https:///x": "", "ftp://a.example/x": "", "/x//y?z": "/x/y", "https://a.example/x\n": "https://a.example/x\n", "": "",
    }
    cases = [(u, UR.PLAIN, w if w is not None else u, u in plain) for u, w in (plain | apart).items()] + [("https://a.example" + "/x" * 50_000, UR.PLAIN, "https://a.example" + "/x" * 50_000, True)]
    rows = spark.createDataFrame(cases, "u string, p string, want string, short boolean")
    got = rows.select("u", "want", "short", UR.canonical_url(F.col("u")).alias("got"), (F.regexp_extract("u", UR.PLAIN, 1) != "").alias("told"))
    for r in got.collect():
        assert (r["got"], r["told"]) == (r["want"], r["short"]), r["u"][:80]
