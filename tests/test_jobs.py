"""Write jobs: idempotence, refusals, partition rewrites and replays."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyglass.operators.quantiles import exact_median
from tallyglass.operators.skew import salted_lookup
from tallyglass.plans import errors as PE
from tallyglass.functions import windows as P
from tallyglass.plans import experiments as PX
from tallyglass.plans import journeys as PJ
from tallyglass.plans import traffic as PT
from tallyglass.session import scratch_dir
from tallyglass.sources import error_log as EL
from tallyglass.sources import events as EV
from tallyglass.sources import maintenance as M
from tallyglass.sources import revenue_store as RS
from tallyglass.streaming import batches as MB

REVENUE = (
    "slug string, url string, post_id bigint, views bigint, revenue decimal(12,4), rpm double, cpm double, "
    "viewability double, fill_rate double, impressions_per_pageview double"
)
SCOPE = dict(blog_id=1, period="2026-05", source="feed", site="example.org")


def revenue_rows(spark, rows):
    from decimal import Decimal

    data = [(s, None, p, v, Decimal(r), 1.0, 2.0, 50.0, 60.0, i) for s, p, v, r, i in rows]
    return spark.createDataFrame(data, REVENUE)


def test_reingest_is_a_no_op(spark):
    target = scratch_dir(spark, "rev")
    rows = revenue_rows(spark, [("a", 1, 10, 1, 2.0), ("/a/", 1, 30, 3, 2.0), ("b?x=1", None, 5, 2, 1.0)])
    first = RS.ingest_revenue(rows, target, target + "-s0", **SCOPE).first()
    again = RS.ingest_revenue(rows, target, target + "-s1", **SCOPE).first()
    assert tuple(first) == (2, 0, 0) and tuple(again) == (0, 2, 0)
    stored = {r["slug"]: r for r in spark.read.parquet(target).collect()}
    assert set(stored) == {"a", "b"} and stored["a"]["views"] == 40 and float(stored["a"]["revenue"]) == 4.0
    assert stored["a"]["rpm"] == pytest.approx(100.0)


def test_replace_deletes_and_keeps_other_snapshots(spark):
    target = scratch_dir(spark, "rev")
    old = revenue_rows(spark, [("a", 1, 1, 1, 1.0), ("b", 2, 1, 1, 1.0)])
    new = revenue_rows(spark, [("b", 2, 9, 9, 1.0), ("c", 3, 1, 1, 1.0)])
    RS.ingest_revenue(old, target, target + "-s0", **SCOPE)
    RS.ingest_revenue(old, target, target + "-s1", **{**SCOPE, "period": "2026-04"})
    dry = RS.ingest_revenue(new, target, target + "-s2", dry_run=True, **SCOPE).first()
    assert tuple(dry) == (1, 1, 1) and spark.read.parquet(target).count() == 4
    RS.ingest_revenue(new, target, target + "-s3", **SCOPE)
    rows = spark.read.parquet(target)
    assert {r["slug"] for r in rows.filter("period_label = '2026-05'").collect()} == {"b", "c"}
    assert rows.filter("period_label = '2026-04'").count() == 2


def test_ingest_refusals(spark):
    rows = revenue_rows(spark, [("a", 1, 1, 1, 1.0)])
    target = scratch_dir(spark, "rev")
    with pytest.raises(ValueError):
        RS.ingest_revenue(rows.filter("false"), target, target + "-s", **SCOPE)
    for label in (None, "Bad Label"):
        with pytest.raises(ValueError):
            RS.ingest_revenue(rows, target, target + "-s", mode="additive", snapshot=label, **SCOPE)


def test_purge_rewrites_touched_days_only(spark):
    path = scratch_dir(spark, "events")
    rows = spark.createDataFrame(
        [(1, "404_error", datetime(2024, 1, 1)), (2, "pageview", datetime(2024, 1, 1)), (3, "404_error", datetime(2024, 3, 1)), (4, "404_error", datetime(2024, 2, 2))],
        "id bigint, event_type string, created_at timestamp",
    ).withColumn("event_date", F.to_date("created_at"))
    rows.write.partitionBy("event_date").parquet(path)
    assert M.purge(spark.read.parquet(path), ["404_error"], datetime(2024, 2, 15))[1].first()["purged"] == 2
    assert M.purge_days(spark, path, path + "-stage", ["404_error"], datetime(2024, 2, 15)) == 2
    assert sorted(r["id"] for r in spark.read.parquet(path).collect()) == [2, 3]  # the day that held only row 4 is gone
    assert M.purge_days(spark, path, path + "-stage", ["404_error"], datetime(2024, 2, 15)) == 0


def test_backfill_keeps_json_types(spark):
    rows = spark.createDataFrame(
        [(1, "x", '{"a":1,"b":true}', "v", 1), (2, "x", "{}", None, 1), (3, "x", '{"is_bot":null}', "v", 1), (4, "x", "bad", "v", 1)],
        "id bigint, event_type string, event_data string, visitor_id string, blog_id int",
    )
    out = {r["id"]: r["event_data"] for r in M.backfill_is_bot(rows)[0].collect()}
    assert out == {1: '{"a":1,"b":true,"is_bot":false}', 2: '{"is_bot":true}', 3: '{"is_bot":null}', 4: "bad"}


def test_log_records_and_signatures(spark):
    path = scratch_dir(spark, "log")
    text = (
        "left over\n[01-Feb-2026 10:00:00 UTC] PHP Fatal error:  Uncaught Error: id=12 at 0xAB in /srv/site/a.php:3\n#0 {main}\n"
        "  thrown in /srv/site/core/b.php on line 9\n[01-Feb-2026 10:05:00 UTC] PHP Warning:  bad <b>thing</b> 7 in /srv/site/c.php on line 1\n"
        "[01-Feb-2026 10:06:00 UTC] some other line\n"
    )
    spark.createDataFrame([(text.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    rows = EL.parse_errors(EL.read_error_log(spark, path), ["/srv/site"]).orderBy("ts").collect()
    assert [(r["severity"], r["file"]) for r in rows] == [("fatal", "b.php:9"), ("warning", "c.php:1")]
    assert rows[0]["message"].startswith("Uncaught Error: id=N at NxADDR") and rows[1]["message"] == "bad thing N"
    assert rows[0]["from_production"] and len(rows[0]["signature"]) == 32


def test_active_totals(spark):
    merged = spark.createDataFrame(
        [("old", 1000, 0), ("new", 1, 1)], "signature string, count bigint, active_count bigint"
    )
    row = PE.error_totals(merged).first()
    assert (row["total"], row["active_total"], row["active_per_day"], row["active_signatures"]) == (1001, 1, 1.0, 1)


def test_alarm_rearms_and_escalates(spark):
    at = datetime(2026, 1, 1, 12)
    entries = spark.createDataFrame(
        [(s, "fatal", "f:1", "x", True, datetime(2026, 1, 1, 11, 55, i)) for s in ("new", "quiet", "hot", "calm") for i in range(20)],
        "signature string, severity string, file string, sample string, from_production boolean, ts timestamp",
    )
    state = spark.createDataFrame(
        [("quiet", datetime(2026, 1, 1, 9), 9999, at), ("hot", datetime(2026, 1, 1, 11, 30), 10, at),
         ("calm", datetime(2026, 1, 1, 11, 30), 1000, at), ("gone", datetime(2025, 12, 1), 1, at)], PE.STATE,
    )
    found = PE.alarm_candidates(entries, state, at)
    got = {r["signature"]: (r["rate_per_hr"], r["reasons"], r["would_alarm"]) for r in found.collect()}
    assert got["new"] == (1200, "new_signature,over_threshold", True)
    assert got["quiet"] == (1200, "returned_after_quiet,over_threshold", True)
    assert got["hot"] == (1200, "over_threshold,escalated", True)
    assert got["calm"] == (1200, "", False)
    assert {r["signature"] for r in PE.next_state(found, state, at).collect()} == {"new", "quiet", "hot", "calm"}


def test_replayed_batch_counts_once(spark):
    path = scratch_dir(spark, "mb")
    rows = spark.range(5)
    MB.put(rows, path, 0)
    MB.put(rows, path, 1)
    MB.put(rows, path, 1)
    assert MB.get(spark, path, rows.schema).count() == 10


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_exact_median(spark, n):
    import statistics

    values = [((i * 7919) % 1013) * 0.25 - 60 for i in range(n)]
    row = exact_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first()
    assert (row["median"], row["n"]) == (statistics.median(values), n)


def test_salted_lookup_keeps_all_rows(spark):
    big = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("950", 2), ("none", 3)], "k string, v int")
    assert salted_lookup(big, small, "k").count() == 901
    assert salted_lookup(big, small, "k", how="left").count() == 1000


def experiment_rows(spark, rows):
    cols = (
        "id bigint, event_type string, ts bigint, blog_id int, visitor_id string, user_id bigint, payload_user_id bigint, is_bot string, "
        "context string, post_id bigint, route_family string, experiment_key string, definition_version bigint, assignment_policy string, "
        "variant string, surface string"
    )
    base = dict(blog_id=1, user_id=None, payload_user_id=None, is_bot="false", context=None, post_id=None, route_family=None,
                experiment_key="k", definition_version=1, assignment_policy="p", variant="control", surface="s")
    names = [c.strip().split()[0] for c in cols.split(",")]
    return spark.createDataFrame([tuple({**base, **r}[n] for n in names) for r in rows], cols)


def test_experiment_walk(spark):
    """Stage moves on when a pageview, or the outcome, comes more than one gap after the last pageview."""
    A, X, V, O = "experiment_assignment", "experiment_exposure", "pageview", "newsletter_signup"
    rows = experiment_rows(spark, [
        dict(id=1, event_type=A, ts=1000, visitor_id="a"), dict(id=2, event_type=V, ts=2500, visitor_id="a"),
        dict(id=3, event_type=O, ts=4300, visitor_id="a"),
        dict(id=4, event_type=A, ts=1000, visitor_id="b"), dict(id=5, event_type=V, ts=2900, visitor_id="b"),
        dict(id=6, event_type=O, ts=2901, visitor_id="b"),
        dict(id=7, event_type=O, ts=900, visitor_id="c"), dict(id=8, event_type=A, ts=1000, visitor_id="c", variant="treatment"),
        dict(id=9, event_type=X, ts=1000, visitor_id="c", variant="treatment"), dict(id=10, event_type=A, ts=1001, visitor_id="c"),
        dict(id=11, event_type=O, ts=1002, visitor_id="c"), dict(id=12, event_type=A, ts=1, visitor_id="d", is_bot="true"),
    ])
    exp = PX.experiment_summary(rows, datetime(1970, 1, 2), "k", ["control", "treatment"], "control", [O], version=1)
    got = {(r["person"], r["lens"]): r["stage"] for r in exp.attributed_outcomes().collect()}
    assert got == {
        ("visitor:a", "assignment"): "same_session", ("visitor:b", "assignment"): "later_session",
        ("visitor:c", "assignment"): "same_session", ("visitor:c", "exposure"): "same_session",
    }
    cover = exp.coverage().first()
    assert (cover["bot_rows_excluded"], cover["duplicate_assignment_events"], cover["conflicting_assignment_events"]) == (1, 1, 1)
    assert cover["pre_assignment_outcome_events"] == 1


def test_reports_prune_days_of_the_stored_table(spark):
    """Windows reach the scan of the table that append_events writes, as partition and row-group filters."""
    path = scratch_dir(spark, "days")
    rows = spark.createDataFrame(
        [(i, "pageview", "{}", "", 1, 0, f"v{i}", datetime(2024, 1, 1 + i)) for i in range(20)],
        "id bigint, event_type string, event_data string, source_url string, blog_id int, user_id bigint, visitor_id string, created_at timestamp",
    )
    EV.append_events(rows, path)
    events, at = EV.read_events(spark, path), datetime(2024, 1, 20)
    frames = {
        "summary": PT.analytics_summary(events, at, 7),
        "routes": PJ.RouteReport(events, at, days=7).rows,
        "funnel": P.between(events, PJ.epoch(datetime(2024, 1, 13)), PJ.epoch(at)),
    }
    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    for name, frame in frames.items():
        plan = frame._jdf.queryExecution().executedPlan().toString()
        scan = plan[plan.index("PartitionFilters") :]
        assert "event_date" in scan[: scan.index("PushedFilters")], name
        assert "GreaterThanOrEqual(created_at" in scan, name


def test_revenue_names_without_slug_and_lowest_post(spark):
    rows = [("?utm=x", 5, 1), ("/", 7, 2), ("/?utm=y", 1, 2), ("/a/", 2, 9), ("a?x=1", 3, 4), ("a", 4, 0), ("b", 1, None)]
    rates = {c: 0.0 for c in RS.RATES}
    data = [{"slug": s, "url": None, "views": v, "revenue": 1.0, "post_id": p, **rates} for s, v, p in rows]
    schema = "slug string, url string, views long, revenue double, post_id long, " + ", ".join(f"{c} double" for c in RS.RATES)
    got = {r["slug"]: (r["views"], r["post_id"]) for r in RS.normalize_revenue(spark.createDataFrame(data, schema)).collect()}
    assert got == {"": (8, 2), "a": (9, 4), "b": (1, None)}


PERIODS = dict(blog_id=1, source="feed", site="example.org", imported_at=datetime(2026, 6, 1))
CONTENT = "status string, url string, post_id bigint, blog_id int"


def test_all_periods_in_one_ingest(spark):
    pages = [("publish", "https://x.org/resolved/", 50, 3), ("publish", "https://x.org/twice/", 60, 3), ("publish", "https://y.org/twice/", 61, 4),
             ("draft", "https://x.org/hidden/", 70, 3), ("publish", "https://e.org/a/", 1, 1)]
    content = spark.createDataFrame(pages, CONTENT)
    target = scratch_dir(spark, "rev")

    def rows(*data):
        frame = revenue_rows(spark, [d[1:] for d in data])
        return frame.withColumn("period", F.element_at(F.create_map(*[F.lit(x) for d in data for x in (d[1], d[0])]), F.col("slug")))

    first = rows(("2026-04", "a", 1, 10, 1, 2.0), ("2026-04", "/a/", 2, 30, 3, 2.0), ("2026-04", "resolved", None, 5, 2, 1.0), ("2026", "twice", None, 1, 1, 1.0), ("", "/", None, 7, 1, 1.0))
    counts = RS.ingest_periods(first, content, target, target + "-s0", **PERIODS)
    assert {r["period_label"]: tuple(r)[1:] for r in counts.collect()} == {"2026-04": (2, 0, 0), "2026": (1, 0, 0), "all-time": (1, 0, 0)}
    stored = {r["slug"]: r for r in spark.read.parquet(target).collect()}
    assert (stored["a"]["views"], stored["a"]["post_id"], stored["a"]["content_blog_id"], stored["a"]["canonical_url"], stored["a"]["url"]) == (40, 1, 1, "https://e.org/a/", "/a/")
    assert (stored["resolved"]["post_id"], stored["resolved"]["content_blog_id"], stored["resolved"]["canonical_url"]) == (50, 3, "https://x.org/resolved/")
    assert stored["twice"]["post_id"] is None and stored["twice"]["content_blog_id"] is None and stored[""]["period_start"] is None
    second = rows(("2026-04", "b", 2, 9, 9, 1.0), ("2026-04", "resolved", None, 6, 2, 1.0))
    dry = RS.ingest_periods(second, content, target, target + "-s1", dry_run=True, **PERIODS)
    assert [tuple(r) for r in dry.collect()] == [("2026-04", 1, 1, 1)] and spark.read.parquet(target).count() == 4
    RS.ingest_periods(second, content, target, target + "-s2", **PERIODS)
    assert sorted((r["period_label"], r["slug"]) for r in spark.read.parquet(target).collect()) == [("2026", "twice"), ("2026-04", "b"), ("2026-04", "resolved"), ("all-time", "")]
    same = RS.snapshot_identity(F.lit("feed"), F.lit("example.org"), F.lit(1), F.lit("2026-04"))
    assert spark.read.parquet(target).filter(F.col("period_label") == "2026-04").filter(F.col("import_batch") != same).count() == 0


def test_experiment_coverage_broadcasts_no_copies(spark):
    """The lookups of a coverage row repeat their small side, which must not pass through the driver."""
    rows = experiment_rows(spark, [dict(id=i, event_type="experiment_assignment", ts=i, visitor_id=f"v{i % 5}") for i in range(20)])
    exp = PX.experiment_summary(rows, datetime(1970, 1, 2), "k", ["control", "treatment"], "control", ["newsletter_signup"], version=1)
    cover = exp.coverage()
    assert "BroadcastHashJoin" not in cover._jdf.queryExecution().executedPlan().toString()
    assert cover.first()["duplicate_assignment_events"] == 15


def test_rows_without_a_path_or_a_post_spread(spark):
    """Most rows name their post and ask for no path, some have no post: neither meet in one task."""
    content = spark.range(2000).select(
        F.lit("publish").alias("status"), F.concat(F.lit("https://x.org/s"), "id", F.lit("/")).alias("url"), F.col("id").alias("post_id"), F.lit(1).alias("blog_id")
    )
    rows = spark.range(1, 12_001).select(
        F.concat(F.lit("s"), "id").alias("slug"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("post_id"), F.lit("/x/").alias("page_url")
    )
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    for k, v in zip(before, ("-1", "16", "false"), strict=True):
        spark.conf.set(k, v)
    try:
        out = RS.with_content(rows, content, 1, scratch_dir(spark, "rev"))
        sizes = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert sum(sizes) == 12_000 and max(sizes) < 2000
        at = {r["slug"]: (r["post_id"], r["content_blog_id"], r["canonical_url"]) for r in out.collect()}
        assert at["s3"] == (3, 1, "https://x.org/s3/") and at["s4"] == (4, 1, "https://x.org/s4/")
        assert at["s3000"] == (None, None, None) and at["s4000"] == (4000, 1, None)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_additive_periods_and_refusals(spark, monkeypatch):
    content = spark.createDataFrame([], CONTENT)
    target = scratch_dir(spark, "rev")
    one = revenue_rows(spark, [("a", 1, 1, 1, 1.0)]).withColumn("period", F.lit("2026-05"))
    two = revenue_rows(spark, [("b", None, 1, 1, 1.0)]).withColumn("period", F.lit("2026-05"))
    add = dict(mode="additive", snapshot="extra-1", **PERIODS)
    RS.ingest_periods(one, content, target, target + "-s0", **add)
    assert [tuple(r) for r in RS.ingest_periods(two, content, target, target + "-s1", **add).collect()] == [("2026-05", 1, 0, 0)]
    assert {r["slug"] for r in spark.read.parquet(target).collect()} == {"a", "b"}
    own = spark.range(1).select(RS.snapshot_identity(F.lit("feed"), F.lit("example.org"), F.lit(1), F.lit("2026-05"))).first()[0]
    for label in (None, "Bad Label", own):
        with pytest.raises(ValueError):
            RS.ingest_periods(one, content, target, target + "-s2", **{**add, "snapshot": label})
    with pytest.raises(ValueError):
        RS.ingest_periods(one.filter("false"), content, target, target + "-s3", **PERIODS)
    whole = RS.resolve_paths
    monkeypatch.setattr(RS, "resolve_paths", lambda rows, pages: whole(rows, pages).filter("false"))
    with pytest.raises(ValueError, match="incomplete"):
        RS.ingest_periods(two, content, target, target + "-s4", **PERIODS)
    assert {r["slug"] for r in spark.read.parquet(target).collect()} == {"a", "b"}


def test_names_are_cut_once_above_the_aggregate_that_made_the_rows(spark):
    """A filter on names that come from a grouped table would run its patterns on every row below the grouping."""
    lines = spark.range(60).select((F.col("id") % 6).alias("pk"))
    pages = lines.groupBy("pk").agg(F.count("*").alias("views")).select(
        F.expr("elt(CAST(pk AS INT) + 1, ' ', '/', '?q', '/a/?x', 'a', 'b')").alias("slug"), F.lit(None).cast("string").alias("url"),
        "views", F.lit(1).cast("decimal(12,4)").alias("revenue"), F.lit("2026-04").alias("period_label"), F.lit(None).cast("bigint").alias("post_id"),
        *[F.lit(1.0).alias(r) for r in RS.RATES],
    )
    out = RS.normalize_revenue(pages, "period_label")
    below = out._jdf.queryExecution().optimizedPlan().toString().rsplit("Aggregate", 1)[1]
    assert "regexp" not in below and "Filter" not in below
    assert sorted((r["slug"], r["views"]) for r in out.collect()) == [("", 10), ("a", 20), ("b", 10)]


def test_admission_shuffles_no_parsed_payload(spark):
    """A row's own flaws are judged before the lookups; the order of the reasons stays."""
    url = "https://a.example/x/?q=1"
    rows = spark.createDataFrame(
        [
            (1, "share_click", "{", url, "b.example"), (2, "share_click", "{", url, "a.example"), (3, "other", "{", url, "b.example"),
            (4, "bridge_click", '{"dest_site": "one"}', url, "A.example"), (5, "bridge_click", '{"dest_site": "two"}', url, "a.example"),
            (6, "share_click", '{"share_url": "ftp://x"}', url, "a.example"), (7, "bridge_click", '{"source_post": "1x", "dest_site": "two"}', url, "a.example"),
            (8, "share_click", "{}", "https://c.example/", "a.example"), (9, "share_click", None, url, "a.example"),
        ],
        "id int, event_type string, event_data string, source_url string, origin_host string",
    )
    sites = spark.createDataFrame([("a.example", "one")], "host string, site string")
    judged = EV.admission(rows, sites)
    assert not {"_json", "_keys"} & set(judged.columns)
    assert {r["id"]: r["reject_reason"] for r in judged.collect()} == {
        1: "invalid_event_origin", 2: "invalid_event_data", 3: "unsupported_type", 4: None, 5: "unknown_site",
        6: "invalid_url", 7: "invalid_event_field", 8: "invalid_event_source", 9: "invalid_event_data",
    }
