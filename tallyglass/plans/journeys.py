"""Route transitions, retention and surface stickiness."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import predicates as P
from ..functions.stats import half_up, ratio
from ..functions.windows import Window, between, relative, resolve
from ..operators import sessions as S


def epoch(moment: datetime) -> int:
    return int(moment.replace(tzinfo=timezone.utc).timestamp())


def pageviews(events: DataFrame) -> DataFrame:
    return events.filter(P.of_type("pageview"))


def known_pageviews(events: DataFrame) -> DataFrame:
    return pageviews(events).filter(P.identified())


def node_key(node: Column) -> Column:
    return F.concat_ws(":", node["blog_id"].cast("string"), node["route_family"])


class RouteReport:
    """Route transitions over one window; every output is its own lazy frame.

    Reads one gap of context before the window so a session that began earlier is
    recognised and left out.
    """

    def __init__(
        self,
        events: DataFrame,
        as_of: datetime,
        days: int = 28,
        gap: int = 1800,
        length: int = 3,
        cohort: str = "all",
        limit: int = 25,
        blog_id: int = 0,
        recent: int | None = None,
    ):
        self.gap, self.length, self.cohort, self.limit = gap, length, cohort, limit
        self.since, self.until = epoch(as_of - timedelta(days=days)), epoch(as_of)
        self.views = pageviews(events)
        self.scope = P.scoped(blog_id)
        family = C.route_family(F.col("route_family"), F.col("post_id"))
        rows = between(known_pageviews(events), self.since - gap, self.until).filter(
            self.scope & F.col("ts").between(self.since - gap, self.until)
        ).select("id", "visitor_id", "blog_id", "ts", family.alias("route_family"))
        if recent is not None:
            rows = self._most_recent(rows, recent)
        self.rows = rows
        self.acq = S.acquisitions(known_pageviews(events))

    def _most_recent(self, rows: DataFrame, n: int) -> DataFrame:
        """Optional bounded sample: the newest ``n`` rows, ranking from one gap later."""
        newest = rows.orderBy(F.desc("ts"), F.desc("id")).limit(n + 1)
        cut = newest.agg(F.min(F.struct("ts", "id")).alias("m"), F.count("*").alias("n"))
        oldest = cut.select(F.when(F.col("n") > n, F.col("m"))).scalar()
        self.since = F.greatest(F.lit(self.since), F.coalesce(oldest["ts"] + self.gap, F.lit(0)))
        return newest.filter(oldest.isNull() | (F.struct("ts", "id") > oldest))

    def sessions(self) -> DataFrame:
        table = S.session_table(self.rows, self.gap, ends=["blog_id", "route_family"])
        table = table.filter((F.col("session_start") >= self.since) & (F.col("session_start") <= self.until))
        table = S.with_cohort(table, self.acq)
        return table if self.cohort == "all" else table.filter(F.col("cohort") == self.cohort)

    def trails(self, depth: int) -> DataFrame:
        out = S.sessionize(self.rows, self.gap, node=["blog_id", "route_family"], depth=depth)
        out = out.filter((F.col("session_start") >= self.since) & (F.col("session_start") <= self.until))
        if self.cohort == "all":
            return out
        wanted = self.sessions().select("visitor_id", "session_start")
        return out.join(wanted, ["visitor_id", "session_start"], "left_semi")

    def counts(self) -> DataFrame:
        """Session and pair totals. Windows of n routes per session follow from its length."""
        s = self.sessions()
        tally = s.agg(
            F.count("*").alias("sessions"),
            F.count_if(F.col("cohort") == "first_time").alias("first_time_sessions"),
            F.count_if(F.col("cohort") == "returning").alias("returning_sessions"),
            F.count_if(F.col("rows") == 1).alias("direct_terminal_sessions"),
            F.coalesce(F.sum(F.col("rows") - 1), F.lit(0)).alias("transitions"),
            F.coalesce(F.sum(F.greatest(F.col("rows") - (self.length - 1), F.lit(0))), F.lit(0)).alias(
                "sequence_windows"
            ),
        )
        same = S.transitions(self.trails(1)).agg(
            F.count_if(F.col("from_node.blog_id") == F.col("to_node.blog_id")).alias("same")
        ).scalar()
        return tally.select(
            "*",
            same.alias("same_surface_transitions"),
            (F.col("transitions") - same).alias("cross_surface_transitions"),
        )

    def _ranked(self, frame: DataFrame, key: str) -> DataFrame:
        return frame.orderBy(F.desc("count"), key).limit(self.limit)

    def transitions(self) -> DataFrame:
        pairs = S.transitions(self.trails(1)).select(
            node_key(F.col("from_node")).alias("from"),
            node_key(F.col("to_node")).alias("to"),
            (F.col("from_node.blog_id") == F.col("to_node.blog_id")).alias("same_surface"),
        )
        out = pairs.groupBy("from", "to", "same_surface").agg(F.count("*").alias("count"))
        return out.orderBy(F.desc("count"), "from", "to").limit(self.limit)

    def sequences(self) -> DataFrame:
        paths = S.sequences(self.trails(self.length - 1), self.length)
        text = F.array_join(F.transform("path", node_key), ">")
        return self._ranked(paths.groupBy(text.alias("path")).agg(F.count("*").alias("count")), "path")

    def _edge(self, edge: str) -> DataFrame:
        node = F.concat_ws(":", F.col(f"{edge}_blog_id").cast("string"), F.col(f"{edge}_route_family"))
        return self._ranked(self.sessions().groupBy(node.alias("route")).agg(F.count("*").alias("count")), "route")

    def entries(self) -> DataFrame:
        return self._edge("first")

    def terminals(self) -> DataFrame:
        return self._edge("last")

    def coverage(self) -> DataFrame:
        known, post, family = P.identified(), F.col("post_id") > 0, F.col("route_family")
        loaded = self.rows.agg(F.count("*")).scalar()
        window = between(self.views, self.since, self.until).filter(self.scope & (F.col("ts") >= self.since) & (F.col("ts") <= self.until))
        out = window.agg(
            F.count("*").alias("total_pageviews"),
            F.count_if(known).alias("identified_pageviews"),
            F.count_if(~known).alias("anonymous_pageviews"),
            F.count_if(family.isNotNull()).alias("explicit_route_family_pageviews"),
            F.count_if(family.isNull() & post).alias("inferred_singular_pageviews"),
            F.count_if(family.isNull() & ~F.coalesce(post, F.lit(False))).alias("historical_unclassified_pageviews"),
        )
        return out.select(
            "*",
            ratio(F.col("identified_pageviews"), F.col("total_pageviews"), 4, 0.0).alias("identity_coverage_rate"),
            loaded.alias("loaded_identified_pageviews"),
        )


# ---- retention ------------------------------------------------------------------------


def visitor_days(events: DataFrame, window: Window, blog_id: int = 0) -> DataFrame:
    """Pageviews per visitor and UTC day; at most one row per visitor-day leaves the map side."""
    rows = known_pageviews(events).filter(window.on() & P.scoped(blog_id))
    return rows.groupBy("visitor_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("views"))


def return_rate(events: DataFrame, window: Window, blog_id: int = 0) -> DataFrame:
    per_visitor = visitor_days(events, window, blog_id).groupBy("visitor_id").agg(F.count("*").alias("days"))
    out = per_visitor.agg(
        F.count("*").alias("total_visitors"), F.count_if(F.col("days") >= 2).alias("returning_visitors")
    )
    return out.withColumn("rate", ratio(F.col("returning_visitors"), F.col("total_visitors"), 4, 0.0))


def session_depth(events: DataFrame, window: Window, blog_id: int = 0) -> DataFrame:
    days = visitor_days(events, window, blog_id)
    return days.agg(
        ratio(F.sum("views"), F.count("*"), 2, 0.0).alias("avg_pageviews_per_visitor_day"),
        F.coalesce(F.max("views"), F.lit(0)).alias("max_pageviews_per_visitor_day"),
    )


def cross_site_return(events: DataFrame, window: Window) -> DataFrame:
    rows = known_pageviews(events).filter(window.on())
    seen = rows.groupBy("visitor_id", "blog_id", F.to_date("created_at").alias("day")).agg(F.count("*").alias("n"))
    per_visitor = seen.groupBy("visitor_id").agg(
        F.count_distinct("blog_id").alias("sites"), F.count_distinct("day").alias("days")
    )
    out = per_visitor.agg(
        F.count("*").alias("total_visitors"),
        F.count_if((F.col("sites") >= 2) & (F.col("days") >= 2)).alias("cross_site_visitors"),
    )
    return out.withColumn("rate", ratio(F.col("cross_site_visitors"), F.col("total_visitors"), 4, 0.0))


def cohort_members(events: DataFrame, as_of: datetime, weeks: int = 8, blog_id: int = 0) -> DataFrame:
    """Visitors acquired in the range with their week-1 and week-2 activity flags."""
    rows = known_pageviews(events).filter(P.scoped(blog_id) & (F.col("created_at") < F.lit(as_of)))
    days = rows.groupBy("visitor_id", F.to_date("created_at").alias("day")).agg(F.min("created_at").alias("first_at"))
    acquired = (
        days.groupBy("visitor_id")
        .agg(F.min("first_at").alias("first_at"))
        .filter(F.col("first_at") >= F.lit(as_of - timedelta(weeks=weeks)))
        .select("visitor_id", F.to_date(F.date_trunc("week", "first_at")).alias("cohort_week_start"))
    )
    week = F.col("cohort_week_start")
    within = (F.col("day") >= F.date_add(week, 7)) & (F.col("day") < F.date_add(week, 21))
    activity = days.select(F.col("visitor_id").alias("_v"), "day")
    joined = acquired.join(activity, (F.col("visitor_id") == F.col("_v")) & within, "left")
    return joined.groupBy("visitor_id", "cohort_week_start").agg(
        F.coalesce(F.max(F.col("day") < F.date_add(week, 14)), F.lit(False)).alias("active_w1"),
        F.coalesce(F.max(F.col("day") >= F.date_add(week, 14)), F.lit(False)).alias("active_w2"),
    )


def censor_cohorts(cohorts: DataFrame, as_of: datetime) -> DataFrame:
    """NULL, not zero, for a horizon whose week has not fully elapsed."""
    week = F.col("cohort_week_start")
    cut = F.lit(as_of)
    mature = {
        "w1": cut >= F.date_add(week, 14).cast("timestamp"),
        "w2": cut >= F.date_add(week, 21).cast("timestamp"),
    }
    label = F.extract(F.lit("YEAROFWEEK"), week) * 100 + F.weekofyear(week)
    cols = [label.cast("string").alias("cohort_week"), week, F.col("cohort_size")]
    for w in ("w1", "w2"):
        cols += [
            mature[w].alias(f"{w}_mature"),
            F.when(mature[w], F.col(f"returned_{w}")).alias(f"returned_{w}"),
            F.when(mature[w], ratio(F.col(f"returned_{w}"), F.col("cohort_size"), 4)).alias(f"retention_{w}"),
        ]
    return cohorts.select(*cols).orderBy("cohort_week_start")


def retention_cohorts(events: DataFrame, as_of: datetime, weeks: int = 8, blog_id: int = 0) -> DataFrame:
    cohorts = cohort_members(events, as_of, weeks, blog_id).groupBy("cohort_week_start").agg(
        F.count("*").alias("cohort_size"),
        F.count_if("active_w1").alias("returned_w1"),
        F.count_if("active_w2").alias("returned_w2"),
    )
    return censor_cohorts(cohorts, as_of)


def referrers(events: DataFrame, window: Window, blog_id: int = 0, limit: int = 25) -> DataFrame:
    rows = pageviews(events).filter(window.on() & P.scoped(blog_id) & F.col("referrer_host").isNotNull())
    return (
        rows.groupBy("referrer_host").agg(F.count("*").alias("landings"))
        .orderBy(F.desc("landings"), "referrer_host").limit(limit)
    )


def collection_coverage(events: DataFrame, window: Window, blog_id: int = 0) -> DataFrame:
    post = F.coalesce(F.col("post_id") > 0, F.lit(False))
    return pageviews(events).filter(window.on() & P.scoped(blog_id)).agg(
        F.count("*").alias("total_pageviews"),
        F.count_if(post).alias("post_backed_pageviews"),
        F.count_if(F.col("view_kind") == "route").alias("route_pageviews"),
        F.count_if(~post & F.col("view_kind").isNull()).alias("historical_unclassified_pageviews"),
    )


# ---- surface stickiness ---------------------------------------------------------------


def _windows(as_of: datetime, days: int) -> tuple[Window, Window]:
    return relative(days, as_of), resolve(as_of, days=days, end_days_ago=days)


def _period(as_of: datetime, days: int, col: str = "created_at") -> Column:
    current, prior = _windows(as_of, days)
    return F.when(current.on(col), "current").when(prior.on(col), "prior")


def surface_stickiness(events: DataFrame, surfaces: list[int], as_of: datetime, days: int = 28) -> DataFrame:
    """Engagement of each surface in this window and the equal one before it, from one scan."""
    rows = known_pageviews(events).filter(F.col("blog_id").isin(surfaces))
    rows = rows.withColumn("period", _period(as_of, days)).filter(F.col("period").isNotNull())
    per_day = rows.groupBy("blog_id", "period", "visitor_id", F.to_date("created_at").alias("day")).agg(
        F.count("*").alias("views")
    )
    per_visitor = per_day.groupBy("blog_id", "period", "visitor_id").agg(
        F.count("*").alias("days"), F.sum("views").alias("views")
    )
    snap = per_visitor.groupBy("blog_id", "period").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("days") >= 2).alias("returning"),
        F.sum("days").alias("visitor_days"),
        F.sum("views").alias("views"),
    )
    snap = snap.select(
        "blog_id", "period", "total", "returning",
        ratio(F.col("returning"), F.col("total"), 4, 0.0).alias("rate"),
        ratio(F.col("views"), F.col("visitor_days"), 2, 0.0).alias("depth"),
    )
    spark = events.sparkSession
    wanted = spark.createDataFrame([(b,) for b in surfaces], "blog_id int")
    pick = lambda col, period, empty: F.coalesce(
        F.max(F.when(F.col("period") == period, F.col(col))), F.lit(empty)
    )
    wide = wanted.join(snap, "blog_id", "left").groupBy("blog_id").agg(
        pick("rate", "current", 0.0).alias("return_rate"),
        pick("rate", "prior", 0.0).alias("prior_return_rate"),
        pick("depth", "current", 0.0).alias("session_depth"),
        pick("depth", "prior", 0.0).alias("prior_session_depth"),
        pick("total", "current", 0).alias("total_visitors"),
        pick("returning", "current", 0).alias("returning_visitors"),
        pick("total", "prior", 0).alias("prior_total"),
    )
    return wide.select(
        "*",
        half_up(F.col("return_rate") - F.col("prior_return_rate"), 4).alias("return_rate_delta"),
        half_up(F.col("session_depth") - F.col("prior_session_depth"), 4).alias("session_depth_delta"),
        (F.col("total_visitors") - F.col("returning_visitors")).alias("new_visitors"),
        (F.col("total_visitors") - F.col("prior_total")).alias("total_delta"),
    )


def surface_activity(content: DataFrame, surfaces: list[tuple[int, str]], as_of: datetime, days: int = 28) -> DataFrame:
    """Newly published items per surface, this window against the one before."""
    spark = content.sparkSession
    wanted = spark.createDataFrame(surfaces, "blog_id int, post_type string")
    live = content.filter(F.col("status") == "publish").withColumn("period", _period(as_of, days, "published_at"))
    counted = wanted.join(live, ["blog_id", "post_type"], "left").groupBy("blog_id", "post_type").agg(
        F.count_if(F.col("period") == "current").alias("current"),
        F.count_if(F.col("period") == "prior").alias("prior"),
    )
    return counted.select(
        "*",
        (F.col("current") - F.col("prior")).alias("delta"),
        half_up(F.col("current") / F.lit(days / 7), 2).alias("per_week"),
    )


def cross_surface_trend(events: DataFrame, as_of: datetime, days: int = 28) -> DataFrame:
    current, prior = _windows(as_of, days)
    now = cross_site_return(events, current).select("rate").scalar()
    before = cross_site_return(events, prior).select("rate").scalar()
    base = events.sparkSession.range(1)
    return base.select(
        now.alias("current"), before.alias("prior"), half_up(now - before, 4).alias("delta")
    )
