"""Activation funnel, conversion map, outcome attribution and crosslink targets."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import rules, urls
from ..functions.windows import between
from ..functions.stats import half_up, ratio
from ..operators import funnel as FN
from ..operators import identity as ID
from ..operators import sessions as S
from ..operators.reuse import Shared
from ..operators.skew import salted_lookup
from .journeys import epoch, known_pageviews


class ActivationFunnel(Shared):
    def __init__(
        self,
        events: DataFrame,
        as_of: datetime,
        days: int = 28,
        blog_id: int = 0,
        steps: list[str] = rules.ACTIVATION_STEPS,
        friction: list[str] = rules.ACTIVATION_FRICTION,
        access: list[str] = rules.ACTIVATION_ACCESS,
    ):
        super().__init__()
        self.steps_of, self.friction, self.access = steps, friction, access
        cond = P.of_type([*steps, *friction, *access]) & P.scoped(blog_id) & (F.col("ts") <= epoch(as_of))
        since = epoch(as_of - timedelta(days=days)) if days > 0 else None
        if since is not None:
            cond = cond & (F.col("ts") >= since)
        rows = between(events, since, epoch(as_of)).filter(cond).select("id", "event_type", "ts", "visitor_id", "user_id", "payload_user_id")
        self.rows = self.keep(
            "rows", lambda: ID.with_person(rows, ID.identity_bridge(rows)).filter(F.col("person") != "")
        )

    def counted(self) -> DataFrame:
        return FN.ordered_funnel(self.rows, self.steps_of)

    def steps(self) -> DataFrame:
        return FN.funnel_rates(self.counted())

    def summary(self) -> DataFrame:
        return FN.funnel_summary(self.counted())

    def reach(self) -> DataFrame:
        return FN.reach(self.rows, {"anomaly": self.friction, "access": self.access})


SURFACES = {"events": 2, "community": 3, "artist": 4}
LENSES = ("direct_source", "same_session", "later_session")


class ConversionMap(Shared):
    """Editorial entry journeys and what became of them."""

    def __init__(
        self,
        events: DataFrame,
        content: DataFrame,
        terms: DataFrame,
        as_of: datetime,
        days: int = 28,
        gap: int = 1800,
        observation_days: int = 7,
        entry_blog: int = 1,
        entry_host: str = "",
        surfaces: dict[str, int] = SURFACES,
        author_id: int = 0,
        outcomes: list[str] = rules.CONVERSION_OUTCOMES,
        lifecycle: list[str] = rules.LIFECYCLE_OUTCOMES,
    ):
        super().__init__()
        self.gap, self.entry_blog, self.surfaces = gap, entry_blog, surfaces
        self.entry_host, self.author_id = entry_host, author_id
        self.outcome_types, self.lifecycle = outcomes, lifecycle
        self.since, self.end = epoch(as_of - timedelta(days=days)), epoch(as_of)
        self.mature = epoch(as_of - timedelta(days=observation_days))
        self.events, self.terms = events, terms
        self.posts = content.filter(
            (F.col("blog_id") == entry_blog) & (F.col("post_type") == "post") & (F.col("status") == "publish")
        )
        self.eligible_posts = self.posts.filter(F.col("author_id") == author_id) if author_id > 0 else self.posts

    # ---- reach ----

    def pageviews(self) -> DataFrame:
        """Known pageviews, one gap of context included, of visitors who touched the entry blog."""
        rows = self._views()
        touched = rows.filter(F.col("blog_id") == self.entry_blog).groupBy("visitor_id").agg(F.count("*").alias("_n"))
        return salted_lookup(rows, touched.select("visitor_id"), "visitor_id", how="left_semi")

    def _views(self) -> DataFrame:
        """Known pageviews, one gap of context included."""
        rows = between(known_pageviews(self.events), self.since - self.gap, self.end)
        return rows.filter((F.col("ts") >= self.since - self.gap) & (F.col("ts") < self.end)).select(
            "id", "visitor_id", "ts", "blog_id", "post_id"
        )

    def journeys(self) -> DataFrame:
        """The first eligible, mature entry journey of every visitor."""
        return self.keep("journeys", self._journeys)

    def _journeys(self) -> DataFrame:
        flags = {f"on_{name}": F.col("blog_id") == blog for name, blog in self.surfaces.items()}
        # visitors without an entry drop out below, so no filter by visitor is needed here
        sessions = S.session_table(self._views(), self.gap, flags=flags, ends=["blog_id", "post_id"])
        posts = self.eligible_posts.select(F.col("post_id").alias("_key"), F.lit(True).alias("_post"))
        may = (F.col("first_blog_id") == self.entry_blog) & F.col("session_start").between(self.since, self.mature)
        # sessions that cannot be entries, and those without a post, probe with keys of their own
        own = -1 - F.pmod(F.xxhash64("visitor_id", "session_start"), F.lit(1 << 30))
        probe = F.coalesce(F.when(may, F.col("first_post_id")), own)
        entry = may & F.coalesce("_post", F.lit(False))
        per_visitor = Window.partitionBy("visitor_id")
        start = F.min(F.when(entry, F.col("session_start"))).over(per_visitor)
        rows = salted_lookup(sessions.withColumn("_key", probe), posts, "_key", "visitor_id", "left").withColumn("entry_ts", start)
        rows = rows.filter(F.col("entry_ts").isNotNull())
        same, later = F.col("session_start") == F.col("entry_ts"), F.col("session_start") > F.col("entry_ts")
        hit = lambda cond, name: F.coalesce(F.max(cond & F.col(f"on_{name}")), F.lit(False))
        out = rows.groupBy("visitor_id", "entry_ts").agg(
            F.max(F.when(same, F.col("first_post_id"))).alias("post_id"),
            F.max(F.when(same, F.col("session_last") + self.gap)).alias("same_session_through"),
            F.coalesce(F.max(later), F.lit(False)).alias("returned"),
            *[hit(same, n).alias(f"{n}_same") for n in self.surfaces],
            *[hit(later, n).alias(f"{n}_return") for n in self.surfaces],
        )
        any_of = lambda suffix: F.greatest(*[F.col(f"{n}_{suffix}") for n in self.surfaces])
        return out.withColumn("any_same", any_of("same")).withColumn("any_return", any_of("return")).withColumn(
            "any", F.greatest("any_same", "any_return")
        )

    def _flags(self) -> list[str]:
        names = [*self.surfaces, "any"]
        return [f"{n}_{s}" for s in ("same", "return") for n in names]

    def _rates(self, journeys: DataFrame, *keys: str) -> DataFrame:
        counts = journeys.groupBy(*keys).agg(
            F.count("*").alias("entry_sessions"),
            F.count_if("any").alias("reached_any"),
            F.count_if("returned").alias("returned_count"),
            *[F.count_if(f).alias(f"_{f}") for f in self._flags()],
        )
        n = F.col("entry_sessions")
        return counts.select(
            *keys,
            "entry_sessions",
            "reached_any",
            ratio(F.col("reached_any"), n, 4, 0.0).alias("reached_any_rate"),
            *[ratio(F.col(f"_{f}"), n, 4, 0.0).alias(f"{f}_rate") for f in self._flags()],
            ratio(F.col("returned_count"), n, 4, 0.0).alias("returned_rate"),
            "returned_count",
        )

    def overall(self) -> DataFrame:
        return self._rates(self.journeys())

    def by_article(self, top: int | None = 25, min_entry_sessions: int = 1) -> DataFrame:
        rates = self._rates(self.journeys(), "post_id").filter(F.col("entry_sessions") >= min_entry_sessions)
        if top is not None:
            rates = rates.orderBy(F.desc("entry_sessions"), "post_id").limit(top)
        return self._titled(rates)

    def _titled(self, rows: DataFrame) -> DataFrame:
        dim = self.posts.select("post_id", "title", "slug", F.concat(F.lit("/"), F.regexp_replace(
            urls.path(F.col("url")), "^/+", "")).alias("path"))
        return rows.join(dim, "post_id", "left").select(
            *rows.columns,
            F.coalesce("title", F.lit("(unknown)")).alias("title"),
            F.coalesce("slug", F.lit("")).alias("slug"),
            F.coalesce("path", F.lit("")).alias("path"),
        )

    def _categories(self) -> DataFrame:
        mine = self.terms.filter(F.col("blog_id") == self.entry_blog)
        return mine.select("post_id", "term_id", F.col("name").alias("category"))

    def by_category(self, min_entry_sessions: int = 1) -> DataFrame:
        """A journey counts in every category of its entry article."""
        fanned = self.journeys().join(self._categories(), "post_id")
        return (
            self._rates(fanned, "term_id", "category")
            .filter(F.col("entry_sessions") >= min_entry_sessions)
            .orderBy(F.desc("entry_sessions"), "term_id")
        )

    # ---- outcomes ----

    def outcome_rows(self) -> DataFrame:
        """Outcome rows with person, direct article and journey stage."""
        return self.keep("outcomes", self._outcome_rows)

    def _outcome_rows(self) -> DataFrame:
        rows = between(self.events, self.since, self.end).filter(
            P.of_type(self.outcome_types) & (F.col("ts") >= self.since) & (F.col("ts") < self.end)
        ).select("id", "event_type", "ts", "visitor_id", "user_id", "payload_user_id", "source_url", "context")
        rows = rows.withColumn("excluded", P.automatic_signup())
        bridge = ID.identity_bridge(rows.filter(~F.col("excluded")))
        rows = ID.with_person(rows, bridge, event_fallback=True)
        rows = self._with_source_article(rows)
        trips = self.journeys().select(
            "visitor_id", "entry_ts", "same_session_through", F.col("post_id").alias("journey_post")
        )
        keyed = rows.withColumn(
            "_v", F.when(P.identified(), F.concat(F.lit("v"), F.col("visitor_id"))).otherwise(
                F.concat(F.lit("#"), F.col("id").cast("string")))
        )
        trips = trips.select(F.concat(F.lit("v"), F.col("visitor_id")).alias("_v"), *trips.columns[1:])
        rows = salted_lookup(keyed, trips, "_v", how="left").drop("_v")
        ts = F.col("ts")
        stage = F.when(ts >= F.col("entry_ts"), F.when(ts <= F.col("same_session_through"), "same_session").otherwise(
            "later_session"))
        rows = rows.withColumn("has_journey", F.col("entry_ts").isNotNull()).withColumn("stage", stage)
        if self.author_id > 0:
            rows = rows.filter(F.col("direct_post").isNotNull() | F.col("has_journey"))
        return rows

    def _with_source_article(self, rows: DataFrame) -> DataFrame:
        """Published entry-blog article the source URL points at; host compared without www."""
        key = lambda url: F.regexp_replace(urls.route_path(url), "/+$", "")
        posts = self.posts.groupBy(key(F.col("url")).alias("_path")).agg(F.min("post_id").alias("resolved_post"))
        mine = self.eligible_posts.select(F.col("post_id").alias("resolved_post"), F.lit(True).alias("_mine"))
        posts = posts.join(mine, "resolved_post", "left")
        here = urls.host_without_www(F.col("source_url")) == self.entry_host
        # Rows of other hosts probe with a key of their own, so they do not pile up in one task.
        probe = F.when(here, key(F.col("source_url"))).otherwise(F.concat(F.lit("#"), F.col("id").cast("string")))
        out = salted_lookup(rows.withColumn("_path", probe), posts, "_path", how="left").drop("_path")
        return out.withColumn("direct_post", F.when(F.col("_mine"), F.col("resolved_post"))).withColumn(
            "outside", F.lit(self.author_id > 0) & F.col("resolved_post").isNotNull() & F.col("direct_post").isNull()
        ).drop("_mine")

    def records(self) -> DataFrame:
        """One row per (type, person); a later duplicate may fill attribution the first row lacks."""
        return self.keep("records", self._records)

    def _records(self) -> DataFrame:
        order = F.struct("ts", "id")
        first = lambda col, cond: F.min_by(col, F.when(cond, order))
        direct, staged = F.col("direct_post").isNotNull(), F.col("stage").isNotNull()
        return self.outcome_rows().filter(~F.col("excluded")).groupBy("event_type", "person").agg(
            F.count("*").alias("rows"),
            F.max(F.trim(F.coalesce("source_url", F.lit(""))) != "").alias("has_source"),
            F.max("outside").alias("outside"),
            first("direct_post", direct).alias("direct_post"),
            F.max(P.identified()).alias("has_visitor"),
            F.max(F.col("has_journey") & F.col("stage").isNull()).alias("saw_before"),
            first("stage", staged).alias("stage"),
            first("journey_post", staged).alias("journey_post"),
        )

    def coverage(self) -> DataFrame:
        """Fourteen counters and three statuses per outcome type."""
        stored = self.outcome_rows().groupBy("event_type").agg(
            F.count("*").alias("stored_events"), F.count_if("excluded").alias("automatic_registration_excluded")
        )
        direct, staged = F.col("direct_post").isNotNull(), F.col("stage").isNotNull()
        sourced = direct | (~F.col("outside") & F.col("has_source"))
        known = staged | F.col("has_visitor")
        tally = self.records().groupBy("event_type").agg(
            F.count("*").alias("deduplicated_outcomes"),
            (F.sum("rows") - F.count("*")).alias("duplicate_events"),
            F.count_if(sourced).alias("with_source_url"),
            F.count_if(direct).alias("direct_source_attributed"),
            F.count_if(~direct & ~F.col("outside") & ~F.col("has_source")).alias("missing_source_url"),
            F.count_if(~direct & ~F.col("outside") & F.col("has_source")).alias("unresolved_source_url"),
            F.count_if(~direct & F.col("outside")).alias("source_outside_scope"),
            F.count_if(known).alias("with_visitor_identity"),
            F.count_if(~known).alias("missing_visitor_identity"),
            F.count_if(staged).alias("visitor_journey_attributed"),
            F.count_if(~staged & F.col("has_visitor") & ~F.col("saw_before")).alias("identity_without_eligible_journey"),
            F.count_if(~staged & F.col("has_visitor") & F.col("saw_before")).alias("outcome_before_entry"),
        )
        kinds = self.events.sparkSession.createDataFrame(
            [(t, t in self.lifecycle) for t in self.outcome_types], "event_type string, gap_if_absent boolean"
        )
        out = kinds.join(stored, "event_type", "left").join(tally, "event_type", "left")
        counters = [c for c in out.columns if c not in ("event_type", "gap_if_absent")]
        out = out.select("event_type", "gap_if_absent", *[F.coalesce(c, F.lit(0)).alias(c) for c in counters])
        total = F.col("deduplicated_outcomes")

        def status(seen: str, full: str) -> Column:
            return (
                F.when(total == 0, F.when(F.col("gap_if_absent"), "not_instrumented").otherwise("measured"))
                .when(F.col(seen) == 0, "not_instrumented")
                .when(F.col(full) == total, "measured")
                .otherwise("partial")
            )

        return out.select(
            "event_type",
            *counters,
            F.when(F.col("stored_events") == 0, "not_observed").otherwise("observed").alias("instrumentation_status"),
            status("with_source_url", "direct_source_attributed").alias("direct_source_status"),
            status("with_visitor_identity", "with_visitor_identity").alias("visitor_journey_status"),
        )

    def outcomes_overall(self) -> DataFrame:
        """Counts per lens; NULL, not zero, where a lens is not instrumented."""
        counts = self.records().groupBy("event_type").agg(
            F.count_if(F.col("direct_post").isNotNull()).alias("d"),
            F.count_if(F.col("stage") == "same_session").alias("s"),
            F.count_if(F.col("stage") == "later_session").alias("l"),
        )
        cover = self.coverage().select("event_type", "direct_source_status", "visitor_journey_status")
        shown = lambda status, col: F.when(
            F.col(status) != "not_instrumented", F.coalesce(col, F.lit(0))
        )
        return cover.join(counts, "event_type", "left").select(
            "event_type",
            shown("direct_source_status", "d").alias("direct_source"),
            "direct_source_status",
            shown("visitor_journey_status", "s").alias("same_session"),
            shown("visitor_journey_status", "l").alias("later_session"),
            "visitor_journey_status",
        )

    def signals(self) -> DataFrame:
        """Attribution signals as (event_type, post_id, lens); the two lenses are independent."""
        pair = F.array(
            F.struct(F.col("direct_post").alias("post_id"), F.lit("direct_source").alias("lens")),
            F.struct(F.col("journey_post").alias("post_id"), F.col("stage").alias("lens")),
        )
        rows = self.records().select("event_type", F.explode(pair).alias("x")).select("event_type", "x.*")
        return rows.filter((F.col("post_id") > 0) & F.col("lens").isNotNull())

    @staticmethod
    def _lens_counts() -> list[Column]:
        lenses = [F.count_if(F.col("lens") == lens).alias(lens) for lens in LENSES]
        return [F.count("*").alias("attribution_signals"), *lenses]

    def outcomes_by_article(self, top: int = 25) -> DataFrame:
        grouped = self.signals().groupBy("post_id").agg(*self._lens_counts())
        return self._titled(grouped.orderBy(F.desc("attribution_signals"), "post_id").limit(top))

    def outcomes_by_category(self) -> DataFrame:
        fanned = self.signals().join(self._categories(), "post_id")
        return fanned.groupBy("term_id", "category").agg(*self._lens_counts()).orderBy(
            F.desc("attribution_signals"), "term_id"
        )


def inbound_links(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Inbound links per scanned page, self links ignored, zero when nothing links to it."""
    counted = (
        edges.filter((F.col("target_id") > 0) & (F.col("target_id") != F.col("source_id")))
        .groupBy(F.col("target_id").alias("post_id"))
        .agg(F.count("*").alias("n"))
    )
    out = nodes.select("post_id").join(counted, "post_id", "left")
    inbound = F.coalesce("n", F.lit(0))
    return out.select("post_id", inbound.alias("inbound_links"), (inbound == 0).alias("orphan"))


def crosslink_targets(
    articles: DataFrame, inbound: DataFrame, limit: int = 25, max_inbound: int = 2, min_returned: int = 1
) -> DataFrame:
    """Articles readers come back to that few pages link to; unscanned pages are skipped."""
    rows = articles.filter(F.col("returned_count") >= min_returned).join(inbound, "post_id")
    rows = rows.filter(F.col("inbound_links") <= max_inbound)
    score = half_up(F.col("returned_count") / (F.col("inbound_links") + 1), 2)
    return (
        rows.select(
            "post_id", "title", "slug", "entry_sessions", F.col("returned_count").alias("returned"),
            "returned_rate", "reached_any", "inbound_links", "orphan", score.alias("score"),
        )
        .orderBy(F.desc("score"), F.desc("returned"), "post_id")
        .limit(limit)
    )
