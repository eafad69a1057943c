"""Experiment summary and the holdout report."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classify as C
from ..functions import predicates as P
from ..functions import rules
from ..functions.windows import between
from ..functions.stats import lift, ratio, wilson_interval
from ..operators import anchors as A
from ..operators import identity as ID
from ..operators.reuse import Shared
from ..operators.skew import salted_lookup
from .journeys import epoch

ASSIGN, EXPOSE, VIEW, CLICK = "experiment_assignment", "experiment_exposure", "pageview", "bridge_click"
CONTRACT = ["variant", "definition_version", "assignment_policy", "surface"]
COLUMNS = [
    "id", "event_type", "ts", "blog_id", "visitor_id", "user_id", "payload_user_id", "is_bot", "context",
    "post_id", "route_family", "experiment_key", *CONTRACT,
]


class Experiment(Shared):
    """Rows, anchors and attributed outcomes shared by both reports.

    ``holdout`` reads the looser contract: fixed key, surface and variants, no version
    or policy, identity from every human row and no attribution limit.
    """

    def __init__(
        self,
        events: DataFrame,
        as_of: datetime,
        key: str,
        variants: list[str],
        control: str,
        outcomes: list[str],
        version: int | None = None,
        surface: str | None = None,
        days: int = 28,
        attribution_days: int = 28,
        gap: int = 1800,
        holdout: bool = False,
    ):
        super().__init__()
        self.events, self.variants, self.control, self.outcomes = events, variants, control, outcomes
        self.gap, self.holdout = gap, holdout
        self.attribution = None if holdout else attribution_days * 86400
        types = [ASSIGN, EXPOSE, VIEW, *([CLICK] if holdout else []), *outcomes]
        self.types = list(dict.fromkeys(types))
        since, until = epoch(as_of - timedelta(days=days)), epoch(as_of)
        rows = between(events, since, until).filter(P.of_type(self.types) & F.col("ts").between(since, until)).select(*COLUMNS)
        self.loaded = rows
        if holdout:
            fits = (
                (F.coalesce("experiment_key", F.lit("")) == key)
                & (F.coalesce("surface", F.lit("")) == surface)
                & F.coalesce(F.col("variant").isin(variants), F.lit(False))
            )
            status = (
                F.when(~F.col("event_type").isin(ASSIGN, EXPOSE), "not_experiment")
                .when(fits, "matched")
                .otherwise("rejected")
            )
        else:
            status = A.contract_status(key, variants, version)
        human = rows.filter(~P.bot_is_truthy()).withColumn("status", status)
        seen = human if holdout else human.filter(F.col("status").isin("not_experiment", "matched"))
        self.seen = seen
        self.human = self.keep("human", lambda: ID.with_person(human, ID.identity_bridge(seen)))
        self.known = self.human.filter(F.col("person") != "")
        self.contract = ["variant"] if holdout else CONTRACT

    def _matched(self, event_type: str) -> DataFrame:
        return self.known.filter((F.col("event_type") == event_type) & (F.col("status") == "matched"))

    def assignments(self) -> DataFrame:
        """One anchor per person: the first valid assignment fixes its contract."""
        return self.keep(
            "assignments", lambda: A.first_per_person(self._matched(ASSIGN), [*self.contract, "blog_id"])
        )

    def _same_contract(self) -> Column:
        cond = F.lit(True)
        for name in self.contract:
            cond = cond & (F.col(name) == F.col(f"anchor_{name}"))
        return cond

    def exposure_rows(self) -> DataFrame:
        """Valid exposures, attributed only when they match and follow the assignment."""

        def build() -> DataFrame:
            joined = salted_lookup(self._matched(EXPOSE), self.assignments(), "person", how="left")
            ok = F.coalesce(self._same_contract() & A.is_after_anchor(), F.lit(False))
            return joined.withColumn("attributed", ok).drop(*[c for c in joined.columns if c.startswith("anchor_")])

        return self.keep("exposures", build)

    def exposures(self) -> DataFrame:
        return A.first_per_person(self.exposure_rows().filter("attributed"), ["variant", "blog_id"])

    def anchors(self) -> DataFrame:
        return self.keep("anchors", self._anchors)

    def _anchors(self) -> DataFrame:
        cols = ["person", "anchor_ts", "anchor_id", "anchor_variant", "anchor_blog_id"]
        both = self.assignments().select(*cols, F.lit("assignment").alias("lens")).unionByName(
            self.exposures().select(*cols, F.lit("exposure").alias("lens"))
        )
        return A.with_same_session_end(both, self.known.filter(F.col("event_type") == VIEW), self.gap)

    def _outcome_rows(self) -> DataFrame:
        rows = self.known.filter(P.of_type(self.outcomes))
        return rows.filter(~P.automatic_signup()) if self.holdout else rows

    def attributed_outcomes(self) -> DataFrame:
        """First qualifying outcome per person, type and lens, with its session stage."""
        rows = salted_lookup(
            self._outcome_rows().select("id", "event_type", "ts", "person"), self.anchors(), "person"
        ).filter(A.is_after_anchor())
        if self.attribution is not None:
            rows = rows.filter(F.col("ts") - F.col("anchor_ts") <= self.attribution)
        firsts = rows.groupBy("person", "event_type", "lens", F.col("anchor_variant").alias("variant")).agg(
            F.min("ts").alias("ts"), F.min("chain_end").alias("chain_end")
        )
        return firsts.withColumn("stage", A.stage(self.gap))

    # ---- tables ----

    def _variant_frame(self) -> DataFrame:
        return self.events.sparkSession.createDataFrame([(v,) for v in self.variants], "variant string")

    def _instrumented(self) -> DataFrame:
        """Event types ever stored, over all history, which is scanned once."""
        stored = self.events.filter(P.of_type(self.types)).groupBy("event_type")
        return self.keep("instrumented", lambda: stored.agg(F.max(F.lit(True)).alias("instrumented")))

    def _has(self, event_type: str) -> Column:
        return self._instrumented().agg(F.count_if(F.col("event_type") == event_type) > 0).scalar()

    def _has_cohort(self) -> Column:
        return self.assignments().agg(F.count("*") > 0).scalar()

    def state(self) -> DataFrame:
        base = self.events.sparkSession.range(1)
        empty = "no_production_data" if self.holdout else "no_data"
        return base.select(
            F.when(self._has_cohort(), "measured").when(self._has(ASSIGN), empty).otherwise("not_instrumented").alias("state")
        )

    def populations(self) -> DataFrame:
        """People and rows per variant for both anchors."""
        assigned = self.assignments().groupBy(F.col("anchor_variant").alias("variant")).agg(F.count("*").alias("assigned"))
        a_rows = self._matched(ASSIGN).groupBy("variant").agg(F.count("*").alias("assignment_events"))
        exposed = self.exposures().groupBy(F.col("anchor_variant").alias("variant")).agg(F.count("*").alias("exposed"))
        e_rows = self.exposure_rows().filter("attributed").groupBy("variant").agg(F.count("*").alias("exposure_events"))
        out = self._variant_frame()
        for part in (assigned, a_rows, exposed, e_rows):
            out = out.join(part, "variant", "left")
        return out.na.fill(0)

    def variants_table(self) -> DataFrame:
        cohort, expose = self._has_cohort(), self._has(EXPOSE)
        lo, hi = wilson_interval(F.col("exposed"), F.col("assigned"))
        shown = lambda col: F.when(cohort, F.col(col))
        seen = lambda col: F.when(expose, col)
        return self.populations().select(
            "variant",
            shown("assigned").alias("assigned_people"),
            shown("assignment_events").alias("assignment_events"),
            seen(shown("exposed")).alias("exposed_people"),
            seen(shown("exposure_events")).alias("exposure_events"),
            seen(ratio(F.col("exposed"), F.col("assigned"), 4)).alias("exposure_rate"),
            seen(lo).alias("exposure_rate_lower"),
            seen(hi).alias("exposure_rate_upper"),
            F.when(~expose, "not_instrumented").when(cohort, "measured").otherwise("no_data").alias("exposure_status"),
        )

    def outcomes_table(self) -> DataFrame:
        """Per variant and outcome: people, rate, interval and session split on both lenses, with lift."""
        hits = self.attributed_outcomes().groupBy("variant", "event_type").agg(
            *[
                F.count_if((F.col("lens") == lens) & cond).alias(f"{short}_{name}")
                for lens, short in (("assignment", "a"), ("exposure", "x"))
                for name, cond in (
                    ("people", F.lit(True)),
                    ("same", F.col("stage") == "same_session"),
                    ("later", F.col("stage") == "later_session"),
                )
            ]
        )
        spark = self.events.sparkSession
        kinds = spark.createDataFrame([(v, o) for v in self.variants for o in self.outcomes], "variant string, event_type string")
        base = kinds.join(self.populations(), "variant").join(hits, ["variant", "event_type"], "left").na.fill(0)
        control = base.filter(F.col("variant") == self.control).select(
            "event_type", F.col("a_people").alias("c_people"), F.col("assigned").alias("c_assigned")
        )
        base = base.join(control, "event_type").join(self._instrumented(), "event_type", "left")
        cohort = self._has_cohort()
        known = F.coalesce("instrumented", F.lit(False))
        ready = known & cohort
        seen = ready & self._has(EXPOSE)
        alo, ahi = wilson_interval(F.col("a_people"), F.col("assigned"))
        xlo, xhi = wilson_interval(F.col("x_people"), F.col("exposed"))
        lifts = lift(
            F.col("a_people"), F.col("assigned"), F.col("c_people"), F.col("c_assigned"), F.col("variant") == self.control
        )
        shown = {
            "assigned_outcome_people": F.col("a_people"),
            "assigned_rate": ratio(F.col("a_people"), F.col("assigned"), 4),
            "assigned_rate_lower": alo,
            "assigned_rate_upper": ahi,
            "assigned_same_session": F.col("a_same"),
            "assigned_later_session": F.col("a_later"),
            **lifts,
        }
        shown_x = {
            "exposed_outcome_people": F.col("x_people"),
            "exposed_rate": ratio(F.col("x_people"), F.col("exposed"), 4),
            "exposed_rate_lower": xlo,
            "exposed_rate_upper": xhi,
            "exposed_same_session": F.col("x_same"),
            "exposed_later_session": F.col("x_later"),
        }
        return base.select(
            "variant",
            "event_type",
            F.when(~known, "not_instrumented").when(cohort, "measured").otherwise("no_data").alias("coverage_status"),
            *[F.when(ready, c).alias(n) for n, c in shown.items()],
            *[F.when(seen, c).alias(n) for n, c in shown_x.items()],
        )

    def coverage(self) -> DataFrame:
        """Excluded, duplicate and unattributed rows."""
        bots = self.loaded.agg(F.count_if(P.bot_is_truthy()).alias("b"), F.count("*").alias("n"))
        rejects = self.human.agg(
            F.count_if(F.col("status") == "other_experiment").alias("other"),
            F.count_if(F.col("status") == "invalid_contract").alias("invalid"),
            F.count_if(F.col("status") == "other_definition_version").alias("version"),
            F.count_if((F.col("status") == "rejected") & (F.col("person") != "")).alias("rejected"),
            F.count_if(
                (F.col("person") == "") & (F.lit(self.holdout) | F.col("status").isin("not_experiment", "matched"))
            ).alias("nobody"),
        )
        anchored = salted_lookup(self._matched(ASSIGN), self.assignments(), "person")
        dup = anchored.agg(
            F.count_if(F.col("id") != F.col("anchor_id")).alias("duplicates"),
            F.count_if((F.col("id") != F.col("anchor_id")) & ~self._same_contract()).alias("conflicts"),
        )
        exposure = self.exposure_rows().agg(
            F.count_if("attributed").alias("ok"), F.count_if(~F.col("attributed")).alias("lost")
        )
        people = self.exposures().agg(F.count("*").alias("n"))
        outs = salted_lookup(self._outcome_rows(), self.assignments(), "person", how="left").agg(
            F.count_if(F.col("anchor_ts").isNotNull() & ~A.is_after_anchor()).alias("early"),
            F.count_if(F.col("anchor_ts").isNull()).alias("lost"),
        )
        who = ID.ambiguous_visitors(self.seen)
        row = [
            bots.select("n").scalar().alias("loaded_rows"),
            bots.select("b").scalar().alias("bot_rows_excluded"),
            rejects.select("nobody").scalar().alias("unidentified_rows"),
        ]
        if self.holdout:
            row.append(rejects.select("rejected").scalar().alias("contract_rows_rejected"))
        else:
            row += [
                rejects.select("other").scalar().alias("other_experiment_rows"),
                rejects.select("invalid").scalar().alias("invalid_contract_rows"),
                rejects.select("version").scalar().alias("other_definition_version_rows"),
            ]
        row += [
            dup.select("duplicates").scalar().alias("duplicate_assignment_events"),
            dup.select("conflicts").scalar().alias("conflicting_assignment_events"),
            (exposure.select("ok").scalar() - people.scalar()).alias("duplicate_exposure_events"),
            exposure.select("lost").scalar().alias("unattributed_exposure_events"),
            outs.select("early").scalar().alias("pre_assignment_outcome_events"),
            outs.select("lost").scalar().alias("unattributed_outcome_events"),
            who.select("ambiguous_visitor_ids").scalar().alias("ambiguous_visitor_ids"),
        ]
        return self.events.sparkSession.range(1).select(*row)

    # ---- holdout tables ----

    def clicks(self) -> DataFrame:
        """Bridge clicks after each anchor, as events and as people."""
        rows = salted_lookup(
            self.known.filter(F.col("event_type") == CLICK).select("id", "ts", "person"),
            self.assignments().select("person", "anchor_ts", "anchor_id", "anchor_variant", F.lit("assignment").alias("lens"))
            .unionByName(
                self.exposures().select("person", "anchor_ts", "anchor_id", "anchor_variant", F.lit("exposure").alias("lens"))
            ),
            "person",
        ).filter(A.is_after_anchor())
        per = rows.groupBy("person", "lens", F.col("anchor_variant").alias("variant")).agg(F.count("*").alias("n"))
        hits = per.groupBy("variant").agg(
            *[
                expr.alias(f"click_{kind}_{lens}")
                for lens in ("assignment", "exposure")
                for kind, expr in (
                    ("events", F.sum(F.when(F.col("lens") == lens, F.col("n")))),
                    ("people", F.count_if(F.col("lens") == lens)),
                )
            ]
        )
        out = self.populations().join(hits, "variant", "left").na.fill(0)
        return out.select(
            "variant",
            "assigned",
            "exposed",
            "click_events_assignment",
            "click_people_assignment",
            ratio(F.col("click_events_assignment"), F.col("assigned"), 4).alias("events_per_assignment"),
            "click_events_exposure",
            "click_people_exposure",
            ratio(F.col("click_events_exposure"), F.col("exposed"), 4).alias("events_per_exposure"),
        )

    def first_cross_surface(self) -> DataFrame:
        """First pageview on another blog after each anchor."""
        views = self.known.filter(F.col("event_type") == VIEW).select(
            "id", "ts", "person", "blog_id", C.route_family(F.col("route_family"), F.col("post_id")).alias("route_family")
        )
        rows = salted_lookup(views, self.anchors(), "person")
        rows = rows.filter(A.is_after_anchor() & (F.col("blog_id") != F.col("anchor_blog_id")))
        edge = F.struct("ts", "id", "blog_id", "route_family")
        first = rows.groupBy("person", "lens", F.col("anchor_variant").alias("variant"), "chain_end").agg(
            F.min(edge).alias("v")
        )
        return first.select(
            "person", "lens", "variant", "chain_end", F.col("v.ts").alias("ts"),
            F.col("v.blog_id").alias("destination_blog_id"), F.col("v.route_family").alias("route_family"),
        ).withColumn("session_stage", A.stage(self.gap)).drop("chain_end", "ts")

    def cross_surface_table(self) -> DataFrame:
        return self.first_cross_surface().groupBy(
            "variant", "lens", "destination_blog_id", "route_family", "session_stage"
        ).agg(F.count("*").alias("people"))

    def outcome_stages(self) -> DataFrame:
        return self.attributed_outcomes().groupBy("variant", "event_type", "lens", "stage").agg(
            F.count("*").alias("people")
        )


def experiment_summary(events: DataFrame, as_of: datetime, key: str, variants: list[str], control: str,
                       outcomes: list[str], **options) -> Experiment:
    return Experiment(events, as_of, key, variants, control, outcomes, **options)


def holdout_experiment(events: DataFrame, as_of: datetime, key: str, surface: str, variants: list[str],
                       outcomes: list[str] = rules.CONVERSION_OUTCOMES, **options) -> Experiment:
    return Experiment(
        events, as_of, key, variants, variants[0], outcomes, surface=surface, holdout=True, **options
    )
