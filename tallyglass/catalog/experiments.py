"""Experiment summary and holdout report."""

from datetime import timedelta

from pyspark.sql import functions as F

from ..functions.rules import CONVERSION_OUTCOMES
from ..functions.stats import Z95, lift, wilson_interval
from ..operators import anchors as A
from ..plans.experiments import experiment_summary, holdout_experiment
from ..plans.journeys import epoch
from ..sources import bind as B
from . import query
from .people import bridge_sql, person_sql, types_in
from .rules_sql import lit, route_family

KEY, VARIANTS, OUTCOMES = "card-holdout", ["control", "treatment"], ["newsletter_signup", "user_registration", "outbound_click", "onboarding_completed"]
SINCE, UNTIL = epoch(B.AS_OF - timedelta(days=28)), epoch(B.AS_OF)
GAP, ATTR = B.GAP_12H, 10 * 86400
KEYS = "ts * 1000000000 + id"

_STATUS = f"""CASE WHEN event_type NOT IN ('experiment_assignment', 'experiment_exposure') THEN 'not_experiment'
 WHEN experiment_key <> '{KEY}' THEN 'other_experiment' WHEN definition_version NOT BETWEEN 1 AND 1000000 THEN 'invalid_contract'
 WHEN definition_version <> 1 THEN 'other_definition_version' WHEN regexp_matches(assignment_policy, '{A.IDENTIFIER}')
 AND variant IN ('control', 'treatment') AND regexp_matches(surface, '{A.IDENTIFIER}') THEN 'matched' ELSE 'invalid_contract' END"""
_HSTATUS = f"""CASE WHEN event_type NOT IN ('experiment_assignment', 'experiment_exposure') THEN 'not_experiment'
 WHEN experiment_key = '{KEY}' AND surface = 'post-card' AND variant IN ('control', 'treatment') THEN 'matched' ELSE 'rejected' END"""


def _ctes(holdout: bool) -> dict[str, str]:
    types = ["experiment_assignment", "experiment_exposure", "pageview"] + (["bridge_click", *CONVERSION_OUTCOMES] if holdout else OUTCOMES)
    outs = CONVERSION_OUTCOMES if holdout else OUTCOMES
    same = "x.variant = a.variant" if holdout else (
        "x.variant = a.variant AND x.definition_version = a.definition_version AND x.assignment_policy = a.assignment_policy AND x.surface = a.surface"
    )
    skip = "AND NOT coalesce(event_type = 'newsletter_signup' AND context = 'registration', false)" if holdout else ""
    limit = "" if holdout else f"AND o.ts - k.ats <= {ATTR}"
    return {
        "ld": f"SELECT * FROM e WHERE {types_in(types)} AND ts BETWEEN {SINCE} AND {UNTIL}",
        "hu": f"SELECT *, {_HSTATUS if holdout else _STATUS} AS status FROM ld WHERE is_bot IS NULL OR is_bot IN ('false', '0', '', '[]')",
        "seen": "SELECT * FROM hu" + ("" if holdout else " WHERE status IN ('not_experiment', 'matched')"),
        "b": bridge_sql("seen"),
        "hp": person_sql("hu", "b"),
        "kn": "SELECT *, ts * 1000000000 + id AS pos FROM hp WHERE person <> ''",
        "asg": "SELECT * FROM kn WHERE event_type = 'experiment_assignment' AND status = 'matched'",
        "a": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts, id) AS rn FROM asg) WHERE rn = 1",
        "xr": f"""SELECT x.*, coalesce({same} AND x.pos > a.pos, false) AS attributed FROM kn x LEFT JOIN a ON a.person = x.person
          WHERE x.event_type = 'experiment_exposure' AND x.status = 'matched'""",
        "x": "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY person ORDER BY ts, id) AS rn FROM xr WHERE attributed) WHERE rn = 1",
        "anc": """SELECT person, 'assignment' AS lens, variant, blog_id AS ab, ts AS ats, pos AS aat FROM a UNION ALL
          SELECT person, 'exposure', variant, blog_id, ts, pos FROM x""",
        # ordered walk over the pageviews after each anchor
        "walk": f"""SELECT k.person, k.lens, k.variant, k.ab, k.ats, v.ts, v.pos, v.id, v.blog_id, {route_family("v.route_family", "v.post_id")} AS fam,
          CASE WHEN v.ts - coalesce(lag(v.ts) OVER w, k.ats) > {GAP} THEN 1 ELSE 0 END AS brk FROM anc k JOIN kn v ON v.person = k.person
          AND v.event_type = 'pageview' AND v.pos > k.aat WINDOW w AS (PARTITION BY k.person, k.lens ORDER BY v.ts, v.id)""",
        "wk": "SELECT *, sum(brk) OVER (PARTITION BY person, lens ORDER BY ts, id) AS broken FROM walk",
        "oc": f"""SELECT k.person, k.lens, k.variant, o.event_type, o.ts, o.pos, k.ats, row_number() OVER (PARTITION BY k.person, k.lens, o.event_type ORDER BY o.ts, o.id) AS rn
          FROM anc k JOIN kn o ON o.person = k.person AND {types_in(outs).replace("event_type", "o.event_type")} AND o.pos > k.aat {limit} {skip.replace("event_type", "o.event_type")}""",
        "os": f"""SELECT oc.person, oc.lens, oc.variant, oc.event_type, CASE WHEN coalesce(max(w.broken), 0) > 0 OR oc.ts - coalesce(max(w.ts), max(oc.ats)) > {GAP}
          THEN 'later_session' ELSE 'same_session' END AS stage FROM oc LEFT JOIN wk w ON w.person = oc.person AND w.lens = oc.lens AND w.pos < oc.pos
          WHERE rn = 1 GROUP BY 1, 2, 3, 4, oc.ts""",
        "pop": """SELECT v.variant, (SELECT count(*) FROM a WHERE a.variant = v.variant) AS assigned, (SELECT count(*) FROM asg WHERE asg.variant = v.variant) AS assignment_events,
          (SELECT count(*) FROM x WHERE x.variant = v.variant) AS exposed, (SELECT count(*) FROM xr WHERE attributed AND xr.variant = v.variant) AS exposure_events
          FROM (VALUES ('control'), ('treatment')) v(variant)""",
    }


EX, HO = _ctes(False), _ctes(True)


def _wilson(s: str, n: str, side: int) -> str:
    p = f"(CAST({s} AS DOUBLE) / {n})"
    z2 = Z95 * Z95
    scale = f"(1 + {z2!r} / {n})"
    mid = f"(({p} + {z2!r} / (2 * {n})) / {scale})"
    half = f"({Z95!r} * sqrt(({p} * (1 - {p}) + {z2!r} / (4 * {n})) / {n}) / {scale})"
    raw = f"greatest(0.0, {mid} - {half})" if side < 0 else f"least(1.0, {mid} + {half})"
    return f"CASE WHEN {n} > 0 AND {s} BETWEEN 0 AND {n} THEN {raw} END"


def _wr(s: str, n: str, side: int) -> str:
    return B.sql_round(_wilson(s, n, side), 4)


def _lift_sql(s: str, n: str, cs: str, cn: str, control: str) -> dict[str, str]:
    ok = f"{n} > 0 AND {cn} > 0 AND {s} <= {n} AND {cs} <= {cn}"
    r1, r0 = f"(CAST({s} AS DOUBLE) / nullif({n}, 0))", f"(CAST({cs} AS DOUBLE) / nullif({cn}, 0))"
    lo1, up1, lo0, up0 = (f"({_wilson(a, b, d)})" for a, b, d in ((s, n, -1), (s, n, 1), (cs, cn, -1), (cs, cn, 1)))
    inner = f"{s} > 0 AND {s} < {n} AND {cs} > 0 AND {cs} < {cn}"
    log_rr, err = f"ln({r1} / {r0})", f"sqrt(1.0 / {s} - 1.0 / {n} + 1.0 / {cs} - 1.0 / {cn})"
    when = lambda cond, v: f"CASE WHEN {cond} THEN {v} END"
    comp = f"{ok} AND NOT {control}"
    zero = lambda v: f"CASE WHEN {ok} AND {control} THEN 0.0::DOUBLE WHEN {ok} THEN {v} END"
    return {
        "lift_absolute": zero(B.sql_round(f"{r1} - {r0}", 4)),
        "lift_relative": zero(f"CASE WHEN {cs} > 0 THEN " + B.sql_round(f"({r1} - {r0}) / nullif({r0}, 0)", 4) + " END"),
        "lift_absolute_lower": when(comp, B.sql_round(f"greatest(-1.0, {r1} - {r0} - sqrt(({r1} - {lo1}) ** 2 + ({up0} - {r0}) ** 2))", 4)),
        "lift_absolute_upper": when(comp, B.sql_round(f"least(1.0, {r1} - {r0} + sqrt(({up1} - {r1}) ** 2 + ({r0} - {lo0}) ** 2))", 4)),
        "lift_relative_lower": when(f"{comp} AND {inner}", B.sql_round(f"exp({log_rr} - {Z95!r} * {err}) - 1", 4)),
        "lift_relative_upper": when(f"{comp} AND {inner}", B.sql_round(f"exp({log_rr} + {Z95!r} * {err}) - 1", 4)),
        "lift_status": f"""CASE WHEN {n} <= 0 OR {cn} <= 0 THEN 'zero_denominator' WHEN NOT ({ok}) THEN 'insufficient_data' WHEN {control} THEN 'control_reference'
          WHEN {inner} THEN 'measured' ELSE 'insufficient_data' END""",
    }


def summary(spark, sf):
    return experiment_summary(
        B.events(spark, sf), B.AS_OF, KEY, VARIANTS, "control", OUTCOMES, version=1, attribution_days=10, gap=GAP
    )


def holdout(spark, sf):
    return holdout_experiment(B.events(spark, sf), B.AS_OF, KEY, "post-card", VARIANTS, gap=GAP)


@query(
    "r21_experiment_summary__variants",
    B.duck(f"""SELECT variant, assigned AS assigned_people, assignment_events, exposed AS exposed_people, exposure_events,
    {B.sql_ratio("exposed", "assigned", 4)} AS exposure_rate, {_wr("exposed", "assigned", -1)} AS exposure_rate_lower,
    {_wr("exposed", "assigned", 1)} AS exposure_rate_upper, 'measured' AS exposure_status FROM pop""", **EX),
)
def _(spark, sf):
    return summary(spark, sf).variants_table()


_L = _lift_sql("ap", "assigned", "cp", "ca", "(variant = 'control')")
_READY = lambda name, expr: f"CASE WHEN inst THEN {expr} END AS {name}"
OUTCOME_SQL = B.duck(
    "SELECT variant, event_type, CASE WHEN inst THEN 'measured' ELSE 'not_instrumented' END AS coverage_status, "
    + ", ".join(
        [
            _READY("assigned_outcome_people", "ap"), _READY("assigned_rate", B.sql_ratio("ap", "assigned", 4)),
            _READY("assigned_rate_lower", _wr("ap", "assigned", -1)), _READY("assigned_rate_upper", _wr("ap", "assigned", 1)),
            _READY("assigned_same_session", "asame"), _READY("assigned_later_session", "alater"),
            *[_READY(k, v) for k, v in _L.items()],
            _READY("exposed_outcome_people", "xp"), _READY("exposed_rate", B.sql_ratio("xp", "exposed", 4)),
            _READY("exposed_rate_lower", _wr("xp", "exposed", -1)), _READY("exposed_rate_upper", _wr("xp", "exposed", 1)),
            _READY("exposed_same_session", "xsame"), _READY("exposed_later_session", "xlater"),
        ]
    )
    + """ FROM (SELECT t.*, c.ap AS cp, c.assigned AS ca FROM tab t JOIN tab c ON c.event_type = t.event_type AND c.variant = 'control')""",
    **EX,
    tab=f"""SELECT pop.variant, pop.assigned, pop.exposed, k.event_type, k.event_type IN (SELECT DISTINCT event_type FROM e) AS inst,
      count(*) FILTER (lens = 'assignment') AS ap, count(*) FILTER (lens = 'assignment' AND stage = 'same_session') AS asame,
      count(*) FILTER (lens = 'assignment' AND stage = 'later_session') AS alater, count(*) FILTER (lens = 'exposure') AS xp,
      count(*) FILTER (lens = 'exposure' AND stage = 'same_session') AS xsame, count(*) FILTER (lens = 'exposure' AND stage = 'later_session') AS xlater
      FROM pop CROSS JOIN (VALUES {', '.join('(' + lit(o) + ')' for o in OUTCOMES)}) k(event_type)
      LEFT JOIN os ON os.variant = pop.variant AND os.event_type = k.event_type GROUP BY 1, 2, 3, 4""",
)


@query("r21_experiment_summary", OUTCOME_SQL)
def _(spark, sf):
    return summary(spark, sf).outcomes_table()


@query("a20_lift_vs_control", OUTCOME_SQL)
def _(spark, sf):
    return summary(spark, sf).outcomes_table()


@query("r21_experiment_summary__state", B.duck("SELECT CASE WHEN (SELECT count(*) FROM a) > 0 THEN 'measured' ELSE 'no_data' END AS state", **EX))
def _(spark, sf):
    return summary(spark, sf).state()


def _cover(holdout: bool) -> str:
    rej = "(SELECT count(*) FROM hp WHERE status = 'rejected' AND person <> '') AS contract_rows_rejected" if holdout else """
     (SELECT count(*) FROM hp WHERE status = 'other_experiment') AS other_experiment_rows, (SELECT count(*) FROM hp WHERE status = 'invalid_contract') AS invalid_contract_rows,
     (SELECT count(*) FROM hp WHERE status = 'other_definition_version') AS other_definition_version_rows"""
    same = "s.variant = a.variant" if holdout else (
        "s.variant = a.variant AND s.definition_version = a.definition_version AND s.assignment_policy = a.assignment_policy AND s.surface = a.surface"
    )
    outs = types_in(CONVERSION_OUTCOMES if holdout else OUTCOMES).replace("event_type", "o.event_type")
    skip = "AND NOT coalesce(o.event_type = 'newsletter_signup' AND o.context = 'registration', false)" if holdout else ""
    nobody = "" if holdout else "AND status IN ('not_experiment', 'matched')"
    return f"""SELECT (SELECT count(*) FROM ld) AS loaded_rows, (SELECT count(*) FROM ld) - (SELECT count(*) FROM hu) AS bot_rows_excluded,
     (SELECT count(*) FROM hp WHERE person = '' {nobody}) AS unidentified_rows, {rej},
     (SELECT count(*) FROM asg s JOIN a ON a.person = s.person AND a.id <> s.id) AS duplicate_assignment_events,
     (SELECT count(*) FROM asg s JOIN a ON a.person = s.person AND a.id <> s.id AND NOT ({same})) AS conflicting_assignment_events,
     (SELECT count(*) FROM xr WHERE attributed) - (SELECT count(*) FROM x) AS duplicate_exposure_events,
     (SELECT count(*) FROM xr WHERE NOT attributed) AS unattributed_exposure_events,
     (SELECT count(*) FROM kn o JOIN a ON a.person = o.person AND NOT o.pos > a.pos WHERE {outs} {skip}) AS pre_assignment_outcome_events,
     (SELECT count(*) FROM kn o LEFT JOIN a ON a.person = o.person WHERE a.person IS NULL AND {outs} {skip}) AS unattributed_outcome_events,
     (SELECT count(*) FROM (SELECT visitor_id FROM seen WHERE coalesce(payload_user_id, user_id, 0) > 0 AND visitor_id <> '' GROUP BY 1
       HAVING count(DISTINCT coalesce(payload_user_id, user_id, 0)) > 1)) AS ambiguous_visitor_ids"""


@query("r21_experiment_summary__coverage", B.duck(_cover(False), **EX))
def _(spark, sf):
    return summary(spark, sf).coverage()


STAGES = "SELECT variant, event_type, lens, stage, count(*) AS people FROM os GROUP BY 1, 2, 3, 4"


@query("w14_stage_since_anchor", B.duck(STAGES, **EX))
def _(spark, sf):
    return summary(spark, sf).outcome_stages()


@query(
    "w14_stage_since_anchor__30m",
    B.duck(STAGES, **{k: v.replace(f"> {GAP}", "> 1800") for k, v in EX.items()}),
)
def _(spark, sf):
    return experiment_summary(
        B.events(spark, sf), B.AS_OF, KEY, VARIANTS, "control", OUTCOMES, version=1, attribution_days=10
    ).outcome_stages()


@query(
    "j08_anchor_join",
    B.duck("SELECT person, lens, variant, ats AS anchor_ts FROM anc", **EX),
)
def _(spark, sf):
    return summary(spark, sf).anchors().select("person", "lens", F.col("anchor_variant").alias("variant"), "anchor_ts")


@query("f12_contract_status", B.duck(f"SELECT id, {_STATUS} AS status FROM e"))
def _(spark, sf):
    return B.events(spark, sf).select("id", A.contract_status(KEY, VARIANTS, 1).alias("status"))


@query(
    "a19_wilson_interval",
    B.duck(f"""SELECT blog_id, event_type, k, n, {_wr("k", "n", -1)} AS lower, {_wr("k", "n", 1)} AS upper FROM
    (SELECT blog_id, event_type, count(*) FILTER (is_bot = 'false') AS k, count(*) AS n FROM e GROUP BY 1, 2)"""),
)
def _(spark, sf):
    g = B.events(spark, sf).groupBy("blog_id", "event_type").agg(
        F.count_if(F.col("is_bot") == "false").alias("k"), F.count("*").alias("n")
    )
    lo, hi = wilson_interval(F.col("k"), F.col("n"))
    return g.select("*", lo.alias("lower"), hi.alias("upper"))


# ---- holdout --------------------------------------------------------------------------


@query(
    "r22_holdout_experiment__clicks",
    B.duck(f"""SELECT variant, assigned, exposed, CAST(ea AS BIGINT) AS click_events_assignment, pa AS click_people_assignment,
    {B.sql_ratio("ea", "assigned", 4)} AS events_per_assignment, CAST(ex AS BIGINT) AS click_events_exposure, px AS click_people_exposure,
    {B.sql_ratio("ex", "exposed", 4)} AS events_per_exposure FROM (SELECT pop.*, count(pos) FILTER (lens = 'assignment') AS ea,
     count(DISTINCT person) FILTER (lens = 'assignment') AS pa, count(pos) FILTER (lens = 'exposure') AS ex, count(DISTINCT person) FILTER (lens = 'exposure') AS px
     FROM pop LEFT JOIN (SELECT anc.variant, lens, c.person, c.pos FROM anc JOIN kn c ON c.person = anc.person AND c.event_type = 'bridge_click' AND c.pos > aat) USING (variant)
     GROUP BY ALL)""", **HO),
)
def _(spark, sf):
    return holdout(spark, sf).clicks()


FIRST = """SELECT person, lens, variant, blog_id AS destination_blog_id, fam AS route_family, CASE WHEN broken > 0 THEN 'later_session' ELSE 'same_session' END AS session_stage
 FROM (SELECT *, row_number() OVER (PARTITION BY person, lens ORDER BY ts, id) AS rn FROM wk WHERE blog_id <> ab) WHERE rn = 1"""


@query("w15_first_cross_surface", B.duck(FIRST, **HO))
def _(spark, sf):
    return holdout(spark, sf).first_cross_surface()


@query(
    "r22_holdout_experiment",
    B.duck("SELECT variant, lens, destination_blog_id, route_family, session_stage, count(*) AS people FROM fc GROUP BY ALL", **HO, fc=FIRST),
)
def _(spark, sf):
    return holdout(spark, sf).cross_surface_table()


@query("r22_holdout_experiment__outcomes", B.duck(STAGES, **HO))
def _(spark, sf):
    return holdout(spark, sf).outcome_stages()


@query("r22_holdout_experiment__coverage", B.duck(_cover(True), **HO))
def _(spark, sf):
    return holdout(spark, sf).coverage()
