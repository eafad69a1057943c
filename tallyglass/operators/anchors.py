"""Experiment anchors: first valid row per person, and what follows each anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .sessions import session_table
from .skew import salted_lookup

IDENTIFIER = r"^[a-z0-9][a-z0-9_-]{0,63}$"
MAX_VERSION = 1_000_000


def contract_status(
    key: str,
    variants: list[str],
    version: int | None = None,
    experiment_types: tuple[str, ...] = ("experiment_assignment", "experiment_exposure"),
) -> Column:
    """How a row relates to one experiment's contract."""
    v = F.col("definition_version")
    valid_version = F.coalesce(v.between(1, MAX_VERSION), F.lit(False))
    wrong_version = (v != version) if version is not None else F.lit(False)
    complete = (
        F.coalesce(F.col("assignment_policy").rlike(IDENTIFIER), F.lit(False))
        & F.coalesce(F.col("variant").isin(variants), F.lit(False))
        & F.coalesce(F.col("surface").rlike(IDENTIFIER), F.lit(False))
    )
    return (
        F.when(~F.col("event_type").isin(*experiment_types), "not_experiment")
        .when(F.coalesce("experiment_key", F.lit("")) != key, "other_experiment")
        .when(~valid_version, "invalid_contract")
        .when(wrong_version, "other_definition_version")
        .when(complete, "matched")
        .otherwise("invalid_contract")
    )


def first_per_person(rows: DataFrame, keep: list[str]) -> DataFrame:
    """Anchor row of each person: the earliest by (ts, id), with the columns in ``keep``."""
    edge = F.struct("ts", "id", *keep)
    firsts = rows.groupBy("person").agg(F.min_by(edge, F.struct("ts", "id")).alias("a"))
    return firsts.select(
        "person", F.col("a.ts").alias("anchor_ts"), F.col("a.id").alias("anchor_id"),
        *[F.col(f"a.{c}").alias(f"anchor_{c}") for c in keep],
    )


def is_after_anchor() -> Column:
    return P.after(F.col("ts"), F.col("id"), F.col("anchor_ts"), F.col("anchor_id"))


def with_same_session_end(anchors: DataFrame, pageviews: DataFrame, gap: int) -> DataFrame:
    """Last second of the unbroken pageview chain that starts at each anchor.

    The chain ends where a pageview follows the one before it, or the anchor itself,
    by more than the gap. The first pageview after the anchor lies in the earliest
    session that reaches past the anchor, so the chain ends with that session if the
    session is within one gap of the anchor, and at the anchor otherwise. A later row
    is in the same session exactly when it is at most one gap past the chain's end.
    """
    sessions = session_table(pageviews, gap, key="person").select(
        "person", "session_start", F.col("session_last").alias("_last"), F.col("last_id").alias("_last_id")
    )
    sessions = sessions.withColumn("id", F.col("session_start"))
    joined = salted_lookup(sessions, anchors.select("person", "lens", "anchor_ts", "anchor_id"), "person")
    past = P.after(F.col("_last"), F.col("_last_id"), F.col("anchor_ts"), F.col("anchor_id"))
    nxt = joined.filter(past).groupBy("person", "lens").agg(
        F.min(F.struct("session_start", "_last")).alias("s")
    )
    near = F.col("s.session_start") - F.col("anchor_ts") <= gap
    return (
        anchors.join(nxt, ["person", "lens"], "left")
        .withColumn("chain_end", F.when(F.coalesce(near, F.lit(False)), F.col("s._last")).otherwise(F.col("anchor_ts")))
        .drop("s")
    )


def stage(gap: int) -> Column:
    return F.when(F.col("ts") <= F.col("chain_end") + gap, "same_session").otherwise("later_session")
