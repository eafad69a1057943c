"""Ambiguity-safe stitching of anonymous visitors to users."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from .skew import salted_lookup


def effective_user() -> Column:
    """Payload user first, stored user as fallback; a present 0 in the payload means nobody."""
    return F.coalesce("payload_user_id", "user_id", F.lit(0))


def visitor_users(rows: DataFrame) -> DataFrame:
    """Lowest and highest user seen with each visitor: equal exactly when there is one."""
    seen = rows.filter((effective_user() > 0) & P.identified())
    return seen.groupBy("visitor_id").agg(
        F.min(effective_user()).alias("low_user"), F.max(effective_user()).alias("high_user")
    )


def identity_bridge(rows: DataFrame) -> DataFrame:
    """visitor_id to user_id for visitors observed with exactly one user."""
    pairs = visitor_users(rows).filter(F.col("low_user") == F.col("high_user"))
    return pairs.select("visitor_id", F.col("low_user").alias("bridged_user"))


def ambiguous_visitors(rows: DataFrame) -> DataFrame:
    return visitor_users(rows).agg(
        F.count_if(F.col("low_user") == F.col("high_user")).alias("unambiguous_identity_bridges"),
        F.count_if(F.col("low_user") != F.col("high_user")).alias("ambiguous_visitor_ids"),
    )


def with_person(rows: DataFrame, bridge: DataFrame, event_fallback: bool = False) -> DataFrame:
    """Adds ``person``: user, stitched user, visitor, and per row when asked; else ''.

    Rows that need no stitching probe with a key of their own, so NULL visitors and
    signed-in rows spread over all tasks instead of meeting in one.
    """
    user = effective_user()
    asks = (user <= 0) & P.identified()
    probe = F.when(asks, F.concat(F.lit("v"), F.col("visitor_id"))).otherwise(
        F.concat(F.lit("#"), F.col("id").cast("string"))
    )
    keyed = bridge.select(F.concat(F.lit("v"), F.col("visitor_id")).alias("_probe"), "bridged_user")
    nobody = F.concat(F.lit("event:"), F.col("id").cast("string")) if event_fallback else F.lit("")
    person = (
        F.when(user > 0, F.concat(F.lit("user:"), user.cast("string")))
        .when(F.col("bridged_user").isNotNull(), F.concat(F.lit("user:"), F.col("bridged_user").cast("string")))
        .when(P.identified(), F.concat(F.lit("visitor:"), F.col("visitor_id")))
        .otherwise(nobody)
    )
    joined = salted_lookup(rows.withColumn("_probe", probe), keyed, "_probe", how="left")
    return joined.withColumn("person", person).drop("_probe", "bridged_user")
