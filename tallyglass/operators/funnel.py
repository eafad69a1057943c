"""Ordered funnel: a step counts only after the one before it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import half_up, ratio
from .skew import salted_lookup


def ordered_funnel(rows: DataFrame, steps: list[str]) -> DataFrame:
    """People per step, with rows of (person, event_type, ts, id).

    The earliest row strictly after the previous step is the one a walk in (ts, id)
    order would take, so each step is one aggregate; no ordered walk is needed.
    """
    at = F.struct("ts", "id")
    counted = None
    reached = None
    for index, step in enumerate(steps):
        here = rows.filter(F.col("event_type") == step).select("person", "ts", "id")
        if reached is not None:
            before = reached.select("person", F.col("at").alias("prev"))
            here = salted_lookup(here, before, "person").filter(at > F.col("prev"))
        reached = here.groupBy("person").agg(F.min(at).alias("at"))
        line = reached.agg(F.count("*").alias("people")).select(
            F.lit(index).alias("index"), F.lit(step).alias("event_type"), "people"
        )
        counted = line if counted is None else counted.unionByName(line)
    return counted


def funnel_rates(steps: DataFrame) -> DataFrame:
    """Conversion from the previous and the first step; one row per step."""
    order = Window.orderBy("index")
    prev, top = F.lag("people").over(order), F.first("people").over(order)
    out = steps.withColumn("_prev", prev).withColumn("_top", top)
    return out.select(
        "index",
        "event_type",
        "people",
        F.when(F.col("index") == 0, 1.0)
        .otherwise(ratio(F.col("people"), F.col("_prev"), 4, 0.0))
        .alias("conversion_from_prev"),
        ratio(F.col("people"), F.col("_top"), 4, 0.0).alias("conversion_from_top"),
    )


def funnel_summary(steps: DataFrame) -> DataFrame:
    """Overall conversion and the step that loses most, the first one on ties."""
    order = Window.orderBy("index")
    drop = 1 - F.col("people") / F.when(F.col("_prev") > 0, F.col("_prev"))
    out = steps.withColumn("_prev", F.lag("people").over(order)).withColumn("_from", F.lag("event_type").over(order))
    out = out.withColumn("_drop", drop)
    worst = F.min_by(
        F.struct("_from", "event_type", "_prev", "people", "_drop"),
        F.when(F.col("_drop").isNotNull(), F.struct((-F.col("_drop")).alias("d"), F.col("index"))),
    )
    last, first = F.max_by("people", "index"), F.min_by("people", "index")
    return out.agg(ratio(last, first, 4, 0.0).alias("overall_conversion"), worst.alias("w")).select(
        "overall_conversion",
        F.col("w._from").alias("from_step"),
        F.col("w.event_type").alias("to_step"),
        (F.col("w._prev") - F.col("w.people")).alias("dropped"),
        half_up(F.col("w._drop"), 4).alias("drop_rate"),
    )


def reach(rows: DataFrame, kinds: dict[str, list[str]]) -> DataFrame:
    """Independent reach: distinct people and raw rows per event type, zeros included."""
    listed = [(kind, name) for kind, names in kinds.items() for name in names]
    wanted = rows.sparkSession.createDataFrame(listed, "kind string, event_type string")
    seen = rows.groupBy("event_type").agg(F.count_distinct("person").alias("people"), F.count("*").alias("events"))
    return wanted.join(seen, "event_type", "left").select(
        "kind",
        "event_type",
        F.coalesce("people", F.lit(0)).alias("people"),
        F.coalesce("events", F.lit(0)).alias("events"),
    )
