"""Exact order statistics without gathering all values in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PER_DECADE = 1000
OFFSET = 400 * PER_DECADE


def _bucket(v: Column) -> Column:
    """Order-preserving bucket of a double: a thousandth of a decade wide."""
    size = F.floor(F.log10(F.abs(F.when(v != 0, v))) * PER_DECADE) + OFFSET
    return F.when(v == 0, 0).when(v > 0, size).otherwise(-size).cast("bigint")


def exact_median(rows: DataFrame, col: str) -> DataFrame:
    """One-row frame (median, n): the middle value, or the mean of the middle two.

    Values are counted into buckets first; the windows run over bucket counts, of which
    there are some thousands at most. Only the buckets that hold the middle ranks are
    then read value by value, as (value, count) pairs.
    """
    values = rows.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("v"))
    placed = values.groupBy("v").agg(F.count("*").alias("c")).withColumn("b", _bucket(F.col("v")))
    running = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edges = placed.groupBy("b").agg(F.sum("c").alias("held"))
    edges = edges.select(
        "b", (F.sum("held").over(running) - F.col("held")).alias("before"), "held", F.sum("held").over(everything).alias("n")
    )
    low, high = F.floor((F.col("n") + 1) / 2), F.floor((F.col("n") + 2) / 2)
    edges = edges.filter((F.col("before") + F.col("held") >= low) & (F.col("before") < high)).drop("held")
    inside = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = placed.join(edges, "b").withColumn("upto", F.col("before") + F.sum("c").over(inside))
    first = lambda rank: F.min(F.when(F.col("upto") >= rank, F.col("v")))
    return ranked.agg(((first(low) + first(high)) / 2).alias("median"), F.coalesce(F.max("n"), F.lit(0)).alias("n"))
