"""Inactivity-gap sessions that stay balanced when one visitor holds most rows.

Time is cut into slices no longer than the gap, so two rows of a visitor in the
same slice always share a session. Rows are first folded per (visitor, slice),
which the map side combines; only one small summary per slice meets in a window
over the visitor. No task ever holds all rows of a visitor.

A gap splits a session only when it is strictly longer than the timeout; order is
(ts, id) with ``ts`` in whole seconds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROW_SLICE = 300


def _slice(width: int) -> Column:
    return F.floor(F.col("ts") / F.lit(width)).cast("bigint")


def slice_sessions(sliced: DataFrame, gap: int, key: str) -> DataFrame:
    """Assigns ``session_start`` and ``session_last`` to per-slice summaries.

    ``sliced`` has one row per (key, _slice) with ``_first`` and ``_last`` seconds.
    """
    by_key = Window.partitionBy(key).orderBy("_slice")
    quiet = F.col("_first") - F.lag("_last").over(by_key) > gap
    begins = F.when(F.coalesce(quiet, F.lit(True)), F.col("_first"))
    out = sliced.withColumn("_begin", begins).withColumn(
        "session_start",
        F.last("_begin", ignorenulls=True).over(by_key.rowsBetween(Window.unboundedPreceding, 0)),
    )
    return out.drop("_begin")


def session_table(rows: DataFrame, gap: int, key: str = "visitor_id", flags: dict[str, Column] | None = None,
                  ends: list[str] | None = None) -> DataFrame:
    """One row per session.

    ``flags`` are boolean columns kept as "any row of the session"; ``ends`` are
    columns whose first and last values are kept as ``first_<c>`` / ``last_<c>``.
    """
    flags, ends = flags or {}, ends or []
    edge = F.struct(F.col("ts"), F.col("id"), *[F.col(c) for c in ends])
    folded = rows.groupBy(key, _slice(gap).alias("_slice")).agg(
        F.min("ts").alias("_first"),
        F.max("ts").alias("_last"),
        F.min_by(edge, F.struct("ts", "id")).alias("_head"),
        F.max_by(edge, F.struct("ts", "id")).alias("_tail"),
        F.count("*").alias("rows"),
        *[F.max(cond).alias(name) for name, cond in flags.items()],
    )
    sessions = slice_sessions(folded, gap, key).groupBy(key, "session_start").agg(
        F.min_by("_head", "_slice").alias("_head"),
        F.max_by("_tail", "_slice").alias("_tail"),
        F.sum("rows").alias("rows"),
        *[F.max(name).alias(name) for name in flags],
    )
    return sessions.select(
        key,
        "session_start",
        F.col("_head.id").alias("first_id"),
        F.col("_tail.ts").alias("session_last"),
        F.col("_tail.id").alias("last_id"),
        "rows",
        *[F.col(f"_head.{c}").alias(f"first_{c}") for c in ends],
        *[F.col(f"_tail.{c}").alias(f"last_{c}") for c in ends],
        *flags,
    )


def _last_n(items: Column, n: int) -> Column:
    return F.when(F.size(items) > n, F.slice(items, F.size(items) - n + 1, F.lit(n))).otherwise(items)


def sessionize(
    rows: DataFrame,
    gap: int,
    key: str = "visitor_id",
    node: list[str] | None = None,
    depth: int = 0,
    slice_secs: int = ROW_SLICE,
) -> DataFrame:
    """Rows with ``session_start``; with ``depth`` also ``trail``, the ``node`` structs
    of up to that many directly preceding rows of the same session.

    The trail crosses slice borders through each slice's last ``depth`` rows, so the
    row-level window holds one slice of one visitor at most.
    """
    width = min(gap, slice_secs)
    rows = rows.withColumn("_slice", _slice(width))
    carry = []
    tails = []
    if depth:
        seen = F.struct("ts", F.struct(*[F.col(c) for c in node]).alias("node"))
        near = Window.partitionBy(key, "_slice").orderBy("ts", "id").rowsBetween(-depth, 0)
        rows = rows.withColumn("_near", F.collect_list(seen).over(near))
        tails = [F.max_by("_near", F.struct("ts", "id")).alias("_tail")]
    folded = rows.groupBy(key, "_slice").agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"), *tails
    )
    slices = slice_sessions(folded, gap, key)
    if depth:
        before = Window.partitionBy(key).orderBy("_slice").rowsBetween(-depth, -1)
        slices = slices.withColumn("_carry", F.flatten(F.collect_list("_tail").over(before)))
        carry = ["_carry"]
    out = rows.join(slices.select(key, "_slice", "session_start", *carry), [key, "_slice"])
    if depth:
        earlier = F.slice(F.col("_near"), F.lit(1), F.size("_near") - 1)
        joined = _last_n(F.concat("_carry", earlier), depth)
        same = F.filter(joined, lambda x: x["ts"] >= F.col("session_start"))
        out = out.withColumn("trail", F.transform(same, lambda x: x["node"])).drop("_carry", "_near")
    return out.drop("_slice")


def acquisitions(pageviews: DataFrame, key: str = "visitor_id") -> DataFrame:
    """First observed pageview of every visitor over all history."""
    return pageviews.groupBy(key).agg(F.min("ts").alias("acquisition_ts"))


def with_cohort(sessions: DataFrame, acq: DataFrame, key: str = "visitor_id") -> DataFrame:
    """First-time when the visitor's first observed pageview falls inside the session."""
    inside = F.col("acquisition_ts").between(F.col("session_start"), F.col("session_last"))
    label = F.when(F.coalesce(inside, F.lit(False)), "first_time").otherwise("returning")
    return sessions.join(acq, key, "left").withColumn("cohort", label)


def starting_between(frame: DataFrame, since_ts: int, until_ts: int) -> DataFrame:
    """Drops sessions that began before the window or after its end, as a whole."""
    return frame.filter(F.col("session_start").between(since_ts, until_ts))


def transitions(rows: DataFrame) -> DataFrame:
    """Adjacent pairs inside a session, loops included."""
    return rows.filter(F.size("trail") >= 1).select(
        F.element_at("trail", -1).alias("from_node"), F.struct("blog_id", "route_family").alias("to_node")
    )


def sequences(rows: DataFrame, length: int) -> DataFrame:
    """Sliding windows of exactly ``length`` routes; ``rows`` carry a trail of ``length - 1``."""
    here = F.array(F.struct("blog_id", "route_family"))
    return rows.filter(F.size("trail") == length - 1).select(F.concat("trail", here).alias("path"))
