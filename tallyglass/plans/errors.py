"""Error summary and the fatal-rate alarm."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stats import first_rows, half_up

ALARM_SEVERITIES = ("fatal", "parse")
WINDOW, RECENCY, THRESHOLD, KEEP_DAYS = 3600, 600, 10, 7
STATE = "signature string, last_alerted_at timestamp, last_alerted_rate bigint, last_seen timestamp"


def merged_errors(
    persisted: DataFrame, live: DataFrame, as_of: datetime, days: int = 7, severity: str = "all", active_hours: int = 24
) -> DataFrame:
    """Stored daily counts and live entries per signature. The two sources do not overlap."""
    active = F.lit(as_of - timedelta(hours=active_hours))
    stored = persisted.select(
        "signature", "severity", F.col("file_line").alias("file"), F.col("sample_message").alias("sample"), "count",
        F.when(F.col("last_seen") >= active, F.col("count")).otherwise(0).alias("active"), "first_seen", "last_seen",
        "snapshot_day",
    )
    fresh = live.select(
        "signature", "severity", "file", "sample", F.lit(1).cast("bigint").alias("count"),
        F.coalesce(F.col("ts") >= active, F.lit(False)).cast("bigint").alias("active"),
        F.col("ts").alias("first_seen"), F.col("ts").alias("last_seen"), F.to_date("ts").alias("snapshot_day"),
    )
    if days > 0:
        since = as_of - timedelta(days=days)
        stored = stored.filter(F.col("snapshot_day") >= F.lit(since.date()))
        fresh = fresh.filter(F.col("last_seen") >= F.lit(since))
    both = stored.unionByName(fresh)
    if severity != "all":
        both = both.filter(F.col("severity") == severity)
    newest = F.max(F.struct("last_seen", "severity", "file", "sample"))
    return both.groupBy("signature").agg(
        newest.alias("_n"), F.sum("count").alias("count"), F.sum("active").alias("active_count"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    ).select(
        "signature", F.col("_n.severity").alias("severity"), F.col("_n.file").alias("file"),
        F.col("_n.sample").alias("sample"), "count", "active_count", "first_seen", "last_seen",
    )


def _covered_days(merged: DataFrame):
    """Days seen as a first or last occurrence, for all-time averages."""
    ends = merged.select(F.explode(F.array(F.to_date("first_seen"), F.to_date("last_seen"))).alias("d"))
    return F.greatest(F.lit(1), ends.agg(F.count_distinct("d")).scalar())


def error_summary(merged: DataFrame, days: int = 7, limit: int = 25) -> DataFrame:
    span = F.lit(days) if days > 0 else _covered_days(merged)
    rows = merged.withColumn("per_day", half_up(F.col("count") / span, 1)).withColumn("active", F.col("active_count") > 0)
    return first_rows(rows.orderBy(F.desc("count"), "signature"), limit)


def error_totals(merged: DataFrame, active_hours: int = 24, limit: int = 25) -> DataFrame:
    active_days = max(1.0, active_hours / 24)
    return merged.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        F.coalesce(F.sum("active_count"), F.lit(0)).alias("active_total"),
        half_up(F.coalesce(F.sum("active_count"), F.lit(0)) / F.lit(active_days), 1).alias("active_per_day"),
        F.count_if(F.col("active_count") > 0).alias("active_signatures"),
        F.count("*").alias("distinct_signatures"),
        (F.lit(limit > 0) & (F.count("*") > limit)).alias("truncated"),
    )


def alarm_candidates(
    entries: DataFrame,
    state: DataFrame,
    as_of: datetime,
    window: int = WINDOW,
    recency: int = RECENCY,
    threshold: int = THRESHOLD,
    severities: tuple[str, ...] = ALARM_SEVERITIES,
) -> DataFrame:
    """Every signature in the window with its hourly rate, the reasons to alarm and the verdict."""
    now = F.lit(as_of)
    rows = entries.filter(
        F.col("severity").isin(*severities) & F.col("from_production")
        & (F.col("ts") >= F.lit(as_of - timedelta(seconds=window))) & (F.col("ts") <= now)
    )
    newest = F.max(F.struct("ts", "severity", "file", "sample"))
    seen = rows.groupBy("signature").agg(
        newest.alias("_n"), F.count("*").alias("count"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")
    )
    span = F.greatest(F.unix_timestamp("last_seen") - F.unix_timestamp("first_seen"), F.lit(60))
    rate = F.round(F.col("count") * (F.lit(3600.0) / span), 0).cast("bigint")
    prior = state.select("signature", "last_alerted_at", "last_alerted_rate", F.lit(True).alias("_known"))
    out = seen.join(prior, "signature", "left").withColumn("rate_per_hr", rate)
    new = F.col("_known").isNull()
    quiet = F.unix_timestamp(now) - F.coalesce(F.unix_timestamp("last_alerted_at"), F.lit(0))
    back = ~new & (quiet > 2 * window)
    over = F.col("rate_per_hr") >= max(1, threshold)
    worse = ~new & over & (F.col("rate_per_hr") > F.coalesce("last_alerted_rate", F.lit(0)) * 2)
    live = F.unix_timestamp("last_seen") >= F.unix_timestamp(now) - recency
    fires = new | back | worse
    reasons = F.when(~live, F.lit("resolved_not_firing")).otherwise(
        F.concat_ws(
            ",", F.when(new, "new_signature"), F.when(back, "returned_after_quiet"),
            F.when(over & fires, "over_threshold"), F.when(worse, "escalated"),
        )
    )
    return out.select(
        "signature", F.col("_n.severity").alias("severity"), F.col("_n.file").alias("file"),
        F.col("_n.sample").alias("sample"), "count", "rate_per_hr", "first_seen", "last_seen",
        new.alias("is_new"), live.alias("is_live"), reasons.alias("reasons"), (live & fires).alias("would_alarm"),
    )


def next_state(candidates: DataFrame, state: DataFrame, as_of: datetime, keep_days: int = KEEP_DAYS) -> DataFrame:
    """State after the alarms: alerted signatures replaced, old ones dropped."""
    fired = candidates.filter("would_alarm").select(
        "signature", F.lit(as_of).alias("last_alerted_at"), F.col("rate_per_hr").alias("last_alerted_rate"), "last_seen"
    )
    kept = state.filter(F.col("last_alerted_at") >= F.lit(as_of - timedelta(days=keep_days)))
    return kept.join(fired, "signature", "left_anti").unionByName(fired)
