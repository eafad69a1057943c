"""Work that several outputs read is done once."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyglass import catalog
from tallyglass.session import scratch_dir

catalog.load()


def event_table(spark):
    """A few rows in the form of the bound event table."""
    at = F.timestamp_add("SECOND", F.col("id").cast("int") * 60, F.lit(datetime(2024, 1, 30))).cast("timestamp_ntz")
    rows = spark.range(1500).select(
        F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 40).alias("user_id"), F.lit("view").alias("event_type"),
        F.lit(1.0).alias("value"), F.concat(F.lit('{"k": '), F.col("id") % 100, F.lit("}")).alias("props"),
    )
    path = scratch_dir(spark, "tables")
    rows.write.parquet(f"{path}/events.parquet")
    return path


def test_the_alarm_parses_the_log_once(spark):
    """State, alarms and the next state read parsed entries, not the text again."""
    state = catalog.QUERIES["r34_fatal_alarm__state"](spark, event_table(spark))
    plan = state._jdf.queryExecution().executedPlan().toString()
    assert "FileScan text" not in plan and "FileScan parquet" in plan
    assert state.filter(F.col("last_alerted_at") == datetime(2024, 1, 30, 23, 50)).count() > 0
