"""Error-log tail and the fatal-rate alarm."""

from __future__ import annotations

from datetime import timedelta

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import errors as PE
from ..sources import error_log as EL
from . import batches as MB


def tail_log(spark: SparkSession, path: str) -> DataFrame:
    """Completed log files as they appear. The checkpoint remembers each file, so a rotation repeats nothing."""
    return spark.readStream.option("lineSep", "\n[").text(path)


def rollup_log(stream: DataFrame, partials: str, checkpoint: str, roots: list[str]) -> None:
    """Each batch stores its own daily rollup; :func:`daily_errors` adds them up."""

    def handle(chunks: DataFrame, batch_id: int) -> None:
        MB.put(EL.rollup_errors(EL.parse_errors(EL.split_records(chunks), roots)), partials, batch_id)

    MB.run(stream, handle, checkpoint)


def daily_errors(spark: SparkSession, partials: str) -> DataFrame:
    stored = spark.read.parquet(partials)
    return EL.rollup_errors(_no_entries(spark), stored)


DAILY = (
    "snapshot_day date, signature string, severity string, file_line string, sample_message string, count bigint, "
    "first_seen timestamp, last_seen timestamp"
)


def daily_table(spark: SparkSession, path: str) -> MB.Folded:
    """Daily rollups of batches, folded into layers by day."""
    schema = spark.createDataFrame([], DAILY).schema
    return MB.Folded(spark, path, schema, lambda rows: EL.rollup_errors(_no_entries(spark), rows), by="snapshot_day")


def rollup_tail(stream: DataFrame, table: MB.Folded, checkpoint: str, roots: list[str]) -> None:
    """As :func:`rollup_log`, into a table that can be compacted."""
    MB.run(stream, lambda chunks, batch_id: table.put(EL.rollup_errors(EL.parse_errors(EL.split_records(chunks), roots)), batch_id), checkpoint)


def _no_entries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "ts timestamp, signature string, severity string, file string, sample string")


def watch_fatals(stream: DataFrame, base: str, checkpoint: str, roots: list[str], **rules) -> None:
    """Evaluates the alarm after every batch, at the newest time the batch contains: for replays of a recorded log.

    A line with a wrong date moves this clock; live logs are watched by :func:`.alarm.watch_keyed`.

    Entries, alarms and state are tables under ``base`` with one partition per batch;
    a batch reads the state of the batch before it.
    """
    spark: SparkSession = stream.sparkSession
    state_schema = spark.createDataFrame([], PE.STATE).schema
    cols = ["ts", "signature", "severity", "file", "sample", "from_production"]

    def handle(chunks: DataFrame, batch_id: int) -> None:
        fresh = EL.parse_errors(EL.split_records(chunks), roots).select(*cols).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            evaluate(fresh, batch_id)
        finally:
            fresh.unpersist()

    def evaluate(fresh: DataFrame, batch_id: int) -> None:
        as_of = fresh.agg(F.max("ts").alias("t")).first()["t"]
        state = MB.get(spark, f"{base}/state", state_schema)
        last = state.filter(F.col("batch") < batch_id)
        last = last.filter(F.col("batch") == last.agg(F.max("batch")).scalar()).drop("batch")
        if as_of is None:
            MB.put(last, f"{base}/state", batch_id)
            return
        MB.put(fresh, f"{base}/entries", batch_id)
        since = as_of - timedelta(seconds=rules.get("window", PE.WINDOW))
        recent = MB.get(spark, f"{base}/entries", fresh.schema).filter(
            (F.col("batch") <= batch_id) & (F.col("ts") >= F.lit(since))
        )
        found = PE.alarm_candidates(recent, last, as_of, **rules).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            MB.put(found.withColumn("as_of", F.lit(as_of)), f"{base}/candidates", batch_id)
            MB.put(PE.next_state(found, last, as_of), f"{base}/state", batch_id)
        finally:
            found.unpersist()

    MB.run(stream, handle, checkpoint)
