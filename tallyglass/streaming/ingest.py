"""Continuous event ingest with quarantine, and the side table for late rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import events as EV
from . import batches as MB


#: Marks that a batch reads; batches follow each other, so one would do.
MARKS = 3


def ingest_events(stream: DataFrame, sites: DataFrame, accepted: str, rejected: str, checkpoint: str) -> None:
    """Admitted rows to one table, refused rows with their reason to another."""

    def handle(rows: DataFrame, batch_id: int) -> None:
        judged = EV.admission(rows, sites).select(*rows.columns, "_canonical", "reject_reason")
        judged.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            ok, bad = EV.split_admitted(judged, rows.columns)
            MB.put(ok, accepted, batch_id)
            MB.put(bad, rejected, batch_id)
        finally:
            judged.unpersist()

    MB.run(stream, handle, checkpoint)


def ingest_stamped(stream: DataFrame, target: str, checkpoint: str) -> None:
    """Server-side rows: write-time stamps, hostile searches rerouted."""
    MB.run(stream, lambda rows, batch_id: MB.put(EV.stamp_events(rows), target, batch_id), checkpoint)


def route_late(
    stream: DataFrame, on_time: str, late: str, marks: str, checkpoint: str, delay_secs: int
) -> None:
    """Rows older than the highest time of earlier batches minus the delay go to ``late``.

    They are kept, not dropped: reports recompute from both tables.
    """
    spark: SparkSession = stream.sparkSession
    mark_schema = spark.createDataFrame([], "high bigint").schema

    def handle(rows: DataFrame, batch_id: int) -> None:
        rows.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            # Each mark holds the highest time up to its batch, so the one before is enough.
            before = MB.get(spark, marks, mark_schema).filter(F.col("batch").between(batch_id - MARKS, batch_id - 1))
            high = before.agg(F.max("high")).scalar()
            is_late = F.coalesce(F.col("ts") < high - delay_secs, F.lit(False))
            MB.put(rows.filter(is_late), late, batch_id)
            MB.put(rows.filter(~is_late), on_time, batch_id)
            MB.put(rows.agg(F.greatest(F.max("ts"), high).alias("high")), marks, batch_id)
        finally:
            rows.unpersist()

    MB.run(stream, handle, checkpoint)
