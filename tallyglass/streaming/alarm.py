"""Fatal-rate alarm with keyed state: each signature holds its own window, alert and clock."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans import errors as PE
from ..sources import error_log as EL

SECOND = "severity string, file string, sample string, n bigint"
SHOWN = (
    "signature string, severity string, file string, sample string, count bigint, rate_per_hr bigint, first_seen bigint, "
    "last_seen bigint, is_new boolean, is_live boolean, reasons string, would_alarm boolean, as_of bigint"
)


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each signature and second of a batch: a signature that floods the log meets its state in few rows."""
    keys = ["signature", "second", "severity", "file", "sample"]
    for batch in batches:
        if batch.num_rows:
            out = pa.Table.from_batches([batch]).group_by(keys).aggregate([("n", "sum")])
            yield from out.rename_columns([*keys, "n"]).combine_chunks().to_batches()


class FatalAlarm(StatefulProcessor):
    """State of one signature.

    ``recent`` counts its entries per second and forgets them after two windows; ``alert`` is the last alarm
    and is forgotten after ``keep_secs``; ``clock`` never goes back. Time is the processing time, so
    that a line with a wrong date moves nothing: what lies ahead of the clock counts once its time has come.
    ``at`` (epoch milliseconds) replays a recorded log at that time, without timers.
    """

    def __init__(self, window: int, recency: int, threshold: int, keep_secs: float, at: int | None):
        self.window, self.recency, self.threshold, self.keep_secs, self.at = window, recency, threshold, keep_secs, at

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        keep = max(1, int(self.keep_secs * 1000))
        self.recent = handle.getMapState("recent", "second bigint", SECOND, 2000 * self.window)
        self.alert = handle.getValueState("alert", "at bigint, rate bigint", keep)
        self.clock = handle.getValueState("clock", "ms bigint", max(keep, 2000 * self.window))

    def now(self, timers) -> int:
        ms = self.at if self.at is not None else timers.getCurrentProcessingTimeInMs()
        if self.clock.exists():
            ms = max(ms, self.clock.get()[0])
        self.clock.update((ms,))
        return ms

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        now = self.now(timerValues)
        fresh: dict[int, tuple] = {}
        for row in rows:
            shown, n = (row["severity"], row["file"], row["sample"]), row["n"]
            old = fresh.get(row["second"], (("", "", ""), 0))
            fresh[row["second"]] = (max(old[0], shown), old[1] + n)
        for second, (shown, n) in fresh.items():
            if second < now // 1000 - self.window:
                continue
            stored = self.recent.getValue((second,)) if self.recent.containsKey((second,)) else None
            if stored:
                shown, n = max(shown, tuple(stored[:3])), n + stored[3]
            self.recent.updateValue((second,), (*shown, n))
        yield from self.judged(key[0], now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.judged(key[0], self.now(timerValues))

    def judged(self, signature: str, now_ms: int) -> Iterator[Row]:
        now = now_ms // 1000
        seen = {}
        for (second,), value in list(self.recent.iterator()):
            if second < now - self.window:
                self.recent.removeKey((second,))
            elif second <= now:
                seen[second] = value
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if not seen:
            return
        first, last = min(seen), max(seen)
        count = sum(v[3] for v in seen.values())
        rate = int(count * 3600.0 / max(last - first, 60) + 0.5)
        alert = self.alert.get() if self.alert.exists() else None
        live, new = last >= now - self.recency, alert is None
        back = not new and now - alert[0] // 1000 > 2 * self.window
        over = rate >= max(1, self.threshold)
        worse = not new and over and rate > 2 * alert[1]
        fires = new or back or worse
        named = (("new_signature", new), ("returned_after_quiet", back), ("over_threshold", over and fires), ("escalated", worse))
        reasons = ",".join(name for name, true in named if true) if live else "resolved_not_firing"
        if live and fires:
            self.alert.update((now_ms, rate))
        if live and self.at is None:  # to report when it has stopped
            self.handle.registerTimer((last + self.recency + 1) * 1000)
        severity, file, sample, _ = seen[last]
        yield Row(
            signature=signature, severity=severity, file=file, sample=sample, count=count, rate_per_hr=rate, first_seen=first,
            last_seen=last, is_new=new, is_live=live, reasons=reasons, would_alarm=live and fires, as_of=now,
        )


def alarms(
    stream: DataFrame,
    roots: list[str],
    window: int = PE.WINDOW,
    recency: int = PE.RECENCY,
    threshold: int = PE.THRESHOLD,
    severities: tuple[str, ...] = PE.ALARM_SEVERITIES,
    keep_secs: float = 86400 * PE.KEEP_DAYS,
    at: datetime | None = None,
) -> DataFrame:
    """Verdicts of the signatures that a batch or a timer touches, as a stream to append."""
    entries = EL.parse_errors(EL.split_records(stream), roots)
    mine = entries.filter(F.col("severity").isin(*severities) & F.col("from_production") & F.col("ts").isNotNull())
    rows = mine.select("signature", F.unix_seconds("ts").alias("second"), "severity", "file", "sample", F.lit(1).cast("bigint").alias("n"))
    folded = rows.mapInArrow(_folded, rows.schema)
    ms = None if at is None else int((at - datetime(1970, 1, 1)).total_seconds() * 1000)
    judged = folded.groupBy("signature").transformWithState(FatalAlarm(window, recency, threshold, keep_secs, ms), SHOWN, "Append", "ProcessingTime")
    times = [F.timestamp_seconds(c).alias(c) for c in ("first_seen", "last_seen")]
    return judged.select(
        "signature", "severity", "file", "sample", "count", "rate_per_hr", *times, "is_new", "is_live", "reasons", "would_alarm",
        F.timestamp_seconds("as_of").alias("as_of"),
    )


@contextmanager
def keyed_state(spark: SparkSession, once: bool):
    """State of several variables a key needs the RocksDB store; queries started inside use it.

    A run that is to end, ``once``, must not wait for timers: state by processing time asks for batches without end.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if once:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def watch_keyed(stream: DataFrame, target: str, checkpoint: str, roots: list[str], every: str | None = None, **rules):
    """Writes the verdicts as Parquet, each once. Without ``every`` the call ends when all there is was read."""
    out = alarms(stream, roots, **rules)
    writer = out.writeStream.outputMode("append").format("parquet").option("path", target).option("checkpointLocation", checkpoint)
    with keyed_state(stream.sparkSession, every is None):
        query = (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()
        if every is None:
            query.awaitTermination()
    return query
