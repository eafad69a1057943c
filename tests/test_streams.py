"""Streams: byte tail, keyed alarm, folded tables, late rows, rows without a day."""

import os
import random
import shutil
import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tallyglass.session import scratch_dir
from tallyglass.sources import maintenance as M
from tallyglass.streaming import alarm as SA
from tallyglass.streaming import batches as MB
from tallyglass.streaming import late as SL
from tallyglass.streaming import tail as ST


def record(i, extra=""):
    return f"[2{i:03d}] record {i}{extra}"


def put_text(path, *records, mode="a"):
    with open(path, mode) as file:
        file.write("".join(r + "\n" for r in records))


class Tail:
    def __init__(self, spark, base=None, split=40):
        self.spark, self.out, self.logs = spark, scratch_dir(spark, "tail"), scratch_dir(spark, "logs")
        os.makedirs(self.logs)
        self.base, self.split = base, split

    def path(self, name):
        return f"{self.logs}/{name}"

    def run(self, fail=False):
        def handle(rows, batch_id):
            MB.put(rows, f"{self.out}/rows", batch_id)
            if fail:
                raise RuntimeError("lost")

        stream = ST.tail_bytes(self.spark, self.logs, f"{self.out}/memory", self.base, self.split)
        MB.run(stream, handle, f"{self.out}/ckpt")

    def rows(self):
        return sorted(r["value"] for r in self.spark.read.parquet(f"{self.out}/rows").collect())


def test_growing_rotated_and_cut_logs(spark):
    tail = Tail(spark, "app.log")
    log, old = tail.path("app.log"), tail.path("app.log.1")
    put_text(log, "text before the first record", *map(record, range(4)))
    put_text(tail.path("other.log"), record(900))
    put_text(tail.path("app.log.2.gz"), record(901))
    tail.run()
    assert tail.rows() == [record(i) for i in range(3)]  # the last one may still grow
    put_text(log, "its stack", "[not a stamp", *map(record, range(4, 30)))
    tail.run()
    put_text(log, record(30))
    os.rename(log, old)
    put_text(log, *map(record, range(31, 34)))
    tail.run()
    shutil.copy(log, tail.path("app.log.3"))  # copied, then emptied and filled anew
    put_text(log, record(34), mode="w")
    tail.run()
    tail.run()
    want = [record(i) for i in range(35) if i != 3] + [record(3, "\nits stack"), "[not a stamp"]
    assert tail.rows() == sorted(want)
    tail.run()
    assert tail.rows() == sorted(want)


def test_a_batch_that_failed_reads_the_same_bytes(spark):
    tail = Tail(spark)
    put_text(tail.path("a"), *map(record, range(20)))
    put_text(tail.path("b"), *map(record, range(100, 120)))
    with pytest.raises(Exception):
        tail.run(fail=True)
    put_text(tail.path("a"), *map(record, range(20, 25)))
    os.rename(tail.path("b"), tail.path("c"))
    tail.run()
    tail.run()
    tail.run()
    assert tail.rows() == sorted([record(i) for i in (*range(25), *range(100, 120))])


def test_records_of_split_ranges(tmp_path):
    rng = random.Random(4)
    for _ in range(60):
        body = b"".join(rng.choice([b"[a] x\n", b"[bb] yy\nmore\n", b"plain\n", b"\n", b"[c]" + b"z" * rng.randint(0, 90) + b"\r\n"]) for _ in range(rng.randint(0, 30)))
        (tmp_path / "log").write_bytes(body)
        files, name = ST.Files(str(tmp_path), None), str(tmp_path / "log")
        want, held, at = [], None, 0
        for line in body.splitlines(keepends=True):
            if line.startswith(b"["):
                want += [held] if held else []
                held = (at, line)
            elif held:
                held = (held[0], held[1] + line)
            at += len(line)
        want = [(p, x.rstrip(b"\r\n")) for p, x in want + ([held] if held else [])]
        step = rng.choice([1, 7, 50, 1000])
        got = []
        for low in range(0, len(body), step):
            got += ST.records(files, name, ST.Range(name, 0, "", 0, low, min(low + step, len(body)), len(body)))
        assert got == want


def fatal(moment, message):
    return f"[{moment:%d-%b-%Y %H:%M:%S} UTC] PHP Fatal error:  {message} in /srv/site/a.php on line 3"


def test_keyed_alarm(spark):
    logs, out = scratch_dir(spark, "logs"), scratch_dir(spark, "alarm")
    os.makedirs(logs)

    def run(*lines, keep_secs=600):
        put_text(f"{logs}/{time.time_ns()}", *lines)
        stream = spark.readStream.option("lineSep", "\n[").text(logs)
        SA.watch_keyed(stream, f"{out}/rows", f"{out}/ckpt", ["/srv/site"], keep_secs=keep_secs)
        return [r for r in spark.read.parquet(f"{out}/rows").orderBy("as_of").collect()]

    now = datetime.now(timezone.utc).replace(tzinfo=None, microsecond=0)
    ago = lambda s: now - timedelta(seconds=s)
    first = run(fatal(ago(100), "boom"), fatal(ago(40), "boom"), fatal(now + timedelta(days=9), "boom"), fatal(ago(9000), "boom"))
    assert [(r["count"], r["rate_per_hr"], r["reasons"], r["would_alarm"]) for r in first] == [(2, 120, "new_signature,over_threshold", True)]
    second = run(fatal(ago(1000), "boom"))  # older than what was seen: it counts, and nothing fires again
    assert [(r["count"], r["is_new"], r["is_live"], r["would_alarm"]) for r in second[1:]] == [(3, False, True, False)]
    third = run(*[fatal(ago(s), "boom") for s in range(10, 400)])
    assert third[-1]["count"] == 393 and third[-1]["reasons"] == "over_threshold,escalated"
    late = run(fatal(ago(3000), "quiet"))
    assert [(r["reasons"], r["would_alarm"]) for r in late if "quiet" in r["sample"]] == [("resolved_not_firing", False)]


def test_alarm_state_is_forgotten(spark):
    logs, out = scratch_dir(spark, "logs"), scratch_dir(spark, "alarm")
    os.makedirs(logs)

    def run():
        moment = datetime.now(timezone.utc).replace(tzinfo=None)
        put_text(f"{logs}/{time.time_ns()}", fatal(moment, "boom"))
        SA.watch_keyed(spark.readStream.option("lineSep", "\n[").text(logs), f"{out}/rows", f"{out}/ckpt", [], keep_secs=20)
        return spark.read.parquet(f"{out}/rows").orderBy(F.desc("as_of")).first()["is_new"]

    assert run() and not run()
    time.sleep(21)
    assert run()


SUMS = "day date, k string, n bigint"


def summed(rows):
    return rows.groupBy("day", "k").agg(F.sum("n").alias("n"))


def test_folded_batches(spark):
    path = scratch_dir(spark, "folded")
    table = MB.Folded(spark, path, spark.createDataFrame([], SUMS).schema, summed, by="day")
    assert table.read().count() == 0 and table.compact() is None
    rows = spark.range(2000).selectExpr("date_add(DATE '2024-01-01', CAST(id % 3 AS INT)) AS day", "concat('k', id % 7) AS k", "id AS n", "id % 200 AS batch")
    rows.repartition(1).write.partitionBy("batch").parquet(f"{path}/delta")
    want = sorted(map(tuple, summed(rows).collect()))
    assert table.compact() == (0, 198) and table.compact() is None and table.batches()[-1] == 199
    assert sorted(map(tuple, table.read().collect())) == want
    assert len(table.rows().inputFiles()) <= 5  # three days and one batch
    table.put(rows.filter("batch = 50"), 50)  # replayed: its layer has it
    assert sorted(map(tuple, table.read().collect())) == want
    table.put(rows.filter("batch = 50"), 200)
    os.makedirs(f"{path}/layers/{0:012d}-{999:012d}")  # a layer that was never finished
    more = sorted(map(tuple, summed(rows.unionByName(rows.filter("batch = 50"))).collect()))
    assert sorted(map(tuple, table.read().collect())) == more
    assert table.compact() == (199, 199) and table.compact(whole=True) == (0, 199) and table.layers() == [(0, 199)]
    assert table.vacuum() == 202 and table.batches() == [200]
    assert sorted(map(tuple, table.read().collect())) == more
    day = F.col("day") == F.lit("2024-01-02").cast("date")
    assert {r["day"].day for r in table.read(day).collect()} == {2}


def sessions_of(rows, gap):
    out = []
    for who in sorted({v for v, _ in rows}):
        times = sorted(t for v, t in rows if v == who)
        for t in times:
            if out and out[-1][0] == who and t - out[-1][2] <= gap:
                out[-1] = (who, out[-1][1], t, out[-1][3] + 1)
            else:
                out.append((who, t, t, 1))
    return sorted(out)


def test_late_rows_join_sessions(spark):
    rng, gap = random.Random(6), 1800
    rows = [(rng.choice("abcd"), rng.randrange(6 * 86400)) for _ in range(400)]
    rows += [("e", 86400 * k // 40) for k in range(200)]  # never pauses for long
    late = [r for r in rows if rng.random() < 0.3] + [("new", 5), ("new", 1805), ("new", 4000)]
    on_time = list(rows)
    for r in late:
        if r in on_time:
            on_time.remove(r)
    path = scratch_dir(spark, "sessions")
    SL.store_sessions(spark.createDataFrame(sessions_of(on_time, gap), SL.SESSION), path)
    frame = spark.createDataFrame([("pageview", v, t) for v, t in late] + [("click", "a", 1), ("pageview", None, 3)], "event_type string, visitor_id string, ts bigint")
    staging = scratch_dir(spark, "staging")
    assert SL.merge_late_sessions(spark, path, frame, staging, gap) > 0
    want = sessions_of(on_time + late, gap)
    read = lambda: sorted(tuple(r)[:4] for r in spark.read.parquet(path).select(*SL.SESSION_NAMES).collect())
    assert read() == want
    SL.merge_late_sessions(spark, path, frame, staging, gap)  # the same run again
    assert read() == want
    far = spark.createDataFrame([("pageview", "zz", 86400 * 5)], frame.schema)
    assert SL.merge_late_sessions(spark, path, far, scratch_dir(spark, "staging"), gap) == 1
    assert read() == sorted([*want, ("zz", 86400 * 5, 86400 * 5, 1)])


def test_rows_without_a_day_are_erased(spark):
    path = scratch_dir(spark, "bronze")
    data = [(1, "email_sent", 7, None), (2, "email_sent", 8, None), (3, "email_sent", 7, "2024-01-02"), (4, "pageview", 7, "2024-01-02"), (5, "email_sent", 9, "2024-01-03")]
    rows = spark.createDataFrame(data, "id long, event_type string, user_id long, event_date string").withColumn("event_date", F.to_date("event_date"))
    rows.write.partitionBy("event_date").parquet(path)
    left = lambda: sorted(r["id"] for r in spark.read.schema(rows.schema).parquet(path).collect())
    assert M.erase_days(spark, path, scratch_dir(spark, "s"), 7) == 2 and left() == [2, 4, 5]
    assert M.erase_days(spark, path, scratch_dir(spark, "s"), 8) == 1 and left() == [4, 5]
    assert not os.path.exists(f"{path}/event_date={M.NULL_FOLDER}")
