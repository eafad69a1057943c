"""Error log, summary and alarm."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ..plans import errors as PE
from ..session import scratch_dir
from ..sources import bind as B
from ..sources import error_log as EL
from . import query

ROOTS = ["/srv/site"]
# Log text of one event: the same expression builds the file and the DuckDB rows.
LABEL = "CASE k % 8 WHEN 0 THEN 'Fatal error' WHEN 1 THEN 'Parse error' WHEN 2 THEN 'Warning' WHEN 3 THEN 'Notice' WHEN 4 THEN 'Deprecated' WHEN 5 THEN 'Strict Standards' WHEN 6 THEN 'Fatal error' ELSE 'debug' END"
BODY = f"""concat('] PHP ', {LABEL}, ':  ', CASE k % 5 WHEN 0 THEN concat('Uncaught <b>Error</b>: id=', CAST(user_id AS STRING), ' at 0x7f', CAST(k AS STRING))
 WHEN 1 THEN concat('Undefined   variable $v', CAST(k % 3 AS STRING)) WHEN 2 THEN concat('Allowed memory size of ', CAST(k * 1000 AS STRING), ' bytes exhausted')
 WHEN 3 THEN 'A long text that repeats itself, a long text that repeats itself, a long text that repeats itself, a long text that repeats itself, a long text that repeats itself, end'
 ELSE 'Call to undefined function foo()' END, CASE WHEN k % 11 = 3 THEN '' ELSE concat(' in /srv/', CASE WHEN k % 7 = 2 THEN 'other' ELSE 'site' END, '/lib/f', CAST(k % 4 AS STRING), '.php on line ', CAST(k AS STRING)) END,
 CASE k % 6 WHEN 1 THEN concat(chr(10), 'Stack trace:', chr(10), '#0 phar:///usr/bin/wp/vendor/wp-cli/eval-command/src/Eval_Command.php(39): run()')
 WHEN 2 THEN concat(chr(10), '#0 {{main}}', chr(10), '  thrown in /srv/site/core/g', CAST(k % 3 AS STRING), '.php on line ', CAST(k AS STRING)) ELSE '' END)""".replace("{{", "{").replace("}}", "}")


def write_log(spark, sf, where="true", name="log"):
    """The bound events as a log file set in the shared scratch folder."""
    rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", f"{B.SPARK['k']} AS k").filter(where)
    line = rows.selectExpr(f"concat('[', date_format(ts, 'dd-MMM-yyyy HH:mm:ss'), ' UTC', {BODY}) AS value")
    path = scratch_dir(spark, name)
    line.write.text(path)
    return path


def entries(spark, sf, where="true"):
    return EL.parse_errors(EL.read_error_log(spark, write_log(spark, sf, where)), ROOTS)


RAW = f"""SELECT CAST(date_trunc('second', ts) AS TIMESTAMP) AS ts, concat('[', strftime(ts, '%d-%b-%Y %H:%M:%S'), ' UTC', {BODY}) AS raw FROM
 (SELECT *, {B.DUCK['k']} AS k FROM events)"""
_SEV = EL.SEVERITY
P1 = rf"""SELECT *, regexp_replace(first, '^\[[^\]]*\]\s*', '') AS body FROM (SELECT *, regexp_extract(raw, '^([^\n]*)', 1) AS first FROM raw)"""
P2 = rf"""SELECT ts, raw, lower(regexp_extract(body, '{_SEV}', 1)) AS lab,
 trim(regexp_replace(regexp_replace(regexp_replace(body, '(?i)^.*?\bPHP [^:]+:\s*', ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS msg,
 CASE WHEN regexp_matches(raw, 'thrown in (.+?) on line (\d+)') THEN regexp_extract(raw, 'thrown in (.+?) on line (\d+)', 1) ELSE regexp_extract(first, ' in (.+?) on line (\d+)', 1) END AS origin_path,
 CASE WHEN regexp_matches(raw, 'thrown in (.+?) on line (\d+)') THEN regexp_extract(raw, 'thrown in (.+?) on line (\d+)', 2) ELSE regexp_extract(first, ' in (.+?) on line (\d+)', 2) END AS line
 FROM p1 WHERE regexp_matches(body, '{_SEV}')"""
P3 = r"""SELECT *, CASE WHEN lab LIKE '%parse%' THEN 'parse' WHEN lab LIKE '%fatal%' THEN 'fatal' WHEN lab LIKE '%warning%' THEN 'warning' WHEN lab LIKE '%deprecated%' THEN 'deprecated'
 WHEN lab LIKE '%strict%' THEN 'strict' ELSE 'notice' END AS severity, regexp_extract(origin_path, '([^/]*)$', 1) AS base,
 trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(msg, ' in .+? on line \d+.*$', ''), '0x[0-9a-fA-F]+', '0xADDR', 'g'), '(?i)\bid[=: ]+\d+', 'id=N', 'g'), '\d+', 'N', 'g'), '\s+', ' ', 'g')) AS message FROM p2"""
ENT = r"""SELECT ts, raw, severity, message, CASE WHEN base = '' THEN '(unknown)' ELSE concat(base, CASE WHEN line <> '' THEN concat(':', line) ELSE '' END) END AS file,
 md5(concat_ws('|', severity, base, message)) AS signature, CASE WHEN length(msg) > 160 THEN concat(substr(msg, 1, 157), '...') ELSE msg END AS sample, origin_path,
 (origin_path = '' OR starts_with(origin_path, '/srv/site/')) AND NOT contains(raw, 'wp-cli/eval-command') AS from_production FROM p3"""
EC = {"raw": RAW, "p1": P1, "p2": P2, "p3": P3, "ent": ENT}


@query("io07_multiline_log_scan", B.duck("SELECT ts, raw FROM raw", "content", raw=RAW))
def _(spark, sf):
    return EL.read_error_log(spark, write_log(spark, sf)).select("ts", "raw")


@query(
    "e19_error_signature",
    B.duck("SELECT ts, severity, message, file, signature, sample, origin_path FROM ent", "content", **EC),
)
def _(spark, sf):
    return entries(spark, sf).select("ts", "severity", "message", "file", "signature", "sample", "origin_path")


@query("e20_production_origin", B.duck("SELECT ts, signature, from_production FROM ent", "content", **EC))
def _(spark, sf):
    return entries(spark, sf).select("ts", "signature", "from_production")


@query(
    "io08_rotated_logs",
    B.duck("SELECT ts, raw FROM raw WHERE ts >= TIMESTAMP '2024-01-10'", "content", raw=RAW),
)
def _(spark, sf):
    """Three files: the log, a rotated one, and an unrelated one that must not be read."""
    base = scratch_dir(spark, "rotated")
    for name, where in (
        ("app.log", "ts >= TIMESTAMP_NTZ '2024-01-20'"),
        ("app.log.1", "ts >= TIMESTAMP_NTZ '2024-01-10' AND ts < TIMESTAMP_NTZ '2024-01-20'"),
        ("other.log", "ts < TIMESTAMP_NTZ '2024-01-10'"),
    ):
        rows = spark.read.parquet(f"{sf}/events.parquet").selectExpr("*", f"{B.SPARK['k']} AS k").filter(where)
        line = rows.selectExpr(f"concat('[', date_format(ts, 'dd-MMM-yyyy HH:mm:ss'), ' UTC', {BODY}) AS value", f"'{name}' AS name")
        line.write.partitionBy("name").mode("append").text(base)
    # The folder name stands for the log name here: Spark chooses the names of the files it writes.
    chunks = spark.read.option("lineSep", "\n[").text(base).select("value", F.col("name").alias("file_name"))
    mine = (F.col("file_name") == "app.log") | F.col("file_name").startswith("app.log.")
    return EL.split_records(chunks.filter(mine & ~F.col("file_name").rlike(EL.ARCHIVES))).select("ts", "raw")


DAY = """SELECT CAST(ts AS DATE) AS snapshot_day, signature, arg_max(severity, struct_pack(a := ts, b := severity, c := file, d := sample)) AS severity,
 arg_max(file, struct_pack(a := ts, b := severity, c := file, d := sample)) AS file_line, arg_max(sample, struct_pack(a := ts, b := severity, c := file, d := sample)) AS sample_message,
 count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM {src} GROUP BY 1, 2"""
CUT = datetime(2024, 1, 29, 12)
EARLY, LATE = f"ts < TIMESTAMP_NTZ '{CUT}'", f"ts >= TIMESTAMP_NTZ '{CUT}'"


@query("io09_daily_error_rollup", B.duck(DAY.format(src="ent"), "content", **EC))
def _(spark, sf):
    """Two runs: the second merges into the first one's table."""
    return EL.rollup_errors(entries(spark, sf, LATE), EL.rollup_errors(entries(spark, sf, EARLY)))


MERGED = f"""SELECT signature, arg_max(severity, struct_pack(a := ts, b := severity, c := file, d := sample)) AS severity, arg_max(file, struct_pack(a := ts, b := severity, c := file, d := sample)) AS file,
 arg_max(sample, struct_pack(a := ts, b := severity, c := file, d := sample)) AS sample, CAST(sum(c) AS BIGINT) AS count, CAST(sum(act) AS BIGINT) AS active_count, min(f) AS first_seen, max(ts) AS last_seen FROM
 (SELECT signature, severity, file_line AS file, sample_message AS sample, count AS c, CASE WHEN last_seen >= {B.AS_OF_SQL} - INTERVAL 24 HOUR THEN count ELSE 0 END AS act, first_seen AS f, last_seen AS ts FROM day
   WHERE snapshot_day >= DATE '2024-01-24'
  UNION ALL SELECT signature, severity, file, sample, 1, (ts >= {B.AS_OF_SQL} - INTERVAL 24 HOUR)::INT, ts, ts FROM ent WHERE ts >= TIMESTAMP '{CUT}' AND ts >= TIMESTAMP '2024-01-24') GROUP BY 1"""
EM = {**EC, "old": f"SELECT * FROM ent WHERE ts < TIMESTAMP '{CUT}'", "day": DAY.format(src="old"), "m": MERGED}


def merged(spark, sf):
    return PE.merged_errors(EL.rollup_errors(entries(spark, sf, EARLY)), entries(spark, sf, LATE), B.AS_OF)


SUMMARY = B.duck(f"""SELECT *, {B.sql_round("count / 7.0", 1)} AS per_day, active_count > 0 AS active FROM m ORDER BY count DESC, signature LIMIT 25""", "content", **EM)


@query("r33_error_summary", SUMMARY)
def _(spark, sf):
    return PE.error_summary(merged(spark, sf))


for _name in ("j15_persisted_and_live", "u01_union_persisted_live"):
    query(_name, B.duck("SELECT * FROM m", "content", **EM))(lambda spark, sf: merged(spark, sf))

TOTALS = B.duck(f"""SELECT CAST(sum(count) AS BIGINT) AS total, CAST(sum(active_count) AS BIGINT) AS active_total, {B.sql_round("sum(active_count) / 1.0", 1)} AS active_per_day,
    count(*) FILTER (active_count > 0) AS active_signatures, count(*) AS distinct_signatures, count(*) > 25 AS truncated FROM m""", "content", **EM)
for _name in ("r33_error_summary__totals", "a23_active_window_totals"):
    query(_name, TOTALS)(lambda spark, sf: PE.error_totals(merged(spark, sf)))

# State with half of the signatures already alerted, some long ago, some at a high rate.
ALARM_AT = datetime(2024, 1, 30, 23, 50)
ALARM_WINDOW, ALARM_RECENCY = 12 * 3600, 2 * 3600
STATE_SQL = f"""SELECT signature, CASE WHEN substr(signature, 1, 1) < '6' THEN TIMESTAMP '{ALARM_AT}' - INTERVAL 1 HOUR WHEN substr(signature, 1, 1) < '9' THEN TIMESTAMP '{ALARM_AT}' - INTERVAL 2 DAY
 ELSE TIMESTAMP '{ALARM_AT}' - INTERVAL 9 DAY END AS last_alerted_at, CAST(CASE WHEN substr(signature, 2, 1) < '8' THEN 0 ELSE 100 END AS BIGINT) AS last_alerted_rate, max(ts) AS last_seen FROM {{}}
 WHERE ts < TIMESTAMP '{ALARM_AT}' - INTERVAL 1 DAY AND substr(signature, 1, 1) < 'c' GROUP BY 1"""


def alarm_inputs(spark, sf):
    """Entries and state; the log is parsed once, as alarms and the next state read both of them several times."""
    parsed = entries(spark, sf).select("ts", "signature", "severity", "file", "sample", "from_production")
    path = scratch_dir(spark, "entries")
    parsed.write.parquet(path)
    rows = spark.read.schema(parsed.schema).parquet(path)
    return rows, spark.sql(STATE_SQL.format("{entries}"), entries=rows)


def candidates(spark, sf):
    rows, state = alarm_inputs(spark, sf)
    return PE.alarm_candidates(rows, state, ALARM_AT, ALARM_WINDOW, ALARM_RECENCY, threshold=1)


CAND = f"""SELECT signature, severity, file, sample, count, rate AS rate_per_hr, first_seen, last_seen, isnew AS is_new, live AS is_live,
 CASE WHEN NOT live THEN 'resolved_not_firing' ELSE concat_ws(',', CASE WHEN isnew THEN 'new_signature' END, CASE WHEN back THEN 'returned_after_quiet' END,
  CASE WHEN rate >= 1 AND (isnew OR back OR worse) THEN 'over_threshold' END, CASE WHEN worse THEN 'escalated' END) END AS reasons, live AND (isnew OR back OR worse) AS would_alarm FROM
 (SELECT *, NOT isnew AND date_diff('second', last_alerted_at, TIMESTAMP '{ALARM_AT}') > {2 * ALARM_WINDOW} AS back, NOT isnew AND rate >= 1 AND rate > coalesce(last_alerted_rate, 0) * 2 AS worse,
   last_seen >= TIMESTAMP '{ALARM_AT}' - INTERVAL {ALARM_RECENCY} SECOND AS live FROM
  (SELECT a.*, s.signature IS NULL AS isnew, last_alerted_at, last_alerted_rate, CAST(round(count * (3600.0::DOUBLE / greatest(date_diff('second', first_seen, a.last_seen), 60))) AS BIGINT) AS rate FROM
   (SELECT signature, arg_max(severity, struct_pack(a := ts, b := severity, c := file, d := sample)) AS severity, arg_max(file, struct_pack(a := ts, b := severity, c := file, d := sample)) AS file,
     arg_max(sample, struct_pack(a := ts, b := severity, c := file, d := sample)) AS sample, count(*) AS count, min(ts) AS first_seen, max(ts) AS last_seen FROM ent
    WHERE severity IN ('fatal', 'parse') AND from_production AND ts BETWEEN TIMESTAMP '{ALARM_AT}' - INTERVAL {ALARM_WINDOW} SECOND AND TIMESTAMP '{ALARM_AT}' GROUP BY 1) a
   LEFT JOIN st s ON s.signature = a.signature))"""
AL = {**EC, "st": STATE_SQL.format("ent"), "cand": CAND}


@query("r34_fatal_alarm", B.duck("SELECT * FROM cand", "content", **AL))
def _(spark, sf):
    return candidates(spark, sf)


@query(
    "r34_fatal_alarm__state",
    B.duck(f"""SELECT signature, last_alerted_at, last_alerted_rate, last_seen FROM st WHERE last_alerted_at >= TIMESTAMP '{ALARM_AT}' - INTERVAL 7 DAY
    AND signature NOT IN (SELECT signature FROM cand WHERE would_alarm) UNION ALL SELECT signature, TIMESTAMP '{ALARM_AT}', rate_per_hr, last_seen FROM cand WHERE would_alarm""", "content", **AL),
)
def _(spark, sf):
    rows, state = alarm_inputs(spark, sf)
    return PE.next_state(PE.alarm_candidates(rows, state, ALARM_AT, ALARM_WINDOW, ALARM_RECENCY, threshold=1), state, ALARM_AT)
