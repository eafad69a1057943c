"""Runs registered queries against their DuckDB text and compares whole results.

    python tests/oracle.py [--sf 0.01] [name-prefix ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TESTDATA = os.environ.get("TALLYGLASS_TESTDATA", "/root/testdata")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    if isinstance(value, decimal.Decimal):
        return "decimal"
    return type(value).__name__


def norm(value):
    if isinstance(value, (float, decimal.Decimal)):
        return repr(round(float(value), 9) + 0.0)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)) and not hasattr(value, "asDict"):
        return [norm(v) for v in value]
    if hasattr(value, "asDict"):
        return {k: norm(v) for k, v in value.asDict().items()}
    if isinstance(value, dict):
        return {k: norm(v) for k, v in value.items()}
    return value


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = {}
    out = []
    for row in rows:
        out.append(repr([norm(row[i]) for i in order]))
        for i in order:
            if row[i] is not None:
                kinds.setdefault(columns[i], kind(row[i]))
    return [columns[i] for i in order], kinds, sorted(out)


def compare(spark, con, fn, sql, sf_dir) -> tuple[str, str]:
    df = fn(spark, sf_dir)
    cols, kinds, rows = table(df.columns, df.collect())
    if sql is None:
        return ("rows-only" if rows else "EMPTY"), f"{len(rows)} rows"
    cur = con.execute(sql)
    wide = [d[0] for d in cur.description if str(d[1]) == "HUGEINT"]
    dcols, dkinds, drows = table([d[0] for d in cur.description], cur.fetchall())
    if cols != dcols:
        return "COLUMNS", f"{cols} vs {dcols}"
    if len(rows) != len(drows):
        return "COUNT", f"{len(rows)} vs {len(drows)}"
    if rows != drows:
        bad = [(a, b) for a, b in zip(rows, drows) if a != b]
        return "VALUES", f"{len(bad)} of {len(rows)} differ, {cols}\n   spark {bad[0][0][:600]}\n   duck  {bad[0][1][:600]}"
    off = {c: (kinds[c], dkinds[c]) for c in kinds if c in dkinds and kinds[c] != dkinds[c]}
    if off or wide:
        return "TYPES", f"{off} hugeint {wide}"
    return ("ok" if rows else "EMPTY"), f"{len(rows)} rows"


def main(argv: list[str]) -> int:
    from tallyglass import catalog
    from tallyglass.session import build_session

    sf = "0.01"
    if "--sf" in argv:
        at = argv.index("--sf")
        sf = argv[at + 1]
        argv = argv[:at] + argv[at + 2 :]
    catalog.load()
    spark = build_session("oracle")
    sf_dir = f"{TESTDATA}/sf{sf}"
    con = connect(sf_dir)
    tally: dict[str, int] = {}
    for name, fn in catalog.QUERIES.items():
        if argv and not any(name.startswith(p) for p in argv):
            continue
        start = time.time()
        try:
            status, note = compare(spark, con, fn, catalog.ORACLES.get(name), sf_dir)
        except Exception as error:  # noqa: BLE001
            status, note = "ERROR", str(error)[:900]
        tally[status] = tally.get(status, 0) + 1
        print(f"{status:10s} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(tally)
    return 0 if set(tally) <= {"ok", "rows-only"} else 1


if __name__ == "__main__":
    code = main(sys.argv[1:])
    sys.stdout.flush()
    os._exit(code)
