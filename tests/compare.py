"""Run a registered query and its SQL side by side and compare the full row sets.

Command line: ``python -m tests.compare [sf] [name-prefix ...]``.
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events "
    "documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    return str(value)


def kind(value) -> str:
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def rows_of(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def kinds_of(names: list[str], rows: list[tuple]) -> dict[str, set]:
    return {n: {kind(r[i]) for r in rows if r[i] is not None} for i, n in enumerate(names)}


def compare(spark, con, sf_dir: str, entry) -> dict:
    start = time.time()
    df = entry.run(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - start
    out = {"rows": len(got), "sec": round(took, 2), "problem": None}
    if entry.sql is None:
        return out
    cur = con.execute(entry.sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        out["problem"] = f"columns differ: spark={sorted(df.columns)} sql={sorted(names)}"
        return out
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if a != b:
        only_a = [r for r in a if r not in set(b)][:3]
        only_b = [r for r in b if r not in set(a)][:3]
        out["problem"] = f"{len(a)} vs {len(b)} rows; {sorted(names)}\n   spark {only_a}\n   sql   {only_b}"
        return out
    ka, kb = kinds_of(df.columns, got), kinds_of(names, want)
    off = {n: (ka[n], kb[n]) for n in names if ka[n] != kb[n]}
    if off:
        out["problem"] = f"value kinds differ: {off}"
    return out


def main() -> int:
    from pyspark.sql import SparkSession

    from fleetspan.registry import all_entries

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "8")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    bad = 0
    for name, entry in all_entries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            r = compare(spark, con, sf_dir, entry)
        except Exception as exc:  # report and go on with the next query
            r = {"rows": -1, "sec": 0, "problem": f"{type(exc).__name__}: {str(exc)[:600]}"}
        flag = "OK " if r["problem"] is None else "BAD"
        if entry.sql is None:
            flag += "(rows only)"
        if r["rows"] == 0:
            flag += " EMPTY"
        bad += r["problem"] is not None
        print(f"{flag} {name} rows={r['rows']} {r['sec']}s {r['problem'] or ''}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
