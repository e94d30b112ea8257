"""Run registered queries beside their SQL in DuckDB and compare names, types, counts and values."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
         "boolean": "BOOLEAN", "float": "FLOAT"}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v, digits=9):
    if v is None:
        return ("", "null")
    if isinstance(v, bool):
        return ("b", v)
    if isinstance(v, (int, float)):
        if isinstance(v, float) and math.isnan(v):
            return ("n", "nan")
        return ("n", float(f"{float(v):.{digits}g}") + 0.0)
    return ("s", str(v))


def differences(df, con, sql: str) -> list[str]:
    rel = con.sql(sql)
    bad = []
    scols, dcols = sorted(df.columns), sorted(rel.columns)
    if scols != dcols:
        return [f"columns {scols} against {dcols}"]
    dtypes = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        want = TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())
        if dtypes[f.name] != want:
            bad.append(f"type of {f.name}: {want} against {dtypes[f.name]}")
    left = sorted(tuple(norm(r[c]) for c in scols) for r in df.collect())
    pos = [rel.columns.index(c) for c in scols]
    right = sorted(tuple(norm(r[i]) for i in pos) for r in rel.fetchall())
    if len(left) != len(right):
        bad.append(f"{len(left)} rows against {len(right)}")
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        bad.append(f"{len(wrong)} rows differ, first {scols}\n   {wrong[0][0]}\n   {wrong[0][1]}")
    if not left:
        bad.append("no rows")
    return bad


def main(argv):
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry
    sf = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark = (SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "12g")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.showConsoleProgress", "false").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    con, queries, oracles = connect(sf), entry.queries(), entry.oracle_sql()
    failed = 0
    for name, fn in queries.items():
        if only and not any(o in name for o in only):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                bad = differences(df, con, oracles[name])
                note = "ok" if not bad else "; ".join(bad)
            else:
                n = len(df.collect())
                bad, note = ([], f"rows only: {n}") if n else (["none"], "NO ROWS")
        except Exception as e:  # noqa: BLE001 - every query is reported
            bad, note = [str(e)], f"ERROR {type(e).__name__}: {str(e)[:1500]}"
        failed += bool(bad)
        print(f"{name:32s} {time.time() - t0:6.1f}s  {note}", flush=True)
    print("failed:", failed, "of", len(queries), "- without SQL:", [q for q in queries if q not in oracles])
    return failed


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
