"""Run registered queries against their SQL on the same tables and compare values."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else v
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is not None, str(type(x)), str(x)) for x in r))


def compare(spark, con, sf_dir, plan, sql) -> str:
    """'' when equal, else what differs."""
    df = plan(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    want = res.fetchall()
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    a, b = rows_of(df.columns, got), rows_of(names, want)
    if len(a) != len(b):
        return f"rows {len(a)} vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return "" if not bad else f"{len(bad)} of {len(a)} rows differ, e.g. {bad[0][0]} vs {bad[0][1]}"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from cohortloom.session import build_session

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    spark = build_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g",
           "spark.sql.autoBroadcastJoinThreshold": os.environ.get("BCAST", "10MB")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = duck(sf_dir)
    plans, sqls = entry.queries(), entry.oracle_sql()
    failed = 0
    for name in plans:
        if argv and not any(name.startswith(a) for a in argv):
            continue
        start = time.time()
        try:
            if name in sqls:
                msg = compare(spark, con, sf_dir, plans[name], sqls[name])
                n = con.execute(f"SELECT count(*) FROM ({sqls[name]})").fetchone()[0]
            else:
                n, msg = len(plans[name](spark, sf_dir).collect()), ""
        except Exception as e:  # noqa: BLE001
            msg, n = f"{type(e).__name__}: {str(e)[:600]}", -1
        failed += bool(msg)
        kind = "sql" if name in sqls else "rows"
        print(f"{'FAIL' if msg else 'ok'} {name} [{kind}] rows={n} {time.time() - start:.1f}s {msg}", flush=True)
    print("failed", failed)
    return failed


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
