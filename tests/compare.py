"""Run queries in Spark and in DuckDB on the same parquet files and compare the rows."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v)
    return str(v)


def table_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(normal(row[i]) for i in order) for row in rows)


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, else a description of the difference."""
    df = fn(spark, sf_dir)
    cols, got = table_rows(df.columns, [tuple(x) for x in df.collect()])
    if sql is None:
        return None if got else "no rows"
    res = con.execute(sql)
    types = {d[0]: str(d[1]) for d in res.description}
    wcols, want = table_rows([d[0] for d in res.description], res.fetchall())
    if cols != wcols:
        return f"columns {cols} vs {wcols}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:3]
        return f"{len(got)} vs {len(want)} rows; {bad}; {df.dtypes} vs {types}"
    loose = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "int": "INTEGER"}
    odd = [(c, t, types[c]) for c, t in df.dtypes if loose.get(t, t) != types[c]]
    return f"types {odd}" if odd else None


def main(argv):
    from freqloom.session import local_session
    import __spark_entry__ as e

    sf_dir = f"/root/testdata/{argv[0]}"
    wanted = argv[1:]
    spark, con = local_session("8"), duck(sf_dir)
    bad = 0
    for name, fn in e.queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            diff = compare(spark, con, name, fn, e.oracle_sql().get(name), sf_dir)
        except Exception as ex:  # noqa: BLE001
            diff = f"{type(ex).__name__}: {str(ex)[:1500]}"
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} {time.time() - start:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv[1:])
