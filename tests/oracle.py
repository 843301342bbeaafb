"""Compare registered Spark queries with their SQL twins in DuckDB."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "null"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        if math.isnan(v):
            return "null"
        return f"{int(v)}" if v == int(v) and abs(v) < 1e15 else repr(v)
    if isinstance(v, int):
        return str(v)
    if isinstance(v, pd.Timestamp):
        return v.isoformat()
    return str(v)


def rows_of(df: pd.DataFrame) -> list[tuple]:
    cols = sorted(df.columns)
    return sorted(tuple(_cell(v) for v in r) for r in df[cols].astype(object).itertuples(index=False))


def difference(spark_df, con, sql: str) -> str | None:
    left, right = spark_df.toPandas(), con.execute(sql).df()
    if sorted(left.columns) != sorted(right.columns):
        return f"columns {sorted(left.columns)} != {sorted(right.columns)}"
    a, b = rows_of(left), rows_of(right)
    if len(a) != len(b):
        return f"rows {len(a)} != {len(b)}; {a[:2]} / {b[:2]}"
    for x, y in zip(a, b):
        if x != y:
            n = sum(p != q for p, q in zip(a, b))
            return f"{n} of {len(a)} rows differ, first {x} != {y} {sorted(left.columns)}"
    if not a:
        return "EMPTY"
    return None


def main() -> None:
    sys.path.insert(0, ".")
    from shutterlake.catalog import registry
    from shutterlake.session import local_session

    sf, names = sys.argv[1], sys.argv[2:]
    spark = local_session(cores="8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    qs, sqls = registry()
    bad = 0
    for name, fn in qs.items():
        if names and not any(name.startswith(n) for n in names):
            continue
        at = time.time()
        try:
            if name in sqls:
                diff = difference(fn(spark, sf), con, sqls[name])
            else:
                n = fn(spark, sf).count()
                diff = None if n else "EMPTY (no oracle)"
        except Exception as e:
            diff = "ERROR " + str(e)[:1500]
        kind = "sql" if name in sqls else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {time.time() - at:6.2f} {kind} {name} {diff or ''}", flush=True)
        bad += diff is not None
    print("bad:", bad)


if __name__ == "__main__":
    main()
