"""Run queries next to their SQL twins: python tests/check.py SF_DIR [prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def connect(sf: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cell(v):
    if v is None:
        return None
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return Counter(tuple((type(cell(r[i])).__name__, cell(r[i])) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a short account of the difference."""
    got = df.collect()
    cur = con.execute(sql)
    want_cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(df.columns) != sorted(want_cols):
        return f"columns {sorted(df.columns)} vs {sorted(want_cols)}", len(got)
    a, b = rows_of(df.columns, got), rows_of(want_cols, want)
    if a == b:
        return None, len(got)
    return f"rows {len(got)} vs {len(want)}; only spark {list((a - b).items())[:3]}; only sql {list((b - a).items())[:3]}", len(got)


def main():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry
    from daymill.session import build_session

    sf, prefixes = sys.argv[1], sys.argv[2:]
    spark = build_session(master="local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf)
    oracles = entry.oracle_sql()
    bad = 0
    for name, fn in entry.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        t = time.time()
        try:
            df = fn(spark, sf)
            if name in oracles:
                diff, n = compare(df, con, oracles[name])
            else:
                n = len(df.collect())
                diff = None
        except Exception as e:  # noqa: BLE001
            diff, n = f"{type(e).__name__}: {str(e)[:900]}", -1
        bad += diff is not None
        kind = "sql" if name in oracles else "rows"
        print(f"{'ok ' if diff is None else 'BAD'} {kind:4} {name} rows={n} {time.time() - t:.1f}s {diff or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
