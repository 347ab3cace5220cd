"""Compare registered queries with their SQL on DuckDB.

    python -m tests.compare /root/testdata/sf0.01 [name-prefix ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

from figureyard.plans import registered


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    return con


def _plain(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, str)):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return int(v) if v == int(v) else float(f"{v:.10g}")
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    if hasattr(v, "as_tuple"):
        return _plain(float(v))
    return str(v)


def normal(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(spark, con, folder: str, name: str) -> str | None:
    """None when rows, column names and values agree."""
    df = registered.QUERIES[name](spark, folder)
    got = normal(df.columns, df.collect())
    rel = con.execute(registered.SQL[name])
    columns = [c[0] for c in rel.description]
    want = normal(columns, rel.fetchall())
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        have, need = set(got), set(want)
        extra, lost = sorted(have - need, key=repr)[:3], sorted(need - have, key=repr)[:3]
        return f"rows {len(got)} vs {len(want)}; only here {extra}; only SQL {lost}"
    return None


def main() -> None:
    from figureyard.session import local_session

    folder, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in registered.QUERIES:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            if name in registered.SQL:
                diff, n = difference(spark, con, folder, name), ""
            else:
                rows = registered.QUERIES[name](spark, folder).collect()
                diff, n = None, f"{len(rows)} (rows only)"
        except Exception as exc:  # report every query
            diff, n = f"{type(exc).__name__}: {str(exc)[:600]}", 0
        bad += diff is not None
        print(f"{'ok ' if diff is None else 'BAD'} {name} rows={n} {time.time() - start:.1f}s {diff or ''}",
              flush=True)
    print(f"{bad} differences")


if __name__ == "__main__":
    main()
