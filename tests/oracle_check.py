"""Run registered queries next to their checking SQL: python tests/oracle_check.py [sf] [name ...]"""

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def cell(v):
    if v is None:
        return "\0"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6f}"
    if isinstance(v, int):
        return f"{v:.6f}"
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(spark, folder, name, queries, oracles, con):
    df = queries[name](spark, folder)
    got = [tuple(r) for r in df.collect()]
    if name not in oracles:
        return len(got), "rows only"
    want = con.sql(oracles[name])
    columns = list(want.columns)
    if sorted(columns) != sorted(df.columns):
        return len(got), f"columns {sorted(df.columns)} vs {sorted(columns)}"
    a, b = rows_of(df.columns, got), rows_of(columns, want.fetchall())
    if a == b:
        return len(got), "ok"
    sa, sb = set(a), set(b)
    return len(got), f"MISMATCH {len(a)} vs {len(b)}; only spark {sorted(sa - sb)[:3]}; only sql {sorted(sb - sa)[:3]}"


def connect(folder):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


if __name__ == "__main__":
    import __spark_entry__ as entry
    from spanloom.session import local_session

    sf, names = (sys.argv[1] if len(sys.argv) > 1 else "0.01"), sys.argv[2:]
    folder = f"/root/testdata/sf{sf}"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    bad = 0
    for name in names or entry.queries():
        started = time.time()
        try:
            n, verdict = compare(spark, folder, name, entry.queries(), entry.oracle_sql(), con)
        except Exception as exc:  # report and go on to the next query
            n, verdict = -1, f"ERROR {type(exc).__name__}: {str(exc)[:600]}"
        bad += verdict not in ("ok", "rows only")
        print(f"{name:32s} {n:8d} {time.time() - started:6.1f}s {verdict}", flush=True)
    print("bad:", bad)
