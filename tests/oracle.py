"""Runs registered queries against their SQL in DuckDB: python -m tests.oracle [--sf DIR] [NAME...]"""

from __future__ import annotations

import sys
import time
from collections import Counter
from pathlib import Path

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0 if v == v else "nan"
    return v


def bag(names: list[str], rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(con, df, sql: str) -> str:
    """'' if both give the same columns and rows, else what differs."""
    found = con.execute(sql)
    want_names = [d[0] for d in found.description]
    want = bag(want_names, found.fetchall())
    got = bag(df.columns, df.collect())
    if sorted(want_names) != sorted(df.columns):
        return f"columns {sorted(df.columns)}, wanted {sorted(want_names)}"
    if want != got:
        return f"{sum(got.values())} rows, wanted {sum(want.values())}; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return ""


def main(args: list[str]) -> int:
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as entry
    from siftwell.session import local_session

    sf = "/root/testdata/sf0.01"
    if args[:1] == ["--sf"]:
        sf, args = args[1], args[2:]
    spark, con, bad = local_session(), connect(sf), 0
    queries, sql = entry.queries(), entry.oracle_sql()
    for name in args or queries:
        began = time.time()
        try:
            df = queries[name](spark, sf)
            said = compare(con, df, sql[name]) if name in sql else f"no SQL; {df.count()} rows"
        except Exception as e:  # noqa: BLE001
            said = f"ERROR {type(e).__name__} {str(e)[:1500]}"
        ok = not said or said.startswith("no SQL")
        bad += not ok
        print(f"{'ok  ' if ok else 'BAD '} {name} {time.time() - began:.1f}s {said}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
