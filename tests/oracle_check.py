"""Compare registered queries with their SQL in DuckDB.

    python tests/oracle_check.py [sf_dir] [query ...]
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    return value


def _rows(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, sf_dir: str, fn, sql: str) -> str | None:
    """None when both sides agree, else what differs."""
    df = fn(spark, sf_dir)
    got = _rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = _rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    if len(got) != len(want):
        extra = [r for r in got if r not in set(want)][:2]
        lack = [r for r in want if r not in set(got)][:2]
        return f"{len(got)} rows != {len(want)} rows; only ours {extra}; only theirs {lack}"
    for g, w in zip(got, want):
        if g != w or [type(a) for a in g] != [type(a) for a in w]:
            return f"first difference in {sorted(names)}:\n   ours   {str(g)[:600]}\n   theirs {str(w)[:600]}"
    return None if got else "no rows"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries as all_queries
    from talkmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("oracle-check", "8", 8)
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = all_queries(), oracle_sql()
    names = sys.argv[2:] or list(queries)
    con = connect(sf_dir)
    bad = 0
    for name in names:
        start = time.time()
        try:
            if name in oracles:
                problem = compare(spark, con, sf_dir, queries[name], oracles[name])
            else:
                problem = None if queries[name](spark, sf_dir).count() else "no rows"
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:1200]}"
        bad += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - start:6.2f}s {name} {problem or ''}", flush=True)
    print(f"{len(names) - bad} of {len(names)} agree")
    return bad


if __name__ == "__main__":
    sys.exit(main())
