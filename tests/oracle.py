"""Run queries in Spark and their SQL in DuckDB and compare rows in any order."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    return value


def compare(spark, con, query, sf_dir: str, check_plan=None) -> str | None:
    """None where both sides agree, else what differs."""
    df = query.run(spark, sf_dir)
    if check_plan:
        check_plan(df._jdf.queryExecution().executedPlan().toString())
    got = df.collect()
    if query.sql is None:
        return None
    cur = con.execute(query.sql)
    names = [c[0] for c in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(c) for c in df.columns]
    want = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    have = Counter(tuple(plain(v) for v in r) for r in got)
    if have == want:
        return None if have else "both sides are empty"
    extra, missing = list((have - want).items())[:3], list((want - have).items())[:3]
    return f"{sum(have.values())} rows against {sum(want.values())}\n  spark only {extra}\n  sql only   {missing}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
    from cellweave.queries import all_queries
    from cellweave.session import local_session

    sf_dir, wanted = sys.argv[1], sys.argv[2:]
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con, failed = connect(sf_dir), 0
    for name, query in all_queries().items():
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            problem = compare(spark, con, query, sf_dir)
        except Exception as e:  # noqa: BLE001
            problem = f"{type(e).__name__}: {str(e)[:1500]}"
        failed += problem is not None
        state = "ok" if problem is None else "FAILED"
        print(f"{name:40s} {state} {time.time() - start:6.2f}s{'' if query.sql else ' (no SQL)'}", flush=True)
        if problem:
            print("  " + problem, flush=True)
    print("failed:", failed)
