"""Compare the queries with their DuckDB twins: python tests/compare.py [sf] [query ...]."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    return value


def rows(columns, records) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_cell(r[i]) for i in order) for r in records)


def difference(spark, con, sf_dir: str, name: str, queries, oracles) -> str | None:
    frame = queries[name](spark, sf_dir)
    mine = rows(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.sql(oracles[name])
    theirs = rows(result.columns, result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} / {theirs[0]}"
    if mine[1] != theirs[1]:
        left, right = mine[1] - theirs[1], theirs[1] - mine[1]
        return f"{sum(left.values())} / {sum(right.values())} rows differ: {list(left)[:2]} / {list(right)[:2]}"
    return None


def main() -> None:
    import __spark_entry__ as entry
    from mementa.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    bad = 0
    for name in sys.argv[2:] or queries:
        if name not in oracles:
            print("NO SQL", name)
            continue
        start = time.time()
        try:
            problem = difference(spark, con, sf_dir, name, queries, oracles)
        except Exception as error:  # report and go on with the others
            problem = f"{type(error).__name__}: {str(error)[:400]}"
        bad += problem is not None
        print(f"{'ok ' if problem is None else 'BAD'} {name:28s} {time.time() - start:6.2f}s {problem or ''}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
