"""Running a query and its SQL side by side."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf: str):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(round(value, 9) + 0.0)
    if isinstance(value, (list, tuple)):
        return str([_plain(v) for v in value])
    return repr(value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted([tuple(_plain(r[i]) for i in order) for r in rows])


def compare(spark, con, sf: str, query, sql: str) -> str | None:
    """None when equal, else what differs."""
    frame = query(spark, sf)
    ours = rows_of(frame.columns, [tuple(r) for r in frame.collect()])
    result = con.execute(sql)
    theirs = rows_of([d[0] for d in result.description], result.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if ours[1] == theirs[1]:
        return None
    a, b = set(ours[1]), set(theirs[1])
    return f"rows {len(ours[1])} vs {len(theirs[1])}; only ours {sorted(a - b)[:3]}; only SQL {sorted(b - a)[:3]}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    import __spark_entry__ as driver
    from modelyard.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    wanted = sys.argv[2:] or list(driver.queries())
    spark, con, oracle = local_session(cpus=8), connect(sf), driver.oracle_sql()
    bad = []
    for name in wanted:
        started = time.time()
        try:
            if name in oracle:
                verdict = compare(spark, con, sf, driver.queries()[name], oracle[name])
                verdict = verdict or "equal"
            else:
                verdict = f"rows {len(driver.queries()[name](spark, sf).collect())}"
        except Exception as problem:
            verdict = f"ERROR {type(problem).__name__}: {str(problem)[:600]}"
        if verdict != "equal" and not verdict.startswith("rows ") or " vs " in verdict:
            bad.append(name)
        print(f"{name:22s} {time.time() - started:6.2f}s {verdict[:900]}", flush=True)
    print("bad:", bad)
