"""Runs registered queries next to their SQL and compares rows."""

from __future__ import annotations

import glob
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import oracle_sql, queries  # noqa: E402


def database(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def canonical(rows: list[tuple]) -> list[str]:
    def text(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
        return repr(v)

    return sorted("\t".join(text(v) for v in row) for row in rows)


def compare(spark, con, name: str, sf: str) -> str:
    """Empty if both sides agree, else what differs."""
    found = queries()[name](spark, sf)
    names = sorted(found.columns)
    mine = [tuple(r) for r in found.select(*[f"`{n}`" for n in names]).collect()]
    expected = con.execute(oracle_sql()[name])
    theirs_names = [d[0] for d in expected.description]
    if sorted(theirs_names) != names:
        return f"columns {names} against {sorted(theirs_names)}"
    order = [theirs_names.index(n) for n in names]
    theirs = [tuple(row[i] for i in order) for row in expected.fetchall()]
    left, right = canonical(mine), canonical(theirs)
    if left == right:
        return ""
    odd = [(a[:300], b[:300]) for a, b in zip(left, right) if a != b][:2]
    return f"{len(left)} rows against {len(right)}: {odd}"


if __name__ == "__main__":
    from corpuscape.runtime import local_session

    sf = sys.argv[1]
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = database(sf)
    chosen = sys.argv[2:] or list(queries())
    for name in chosen:
        start = time.time()
        try:
            if name in oracle_sql():
                problem = compare(spark, con, name, sf)
                state = "ok" if not problem else "DIFFERS " + problem
            else:
                state = f"rows only {queries()[name](spark, sf).count()}"
        except Exception as error:  # report and go on
            state = "ERROR " + str(error)[:600]
        print(f"{time.time() - start:6.1f}s {name}: {state}", flush=True)
