"""Run a registered query and its SQL oracle side by side.

``python tests/compare.py SF_DIR [key ...]`` prints one line per key.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(value):
    if value is None:
        return "\0null"
    if isinstance(value, float):
        return "\0null" if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def canonical(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(row[i]) for i in order) for row in rows)


def compare(spark, con, sf_dir: str, fn, sql: str | None) -> str:
    """Empty string when equal, else a description of the difference."""
    frame = fn(spark, sf_dir)
    got = [tuple(r) for r in frame.collect()]
    if sql is None:
        return "" if got else "no rows"
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    want = cursor.fetchall()
    if sorted(names) != sorted(frame.columns):
        return f"columns {sorted(frame.columns)} != {sorted(names)}"
    mine, theirs = canonical(got, frame.columns), canonical(want, names)
    if mine == theirs:
        return "" if mine else "both empty"
    a, b = set(mine), set(theirs)
    return (
        f"rows {len(mine)} vs {len(theirs)}\n   spark only {sorted(a - b)[:3]}\n   sql only "
        f"{sorted(b - a)[:3]}\n   order {sorted(names)}"
    )


def main() -> int:
    import __spark_entry__ as entry
    from karvan.session import local_session

    sf_dir, keys = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = [k for k in queries if not keys or any(k == w or k.startswith(w.rstrip("*")) and w.endswith("*") for w in keys)]
    bad = 0
    for name in names:
        start = time.time()
        try:
            problem = compare(spark, con, sf_dir, queries[name], oracles.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:700]}"
        bad += bool(problem)
        mark = "ok  " if not problem else "FAIL"
        note = "" if name in oracles else " (rows only)"
        print(f"{mark} {name}{note} {time.time() - start:.1f}s {problem}", flush=True)
    print(f"{len(names) - bad} of {len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
