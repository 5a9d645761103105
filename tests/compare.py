"""Run registered queries beside their SQL and compare whole results.

``python -m tests.compare [names...]`` checks at sf0.01 (or $SF_DIR).
"""

from __future__ import annotations

import os
import sys
import time

import duckdb
import pandas as pd

from ambry.plans import ORACLES, QUERIES
from ambry.session import local_session
from ambry.tables import NAMES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.01")


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in NAMES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def canonical(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    rows = []
    for row in frame.itertuples(index=False):
        rows.append(tuple(_plain(v) for v in row))
    return sorted(rows, key=repr)


def _plain(value):
    if value is None or (isinstance(value, float) and value != value) or value is pd.NaT or value is pd.NA:
        return None
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, float):
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, pd.Timestamp):
        return value.isoformat()
    return value


def kinds(frame: pd.DataFrame) -> dict[str, str]:
    return {c: str(frame[c].dtype) for c in sorted(frame.columns)}


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    begun = time.time()
    got = QUERIES[name](spark, sf_dir).toPandas()
    took = time.time() - begun
    if name not in ORACLES:
        return True, f"{len(got)} rows, no SQL, {took:.1f}s"
    want = con.execute(ORACLES[name]).df()
    sql_took = time.time() - begun - took
    note = f"{len(got)} rows, spark {took:.1f}s, sql {sql_took:.1f}s"
    if sorted(got.columns) != sorted(want.columns):
        return False, f"{note}; columns {sorted(got.columns)} != {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if a != b:
        in_a, in_b = set(a), set(b)
        only_a = [r for r in a if r not in in_b][:3]
        only_b = [r for r in b if r not in in_a][:3]
        return False, f"{note}; sql {len(b)} rows; spark only {only_a}; sql only {only_b}"
    ka, kb = kinds(got), kinds(want)
    differ = {c: (ka[c], kb[c]) for c in ka if ka[c] != kb[c]}
    return True, note + (f"; types {differ}" if differ else "") + ("; EMPTY" if not a else "")


def main(names: list[str]) -> int:
    spark, con = local_session("compare"), duck(SF_DIR)
    failed = []
    for name in names or list(QUERIES):
        try:
            ok, note = compare(spark, con, name, SF_DIR)
        except Exception as error:  # report and go on to the next query
            ok, note = False, f"{type(error).__name__}: {str(error)[:1500]}"
        print(("ok   " if ok else "FAIL ") + f"{name}: {note}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(failed)} failed {failed}")
    return len(failed)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
