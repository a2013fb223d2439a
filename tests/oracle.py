"""Compare registered queries with their SQL in DuckDB: ``python -m tests.oracle [pattern] [folder]``."""

from __future__ import annotations

import re
import sys
import time
import traceback

import duckdb
import numpy as np
import pandas as pd

from strayfield.plans.registry import all_queries, all_sql
from strayfield.session import local_session
from strayfield.sources.tables import BASE_TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in BASE_TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def canon(value):
    if value is None or (isinstance(value, float) and np.isnan(value)):
        return None
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(canon(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, canon(v)) for k, v in sorted(value.items()))
    if hasattr(value, "asDict"):
        return canon(value.asDict())
    if isinstance(value, (bool, np.bool_)):
        return bool(value)
    if isinstance(value, (int, np.integer)):
        return float(value)
    if isinstance(value, (float, np.floating)):
        return round(float(value), 5) + 0.0
    return str(value)


def rows(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    return sorted((tuple(canon(v) for v in r) for r in pdf[cols].itertuples(index=False)), key=repr)


def compare(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} vs {sorted(want.columns)}"
    for c in want.columns:
        for side, pdf in (("spark", got), ("sql", want)):
            v = pdf[c].dropna()
            if len(v) and type(v.iloc[0]).__name__ == "Decimal":
                return f"decimal column {c} in {side}"
        kinds = {pdf[c].dtype.kind for pdf in (got, want)}
        if kinds in ({"i", "f"}, {"b", "i"}) and not got[c].isna().any():
            return f"type of {c}: {got[c].dtype} vs {want[c].dtype}"
    a, b = rows(got), rows(want)
    if len(a) != len(b):
        return f"{len(a)} rows vs {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} of {len(a)} rows differ: {str(bad[0])[:600]}" if bad else None


def main(pattern: str = ".", folder: str = "/root/testdata/sf0.01") -> int:
    spark, con, failed = local_session(), connect(folder), []
    sqls = all_sql()
    for name, run in all_queries().items():
        if not re.search(pattern, name):
            continue
        start = time.time()
        try:
            got = run(spark, folder).toPandas()
            took = time.time() - start
            start = time.time()
            problem = compare(got, con.execute(sqls[name]).df()) if name in sqls else None
            status = problem or ("ok" if name in sqls else "rows only")
            if not len(got):
                status += " EMPTY"
        except Exception as e:  # noqa: BLE001
            took, problem = time.time() - start, str(e).split('\n')[0][:400]
            status = "ERROR " + problem
            if "-v" in sys.argv:
                traceback.print_exc()
        print(f"{name:34s} {took:6.2f}s {time.time() - start:6.2f}s  {len(got) if 'got' in dir() else 0:6d}  {status}", flush=True)
        if problem:
            failed.append(name)
    print("failed:", failed)
    return len(failed)


if __name__ == "__main__":
    args = [a for a in sys.argv[1:] if not a.startswith("-")]
    sys.exit(1 if main(*args) else 0)
