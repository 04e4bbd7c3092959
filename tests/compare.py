"""Results of a query and of its SQL as sorted rows that can be compared."""

from __future__ import annotations

import duckdb
import numpy as np
import pandas as pd

from mailsieve.session import TABLES


def connection(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)):
        return "NULL"
    if isinstance(x, (list, np.ndarray)):
        return str([plain(y) for y in x])
    if isinstance(x, (bool, np.bool_)):
        return str(bool(x))
    if isinstance(x, (int, float, np.integer, np.floating)) or type(x).__name__ == "Decimal":
        return f"{float(x):.9g}"
    return str(x)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def differs(frame, con, sql: str) -> str:
    got, want = frame.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows(got), rows(want)
    return "" if a == b else f"{len(a)} and {len(b)} rows: {[(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]}"
