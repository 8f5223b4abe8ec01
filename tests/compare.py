"""Side-by-side check of a Spark query and its DuckDB SQL."""

import decimal
import math
from collections import Counter

import duckdb

from twinledger.fixtures import TABLES


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _cell(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.12g}"
    return repr(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_cell(r[i]) for i in order) for r in rows)


def difference(df, con, sql):
    """None if equal, else a text saying what differs."""
    got_cols = df.columns
    result = con.execute(sql)
    want_cols = [d[0] for d in result.description]
    if sorted(got_cols) != sorted(want_cols):
        return f"columns {sorted(got_cols)} vs {sorted(want_cols)}"
    want = rows_of(want_cols, result.fetchall())
    got = rows_of(got_cols, [tuple(r) for r in df.collect()])
    if got == want:
        return None
    return (f"{sum(got.values())} rows vs {sum(want.values())}; only here {list((got - want).items())[:3]}; "
            f"only there {list((want - got).items())[:3]}")
