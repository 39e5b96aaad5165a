"""Order-insensitive comparison of a Spark result with a DuckDB result."""

from __future__ import annotations

import math
from collections import Counter


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "__float__") and not isinstance(v, int):  # Decimal
        return round(float(v), 6) + 0.0
    return v


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, Counter(tuple(_norm(r[c]) for c in cols) for r in df.collect())


def rows_of_duck(con, sql):
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    data = rel.fetchall()
    cols = sorted(names)
    idx = [names.index(c) for c in cols]
    return cols, Counter(tuple(_norm(r[i]) for i in idx) for r in data)


def assert_same(spark_df, con, sql, name=""):
    sc, sr = rows_of_spark(spark_df)
    dc, dr = rows_of_duck(con, sql)
    assert sc == dc, f"{name}: columns differ {sc} vs {dc}"
    if sr != dr:
        only_s = list((sr - dr).items())[:5]
        only_d = list((dr - sr).items())[:5]
        raise AssertionError(f"{name}: {sum(sr.values())} vs {sum(dr.values())} rows; "
                             f"spark-only {only_s}; duck-only {only_d}")
