"""Ordered running sums without a one-task window.

``Window.partitionBy(keys).orderBy(x)`` sends every row of a key group to one
task.  When the groups are few and large (one model scored on billions of rows)
that task holds the whole group.  Here the order is cut into ranges first:

1. range bounds per key group from ``percentile_approx`` (small: groups x buckets),
   nested when a group is so large that a range would still be too big;
2. each row gets the range it falls in (equal values always share a range);
3. per-range totals are summed in order over the small range table;
4. the window runs inside (keys, range) and the offset of earlier ranges is added.

The result equals the plain window exactly; only the work is spread.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabeval.session import materialize

DEFAULT_BUCKETS = 64
SMALL_BOUNDS = 100_000          # rows of a bounds or totals table that may be broadcast
TARGET_RANGE_ROWS = 2_000_000   # rows per (key, range) the window may hold


def _shape(df: DataFrame, keys: Sequence[str], n_buckets: int, target: int) -> tuple[int, int]:
    """(nested range cuts that keep the largest key group under ``target`` rows per range,
    number of key groups); at least one cut, whatever the size."""
    g = df.groupBy(*keys).count() if keys else df.select(F.count(F.lit(1)).alias("count"))
    r = g.agg(F.max("count"), F.count(F.lit(1))).first()   # two numbers
    levels = 1
    while (r[0] or 0) > target * n_buckets ** levels:
        levels += 1
    return levels, r[1]


def _bucketed(df: DataFrame, keys: Sequence[str], order_col: str, n_buckets: int,
              accuracy: int, levels: int, groups: int) -> DataFrame:
    """Add ``_bucket``: the index of the value's range, monotone in the value within
    each key group; equal values always share it.  With ``levels`` > 1 every range is
    cut again by its own bounds (n_buckets ** levels ranges in all)."""
    pcts = [i / n_buckets for i in range(1, n_buckets)]
    if not pcts:
        return df.withColumn("_bucket", F.lit(0))
    o = F.col(order_col).cast("double")
    x = df
    parts = []
    for lvl in range(levels):
        gkeys = list(keys) + parts
        name = f"_b{lvl}"
        if gkeys:
            # one bounds array per (key, parent range): groups x n_buckets ** lvl rows
            bounds = x.groupBy(*gkeys).agg(F.percentile_approx(o, pcts, accuracy).alias("_bounds"))
            # its row count is known: groups x ranges so far
            few = groups * n_buckets ** lvl <= SMALL_BOUNDS
            x = x.join(F.broadcast(bounds) if few else bounds, gkeys, "left")
        else:
            # one bounds array for the whole table: a scalar subquery, not a join
            x = x.withColumn("_bounds", x.select(F.percentile_approx(o, pcts, accuracy)).scalar())
        x = x.withColumn("_above", _block(o, len(pcts))).withColumn(name, _place(o, len(pcts))).drop("_bounds", "_above")
        parts.append(name)
    idx = F.lit(0)
    for name in parts:
        idx = idx * F.lit(n_buckets) + F.col(name)
    return x.withColumn("_bucket", idx.cast("long")).drop(*parts)


def _below(i: Column | int, o: Column) -> Column:
    return F.coalesce(F.get("_bounds", i if isinstance(i, Column) else F.lit(i)) < o, F.lit(False)).cast("int")


def _block(o: Column, n: int) -> Column:
    """How many whole blocks of about sqrt(n) sorted bounds lie below the value; compiled, unlike a
    lambda over all of them."""
    step = math.isqrt(n - 1) + 1
    return sum((_below(i, o) for i in range(step - 1, n, step)), F.lit(0))


def _place(o: Column, n: int) -> Column:
    """How many of the n bounds lie below the value, given ``_above``: only its own block is compared."""
    first = F.col("_above") * F.lit(math.isqrt(n - 1) + 1)
    return sum((_below(first + F.lit(i), o) for i in range(math.isqrt(n - 1))), first)


def prefix_sums(df: DataFrame, keys: Sequence[str], order_col: str, value_cols: Sequence[str],
                descending: bool = True, lead_cols: Sequence[str] = (),
                n_buckets: int = DEFAULT_BUCKETS, accuracy: int = 1000, levels: int | None = None,
                target_rows: int | None = None) -> DataFrame:
    """Add ``<v>_before`` = sum of ``v`` over rows of the same ``keys`` strictly earlier
    in the order of ``order_col``, and ``<c>_next`` = ``c`` of the next row.

    Rows must be unique on ``keys + [order_col]`` (aggregate to distinct values first).
    ``levels`` of nested range cuts: by default as many as keep the largest key
    group under ``target_rows`` rows per range, and at least one.
    """
    keys = list(keys)
    value_cols = list(value_cols)
    lead_cols = list(lead_cols)
    base_cols = df.columns
    needed, groups = _shape(df, keys, n_buckets, target_rows or TARGET_RANGE_ROWS)
    levels = levels or needed
    x = _bucketed(df, keys, order_col, n_buckets, accuracy, levels, groups)
    o = F.col(order_col)
    ob = F.col("_bucket")
    row_order = o.desc() if descending else o.asc()
    bucket_order = ob.desc() if descending else ob.asc()

    # per-range totals and the first row of each range: groups x ranges rows
    tot = x.groupBy(*keys, "_bucket").agg(
        *[F.sum(v).alias(f"_bt_{v}") for v in value_cols],
        *[(F.max_by(F.col(c), o) if descending else F.min_by(F.col(c), o)).alias(f"_first_{c}")
          for c in lead_cols])
    wb = Window.partitionBy(*keys).orderBy(bucket_order)
    tot = tot.select(
        *keys, "_bucket",
        *[F.coalesce(F.sum(f"_bt_{v}").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_off_{v}") for v in value_cols],
        *[F.lead(f"_first_{c}").over(wb).alias(f"_nextb_{c}") for c in lead_cols])

    wr = Window.partitionBy(*keys, "_bucket").orderBy(row_order)
    y = x.select(
        *base_cols, "_bucket",
        *[F.coalesce(F.sum(v).over(wr.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0)).alias(f"_in_{v}") for v in value_cols],
        *[F.lead(c).over(wr).alias(f"_lead_{c}") for c in lead_cols],
        *([F.lead(F.lit(1)).over(wr).isNull().alias("_is_last")] if lead_cols else []))
    few = groups * n_buckets ** levels <= SMALL_BOUNDS
    out = y.join(F.broadcast(tot) if few else tot, keys + ["_bucket"], "left")
    return out.select(
        *base_cols,
        *[(F.col(f"_in_{v}") + F.col(f"_off_{v}")).alias(f"{v}_before") for v in value_cols],
        *[F.when(F.col("_is_last"), F.col(f"_nextb_{c}")).otherwise(F.col(f"_lead_{c}")).alias(f"{c}_next")
          for c in lead_cols])


def avg_rank(df: DataFrame, keys: Sequence[str], value_col: str, out_col: str = "rank",
             n_buckets: int = DEFAULT_BUCKETS, levels: int | None = None,
             weight_col: str | None = None) -> DataFrame:
    """Ascending rank of ``value_col`` within ``keys``, ties averaged (1-based), NULL kept NULL.

    Returns one row per distinct (keys, value) with ``_cnt`` (rows, or summed
    ``weight_col`` when rows stand for several) and ``_nrows`` (input rows): join it
    back where needed.
    """
    keys = list(keys)
    w = F.col(weight_col) if weight_col else F.lit(1)
    # counted, cut into ranges and summed: grouped once
    d = materialize(df.where(F.col(value_col).isNotNull())
                    .groupBy(*keys, value_col).agg(F.sum(w).alias("_cnt"), F.count(F.lit(1)).alias("_nrows")), "values")
    c = prefix_sums(d, keys, value_col, ["_cnt"], descending=False, n_buckets=n_buckets, levels=levels)
    return c.select(*keys, value_col, "_cnt", "_nrows",
                    (F.col("_cnt_before") + (F.col("_cnt") + F.lit(1)) / F.lit(2.0)).alias(out_col))
