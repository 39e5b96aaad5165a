"""Profiling: frequencies, missing counts, schema summary, histogram, box statistics,
exact quantiles and Tukey fences.

Global statistics (a total, a min/max, a fence) enter later expressions as scalar
subqueries (``DataFrame.scalar()``): they stay in the plan, run as one small job
each, and need neither a driver round-trip nor a join against a one-row table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.functions.exprs import count_points_below, grid_point, missing, ratio
from tabeval.operators.cumulative import DEFAULT_BUCKETS, prefix_sums
from tabeval.session import checkpoint_dir, materialize


def value_counts(df: DataFrame, column: str, normalize: bool = False, sort: bool = True) -> DataFrame:
    """Frequency of each non-NULL value (``count``), and with ``normalize`` its share
    of the non-NULL rows (``freq``)."""
    g = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("count"))
    if normalize:
        total = df.select(F.count(column)).scalar()
        g = g.withColumn("freq", ratio("count", total))
    return g.orderBy(F.desc("count"), column) if sort else g


def missing_counts(df: DataFrame) -> DataFrame:
    """(variable, n_missing) for every column, in one pass."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(*aggs)
    return wide.unpivot([], df.columns, "variable", "n_missing")


def schema_profile(df: DataFrame) -> DataFrame:
    """(position, variable, dtype, non_null, n_rows): what ``DataFrame.info`` prints."""
    wide = df.agg(F.count(F.lit(1)).alias("__n_rows"), *[F.count(c).alias(c) for c in df.columns])
    long = wide.unpivot(["__n_rows"], df.columns, "variable", "non_null")
    types = df.sparkSession.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema.fields)],
        "position INT, variable STRING, dtype STRING")
    # the schema table has one row per column of df: bounded by the schema itself
    return (F.broadcast(types).join(long, "variable")
            .select("position", "variable", "dtype", "non_null", F.col("__n_rows").alias("n_rows")))


def histogram(df: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram over [min, max] (numpy rules: bin i holds
    edge_i <= x < edge_i+1, the last bin is closed; empty bins kept)."""
    x = F.col(column).cast("double")
    stats = df.select(F.min(x).alias("lo"), F.max(x).alias("hi"))
    lo0 = stats.select("lo").scalar()
    hi0 = stats.select("hi").scalar()
    lo = F.when(lo0 == hi0, lo0 - F.lit(0.5)).otherwise(lo0)
    hi = F.when(lo0 == hi0, hi0 + F.lit(0.5)).otherwise(hi0)
    step = (hi - lo) / F.lit(float(bins))
    # edges_k = k*step + lo (k = 0..bins, last = hi); bin = (# edges <= x) - 1, clamped
    le = count_points_below(x, lo, step, bins + 1, hi, strict=False)
    b = F.least(F.greatest(le - F.lit(1), F.lit(0)), F.lit(bins - 1))
    counts = df.where(x.isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spark = df.sparkSession
    grid = spark.range(bins).select(F.col("id").cast("int").alias("bin"))
    return (grid.join(counts, "bin", "left")
            .select("bin", grid_point("bin", lo, step, bins + 1, hi).alias("lo"),
                    grid_point(F.col("bin") + 1, lo, step, bins + 1, hi).alias("hi"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def _long(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(variable, value DOUBLE) for the given columns, NULLs dropped."""
    u = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"))
                                      for c in columns])).alias("_u")).select("_u.variable", "_u.value")
    return u.where(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles(df: DataFrame, columns: Sequence[str], qs: Sequence[float] = (0.25, 0.5, 0.75),
              exact: bool = True, accuracy: int = 10000, n_buckets: int = DEFAULT_BUCKETS,
              levels: int | None = None) -> DataFrame:
    """(variable, q, value): linear-interpolation quantiles (numpy/pandas 'linear').

    Exact mode never gathers a column in one task: values are counted, ranked by
    range-cut prefix sums, and the two order statistics around (n-1)*q are picked
    by a broadcast join against the (column, q) target table, whose size is the
    caller's parameters.  ``exact=False`` uses ``percentile_approx``.
    """
    columns = list(columns)
    long = _long(df, columns)
    if not exact:
        return (long.groupBy("variable").agg(F.percentile_approx("value", list(qs), accuracy).alias("_v"))
                .select("variable", F.posexplode("_v").alias("_i", "value"))
                .withColumn("q", F.element_at(F.array(*[F.lit(float(q)) for q in qs]), F.col("_i") + 1))
                .select("variable", "q", "value"))
    d = long.groupBy("variable", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # the value counts feed bounds, range totals, ordered sums and n: written once
    checkpoint_dir(df.sparkSession)
    d = d.checkpoint(eager=True)
    c = prefix_sums(d, ["variable"], "value", ["cnt"], descending=False, n_buckets=n_buckets, levels=levels)
    n = d.groupBy("variable").agg(F.sum("cnt").alias("n"))
    h = (F.col("n") - F.lit(1)).cast("double") * F.col("q")
    targets = (n.select(F.col("variable").alias("_tcol"), "n", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q"))
               .withColumn("h", h)
               .select("_tcol", "q", "h", F.explode(F.array(
                   F.struct(F.lit("lo").alias("side"), F.floor("h").cast("long").alias("rank")),
                   F.struct(F.lit("hi").alias("side"), F.ceil("h").cast("long").alias("rank")))).alias("_t"))
               .select("_tcol", "q", "h", "_t.side", "_t.rank"))
    hit = c.join(F.broadcast(targets),
                 (c["variable"] == targets["_tcol"]) & (c["cnt_before"] <= targets["rank"])
                 & (targets["rank"] < c["cnt_before"] + c["cnt"]))
    g = hit.groupBy("variable", "q", "h").agg(
        F.max(F.when(F.col("side") == "lo", F.col("value"))).alias("_lo"),
        F.max(F.when(F.col("side") == "hi", F.col("value"))).alias("_hi"))
    frac = F.col("h") - F.floor("h")
    return g.select("variable", "q", (F.col("_lo") + frac * (F.col("_hi") - F.col("_lo"))).alias("value"))


def iqr_fences(df: DataFrame, columns: Sequence[str], k: float = 1.5, exact: bool = True) -> DataFrame:
    """(variable, q1, q3, iqr, lower, upper): Tukey fences, all columns in one plan."""
    q = quantiles(df, columns, (0.25, 0.75), exact=exact)
    w = q.groupBy("variable").agg(F.max(F.when(F.col("q") == 0.25, F.col("value"))).alias("q1"),
                                F.max(F.when(F.col("q") == 0.75, F.col("value"))).alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    return w.select("variable", "q1", "q3", iqr.alias("iqr"),
                    (F.col("q1") - F.lit(k) * iqr).alias("lower"), (F.col("q3") + F.lit(k) * iqr).alias("upper"))


def _fence(df: DataFrame, column: str, k: float, exact: bool):
    f = materialize(iqr_fences(df, [column], k, exact), "fences")   # one row, ranked once
    return f.select("lower").scalar(), f.select("upper").scalar()


def outside(c, lo, hi):
    """Range predicate with OR: c < lo or c > hi."""
    c = F.col(c) if isinstance(c, str) else c
    return (c < lo) | (c > hi)


def iqr_outliers(df: DataFrame, column: str, k: float = 1.5, exact: bool = True) -> DataFrame:
    """Rows whose ``column`` lies outside the Tukey fences."""
    lo, hi = _fence(df, column, k, exact)
    return df.where(outside(F.col(column).cast("double"), lo, hi))


def drop_last_digit(c):
    """The reference's stated repair rule for a mistyped reading (1188 -> 118)."""
    return F.floor(c / F.lit(10))


def iqr_repair(df: DataFrame, column: str, k: float = 1.5, rule=drop_last_digit,
               overrides: DataFrame | None = None, id_col: str = "row_id", exact: bool = True) -> DataFrame:
    """Overwrite flagged cells: ``rule(x)`` for values outside the fences, or the
    value from ``overrides(id_col, value)`` where one is given for the row.  A repeated id
    counts once; with different values it stops the job."""
    lo, hi = _fence(df, column, k, exact)
    x = F.col(column)
    flagged = outside(x.cast("double"), lo, hi)
    repaired = F.when(flagged, rule(x).cast(df.schema[column].dataType)).otherwise(x)
    out = df.withColumn(column, repaired)
    if overrides is not None:
        o = overrides.groupBy(id_col).agg(F.min("value").alias("_override"), F.max("value").alias("_other"))
        o = o.select(id_col, F.when(F.col("_override").eqNullSafe(F.col("_other")), F.col("_override")).otherwise(
            F.raise_error(F.lit("several overrides for one row"))).alias("_override"))
        out = (out.join(o, id_col, "left")
               .withColumn(column, F.coalesce(F.col("_override").cast(df.schema[column].dataType), F.col(column)))
               .drop("_override"))
    return out.select(*df.columns)


def box_stats(df: DataFrame, column: str, whis: float = 1.5) -> DataFrame:
    """One row: q1, median, q3, iqr, whisker_lo / whisker_hi (the extreme data points
    within whis*IQR of the box), n_fliers, n."""
    q = quantiles(df, [column], (0.25, 0.5, 0.75))
    at = [F.max(F.when(F.col("q") == v, F.col("value"))).alias(n) for v, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))]
    box = q.agg(*at).withColumn("iqr", F.col("q3") - F.col("q1"))   # one row
    x = F.col(column).cast("double")
    d = df.select(x.alias("x")).where(~missing("x")).crossJoin(F.broadcast(box))
    lo, hi = F.col("q1") - F.lit(whis) * F.col("iqr"), F.col("q3") + F.lit(whis) * F.col("iqr")
    # a value beyond a fence is beyond the whisker too, and no other is: one pass counts the fliers
    return d.groupBy("q1", "median", "q3", "iqr").agg(
        F.min(F.when(F.col("x") >= lo, F.col("x"))).alias("whisker_lo"),
        F.max(F.when(F.col("x") <= hi, F.col("x"))).alias("whisker_hi"),
        F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("n_fliers"), F.count(F.lit(1)).alias("n"))


def head(df: DataFrame, n: int = 5, order_by: str | Sequence[str] = "row_id") -> DataFrame:
    """First n rows by the row id (the limit is the feature)."""
    cols = [order_by] if isinstance(order_by, str) else list(order_by)
    return df.orderBy(*cols).limit(n)


def half_even(c, scale: int = 0):
    """pandas/numpy ``round``: half to even."""
    return F.bround(F.col(c) if isinstance(c, str) else c, scale)
