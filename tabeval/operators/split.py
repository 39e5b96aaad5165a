"""Exact stratified hold-out split, seeded samples, tagged unions.

Row order for every random choice is ``md5('<seed>:<id>')`` then the id: the same
in Spark and in any SQL engine, and stable under repartitioning.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions.exprs import md5_order
from tabeval.session import materialize, small_side


def _allocation(counts: DataFrame, strata: list[str], test_size: float) -> DataFrame:
    """Training rows per stratum: n_test = ceil(test_size*n) overall, the training
    share n - n_test spread over strata by largest remainder (ties: stratum order).

    ``counts`` has one row per stratum, so the windows here see only that table.
    """
    w_all = Window.partitionBy()
    n = F.sum("_c").over(w_all)
    n_train = n - F.ceil(F.lit(float(test_size)) * n)
    cont = n_train.cast("double") * F.col("_c") / n.cast("double")
    a = counts.select(*strata, "_c", n_train.alias("_n_train"), cont.alias("_cont"))
    a = a.withColumn("_floor", F.floor("_cont").cast("long"))
    a = a.withColumn("_need", F.col("_n_train") - F.sum("_floor").over(w_all))
    a = a.withColumn("_rk", F.row_number().over(
        Window.orderBy(F.desc(F.col("_cont") - F.col("_floor")), *[F.col(s).asc_nulls_first() for s in strata])))
    return a.select(*strata, "_c", (F.col("_floor") + F.when(F.col("_rk") <= F.col("_need"), 1).otherwise(0))
                    .alias("_train_n"))


def stratified_split(df: DataFrame, strata: str | Sequence[str], test_size: float = 0.3, seed: int = 2025,
                     id_col: str = "row_id", hex_digits: int = 4, out_col: str = "split") -> DataFrame:
    """Adds ``split`` = 'train' / 'test' with exact sizes per stratum.

    Within a stratum the first ``train_n`` rows in md5 order are training rows.  The
    order is cut into 16**hex_digits ranges by the leading hex digits of the key;
    counts per (stratum, range) locate the one range holding the cut, and only the
    rows of that range are ranked.
    """
    strata = [strata] if isinstance(strata, str) else list(strata)
    key = md5_order(seed, id_col)
    x = (df.withColumn("_key", key)
           .withColumn("_b", F.conv(F.substring("_key", 1, hex_digits), 16, 10).cast("long")))
    bc = x.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_bc"))
    # stratum sizes are sums of the range counts: no second pass over the rows
    bc = materialize(bc, "strata")
    alloc = _allocation(bc.groupBy(*strata).agg(F.sum("_bc").alias("_c")), strata, test_size)
    cols = df.columns + [out_col]
    wb = Window.partitionBy(*strata).orderBy("_b")
    bc = bc.withColumn("_before", F.coalesce(F.sum("_bc").over(wb.rowsBetween(Window.unboundedPreceding, -1)),
                                             F.lit(0)))
    cut = (bc.join(alloc.select(*[F.col(s).alias(f"_a_{s}") for s in strata], "_train_n"),
                   [F.col(s).eqNullSafe(F.col(f"_a_{s}")) for s in strata], "inner")
             .where((F.col("_before") < F.col("_train_n")) & (F.col("_train_n") <= F.col("_before") + F.col("_bc")))
             .select(*strata, F.col("_b").alias("_cut"), (F.col("_train_n") - F.col("_before")).alias("_need")))
    # one row per stratum (none when the stratum gets no training row): written once, counted,
    # and broadcast, so the rows are never dealt out by the few strata
    cut = small_side(materialize(cut, "cut"))
    cut = cut.select(*[F.col(s).alias(f"_s_{s}") for s in strata], "_cut", "_need")
    same = F.lit(True)
    for s in strata:
        same = same & x[s].eqNullSafe(cut[f"_s_{s}"])
    y = x.join(cut, same, "left")
    is_cut = F.col("_b") == F.col("_cut")
    simple = (y.where(F.col("_cut").isNull() | ~is_cut)
                .withColumn(out_col, F.when(F.col("_cut").isNotNull() & (F.col("_b") < F.col("_cut")), "train")
                            .otherwise("test")))
    ranked = (y.where(is_cut)
                .withColumn("_rn", F.row_number().over(Window.partitionBy(*strata).orderBy("_key", id_col)))
                .withColumn(out_col, F.when(F.col("_rn") <= F.col("_need"), "train").otherwise("test")))
    return simple.select(*cols).unionByName(ranked.select(*cols))


def split_sizes(split_df: DataFrame, strata: str | Sequence[str], out_col: str = "split") -> DataFrame:
    strata = [strata] if isinstance(strata, str) else list(strata)
    return split_df.groupBy(out_col, *strata).agg(F.count(F.lit(1)).alias("n"))


def sample_n(df: DataFrame, n: int, seed: int = 2025, id_col: str = "row_id") -> DataFrame:
    """min(n, rows) rows without replacement, seeded: the first n in md5 order.

    A top-n (TakeOrderedAndProject): each partition keeps n candidates, so the
    driver-side merge holds n x partitions keys at most; n is the sample size."""
    return df.orderBy(md5_order(seed, id_col), F.col(id_col)).limit(n)


def tag(df: DataFrame, name: str, value) -> DataFrame:
    """Add a constant tag column (e.g. group = 'train_set')."""
    return df.withColumn(name, F.lit(value))


def union_tagged(parts: dict[str, DataFrame], tag_col: str = "dataset") -> DataFrame:
    """UNION ALL of several frames, each tagged; (tag, row id) identifies a row."""
    out = None
    for name, d in parts.items():
        t = tag(d, tag_col, name)
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def compare_params(a: DataFrame, b: DataFrame, key: str = "param", suffixes=("_default", "_tuned")) -> DataFrame:
    """Side-by-side table of two keyed tables (full outer join on ``key``)."""
    ra = a.select(key, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c != key])
    rb = b.select(key, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c != key])
    return ra.join(rb, key, "full")
