"""Cross-model consistency of explanations: does every model push a feature the
same way, and how important is it across models?

Input: the long SHAP table ``shap(model, row_id, feature, value, phi)``.
Per (model, feature): Spearman correlation of the feature's value with its phi
(direction) and mean |phi| (importance).  Per feature across models: mean
correlation, sign agreement, normalised importance.  The per-model tables have
models x features rows; only ``spearman`` touches the row-level data, and it does
so with distributed ranks (no window over a whole group).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions.exprs import SIGN_TOL, clip01, direction_sign, direction_txt
from tabeval.operators.cumulative import DEFAULT_BUCKETS, avg_rank, prefix_sums
from tabeval.session import materialize as write
from tabeval.session import small_side


HOT_ROWS = 1_000_000            # input rows one join task may take for one value
MAX_HOT_VALUES = 100_000        # hot values listed in a broadcast, by construction


def _salted_join(big: DataFrame, ranks: DataFrame, on: list[str], hot_rows: int) -> DataFrame:
    """Join ``big`` to the rank table on ``on``; a value carried by more than
    ``hot_rows`` rows of ``big`` is spread over ceil(rows / hot_rows) salted tasks
    (its rank row is copied that many times).  ``ranks`` carries the rows per value
    (``_nrows``), so nothing is counted again.  Rank rows counted to be few are broadcast."""
    salts = F.ceil(F.col("_nrows") / F.lit(hot_rows)).cast("int")
    hot = F.broadcast(ranks.where(F.col("_nrows") > hot_rows).select(*on, salts.alias("_s")))
    r = (ranks.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_cnt", "_nrows"))
    # by the row's place: equal rows are spread too
    b = (big.withColumn("_at", F.monotonically_increasing_id()).join(hot, on, "left")
            .withColumn("_salt", F.when(F.col("_s").isNull(), F.lit(0))
                        .otherwise(F.pmod(F.xxhash64("_at"), F.col("_s")).cast("int"))).drop("_s", "_at"))
    return b.join(small_side(r), on + ["_salt"]).drop("_salt")


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str, out_col: str = "spearman_r",
             n_buckets: int = DEFAULT_BUCKETS, levels: int | None = None,
             hot_rows: int = HOT_ROWS) -> DataFrame:
    """Spearman rank correlation of x and y per key group (average ranks for ties).

    NULL when either side is constant (the correlation is undefined); pairs with a
    NULL/NaN side are left out first.  The rank of x is joined to the rows with salting
    for hot values; the rows of one y are then added up before y is ranked, for its rank
    is the same in all of them: sum (rx - m)(ry - m) = sum over y of (ry - m) sum (rx - m),
    m the known mean rank (n+1)/2.  So no row meets the ranks of y, and a constant side has
    exactly zero spread.
    """
    keys = list(keys)
    d = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")) \
          .where(F.col("_x").isNotNull() & F.col("_y").isNotNull() & ~F.isnan("_x") & ~F.isnan("_y"))
    # read by the ranking of x and by the join: computed once
    d = write(d, "pairs")
    # no more values than the broadcast list may hold can pass this many rows
    hot_rows = max(hot_rows, d.count() // MAX_HOT_VALUES)
    rx = write(avg_rank(d, keys, "_x", "_rx", n_buckets, levels), "ranks")
    n = write(rx.groupBy(*keys).agg(F.sum("_cnt").alias("_n")), "rows")   # one row a group, from the rank rows
    m = (F.col("_n") + F.lit(1)) / F.lit(2.0)
    dx = write(rx.join(small_side(n), keys).withColumn("_dx", F.col("_rx") - m).drop("_rx", "_n"), "ranks")
    sx = dx.groupBy(*keys).agg(F.sum(F.col("_cnt") * F.col("_dx") * F.col("_dx")).alias("_sxx"))
    by_y = _salted_join(d, dx, keys + ["_x"], hot_rows).groupBy(*keys, "_y").agg(
        F.count(F.lit(1)).alias("_cnt"), F.sum("_dx").alias("_dx"))
    ry = prefix_sums(write(by_y, "by_y"), keys, "_y", ["_cnt"], descending=False, n_buckets=n_buckets, levels=levels)
    cnt = F.col("_cnt")
    dy = F.col("_cnt_before") + (cnt + F.lit(1)) / F.lit(2.0) - m
    g = ry.join(small_side(n), keys).groupBy(*keys).agg(
        F.sum(dy * F.col("_dx")).alias("_sxy"), F.sum(cnt * dy * dy).alias("_syy"), F.first("_n").alias("n"))
    return g.join(small_side(sx), keys).select(
        *keys, F.try_divide(F.col("_sxy"), F.sqrt(F.col("_sxx") * F.col("_syy"))).alias(out_col), "n")


def shap_direction(shap: DataFrame, tol: float = SIGN_TOL) -> DataFrame:
    """(model, feature, spearman_r, sign): direction of each feature in each model."""
    r = spearman(shap, ["model", "feature"], "value", "phi")
    return r.select("model", "feature", "spearman_r", direction_sign("spearman_r", tol).alias("sign"))


def shap_mean_abs(shap: DataFrame) -> DataFrame:
    """(model, feature, mean_abs_shap)."""
    return shap.groupBy("model", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))


def normalise_importance(mean_abs: DataFrame) -> DataFrame:
    """(model, feature, I_norm): mean |phi| over the model's largest; 0 when that
    maximum is not positive or undefined."""
    mx = F.max("mean_abs_shap").over(Window.partitionBy("model"))
    ok = mx.isNotNull() & ~F.isnan(mx) & (mx > 0)
    return mean_abs.select("model", "feature",
                           F.when(ok, F.col("mean_abs_shap") / mx).otherwise(F.lit(0.0)).alias("I_norm"))


def overall_importance(norm: DataFrame) -> DataFrame:
    """(feature, I_norm): mean normalised importance over models."""
    return norm.groupBy("feature").agg(F.avg("I_norm").alias("I_norm"))


def direction_agreement(direction: DataFrame, tol: float = SIGN_TOL, method: str = "rho") -> DataFrame:
    """Per feature: mean_r, S_abs, S_overall, Q_agree, n_models.

    ``method='rho'`` (the reference's current rule): undefined correlations are
    dropped; mean_r = mean correlation, S_abs = |mean_r|; signs (dead zone ``tol``)
    give S_overall = mean sign, the main direction = sign of S_overall, and
    Q_agree = share of models whose sign equals it (0 without a main direction).
    A feature without any defined correlation is left out.
    ``method='vote'`` (the reference's earlier rule): the stored ``sign`` column of
    every row votes and S_abs = |S_overall|.
    """
    if method == "rho":
        r = F.col("spearman_r")
        d = direction.where(r.isNotNull() & ~F.isnan(r)).withColumn("_s", direction_sign(r, tol))
        g = d.groupBy("feature").agg(F.avg(r).alias("mean_r"), F.avg("_s").alias("S_overall"),
                                     F.count_if(F.col("_s") == 1).alias("_np"),
                                     F.count_if(F.col("_s") == -1).alias("_nn"),
                                     F.count(F.lit(1)).alias("n_models"))
        s_abs = F.abs("mean_r")
    elif method == "vote":
        d = direction.withColumn("_s", F.col("sign").cast("int"))
        g = d.groupBy("feature").agg(F.avg("_s").alias("S_overall"),
                                     F.count_if(F.col("_s") == 1).alias("_np"),
                                     F.count_if(F.col("_s") == -1).alias("_nn"),
                                     F.count(F.lit(1)).alias("n_models"))
        s_abs = F.abs("S_overall")
    else:
        raise ValueError("method must be 'rho' or 'vote'")
    main = F.when(F.col("S_overall") > 0, F.col("_np")).when(F.col("S_overall") < 0, F.col("_nn"))
    q = F.coalesce(main / F.col("n_models"), F.lit(0.0))
    cols = ["feature"] + (["mean_r"] if method == "rho" else [])
    return g.select(*cols, s_abs.alias("S_abs"), "S_overall", q.alias("Q_agree"),
                    F.col("n_models").cast("int").alias("n_models"))


def consistency_table(direction: DataFrame, mean_abs: DataFrame, tol: float = SIGN_TOL) -> DataFrame:
    """The summary: agreement, overall importance, S_abs x Q_agree and the direction text.
    Sorted by I_norm (descending)."""
    agree = direction_agreement(direction, tol)
    imp = overall_importance(normalise_importance(mean_abs))
    t = agree.join(imp, "feature", "left")
    return (t.select("feature", "mean_r", "S_abs", "S_overall", "Q_agree", "n_models", "I_norm",
                     (F.col("S_abs") * F.col("Q_agree")).alias("S_abs_times_Q"),
                     direction_txt("S_overall").alias("direction_txt"))
             .orderBy(F.desc_nulls_last("I_norm"), "feature"))


def consistency(shap: DataFrame, tol: float = SIGN_TOL, materialize: bool = True) -> DataFrame:
    """From the long SHAP table straight to the summary.

    The SHAP table feeds four aggregations (two rank tables, the rank join, mean
    |phi|); with ``materialize`` it is written once to the shared checkpoint folder
    (a reliable checkpoint: it survives lost executors and cuts the lineage) instead
    of re-running the explanation for every consumer.
    """
    if materialize:
        shap = write(shap, "shap")
    return consistency_table(shap_direction(shap, tol), shap_mean_abs(shap), tol)


def radar_frame(table: DataFrame, top_k: int = 8, use_metric: str = "S_abs") -> DataFrame:
    """The data of the radar chart: the top_k features by I_norm with label
    'feature (direction)', angle 2*pi*i/n, bar = clipped I_norm, line = clipped metric."""
    if use_metric not in ("S_abs", "S_abs_times_Q"):
        raise ValueError("use_metric must be 'S_abs' or 'S_abs_times_Q'")
    # the table has one row per feature; the top-k cut is the feature of this view
    top = table.orderBy(F.desc_nulls_last("I_norm"), "feature").limit(top_k)
    i = F.row_number().over(Window.orderBy(F.desc_nulls_last("I_norm"), "feature")) - 1
    n = F.count(F.lit(1)).over(Window.partitionBy())
    return top.select(
        i.alias("position"), "feature",
        F.format_string("%s (%s)", F.col("feature"), F.col("direction_txt")).alias("label"),
        (F.lit(2.0 * math.pi) * i / n).alias("angle"),
        clip01("I_norm").alias("bar"),
        clip01(use_metric).alias("line"))
