"""Evaluation of any number of models in one pass over a long ``scored`` table.

``scored(dataset, model, row_id, y INT, p DOUBLE)``: one row per (dataset, model, row).
Every operator groups by the key columns (default ``dataset, model``), so all
models and datasets are evaluated by the same job, with partial (map-side)
aggregation before each shuffle.  Only the cumulative steps need more than a
plain ``groupBy``; they use the range-cut prefix sums of ``cumulative``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions.exprs import Z_975, classify, count_points_below, grid_point, missing, ratio, required
from tabeval.operators.cumulative import DEFAULT_BUCKETS, prefix_sums
from tabeval.session import checkpoint_dir, small_side

KEYS = ("dataset", "model")


def checked(scored: DataFrame, on_missing: str = "error") -> DataFrame:
    """The scored rows with a label and a score.  A NULL or NaN label or score stops the
    job by default; ``"drop"`` leaves such rows out (:func:`score_audit` counts them)."""
    if on_missing == "error":
        return scored.withColumns({"p": required("p", "p"), "y": required("y", "y").cast("int")})
    if on_missing == "drop":
        return scored.where(~(missing("p") | missing("y")))
    raise ValueError("on_missing must be 'error' or 'drop'")


def score_audit(scored: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows in, with label and score, and without, per key group."""
    return scored.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_in"), F.count_if(~(missing("p") | missing("y"))).alias("n_used"),
        F.count_if(missing("p") | missing("y")).alias("n_refused"))


def confusion(scored: DataFrame, cut: float = 0.5, keys: Sequence[str] = KEYS, on_missing: str = "error") -> DataFrame:
    """tn, fp, fn, tp per key group; class = ``p >= cut``."""
    scored = checked(scored, on_missing)
    yhat = classify("p", cut)
    y = F.col("y")
    return scored.groupBy(*keys).agg(
        F.count_if((y == 0) & (yhat == 0)).alias("tn"),
        F.count_if((y == 0) & (yhat == 1)).alias("fp"),
        F.count_if((y == 1) & (yhat == 0)).alias("fn"),
        F.count_if((y == 1) & (yhat == 1)).alias("tp"))


def class_metrics(conf: DataFrame) -> DataFrame:
    """Accuracy, precision, sensitivity, F1, specificity from confusion counts.

    A ratio with a zero denominator is NULL (numpy gave nan)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    precision = ratio(tp, tp + fp)
    sensitivity = ratio(tp, tp + fn)
    return conf.select(
        *[c for c in conf.columns],
        ratio(tp + tn, tp + fn + tn + fp).alias("accuracy"),
        precision.alias("precision"),
        sensitivity.alias("sensitivity"),
        F.try_divide(F.lit(2.0) * precision * sensitivity, precision + sensitivity).alias("f1"),
        ratio(tn, tn + fp).alias("specificity"))


def score_counts(scored: DataFrame, keys: Sequence[str] = KEYS, materialize: bool = True,
                 on_missing: str = "error") -> DataFrame:
    """Positives and negatives per distinct score: the input of every curve and metric.

    One scan of ``scored`` with map-side partial aggregation.  The result feeds
    several consumers (range bounds, range totals, the ordered sums, the totals),
    so by default it is written once to the shared checkpoint folder: the large
    input is read once, and a lost executor does not send the job back to it.
    """
    c = checked(scored, on_missing).groupBy(*keys, "p").agg(
        F.count_if(F.col("y") == 1).alias("pos"),
        F.count_if(F.col("y") == 0).alias("neg"))
    if materialize:
        checkpoint_dir(scored.sparkSession)
        c = c.checkpoint(eager=True)
    return c


def confusion_from_counts(counts: DataFrame, cut: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """``confusion`` computed from the distinct-score counts."""
    hi = F.col("p") >= F.lit(cut)
    return counts.groupBy(*keys).agg(
        F.sum(F.when(~hi, F.col("neg")).otherwise(0)).alias("tn"),
        F.sum(F.when(hi, F.col("neg")).otherwise(0)).alias("fp"),
        F.sum(F.when(~hi, F.col("pos")).otherwise(0)).alias("fn"),
        F.sum(F.when(hi, F.col("pos")).otherwise(0)).alias("tp"))


def auc(scored: DataFrame, keys: Sequence[str] = KEYS, n_buckets: int = DEFAULT_BUCKETS,
        counts: DataFrame | None = None, levels: int | None = None) -> DataFrame:
    """ROC AUC with ties counted one half (Mann-Whitney), plus n, positives, negatives.

    Pair counts are summed as DECIMAL(38,0): exact, so the result does not depend
    on how the sum was split over tasks.  NULL when a group has one class only.
    """
    keys = list(keys)
    counts = counts if counts is not None else score_counts(scored, keys)
    c = prefix_sums(counts, keys, "p", ["pos"], descending=True, n_buckets=n_buckets, levels=levels)
    dec = "decimal(38,0)"
    pairs2 = F.col("neg").cast(dec) * (F.lit(2) * F.col("pos_before") + F.col("pos")).cast(dec)
    g = c.groupBy(*keys).agg(
        F.sum(pairs2).alias("_pairs2"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"))
    return g.select(
        *keys,
        (F.col("n_pos") + F.col("n_neg")).alias("n"), "n_pos", "n_neg",
        F.try_divide(F.col("_pairs2").cast("double"),
                     F.lit(2.0) * F.col("n_pos").cast("double") * F.col("n_neg").cast("double")).alias("auc"))


def auc_ci(df: DataFrame, level_z: float = Z_975, auc_col: str = "auc", n_col: str = "n") -> DataFrame:
    """The reference's 'binomial' interval: auc -/+ z*sqrt(auc(1-auc)/n), n = all rows, not clipped."""
    a = F.col(auc_col)
    se = F.sqrt(F.try_divide(a * (F.lit(1.0) - a), F.col(n_col).cast("double")))
    return df.withColumn("auc_lower", a - F.lit(level_z) * se).withColumn("auc_upper", a + F.lit(level_z) * se)


def model_table(scored: DataFrame, cut: float = 0.5, keys: Sequence[str] = KEYS,
                n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """The comparison table: AUC with interval, accuracy, precision, sensitivity, specificity, F1."""
    keys = list(keys)
    counts = score_counts(scored, keys)
    m = class_metrics(confusion_from_counts(counts, cut, keys))
    a = auc_ci(auc(scored, keys, n_buckets, counts=counts))
    return a.join(m, keys, "inner").select(
        *keys, "n", "auc", "auc_lower", "auc_upper", "accuracy", "precision", "sensitivity",
        "specificity", "f1", "tn", "fp", "fn", "tp")


def roc_curve(scored: DataFrame, keys: Sequence[str] = KEYS, drop_collinear: bool = True,
              n_buckets: int = DEFAULT_BUCKETS, levels: int | None = None) -> DataFrame:
    """ROC points: the origin (threshold NULL), then one point per distinct score,
    descending.  With ``drop_collinear`` a point is kept only where the step to the
    next point differs from the step that reached it (plus the first and last)."""
    keys = list(keys)
    counts = score_counts(scored, keys)
    c = prefix_sums(counts, keys, "p", ["pos", "neg"], descending=True,
                    lead_cols=["pos", "neg"] if drop_collinear else [], n_buckets=n_buckets, levels=levels)
    tot = counts.groupBy(*keys).agg(F.sum("pos").alias("_P"), F.sum("neg").alias("_N"))
    c = c.join(small_side(tot), keys)  # one row a group
    tps = F.col("pos_before") + F.col("pos")
    fps = F.col("neg_before") + F.col("neg")
    if drop_collinear:
        first = (F.col("pos_before") == 0) & (F.col("neg_before") == 0)
        last = F.col("pos_next").isNull()
        turn = (F.col("pos_next") != F.col("pos")) | (F.col("neg_next") != F.col("neg"))
        c = c.where(first | last | turn)
    pts = c.select(*keys, F.col("p").alias("threshold"),
                   ratio(fps, "_N").alias("fpr"), ratio(tps, "_P").alias("tpr"))
    origin = tot.select(*keys, F.lit(None).cast("double").alias("threshold"),
                        F.when(F.col("_N") > 0, F.lit(0.0)).alias("fpr"),
                        F.when(F.col("_P") > 0, F.lit(0.0)).alias("tpr"))
    return origin.unionByName(pts)


def calibration(scored: DataFrame, n_bins: int = 10, keys: Sequence[str] = KEYS, on_missing: str = "error") -> DataFrame:
    """Reliability table over ``n_bins`` equal bins of [0, 1]: mean p and observed
    rate per non-empty bin.  A score on an inner edge goes to the lower bin."""
    keys = list(keys)
    # edges are linspace(0, 1, n+1) = k*(1/n); bin = 1 + number of inner edges below p
    below = count_points_below("p", start=0.0, step=1.0 / n_bins, n=n_bins + 1, stop=1.0)
    inner = F.least(F.greatest(below - F.lit(1), F.lit(0)), F.lit(n_bins - 1))
    return (checked(scored, on_missing).withColumn("bin", (inner + F.lit(1)).cast("int"))
            .groupBy(*keys, "bin").agg(
                F.avg("p").alias("prob_pred"),
                F.avg(F.col("y").cast("double")).alias("prob_true"),
                F.count(F.lit(1)).alias("n")))


def thresholds(spark, n: int = 100, start: float = 0.01, stop: float = 1.0) -> DataFrame:
    """numpy ``linspace(start, stop, n)`` as a table (k, threshold)."""
    step = (stop - start) / (n - 1)
    return (spark.range(n).select(F.col("id").cast("int").alias("k"))
            .withColumn("threshold", grid_point("k", start, step, n, stop)))


def decision_curve(scored: DataFrame, n: int = 100, start: float = 0.01, stop: float = 1.0,
                   keys: Sequence[str] = KEYS, on_missing: str = "error") -> DataFrame:
    """Net benefit of the model, of treating all and of treating none at ``n``
    thresholds (class = ``p > t``, strict).  At t = 1 the weight t/(1-t) is
    undefined and the net benefits are NULL.

    One pass over the rows: each score is counted under k(p) = number of thresholds
    below it; true/false positives at threshold j are the counts with k > j,
    a descending cumulative sum over at most n+1 rows per group.
    """
    keys = list(keys)
    step = (stop - start) / (n - 1)
    k = count_points_below("p", start, step, n, stop)
    counts = (checked(scored, on_missing).withColumn("_k", k)
              .groupBy(*keys, "_k").agg(F.count_if(F.col("y") == 1).alias("_pos"),
                                        F.count_if(F.col("y") == 0).alias("_neg")))
    # every k in 0..n for every group (n is a parameter, so this is bounded)
    groups = counts.groupBy(*keys).agg(F.sum("_pos").alias("_P"), F.sum("_neg").alias("_N"))
    grid = groups.select(*keys, "_P", "_N", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("_k"))
    full = grid.join(counts, keys + ["_k"], "left")
    # rows with k >= k0, summed from the top; threshold j is passed by k >= j+1
    w = Window.partitionBy(*keys).orderBy(F.col("_k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    cum = full.select(*keys, "_P", "_N", "_k",
                      F.sum(F.coalesce("_pos", F.lit(0))).over(w).alias("_tp"),
                      F.sum(F.coalesce("_neg", F.lit(0))).over(w).alias("_fp"))
    g = cum.where(F.col("_k") >= 1).withColumn("_j", F.col("_k") - 1)
    t = grid_point("_j", start, step, n, stop)
    wt = F.try_divide(t, F.lit(1.0) - t)
    total = (F.col("_P") + F.col("_N")).cast("double")
    return g.select(
        *keys, t.alias("threshold"),
        (F.col("_tp") / total - F.col("_fp") / total * wt).alias("net_benefit"),
        (F.col("_P") / total - F.col("_N") / total * wt).alias("treat_all"),
        F.lit(0.0).alias("treat_none"))
