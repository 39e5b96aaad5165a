"""The reference's study, end to end, as three plans over the operators.

1. ``prepare``: raw table -> outlier repair -> imputation -> exact stratified split
   -> balance table -> scaling -> logistic screen and selection;
2. ``fit_and_evaluate``: the final logistic model and the tuned learners ->
   one ``scored`` table -> performance tables and curves;
3. ``explain_and_compare``: SHAP of every learner on one shared evaluation sample
   and background -> per-model direction and importance -> consistency summary.

Each returns DataFrames (and fitted models); nothing is drawn.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.operators import balance as bl
from tabeval.operators import classify as cl
from tabeval.operators import consistency as cs
from tabeval.operators import evaluate as ev
from tabeval.operators import explain as xp
from tabeval.operators import impute as im
from tabeval.operators import profile as pr
from tabeval.operators import scale as sc
from tabeval.operators import select as se
from tabeval.operators import split as sp
from tabeval.operators.frame import Roles
from tabeval.session import checkpoint_dir, materialize


@dataclass
class Prepared:
    train: DataFrame            # not scaled, with row_id
    test: DataFrame
    train_scaled: DataFrame
    test_scaled: DataFrame
    balance: DataFrame
    univariable: DataFrame
    multivariable: DataFrame
    selected: list[str]


def prepare(raw: DataFrame, roles: Roles, repair_column: str | None = None, test_size: float = 0.3,
            seed: int = 2025, impute: bool = True, impute_params: dict | None = None,
            round_columns: tuple[str, ...] = ()) -> Prepared:
    """``round_columns``: imputed integer-valued columns rounded half to even afterwards."""
    df = raw
    if repair_column:
        df = pr.iqr_repair(df, repair_column)
    if impute:
        cols = [roles.label, *roles.features]
        df = im.miss_forest(df, cols, categorical=roles.categorical, exclude=[roles.label], seed=seed,
                            **(impute_params or {}))
        for c in round_columns:
            df = df.withColumn(c, pr.half_even(c, 0))
    split = materialize(sp.stratified_split(df, roles.label, test_size, seed, roles.row_id), "split")
    train = split.where(F.col("split") == "train").drop("split")
    test = split.where(F.col("split") == "test").drop("split")
    tagged = sp.union_tagged({"train_set": train, "test_set": test}, "group")
    balance = bl.balance_table(tagged, "group", [roles.label, *roles.categorical], list(roles.continuous),
                               ["test_set", "train_set"])
    stats = sc.fit_scaler(train, roles.continuous)
    train_s = sc.apply_scaler(train, stats, roles.continuous)
    test_s = sc.apply_scaler(test, stats, roles.continuous)
    features = roles.features
    uni = se.univariable_logit(train, roles.label, features)
    kept = [r.variable for r in se.significant(uni).collect()]          # a handful of names
    multi = se.logit_table(train, roles.label, [f for f in features if f in kept], fit_intercept=False)
    selected = [r.variable for r in se.significant(multi).collect()]
    return Prepared(train, test, train_s, test_s, balance, uni, multi, selected)


# name -> (kind, grid): every learner is tuned over its grid on the validation part
DEFAULT_LEARNERS = {name: (kind, cl.REFERENCE_GRIDS[kind]) for name, kind in (
    ("Decision Tree", "tree"), ("Random Forest", "forest"), ("Gradient Boosting", "gbt"),
    ("Leaf-sized Boosting", "gbt_leafy"), ("SVM", "svm"), ("Neural Network", "mlp"))}


def fit_and_evaluate(prep: Prepared, roles: Roles, learners: dict | None = None, seed: int = 123):
    """Returns (models, scored, validation table, test table).  ``learners``: name -> (kind,
    grid); the model with the best validation AUC of each grid goes on."""
    label, rid = roles.label, roles.row_id
    logistic = se.fit_logistic(prep.train, label, prep.selected)
    # iterative learners read their input once per iteration: materialize it first
    inner = materialize(sp.stratified_split(prep.train_scaled, label, 0.3, seed, rid), "inner")
    tr = inner.where(F.col("split") == "train").drop("split")
    va = inner.where(F.col("split") == "test").drop("split")
    feats = roles.features
    models = {}
    for name, (kind, grid) in (learners or DEFAULT_LEARNERS).items():
        tried = cl.candidates(kind, feats, grid, label, seed, cl.svm_params if grid is cl.REFERENCE_GRIDS.get("svm") else None)
        _table, models[name] = cl.grid_search(tried, tr, va, label, rid)

    def scored_of(m, d, dataset, name):
        return m.transform(d).select(F.lit(dataset).alias("dataset"), F.lit(name).alias("model"),
                                     F.col(rid).cast("long").alias("row_id"),
                                     F.col(label).cast("int").alias("y"), F.col("p").cast("double").alias("p"))
    parts = [scored_of(logistic, prep.train, "validation", "Logistic"),
             scored_of(logistic, prep.test, "test", "Logistic")]
    for name, m in models.items():
        parts += [scored_of(m, va, "validation", name), scored_of(m, prep.test_scaled, "test", name)]
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    table = ev.model_table(scored)
    return ({"Logistic": logistic, **models}, scored,
            table.where(F.col("dataset") == "validation"), table.where(F.col("dataset") == "test"))


def explain_and_compare(prep: Prepared, roles: Roles, models: dict, n_background: int = 200, n_eval: int = 300,
                        seed: int = 2025, mode: str = "kernel", n_coalitions: int | None = None):
    """Returns (shap long table, direction, mean |phi|, consistency summary, radar frame)."""
    feats = roles.features
    checkpoint_dir(prep.train.sparkSession)
    both = prep.train_scaled.unionByName(prep.test_scaled)
    bg = sp.sample_n(both, n_background, seed, roles.row_id)
    evald = sp.sample_n(both, n_eval, seed, roles.row_id).checkpoint(eager=True)
    shap = xp.kernel_shap(evald, bg, feats, models, id_col=roles.row_id, mode=mode, n_coalitions=n_coalitions,
                          seed=seed, prob_col="p")
    # every later step reads the explanations: compute them once
    checkpoint_dir(shap.sparkSession)
    shap = shap.checkpoint(eager=True)
    direction = cs.shap_direction(shap)
    mean_abs = cs.shap_mean_abs(shap)
    table = cs.consistency_table(direction, mean_abs)
    return shap, direction, mean_abs, table, cs.radar_frame(table)
