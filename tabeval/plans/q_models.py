"""Registered model queries (M1 M3-M5 M7 C1-C9, X1 sampled and on fitted models).

The logistic fits and the LASSO have oracles (Newton steps and coordinate descent in
SQL); the tree, boosting, SVM and network learners are checked on known problems in
tests/test_learners.py.
Binary problem over orders: y = (o_orderstatus = 'F'), three numeric features,
split 70/30 by the exact stratified split.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabeval.operators import classify as cl
from tabeval.operators import evaluate as ev
from tabeval.operators import explain as xp
from tabeval.operators import grids as gr
from tabeval.operators import impute as im
from tabeval.operators import network as nw
from tabeval.operators import scale as sc
from tabeval.operators import select as se
from tabeval.operators import svm as sv
from tabeval.operators import trees as tr
from tabeval.operators.split import sample_n, stratified_split
from tabeval.plans import fixtures as fx
from tabeval.plans import oracles as orc
from tabeval.plans.queries import MODEL_TABLE_SQL, SCORED, register
from tabeval.plans.report import rounded
from tabeval.session import materialize
from tabeval.sources.io import testdata_table

SEED = 2025
ORDER_FEATURES = ["price", "cust", "age_days"]
LINE_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def orders_problem(spark, sf_dir):
    o = testdata_table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("row_id"),
                 (F.col("o_orderstatus") == "F").cast("int").alias("y"),
                 (F.col("o_totalprice") / 1000.0).alias("price"),
                 F.col("o_custkey").cast("double").alias("cust"),
                 F.datediff(F.col("o_orderdate").cast("date"), F.lit("1992-01-01").cast("date"))
                  .cast("double").alias("age_days"))
    # every fit reads it again and again: split once
    return materialize(stratified_split(d, "y", 0.3, SEED, id_col="row_id"), "orders_problem")


def lineitem_problem(spark, sf_dir):
    li = testdata_table(spark, sf_dir, "lineitem")
    return li.select(F.expr(fx.LABEL_SQL).alias("y"), *LINE_FEATURES)


def _coefficients(name: str, variables: list[str], extra: str = "") -> str:
    names = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(variables))
    return (f"SELECT CASE i {names} END AS variable, round(b, 6) AS coefficient, {extra}round(se, 6) AS std_error, "
            f"round(b / se, 6) AS z, round({orc.p_normal('(b / se)')}, 6) AS p_value FROM {name}")


LINES = f"(SELECT {fx.LABEL_SQL} AS y, * FROM lineitem)"
UNIVARIABLE_SQL = "WITH RECURSIVE " + ", ".join(
    orc.newton(f"m{i}", LINES, "y", [f], True) for i, f in enumerate(LINE_FEATURES)) + " " + " UNION ALL ".join(
    _coefficients(f"m{i}", [f]) + " WHERE i = 0" for i, f in enumerate(LINE_FEATURES))

ORDERS_SQL = f"""
o AS (SELECT o_orderkey AS row_id, (o_orderstatus = 'F')::INT AS y, o_totalprice / 1000.0 AS price,
             o_custkey::DOUBLE AS cust, date_diff('day', DATE '1992-01-01', o_orderdate::DATE)::DOUBLE AS age_days FROM orders),
ox AS (SELECT *, md5(concat('{SEED}', ':', row_id::VARCHAR)) AS key FROM o),
oc AS (SELECT y, count(*) AS c FROM ox GROUP BY 1),
oa AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER () - ceil(0.3::DOUBLE * sum(c) OVER ()) AS n_train FROM oc),
ob AS (SELECT *, n_train::DOUBLE * c / n::DOUBLE AS cont, floor(n_train::DOUBLE * c / n::DOUBLE) AS fl FROM oa),
od AS (SELECT *, n_train - sum(fl) OVER () AS need, row_number() OVER (ORDER BY cont - fl DESC, y NULLS FIRST) AS rk FROM ob),
osplit AS (SELECT ox.* EXCLUDE (key), CASE WHEN row_number() OVER (PARTITION BY ox.y ORDER BY key, row_id)
             <= fl + (rk <= need)::INT THEN 'train' ELSE 'test' END AS split FROM ox JOIN od USING (y)),
otrain AS (SELECT * FROM osplit WHERE split = 'train')"""
ORDERS_FIT = f"WITH RECURSIVE {ORDERS_SQL}, {orc.newton('fit', 'otrain', 'y', ORDER_FEATURES, True)}"
ORDERS_P = "1 / (1 + exp(-(b0 * price + b1 * cust + b2 * age_days + b3)))"


@register("univariable_logit", UNIVARIABLE_SQL)
def q_univariable_logit(spark, sf_dir):
    return rounded(se.univariable_logit(lineitem_problem(spark, sf_dir), "y", LINE_FEATURES))


@register("logit_table", f"WITH RECURSIVE {orc.newton('fit', LINES, 'y', LINE_FEATURES, False)} " + _coefficients(
    "fit", LINE_FEATURES, "round(exp(b), 6) AS odds_ratio, "))
def q_logit_table(spark, sf_dir):
    return rounded(se.logit_table(lineitem_problem(spark, sf_dir), "y", LINE_FEATURES, fit_intercept=False))


@register("lasso_select", f"WITH RECURSIVE {orc.lasso(LINES, 'y', LINE_FEATURES, 0.001)} " + " UNION ALL ".join(
    f"SELECT '{f}' AS variable, round(w{i}, 6) AS coefficient, w{i} <> 0 AS selected FROM lasso"
    for i, f in enumerate(LINE_FEATURES)))
def q_lasso_select(spark, sf_dir):
    return rounded(se.lasso_select(lineitem_problem(spark, sf_dir), "y", LINE_FEATURES, alpha=0.001))


@register("fit_logistic", f"""{ORDERS_FIT},
scored AS (SELECT split AS dataset, 'logistic' AS model, y, {ORDERS_P} AS p FROM osplit, fit_b),
{MODEL_TABLE_SQL.split(SCORED + ',')[1]}""")
def q_fit_logistic(spark, sf_dir):
    """Final logistic model on the training split, evaluated on both splits."""
    d = orders_problem(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    m = se.fit_logistic(train, "y", ORDER_FEATURES)
    scored = (m.transform(d).select(F.col("split").alias("dataset"), F.lit("logistic").alias("model"),
                                    "row_id", "y", F.col("p")))
    return rounded(ev.model_table(scored))


TREE_SPECS = {
    "tree": tr.TreeParams(**tr.SINGLE),
    "forest": tr.TreeParams(**tr.FOREST, node_columns=1),
    "gbt": tr.TreeParams(**tr.LEVEL_WISE),
    "gbt_leafy": tr.TreeParams(**tr.LEAF_WISE),
}


@register("classifier_table")
def q_classifier_table(spark, sf_dir):
    """Eight models at their default sizes trained on the training split, scored on the test split
    in one ``scored`` table, compared by one ``model_table`` job."""
    d = orders_problem(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    test = d.where(F.col("split") == "test")
    models = dict(zip(TREE_SPECS, tr.fit_all(tr.prepare(train, ORDER_FEATURES), list(TREE_SPECS.values()))))
    stats = sc.fit_scaler(train, ORDER_FEATURES)
    train_s, test_s = (sc.apply_scaler(x, stats, ORDER_FEATURES) for x in (train, test))
    kernels = ("linear", "poly", "rbf")
    scaled = dict(zip([f"svm_{k}" for k in kernels],
                      sv.fit_svms(train_s, ORDER_FEATURES, [sv.SvmParams(kernel=k) for k in kernels])))
    scaled["network"] = nw.fit_networks(train_s, ORDER_FEATURES, [nw.NetParams()])[0]
    return rounded(ev.model_table(cl.score_all(models, test, "test").unionByName(cl.score_all(scaled, test_s, "test"))))


@register("grid_search")
def q_grid_search(spark, sf_dir):
    d = orders_problem(spark, sf_dir)
    train_all = d.where(F.col("split") == "train").drop("split")
    inner = stratified_split(train_all, "y", 0.3, 123, id_col="row_id")
    tr, va = inner.where(F.col("split") == "train"), inner.where(F.col("split") == "test")
    table, _best = cl.grid_search(cl.reference_candidates("tree", ORDER_FEATURES), tr, va)
    return rounded(table)


@register("default_vs_tuned")
def q_default_vs_tuned(spark, sf_dir):
    """The SVM's default parameters beside those of the best point of its whole grid."""
    d = orders_problem(spark, sf_dir)
    inner = stratified_split(d.where(F.col("split") == "train").drop("split"), "y", 0.3, 123, id_col="row_id")
    tr_, va = (inner.where(F.col("split") == x).drop("split") for x in ("train", "test"))
    stats = sc.fit_scaler(tr_, ORDER_FEATURES)
    tr_, va = (sc.apply_scaler(x, stats, ORDER_FEATURES) for x in (tr_, va))
    default = sv.fit_svms(tr_, ORDER_FEATURES, [sv.SvmParams()], probabilities=False)[0]
    return cl.compare_params(default, gr.svm_search(tr_, va, ORDER_FEATURES)[1])


@register("miss_forest")
def q_miss_forest(spark, sf_dir):
    li = fx.lineitem_missing(spark, sf_dir).select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    # the defaults are the reference's: at most 10 rounds of 100 trees
    return rounded(im.miss_forest(li, ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]))


@register("kernel_shap_sampled")
def q_kernel_shap_sampled(spark, sf_dir):
    """Three features have six coalitions; a budget of four makes the operator sample them."""
    ev_ = fx.events_features(spark, sf_dir)
    bg = sample_n(ev_, 200, SEED, "row_id")
    models = [xp.SqlModel(n, e) for n, e in fx.EVENT_MODELS]
    feats = [n for n, _ in fx.EVENT_FEATURES]
    return rounded(xp.kernel_shap(ev_, bg, feats, models, mode="kernel", n_coalitions=4, seed=SEED))


WIDE = 13
# f0 by a power of two: halves of the sixth place are exact in both engines
WIDE_FEATURES = [("f0", "CAST(floor(o_totalprice) AS DOUBLE) / CAST(131072.0 AS DOUBLE)"), ("f1", "o_custkey / 1000.0")] + [
    (f"f{j}", f"((o_orderkey * {7919 + 104729 * j}) % 1000) / 1000.0") for j in range(2, WIDE)]
WIDE_WEIGHTS = [(j + 1) / 21 for j in range(WIDE)]


def _wide_sql() -> str:
    """A linear model's Shapley values are weight x (value - background mean), whatever was sampled."""
    cols = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in WIDE_FEATURES)
    order = "ORDER BY md5(concat('{}', ':', row_id::VARCHAR)), row_id LIMIT {}"
    base = " + ".join(f"{w} * avg({n})" for w, (n, _) in zip(WIDE_WEIGHTS, WIDE_FEATURES))
    rows = " UNION ALL ".join(
        f"SELECT 'wide' AS model, row_id, '{n}' AS feature, round({n}, 6) AS value, round({w} * ({n} - (SELECT avg({n}) FROM b)), 6) "
        f"AS phi, round((SELECT {base} FROM b), 6) AS base FROM e" for w, (n, _) in zip(WIDE_WEIGHTS, WIDE_FEATURES))
    return (f"WITH d AS (SELECT o_orderkey AS row_id, {cols} FROM orders), e AS (SELECT * FROM d {order.format(SEED + 1, 300)}), "
            f"b AS (SELECT * FROM d {order.format(SEED, 200)}) {rows}")


@register("kernel_shap_wide", _wide_sql())
def q_kernel_shap_wide(spark, sf_dir):
    """Kernel SHAP at the reference's size: 13 features, 200 background rows, the default
    budget of 2 x 13 + 2048 draws, for 300 sampled orders (the sizes are the feature)."""
    o = testdata_table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("row_id"), *[F.expr(e).cast("double").alias(n) for n, e in WIDE_FEATURES])
    model = xp.SqlModel("wide", " + ".join(f"{w}D * {n}" for w, (n, _) in zip(WIDE_WEIGHTS, WIDE_FEATURES)))
    shap = xp.kernel_shap(sample_n(d, 300, SEED + 1, "row_id"), sample_n(d, 200, SEED, "row_id"),
                          [n for n, _ in WIDE_FEATURES], [model], mode="kernel", seed=SEED)
    return rounded(shap)


SPARSE = 40
SPARSE_FEATURES = [(f"g{j}", f"((o_orderkey * {7919 + 104729 * j}) % 1000) / 1000.0") for j in range(SPARSE)]
SPARSE_WEIGHTS = {f"g{j}": (-1) ** k * (k + 2) / 21 for k, j in enumerate((3, 8, 14, 21, 30, 37))}


def _sparse_sql() -> str:
    """Weight x (value - background mean) for the features in the model, 0 for all others."""
    cols = ", ".join(f"({e})::DOUBLE AS {n}" for n, e in SPARSE_FEATURES)
    order = "ORDER BY md5(concat('{}', ':', row_id::VARCHAR)), row_id LIMIT {}"
    base = " + ".join(f"({w}) * avg({n})" for n, w in SPARSE_WEIGHTS.items())
    rows = " UNION ALL ".join(
        f"SELECT 'sparse' AS model, row_id, '{n}' AS feature, round({n}, 6) AS value, "
        f"round(({SPARSE_WEIGHTS.get(n, 0.0)}) * ({n} - (SELECT avg({n}) FROM b)), 6) + 0.0 AS phi, "
        f"round((SELECT {base} FROM b), 6) AS base FROM e" for n, _ in SPARSE_FEATURES)
    return (f"WITH d AS (SELECT o_orderkey AS row_id, {cols} FROM orders), e AS (SELECT * FROM d {order.format(SEED + 1, 300)}), "
            f"b AS (SELECT * FROM d {order.format(SEED, 200)}) {rows}")


@register("kernel_shap_l1", _sparse_sql())
def q_kernel_shap_l1(spark, sf_dir):
    """X1 with the L1 path: 40 features of which the model uses six, 300 sampled orders and 200
    background rows (the sizes are the feature), the default budget of coalitions."""
    o = testdata_table(spark, sf_dir, "orders")
    d = o.select(F.col("o_orderkey").alias("row_id"), *[F.expr(e).cast("double").alias(n) for n, e in SPARSE_FEATURES])
    model = xp.SqlModel("sparse", " + ".join(f"({w}D) * {n}" for n, w in SPARSE_WEIGHTS.items()))
    shap = xp.kernel_shap(sample_n(d, 300, SEED + 1, "row_id"), sample_n(d, 200, SEED, "row_id"),
                          [n for n, _ in SPARSE_FEATURES], [model], mode="kernel", seed=SEED, l1="aic")
    return rounded(shap.withColumn("phi", F.round("phi", 6) + F.lit(0.0)))


@register("shap_fitted_model")
def q_shap_fitted_model(spark, sf_dir):
    """Shapley values of fitted boosted trees at their default size on every test order, against
    200 background rows."""
    d = orders_problem(spark, sf_dir)
    train = d.where(F.col("split") == "train")
    test = d.where(F.col("split") == "test")
    m = tr.fit_all(tr.prepare(train, ORDER_FEATURES), [TREE_SPECS["gbt"]])[0]
    bg = sample_n(train, 200, SEED, "row_id")
    shap = xp.kernel_shap(test, bg, ORDER_FEATURES, {"gbt": m}, mode="exact", prob_col="p")
    return rounded(shap)


@register("row_audit", """
SELECT count(*) AS n_in, count(*) FILTER (WHERE l_discount <> 0 AND l_tax <> 0) AS n_used,
       count(*) FILTER (WHERE l_discount = 0 OR l_tax = 0) AS n_refused FROM lineitem""")
def q_row_audit(spark, sf_dir):
    """Rows a fit would use and refuse when features are missing."""
    return se.row_audit(fx.lineitem_missing(spark, sf_dir), ["l_quantity", "l_discount", "l_tax"])


@register("score_audit", f"""
SELECT {fx.DATASET_SQL} AS dataset, 'discount' AS model, count(*) AS n_in,
       count(*) FILTER (WHERE l_discount <> 0) AS n_used, count(*) FILTER (WHERE l_discount = 0) AS n_refused
FROM lineitem GROUP BY 1""")
def q_score_audit(spark, sf_dir):
    """Scored rows with and without a score."""
    li = fx.lineitem_missing(spark, sf_dir)
    return ev.score_audit(li.select(F.expr(fx.DATASET_SQL).alias("dataset"), F.lit("discount").alias("model"),
                                    F.expr(fx.LABEL_SQL).alias("y"), F.col("l_discount").alias("p")))


@register("logistic_summary", f"""{ORDERS_FIT},
dev AS (SELECT -2 * sum(y * ln(p) + (1 - y) * ln(1 - p)) AS d FROM (SELECT y, {ORDERS_P} AS p FROM otrain, fit_b))
SELECT t.*, round(d + 8, 6) AS aic, round(d, 6) AS deviance FROM ({_coefficients("fit", [*ORDER_FEATURES, "(intercept)"])}) t, dev""")
def q_logistic_summary(spark, sf_dir):
    """M7: the final logistic model's summary (coefficients, SE, z, p, AIC, deviance)."""
    d = orders_problem(spark, sf_dir)
    m = se.fit_logistic(d.where(F.col("split") == "train"), "y", ORDER_FEATURES)
    return rounded(se.logistic_summary(m, ORDER_FEATURES))
