"""Value checks for the learners, imputation, missing values, and executor safety."""

import math
import os
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.functions import required
from tabeval.operators import classify as cl
from tabeval.operators import evaluate as ev
from tabeval.operators import explain as xp
from tabeval.operators import impute as im
from tabeval.operators import select as se
from tabeval.sources.io import testdata_table as read_testdata

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def problem(spark, sf_dir):
    """Separable by a curve: y from the documents' own columns, standardised."""
    li = read_testdata(spark, sf_dir, "lineitem").select(
        F.monotonically_increasing_id().alias("row_id"), ((F.col("l_quantity") - 25.5) / 14.4).alias("a"),
        ((F.col("l_extendedprice") - 25000) / 15000).alias("b"), (F.col("l_tax") * 20).alias("c"))
    d = li.withColumn("y", (F.col("a") * 2 + F.col("b") > 0.3).cast("int"))
    rows = d.collect()
    return spark.createDataFrame(rows, d.schema).repartition(4, "row_id").cache()


SPECS = {"tree": ("tree", {"maxDepth": 6}), "tree_subset": ("tree", {"maxDepth": 8, "featureSubsetStrategy": "sqrt"}),
         "forest": ("forest", {"numTrees": 15, "maxDepth": 6}), "gbt": ("gbt", {"maxIter": 10, "maxDepth": 4}),
         "gbt_leafy": ("gbt_leafy", {"maxIter": 10, "num_leaves": 8}), "logistic": ("logistic", {}),
         "svm_linear": ("svm", {"kernel": "linear"}), "svm_poly": ("svm", {"kernel": "poly", "degree": 2}),
         "svm_rbf": ("svm", {"kernel": "rbf", "n_components": 60, "gamma": 0.5}), "mlp": ("mlp", {"hidden": [6], "maxIter": 100})}


@pytest.mark.parametrize("name", sorted(SPECS))
def test_learner_finds_the_boundary(problem, name):
    kind, params = SPECS[name]
    train, test = problem.where("row_id % 3 <> 0"), problem.where("row_id % 3 = 0")
    m = cl.spec(kind, ["a", "b", "c"], **params).fit(train)
    row = ev.auc(cl.score_all({name: m}, test, "test")).first()
    assert row["n"] == test.count() and row["auc"] > 0.95
    with pytest.raises(Exception, match="NaN|null|Encountered"):
        cl.score_all({name: m}, test.withColumn("a", F.when(F.col("row_id") > 3, F.col("a"))), "test").collect()


def test_grid_winner_is_the_first_maximum(problem):
    train, val = problem.where("row_id % 3 <> 0"), problem.where("row_id % 3 = 0")
    tried = cl.candidates("tree", ["a", "b", "c"], {"maxDepth": [1, 4, 4], "minInstancesPerNode": [1, 5]})
    assert len(tried) == 4   # repeated combinations are tried once
    table, best = cl.grid_search(tried, train, val, parallelism=2)
    rows = sorted(table.collect(), key=lambda r: r["ordinal"])
    top = max(r["auc"] for r in rows)
    first = next(r["ordinal"] for r in rows if r["auc"] == top)
    assert cl.learner_of(best.stages).getOrDefault("maxDepth") == tried[first][0]["maxDepth"]
    assert ev.auc(cl.score_all({"m": best}, val, "v")).first()["auc"] == pytest.approx(top)


def test_trees_on_counted_bins_equal_trees_on_rows(spark, monkeypatch):
    # values in few steps: both cut between all of them
    d = spark.range(3000).selectExpr("id AS row_id", "pmod(xxhash64(id), 31) / 3e0 AS a", "pmod(xxhash64(id, 1), 17) - 5e0 AS b", "1e0 AS c",
                                     "pmod(xxhash64(id, 2), 100) AS u").selectExpr("*", "int(u < 20 + 40 * int(a + b > 6) + 30 * int(a * b < 0)) AS y")
    train, val = d.where("row_id % 3 <> 0"), d.where("row_id % 3 = 0")
    tried = cl.candidates("tree", ["a", "b", "c"], {"maxDepth": [9], "minInstancesPerNode": [1, 40],
                                                    "featureSubsetStrategy": ["sqrt", "all"], "minInfoGain": [0.0, 0.01]})
    by_rows, _ = cl.grid_search(tried, train, val)
    want = [tuple(r) for r in by_rows.orderBy("ordinal").collect()]
    fitted, fit = [], cl.Pipeline.fit
    monkeypatch.setattr(cl, "CUT_ROWS", 0)
    monkeypatch.setattr(cl.Pipeline, "fit", lambda self, df: fitted.append(df.count()) or fit(self, df))
    table, best = cl.grid_search(tried, train, val)
    got = [tuple(r) for r in table.orderBy("ordinal").collect()]
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=1e-12)
    assert len({round(w[2], 6) for w in want}) > 4  # the points differ
    # no fit reads the 2,000 rows
    assert len(fitted) == len(tried) + 1 and max(fitted) <= 2 * 31 * 17 < train.count()
    top = max(w[2] for w in want)
    assert ev.auc(cl.score_all({"m": best}, val, "v")).first()["auc"] == pytest.approx(top)
    with pytest.raises(Exception, match="missing value in a"):
        cl.grid_search(tried, train.withColumn("a", F.expr("nullif(a, 0e0)")), val)


def test_only_single_trees_over_all_rows_are_counted():
    f = ["a", "b"]
    assert cl.max_bins_of(cl.spec("tree", f)) == cl.max_bins_of(cl.spec("tree", f, featureSubsetStrategy="sqrt")) == 32
    others = [cl.spec("tree", f, weightCol="w"), cl.spec("tree", f, minWeightFractionPerNode=0.1), cl.spec("gbt", f), cl.spec("svm", f)]
    assert [cl.max_bins_of(p) for p in [*others, *(cl.spec("forest", f, numTrees=n) for n in (1, 5))]] == [None] * 6


def test_reference_grids_have_every_combination():
    f = ["a", "b", "c"]
    assert {k: len(cl.reference_candidates(k, f)) for k in cl.REFERENCE_GRIDS} == {
        "tree": 72, "forest": 27, "gbt": 81, "gbt_leafy": 243, "svm": 3 * (1 + 4 + 3), "mlp": 7}


@pytest.mark.parametrize("name", ["svm_poly", "forest", "mlp", "tree_subset"])
def test_default_vs_tuned_lists_the_learner(problem, name):
    kind, params = SPECS[name]
    tuned = {k: v for k, v in params.items()} | ({"maxIter": 7} if kind in ("svm", "mlp") else {"maxDepth": 3})
    a = cl.spec(kind, ["a", "b", "c"], **params).fit(problem)
    b = cl.spec(kind, ["a", "b", "c"], **tuned).fit(problem)
    t = {r["param"]: (r["default"], r["tuned"]) for r in cl.compare_params(a, b).collect()}
    key = "maxIter" if kind in ("svm", "mlp") else "maxDepth"
    assert t[key][1] == str(tuned[key]) and "elasticNetParam" not in t


# ------------------------------------------------------------------ missing values

@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_scores_are_refused_or_dropped(spark, bad):
    rows = [("d", "m", 1, 0.9), ("d", "m", 0, 0.2), ("d", "m", 1, bad), ("d", "m", 0, bad), ("d", "m", 1, 0.4)]
    s = spark.createDataFrame(rows, "dataset string, model string, y int, p double")
    for f in (ev.confusion, ev.model_table, ev.roc_curve, ev.calibration, ev.decision_curve):
        with pytest.raises(Exception, match="missing value in p"):
            f(s).collect()
    c = ev.confusion(s, on_missing="drop").first()
    assert (c.tp, c.fn, c.tn, c.fp) == (1, 1, 1, 0)
    assert ev.calibration(s, on_missing="drop").agg(F.sum("n")).first()[0] == 3
    assert tuple(ev.score_audit(s).first())[2:] == (5, 3, 2)


@pytest.mark.parametrize("bad", [None, float("nan")])
def test_missing_features_are_refused_or_dropped(spark, bad):
    rows = [(i % 2, float(i % 7), bad if i % 10 == 0 else float(i % 5)) for i in range(200)]
    d = spark.createDataFrame(rows, "y int, a double, b double")
    for f in (se.univariable_logit, se.logit_table, se.lasso_select, se.fit_logistic):
        with pytest.raises(Exception, match="missing value in b"):
            f(d, "y", ["a", "b"])
    m = se.fit_logistic(d, "y", ["a", "b"], on_missing="drop")
    with pytest.raises(Exception):
        m.transform(d).agg(F.avg("p")).collect()
    assert tuple(se.row_audit(d, ["a", "b"]).first()) == (200, 180, 20)
    assert m.stages[-1].summary.numInstances == 180


def test_required_names_the_column(spark):
    with pytest.raises(Exception, match="missing value in price"):
        spark.createDataFrame([(None,)], "x double").select(required("x", "price")).collect()


# ------------------------------------------------------------------ fits against numpy

def test_univariable_logit_matches_newton(spark):
    rng = np.random.default_rng(0)
    x = np.stack([rng.normal(50000, 9000, 400), rng.integers(0, 3, 400), np.full(400, 2.0)], 1)
    y = (rng.random(400) < 1 / (1 + np.exp(-(x[:, 0] - 50000) / 9000 - 0.3 * x[:, 1]))).astype(int)
    d = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, x)], "y int, u double, v double, w double")
    got = {r.variable: r for r in se.univariable_logit(d, "y", ["u", "v", "w"]).collect()}
    for j, name in enumerate("uv"):
        z = np.stack([np.ones(400), (x[:, j] - x[:, j].mean()) / x[:, j].std()], 1)
        b = np.zeros(2)
        for _ in range(40):
            p = 1 / (1 + np.exp(-z @ b))
            h = z.T @ (z * (p * (1 - p))[:, None])
            b += np.linalg.solve(h, z.T @ (y - p))
        assert got[name].coefficient == pytest.approx(b[1] / x[:, j].std(), rel=1e-9)
        assert got[name].std_error == pytest.approx(np.sqrt(np.linalg.inv(h)[1, 1]) / x[:, j].std(), rel=1e-9)
    assert np.isnan(got["w"].std_error)   # a constant candidate has no estimate


# ------------------------------------------------------------------ imputation

def test_imputation_beats_the_mean_and_keeps_observed_cells(spark):
    rng = np.random.default_rng(4)
    a = rng.uniform(0, 10, 400)
    rows = [(i, float(x), None if i % 5 == 0 else float(3 * x + 1), None if i % 7 == 0 else float(x > 5)) for i, x in enumerate(a)]
    d = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    out = {r.row_id: r for r in im.miss_forest(d, ["a", "b", "c"], categorical=["c"], max_iter=3, num_trees=15).collect()}
    mean = np.mean([r[2] for r in rows if r[2] is not None])
    miss = [i for i in range(400) if i % 5 == 0]
    assert np.mean([(out[i].b - 3 * a[i] - 1) ** 2 for i in miss]) < 0.1 * np.mean([(mean - 3 * a[i] - 1) ** 2 for i in miss])
    assert np.mean([out[i].c == float(a[i] > 5) for i in range(0, 400, 7)]) > 0.9
    assert all(out[i].b == rows[i][2] for i in range(400) if rows[i][2] is not None)


def test_categorical_imputation_goes_on_after_one_round(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(300):
        x = rng.integers(0, 2)
        rows.append((i, float(rng.random()), None if i % 3 == 0 else float(x), None if i % 4 == 0 else float(x)))
    d = spark.createDataFrame(rows, "row_id long, a double, b double, c double")
    fits = []
    original = im.RandomForestClassifier
    monkeypatch.setattr(im, "RandomForestClassifier", lambda **k: fits.append(1) or original(**k))
    im.miss_forest(d, ["a", "b", "c"], categorical=["b", "c"], max_iter=4, num_trees=5).count()
    assert len(fits) > 2


# ------------------------------------------------------------------ explanations

def test_feature_names_like_functions_and_literals(spark):
    d = spark.createDataFrame([(1, 2.0, 3.0), (2, 0.5, 1.0)], "row_id long, exp double, `odd name` double")
    model = xp.SqlModel("m", "exp(exp) + `odd name` * CASE WHEN 'exp' = 'exp' THEN 1 ELSE 0 END")
    out = {(r.row_id, r.feature): r for r in xp.kernel_shap(d, d, ["exp", "odd name"], [model], mode="exact").collect()}
    for i, e, o in ((1, 2.0, 3.0), (2, 0.5, 1.0)):
        assert out[i, "exp"].phi == pytest.approx(np.exp(e) - (np.exp(2.0) + np.exp(0.5)) / 2)
        assert out[i, "odd name"].phi == pytest.approx(o - 2.0)


def test_nan_and_null_background_cells(spark):
    d = spark.createDataFrame([(1, 2.0, 1.0)], "row_id long, a double, b double")
    bg = spark.createDataFrame([(float("nan"), 1.0), (None, 1.0)], "a double, b double")
    model = xp.SqlModel("m", "coalesce(nanvl(a, 0.0D), 0.0D) + b")
    for limit in (2048, 0):
        xp.UNROLL_LIMIT, kept = limit, xp.UNROLL_LIMIT
        try:
            got = {r.feature: r.phi for r in xp.kernel_shap(d, bg, ["a", "b"], [model], mode="exact").collect()}
        finally:
            xp.UNROLL_LIMIT = kept
        assert got == {"a": pytest.approx(2.0), "b": pytest.approx(0.0)}


def test_merged_coalitions_solve_the_same_least_squares():
    masks, k = xp.kernel_map(6, 33, seed=1)
    assert len({m.tobytes() for m in masks}) == len(masks)
    w = np.array([0.5, -1, 2, 0.1, 3, -0.7])
    v = masks.astype(float) @ w + 0.25   # a linear game: its Shapley values are w
    np.testing.assert_allclose(k @ v, w, atol=1e-9)


# ------------------------------------------------------------------ executors without the package

def test_balance_table_runs_with_the_package_on_the_drivers_path_only(sf_dir, tmp_path):
    code = f"""
import sys; sys.path.insert(0, {ROOT!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", {str(tmp_path)!r}).config(
    "spark.sql.shuffle.partitions", "2").getOrCreate()
import __spark_entry__
rows = __spark_entry__.queries()["balance_table"](spark, {sf_dir!r}).collect()
print("ROWS", len(rows))
"""
    env = {k: v for k, v in os.environ.items() if k not in ("PYTHONPATH", "PYSPARK_GATEWAY_PORT", "PYSPARK_GATEWAY_SECRET")}
    r = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "ROWS" in r.stdout, r.stderr[-2000:]


def test_nan_cells_are_imputed_and_repeated_overrides_count_once(spark):
    from tabeval.operators import profile as pr
    rows = [(k, float("nan") if k % 9 == 0 else None if k % 7 == 0 else float(k % 5), float(k % 5)) for k in range(120)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double")
    out = {r.row_id: r.a for r in im.miss_forest(df, ["a", "b"], max_iter=2, num_trees=5).collect()}
    for k, a, _ in rows:
        assert out[k] is not None and not np.isnan(out[k])
        assert a is None or np.isnan(a) or out[k] == a
    d = spark.createDataFrame([(k, k % 5) for k in range(20)] + [(20, 500)], "row_id long, v int")
    twice = spark.createDataFrame([(20, 50), (20, 50), (3, 7)], "row_id long, value int")
    got = pr.iqr_repair(d, "v", overrides=twice).collect()
    assert len(got) == 21 and {r.row_id: r.v for r in got}[20] == 50 and {r.row_id: r.v for r in got}[3] == 7
    with pytest.raises(Exception, match="several overrides"):
        pr.iqr_repair(d, "v", overrides=twice.union(spark.createDataFrame([(20, 51)], twice.schema))).collect()


def test_out_of_bag_error_of_the_imputer(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 2))
    y = 2 * x[:, 0] - x[:, 1]
    gone = rng.random(400) < 0.2
    noise = rng.normal(size=400)
    rows = [(k, *map(float, x[k]), None if gone[k] else float(y[k]), None if k % 11 == 0 else float(noise[k])) for k in range(400)]
    df = spark.createDataFrame(rows, "row_id long, a double, b double, y double, z double")
    out, errors = im.miss_forest_errors(df, ["a", "b", "y", "z"], max_iter=3, num_trees=30, max_depth=8, stop="oob")
    e = {(r["round"], r["column"]): r.oob_error for r in errors.collect()}
    assert e[1, "y"] < 0.6 and e[1, "z"] > 0.9                 # a function of the others; noise
    assert {r["round"] for r in errors.where("chosen").collect()} <= {1, 2, 3}
    filled = {r.row_id: r.y for r in out.collect()}
    got = np.array([filled[k] for k in range(400)])
    rmse, flat = (math.sqrt(np.mean((v - y)[gone] ** 2)) for v in (got, np.full(400, y[~gone].mean())))
    assert rmse < 0.6 * flat and rmse / y.std() == pytest.approx(e[1, "y"], rel=0.5)
    assert "p" not in out.columns and sorted(out.columns) == sorted(df.columns)
