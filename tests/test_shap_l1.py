"""Kernel SHAP with the L1 path: sets against the stationarity conditions, values against known models."""

import itertools
import math

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from pyspark.ml import Transformer

from tabeval.operators import explain as xp


def lasso(gram, c, lam, rounds=20000):
    beta = np.zeros(len(c))
    for _ in range(rounds):
        old = beta.copy()
        for j in range(len(c)):
            r = c[j] - gram[j] @ beta + gram[j, j] * beta[j]
            beta[j] = math.copysign(max(abs(r) - lam, 0.0), r) / gram[j, j]
        if np.abs(beta - old).max() < 1e-13:
            break
    return beta


@pytest.mark.parametrize("seed", range(6))
def test_path_visits_the_set_of_every_penalty(seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(30, 6)) + rng.normal(size=(30, 1))
    y = x @ np.array([2.0, 0, -1, 0, 0.5, 0]) + rng.normal(size=30)
    gram, c = x.T @ x, x.T @ y
    sets = xp.l1_path(gram, c)
    at = 0
    for lam in np.abs(c).max() * np.geomspace(0.999, 1e-4, 60):  # the sets in the order of falling penalties
        wanted = np.flatnonzero(np.abs(lasso(gram, c, lam)) > 1e-9).tolist()
        at = sets.index(wanted, at)
    assert sets[-1] == list(range(6))


def brute(z, w, y, d, chosen):
    """Weighted least squares on ``chosen`` under the efficiency constraint, by elimination of the last one."""
    *head, last = chosen
    zf = z.astype(float)
    a = zf[:, head] - zf[:, [last]]
    t = y - zf[:, last] * d
    r = np.sqrt(w)
    phi = np.zeros(z.shape[1])
    if head:
        phi[head] = np.linalg.lstsq(a * r[:, None], t * r, rcond=None)[0]
    phi[last] = d - phi[head].sum()
    return phi


@pytest.mark.parametrize("criterion", ["aic", "bic"])
def test_values_from_sums_equal_the_regression_itself(criterion):
    rng = np.random.default_rng(3)
    z, w = xp.kernel_coalitions(9, 200, 1)
    fit = xp.SparseFit(z, w, criterion)
    zf, s = z.astype(float), z.sum(axis=1)
    rows = np.vstack([zf * np.sqrt(w * (9 - s))[:, None], (zf - 1) * np.sqrt(w * s)[:, None]])
    for k in range(20):
        truth = np.where(rng.random(9) < 0.4, rng.normal(size=9), 0.0)
        y = zf @ truth + 0.05 * rng.normal(size=len(z))
        d = truth.sum() + 0.05 * rng.normal()
        phi = fit.values(zf.T @ (w * y), float((w * s * y).sum()), float((w * y * y).sum()), d)
        target = np.concatenate([y * np.sqrt(w * (9 - s)), (y - d) * np.sqrt(w * s)])
        scale = np.sqrt((rows ** 2).sum(0))
        marks = []
        for chosen in xp.l1_path((rows / scale).T @ (rows / scale), (rows / scale).T @ target):
            left = target - rows[:, chosen] @ np.linalg.lstsq(rows[:, chosen], target, rcond=None)[0]
            n = len(target)
            marks.append((n * math.log(left @ left / n) + len(chosen) * (2 if criterion == "aic" else math.log(n)), chosen))
        np.testing.assert_allclose(phi, brute(z, w, y, d, min(marks)[1]), atol=1e-9)
        assert abs(phi.sum() - d) < 1e-9


def test_all_coalitions_of_a_dense_model_give_exact_values(spark):
    feats = ["a", "b", "c", "e"]
    rng = np.random.default_rng(0)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(12, 4)))], ["row_id", *feats])
    bg = df.where("row_id < 5")
    model = xp.SqlModel("m", "1 / (1 + exp(-(a * b + 2 * c - e + 0.3 * a)))")
    args = (df, bg, feats, [model])
    exact = {(r.row_id, r.feature): r for r in xp.kernel_shap(*args, mode="exact").collect()}
    some = xp.kernel_shap(*args, l1="aic").collect()
    by_row = {i: [r for r in some if r.row_id == i] for i in range(12)}
    for i, rows in by_row.items():
        assert len(rows) == 4
        want = [exact[i, r.feature] for r in rows]
        assert abs(sum(r.phi for r in rows) - sum(r.phi for r in want)) < 1e-9
        assert all(abs(r.base - q.base) < 1e-12 and r.value == q.value for r, q in zip(rows, want))
        if all(r.phi for r in rows):
            assert all(abs(r.phi - q.phi) < 1e-9 for r, q in zip(rows, want))
    assert any(all(r.phi for r in rows) for rows in by_row.values())


def test_sparse_model_of_seventy_features(spark):
    """More features than one long has bits; only the model's own are found, with their exact values."""
    m, used = 70, {2: 1.5, 40: -2.0, 66: 0.75}
    rng = np.random.default_rng(7)
    data = rng.integers(0, 1000, size=(14, m)) / 1000
    feats = [f"f{j}" for j in range(m)]
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], ["row_id", *feats])
    model = xp.SqlModel("s", " + ".join(f"({w}D) * f{j}" for j, w in used.items()))
    mean = data[:6].mean(axis=0)
    for l1 in ("aic", "bic"):
        out = xp.kernel_shap(df, df.where("row_id < 6"), feats, [model], n_coalitions=400, l1=l1).collect()
        assert len(out) == 14 * m
        for r in out:
            j = int(r.feature[1:])
            want = used.get(j, 0.0) * (data[r.row_id, j] - mean[j])
            assert abs(r.phi - want) < 1e-9 and (j in used or r.phi == 0.0)


class Summed(Transformer):
    def _transform(self, df):
        return df.withColumn("probability", array_to_vector(F.array(F.lit(0.0), F.col("a") - F.col("c"))))


def test_transformers_constants_nulls_and_refusals(spark):
    feats = ["a", "b", "c"]
    df = spark.createDataFrame([(1, 0.5, 1.0, 2.0), (2, 1.5, 3.0, 0.0), (2, 1.5, 3.0, 0.0)], ["row_id", *feats])
    out = xp.kernel_shap(df, df, feats, {"t": Summed(), "k": xp.SqlModel("k", "0.25"), "n": xp.SqlModel("n", "CAST(NULL AS DOUBLE) * a")},
                         l1="bic").collect()
    assert len(out) == 27  # the repeated row has its values twice
    means = {"a": 3.5 / 3, "b": 7 / 3, "c": 2 / 3}
    for r in out:
        if r.model == "t":
            want = {"a": 1, "b": 0, "c": -1}[r.feature] * (r.value - means[r.feature])
            assert abs(r.phi - want) < 1e-9
        else:
            assert r.phi == (0.0 if r.model == "k" else None)
    assert xp.kernel_shap(df.limit(0), df, feats, [xp.SqlModel("k", "a")], l1="aic").count() == 0
    for bad in ({"l1": "cp"}, {"l1": "aic", "mode": "exact"}):
        with pytest.raises(ValueError):
            xp.kernel_shap(df, df, feats, [xp.SqlModel("k", "a")], **bad)
