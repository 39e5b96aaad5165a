"""Exact Shapley values of binned trees: every coalition once for its distinct bins."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import explain as xp
from tabeval.operators import trees as tr


def test_values_follow_the_definition_and_models_see_few_rows(spark, monkeypatch):
    d = spark.range(600).selectExpr("id AS row_id", "int(id * 7 % 11 + id % 3 > 6) AS y", "double(id % 11) AS a",
                                    "double(id * 5 % 7) AS b", "double(id % 3) AS c")
    feats = ["a", "b", "c"]
    model = tr.fit_all(tr.prepare(d, feats), [tr.TreeParams(trees=5, **tr.LEVEL_WISE)])[0]
    bg = d.where("row_id % 29 = 0")
    # no row is expanded to coalitions x background rows
    monkeypatch.setattr(tr.TreeModel, "transform", None)
    got = {(r.row_id, r.feature): (r.value, r.phi, r.base) for r in xp.kernel_shap(
        d, bg, feats, {"gbt": model}, mode="exact", prob_col="p").collect()}
    rows = d.toPandas().set_index("row_id")[feats]
    back = bg.toPandas()[feats].to_numpy()

    def v(x, inside):
        z = back.copy()
        z[:, list(inside)] = x[list(inside)]
        return model.score(model.bins.of(list(z.T)))[0].mean()

    assert len(got) == 1800
    for rid in (0, 17, 301, 599):
        x = rows.loc[rid].to_numpy()
        for j, f in enumerate(feats):
            rest = [i for i in range(3) if i != j]
            phi = sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (v(x, (*s, j)) - v(x, s))
                      for n in range(3) for s in itertools.combinations(rest, n))
            assert got[rid, f] == pytest.approx((x[j], phi, v(x, ())), abs=1e-12)
    assert not np.isnan([p for _, p, _ in got.values()]).any() and d.where(F.col("a").isNull()).count() == 0
