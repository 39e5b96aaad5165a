"""Property and edge tests on small inline fixtures."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tabeval.functions.exprs import count_points_below, grid_point
from tabeval.functions.tails import chi2_sf, t_two_sided
from tabeval.operators import consistency as cs
from tabeval.operators import cumulative as cu
from tabeval.operators import evaluate as ev
from tabeval.operators import explain as xp
from tabeval.operators import profile as pr
from tabeval.operators import split as sp
from tabeval.operators.cumulative import prefix_sums


def scored_df(spark, rows):
    return spark.createDataFrame(rows, "dataset STRING, model STRING, row_id LONG, y INT, p DOUBLE")


def brute_auc(ys, ps):
    pos = [p for y, p in zip(ys, ps) if y == 1]
    neg = [p for y, p in zip(ys, ps) if y == 0]
    s = sum(1.0 if a > b else 0.5 if a == b else 0.0 for a in pos for b in neg)
    return s / (len(pos) * len(neg))


def test_count_points_below_equals_brute_force(spark):
    n, start, stop = 100, 0.01, 1.0
    step = (stop - start) / (n - 1)
    grid = [k * step + start for k in range(n - 1)] + [stop]
    xs = grid + [g + 1e-17 for g in grid] + [g - 1e-12 for g in grid] + [random.random() for _ in range(300)] + \
        [-1.0, 0.0, 2.0]
    df = spark.createDataFrame([(float(x),) for x in xs], "x DOUBLE")
    got = df.select("x", count_points_below("x", start, step, n, stop).alias("c"),
                    count_points_below("x", start, step, n, stop, strict=False).alias("le")).collect()
    for r in got:
        assert r.c == sum(1 for g in grid if g < r.x), r.x
        assert r.le == sum(1 for g in grid if g <= r.x), r.x


def test_grid_point_matches_numpy(spark):
    want = np.linspace(0.01, 1.0, 100)
    got = spark.range(100).select(grid_point("id", 0.01, 0.99 / 99, 100, 1.0).alias("g")).collect()
    assert [r.g for r in got] == list(want)


def test_auc_matches_pairs_and_is_rank_invariant(spark):
    rnd = random.Random(7)
    rows = [("d", "m", i, rnd.randint(0, 1), round(rnd.random(), 2)) for i in range(400)]
    df = scored_df(spark, rows)
    a = ev.auc(df, n_buckets=8).first().auc
    from tabeval.operators import cumulative as cu
    old = cu.TARGET_RANGE_ROWS
    cu.TARGET_RANGE_ROWS = 10     # force the range cut on this small input
    try:
        assert ev.auc(df, n_buckets=8).first().auc == pytest.approx(a, abs=1e-15)
    finally:
        cu.TARGET_RANGE_ROWS = old
    assert a == pytest.approx(brute_auc([r[3] for r in rows], [r[4] for r in rows]), abs=1e-12)
    mono = df.withColumn("p", F.col("p") * F.col("p") * 0.5)   # strictly increasing on [0, 1]
    assert ev.auc(mono, n_buckets=8).first().auc == pytest.approx(a, abs=1e-12)


def test_prefix_sums_equal_plain_window_under_skew(spark):
    rnd = random.Random(3)
    # one key holds most rows; many ties
    rows = [("big" if i % 10 else "small", float(rnd.randint(0, 50)), rnd.randint(1, 5)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE, w INT").groupBy("k", "v").agg(F.sum("w").alias("w"))
    w = Window.partitionBy("k").orderBy(F.desc("v"))
    want = df.select("k", "v", F.coalesce(F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                                          F.lit(0)).alias("w_before"), F.lead("w").over(w).alias("w_next"))
    b = {(r.k, r.v): (r.w_before, r.w_next) for r in want.collect()}
    for levels in (None, 1, 2):
        got = prefix_sums(df, ["k"], "v", ["w"], descending=True, lead_cols=["w"], n_buckets=3, levels=levels)
        assert {(r.k, r.v): (r.w_before, r.w_next) for r in got.collect()} == b
    # the depth follows the size of the largest group
    assert prefix_sums(df, ["k"], "v", ["w"], n_buckets=2, target_rows=5).count() == df.count()


def test_confusion_sums_to_n_and_edges(spark):
    rows = [("d", "m", i, 1, 0.2) for i in range(5)]  # one class, no predicted positive
    t = ev.model_table(scored_df(spark, rows)).first()
    assert (t.tn, t.fp, t.fn, t.tp) == (0, 0, 5, 0)
    assert t.auc is None and t.precision is None and t.specificity is None and t.accuracy == 0.0


def test_roc_all_ties_and_calibration_edges(spark):
    rows = [("d", "m", i, i % 2, 0.5) for i in range(10)]
    roc = ev.roc_curve(scored_df(spark, rows)).orderBy(F.col("threshold").asc_nulls_first()).collect()
    assert [(r.fpr, r.tpr) for r in roc] == [(0.0, 0.0), (1.0, 1.0)]
    edges = [0.0, 0.1, 0.3, 0.5, 1.0]
    cal = ev.calibration(scored_df(spark, [("d", "m", i, 1, p) for i, p in enumerate(edges)]), n_bins=10)
    bins = sorted((r.bin, r.n) for r in cal.collect())
    assert bins == [(1, 2), (3, 1), (5, 1), (10, 1)]   # 0 and 0.1 in bin 1: edges go to the lower bin


def test_decision_curve_equals_definition(spark):
    rnd = random.Random(5)
    rows = [("d", "m", i, rnd.randint(0, 1), rnd.choice([0.01, 0.5, 0.99, 1.0, rnd.random()])) for i in range(200)]
    got = {round(r.threshold, 10): r for r in ev.decision_curve(scored_df(spark, rows)).collect()}
    n = len(rows)
    for t in np.linspace(0.01, 1.0, 100):
        tp = sum(1 for r in rows if r[3] == 1 and r[4] > t)
        fp = sum(1 for r in rows if r[3] == 0 and r[4] > t)
        g = got[round(float(t), 10)]
        if t < 1.0:
            assert g.net_benefit == pytest.approx(tp / n - fp / n * t / (1 - t), abs=1e-12)
        else:
            assert g.net_benefit is None


def test_split_exact_disjoint_and_stable(spark):
    df = spark.range(1000).select(F.col("id").alias("row_id"), (F.col("id") % 3 == 0).cast("int").alias("y"))
    a = sp.stratified_split(df, "y", 0.3, 11, "row_id", hex_digits=1)   # range cut
    b = sp.stratified_split(df.repartition(7), "y", 0.3, 11, "row_id", hex_digits=1)
    c = sp.stratified_split(df, "y", 0.3, 11, "row_id")                                     # one window
    ra = {r.row_id: r.split for r in a.collect()}
    rb = {r.row_id: r.split for r in b.collect()}
    rc = {r.row_id: r.split for r in c.collect()}
    assert ra == rb == rc and len(ra) == 1000
    assert sum(1 for v in ra.values() if v == "test") == 300
    # a stratum with one row, and a sample larger than the table
    one = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "row_id LONG, y INT")
    s = {r.row_id: r.split for r in sp.stratified_split(one, "y", 0.3, 1, "row_id").collect()}
    assert len(s) == 3
    assert sp.sample_n(one, 10, 1, "row_id").count() == 3


def test_shap_efficiency_linear_closed_form_and_kernel(spark):
    rnd = random.Random(1)
    ev_ = spark.createDataFrame([(i, rnd.random(), rnd.random(), rnd.random()) for i in range(30)],
                                "row_id LONG, a DOUBLE, b DOUBLE, c DOUBLE")
    bg = sp.sample_n(ev_, 8, 2, "row_id")
    lin = xp.SqlModel("lin", "0.2 + 0.5 * a - 0.3 * b + 0.1 * c")
    inter = xp.SqlModel("int", "a * b + c * c")
    ex = xp.kernel_shap(ev_, bg, ["a", "b", "c"], [lin, inter], mode="exact")
    # efficiency: base + sum(phi) = f(x)
    f = ev_.select("row_id", F.expr(lin.expr).alias("f_lin"), F.expr(inter.expr).alias("f_int"))
    force = xp.shap_force(ex).join(f, "row_id").collect()
    for r in force:
        assert r.fx == pytest.approx(r.f_lin if r.model == "lin" else r.f_int, abs=1e-12)
    # linear model: phi_j = w_j (x_j - mean_bg(x_j))
    bgm = bg.agg(*[F.avg(c).alias(c) for c in "abc"]).first()
    w = {"a": 0.5, "b": -0.3, "c": 0.1}
    for r in ex.where("model = 'lin'").collect():
        assert r.phi == pytest.approx(w[r.feature] * (r.value - bgm[r.feature]), abs=1e-12)
    # kernel with a budget covering all coalitions equals exact; the lambda path equals the unrolled one
    kn = xp.kernel_shap(ev_, bg, ["a", "b", "c"], [inter], mode="kernel", n_coalitions=100)
    a = {(r.row_id, r.feature): r.phi for r in ex.where("model = 'int'").collect()}
    for r in kn.collect():
        assert r.phi == pytest.approx(a[(r.row_id, r.feature)], abs=1e-9)
    old = xp.UNROLL_LIMIT
    xp.UNROLL_LIMIT = 0
    try:
        lam = xp.kernel_shap(ev_, bg, ["a", "b", "c"], [inter], mode="exact").collect()
    finally:
        xp.UNROLL_LIMIT = old
    for r in lam:
        assert r.phi == a[(r.row_id, r.feature)]


def test_shap_on_a_fitted_pipeline_is_efficient(spark):
    from tabeval.operators import classify as cl
    rnd = random.Random(4)
    d = spark.createDataFrame([(i, rnd.randint(0, 1), rnd.random(), rnd.random()) for i in range(60)],
                              "row_id LONG, y INT, a DOUBLE, b DOUBLE")
    m = cl.spec("logistic", ["a", "b"]).fit(d)
    bg = sp.sample_n(d, 5, 1, "row_id")
    shap = xp.kernel_shap(d.limit(10), bg, ["a", "b"], {"lr": m}, mode="exact", prob_col="p")
    fx = m.transform(d).select("row_id", F.col("p").alias("f"))
    for r in xp.shap_force(shap).join(fx, "row_id").collect():
        assert r.fx == pytest.approx(r.f, abs=1e-9)


def test_spearman_constant_feature_is_null_and_agreement_bounds(spark):
    rows = [("m1", i, "const", 1.0, float(i)) for i in range(10)] + \
           [("m1", i, "up", float(i), float(i) ** 3) for i in range(10)] + \
           [("m2", i, "up", float(i), -float(i)) for i in range(10)] + \
           [("m2", i, "const", 1.0, 0.0) for i in range(10)]
    shap = spark.createDataFrame(rows, "model STRING, row_id LONG, feature STRING, value DOUBLE, phi DOUBLE")
    d = {(r.model, r.feature): r for r in cs.shap_direction(shap).collect()}
    assert d[("m1", "const")].spearman_r is None and d[("m1", "const")].sign == 0
    assert d[("m1", "up")].spearman_r == pytest.approx(1.0) and d[("m2", "up")].sign == -1
    t = {r.feature: r for r in cs.consistency(shap).collect()}
    assert "const" not in t                     # no defined correlation at all: left out
    assert t["up"].S_overall == 0.0 and t["up"].Q_agree == 0.0 and t["up"].direction_txt == "0"
    zero = spark.createDataFrame([("m", "a", 0.0), ("m", "b", 0.0)], "model STRING, feature STRING, mean_abs_shap DOUBLE")
    assert {r.I_norm for r in cs.normalise_importance(zero).collect()} == {0.0}
    with pytest.raises(ValueError):
        cs.radar_frame(cs.consistency(shap), use_metric="other")


def test_histogram_edges_and_empty_bins(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.0,), (10.0,)], "x DOUBLE")
    h = pr.histogram(df, "x", bins=5).orderBy("bin").collect()
    counts, _ = np.histogram([0.0, 1.0, 1.0, 10.0], bins=5)
    assert [r["count"] for r in h] == list(counts)
    const = spark.createDataFrame([(3.0,), (3.0,)], "x DOUBLE")
    assert sum(r["count"] for r in pr.histogram(const, "x", bins=4).collect()) == 2


def test_quantiles_match_numpy(spark):
    rnd = random.Random(9)
    xs = [float(rnd.randint(0, 30)) for _ in range(501)] + [None]
    df = spark.createDataFrame([(x,) for x in xs], "x DOUBLE")
    got = {r.q: r.value for r in pr.quantiles(df, ["x"], (0.0, 0.1, 0.25, 0.5, 0.9, 1.0), n_buckets=5).collect()}
    arr = np.array([x for x in xs if x is not None])
    for q, v in got.items():
        assert v == pytest.approx(float(np.quantile(arr, q)), abs=1e-12)


def test_tails_known_values():
    assert t_two_sided(2.0, 10.0) == pytest.approx(0.07338803, abs=1e-7)
    assert chi2_sf(3.841458820694124, 1.0) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(0.0, 2.0) == 1.0
    assert math.isnan(t_two_sided(float("nan"), 3.0))


def test_miss_forest_keeps_observed_cells(spark):
    from tabeval.operators import impute as im
    rnd = random.Random(2)
    rows = []
    for i in range(200):
        a = rnd.random() * 10
        b = 2 * a + rnd.random()
        rows.append((i, a, None if i % 9 == 0 else b, float(rnd.randint(0, 1)) if i % 13 else None))
    df = spark.createDataFrame(rows, "row_id LONG, a DOUBLE, b DOUBLE, c DOUBLE")
    out = im.miss_forest(df, ["a", "b", "c"], categorical=["c"], max_iter=2, num_trees=5)
    got = {r.row_id: r for r in out.collect()}
    assert len(got) == 200
    for i, a, b, c in rows:
        r = got[i]
        assert r.a == a and r.b is not None and r.c is not None
        if b is not None:
            assert r.b == b
        if c is not None:
            assert r.c == c
        else:
            assert r.c in (0.0, 1.0)


def test_sampled_kernel_shap_is_exact_for_a_linear_model(spark):
    rnd = random.Random(8)
    feats = ["a", "b", "c", "d", "e"]
    df = spark.createDataFrame([(i, *[rnd.random() for _ in feats]) for i in range(20)],
                               "row_id LONG, " + ", ".join(f"{f} DOUBLE" for f in feats))
    bg = sp.sample_n(df, 6, 3, "row_id")
    w = {"a": 0.4, "b": -0.2, "c": 0.1, "d": 0.05, "e": -0.3}
    lin = xp.SqlModel("lin", "0.1 + " + " + ".join(f"({v}) * {f}" for f, v in w.items()))
    masks, _ = xp.kernel_map(5, 16, seed=4)
    assert 10 <= len(masks) <= 18                # 16 draws, repeated ones merged, + empty + full: fewer than 32
    out = xp.kernel_shap(df, bg, feats, [lin], mode="kernel", n_coalitions=16, seed=4)
    m = bg.agg(*[F.avg(f).alias(f) for f in feats]).first()
    for r in out.collect():
        assert r.phi == pytest.approx(w[r.feature] * (r.value - m[r.feature]), abs=1e-9)


def test_spearman_salted_join_under_a_hot_value(spark):
    rnd = random.Random(11)
    # one value of x carries most rows (a zero-inflated feature)
    rows = [("m", "f", 0.0 if i % 3 else float(rnd.randint(1, 40)), rnd.random()) for i in range(600)]
    df = spark.createDataFrame(rows, "model STRING, feature STRING, value DOUBLE, phi DOUBLE")
    plain = cs.spearman(df, ["model", "feature"], "value", "phi", hot_rows=10 ** 9).first().spearman_r
    salted = cs.spearman(df, ["model", "feature"], "value", "phi", hot_rows=7).first().spearman_r
    xs = np.array([r[2] for r in rows])
    ys = np.array([r[3] for r in rows])

    def avg_ranks(a):
        order = a.argsort(kind="mergesort")
        ranks = np.empty(len(a))
        i = 0
        s = a[order]
        while i < len(a):
            j = i
            while j + 1 < len(a) and s[j + 1] == s[i]:
                j += 1
            ranks[order[i:j + 1]] = (i + j) / 2.0 + 1
            i = j + 1
        return ranks
    want = float(np.corrcoef(avg_ranks(xs), avg_ranks(ys))[0, 1])
    assert plain == pytest.approx(want, abs=1e-12) and salted == pytest.approx(want, abs=1e-12)


def test_spearman_no_row_meets_the_ranks_of_y(spark, monkeypatch):
    rnd = random.Random(5)
    # repeated rows, ties on both sides, two groups, one constant side, missing sides
    rows = [("m", "f", float(rnd.randint(0, 9)), float(rnd.randint(0, 6))) for _ in range(400)]
    rows += [("m", "g", float(i % 13), float(-(i % 13) // 2)) for i in range(200)]
    rows += [("n", "f", 1.0, float(i)) for i in range(20)] + [("m", "f", None, 1.0), ("m", "f", 1.0, float("nan"))]
    df = spark.createDataFrame(rows, "model STRING, feature STRING, value DOUBLE, phi DOUBLE")
    joins, join = [], cs._salted_join
    monkeypatch.setattr(cs, "_salted_join", lambda big, ranks, on, hot: joins.append(on) or join(big, ranks, on, hot))
    got = {(r.model, r.feature): (r.spearman_r, r.n) for r in cs.spearman(df, ["model", "feature"], "value", "phi", hot_rows=5).collect()}
    assert joins == [["model", "feature", "_x"]]

    def ranks(a):
        _, at, n = np.unique(a, return_inverse=True, return_counts=True)
        return (np.cumsum(n) - n + (n + 1) / 2)[at]

    for key, n in ((("m", "f"), 400), (("m", "g"), 200)):
        part = [r for r in rows if r[:2] == key and r[2] is not None and r[3] == r[3]]
        want = np.corrcoef(ranks([r[2] for r in part]), ranks([r[3] for r in part]))[0, 1]
        assert got[key] == (pytest.approx(want, abs=1e-12), n)
    assert got["n", "f"] == (None, 20)


def test_range_places_by_blocks_of_bounds(spark):
    for n in (1, 2, 3, 8, 9, 10, 63):
        df = spark.range(0, 2 * n + 3).selectExpr("cast(id as double) / 2 - 0.5 AS v", f"transform(sequence(0, {n - 1}), i -> cast(i as double)) AS _bounds")
        got = df.withColumn("_above", cu._block(F.col("v"), n)).withColumn("at", cu._place(F.col("v"), n))
        for r in got.select("v", "at").collect():
            assert r["at"] == sum(b < r["v"] for b in range(n)), (n, r)
