"""Histogram trees: splits against brute force, the same model for any partitioning, prefix fits,
pruning, out-of-bag votes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import grids as gr
from tabeval.operators import trees as tr
from tabeval.operators.evaluate import auc
from tabeval.sources.io import testdata_table as read_testdata

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def problem(spark, sf_dir):
    d = read_testdata(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.floor(F.col("o_totalprice") / 9000).cast("double").alias("a"),
        (F.col("o_custkey") % 13).cast("double").alias("b"), (F.col("o_orderkey") % 7).cast("double").alias("c"))
    d = d.withColumn("y", ((F.col("a") + 3 * F.col("b") + F.col("o_noise") if "o_noise" in d.columns else
                            F.col("a") + 3 * F.col("b") + F.col("row_id") % 29) > 48).cast("int"))
    rows = d.collect()
    return spark.createDataFrame(rows, d.schema).repartition(5, "row_id").cache()


@pytest.fixture(scope="module")
def arrays(problem):
    p = problem.toPandas().sort_values("row_id")
    return p[FEATURES].to_numpy(), p["y"].to_numpy().astype(float), p["row_id"].to_numpy()


def best_split(x, g, h, p):
    """Every cut of every feature, straight from the definition."""
    def score(m):
        return g[m].sum() ** 2 / (h[m].sum() + p.l2) if m.any() else 0.0
    best, every = None, np.ones(len(g), bool)
    for f in range(x.shape[1]):
        v = np.unique(x[:, f])
        for cut in (v[:-1] + v[1:]) / 2:
            left = x[:, f] <= cut
            if min(left.sum(), (~left).sum()) < p.min_rows or min(h[left].sum(), h[~left].sum()) < p.min_hess:
                continue
            gain = score(left) + score(~left) - score(every)
            if best is None or gain > best[0] + 1e-12:
                best = (gain, f, cut, left)
    return best


def grown(x, g, h, p):
    """{path: (feature, cut)} best-first or level by level."""
    out, leaves = {}, {1: np.arange(len(g))}
    tried = {}
    while True:
        for path, rows in leaves.items():
            if path not in tried:
                deep = path.bit_length() - 1 >= p.max_depth or len(rows) < p.min_split
                s = None if deep else best_split(x[rows], g[rows], h[rows], p)
                tried[path] = s if s and s[0] > p.min_gain + 1e-12 else None
        open_ = [(-tried[k][0], k) for k in leaves if tried[k]]
        if not open_ or (p.num_leaves and len(leaves) >= p.num_leaves):
            return out, leaves
        k = min(open_)[1]
        _, f, cut, left = tried[k]
        rows = leaves.pop(k)
        out[k] = (FEATURES[f], cut)
        leaves[2 * k], leaves[2 * k + 1] = rows[left], rows[~left]


@pytest.mark.parametrize("name", ["leaf", "level"])
def test_trees_match_brute_force(problem, arrays, name):
    x, y, _ = arrays
    p = tr.TreeParams(trees=2, **(dict(tr.LEAF_WISE, num_leaves=9) if name == "leaf" else dict(tr.LEVEL_WISE, max_depth=3)))
    model = tr.fit_all(tr.prepare(problem, FEATURES), [p])[0]
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    for t in model.trees:
        prob = 1 / (1 + np.exp(-margin))
        g, h = prob - y, prob * (1 - prob)
        splits, leaves = grown(x, g, h, p)
        got = {t.path[k]: (FEATURES[f], model.bins.cuts[f][t.bin[k]]) for k, f in enumerate(t.feature) if f >= 0}
        assert got == splits
        if name == "leaf":
            assert t.leaves == 9
        values = {t.path[k]: t.value[k] for k, f in enumerate(t.feature) if f < 0}
        for path, rows in leaves.items():
            want = -p.rate * g[rows].sum() / (h[rows].sum() + p.l2)
            assert values[path] == pytest.approx(want, abs=1e-6)
            margin[rows] += values[path]


def test_same_model_for_any_partitioning(problem, monkeypatch):
    monkeypatch.setattr(tr, "SMALL_CELLS", 0)
    p = [tr.TreeParams(trees=3, **tr.LEAF_WISE, columns=0.7), tr.TreeParams(trees=2, **tr.LEVEL_WISE, rows=0.6),
         tr.TreeParams(**{**tr.FOREST, "trees": 3, "max_depth": 8}, node_columns=2)]
    a = tr.fit_all(tr.prepare(problem.coalesce(1), FEATURES), p)
    b = tr.fit_all(tr.prepare(problem.repartition(9), FEATURES), p)
    for m, n in zip(a, b):
        assert [t.__dict__ for t in m.trees] == [t.__dict__ for t in n.trees]
    alone = tr.fit_all(tr.prepare(problem, FEATURES), p[:1])[0]  # and for any company
    assert [t.__dict__ for t in alone.trees] == [t.__dict__ for t in a[0].trees]


def test_small_table_gives_the_same_models(problem, monkeypatch):
    p = [tr.TreeParams(trees=12, **tr.LEAF_WISE, columns=0.7), tr.TreeParams(trees=3, **tr.LEVEL_WISE, rows=0.6),
         tr.TreeParams(**{**tr.FOREST, "trees": 10, "max_depth": 8}, node_columns=2)]
    data = tr.prepare(problem, FEATURES)
    small = tr.fit_all(data, p)
    monkeypatch.setattr(tr, "SMALL_CELLS", 0)
    passes = tr.fit_all(data, p)
    for a, b in zip(small, passes):
        assert [t.__dict__ for t in a.trees] == [t.__dict__ for t in b.trees] and a.start == b.start


def test_small_passes_and_direct_counts_give_the_same(problem, monkeypatch):
    p = [tr.TreeParams(trees=1, **tr.LEAF_WISE), tr.TreeParams(trees=2, boosted=False, max_depth=5)]
    data = tr.prepare(problem, FEATURES)
    want = tr.fit_all(data, p)
    monkeypatch.setattr(tr, "SMALL_CELLS", 0)
    monkeypatch.setattr(tr, "PASS_CELLS", 3 * data.bins.width * 3)
    monkeypatch.setattr(tr, "FAN_IN", 2)
    got = tr.fit_all(data, p)
    assert [[t.__dict__ for t in m.trees] for m in got] == [[t.__dict__ for t in m.trees] for m in want]


def test_transform_and_staged_scores_agree(problem):
    model = tr.fit_all(tr.prepare(problem, FEATURES), [tr.TreeParams(trees=6, **tr.LEVEL_WISE)])[0]
    p = {r.row_id: r.p for r in model.transform(problem).collect()}
    staged = tr.staged([model], problem, [(0, 3), (0, 6), (0, 0)]).collect()
    assert len(staged) == 3 * len(p) and all(r.p == pytest.approx(p[r.row_id]) for r in staged if r.model == "1")
    assert len({r.p for r in staged if r.model == "2"}) == 1
    scored = model.transform(problem).selectExpr("'m' AS model", "row_id", "y", "p")
    assert auc(scored, keys=["model"]).first()["auc"] > 0.85
    table = model.node_table(problem.sparkSession)
    assert table.where("feature IS NULL").count() == sum(t.leaves for t in model.trees)


def test_grid_points_equal_separate_fits(problem):
    val = problem.where("row_id % 3 = 0")
    train = problem.where("row_id % 3 <> 0")
    grid = {"rate": [0.1, 0.3], "max_depth": [2, 4], "trees": [3, 6], "rows": [0.7, 1.0]}
    table, best = gr.staged_search("gbt", train, val, FEATURES, grid=grid)
    rows = table.orderBy("ordinal").collect()
    assert len(rows) == 16
    data = tr.prepare(train, FEATURES)
    for k in (0, 5, 15):
        point = gr.points(grid)[k]
        m = tr.fit_all(data, [tr.TreeParams(**{**tr.LEVEL_WISE, **point})])[0]
        alone = auc(m.transform(val).selectExpr("'m' AS model", "row_id", "y", "p"), keys=["model"]).first()["auc"]
        assert alone == pytest.approx(rows[k].auc, abs=1e-12)
    top = max(r.auc for r in rows)
    first = next(r.ordinal for r in rows if r.auc == top)
    assert len(best.trees) == gr.points(grid)[first]["trees"]


def test_tree_grid_by_truncation_equals_separate_fits(problem):
    val, train = problem.where("row_id % 3 = 0"), problem.where("row_id % 3 <> 0")
    table, _ = gr.staged_search("tree", train, val, FEATURES)
    rows = table.orderBy("ordinal").collect()
    assert len(rows) == 72
    data = tr.prepare(train, FEATURES)
    for k in (0, 16, 40, 54, 71):
        point = dict(gr.points(gr.GRIDS["tree"])[k])
        alpha, depth = point.pop("ccp_alpha"), point.pop("max_depth")
        columns = 1 if point.pop("node_columns") else None
        m = tr.fit_all(data, [tr.TreeParams(**tr.SINGLE, max_depth=depth or tr.MAX_DEPTH, node_columns=columns, **point)])[0]
        m.trees = [tr.cut_back(m.trees[0], ccp_alpha=alpha)]
        alone = auc(m.transform(val).selectExpr("'m' AS model", "row_id", "y", "p"), keys=["model"]).first()["auc"]
        assert alone == pytest.approx(rows[k].auc, abs=1e-12)


def subtrees(t, k=0):
    """All prunings of a tree, as sets of the nodes that stay split."""
    if t.feature[k] < 0:
        return [frozenset()]
    return [frozenset()] + [frozenset({k}) | a | b for a in subtrees(t, t.left[k]) for b in subtrees(t, t.right[k])]


def test_pruning_matches_all_subtrees(problem, arrays):
    _, y, _ = arrays
    model = tr.fit_all(tr.prepare(problem, FEATURES), [tr.TreeParams(**tr.SINGLE, max_depth=3)])[0]
    t = model.trees[0]
    gone = tr.pruned_alphas(t)
    impurity = [2 * (g / h) * (1 - g / h) * n / t.n[0] for g, h, n in zip(t.g, t.h, t.n)]

    def cost(kept, alpha):
        leaves = [c for k in kept for c in (t.left[k], t.right[k]) if c not in kept] if kept else [0]
        return sum(impurity[k] for k in leaves) + alpha * len(leaves)

    everything = subtrees(t)
    inner = [k for k, f in enumerate(t.feature) if f >= 0]
    for alpha in sorted({0.0, 1e-4, 0.001, 0.01, 0.1, *[a + 1e-9 for a in gone if a < 1]}):
        kept = frozenset(k for k in inner if gone[k] > alpha)
        least = min(cost(s, alpha) for s in everything)
        assert cost(kept, alpha) == pytest.approx(least, abs=1e-9)
        assert len(kept) == min(len(s) for s in everything if cost(s, alpha) <= least + 1e-12)
    assert tr.cut_back(t, ccp_alpha=1.0).leaves == 1 and tr.cut_back(t, max_depth=1).leaves <= 2


def test_single_tree_is_pure_and_min_split_holds(problem, arrays):
    x, y, _ = arrays
    model = tr.fit_all(tr.prepare(problem, FEATURES), [tr.TreeParams(**tr.SINGLE)])[0]
    t = model.trees[0]
    got = t.predict(model.bins.of(list(x.T)))
    mean = {}
    for row, v in zip(map(tuple, x), y):
        mean.setdefault(row, []).append(v)
    assert got == pytest.approx([np.mean(mean[tuple(row)]) for row in x], abs=1e-7)  # grown out
    for k in range(len(t.path)):
        if t.feature[k] >= 0:
            assert 0 < t.g[k] < t.h[k]
    small = tr.fit_all(tr.prepare(problem, FEATURES), [tr.TreeParams(**tr.SINGLE, min_split=50)])[0].trees[0]
    assert all(small.n[k] >= 50 for k in range(len(small.path)) if small.feature[k] >= 0)
    assert tr.cut_back(t, min_split=50).__dict__ == small.__dict__


def test_out_of_bag_votes_match_a_recomputation(problem, arrays):
    x, y, ids = arrays
    data = tr.prepare(problem, FEATURES)
    p = tr.TreeParams(**{**tr.FOREST, "trees": 9}, node_columns=2)
    model = tr.fit_all(data, [p])[0]
    m = model.bins.of(list(x.T))
    weights = np.stack([tr.row_weights(ids, "bootstrap", p.seed, k) for k in range(9)])
    assert 0.9 < weights.mean() < 1.1 and 0.3 < (weights == 0).mean() < 0.43
    votes = np.stack([t.predict(m) for t in model.trees])
    for k, t in enumerate(model.trees):  # each tree saw its own rows, as often as drawn
        assert t.n[0] == weights[k].sum()
    got = {r.row_id: (r.votes, r.p) for r in tr.out_of_bag(model, data).collect()}
    for i, rid in enumerate(ids):
        free = weights[:, i] == 0
        assert got[rid][0] == free.sum()
        assert got[rid][1] is None if not free.any() else got[rid][1] == pytest.approx(votes[free, i].mean())


def test_edges(spark):
    rows = [(k, k % 2, 1.0, float(k)) for k in range(8)]
    df = spark.createDataFrame(rows, "row_id long, y int, a double, b double")
    one = tr.fit_all(tr.prepare(df, ["a"]), [tr.TreeParams(trees=2, **tr.LEVEL_WISE), tr.TreeParams(**tr.SINGLE)])
    assert [t.leaves for m in one for t in m.trees] == [1, 1, 1]  # a constant feature
    same = tr.fit_all(tr.prepare(df.withColumn("y", F.lit(1)), ["b"]), [tr.TreeParams(**tr.SINGLE)])[0]
    assert same.trees[0].leaves == 1 and same.transform(df).first()["p"] == 1.0
    for bad in ("NULL", "double('NaN')"):
        with pytest.raises(Exception):
            tr.prepare(df.withColumn("b", F.expr(f"IF(row_id = 3, {bad}, b)")), ["b"]).table.collect()
    with pytest.raises(ValueError, match="no training rows"):
        tr.prepare(df.limit(0), ["b"])


def test_many_values_are_cut_at_quantiles(spark):
    df = spark.range(5000).selectExpr("id AS row_id", "int(id >= 2500) AS y", "double(id) AS v")
    bins = tr.fit_bins(df, ["v"], 64)
    assert 40 <= len(bins.cuts[0]) <= 64
    model = tr.fit_all(tr.prepare(df, ["v"], max_bins=64), [tr.TreeParams(trees=3, **tr.LEAF_WISE)])[0]
    p = np.array([r.p for r in model.transform(df).orderBy("row_id").collect()])
    assert p[:2400].max() < p[2600:].min()
