"""Trees over tables that a task holds: the same as by passes, and work that grows with the rows."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabeval.operators import classify as cl
from tabeval.operators import grids as gr
from tabeval.operators import impute as im
from tabeval.operators import trees as tr


def table(spark, n=3000):
    return spark.range(n).selectExpr("id AS row_id", "int(hash(id) % 3 = 0) AS y", "double(id * 7919 % 101) AS a",
                                     "double(id * 104729 % 89) AS b", "double(id * 31 % 7) AS c")


@pytest.mark.parametrize("p", [dict(**tr.FOREST, node_columns=2), dict(tr.SINGLE), dict(tr.LEAF_WISE, trees=2, columns=0.7),
                               dict(tr.LEVEL_WISE, trees=2, rows=0.6), dict(tr.LEVEL_WISE, trees=2, max_depth=9)])
def test_held_rows_give_the_trees_of_the_passes(spark, monkeypatch, p):
    p = tr.TreeParams(**{**p, "trees": min(p.get("trees", 2), 2)})
    data = tr.prepare(table(spark), ["a", "b", "c"])
    here = list(tr.fit_all(data, [p])[0].trees)
    monkeypatch.setattr(tr, "SMALL_CELLS", 0)
    assert [t.__dict__ for t in here] == [t.__dict__ for t in tr.fit_all(data, [p])[0].trees]


def test_a_forest_of_other_labels_is_that_of_the_passes(spark, monkeypatch):
    data = tr.prepare(table(spark).withColumn("y", F.expr("(row_id * 37 % 1000) / 999.0")), ["a", "b", "c"])
    p = tr.TreeParams(**{**tr.FOREST, "trees": 2}, node_columns=1, min_gain=1e-9)
    here = list(tr.fit_all(data, [p])[0].trees)
    monkeypatch.setattr(tr, "SMALL_CELLS", 0)
    assert [t.__dict__ for t in here] == [t.__dict__ for t in tr.fit_all(data, [p])[0].trees]


@pytest.mark.parametrize("p, passes", [(dict(tr.LEVEL_WISE, max_depth=10, rows=0.6), 3), (dict(tr.FOREST, max_depth=10), 1)])
def test_a_level_counts_the_smaller_siblings_only(monkeypatch, p, passes):
    rng = np.random.default_rng(2)
    n, counted, bincount = 50000, [], np.bincount
    m, y = rng.integers(0, 60, (n, 3)).astype(np.uint16), (rng.random(n) < 0.4).astype(float)
    data, p = tr.Held(np.arange(n), y, m), tr.TreeParams(**p)
    rows = np.count_nonzero(tr.row_weights(data.ids, p.rows, p.seed, 0))
    monkeypatch.setattr(np, "bincount", lambda x, *a, **b: counted.append(len(x)) or bincount(x, *a, **b))
    tree, _ = tr.grown_here(data, p, 0, 60, np.zeros(n))
    assert max(tree.path).bit_length() == 11  # ten levels: the root's rows, then at most half of them nine times
    assert sum(counted) <= passes * 3 * rows * (1 + 9 / 2)


def test_equal_forests_of_a_grid_are_grown_once():
    fits = {gr.fitted_as("forest", p, 3, 1)[0] for p in gr.points(gr.GRIDS["forest"])}
    assert len(fits) == 2  # of three features, three or four a node are all
    assert len({gr.fitted_as("forest", p, 4, 1)[0] for p in gr.points(gr.GRIDS["forest"])}) == 3


def test_few_rows_of_many_trees_are_scored_by_all_cores(spark):
    d = table(spark, 400).coalesce(1)
    model = tr.fit_all(tr.prepare(d, ["a", "b", "c"]), [tr.TreeParams(**{**tr.LEVEL_WISE, "trees": 3})])[0]
    scored = tr.staged([model], d, [(0, 1), (0, 3)])
    assert scored.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert scored.select("row_id").distinct().count() == 400 and scored.count() == 800


def test_grown_out_forests_vote_where_they_grow(spark):
    d = table(spark)
    data = tr.prepare(d, ["a", "b", "c"])
    model = tr.fit_all(data, [tr.TreeParams(**{**tr.FOREST, "trees": 12}, node_columns=2)])[0]
    votes = {r.row_id: (r.votes, r.p) for r in tr.out_of_bag(model, data).collect()}
    points = tr.staged([model], d, [(0, 4), (0, 12)]).where("model = '1'").collect()
    assert model.trees.found is None  # no tree has come to the driver
    rows = d.toPandas().sort_values("row_id")
    m, ids = model.bins.of([rows[c].to_numpy() for c in "abc"]), rows["row_id"].to_numpy()
    got = np.stack([t.predict(m) for t in model.trees])
    free = np.stack([tr.row_weights(ids, "bootstrap", model.params.seed, k) == 0 for k in range(12)])
    assert {r.row_id: r.p for r in points} == pytest.approx(dict(zip(ids, got.mean(axis=0))))
    for i, k in enumerate(ids):
        assert votes[k][0] == free[:, i].sum()
        assert votes[k][1] is None if not free[:, i].any() else votes[k][1] == pytest.approx(got[free[:, i], i].mean())


def test_rows_with_equal_bins_are_counted_not_repeated(spark, monkeypatch):
    d = table(spark, 400)
    many = d.select(F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"), "*").select((F.col("row_id") * 10 + F.col("k")).alias("row_id"),
                                                                                     "y", "a", "b", "c")
    p = [tr.TreeParams(trees=3, **tr.LEVEL_WISE), tr.TreeParams(trees=2, **tr.LEAF_WISE)]
    data = tr.prepare(many, ["a", "b", "c"])
    want = tr.fit_all(data, p)
    monkeypatch.setattr(tr, "SMALL_CELLS", 20000)  # 4,000 rows of 11 values do not fit, 400 do
    monkeypatch.setattr(tr, "counted", None)       # no passes
    got = tr.fit_all(data, p)
    assert [[t.__dict__ for t in m.trees] for m in got] == [[t.__dict__ for t in m.trees] for m in want]


def test_pruning_a_grown_out_tree_takes_no_square():
    rng = np.random.default_rng(1)
    n = 40000
    m, y = rng.integers(0, 200, (n, 3)).astype(np.uint16), (rng.random(n) < 0.4).astype(float)
    data = tr.Held.of(np.arange(n), y, m, 200)
    tree, _ = tr.grown_here(data, tr.TreeParams(**tr.SINGLE), 0, 200, np.zeros(n))
    assert len(tree.path) > 20000
    start = time.time()
    kept = tr.cut_backs(tree, [(None, 2, 0.0), (None, 2, 1e-5), (5, 2, 1e-5), (None, 20, 0.1)])
    assert time.time() - start < 60
    assert kept[0].leaves == tree.leaves > kept[1].leaves > kept[2].leaves > kept[3].leaves == 1


def test_only_the_asked_rows_are_predicted(spark, monkeypatch):
    d = table(spark, 500)
    model = tr.fit_all(tr.prepare(d, ["a", "b", "c"]), [tr.TreeParams(**{**tr.FOREST, "trees": 3}, max_depth=4)])[0]
    want = {r.row_id: r.p for r in model.transform(d).collect()}
    got = {r.row_id: r.p for r in model.transform(d, "p", F.when(F.col("c") > 1, F.col("b") > 40)).collect()}
    asked = {r.row_id for r in d.where("c > 1 AND b > 40").collect()}
    assert 0 < len(asked) < 500 and got == {k: p if k in asked else None for k, p in want.items()}


def test_imputation_cuts_a_whole_column_once(spark, monkeypatch):
    d = table(spark, 600).selectExpr("a", "IF(b > 20, b, NULL) AS b", "IF(c > 0, c, NULL) AS c")
    seen, fit_bins = [], tr.fit_bins
    monkeypatch.setattr(tr, "fit_bins", lambda df, features, most, known: seen.append((list(features), set(known))) or fit_bins(df, features, most, known))
    im.miss_forest(d, ["a", "b", "c"], max_iter=2, num_trees=3).count()
    assert seen == [(["a", "b"], set()), (["a", "c"], set()), (["a", "b"], {"a"}), (["a", "c"], {"a"})]


@pytest.mark.parametrize("cells", [None, 11 * 700])
def test_a_compared_forest_is_scored_where_it_grows(spark, monkeypatch, cells):
    d = table(spark)
    model = tr.fit_all(tr.prepare(d, ["a", "b", "c"]), [tr.TreeParams(**{**tr.FOREST, "trees": 12}, node_columns=2)])[0]
    val = d.where("row_id % 3 = 0").withColumn("row_id", F.expr("row_id div 2"))  # ids may be repeated
    want = sorted((r.row_id, r.y, r.p) for r in tr.TreeModel(model.bins, model.params, list(model.trees)).transform(val).collect())
    model = tr.TreeModel(model.bins, model.params, tr.Forest(model.trees.data, model.params, 12))
    data = model.trees.data.held()  # before the bound shrinks
    assert data is not None
    monkeypatch.setattr(tr, "_collected", lambda *_: pytest.fail("the trees came to the driver"))
    monkeypatch.setattr(tr, "SLICE", 150)
    if cells:
        monkeypatch.setattr(tr, "SMALL_CELLS", cells)
    got = sorted((r.row_id, r.y, r.p) for r in cl.score_all({"forest": model}, val, "test").collect())
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


def test_a_grown_out_tree_of_a_grid_is_cut_and_scored_where_it_grows(spark, monkeypatch):
    d, grid = table(spark), {"max_depth": [3, None], "min_split": [5, 20], "node_columns": ["sqrt", None], "ccp_alpha": [0.0, 0.0005]}
    train, val, columns = d.where("row_id % 3 <> 0"), d.where("row_id % 3 = 0"), ["a", "b", "c"]
    fit_all, collected, plain = tr.fit_all, tr._collected, tr.fit_dealt_out
    monkeypatch.setattr(tr, "fit_all", lambda data, p, stay: fit_all(data, p))
    monkeypatch.setattr(tr, "fit_dealt_out", lambda data, p, stay=False: plain(data, p))
    want = [tuple(r) for r in gr.staged_search("tree", train, val, columns, grid=grid)[0].orderBy("ordinal").collect()]
    monkeypatch.setattr(tr, "fit_all", fit_all)
    monkeypatch.setattr(tr, "fit_dealt_out", plain)
    monkeypatch.setattr(tr, "_collected", lambda data, p, units, cut=None: collected(data, p, units, cut) if not units or cut else
                        pytest.fail("a whole tree came to the driver"))
    got, best = gr.staged_search("tree", train, val, columns, grid=grid)
    assert [tuple(r) for r in got.orderBy("ordinal").collect()] == want
    assert best.trees[0].leaves > 1  # cut before it is brought here


def test_pruning_by_levels_is_that_of_the_weakest_links():
    rng = np.random.default_rng(5)
    n = 5000
    m, y = rng.integers(0, 50, (n, 3)).astype(np.uint16), (rng.random(n) < 0.4).astype(float)
    tree, _ = tr.grown_here(tr.Held.of(np.arange(n), y, m, 50), tr.TreeParams(**tr.SINGLE), 0, 50, np.zeros(n))
    gone = np.array(tr.pruned_alphas(tree))
    for alpha in (1e-6, 1e-5, 3e-5, 1e-4, 1e-3, 1e-2, 0.1):
        assert tr._without(tree, gone <= alpha).__dict__ == tr._without(tree, tr.pruned(tree, alpha)).__dict__


def test_row_weights_follow_the_hash_and_its_bounds(monkeypatch):
    monkeypatch.setattr(tr, "HASHED", 1000)
    ids = np.random.default_rng(6).integers(-2 ** 63, 2 ** 63 - 1, 20_500)
    u = tr.uniform(ids, 9, 4, 1)
    assert (tr.row_weights(ids, "bootstrap", 9, 4) == (u[:, None] >= tr.POISSON).sum(axis=1)).all()
    assert (tr.row_weights(ids, 0.6, 9, 4) == (u < 0.6)).all() and tr.row_weights(ids, 1.0, 9, 4) is None
    calls, mixed = [], tr.mixed
    monkeypatch.setattr(tr, "mixed", lambda x: calls.append(len(x)) or mixed(x))
    tr.row_weights(ids, 0.6, 9, 4)
    assert calls == [1, 1, 1]  # the salts once, not for every thousand rows


def test_values_of_all_features_are_found_in_one_scan(spark, monkeypatch):
    d = table(spark, 2000).withColumn("b", F.expr("double(row_id)")).repartition(5)
    monkeypatch.setattr(type(d), "distinct", lambda _: pytest.fail("a scan for each feature"))
    bins = tr.fit_bins(d, ["a", "b", "c"], 120)
    assert [len(c) for c in bins.cuts][::2] == [100, 6] and 100 < len(bins.cuts[1]) <= 119
    assert (bins.cuts[2] == np.arange(6) + 0.5).all()


@pytest.mark.parametrize("depth", [4, 20])
def test_votes_of_unseen_rows_do_not_pass_the_driver(spark, monkeypatch, depth):
    data = tr.prepare(table(spark), ["a", "b", "c"])
    p = tr.TreeParams(**{**tr.FOREST, "trees": 12, "max_depth": depth}, node_columns=2)
    model = tr.fit_all(data, [p])[0]
    whole = tr.TreeModel(model.bins, p, list(model.trees))
    monkeypatch.setattr(tr.Binned, "small", lambda _: False)
    want = {r.row_id: r for r in tr.out_of_bag(whole, data).collect()}
    monkeypatch.undo()
    monkeypatch.setattr(tr, "SLICE", 700)
    monkeypatch.setattr(tr, "summed", lambda *_: pytest.fail("sums by row came to the driver"))
    got = {r.row_id: r for r in tr.out_of_bag(model, data).collect()}
    assert got.keys() == want.keys()
    for k, r in got.items():
        assert (r.y, r.votes) == (want[k].y, want[k].votes) and r.p == (want[k].p if want[k].p is None else pytest.approx(want[k].p, abs=1e-12))


@pytest.mark.parametrize("p", [dict(tr.FOREST, node_columns=2), dict(tr.SINGLE, min_split=9), dict(tr.LEVEL_WISE, max_depth=10, rows=0.6),
                               dict(tr.LEVEL_WISE, max_depth=12, min_hess=0.0, l2=0.0)])
def test_nodes_that_go_on_in_parts_give_the_same_tree(monkeypatch, p):
    rng = np.random.default_rng(7)
    n = 6000
    m, y = rng.integers(0, 40, (n, 3)).astype(np.uint16), rng.random(n)
    y = (y < 0.2 + 0.5 * (m[:, 1] < 9)).astype(float)
    data, p = tr.Held(np.arange(n), y, m), tr.TreeParams(**p)
    want, ends = tr.grown_here(data, p, 3, 40, np.zeros(n))
    met, best = [], tr._best
    monkeypatch.setattr(tr, "PART", 100)
    monkeypatch.setattr(tr, "_best", lambda x, *a: met.append(x.shape[1]) or best(x, *a))
    tree, at = tr.grown_here(data, p, 3, 40, np.zeros(n))
    assert tree.__dict__ == want.__dict__ and (at == ends).all()
    assert len(met) > 30  # parts of levels, not whole ones
