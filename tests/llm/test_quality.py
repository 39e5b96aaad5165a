"""Factorisation machine: the linear-time identity, gradients, held-out ranking, edge rows."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabeval.llm import quality
from tabeval.llm.common import held_out


def auc(pairs):
    pos, neg = [s for s, y in pairs if y], [s for s, y in pairs if not y]
    return np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])


def test_margin_is_the_pairwise_sum():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.3, rng.normal(size=(50, 1 + quality.RANK)))
    docs = [(np.array([3, 9, 20]), np.array([0.5, -1.0, 2.0])), (np.array([7]), np.array([1.5]))]
    z, _ = m.margin(np.concatenate([d[0] for d in docs]), np.concatenate([d[1] for d in docs]), np.array([0, 3]))
    for got, (at, x) in zip(z, docs):
        want = 0.3 + sum(m.table[i, 0] * v for i, v in zip(at, x)) + sum(
            float(m.table[at[a], 1:] @ m.table[at[b], 1:]) * x[a] * x[b] for a in range(len(at)) for b in range(a))
        assert got == pytest.approx(want)


def test_a_step_goes_down_the_numeric_gradient():
    rng = np.random.default_rng(2)
    table = rng.normal(0, 0.3, (quality.SIZE, 1 + quality.RANK))
    at, x, y = np.array([1, 4, 6]), np.array([1.0, 0.5, 2.0]), 1
    def loss(t):
        z = quality.Machine(0.1, t).margin(at, x, np.zeros(1, int))[0][0]
        return -np.log(quality.sigmoid(z))
    m, square = quality.Machine(0.1, table.copy()), np.zeros((quality.SIZE, 1 + quality.RANK)) + 1e-12
    quality.steps(m, [(at, x, y)], square, 1e-9, 0.0, 8)
    for i in (1, 4, 6):
        for f in range(1 + quality.RANK):
            t = table.copy()
            t[i, f] += 1e-5
            slope = (loss(t) - loss(table)) / 1e-5
            assert np.sqrt(square[i, f]) == pytest.approx(abs(slope), rel=0.02, abs=1e-4)
            assert (table - m.table)[i, f] * slope >= 0


def test_held_out_ranking(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    m = quality.train(docs, labels.where(~held_out("doc_id", 5, 0)).select("doc_id", F.col("quality").alias("label")))
    rows = quality.score(docs, m).join(labels, "doc_id").where(held_out("doc_id", 5, 0)).collect()
    assert auc([(r["score"], r["quality"]) for r in rows]) > 0.85


def test_edges(docs_of, spark):
    df = docs_of([(1, None), (2, ""), (2, ""), (None, "some words"), (5, "a\n" * 600_000), (6, "word")])
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (6, None), (77, 1), (5, 1), (5, 1)], "doc_id long, label int")
    m = quality.train(df, labels, rounds=2)
    rows = quality.score(df, m).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (1, 2)}) == 1
    flat = quality.train(df, labels.where("label = 1"))
    assert len({round(r["score"], 12) for r in quality.score(df, flat).collect()}) == 1
    assert quality.score(docs_of([]), flat).count() == 0
    assert quality.train(docs_of([]), labels).bias == 0


def test_training_sample_is_bounded_and_stable(documents, spark):
    labels = documents.select("doc_id", (F.length("text") % 2).alias("label"))
    a = quality.train(documents, labels, sample=50, rounds=2)
    b = quality.train(documents.repartition(3), labels.repartition(5), sample=50, rounds=2)
    np.testing.assert_allclose(a.table, b.table)


def test_features_read_whole_texts():
    f = quality.Features()
    (_, at, x), (_, bt, _) = f.rows(pa.array(["w%d " % 1 * 400_000 + "tail", None]))
    assert len(at) == 2 + quality.STATS and len(bt) == quality.STATS and np.isclose((x[:2] ** 2).sum(), 1)
