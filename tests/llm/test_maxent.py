"""Language model: exact counts and base score, a proper distribution, gradients, and a gain on
held-out texts."""

import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import brute
from tabeval.llm import maxent
from tabeval.llm.common import held_out


def base(docs, training):
    c = collections.Counter(w for i in training for w in [*brute.space_words(docs[i]), " "])
    n, v = sum(c.values()), len(c)
    out = {}
    for i, t in docs.items():
        w = [*brute.space_words(t), " "]
        out[i] = (len(w), sum(c[x] > 0 for x in w), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
    return n, out


def run(df, training, head=None):
    counts = maxent.token_table(training)
    m = maxent.train(training, counts)
    return m, maxent.score(df, m, counts)


@pytest.mark.parametrize("head", [None, 500])
def test_base_score_is_exact_and_model_is_better(documents, monkeypatch, head):
    if head:  # most words outside the tasks' table
        plain = maxent.frequent
        monkeypatch.setattr(maxent, "frequent", lambda counts: plain(counts, head))
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    m, out = run(documents, documents.where(~held_out("doc_id", 7, 2)))
    n, want = base(docs, [i for i in docs if zlib.crc32(str(i).encode()) % 7 != 2])
    rows = {r["doc_id"]: r for r in out.collect()}
    assert m.total == n and rows.keys() == docs.keys()
    if head:
        assert len(m.vocabulary.token) <= head
    for i, (tokens, known, score) in want.items():
        assert (rows[i]["n_tokens"], rows[i]["n_known"]) == (tokens, known)
        assert rows[i]["base_score"] == pytest.approx(score)
    held = [r for i, r in rows.items() if zlib.crc32(str(i).encode()) % 7 == 2]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_probabilities_sum_to_one(documents):
    training = documents.limit(40)
    counts = maxent.token_table(training)
    m = maxent.train(training, counts)
    v = m.vocabulary
    f = np.random.default_rng(0).integers(0, maxent.BUCKETS, (maxent.FEATURES, 5)).astype(np.uint16)
    p = np.exp(maxent.log_softmax(m.class_scores(f)))
    assert np.allclose(p.sum(1), 1, atol=1e-5)
    inside = np.bincount(v.cls, weights=v.count / np.bincount(v.cls, weights=v.count, minlength=maxent.CLASSES)[v.cls],
                         minlength=maxent.CLASSES)
    used = np.flatnonzero(inside)
    assert np.allclose(inside[used], 1)
    rest = (v.rest_count + v.rest_words + 1) / (v.rest_count + v.rest_words + 1)  # known words plus the unknown one
    assert np.allclose(rest, 1)


def test_gradient_matches_numeric():
    rng = np.random.default_rng(1)
    w = rng.normal(0, 0.1, (maxent.BUCKETS, maxent.CLASSES)).astype(np.float64)
    v = maxent.Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8), np.zeros(8), np.zeros(8))
    f, cls = np.array([[3, 5, 3], [7, 7, 9], [1, 2, 3]], np.uint16), np.array([0, 4, 20])
    def loss(w):
        m = maxent.Model(v, w, np.zeros(maxent.CLASSES), 1, 1)
        return -maxent.log_softmax(m.class_scores(f))[np.arange(3), cls].mean()
    m = maxent.Model(v, w.copy(), np.zeros(maxent.CLASSES), 1, 1)
    square = np.full(w.shape, 1e-20)
    maxent.gradient_step(m, f, cls, square, np.full(maxent.CLASSES, 1e-20), 1e-12)
    for b, c in ((5, 4), (2, 7)):
        up = w.copy()
        up[b, c] += 1e-6
        assert abs((loss(up) - loss(w)) / 1e-6) == pytest.approx(math.sqrt(square[b, c]), rel=1e-3)


def test_history_stays_inside_documents():
    tok = np.arange(10, 17, dtype=np.uint64)
    one, two = maxent.history(tok, np.array([0, 1, 4]))
    s = int(maxent.START)
    assert one.tolist() == [s, s, 11, 12, s, 14, 15] and two.tolist() == [s, s, s, 11, s, s, 14]
    one, two = maxent.history(tok[:2], np.array([0, 1]))
    assert one.tolist() == [s, s] and two.tolist() == [s, s]


def test_edges(docs_of):
    df = docs_of([(1, None), (2, ""), (2, "a b a"), (2, "a b a"), (None, "c"), (5, "long " * 300_000)])
    training = df.where("doc_id = 2")
    _, out = run(df, training)
    rows = out.collect()
    assert sorted((r["doc_id"] or 0, r["n_tokens"], r["n_known"]) for r in rows) == [
        (0, 2, 1), (1, 1, 1), (2, 1, 1), (2, 4, 4), (2, 4, 4), (5, 300_001, 1)]
    assert all(np.isfinite(r["score"]) for r in rows)
    m, out = run(df, df.where("doc_id = 77"))
    assert m.total == 0 and all(r["n_known"] == 0 and r["base_score"] == 0 for r in out.collect())
    assert run(docs_of([]), training)[1].count() == 0


def test_vocabulary_lookup():
    rng = np.random.default_rng(2)
    tok = np.unique(rng.integers(0, 1 << 62, 5000, dtype=np.uint64))
    v = maxent.Vocabulary(tok, np.ones(len(tok)), np.zeros(len(tok), np.int8), np.zeros(8), np.zeros(8))
    v.index()
    other = np.setdiff1d(rng.integers(0, 1 << 62, 5000, dtype=np.uint64), tok)
    assert (v.find(tok) == np.arange(len(tok))).all() and (v.find(other) == -1).all()


def test_what_is_gathered_follows_the_corpus(documents):
    assert maxent.token_table(documents).count() > 1.5 * maxent.token_table(documents.where(F.col("doc_id") % 4 == 0)).count()
