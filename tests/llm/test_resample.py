"""Importance resampling against a plain computation and the SQL oracle."""

import hashlib
import math
import zlib
from collections import Counter

import pytest
from brute import index_words

from tabeval.llm import resample as rs
from tabeval.llm.common import partitions


def grams(text, n_max):
    w = index_words(text)
    return [" ".join(w[k:k + n]) for n in range(1, n_max + 1) for k in range(len(w) - n + 1)]


def brute(rows, target, ngram=1, buckets=10_000, min_words=20, percent=10):
    """rows (id, text) -> sorted rows (id, n_words, n_features, weight, score, rank)"""
    def bucket(g):
        return zlib.crc32(g.encode()) % buckets
    s = Counter(bucket(g) for _, t in rows for g in grams(t, ngram))
    t = Counter(bucket(g) for x in target for g in grams(x, ngram))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        gs = grams(text, ngram)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets))))
                     for b in map(bucket, gs))
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(index_words(text)), len(gs), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    for k, r in enumerate(able[:len(able) * percent // 100]):
        r[5] = k + 1
    return sorted(map(tuple, out), key=str)


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_documents_match_brute_force(spark, documents, sf_dir):
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    texts = [r.text for r in target.collect()]
    assert got(rs.resample(documents, target)) == brute(rows, texts)
    spread = documents.repartition(7)
    assert got(rs.resample(spread, target, ngram=2, buckets=500, percent=35)) == brute(rows, texts, 2, 500, percent=35)


EDGES = [(1, None), (2, ""), (3, "A b C " * 20), (4, "\0one\0two " * 30), (5, "ÀÉ été 日本語 ĳ " * 8), (6, "it's e-mail x_y " * 9),
         (7, "last first"), (8, "first last"), (-9, "word " * 20), (10, "word " * 19)]


def test_edges(spark, docs_of):
    target = docs_of([(1, "word two été"), (2, None)])
    texts = [r.text for r in target.collect()]
    rows = EDGES + [(11, "long text of words " * 400_000)]
    for ngram in (1, 3):
        assert got(rs.resample(docs_of(rows), target, ngram=ngram, percent=60)) == brute(rows, texts, ngram, percent=60)
    assert got(rs.resample(docs_of([]), target)) == []
    assert got(rs.resample(docs_of(rows), docs_of([]))) == brute(rows, [])


def test_runs_do_not_cross_documents(monkeypatch, docs_of):
    monkeypatch.setattr(rs, "SLICE", 10)
    f = rs.features([b"a b", b"", b"c", b"D e f"], 2, 1 << 30)
    assert f.words.tolist() == [2, 0, 1, 3] and f.doc.tolist() == [0, 0, 0, 2, 3, 3, 3, 3, 3]
    assert [x for x in rs.slices(__import__("pyarrow").array(["aaaaaaaa", "bbbbbbbbbbbb", None, "c"]))] == [
        [b"aaaaaaaa"], [b"bbbbbbbbbbbb"], [b"", b"c"]]


def test_repeated_rows_null_ids_and_clashing_columns(spark, docs_of):
    text = " ".join(f"w{k % 7}" for k in range(25))
    rows = [(None, text)] * 3 + [(5, text)] * 40 + [(6, text + " more")]
    df = docs_of(rows).selectExpr("doc_id", "text", "1 AS score", "'x' AS rank", "2 AS _row", "3 AS n_words", "4 AS weight")
    out = rs.resample(df, docs_of([(1, "w1")]), percent=50).collect()
    want = brute(rows, ["w1"], percent=50)
    assert sorted((str(r.doc_id), r.weight, r.score) for r in out) == sorted((str(r[0]), r[3], r[4]) for r in want)
    assert sorted(r["rank"] for r in out if r["rank"] is not None) == list(range(1, 23))
    ranked = sorted((r for r in out if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r.score for r in ranked] == sorted((r.score for r in out), reverse=True)[:22]


def test_ranges_and_counts_over_many_tasks(spark, docs_of, monkeypatch):
    rows = [(k, " ".join(f"w{(k * j) % 11}" for j in range(21))) for k in range(400)]
    df = docs_of(rows).repartition(70)
    assert partitions(df) == 70
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert got(rs.resample(df, docs_of([(1, "w1 w2")]), percent=73)) == brute(rows, ["w1 w2"], percent=73)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_percent_bounds(docs_of):
    rows = [(k, "word " * 20) for k in range(10)]
    for percent, n in ((0, 0), (9, 0), (10, 1), (100, 10)):
        out = rs.resample(docs_of(rows), docs_of([]), percent=percent).collect()
        assert sum(r["rank"] is not None for r in out) == n
    with pytest.raises(Exception):
        rs.resample(docs_of(rows), docs_of([]).drop("text")).collect()
