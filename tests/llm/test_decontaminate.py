"""Phrase and proximity matches against brute force."""

import random

import pytest

import brute
from tabeval.llm import decontaminate as dc


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def got(docs, items):
    out = dc.digests(dc.phrase_matches(docs, items))
    return [(r["doc_id"], (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"])) for r in out.collect()]


def agree(docs_of, spark, docs, items):
    assert sorted(got(docs_of(list(docs.items())), items_of(spark, items))) == sorted(brute.contamination(docs, items).items())


def test_documents_match_brute_force(documents, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    want = brute.contamination({r["doc_id"]: r["text"] for r in documents.collect()},
                               [(r["item_id"], r["text"]) for r in items.collect()])
    assert dict(got(documents, items)) == want
    assert any(v[4] for v in want.values())


def test_random_small_vocabularies(docs_of, spark):
    rng = random.Random(4)
    def text(n):
        return " ".join(rng.choice("abc") for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 14, 15, 20]))) for k in range(12)]
    docs = {k: text(rng.randint(0, 40)) for k in range(40)}
    for k in range(10):
        docs[100 + k] = text(10) + " " + items[k % 12][1] + " " + text(5)
    agree(docs_of, spark, docs, items)


def test_edges(docs_of, spark):
    passage = " ".join(f"w{k}" for k in range(20))
    docs = {1: None, 2: "", 3: "...", 4: passage, 5: "W0, w1; (w2) " + passage[9:], 6: passage + " " + passage,
            7: "pad " * 4000 + passage + " pad" * 4000, 8: " ".join(passage.split()[:12]), 9: "é w1 É"}
    items = [(1, passage), (1, passage), (2, passage), (None, "w0 w1 w2"), (3, None), (4, "?!"), (5, "é"), (6, "not there at all")]
    agree(docs_of, spark, docs, items)
    same = docs_of([(1, passage), (1, passage), (1, "other words"), (None, passage)])
    rows = sorted((r[0] or 0, r[1][1]) for r in got(same, items_of(spark, items)))
    assert rows == [(0, 20), (1, 0), (1, 20), (1, 20)]
    assert got(docs_of([]), items_of(spark, items)) == []
    assert [r[1][1] for r in got(docs_of([(1, passage)]), items_of(spark, []))] == [0]


def test_clean_keeps_columns_and_clean_rows(docs_of, spark):
    from pyspark.sql import functions as F
    passage = " ".join(f"w{k}" for k in range(20))
    df = docs_of([(1, passage), (2, "clean text"), (2, passage), (None, "clean text"), (3, None)])
    df = df.withColumn("key", F.lit("mine")).withColumn("words", F.lit(1)).withColumn("matches", F.lit(2))
    out = dc.clean(df, items_of(spark, [(1, passage)]))
    assert out.columns == df.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in out.collect()) == [(0, "clean text"), (2, "clean text"), (3, "")]


def near(docs, items, lists, slop):
    """All choices of positions of a window's rarest terms, by brute force."""
    import itertools
    freq = {}
    for t in docs.values():
        for w in brute.index_words(t):
            freq[w] = freq.get(w, 0) + 1
    out = set()
    for i, t in items:
        words = brute.index_words(t)
        for w in range(max(len(words) - 13 + 1, 1)):
            win = words[w:w + 13]
            if not win or any(x not in freq for x in win):
                continue
            best = sorted(range(len(win)), key=lambda o: (freq[win[o]], o))[:lists]
            for d, text in docs.items():
                dw = brute.index_words(text)
                shifts = [[p - o - w for p, x in enumerate(dw) if x == win[o]] for o in best]
                for c in itertools.product(*shifts):
                    if max(c) - min(c) <= slop:
                        out.add((d, str(i), w, min(c) + w))
    return out


@pytest.mark.parametrize("slop", [0, 2, 4])
def test_proximity(docs_of, spark, slop):
    rng = random.Random(slop)
    passage = [f"t{k}" for k in range(16)]
    docs = {k: " ".join(rng.choice(passage + ["x", "y"]) for _ in range(30)) for k in range(8)}
    for k in range(8):
        p = list(passage)
        for _ in range(k % 4):
            p.insert(rng.randint(1, 14), "extra")
        docs[20 + k] = " ".join(["lead", *p])
    items = [(1, " ".join(passage)), (2, "t3 t4 t5")]
    out = dc.proximity_matches(docs_of(list(docs.items())), items_of(spark, items), slop=slop)
    assert {tuple(r) for r in out.collect()} == near(docs, items, dc.RAREST, slop)


def test_shuffle_path_for_many_test_terms(docs_of, spark, monkeypatch):
    monkeypatch.setattr(dc, "SMALL", 3)
    passage = " ".join(f"w{k}" for k in range(20))
    agree(docs_of, spark, {1: passage, 2: "w1 w2 w3", 3: passage[:40]}, [(1, passage), (2, "w1 w2")])


def test_plan_has_no_python(documents, spark):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = dc.digests(dc.phrase_matches(documents, items))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
