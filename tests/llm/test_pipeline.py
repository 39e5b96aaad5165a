"""The pipeline stage by stage against brute force, then as a whole."""

import brute
import corpus_pipeline as cp
from tabeval.llm import langid, pieces, secretscan
from tabeval.llm.common import held_out
from test_packing import check


def rows(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_stages(spark, documents):
    sf = "/root/testdata/sf0.001"
    assert [n for n, _ in cp.STAGES] == ["language", "near_duplicates", "decontamination", "secrets", "pack"]
    stage = dict(cp.STAGES)
    docs = documents
    out = stage["language"](spark, docs, sf)
    assert out.columns == docs.columns
    judged = langid.identify(docs, langid.learn(docs.where(~held_out("doc_id", 5, 0)))).collect()
    assert set(rows(out)) == {r["doc_id"] for r in judged if r["lang_pred"] != "und"}
    docs = out.cache()
    best = brute.components(rows(docs))
    out = stage["near_duplicates"](spark, docs, sf).cache()
    assert out.columns == docs.columns and set(rows(out)) == {i for i, b in best.items() if i == b}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    bad = brute.contamination(rows(out), items)
    docs, out = out, stage["decontamination"](spark, out, sf).cache()
    assert out.columns == docs.columns and rows(out) == {i: t for i, t in rows(docs).items() if not bad[i][4]}
    docs, out = out, stage["secrets"](spark, out, sf).cache()
    with open(secretscan.VOCABULARY, "rb") as f:
        scanner = secretscan.Scanner(f.read(), 2.2)
    assert out.columns == docs.columns
    assert rows(out) == {i: secretscan.masked(t, scanner.spans(t)) for i, t in rows(docs).items()}
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect())
    packed = [tuple(r) for r in stage["pack"](spark, out, sf).collect()]
    with open(pieces.MODEL, "rb") as f:
        counter = pieces.Counter(*pieces.vocabulary(f.read()))
    check(packed, [(i, counter.text(t)) for i, t in rows(out).items()], (512, 1024, 2048, 4096, 8192))


def test_run_and_edges(spark, docs_of, tmp_path):
    t = "the quick brown fox jumps over the lazy dog and the cat sat down on the mat "
    df = docs_of([(1, t, "en", "s", 1), (2, t, "en", "s", 1), (3, None, None, None, None), (4, "123", "en", "s", 3),
                  (None, "a text without an id token=abcdefgh", "en", "s", 4), (6, " ".join(f"w{k}" for k in range(30)), "en", "s", 1)])
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(f"w{k}" for k in range(30)))], "item_id long, text string").write.parquet(
        f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"] or 0, r["n_tokens"]) for r in cp.run(spark, str(tmp_path)).collect())
    with open(pieces.MODEL, "rb") as f:
        counter = pieces.Counter(*pieces.vocabulary(f.read()))
    assert got == [(0, counter.text("a text without an id [SECRET]")), (1, counter.text(t))]
    df.limit(0).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    assert cp.run(spark, str(tmp_path)).count() == 0


def test_documents_in_three_languages_stay_and_extra_columns_keep_their_values(spark, documents):
    """A third of the words each from three languages: no language has half of the text."""
    from pyspark.sql import functions as F
    by_lang = {}
    for r in documents.where("lang is not null and n_chars > 200").orderBy("doc_id").collect():
        by_lang.setdefault(r["lang"], " ".join(r["text"].split()[:80]))
    mixed = " ".join(list(by_lang.values())[:3])
    names = ["score", "Languages", "lang_pred", "row 0", "chosen row", "n_tokens", "spans", "piece", "contaminated"]
    own = spark.createDataFrame([(900_001, mixed, None, "s", len(mixed)), (900_002, "x" * 300_000 + " y", None, "s", 300_002),
                                 (900_003, None, None, None, None), (900_003, mixed, None, None, None)], documents.schema)
    docs = documents.unionByName(own).withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    sf = "/root/testdata/sf0.001"
    for name, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == [*documents.columns, *names], name
        docs = docs.cache()
        got = docs.where("doc_id >= 900001").collect()
        assert 900_001 in {r["doc_id"] for r in got}, name
        assert all(r[n] == f"{n}{r['doc_id']}" for r in docs.collect() for n in names), name
    assert cp.STAGES[-1][1](spark, docs, sf).where("doc_id = 900001").count() == 1
