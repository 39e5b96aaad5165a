"""Language identification: held-out accuracy, mixtures, and the batch inference against a
plain one-document computation."""

import numpy as np
import pyarrow as pa

from tabeval.llm import langid
from tabeval.llm.common import held_out


def plain(p, n, penalty, rounds, tries):
    """One document; p: entries x languages."""
    share = np.zeros(p.shape[1])
    single = (n[:, None] * np.log(p)).sum(0)
    share[single.argmax()] = 1
    fit = single.max()
    while True:
        slope = (n / (p @ share)) @ p - n.sum()
        slope[share > 0] = -np.inf
        best = (fit, share)
        for k in np.argsort(-slope, kind="stable")[:tries]:
            if slope[k] > 0:
                s = share * 0.8
                s[k] = 0.2
                for _ in range(rounds):
                    w = p * s
                    s = (w * (n / w.sum(1))[:, None]).sum(0) / n.sum()
                f = float(n @ np.log(p @ s))
                if f > best[0]:
                    best = (f, s)
        if best[0] - fit <= penalty * np.log(n.sum() + 1) or (best[1] > 0).all():
            return best[1] if best[0] - fit > penalty * np.log(n.sum() + 1) else share
        fit, share = best


def test_batch_inference_equals_plain():
    rng = np.random.default_rng(3)
    prob = rng.dirichlet(np.full(40, 0.3), 5)
    docs = []
    for k in range(30):
        mix = rng.dirichlet(np.full(5, 0.2))
        n = rng.multinomial(rng.integers(5, 400), mix @ prob).astype(float)
        at = np.flatnonzero(n)
        docs.append((at, n[at]))
    off = np.concatenate(([0], np.cumsum([len(a) for a, _ in docs])[:-1]))
    idx = np.concatenate([a for a, _ in docs])
    got = langid.infer(prob.T[idx], np.concatenate([n for _, n in docs]), off, 2.0, 10, 3)
    for g, (a, n) in zip(got, docs):
        np.testing.assert_allclose(g, plain(prob.T[a], n, 2.0, 10, 3), atol=1e-9)


def test_trigram_counts_cover_long_texts():
    g = langid.Trigrams()
    text = "abc def " * 400_000
    (_, at, n), = g.counts(pa.array([text]))
    (_, at1, n1), = g.counts(pa.array(["abc def " * 4]))
    assert set(at) == set(at1)
    # all eight trigrams of a period hold a letter in the middle or letters on both sides; the last
    # one of the text (letter, space, edge) does not
    assert n.sum() == len(text) - 1 and n1.sum() == 31


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("h", held_out("doc_id", 5, 0))
    out = langid.identify(docs, langid.learn(docs.where("NOT h"))).where("h").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.95
    assert all(0 <= r["score"] <= 1 and r["languages"][0] == r["lang_pred"] for r in out)


def test_edges(docs_of):
    en, fr = "the quick brown fox jumps over the lazy dog and the cat ", "le renard brun saute par dessus le chien et la forêt "
    train = docs_of([(1, en * 5, "en"), (2, fr * 5, "fr"), (3, None, "de"), (4, "x", None), (5, en * 3, "en")])
    p = langid.learn(train)
    assert p.languages == ["en", "fr"]
    df = docs_of([(1, None), (2, ""), (3, "123 ... 456"), (4, "the dog"), (4, "the dog"), (None, fr), (7, en * 40_000),
                  (8, en * 9 + fr * 9), (9, "é")])
    rows = {(r["doc_id"], r["text"]): r for r in langid.identify(df, p).collect()}
    for i, t in ((1, None), (2, ""), (3, "123 ... 456")):
        assert (rows[i, t]["lang_pred"], rows[i, t]["score"], rows[i, t]["languages"]) == ("und", 0.0, [])
    assert rows[4, "the dog"]["lang_pred"] == "en" and rows[None, fr]["lang_pred"] == "fr"
    assert rows[7, en * 40_000]["lang_pred"] == "en"
    assert set(rows[8, en * 9 + fr * 9]["languages"]) == {"en", "fr"}
    kept = langid.accepted(df, p)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 4, 7, 8, 9]


def test_nothing_learned_and_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    p = langid.learn(docs_of([]))
    assert p.languages == []
    df = docs_of([(1, "text")]).withColumn("score", F.lit(7)).withColumn("lang_pred", F.lit("mine"))
    r = langid.identify(df, p).first()
    assert (r["lang_pred"], r["score"]) == ("und", 0.0)
    assert langid.identify(docs_of([]), p).count() == 0


def test_letters_decide_on_signs_beyond_ascii(docs_of, monkeypatch):
    from pyspark.sql import functions as F
    p = langid.learn(docs_of([(1, "the quick brown fox → ", "en"), (2, "le renard brun ← ", "fr")]))
    df = docs_of([(1, "→→ ←← 12 ✓✓"), (2, "the fox"), (3, "١٢٣ ٤٥٦")])
    assert [r["doc_id"] for r in langid.accepted(df, p).collect()] == [2]
    monkeypatch.setattr(langid, "has_letter", lambda c: F.lit(True))  # such texts have trigrams and would be kept
    assert sorted(r["doc_id"] for r in langid.accepted(df, p).collect()) == [1, 2, 3]
