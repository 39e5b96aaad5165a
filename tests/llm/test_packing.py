"""Packing: every token once, no overflow, least permitted capacity, and near the optimum."""

from collections import defaultdict

import pytest

from tabeval.llm import packing


def check(rows, lengths, capacities):
    """rows: (id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset); lengths: list of (id, n)."""
    bins, cover = defaultdict(list), defaultdict(list)
    for i, piece, start, n, b, cap, at in rows:
        cover[i].append((start, n))
        if n:
            bins[b].append((at, n, cap))
        else:
            assert b is None and cap is None and at is None
    for spans in bins.values():
        at = 0
        for o, n, cap in sorted(spans):
            assert o == at and cap == spans[0][2]
            at += n
        assert min(c for c in capacities if c >= at) == spans[0][2]
    for i, n in lengths:
        at = 0
        for s, m in sorted(cover[i]):
            assert s == at
            at += m
        assert at == n
    return bins


def test_documents_are_packed_whole(documents):
    lengths = packing.word_lengths(documents)
    want = {r["doc_id"]: len(r["text"].split(" ")) and len([w for w in __import__("re").split(r"[\x20\x09-\x0D]+", r["text"]) if w])
            for r in documents.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in lengths.collect()}
    assert got == want
    rows = [tuple(r) for r in packing.pack(lengths).collect()]
    bins = check(rows, list(want.items()), packing.CAPACITIES)
    paid = sum(packing.attention_cost(b[0][2]) for b in bins.values())
    floor = sum(want.values()) * min(packing.attention_cost(c) / c for c in packing.CAPACITIES)
    assert paid < 1.15 * floor


def test_words_of_long_texts(docs_of):
    texts = {1: "ab " * 700_000, 2: "x" * 2_500_000 + " y", 3: " lead", 4: None, 5: "é\x0bé"}
    got = {r["doc_id"]: r["n_tokens"] for r in packing.word_lengths(docs_of(list(texts.items()))).collect()}
    assert got == {1: 700_000, 2: 2, 3: 1, 4: 0, 5: 2}


def test_edges(spark):
    lengths = [(1, 0), (2, None), (3, 25), (None, 4), (5, 10), (6, 30), (7, 7)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    rows = [tuple(r) for r in packing.pack(df, capacities=(4, 10)).collect()]
    check(rows, [(i, n or 0) for i, n in lengths], (4, 10))
    assert len(rows) == 1 + 1 + 3 + 1 + 1 + 3 + 1
    assert packing.pack(df.limit(0)).count() == 0


def test_repeated_rows_are_packed_as_often(spark):
    df = spark.createDataFrame([(1, 6)] * 5, "doc_id long, n_tokens long")
    rows = packing.pack(df, capacities=(4, 10)).collect()
    assert len(rows) == 5 and len({(r["bin_id"], r["bin_offset"]) for r in rows}) == 5


def test_many_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 100)
    lengths = [(i, 1 + i * 7919 % 900) for i in range(2000)]
    df = spark.createDataFrame(lengths, "doc_id long, n_tokens long")
    rows = [tuple(r) for r in packing.pack(df).collect()]
    check(rows, lengths, packing.CAPACITIES)
    assert len({r[4] >> 32 for r in rows}) == 20


def optimum(lengths, capacities, cost):
    """Least cost by trying all assignments."""
    best = [float("inf")]
    def go(k, bins):
        paid = sum(min(cost(c) for c in capacities if c >= u) for u in bins)
        if paid >= best[0]:
            return
        if k == len(lengths):
            best[0] = paid
            return
        for b in range(len(bins)):
            if bins[b] + lengths[k] <= max(capacities):
                go(k + 1, bins[:b] + [bins[b] + lengths[k]] + bins[b + 1:])
        go(k + 1, bins + [lengths[k]])
    go(0, [])
    return best[0]


def test_query_packs_tokens_of_the_vocabulary(spark, docs_of, tmp_path):
    from tabeval.llm import pieces, queries
    texts = [(1, "aGVsbG8gd29ybGQ" * 8_000), (2, "a few ordinary words"), (3, "漢字" * 600), (4, None)]
    docs_of(texts).write.parquet(f"{tmp_path}/documents.parquet")
    want = {r["doc_id"]: r["n_tokens"] for r in pieces.token_counts(docs_of(texts)).collect()}
    assert want[1] > 8192 and want[3] > 512  # one word each
    rows = [tuple(r) for r in queries.op8_packing(spark, str(tmp_path)).collect()]
    check(rows, list(want.items()), packing.CAPACITIES)


@pytest.mark.parametrize("seed", range(6))
def test_close_to_the_optimum_on_small_inputs(seed):
    import random
    rng = random.Random(seed)
    caps, cost = (8, 16, 32), lambda c: c + 2
    lengths = sorted((rng.randint(1, 20) for _ in range(8)), reverse=True)
    _, _, sizes = packing.pack_shard(lengths, caps, cost)
    assert sum(map(cost, sizes)) <= 1.35 * optimum(lengths, caps, cost)
