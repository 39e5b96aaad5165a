"""The similarity join against all pairs, on the documents and on hard groups."""

import random

import numpy as np
import pytest

import brute
from tabeval.llm import jaccard


def got(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(df).collect()}


def want(docs):
    c = brute.components(docs)
    return {i: (len(brute.shingle_set(t)), c[i]) for i, t in docs.items()}


def test_documents_match_all_pairs(documents):
    docs = {r["doc_id"]: r["text"] for r in documents.collect()}
    expected = want(docs)
    assert got(documents) == expected
    assert len({c for _, c in expected.values()}) < len(docs)


def group(rng, base, copies, edits):
    out = []
    for _ in range(copies):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_groups_and_shared_passages(docs_of, seed):
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(40)]
    texts = group(rng, [f"a{k}" for k in range(150)], 60, 6) + group(rng, [f"b{k}" for k in range(30)], 20, 2)
    texts += [" ".join(f"c{k}" for k in range(s, s + 60)) for s in range(0, 60, 3)]  # a chain of overlaps
    texts += [" ".join(passage + [f"u{i}x{k}" for k in range(rng.randint(0, 60))]) for i in range(50)]
    texts += [" ".join(passage)] * 5
    rng.shuffle(texts)
    docs = dict(enumerate(texts))
    assert got(docs_of(list(docs.items())).repartition(4)) == want(docs)


def test_pages_of_one_template(docs_of, monkeypatch):
    """Pages that share a passage and differ in the rest: only few link, and lists are met by signature."""
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(100)]
    docs = {i: " ".join(passage + [f"u{i}x{k}" for k in range(rng.randint(12, 35))]) for i in range(400)}
    monkeypatch.setattr(jaccard, "ROUNDS", 0)
    assert got(docs_of(list(docs.items())).repartition(4)) == want(docs)


def test_remaining_pairs_are_those_of_the_bound(spark):
    """Classes with equal and other lists, in components, against all pairs."""
    rng = random.Random(6)
    lists = {c: (rng.randint(20, 26), rng.choice([c, 1, 2]), frozenset(rng.sample(range(12), rng.choice([3, 4, 9]))))
             for c in range(1, 60)}
    for c in range(60, 120):  # repeats of the first ones in other components
        n, _, keys = lists[c - 59]
        lists[c] = (n, rng.choice([c, 1]), keys)
    size = {k: sum(k in v[2] for v in lists.values()) for k in range(12)}
    now = spark.createDataFrame([(k, c, n, comp, size[k]) for c, (n, comp, keys) in lists.items() for k in keys],
                                "key long, class long, n long, component long, m long")
    found = [(min(r.x, r.y), max(r.x, r.y)) for r in jaccard.remaining_pairs(now, 75).collect()]
    assert len(found) == len(set(found))

    def least(a, b):
        return -(-(a + b) * 75 // 175) - (-(-max(a, b) * 75 // 100) - 1)

    wanted = {(x, y) for x, (nx, cx, kx) in lists.items() for y, (ny, cy, ky) in lists.items()
              if x < y and cx != cy and kx & ky and len(kx & ky) >= least(nx, ny)
              and 100 * min(nx, ny) >= 75 * max(nx, ny)}
    assert wanted and wanted <= set(found)
    assert all(len(lists[x][2] & lists[y][2]) >= least(lists[x][0], lists[y][0]) and lists[x][1] != lists[y][1]
               for x, y in found)


def test_edges(docs_of):
    docs = {1: None, 2: "", 3: " \n ", 4: "one two", 5: "One  TWO", 6: "one two three four five", 7: "one two three four five",
            8: "word " * 300_000, 9: "word " * 50, 10: "é è", 11: "two one"}
    assert got(docs_of(list(docs.items()))) == want(docs)
    assert got(docs_of([])) == {}


def test_repeated_rows_null_ids_and_columns(docs_of):
    from pyspark.sql import functions as F
    t = "a b c d e f g h i j k l"
    df = docs_of([(5, t), (5, t), (3, t), (None, t), (None, "unlike anything else here at all"), (9, None)])
    df = df.withColumn("n", F.lit(1)).withColumn("class", F.lit("mine")).withColumn("component_id", F.lit(0))
    rows = sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in jaccard.near_duplicates(df).collect())
    assert rows == [(0, 0), (0, 3), (3, 3), (5, 3), (5, 3), (9, 9)]
    kept = jaccard.one_of_each(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 0, 3, 9]


def test_small_portions_fragments_and_rounds(docs_of, monkeypatch):
    monkeypatch.setattr(jaccard, "HELD", 50)
    monkeypatch.setattr(jaccard, "FRAGMENT", 10)
    rng = random.Random(9)
    docs = dict(enumerate(group(rng, [f"a{k}" for k in range(80)], 40, 5) + group(rng, [f"b{k}" for k in range(80)], 5, 5)))
    assert got(docs_of(list(docs.items())).repartition(3)) == want(docs)


def test_prefix_bound():
    for n in range(1, 400):
        p = jaccard.prefix_length(n, 75)
        assert 1 <= p <= n and 100 * (n - p) < 75 * n <= 100 * (n - p + 1)


def test_frequent_shingles_come_last():
    level = np.zeros(jaccard.SKETCH, np.uint8)
    s = np.sort(np.random.default_rng(0).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
    level[int(s[0] & np.uint64(jaccard.SKETCH - 1))] = 3
    assert jaccard.order_keys(s, level)[-1] & np.uint64((1 << 60) - 1) == s[0] >> np.uint64(4)


def test_a_large_group_makes_no_pairs_of_all_members(docs_of, spark):
    rng = random.Random(3)
    base = [f"a{k}" for k in range(100)]
    docs = dict(enumerate(group(rng, base, 300, 1)))
    seen = []
    original = jaccard.verified
    def counting(pairs, sets, per_cent):
        seen.append(pairs.count())
        return original(pairs, sets, per_cent)
    jaccard.verified = counting
    try:
        out = got(docs_of(list(docs.items())))
    finally:
        jaccard.verified = original
    assert len({c for _, c in out.values()}) == len(set(brute.components(docs).values()))
    assert sum(seen) < 300 * 10  # all pairs would be 44,850


@pytest.mark.parametrize("per_cent", [75, 50, 60, 80, 90])
def test_no_linked_class_has_more_unmet_shingles_than_allowed(spark, per_cent):
    from pyspark.sql import functions as F
    top = 300 if per_cent == 75 else 100
    allowed = {r["id"]: r["m"] for r in spark.range(1, top).select(
        "id", jaccard.most_unmet(F.col("id"), per_cent).alias("m")).collect()}
    for nx in allowed:
        r = jaccard.reach(nx, per_cent)
        for ny in range(-(-per_cent * nx // 100), 100 * nx // per_cent + 1):
            s = jaccard.reach(ny, per_cent)
            for o in range(-(-per_cent * (nx + ny) // (100 + per_cent)), min(nx, ny) + 1):
                # u of x's own among the first r, all of y's own in front
                worst = max(u + max(0, r - u + ny - o - s) for u in range(min(nx - o, r) + 1))
                assert worst <= allowed[nx], (nx, ny, o)


def test_bound_on_unmet_by_every_order_of_small_sets(spark):
    from itertools import permutations

    from pyspark.sql import functions as F
    allowed = {r["id"]: r["m"] for r in spark.range(1, 9).select(
        "id", jaccard.most_unmet(F.col("id"), 75).alias("m")).collect()}
    for nx in range(1, 9):
        for ny in range(1, 11):
            for o in range(1, min(nx, ny) + 1):
                if 100 * o < 75 * (nx + ny - o):
                    continue
                for order in set(permutations("s" * o + "x" * (nx - o) + "y" * (ny - o))) if nx + ny - o <= 8 else []:
                    x = [k for k, c in enumerate(order) if c != "y"][:jaccard.reach(nx, 75)]
                    y = [k for k, c in enumerate(order) if c != "x"][:jaccard.reach(ny, 75)]
                    assert len(set(x) - set(y)) <= allowed[nx], (nx, ny, o, order)


def test_texts_of_seven_words_and_one_more(docs_of):
    docs = {}
    for k in range(60):
        w = [f"v{k}x{j}" for j in range(8)]
        docs[2 * k], docs[2 * k + 1] = " ".join(w), " ".join(w[1:] if k % 2 else w[:-1])
    expected = want(docs)
    assert len({c for _, c in expected.values()}) == 60
    assert got(docs_of(list(docs.items())).repartition(3)) == expected


def test_one_row_of_each_component(docs_of):
    def text(w):
        return " ".join(f"{w}{k}" for k in range(12))
    df = docs_of([(1, text("a")), (1, text("a")), (2, text("a")),  # a repeated representative
                  (3, text("b")), (3, text("c")), (2, text("c")),  # an id with two texts, one of them another's copy
                  *[(None, text("d"))] * 4, (None, text("e")), (7, None), (7, None), (8, None)]).repartition(3)
    rows = sorted((r["doc_id"] or 0, r["text"] or "") for r in jaccard.one_of_each(df).collect())
    assert rows == [(0, text("d")), (0, text("e")), (1, text("a")), (2, text("c")), (3, text("b")), (7, ""), (8, "")]
