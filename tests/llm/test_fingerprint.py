"""Fingerprints against a one-process computation over the sorted documents."""

import hashlib

import pytest

from tabeval.llm import fingerprint as fp


def brute(rows):
    """rows sorted by id -> id: (n_chars, edited sha, digest, edited digest, near_edited, near_next)"""
    d, out = fp.Digester(), []
    for k, (i, t) in enumerate(rows):
        t, nxt = t or "", rows[(k + 1) % len(rows)][1] or ""
        q = len(t) // 4
        e = t[:len(t) - q] + (nxt[:q] if q else "")
        a, b, c = d.digest(t), d.digest(e), d.digest(nxt)
        out.append((i, len(t), hashlib.sha256(e.encode()).hexdigest(), fp.as_hex(a), fp.as_hex(b),
                    pytest.approx(fp.likeness(a, b)), pytest.approx(fp.likeness(a, c))))
    return out


def got(df):
    return [tuple(r) for r in fp.fingerprints(df).orderBy("doc_id").collect()]


def test_documents_match_brute_force(documents):
    rows = sorted((r["doc_id"], r["text"]) for r in documents.collect())
    assert got(documents) == brute(rows)
    assert got(documents.repartition(7)) == brute(rows)


def test_small_tables(docs_of):
    assert got(docs_of([])) == []
    for rows in ([(5, "alone in the table")], [(1, None), (3, ""), (9, "héllo wörld" * 9)],
                 [(i, "x" * i) for i in range(40)], [(1, "a" * 3_000_000), (2, "b c d e f " * 200_000)]):
        assert got(docs_of(rows)) == brute(rows)


def test_null_ids_ties_and_repeated_rows_keep_their_rows(docs_of):
    df = docs_of([(None, "first text here"), (7, "same same same"), (7, "same same same"), (7, "other text of seven"), (8, None)])
    rows = got(df)
    assert sorted((r[0] or 0) for r in rows) == [0, 7, 7, 7, 8]
    assert len({r[3] for r in rows if r[1] == 14}) == 1


def test_digest_properties(documents):
    d = fp.Digester()
    texts = [r["text"] for r in documents.limit(60).collect()]
    for t in texts:
        a = d.digest(t)
        assert (fp.from_hex(fp.as_hex(a)) == a).all() and fp.likeness(a, a) == 1.0
    near = [fp.likeness(d.digest(t), d.digest(t[:-20] + " changed a little")) for t in texts if len(t) > 1000]
    far = [fp.likeness(d.digest(a), d.digest(b)) for a, b in zip(texts, texts[1:])]
    assert min(near) > 0.7 and sum(far) / len(far) < 0.6
    a, b = fp.Digester().counts(b"abc" * 500_000), fp.Digester().counts(b"abc" * 500_000)
    assert (a == b).all() and a.sum() == 6 * (1_500_000 - 4)
