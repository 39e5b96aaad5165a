"""Byte-level BPE against the tiktoken library and by round trips."""

import base64
import random

import numpy as np
import pytest
import tiktoken

from tabeval.llm import bytebpe as bp


def file():
    with open(bp.VOCABULARY, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("t", pat_str=bp.PATTERN, mergeable_ranks=bp.ranks_of(file()), special_tokens={}).encode_ordinary


@pytest.fixture(scope="module")
def encoder():
    return bp.Encoder(file(), bp.written_out())


def ids(encoder, text):
    return np.frombuffer(encoder.texts([text])[0], "<u4").tolist()


TEXTS = ["", " ", "  ", "a", "it's we'LL 's'", "tab\tnew\n\n  line \r\n", "x  　 y z\x1c\x1f", "12 345 ½ ٣", "日本語テキスト", "🙂🙂 é é",
         "<|endoftext|> <|endoftext|>", "\x00\x01\x7f", "a" * 70, "ab" * 200, "՘֋﷐\U0001fbf9\U0003fc3d", "ﬁ ǅ ʰ ⅷ", " !!  ?? ...", "abc" * 21 + "d"]


def test_documents_match_the_library(documents, library):
    rows = {r.doc_id: r.text for r in documents.collect()}
    out = bp.decode(bp.encode(documents)).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.ids == library(rows[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert bytes(r.decoded).decode() == (rows[r.doc_id] or "")


def test_edges_match_the_library(encoder, library):
    for t in TEXTS:
        assert ids(encoder, t) == library(t), t
        assert [x for m in encoder.split(t) for x in encoder.merged(m.encode())] == library(t), t  # one by one
    assert ids(encoder, " " * 3000 + "x") == library(" " * 3000 + "x")


def test_long_runs(encoder, library):
    assert ids(encoder, "ab" * 100_000) == library("ab" * 100_000)
    long = ids(encoder, " " * 1_000_000 + "x")  # more than the library's own splitter can take
    vocabulary = {r: b for b, r in encoder.ranks.items()}
    assert b"".join(vocabulary[i] for i in long) == b" " * 1_000_000 + b"x"


def plain_merge(ranks, piece):
    """Leftmost pair of least rank, by looking at all pairs each time."""
    parts = [bytes([b]) for b in piece]
    while True:
        r, i = min(((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))), default=(1 << 40, 0))
        if r == 1 << 40:
            return [ranks[p] for p in parts]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]


def test_made_up_vocabularies(monkeypatch):
    monkeypatch.setattr(bp, "TOGETHER", 50)
    rng = random.Random(3)
    for _ in range(30):
        tokens, grown = [bytes([b]) for b in range(256)], [b"a", b"b", b"c"]
        for _ in range(rng.randint(0, 40)):
            t = rng.choice(grown) + rng.choice(grown)
            if t not in tokens:
                grown.append(t)
                tokens.append(t)
        tail = tokens[256:]
        rng.shuffle(tail)  # ranks need not follow lengths
        vocabulary = b"\n".join(base64.b64encode(t) + b" %d" % k for k, t in enumerate(tokens[:256] + tail))
        e = bp.Encoder(vocabulary, r"[a-c]+|[^a-c]")
        words = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 17, 40, 64, 65, 90)))) for _ in range(150)]
        want = [[e.ranks[w.encode()]] if w.encode() in e.ranks else plain_merge(e.ranks, w.encode()) for w in words]
        assert [np.frombuffer(x, "<u4").tolist() for x in e.texts(words)] == want
        assert [[e.ranks[w.encode()]] if w.encode() in e.ranks else e.merged(w.encode()) for w in words] == want


def test_memory_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bp, "KEPT", 100)
    e = bp.Encoder(file(), bp.written_out())
    for k in range(20):
        t = " ".join(f"word{k}x{j}" for j in range(60))
        assert ids(e, t) == library(t) and len(e.memo) <= 140


def test_rows_nulls_repeats_clashes_and_batches(monkeypatch, docs_of, library):
    rows = [(1, None), (2, ""), (None, "same text"), (3, "same text"), (3, "same text"), (4, "long words here " * 150_000)]
    df = docs_of(rows).selectExpr("*", "1 AS ids", "2 AS n_tokens", "3 AS decoded")
    for packed in (False, True):
        out = bp.decode(bp.encode(df, packed=packed)).collect()
        assert sorted(((r.doc_id or 0), r.n_tokens) for r in out) == sorted(((i or 0), len(library(t or ""))) for i, t in rows)
        assert sorted(bytes(r.decoded).decode() for r in out) == sorted(t or "" for _, t in rows)
    assert bp.decode(bp.encode(docs_of([]))).collect() == []
    null = df.sparkSession.createDataFrame([(1, None), (2, [1, 2])], "doc_id long, ids array<int>")
    assert [r.n_tokens for r in bp.decode(null).orderBy("doc_id").collect()] == [0, 2]
    with pytest.raises(Exception, match="KeyError"):
        bp.decode(df.sparkSession.createDataFrame([(1, [99_999_999])], "doc_id long, ids array<int>")).collect()


def test_runs():
    sizes = [3 << 20, 3 << 20, 9 << 20, 1, 2]
    assert [len(x) for x in bp.runs(iter(sizes), lambda x: x)] == [3, 2]
