"""Token alignment against a plain reading of its definition."""

import hashlib
import json
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from tabeval.llm import alignment as al


def read(path):
    with open(path, "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def sides():
    """Both tokenizers' own libraries: text -> [(id, bytes)], or None when the bytes differ."""
    slow = Tokenizer.from_file(al.BYTES_BPE)
    slow.encode_special_tokens = True
    alphabet = al.byte_alphabet()
    names = {i: t for t, i in json.loads(read(al.BYTES_BPE))["model"]["vocab"].items()}
    sp = sentencepiece.SentencePieceProcessor(model_file=al.PIECES)

    def piece(i):
        p = sp.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace("▁", " ").encode()

    def both(text):
        if not text:
            return [], []
        a = [(i, bytes(alphabet[c] for c in names[i])) for i in slow.encode(" " + text, add_special_tokens=False).ids]
        b = [(i, piece(i)) for i in sp.encode(text)]
        raw = f" {text}".encode()
        same = all(b"".join(x for _, x in side) == raw for side in (a, b))
        return (a, b) if same else ([], [])
    return both


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(rows, sides):
    """rows (id, text) -> [(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups)]"""
    seen, counts = [], Counter()
    for i, text in rows:
        a, b = map(spans, sides(text))
        links, k = [], 0
        for x, s, e in a:
            while b and b[k][2] <= s:
                k += 1
            j = k
            while j < len(b) and b[j][1] < e:
                links.append((x, b[j][0]))
                j += 1
        cuts = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, s = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, _, e in a if s < e <= c) + "|" + ",".join(str(x) for x, _, e in b if s < e <= c)
                          if len(a) < 3000 else None)
            s = c
        counts.update(links)
        seen.append((i, len(a), len(b), len(cuts), links, ";".join(groups) if len(a) < 3000 else None))
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    return sorted(((i, na, nb, ng, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), g)
                   for i, na, nb, ng, links, g in seen), key=str)


def got(df, tmp, want, frequent=al.FREQUENT):
    from tabeval.llm.common import saved
    aligned = saved(al.align(df), "aligned_test")
    out = al.scored(aligned, saved(al.pair_counts(aligned), "counts_test"), frequent).collect()
    long = {w[0] for w in want if w[-1] is None}
    return sorted(((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, None if r.doc_id in long else r.groups)
                   for r in out), key=str)


def test_documents_match_brute_force(documents, sides):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute(rows, sides)
    assert got(documents, None, want) == want
    assert sum(w[1] > 0 for w in want) > len(rows) * 0.9


@pytest.mark.parametrize("frequent", [0, 3, 200, al.FREQUENT])
def test_edges_and_rare_pairs(docs_of, sides, frequent):
    rows = [(1, None), (2, ""), (3, " "), (4, "it's <|endoftext|> <s> </s> <unk> <0x41>"), (5, "a▁b keeps no tokens"),
            (6, "日本語テキスト 🙂🙂 é é"), (7, "tab\tnew\n\n  line \r\n   x"), (8, "\x00\x01 z"), (9, "՘֋ \U0003fc3d x"),
            (10, "same words same words"), (11, "same words same words"), (12, " " * 700 + "x"), (13, "Ⅷ ﬁ ½")]
    df = docs_of(rows).selectExpr("*", "1 AS n_a", "2 AS groups", "3 AS pairs", "4 AS _row", "5 AS n_best")
    want = brute(rows, sides)
    assert got(df, None, want, frequent) == want
    assert {w[0]: w[1] for w in want}[5] == 0


def test_repeats_null_ids_empty_and_long(docs_of, sides):
    rows = [(None, "one two"), (3, "one two"), (3, "one two"), (4, "several words of a long text " * 40_000)]
    want = brute(rows, sides)
    assert got(docs_of(rows), None, want) == want
    assert got(docs_of([]), None, []) == []
    assert got(docs_of([(1, None)]), None, []) == [(1, 0, 0, 0, 0, 0, 0, "")]


def test_fast_and_slow_sides_agree(documents):
    side = al.ByteSide(read(al.BYTES_BPE))
    texts = [r.text or "" for r in documents.collect()]
    texts += ["".join(chr(c) for c in range(k, k + 40) if not 0xD800 <= c < 0xE000) for k in range(32, 0x30000, 211)]
    fast = 0
    for t in texts:
        if side.plain(" " + t):
            fast += 1
            assert side.fast(" " + t) == side.slow.encode(" " + t, add_special_tokens=False).ids
    assert fast > len(texts) // 2


def test_pieces_by_segment_equal_whole_texts(documents, monkeypatch):
    side = al.PieceSide(read(al.PIECES))
    assert not side.whole
    texts = [r.text or "" for r in documents.collect()] + ["", " ", "   ", "a  b   c ", "  x\n  y\t z", "日本 語 🙂 🙂", "a" * 200 + " " * 90 + "b"]
    monkeypatch.setattr(al, "KEPT", 50)
    for k in range(0, len(texts), 40):
        part = texts[k:k + 40]
        got = side.ids(part)
        assert [x.tolist() for x in got] == side.model.encode(part)
    by_segment = [x.tolist() for x in side.ids(texts[-7:])]
    side.whole, side.memo = True, {}
    assert [x.tolist() for x in side.ids(texts[-7:])] == by_segment
    assert side.ids(["a▁b"]) == [None]


def test_query_digest(spark, sf_dir, documents):
    from tabeval.llm.queries import QUERIES
    rows = {r.doc_id: r for r in QUERIES["op13_alignment"](spark, sf_dir).collect()}
    for r in al.align(documents).collect():
        want = hashlib.sha256(r.groups.encode()).hexdigest() if r.n_a else ""
        assert rows[r.doc_id].groups_sha256 == want
