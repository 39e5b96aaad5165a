"""Token counts equal to the tokenizers library's for the same vocabulary."""

import random

from tokenizers import Tokenizer, models, pre_tokenizers

from tabeval.llm import pieces


def library(vocab, byte_fallback):
    t = Tokenizer(models.Unigram(vocab, unk_id=0, byte_fallback=byte_fallback))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)  # whole-text Viterbi
    return lambda s: len(t.encode(s, add_special_tokens=False).ids)


def model():
    with open(pieces.MODEL, "rb") as f:
        return f.read()


def full_library():
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model())
    return library([(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size())], True)


SPACED = ["x        y", "def f(x):\n    return x\n        y = 1", " " * 40, "a" + " " * 33, " " * 17 + "b  c ", "é   日本  "]
TEXTS = [*SPACED, None, "", " ", "  two  spaces ", "line\nbreak\ttab", "▁mark ▁", "emoji 🙂🙂 x🙂y", "日本語テキスト", "ÀÉ ça", "\x00\x01", "a" * 5000]


def test_documents_match_the_library(documents):
    count = full_library()
    got = {r["doc_id"]: r for r in pieces.token_counts(documents).collect()}
    for r in documents.collect():
        assert got[r["doc_id"]]["n_tokens"] == count(r["text"]) and got[r["doc_id"]]["n_chars"] == len(r["text"])


def test_edges_match_the_library(docs_of):
    count = full_library()
    df = docs_of([(i, t) for i, t in enumerate(TEXTS)] + [(None, "same"), (3, "same"), (3, "same")])
    rows = pieces.token_counts(df).collect()
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"]) for r in rows) == sorted(
        [(i, count(t or "") if t else 0) for i, t in enumerate(TEXTS)] + [(-1, count("same"))] + [(3, count("same"))] * 2)
    assert pieces.token_counts(docs_of([])).count() == 0


def test_ties_and_unknowns_match_the_library():
    rng, compared = random.Random(5), 0
    for _ in range(400):
        vocab = {"".join(rng.choice("ab▁é") for _ in range(rng.randint(1, 3))): float(-rng.randint(1, 4)) for _ in range(6)}
        vocab = [("<unk>", 0.0), *vocab.items()]
        count, own = library(vocab, False), pieces.Counter(vocab[1:], False, min(s for _, s in vocab))
        for _ in range(10):
            s = "".join(rng.choice("abcé   ") for _ in range(rng.randint(1, 12)))
            assert own.text(s) == count(s), (s, vocab)
            compared += 1
    assert compared > 500


def test_memory_of_group_counts_is_bounded(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT", 10)
    c = pieces.Counter(*pieces.vocabulary(model()))
    text = " ".join(f"word{i}" for i in range(300))
    assert c.text(text) == full_library()(text) and len(c.memo) <= 10


def test_runs_of_spaces_match_the_model_file_itself():
    import sentencepiece
    own = sentencepiece.SentencePieceProcessor(model_proto=model())
    c, count = pieces.Counter(*pieces.vocabulary(model())), full_library()
    assert c.text("x        y") == len(own.encode("x        y")) == 3
    for k in range(1, 40):  # the file's own encoder merges pairs, which can take one piece more on long runs
        text = "x" + " " * k + "y"
        assert c.text(text) == count(text) <= len(own.encode(text)) and (k > 15 or c.text(text) == len(own.encode(text)))


def test_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    df = docs_of([(1, "two  words", "en", "s", 1)]).withColumn("n_tokens", F.lit("mine"))
    assert pieces.token_counts(df).first()["n_tokens"] == full_library()("two  words")
