"""Language-model scoring with a hashed maximum-entropy model.

P(token | history) = P(class | history) * P(token | class).  The class softmax has hashed
features of the history (the word before, the two words before, the word before that as a
skip) with one weight per bucket and class; it is trained by distributed gradient updates:
in each round every task takes steps over its own share of the training texts and the
weights are averaged.  The softmax inside a class has only the word's own bias, whose
maximum-likelihood weights are its log counts.

Frequent words get their class from the words they follow (clustered context counts); the
rest from their spelling.  Class, feature and word tables have fixed sizes; the counts of
all other words stay distributed and are joined to the texts that need them.

Null counts as the empty text, whose only token is the end.  Texts are read whole.  Rows
with the same id are scored one by one.  With nothing to learn from, every token is unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import blocks, gathered, pack, partitions, saved, sum_blocks, task_number
from tabeval.llm.words import U64, WordHasher, doc_slices, mix, text_buffers

HEAD = 1 << 18  # most words that are kept in every task
CONTEXT = 32  # most frequent words whose followers are counted
CLUSTERS = 16
SPELLINGS = 8
CLASSES = 1 + CLUSTERS + SPELLINGS  # class 0 is the end of a text
BUCKETS = 1 << 15
FEATURES = 3
BLOCK = 1 << 16
HELD = 2_000_000  # tokens a task counts before it sends them on
STEP = 1 << 15  # tokens in a gradient step
END, START = U64(0x0E4D), U64(0x57A7)
ROUNDS = 2


def spelling(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Spelling class (0-7) of words: a letter beyond ASCII or not, and the last byte."""
    wide = np.concatenate(([0], np.cumsum(b >= 128)))
    return ((b[ends - 1] & 3) + 4 * (wide[ends] > wide[starts])).astype(np.int8)


class Tokens:
    """Token hashes of documents with their ends; built inside a task."""

    def __init__(self) -> None:
        self.hasher = WordHasher()

    def slices(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(first document, token hashes, spelling classes, first token of each document); each
        document's last token is the end."""
        data, off = text_buffers(col)
        for i, j in doc_slices(off):
            b, cuts = data[off[i]:off[j]], off[i:j + 1] - off[i]
            s, e = self.hasher.bounds(b, cuts)
            w = np.searchsorted(s, cuts)
            n = len(s) + j - i
            ends = w[1:] + np.arange(j - i)
            word = np.ones(n, bool)
            word[ends] = False
            tok, cls = np.full(n, END, U64), np.zeros(n, np.int8)
            tok[word] = self.hasher.hashes(b, s, e)
            if len(s):
                cls[word] = spelling(b, s, e)
            yield i, tok, cls, w[:-1] + np.arange(j - i)


def history(tok: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before and the one before that, START beyond a document's beginning."""
    one, two = np.roll(tok, 1), np.roll(tok, 2)
    one[first] = START
    two[first] = START
    after = first[:-1] + 1 if len(first) and first[-1] + 1 >= len(tok) else first + 1
    two[after] = START
    return one, two


def features(tok: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Bucket numbers (FEATURES x tokens)."""
    one, two = history(tok, first)
    shift = U64(64 - 15)
    return np.stack([mix(one) >> shift, mix(one * U64(0x9E3779B97F4A7C15) + two) >> shift,
                     mix(two ^ U64(0xD1B54A32D192ED03)) >> shift]).astype(np.uint16)


def token_table(docs: DataFrame) -> DataFrame:
    """Saved rows (token, spelling, c): the tokens of ``docs`` (text) with their counts."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, held, size = Tokens(), [], 0

        def flush() -> pa.RecordBatch:
            tok = np.concatenate([x[0] for x in held])
            own, at, n = np.unique(tok, return_index=True, return_counts=True)
            cls = np.concatenate([x[1] for x in held])[at]
            return pa.RecordBatch.from_arrays([pa.array(own.view(np.int64)), pa.array(cls), pa.array(n.astype(np.int64))],
                                              ["token", "spelling", "c"])

        for b in batches:
            for _, tok, cls, _ in t.slices(b.column(0)):
                held.append((tok, cls))
                size += len(tok)
                if size >= HELD:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    sent = docs.select("text").mapInArrow(count, "token long, spelling byte, c long")
    return saved(sent.groupBy("token", "spelling").agg(F.sum("c").alias("c")), "tokens")


@dataclass
class Vocabulary:
    """The frequent words: hashes by descending count, their counts and classes, and per spelling
    class the count and number of all other words."""

    token: np.ndarray
    count: np.ndarray
    cls: np.ndarray
    rest_count: np.ndarray
    rest_words: np.ndarray

    def plain(self) -> tuple:
        """The fields, for a broadcast (whose pickles need the package where they are read)."""
        return self.token, self.count, self.cls, self.rest_count, self.rest_words

    def index(self) -> None:
        """Hash table with open addressing from token to place."""
        self.slots = np.full(1 << 20, -1, np.int32)
        todo, at = np.arange(len(self.token)), (self.token & U64((1 << 20) - 1)).astype(np.int64)
        while len(todo):
            free = self.slots[at[todo]] < 0
            self.slots[at[todo[free]]] = todo[free]  # of several the last stays
            lost = self.slots[at[todo]] != todo
            todo = todo[lost]
            at[todo] = (at[todo] + 1) & ((1 << 20) - 1)

    def find(self, tok: np.ndarray) -> np.ndarray:
        """Place of each token among the frequent words, -1 for others."""
        out = np.full(len(tok), -1, np.int32)
        todo, at = np.arange(len(tok)), (tok & U64((1 << 20) - 1)).astype(np.int64)
        while len(todo):
            s = self.slots[at]
            hit = s >= 0
            same = np.zeros(len(s), bool)
            same[hit] = self.token[s[hit]] == tok[todo[hit]]
            out[todo[same]] = s[same]
            go = hit & ~same
            todo, at = todo[go], (at[go] + 1) & ((1 << 20) - 1)
        return out

    def classes(self, place: np.ndarray, cls: np.ndarray, tok: np.ndarray) -> np.ndarray:
        out = np.where(place >= 0, self.cls[place] if len(self.cls) else 0, 1 + CLUSTERS + cls)
        out[tok == END] = 0
        return out


def frequent(counts: DataFrame, most: int = HEAD) -> Vocabulary:
    """The words counted at least 2^j times, for the least j that keeps at most ``most``."""
    power = F.floor(F.log2(F.col("c").cast("double"))).cast("int")
    by = {r["p"]: r["n"] for r in counts.groupBy(power.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    low, total = 64, 0
    while low > 0 and total + by.get(low - 1, 0) <= most:
        low -= 1
        total += by.get(low, 0)
    head = counts.where(F.col("c") >= 2 ** low).select("token", "c").toPandas() if total else None
    rest = counts.where(F.col("c") < 2 ** low).groupBy("spelling").agg(
        F.sum("c").alias("c"), F.count(F.lit(1)).alias("n")).collect()
    rc, rn = np.zeros(SPELLINGS), np.zeros(SPELLINGS)
    for r in rest:
        rc[r["spelling"]], rn[r["spelling"]] = r["c"], r["n"]
    tok = head["token"].to_numpy(np.int64).view(U64) if total else np.zeros(0, U64)
    c = head["c"].to_numpy(np.int64) if total else np.zeros(0, np.int64)
    order = np.lexsort((tok, -c))
    return Vocabulary(tok[order], c[order], np.zeros(total, np.int8), rc, rn)


def contexts(docs: DataFrame, vocabulary: Vocabulary) -> np.ndarray:
    """How often each frequent word follows each of the CONTEXT most frequent ones."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary.plain())
    size = len(vocabulary.token) * CONTEXT

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, v = Tokens(), Vocabulary(*sent.value)
        v.index()
        total, held, n = np.zeros(size, np.uint32), [], 0

        def add() -> None:
            if held:
                np.add(total, np.bincount(np.concatenate(held), minlength=size), out=total, casting="unsafe")
                held.clear()

        for b in batches:
            for _, tok, _, first in t.slices(b.column(0)):
                place = v.find(tok)
                before = np.roll(place, 1)
                before[first] = -1
                ok = (place >= 0) & (before >= 0) & (before < CONTEXT)
                held.append(place[ok].astype(np.int64) * CONTEXT + before[ok])
                n += int(ok.sum())
                if n >= HELD:
                    add()
                    n = 0
        add()
        out = blocks(total, BLOCK)
        yield part_rows(out)

    parts = docs.select("text").mapInArrow(count, "part int, block int, data binary")
    return gathered(sum_blocks(parts, partitions(docs), "uint32"), size, BLOCK, "uint32").reshape(-1, CONTEXT)


def part_rows(out: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([task_number()] * len(out), pa.int32()), pa.array([k for k, _ in out], pa.int32()),
         pa.array([x for _, x in out], pa.binary())], ["part", "block", "data"])


def cluster(follows: np.ndarray, count: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Clusters (0..CLUSTERS-1) of words by the direction of their context counts."""
    if not len(follows):
        return np.zeros(0, np.int8)
    x = follows / np.maximum(follows.sum(0), 1)
    x = np.sqrt(x)
    length = np.sqrt((x * x).sum(1))
    x = np.where(length[:, None] > 0, x / np.maximum(length, 1e-300)[:, None], 1 / np.sqrt(CONTEXT))
    some, weight = x[:4096], np.sqrt(count[:4096].astype(np.float64))
    centre = [some[0]]
    for _ in range(CLUSTERS - 1):  # the word least like the chosen ones, by weight
        far = (1 - np.max(some @ np.array(centre).T, axis=1)) * weight
        centre.append(some[int(far.argmax())])
    centre = np.array(centre)
    for _ in range(rounds):
        own = (some @ centre.T).argmax(1)
        for k in range(CLUSTERS):
            if (own == k).any():
                m = (some[own == k] * weight[own == k, None]).sum(0)
                centre[k] = m / max(np.sqrt(m @ m), 1e-300)
    return (x @ centre.T).argmax(1).astype(np.int8)


@dataclass
class Model:
    vocabulary: Vocabulary
    weight: np.ndarray  # BUCKETS x CLASSES
    bias: np.ndarray
    total: int  # training tokens
    distinct: int

    def plain(self) -> tuple:
        return self.vocabulary.plain(), self.weight, self.bias, self.total, self.distinct

    @staticmethod
    def of(plain: tuple) -> Model:
        v = Vocabulary(*plain[0])
        v.index()
        return Model(v, plain[1].copy(), plain[2].copy(), *plain[3:])

    def class_scores(self, f: np.ndarray) -> np.ndarray:
        z = self.weight[f[0]]
        for k in range(1, FEATURES):
            z += self.weight[f[k]]
        z += self.bias
        return z


def log_softmax(z: np.ndarray) -> np.ndarray:
    z -= z.max(1, keepdims=True)
    z -= np.log(np.exp(z).sum(1, keepdims=True))
    return z


def gradient_step(m: Model, f: np.ndarray, cls: np.ndarray, square: np.ndarray, bias_square: np.ndarray, rate: float) -> None:
    """One AdaGrad step on the mean negative log-likelihood of the classes, in place."""
    n = len(cls)
    g = np.exp(log_softmax(m.class_scores(f)))
    g[np.arange(n), cls] -= 1
    g /= n
    for k in range(FEATURES):
        order = np.argsort(f[k], kind="stable")
        at = f[k][order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        s, own = np.add.reduceat(g[order], first, axis=0), at[first]
        square[own] += s * s
        m.weight[own] -= rate * s / np.sqrt(square[own])
    s = g.sum(0)
    bias_square += s * s
    m.bias -= rate * s / np.sqrt(bias_square)


def train_round(docs: DataFrame, m: Model, rate: float) -> Model:
    """Steps in every task from the weights of ``m`` over ``docs`` (text), averaged by tokens."""
    sent = docs.sparkSession.sparkContext.broadcast(m.plain())
    size = BUCKETS * CLASSES + CLASSES + 1

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, own = Tokens(), Model.of(sent.value)
        square, bias_square = np.full(own.weight.shape, 1e-7, np.float32), np.full(CLASSES, 1e-7, np.float32)
        seen = 0
        for b in batches:
            for _, tok, cls, first in t.slices(b.column(0)):
                f = features(tok, first)
                cls = own.vocabulary.classes(own.vocabulary.find(tok), cls, tok)
                for at in range(0, len(tok), STEP):
                    gradient_step(own, f[:, at:at + STEP], cls[at:at + STEP], square, bias_square, rate)
                seen += len(tok)
        flat = np.concatenate((own.weight.ravel() * seen, own.bias * seen, [seen])).astype(np.float32)
        yield part_rows([(k // BLOCK, pack(flat[k:k + BLOCK])) for k in range(0, size, BLOCK)] if seen else [])

    parts = docs.select("text").mapInArrow(learn, "part int, block int, data binary")
    total = gathered(sum_blocks(parts, partitions(docs), "float32"), size, BLOCK, "float32")
    if total[-1] <= 0:
        return m
    mean = total[:-1] / total[-1]
    return Model(m.vocabulary, mean[:-CLASSES].reshape(BUCKETS, CLASSES), mean[-CLASSES:].copy(), m.total, m.distinct)


def train(docs: DataFrame, counts: DataFrame, rounds: int = ROUNDS, rate: float = 0.1) -> Model:
    """``docs`` (text) are the training texts, ``counts`` their token table."""
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    v = frequent(counts)
    if len(v.token):
        v.cls = (1 + cluster(contexts(docs, v), v.count)).astype(np.int8)
        v.cls[v.token == END] = 0
    own = np.bincount(v.cls, weights=v.count, minlength=CLASSES)[:CLASSES] if len(v.token) else np.zeros(CLASSES)
    own[1 + CLUSTERS:] += v.rest_count
    bias = np.log((own + 1) / (own + 1).sum()).astype(np.float32)
    m = Model(v, np.zeros((BUCKETS, CLASSES), np.float32), bias, int(total[0]), int(total[1]))
    for r in range(rounds):
        m = train_round(docs.where(F.pmod(F.xxhash64("text"), F.lit(rounds)) == r), m, rate)
    return m


def score(docs: DataFrame, m: Model, counts: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, base_score (add-one unigram) and
    score (the model), both log10 of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(m.plain())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, own = Tokens(), Model.of(sent.value)
        v = own.vocabulary
        base_of = np.log10(v.count + 1.0)
        per_class = np.bincount(v.cls, weights=v.count, minlength=CLASSES) if len(v.token) else np.ones(CLASSES)
        word_of = np.log10(v.count / per_class[v.cls]) if len(v.token) else np.zeros(0)
        rest_of = -np.log10(v.rest_count + v.rest_words + 1)
        floor = -np.log10(own.total + own.distinct + 1)
        me, row = task_number() << 40, 0
        for b in batches:
            out = []
            for i, tok, spell, first in t.slices(b.column(1)):
                place = v.find(tok)
                cls = v.classes(place, spell, tok)
                known = place >= 0
                f = features(tok, first)
                lp = np.empty(len(tok))
                for at in range(0, len(tok), STEP):
                    z = log_softmax(own.class_scores(f[:, at:at + STEP]))
                    lp[at:at + STEP] = z[np.arange(len(z)), cls[at:at + STEP]] / np.log(10)
                end = tok == END
                lp[known & ~end] += word_of[place[known & ~end]]
                rest = ~known & ~end
                lp[rest] += rest_of[spell[rest]]
                base = np.full(len(tok), floor)
                base[known] += base_of[place[known]]
                n = np.diff(np.append(first, len(tok)))
                sums = [np.add.reduceat(x, first) for x in (known.astype(np.int64), base, lp)]
                other = np.flatnonzero(rest)
                cut = np.searchsorted(other, np.append(first, len(tok)))
                for d in range(len(first)):
                    w, c = np.unique(tok[other[cut[d]:cut[d + 1]]].view(np.int64), return_counts=True)
                    out.append((n[d], sums[0][d], sums[1][d], sums[2][d], w, c.astype(np.int32)))
            types = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(me + row, me + row + len(b)), pa.int64()), b.column(0),
                 *[pa.array([o[k] for o in out], types[k]) for k in range(6)]],
                ["row", "doc_id", "n_tokens", "n_known", "base_score", "score", "others", "times"])
            row += len(b)

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = saved(docs.select("doc_id", "text").mapInArrow(
        run, f"row long, doc_id {kind}, n_tokens long, n_known long, base_score double, score double, "
             "others array<long>, times array<int>"), "scores")
    # the words outside the tasks' table: look their counts up and add what they contribute
    others = rows.select("row", F.explode(F.arrays_zip("others", "times")).alias("o")).select(
        "row", F.col("o.others").alias("token"), F.col("o.times").alias("times"))
    found = others.join(counts.select("token", "c"), "token").groupBy("row").agg(
        F.sum("times").alias("more"), F.sum(F.col("times") * F.log10(F.col("c") + 1.0)).alias("gain"))
    out = rows.drop("others", "times").join(found, "row", "left")
    gain = F.coalesce("gain", F.lit(0.0))
    return out.select("doc_id", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
                      (F.col("base_score") + gain).alias("base_score"), (F.col("score") + gain).alias("score"))
