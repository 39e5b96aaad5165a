"""Quality classifier: a factorisation machine over hashed words, structure statistics and
metadata (sizes taken from the text).

score(x) = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): the
pairwise interactions cost linear time.  Training uses at most ``sample`` labelled rows
(those with the smallest id hash, so the choice is the same at every run); each round every
partition takes gradient steps from the shared parameters and the results are averaged.

Null counts as the empty text, which has structure statistics but no words.  Labels that
are null or belong to no document are not used; repeated labels count as often as they
occur.  Without usable labels of both kinds the score is the smoothed share of label 1.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import gathered, pack, saved, sum_blocks, task_number
from tabeval.llm.words import SLICE, WordHasher, text_buffers

WORDS = 1 << 14
BINS = 16
STATS = 14
SIZE = WORDS + STATS * BINS
RANK = 8
SAMPLE = 40_000
PARTS = 8  # partitions of the bounded training sample


def bin_of(x: float) -> int:
    """Bin of a share between 0 and 1, finer near 0."""
    return min(int(BINS * math.sqrt(min(max(x, 0.0), 1.0))), BINS - 1)


class Features:
    """Sparse features of the documents of a batch; built inside a task."""

    def __init__(self) -> None:
        self.hasher = WordHasher()
        kind = np.zeros((256, 6), np.int64)  # upper, digit, symbol, line end, other space, beyond ASCII
        kind[65:91, 0] = kind[48:58, 1] = kind[10, 3] = kind[128:, 5] = 1
        kind[[9, 11, 12, 13, 32], 4] = 1
        for lo, hi in ((33, 48), (58, 65), (91, 97), (123, 127)):
            kind[lo:hi, 2] = 1
        self.kind = kind

    def structure(self, raw: bytes, h: np.ndarray) -> list[int]:
        n, words = len(raw), len(h)
        total = np.zeros(256, np.int64)
        for at in range(0, n, SLICE):
            total += np.bincount(np.frombuffer(raw[at:at + SLICE], np.uint8), minlength=256)
        upper, digit, symbol, lines, _, wide = (total @ self.kind).tolist()
        parts = raw.split(b"\n")
        distinct = len(np.unique(h))
        repeated = int((h[1:] == h[:-1]).sum())
        base, w = max(n, 1), max(words, 1)
        ascii_, top = total[33:127], 0
        if n:
            marks = np.concatenate((total[33:48], total[58:65], total[91:97], total[123:127]))
            top = int(marks.max())
        shares = [upper / base, digit / base, symbol / base, lines / w, wide / base, distinct / w, repeated / w,
                  1 - len(set(parts)) / len(parts), top / w, n / w / 40, float(ascii_.sum() > 0),
                  max(map(len, parts)) / base]
        bins = [bin_of(s) for s in shares]
        return [*bins, min(int(math.log2(n + 1)), BINS - 1), min(int(math.log2(words + 1)), BINS - 1)]

    def rows(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, feature numbers, values); the words' values have length 1 together."""
        data, off = text_buffers(col)
        for i, j, h, w in self.hasher.documents(col):
            for d in range(i, j):
                own = h[w[d - i]:w[d - i + 1]]
                at, n = np.unique(own & np.uint64(WORDS - 1), return_counts=True)
                x = np.log1p(n)
                if len(x):
                    x /= math.sqrt(float(x @ x))
                s = self.structure(data[off[d]:off[d + 1]].tobytes(), own)
                s = WORDS + np.arange(STATS) * BINS + np.array(s)
                yield d, np.concatenate((at.astype(np.int64), s)), np.concatenate((x, np.full(STATS, 0.5)))


@dataclass
class Machine:
    """Bias and, per feature, its weight and RANK factors."""

    bias: float
    table: np.ndarray  # SIZE x (1 + RANK)

    def margin(self, at: np.ndarray, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(margins, factor sums) of documents laid end to end, ``off`` their first entries."""
        t = self.table[at] * x[:, None]
        sums = np.add.reduceat(t, off, axis=0)
        squares = np.add.reduceat(t[:, 1:] ** 2, off, axis=0)
        return self.bias + sums[:, 0] + 0.5 * ((sums[:, 1:] ** 2) - squares).sum(1), sums[:, 1:]


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def start_table(seed: int = 7) -> np.ndarray:
    t = np.random.default_rng(seed).normal(0, 0.05, (SIZE, 1 + RANK))
    t[:, 0] = 0
    return t


def steps(m: Machine, rows: list[tuple[np.ndarray, np.ndarray, int]], square: np.ndarray, rate: float, decay: float,
          batch: int) -> None:
    """One pass of mini-batch gradient steps (AdaGrad) over (features, values, label) in place."""
    for k in range(0, len(rows), batch):
        part = rows[k:k + batch]
        at, x = np.concatenate([r[0] for r in part]), np.concatenate([r[1] for r in part])
        size = np.array([len(r[0]) for r in part])
        off = np.concatenate(([0], np.cumsum(size)[:-1]))
        z, sums = m.margin(at, x, off)
        err = (sigmoid(z) - np.array([r[2] for r in part])) / len(part)
        e = np.repeat(err, size)
        grad = np.empty((len(at), 1 + RANK))
        grad[:, 0] = e * x
        grad[:, 1:] = (e * x)[:, None] * (np.repeat(sums, size, axis=0) - m.table[at, 1:] * x[:, None])
        order = np.argsort(at, kind="stable")
        own, first = np.unique(at[order], return_index=True)
        g = np.add.reduceat(grad[order], first, axis=0) + decay * m.table[own]
        square[own] += g * g
        m.table[own] -= rate * g / np.sqrt(square[own])
        m.bias -= rate * float(err.sum())


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, rounds: int = 8, rate: float = 0.1,
          decay: float = 1e-5, batch: int = 64) -> Machine:
    """``docs`` (doc_id, text), ``labels`` (doc_id, label 0 or 1)."""
    known = labels.where("doc_id IS NOT NULL AND label IS NOT NULL").select("doc_id", F.col("label").cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample)  # bounded, so it can be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "label", "text")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = Features()
        for b in batches:
            found = list(f.rows(b.column(2)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([x[1].astype(np.int32) for x in found], pa.list_(pa.int32())),
                 pa.array([x[2].astype(np.float32) for x in found], pa.list_(pa.float32()))],
                ["doc_id", "label", "at", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    seen = saved(rows.mapInArrow(extract, f"doc_id {kind}, label int, at array<int>, x array<float>"), "features")
    count = seen.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0))).first()
    share = (count[1] + 1) / (count[0] + 2)
    m = Machine(math.log(share / (1 - share)), start_table())
    if not 0 < count[1] < count[0]:
        m.table[:] = 0
        return m
    seen = seen.repartition(PARTS, F.pmod(F.xxhash64("doc_id", "at"), F.lit(PARTS)))
    width = SIZE * (1 + RANK)

    for r in range(rounds):
        bias, table = m.bias, docs.sparkSession.sparkContext.broadcast(m.table.astype(np.float32))

        def learn(batches: Iterator[pa.RecordBatch], r: int = r, bias: float = bias, table=table) -> Iterator[pa.RecordBatch]:
            rows = [(i, np.array(a), np.array(x, np.float64), y) for b in batches for i, y, a, x in
                    zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist())]
            rows.sort(key=lambda t: (t[0], t[3], t[1].tobytes()))
            order = np.random.default_rng(r).permutation(len(rows))
            own = Machine(bias, table.value.astype(np.float64))
            steps(own, [rows[k][1:] for k in order], np.full((SIZE, 1 + RANK), 0.01), rate / (1 + r / 2), decay, batch)
            n = len(rows)
            flat = np.concatenate(([n, own.bias * n], (own.table * n).ravel()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([task_number()], pa.int32()), pa.array([0], pa.int32()), pa.array([pack(flat)], pa.binary())],
                ["part", "block", "data"])

        total = gathered(sum_blocks(seen.select("doc_id", "label", "at", "x").mapInArrow(
            learn, "part int, block int, data binary"), PARTS, "float64"), width + 2, width + 2, "float64")
        m = Machine(float(total[1] / total[0]), (total[2:] / total[0]).reshape(SIZE, 1 + RANK))
        table.unpersist()
    return m


def score(docs: DataFrame, m: Machine, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and score, the probability of label 1."""
    sent = docs.sparkSession.sparkContext.broadcast((m.bias, m.table.astype(np.float32)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f, own = Features(), Machine(*sent.value)
        for b in batches:
            out = np.empty(len(b))
            for d, at, x in f.rows(b.column(1)):
                out[d] = own.margin(at, x.astype(np.float32), np.zeros(1, np.int64))[0][0]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sigmoid(out))], [id_col, "score"])

    return docs.select(id_col, text_col).mapInArrow(
        run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double")
