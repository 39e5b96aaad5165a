"""Trees grown from distributed histograms: boosting, forests and single trees in one engine.

The rows are binned once and written.  A pass over them sends every row down the trees that
are growing and adds its statistics to the histograms (node, feature, bin) of the nodes that are
waiting; each task adds up its own rows, so what leaves a task depends on the nodes and bins,
never on the rows.  The driver picks the splits from the summed histograms.  Of two sibling
nodes only the smaller one is counted, the other is the parent less its sibling.

Three sums (g, h, n) serve all kinds, with score G^2 / (H + l2) and gain = score(left) +
score(right) - score(node):

- boosting: gradient and hessian of the logistic loss, leaf -G / (H + l2) times the rate
  (second order, with ``l2``, ``min_gain`` and ``min_hess``);
- trees and forests: weighted label and weight, leaf G / H; the gain is then half the Gini
  decrease times the rows (the squared-error decrease for other labels).

``num_leaves`` grows best-first: a queue takes the leaf with the largest gain until the tree has
so many leaves.  Which leaf comes next does not change what a node's best split is, so all nodes
that may still be taken are counted in one pass: a tree needs about as many passes as it is
deep, not one a leaf.  Many trees (the models of a grid, the trees of a forest) grow in the same
passes.

Sums are whole numbers (statistics in units of 2^-26), so a model does not depend on how the rows
lie in partitions.  Row samples, bootstrap weights and feature samples are hashes of (seed, tree,
row id / node), so they can be recomputed anywhere: the rows that a tree has not seen are known
without storing them.  Boosted margins are written every ``SAVE_EVERY`` trees and what the trees
since then add is recomputed; a lost executor costs one pass.

Missing labels or features are refused.  Ties between splits go to the first feature and bin,
between leaves to the node that stands further left and higher.
"""

from __future__ import annotations

import functools
import heapq
import math
import pickle
from array import array
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.functions.exprs import required
from tabeval.session import materialize

SCALE = 1 << 26       # statistics are counted in units of 1 / SCALE
MAX_BINS = 255
MAX_DEPTH = 60        # node numbers are paths of bits in a long
SAVE_EVERY = 10       # trees after which boosted margins are written
PASS_CELLS = 24 << 20  # histogram cells (node x feature x bin) counted in one pass
SLICE = 1 << 18       # rows whose sums over a task's trees leave it together
FAN_IN = 64           # partial histograms added up in one task
SMALL_CELLS = 64 << 20  # values of a table that may be sent to every task
MAX_TIMES = 1 << 26   # rows whose statistics add up exactly in doubles
TREES_A_TASK = 5      # of a forest over such a table
TREES_AT_ONCE = 2     # of these where the trees themselves leave the task, so that the tasks end together
HASHED = 1 << 14      # rows hashed at a time, so that the steps stay in a core's cache
DENSE = 4             # histogram cells a row up to which a level is counted in a full table
STEP = 1 << 15        # rows of a level that go through its steps together
PART = 1 << 18        # rows of neighbouring nodes that go on together once a level has that many nodes
NODES_TOGETHER = 64   # nodes whose best splits are looked for at a time


@dataclass(frozen=True)
class TreeParams:
    """How one model is grown.  ``rows``: share of the rows a tree sees, or ``"bootstrap"``;
    ``columns``: share of the features a tree sees; ``node_columns``: features tried at a node."""
    trees: int = 100
    boosted: bool = True
    rate: float = 0.1
    max_depth: int = MAX_DEPTH
    num_leaves: int | None = None
    l2: float = 0.0
    min_gain: float = 0.0
    min_rows: int = 1
    min_hess: float = 0.0
    min_split: int = 2
    rows: float | str = 1.0
    columns: float = 1.0
    node_columns: int | None = None
    seed: int = 123


# Defaults of the two boosting styles and of the two tree kinds (fixed values of the usual libraries).
LEVEL_WISE = dict(rate=0.3, max_depth=6, l2=1.0, min_hess=1.0)
LEAF_WISE = dict(rate=0.1, num_leaves=31, min_rows=20, min_hess=1e-3)
SINGLE = dict(trees=1, boosted=False)
FOREST = dict(trees=100, boosted=False, rows="bootstrap")


# ---------------------------------------------------------------- hashes

def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def uniform(key: np.ndarray, *salts: int) -> np.ndarray:
    """Numbers in [0, 1) from keys and salts."""
    x = np.asarray(key).astype(np.int64).astype(np.uint64)
    for s in salts:
        x = mixed(x ^ mixed(np.array([s & 0xFFFFFFFFFFFFFFFF], np.uint64)))
    return (mixed(x) >> np.uint64(11)) * (1.0 / (1 << 53))


# P(Poisson(1) <= k): the bootstrap weight of a row is Poisson, as drawing n of n rows is for large n
POISSON = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(16)])


# the same in whole numbers below 2^53, and for each of their first 12 bits the weight (-1: a bound lies between)
POISSON_53 = np.array([math.ceil(c * (1 << 53)) for c in POISSON], np.uint64)
POISSON_12 = np.searchsorted(POISSON_53, np.arange(1 << 12, dtype=np.uint64) << np.uint64(41), side="right").astype(np.int8)
POISSON_12[(POISSON_53 >> np.uint64(41)).astype(np.int64).clip(max=(1 << 12) - 1)] = -1


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """:func:`mixed` in place."""
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= np.right_shift(x, np.uint64(30), out=spare)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=spare)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=spare)


def row_weights(ids: np.ndarray, rows: float | str, seed: int, tree: int) -> np.ndarray | None:
    """How often tree ``tree`` sees each row (None: every row once), by ``uniform(ids, seed, tree, 1)``."""
    if rows != "bootstrap" and rows >= 1.0:
        return None
    ids, out = np.asarray(ids).astype(np.int64, copy=False), np.empty(len(ids), np.int64)
    salts = [mixed(np.array([s & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] for s in (seed, tree, 1)]
    buffers = np.empty((2, min(HASHED, len(ids))), np.uint64)
    for at in range(0, len(ids), HASHED):
        w = out[at:at + HASHED]
        x, spare = buffers[:, :len(w)]
        x.view(np.int64)[:] = ids[at:at + HASHED]
        for s in salts:
            x ^= s
            _mix(x, spare)
        _mix(x, spare)
        x >>= np.uint64(11)
        if rows != "bootstrap":
            w[:] = x * (1.0 / (1 << 53)) < rows
            continue
        w[:] = POISSON_12.take(np.right_shift(x, np.uint64(41), out=spare).view(np.int64))
        unsure = np.flatnonzero(w < 0)
        w[unsure] = np.searchsorted(POISSON_53, x[unsure], side="right")
    return out


def chosen(n: int, take: int, *salts: int) -> np.ndarray:
    """``take`` of ``n`` features by hash order."""
    return np.sort(np.argsort(uniform(np.arange(n), *salts), kind="stable")[:take])


# ---------------------------------------------------------------- bins

@dataclass
class Bins:
    """Cut points by feature: a value's bin is the number of cuts below it."""
    features: list[str]
    cuts: list[np.ndarray]

    @property
    def width(self) -> int:
        return max([len(c) for c in self.cuts], default=0) + 1

    def of(self, columns: Sequence[np.ndarray]) -> np.ndarray:
        """Rows x features."""
        return np.stack([np.searchsorted(c, x, side="left") for c, x in zip(self.cuts, columns)], axis=1).astype(np.uint16)


def fit_bins(df: DataFrame, features: Sequence[str], max_bins: int = MAX_BINS, known: dict[str, np.ndarray] | None = None) -> Bins:
    """Half-way cuts between the values of a feature with at most ``max_bins`` of them, else
    approximate quantiles.  What reaches the driver is at most ``max_bins`` + 1 values a feature.
    ``known``: cuts of features that were found before on the same rows."""
    unknown = [f for f in features if not known or f not in known]
    values = dict(zip(unknown, few_values(df, unknown, max_bins)))
    cuts: list[np.ndarray | None] = []
    for f in features:
        if f not in values:
            cuts.append(known[f])
            continue
        found = values[f]
        cuts.append((found[:-1] + found[1:]) / 2 if len(found) <= max_bins else None)
    many = [f for f, c in zip(features, cuts) if c is None]
    if many:
        at = [k / max_bins for k in range(1, max_bins)]
        got = df.agg(*[F.percentile_approx(F.col(f).cast("double"), at, 100 * max_bins).alias(f) for f in many]).first()
        cuts = [np.unique(got[f]) if c is None else c for f, c in zip(features, cuts)]
    return Bins(list(features), cuts)


def few_values(df: DataFrame, features: Sequence[str], most: int) -> list[np.ndarray]:
    """By feature its distinct values in order, or more than ``most`` of them.  One scan for all; a task keeps
    and yields at most ``most`` + 1 values a feature."""
    if not features:
        return []

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [np.zeros(0) for _ in features]
        for b in batches:
            for k, x in enumerate(found):
                if len(x) <= most:
                    found[k] = np.unique(np.concatenate([x, b.column(k).to_numpy(zero_copy_only=False)]))[:most + 1]
        yield pa.RecordBatch.from_pylist([{"feature": k, "data": x.tobytes()} for k, x in enumerate(found)],
                                         pa.schema([("feature", pa.int32()), ("data", pa.binary())]))

    rows = df.select(*[F.col(f).cast("double").alias(f"f{k}") for k, f in enumerate(features)]).mapInArrow(work, "feature int, data binary")
    out = [np.zeros(0) for _ in features]
    for r in rows.collect():
        if len(out[r["feature"]]) <= most:
            out[r["feature"]] = np.unique(np.concatenate([out[r["feature"]], np.frombuffer(r["data"])]))
    return out


def binned(df: DataFrame, bins: Bins, label: str, id_col: str) -> DataFrame:
    """(id, y, bins): the bins of all features as one binary value a row."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = bins.of([b.column(k + 2).to_numpy() for k in range(len(bins.features))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), as_binary(m)], ["id", "y", "bins"])

    cols = [required(f, f).cast("double").alias(f"f{k}") for k, f in enumerate(bins.features)]
    return df.select(F.col(id_col).cast("long").alias("id"), required(label, label).cast("double").alias("y"), *cols
                     ).mapInArrow(work, "id long, y double, bins binary")


def as_binary(m: np.ndarray) -> pa.Array:
    """The rows of a matrix as binary values."""
    size = m.shape[1] * m.itemsize
    offsets = (np.arange(len(m) + 1) * size).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(m))])


def as_matrix(a: pa.Array, dtype, columns: int) -> np.ndarray:
    """The matrix whose rows :func:`as_binary` wrote; it lies in the array's own memory."""
    if not len(a):
        return np.zeros((0, columns), dtype)
    wide = pa.types.is_large_binary(a.type)
    _, offsets, data = a.buffers()
    first = int(np.frombuffer(offsets, np.int64 if wide else np.int32, 1, a.offset * (8 if wide else 4))[0])
    return np.frombuffer(data, dtype, len(a) * columns, first).reshape(len(a), columns)


# ---------------------------------------------------------------- one tree

@dataclass
class Tree:
    """Nodes as parallel lists; ``feature`` -1 marks a leaf, rows with bin <= ``bin`` go left."""
    number: int = 0
    path: list[int] = field(default_factory=lambda: [1])
    feature: list[int] = field(default_factory=lambda: [-1])
    bin: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    value: list[float] = field(default_factory=lambda: [0.0])
    gain: list[float] = field(default_factory=lambda: [0.0])
    g: list[int] = field(default_factory=lambda: [0])
    h: list[int] = field(default_factory=lambda: [0])
    n: list[int] = field(default_factory=lambda: [0])

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.feature)

    def depth(self, node: int) -> int:
        return int(self.path[node]).bit_length() - 1

    def leaf_of(self, m: np.ndarray) -> np.ndarray:
        """The node in which each row of a bin matrix ends."""
        feature, cut, left = np.asarray(self.feature, np.int64), np.asarray(self.bin), np.asarray(self.left)
        at, values = np.zeros(len(m), np.int64), m.ravel()
        live = np.arange(len(m)) if feature[0] >= 0 else np.zeros(0, np.int64)
        first, node = live * m.shape[1], at[live]
        while live.size:  # a right child stands behind its sibling
            node = left[node] + (values.take(first + feature[node]) > cut[node])
            inner = feature[node] >= 0
            if not inner.all():
                stay, gone = np.flatnonzero(inner), np.flatnonzero(~inner)
                at[live[gone]] = node[gone]
                live, first, node = live[stay], first[stay], node[stay]
        return at

    def predict(self, m: np.ndarray) -> np.ndarray:
        return np.asarray(self.value)[self.leaf_of(m)]


class Growing:
    """A tree on its way: which nodes wait for a histogram, and what they become."""

    def __init__(self, params: TreeParams, number: int, n_features: int, keep_histograms: bool = True) -> None:
        self.p, self.tree, self.n_features, self.keep = params, Tree(number), n_features, keep_histograms
        self.split: list[tuple | None] = [None]  # (gain, feature, bin, left g, h, n) of a node that may be split
        self.known = [False]
        self.children: list[tuple[int, int] | None] = [None]
        self.parent = [-1]
        self.histogram: dict[int, np.ndarray] = {}
        take = max(1, round(params.columns * n_features))
        self.columns = chosen(n_features, take, params.seed, number, 2) if take < n_features else np.arange(n_features)

    def allowed(self, node: int) -> np.ndarray:
        k = self.p.node_columns
        if k is None or k >= len(self.columns):
            return self.columns
        return self.columns[chosen(len(self.columns), k, self.p.seed, self.tree.number, self.tree.path[node], 3)]

    def add(self, parent: int, right: bool, g: int, h: int, n: int) -> int:
        t = self.tree
        t.path.append(t.path[parent] * 2 + right)
        for a, v in ((t.feature, -1), (t.bin, 0), (t.left, 0), (t.right, 0), (t.value, 0.0), (t.gain, 0.0),
                     (t.g, g), (t.h, h), (t.n, n), (self.split, None), (self.children, None), (self.parent, parent)):
            a.append(v)
        node = len(t.path) - 1
        # a node that cannot be split needs no histogram
        self.known.append(t.depth(node) >= min(self.p.max_depth, MAX_DEPTH) or n < max(self.p.min_split, 2 * self.p.min_rows))
        return node

    def taken(self) -> tuple[list[int], list[int]]:
        """(nodes that are split so far, nodes whose histogram may matter): the queue is run over what
        is known; a waiting child leaves room that a known node may fill for the time being."""
        if not self.known[0]:
            return [], [0]
        budget = (self.p.num_leaves or (1 << 62)) - 1
        heap = [(-self.split[0][0], self.tree.path[0], 0)] if self.split[0] else []
        done, waiting = [], []
        while heap and len(done) < budget:
            _, _, node = heapq.heappop(heap)
            done.append(node)
            if self.children[node] is None:
                _, _, _, lg, lh, ln = self.split[node]
                t = self.tree
                self.children[node] = (self.add(node, False, lg, lh, ln),
                                       self.add(node, True, t.g[node] - lg, t.h[node] - lh, t.n[node] - ln))
            for c in self.children[node]:
                if not self.known[c]:
                    waiting.append(c)
                elif self.split[c]:
                    heapq.heappush(heap, (-self.split[c][0], self.tree.path[c], c))
        return done, waiting

    def to_count(self, waiting: list[int]) -> list[int]:
        """Of two waiting siblings with a kept parent only the smaller one is counted."""
        out, t = [], self.tree
        for c in waiting:
            p = self.parent[c]
            if p >= 0 and p in self.histogram:
                a, b = self.children[p]
                other = b if c == a else a
                if other in waiting and (t.n[other], other) < (t.n[c], c):
                    continue
            out.append(c)
        return out

    def give(self, counted: dict[int, np.ndarray], waiting: list[int]) -> None:
        """Takes the histograms of the counted nodes (features x bins x (g, h, n))."""
        found = {}
        for c in waiting:
            hist = counted.get(c)
            if hist is None:
                a, b = self.children[self.parent[c]]
                sibling = counted.get(b if c == a else a)
                if sibling is None or self.parent[c] not in self.histogram:
                    continue  # in a later pass
                hist = self.histogram[self.parent[c]] - sibling
            found[c] = hist
        nodes = list(found)
        for k in range(0, len(nodes), NODES_TOGETHER):
            part = nodes[k:k + NODES_TOGETHER]
            self.find(part, np.stack([found[c] for c in part]))
        if self.keep:
            self.histogram.update(found)
        for p in [p for p in self.histogram if self.children[p] and all(self.known[c] for c in self.children[p])]:
            del self.histogram[p]
        for c in [c for c in self.histogram if self.split[c] is None]:
            del self.histogram[c]

    def find(self, nodes: list[int], hist: np.ndarray) -> None:
        """The best splits of nodes from their histograms (nodes x features x bins x 3)."""
        t, p = self.tree, self.p
        total = hist[:, 0].sum(axis=1)
        for node, (g, h, n) in zip(nodes, total.tolist()):
            t.g[node], t.h[node], t.n[node] = g, h, n  # only the root's are new
            self.known[node] = True
        if hist.shape[2] < 2:
            return
        left = hist.cumsum(axis=2)[:, :, :-1]
        whole = total[:, None, None]
        right = whole - left
        ok = (left[..., 2] >= p.min_rows) & (right[..., 2] >= p.min_rows) & (left[..., 1] > 0) & (right[..., 1] > 0)
        if p.min_hess:
            ok &= (left[..., 1] / SCALE >= p.min_hess) & (right[..., 1] / SCALE >= p.min_hess)
        for k, node in enumerate(nodes):
            if t.n[node] < max(p.min_split, 2 * p.min_rows) or t.depth(node) >= min(p.max_depth, MAX_DEPTH):
                ok[k] = False
            elif len(self.columns) < self.n_features or p.node_columns:
                other = np.ones(self.n_features, bool)
                other[self.allowed(node)] = False
                ok[k, other] = False
        gain = np.where(ok, score(left, p.l2) + score(right, p.l2) - score(whole, p.l2), -np.inf).reshape(len(nodes), -1)
        best = gain.argmax(axis=1)
        for k, node in enumerate(nodes):
            top, (f, b) = float(gain[k, best[k]]), divmod(int(best[k]), left.shape[2])
            # boosting needs a gain; of the others a pure node is a leaf, an impure one may be split without
            if top > p.min_gain if p.boosted else math.isfinite(top) and top >= p.min_gain and self.impure(node) > 1e-7:
                self.split[node] = (top, f, b, *map(int, left[k, f, b]))

    def impure(self, node: int) -> float:
        """1 - share^2 - (1 - share)^2 halved for a 0/1 label; for others this is positive for a mean within (0, 1)."""
        share = self.tree.g[node] / self.tree.h[node]
        return share * (1 - share)

    def finish(self) -> Tree:
        t, p = self.tree, self.p
        for node in self.taken()[0]:
            t.gain[node], t.feature[node], t.bin[node] = self.split[node][:3]
            t.left[node], t.right[node] = self.children[node]
        for k in range(len(t.path)):
            g, h = t.g[k] / SCALE, t.h[k] / SCALE
            t.value[k] = -p.rate * g / (h + p.l2) if p.boosted and h + p.l2 > 0 else g / h if h > 0 else 0.0
        return compact(t)


def score(s: np.ndarray, l2: float) -> np.ndarray:
    g, h = s[..., 0] / SCALE, s[..., 1] / SCALE + l2
    return np.divide(g * g, h, out=np.zeros_like(g), where=h > 0)


# how the node lists of a finished tree are kept: a grown-out tree has as many nodes as rows
KEPT = {"path": "q", "feature": "h", "bin": "H", "left": "i", "right": "i", "value": "d", "gain": "d", "g": "q", "h": "q", "n": "q"}


def kept(number: int, **nodes) -> Tree:
    """A finished tree from its node lists or arrays."""
    out = Tree(number)
    for name, kind in KEPT.items():
        x = nodes[name]
        setattr(out, name, array(kind, x.astype(np.dtype(kind)).tobytes() if isinstance(x, np.ndarray) else x))
    return out


def slim(t: Tree) -> Tree:
    """What predictions need."""
    out = Tree(t.number)
    for name in KEPT:
        setattr(out, name, getattr(t, name) if name in ("feature", "bin", "left", "value") else array(KEPT[name]))
    return out


def compact(t: Tree) -> Tree:
    """Only the nodes that can be reached, in the order of their paths by level."""
    a = {name: np.asarray(getattr(t, name)) for name in KEPT}
    level, found = np.zeros(1, np.int64), []
    while level.size:
        found.append(level)
        inner = level[a["feature"][level] >= 0]
        level = np.concatenate([a["left"][inner], a["right"][inner]]).astype(np.int64)
    at = np.concatenate(found)
    at = at[np.argsort(a["path"][at])]
    new = np.zeros(len(a["path"]), np.int64)
    new[at] = np.arange(len(at))
    inner = a["feature"][at] >= 0
    nodes = {name: a[name][at] for name in ("path", "feature", "value", "g", "h", "n")}
    for name in ("bin", "gain"):
        nodes[name] = np.where(inner, a[name][at], 0)
    for name in ("left", "right"):
        nodes[name] = np.where(inner, new[a[name][at]], 0)
    return kept(t.number, **nodes)


# ---------------------------------------------------------------- passes

@dataclass
class Job:
    """One tree in a pass: the model it belongs to, the tree so far, the nodes to count."""
    model: int
    params: TreeParams
    tree: Tree
    nodes: list[int]


def partial(growing: Growing) -> Tree:
    """The tree so far: every split that a waiting node hangs on."""
    t = growing.tree
    out = Tree(t.number)
    out.path, out.value = t.path, t.value
    out.feature, out.bin = [-1] * len(t.path), [0] * len(t.path)
    out.left, out.right = [0] * len(t.path), [0] * len(t.path)
    for k, c in enumerate(growing.children):
        if c is not None:
            out.feature[k], out.bin[k] = growing.split[k][1:3]
            out.left[k], out.right[k] = c
    return out


def statistics(y: np.ndarray, margin: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """g and h of the rows in units of 1 / SCALE."""
    if margin is None:
        return np.rint(y * SCALE), np.full(len(y), float(SCALE))
    p = 1.0 / (1.0 + np.exp(-margin))
    return np.rint((p - y) * SCALE), np.rint(p * (1.0 - p) * SCALE)


def with_trees(margin: np.ndarray, trees: list[Tree], m: np.ndarray) -> np.ndarray:
    """The margins after some more trees, always added one by one."""
    for t in trees:
        margin = margin + t.predict(m)
    return margin


def tally(out: np.ndarray, jobs: list[Job], ids: np.ndarray, y: np.ndarray, m: np.ndarray, margin_of, width: int) -> None:
    """Adds rows to the histograms of the jobs' nodes: ``out`` is (nodes of all jobs, features x bins, 3)."""
    n_features = m.shape[1]
    cells, first, model, stats = n_features * width, 0, None, None
    for j in jobs:
        if model != j.model:
            model, stats = j.model, statistics(y, margin_of(j.model) if j.params.boosted else None)
        slot = np.full(len(j.tree.path), -1)
        slot[j.nodes] = np.arange(len(j.nodes))
        at = slot[j.tree.leaf_of(m)]
        w = row_weights(ids, j.params.rows, j.params.seed, j.tree.number)
        use = np.flatnonzero(at >= 0 if w is None else (at >= 0) & (w > 0))
        if use.size:
            key = ((at[use, None] * n_features + np.arange(n_features)) * width + m[use]).ravel()
            times = np.ones(use.size) if w is None else w[use].astype(float)
            for k, x in enumerate((stats[0][use] * times, stats[1][use] * times, times)):
                got = np.bincount(key, np.repeat(x, n_features), len(j.nodes) * cells)
                out[first:first + len(j.nodes), :, k] += got.reshape(len(j.nodes), cells).astype(np.int64)
        first += len(j.nodes)


def summed(parts: DataFrame, tasks: int, dtype: str) -> np.ndarray | None:
    """The sum of the arrays (part, data) of many tasks; the driver adds up at most FAN_IN of them."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        s = sum(np.frombuffer(x, dtype) for x in pdf.sort_values("part")["data"])
        return pd.DataFrame({"part": pdf["part"][:1], "data": [s.tobytes()]})

    while tasks > FAN_IN:
        group = F.expr(f"part div {FAN_IN}").cast("int")
        parts = parts.groupBy(group.alias("_group")).applyInPandas(add, "part int, data binary").withColumn("part", group)
        tasks = -(-tasks // FAN_IN)
    total = None
    for r in sorted(parts.collect(), key=lambda r: r["part"]):
        x = np.frombuffer(r["data"], dtype)
        total = x if total is None else total + x
    return total


def by_job(hist: np.ndarray, jobs: list[Job], n_features: int, width: int) -> list[dict[int, np.ndarray]]:
    hist, out, first = hist.reshape(-1, n_features, width, 3), [], 0
    for j in jobs:
        out.append({node: hist[first + k] for k, node in enumerate(j.nodes)})
        first += len(j.nodes)
    return out


def counted(state: DataFrame, jobs: list[Job], since: list[list[Tree]], n_features: int, width: int,
            n_models: int) -> list[dict[int, np.ndarray]]:
    """The histograms of every job's nodes over all rows."""
    spark = state.sparkSession
    sent = spark.sparkContext.broadcast((jobs, since))
    boosted = "margins" in state.columns
    total = sum(len(j.nodes) for j in jobs)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        jobs, since = sent.value
        out = np.zeros((total, n_features * width, 3), np.int64)
        any_row = False
        for b in batches:
            if not b.num_rows:
                continue
            any_row = True
            m = as_matrix(b.column(2), np.uint16, n_features)
            margins = as_matrix(b.column(3), np.float64, n_models) if boosted else None
            tally(out, jobs, b.column(0).to_numpy(), b.column(1).to_numpy(), m,
                  lambda k: with_trees(margins[:, k], since[k], m), width)
        if any_row:
            yield pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "data": out.tobytes()}],
                                             pa.schema([("part", pa.int32()), ("data", pa.binary())]))

    hist = summed(state.mapInArrow(work, "part int, data binary"), state.rdd.getNumPartitions(), "int64")
    hist = np.zeros(total * n_features * width * 3, np.int64) if hist is None else hist
    sent.destroy()
    return by_job(hist, jobs, n_features, width)


def grow(count, starts: list[tuple[int, TreeParams, int]], n_features: int, width: int) -> list[Tree]:
    """Grows the trees (model, params, number) in common passes; ``count`` gives the histograms of jobs."""
    # parents' histograms are kept on the driver while all trees' open nodes fit
    keep = all(p.num_leaves or p.max_depth <= 10 for _, p, _ in starts) and \
        len(starts) * n_features * width * 64 <= 8 * PASS_CELLS
    open_ = [Growing(p, number, n_features, keep) for _, p, number in starts]
    active = list(range(len(open_)))
    while active:
        jobs, asked, cells, still = [], [], 0, []
        for k in active:
            waiting = open_[k].taken()[1]
            if not waiting:
                continue
            still.append(k)
            nodes = open_[k].to_count(waiting)
            room = (PASS_CELLS - cells) // (n_features * width)
            if room <= 0 and jobs:
                continue
            nodes = nodes[:max(room, 1)]
            cells += len(nodes) * n_features * width
            jobs.append(Job(starts[k][0], open_[k].p, partial(open_[k]), nodes))
            asked.append((k, waiting))
        if jobs:
            for (k, waiting), got in zip(asked, count(jobs)):
                open_[k].give(got, waiting)
        active = still
    return [g.finish() for g in open_]


# ---------------------------------------------------------------- a table held by a task

@dataclass
class Held:
    """The rows of a small table in a task.  Rows with equal bins can never be told apart by a tree,
    so trees grow over the distinct bin rows; ``cell`` is each row's (None: nearly all are distinct)."""
    ids: np.ndarray
    y: np.ndarray
    m: np.ndarray
    times: np.ndarray | None = None  # rows that a row stands for
    cell: np.ndarray | None = None
    _units: np.ndarray | None = None  # the labels in units, in the task that uses them

    @staticmethod
    def of(ids: np.ndarray, y: np.ndarray, m: np.ndarray, width: int, times: np.ndarray | None = None) -> Held:
        if m.shape[1] * math.log2(max(width, 2)) < 62:
            key = np.zeros(len(m), np.int64)
            for k in range(m.shape[1]):
                key = key * width + m[:, k]
            if _distinct(key) < 0.7 * len(m):
                order = np.argsort(key, kind="stable")  # sums by cell then go through memory once
                key = key[order]
                new = _changes(key)
                return Held(ids[order], y[order], np.ascontiguousarray(m[order[new]]), None if times is None else times[order],
                            np.cumsum(new) - 1)
        return Held(ids, y, m, times)

    def sums(self, p: TreeParams, number: int, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """g, h and n of the distinct rows, whole numbers below 2^53; ``margin`` is theirs too."""
        if p.boosted and self.cell is not None:
            margin = margin[self.cell]
        w = row_weights(self.ids, p.rows, p.seed, number)
        if self.times is not None:
            w = self.times if w is None else w * self.times
        n = np.ones(len(self.y)) if w is None else w.astype(float)
        if p.boosted:
            g, h = statistics(self.y, margin)
            found = [g * n, h * n, n]
        else:
            if self._units is None:
                self._units = statistics(self.y, None)[0]
            found = [self._units * n, n]
        if self.cell is not None:
            found = [np.bincount(self.cell, x, len(self.m)) for x in found]
        return tuple(found) if p.boosted else (found[0], found[1] * SCALE, found[1])


def _changes(key: np.ndarray, end: int = 0) -> np.ndarray:
    """Whether a run of equal values starts at a place (``end`` -1: ends there)."""
    out = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=out[1:] if end == 0 else out[:-1])
    return out


def _distinct(key: np.ndarray) -> int:
    key = np.sort(key)
    return int(np.count_nonzero(key[1:] != key[:-1])) + (len(key) > 0)


def grown_here(data: Held, p: TreeParams, number: int, width: int, margin: np.ndarray) -> tuple[Tree, np.ndarray]:
    """The tree that passes over the rows give, and the node in which each distinct row ends."""
    g, h, n = data.sums(p, number, margin)
    if p.num_leaves:
        return _best_first(data.m, g, h, n, p, number, width)
    return _by_level(data.m, g, h, n, p, number, width)


def _best_first(m: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, p: TreeParams, number: int,
                width: int) -> tuple[Tree, np.ndarray]:
    """Every node keeps its rows, so only those of the nodes to count are read."""
    f = m.shape[1]
    growing, rows = Growing(p, number, f), {0: np.arange(len(m))}
    while waiting := growing.taken()[1]:
        for k, c in enumerate(growing.children):
            if c is not None and c[0] not in rows:
                here = rows[k]
                left = m[here, growing.split[k][1]] <= growing.split[k][2]
                rows[c[0]], rows[c[1]] = here[left], here[~left]
        counted = {}
        for c in growing.to_count(waiting):
            here, hist = rows[c], np.zeros((f, width, 3), np.int64)
            values = [x[here] for x in (g, h, n)]
            for j in range(f):
                key = m[here, j]
                for i, x in enumerate(values):
                    hist[j, :, i] = np.bincount(key, x, width)
            counted[c] = hist
        growing.give(counted, waiting)
    paths, children, split = list(growing.tree.path), growing.children, growing.split
    tree = growing.finish()
    index, at = {path: k for k, path in enumerate(tree.path)}, np.zeros(len(m), np.int64)
    for k, path in enumerate(paths):
        if path in index and tree.feature[index[path]] < 0:
            if k not in rows:  # children that no pass was needed for
                up = growing.parent[k]
                left = m[rows[up], split[up][1]] <= split[up][2]
                rows[k] = rows[up][left if children[up][0] == k else ~left]
            at[rows[k]] = index[path]
    return tree, at


def allowed_columns(p: TreeParams, number: int, columns: np.ndarray, path: np.ndarray, n_features: int) -> np.ndarray:
    """Nodes x features: what :meth:`Growing.allowed` says of each node."""
    out = np.zeros((len(path), n_features), bool)
    if p.node_columns is None or p.node_columns >= len(columns):
        out[:, columns] = True
        return out
    x = np.broadcast_to(np.arange(len(columns)).astype(np.uint64), (len(path), len(columns)))
    for s in (p.seed, number, path, 3):
        salt = np.asarray(s, np.int64).astype(np.uint64).reshape(-1, 1)
        x = mixed(x ^ mixed(salt))
    u = (mixed(x) >> np.uint64(11)) * (1.0 / (1 << 53))
    first = np.argsort(u, axis=1, kind="stable")[:, :p.node_columns]
    np.put_along_axis(out, columns[first], True, axis=1)
    return out


def _by_level(m: np.ndarray, g: np.ndarray, h: np.ndarray, n: np.ndarray, p: TreeParams, number: int,
              width: int) -> tuple[Tree, np.ndarray]:
    """All nodes of a level at once: in a full table of (node, bin) while that is not much larger than
    the rows, beyond that over the sorted bins that occur, so that a level costs its rows, not its nodes.
    Rows leave with the node in which they end; those without weight only follow the splits.  Of many rows
    neighbouring nodes go on in parts, so that what is read again and again stays near a core."""
    f, columns = m.shape[1], Growing(p, number, m.shape[1]).columns
    at_end = np.zeros(len(m), np.int64)
    rows = np.flatnonzero(n > 0)
    seen = len(rows)
    if p.boosted and seen < len(m):
        rows = np.concatenate([rows, np.flatnonzero(n <= 0)])
    x, sums = np.ascontiguousarray(m.T).take(rows, axis=1), Sums.of(*[s[rows[:seen]] for s in (g, h, n)], p.boosted)
    total = np.array([[s.sum()] for s in (g, h, n)], np.int64)
    levels = _levels(x, np.zeros(len(rows), np.int64), sums, rows, np.ones(1, np.int64), total, _may(total, p, width, 0), 0, None, at_end,
                     p, number, columns, width)
    nodes = {name: np.concatenate([x[name] for x in levels]) for name in levels[0]}
    a, b = nodes["g"] / SCALE, nodes["h"] / SCALE
    if p.boosted:
        value = np.divide(-p.rate * a, b + p.l2, out=np.divide(a, b, out=np.zeros(len(a)), where=b > 0), where=b + p.l2 > 0)
    else:
        value = np.divide(a, b, out=np.zeros(len(a)), where=b > 0)
    return kept(number, value=value, **nodes), at_end


def _levels(x: np.ndarray, at: np.ndarray, sums: Sums, rows: np.ndarray, path: np.ndarray, total: np.ndarray, may: np.ndarray, depth: int,
            above: Above | None, at_end: np.ndarray, p: TreeParams, number: int, columns: np.ndarray, width: int) -> list[dict]:
    """A level and those below it.  Nodes are numbered from its first one on, in ``at_end`` too."""
    f, base, seen, levels = len(x), 0, len(sums.columns[0]), []
    while True:
        k = len(path)
        if len(rows) > 2 * PART and np.count_nonzero(may) * PART >= len(rows):
            group = _groups(at, may)
            if group[-1]:
                return levels + _in_parts(group, base, x, at, sums, rows, path, total, may, depth, above, at_end, p, number, columns, width)
        level = {"path": path, "g": total[0], "h": total[1], "n": total[2], "feature": np.full(k, -1), "bin": np.zeros(k, np.int64),
                 "left": np.zeros(k, np.int64), "right": np.zeros(k, np.int64), "gain": np.zeros(k)}
        levels.append(level)
        among = np.flatnonzero(may)  # the nodes that the rows still here lie in
        if not len(among):
            break
        here = total[:, among]
        gain, where, cut, left, hist = _best(x, at, sums, here, allowed_columns(p, number, columns, path[among], f), p, width, above)
        good = gain > p.min_gain if p.boosted else np.isfinite(gain) & (gain >= p.min_gain)
        if not good.any():
            at_end[rows] = base + among[at]
            break
        node = among[good]
        first = base + k + 2 * np.arange(len(node))
        for name, value in (("feature", where[good]), ("bin", cut[good]), ("gain", gain[good]), ("left", first), ("right", first + 1)):
            level[name][node] = value
        total = np.stack([left[:, good], here[:, good] - left[:, good]], axis=2).reshape(3, -1)
        path = (path[node, None] * 2 + np.arange(2)).ravel()
        depth += 1
        may = _may(total, p, width, depth)
        # by (node, side): the node in which a row is next, and its place among those that may be split
        turn = np.repeat(base + among, 2)
        turn[np.repeat(good, 2)] = base + k + np.arange(len(path))
        place = np.full(len(turn), -1)
        place[np.repeat(good, 2)] = np.where(may, np.cumsum(may) - 1, -1)
        above = None if hist is None else Above.of(hist, np.repeat(np.flatnonzero(good), 2), may, total[2])
        side = _sides(x, at, where, cut)
        at, base = place[side], base + k
        keep = at >= 0
        if not keep.all():
            stay, gone = np.flatnonzero(keep), np.flatnonzero(~keep)
            at_end[rows[gone]] = turn[side[gone]]
            seen = int(np.searchsorted(stay, seen))
            rows, x, at, sums = rows[stay], x.take(stay, axis=1), at[stay], sums.take(stay[:seen])
    return levels


def _sides(x: np.ndarray, at: np.ndarray, where: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """Twice the node of every row, and one more if its bin of the node's feature goes right."""
    values, start, out = x.ravel(), where * x.shape[1], 2 * at
    for first in range(0, len(at), STEP):
        here, to = at[first:first + STEP], out[first:first + STEP]
        value = values.take(start[here] + np.arange(first, first + len(here)))
        to += value > cut[here]
    return out


def _groups(at: np.ndarray, may: np.ndarray) -> np.ndarray:
    """By node of a level, the part it goes on in: 0, 1, ...; siblings stay together."""
    rows = np.zeros(len(may), np.int64)
    rows[may] = np.bincount(at, minlength=np.count_nonzero(may))
    before = np.cumsum(rows.reshape(-1, 2).sum(axis=1))
    group = np.unique(before // PART, return_inverse=True)[1]
    return np.repeat(group, 2)


def _in_parts(group: np.ndarray, base: int, x: np.ndarray, at: np.ndarray, sums: Sums, rows: np.ndarray, path: np.ndarray, total: np.ndarray,
              may: np.ndarray, depth: int, above: Above | None, at_end: np.ndarray, *rest) -> list[dict]:
    """:func:`_levels` of every group of nodes, put together level by level; ``base`` is the first node's number."""
    among, seen = np.flatnonzero(may), len(sums.columns[0])
    of_row = group[among][at].astype(np.uint16 if group[-1] < 1 << 16 else np.int64)
    order = np.argsort(of_row, kind="stable")
    ends, nodes = np.cumsum(np.bincount(of_row, minlength=group[-1] + 1)), np.searchsorted(group, np.arange(group[-1] + 2))
    parts = []
    for k, (a, b) in enumerate(zip(nodes, nodes[1:])):
        here = order[ends[k - 1] if k else 0:ends[k]]
        first, last = np.searchsorted(among, [a, b])
        up = above and Above(above.hist, above.parent[first:last], above.counted[first:last], above.sibling[first:last] - first)
        mine = rows[here]
        found = _levels(x.take(here, axis=1), at[here] - first, sums.take(here[:np.searchsorted(here, seen)]), mine, path[a:b], total[:, a:b],
                        may[a:b], depth, up, at_end, *rest)
        parts.append((mine, found))
    starts, out = [[] for _ in parts], []
    for j in range(max(len(found) for _, found in parts)):
        for start, (_, found) in zip(starts, parts):
            if j < len(found):
                start.append(base + np.arange(len(found[j]["path"])))
                base += len(found[j]["path"])
    number = [np.concatenate(s) for s in starts]
    for to, (mine, found) in zip(number, parts):
        at_end[mine] = to[at_end[mine]]
        for level in found:
            inner = level["feature"] >= 0
            for side in ("left", "right"):
                level[side][inner] = to[level[side][inner]]
    for j in range(max(len(found) for _, found in parts)):
        here = [found[j] for _, found in parts if j < len(found)]
        out.append({name: np.concatenate([level[name] for level in here]) for name in here[0]})
    return out


def _may(total: np.ndarray, p: TreeParams, width: int, depth: int) -> np.ndarray:
    """The nodes that a split is looked for."""
    may = total[2] >= max(p.min_split, 2 * p.min_rows)
    if depth >= min(p.max_depth, MAX_DEPTH) or width < 2:
        may[:] = False
    if not p.boosted:
        share = np.divide(total[0], total[1], out=np.zeros(total.shape[1]), where=total[1] > 0)
        may &= share * (1 - share) > 1e-7
    return may


@dataclass
class Sums:
    """g, h and n of rows in as few columns of whole numbers as hold them.  Of trees that are not
    boosted h is n in units, and for labels 0 and 1 g and n lie in different bits of one number."""
    columns: list[np.ndarray]
    boosted: bool

    @staticmethod
    def of(g: np.ndarray, h: np.ndarray, n: np.ndarray, boosted: bool) -> Sums:
        if boosted:
            return Sums([g, h, n], boosted)
        if n.sum() < SCALE and not np.any((g < 0) | (g > n * SCALE) | (g % SCALE != 0)):
            return Sums([g + n], boosted)
        return Sums([g, n], boosted)

    def take(self, rows: np.ndarray) -> Sums:
        return Sums([c[rows] for c in self.columns], self.boosted)

    def closed(self, total: np.ndarray) -> np.ndarray:
        """Sums (g, h, n) as these columns."""
        if self.boosted:
            return total.astype(float)
        return (total[:1] + total[2:] if len(self.columns) == 1 else total[[0, 2]]).astype(float)

    def opened(self, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(g / SCALE, h / SCALE, n) of summed columns."""
        if self.boosted:
            return columns[0] * (1 / SCALE), columns[1] * (1 / SCALE), columns[2]
        if len(columns) == 1:
            g = np.floor(columns[0] * (1 / SCALE))
            n = columns[0] - g * SCALE
        else:
            g, n = columns[0] * (1 / SCALE), columns[1]
        return g, n, n


@dataclass
class Above:
    """The histograms of the parents of a level's nodes (columns x features x parents x bins)."""
    hist: np.ndarray
    parent: np.ndarray   # by node
    counted: np.ndarray  # nodes whose rows are counted
    sibling: np.ndarray  # by node; of the others, which is less the sibling

    @staticmethod
    def of(hist: np.ndarray, parent: np.ndarray, may: np.ndarray, n: np.ndarray) -> Above:
        child = np.arange(len(may))
        counted = ~may[child ^ 1] | (n < n[child ^ 1]) | ((n == n[child ^ 1]) & (child % 2 == 0))
        return Above(hist, parent[may], counted[may], (np.cumsum(may) - 1)[child ^ 1][may])


def _histograms(x: np.ndarray, at: np.ndarray, sums: Sums, k: int, bits: int, above: Above | None) -> np.ndarray:
    """Columns x features x nodes x bins; of two siblings only the smaller one is counted."""
    x, at = x[:, :len(sums.columns[0])], at[:len(sums.columns[0])]
    counted = np.arange(k) if above is None else np.flatnonzero(above.counted)
    place = np.full(k, -1)
    place[counted] = np.arange(len(counted))
    size = len(counted) << bits
    out, step = np.zeros((len(sums.columns), len(x), size)), max(STEP, 4 * size)
    for first in range(0, len(at), step):
        some = slice(first, first + step)
        base, bins, columns = at[some], x[:, some], [c[some] for c in sums.columns]
        if len(counted) < k:
            base = place[base]
            rows = np.flatnonzero(base >= 0)
            base, bins, columns = base[rows], bins.take(rows, axis=1), [c[rows] for c in columns]
        base = base << bits
        once = sums.boosted and bool((columns[2] == 1).all())
        for j in range(len(x)):
            key = base + bins[j]
            for i, c in enumerate(columns):
                out[i, j] += np.bincount(key, None if i == 2 and once else c, size)
    out = out.reshape(*out.shape[:2], len(counted), -1)
    if len(counted) == k:
        return out
    hist = np.empty((*out.shape[:2], k, 1 << bits))
    hist[:, :, counted] = out
    rest = np.flatnonzero(~above.counted)
    hist[:, :, rest] = above.hist[:, :, above.parent[rest]] - hist[:, :, above.sibling[rest]]
    return hist


def _best(x: np.ndarray, at: np.ndarray, sums: Sums, total: np.ndarray, allowed: np.ndarray, p: TreeParams, width: int,
          above: Above | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(gain, feature, bin, left sums) of the best split of every node, the first of equal ones; the
    histograms if they were counted."""
    k, seen, bits = total.shape[1], len(sums.columns[0]), int(width - 1).bit_length()
    gain, where, cut, left = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64), np.zeros((3, k), np.int64)
    whole, (g, h, n) = score(total.T, p.l2), (total[0] / SCALE, total[1] / SCALE, total[2].astype(float))
    of_node = sums.closed(total)
    hist = _histograms(x, at, sums, k, bits, above) if k << bits <= DENSE * seen else None

    def offer(node: np.ndarray, bins: np.ndarray, run: np.ndarray, j: int) -> None:
        """Candidates in the order of node and bin."""
        lg, lh, ln = sums.opened(run)
        rg, rn = g[node] - lg, n[node] - ln
        rh = rn if lh is ln else h[node] - lh
        ok = (ln >= p.min_rows) & (rn >= p.min_rows) & (lh > 0) & (rh > 0)
        if p.min_hess:
            ok &= (lh >= p.min_hess) & (rh >= p.min_hess)
        with np.errstate(divide="ignore", invalid="ignore"):
            got = lg * lg / (lh + p.l2) + rg * rg / (rh + p.l2) - whole[node]
        got[~ok] = -np.inf
        start = np.flatnonzero(_changes(node))
        top = np.maximum.reduceat(got, start)
        is_top = np.flatnonzero(got == np.repeat(top, np.diff(start, append=len(node))))
        is_top = is_top[_changes(node[is_top])]
        is_top = is_top[got[is_top] > gain[node[is_top]]]
        to = node[is_top]
        gain[to], where[to], cut[to] = got[is_top], j, bins[is_top]
        left[:, to] = lg[is_top] * SCALE, lh[is_top] * SCALE, ln[is_top]

    for j in np.flatnonzero(allowed.any(axis=0)):
        everywhere = bool(allowed[:, j].all())
        if hist is not None:
            cells = hist[:, j].reshape(len(hist), -1)
            key = np.flatnonzero(cells[-1])
            if not everywhere:
                key = key[allowed[:, j][key >> bits]]
            node, run = key >> bits, np.cumsum(cells, axis=1)[:, key]
            before = of_node
        else:
            a, b, s = at[:seen], x[j, :seen], sums.columns
            if not everywhere:
                use = np.flatnonzero(allowed[:, j][a])
                a, b, s = a[use], b[use], [c[use] for c in s]
            key, run = _runs((a << bits) + b, s, k << bits)
            node, before = key >> bits, of_node * allowed[:, j]
        before = np.cumsum(before, axis=1) - before  # the nodes in front of a node
        if len(key):
            offer(node, key & ((1 << bits) - 1), run - before[:, node], int(j))
    return gain, where, cut, left, hist


def _runs(key: np.ndarray, columns: list[np.ndarray], size: int) -> tuple[np.ndarray, np.ndarray]:
    """(the keys that occur, ascending; the columns added up to the end of each)."""
    if len(columns) == 1:  # g + n of few rows: both go into the low bits of what is sorted
        times = columns[0].astype(np.int64)
        n, ones = times & (SCALE - 1), times >> 26
        most = int(n.max(initial=1)).bit_length()
        if int(size).bit_length() + 2 * most < 63:
            both = np.sort((key << 2 * most) | (ones << most) | n)
            key, low = both >> 2 * most, (1 << most) - 1
            ends = np.flatnonzero(_changes(key, -1))
            run = np.cumsum((((both >> most) & low) << 26) + (both & low))[ends]
            return key[ends], run[None].astype(float)
    order = np.argsort(key.astype(np.uint32) if size < 1 << 32 else key)
    key = key[order]
    ends = np.flatnonzero(_changes(key, -1))
    return key[ends], np.stack([np.cumsum(c[order])[ends] for c in columns])


# ---------------------------------------------------------------- models

@dataclass
class TreeModel:
    """Fitted trees.  ``transform`` adds ``p``."""
    bins: Bins
    params: TreeParams
    trees: Sequence[Tree]
    start: float = 0.0
    _reached: list | None = None  # of the trees, in the task that uses them

    def slim(self) -> TreeModel:
        return TreeModel(self.bins, self.params, [slim(t) for t in self.trees], self.start)

    @property
    def features(self) -> list[str]:
        return self.bins.features

    def score(self, m: np.ndarray, counts: Sequence[int] | None = None) -> list[np.ndarray]:
        """p of a bin matrix after each of the (ascending) tree counts."""
        counts = [len(self.trees)] if counts is None else list(counts)
        total, out = np.full(len(m), self.start), []
        for k in range(max(counts) + 1):
            out += [total / (1 if self.params.boosted else max(k, 1))] * counts.count(k)
            if k < max(counts):
                total = with_trees(total, self.trees[k:k + 1], m)
        return [1.0 / (1.0 + np.exp(-x)) for x in out] if self.params.boosted else out

    def transform(self, df: DataFrame, output: str = "p", where: Column | None = None) -> DataFrame:
        """``df`` with the prediction; only of the rows that ``where`` holds for, if given (the others': null)."""
        sent = df.sparkSession.sparkContext.broadcast(self.slim())

        @F.pandas_udf("double")
        def p(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
            model = sent.value
            for rows in it:
                use = np.flatnonzero(rows.pop("use").to_numpy(dtype=bool))
                out = np.full(len(rows), np.nan)
                if len(use):
                    out[use] = model.score(model.bins.of([rows[c].to_numpy()[use] for c in rows]))[0]
                yield pd.Series(out)

        columns = [required(f, f).cast("double").alias(f"f{k}") for k, f in enumerate(self.bins.features)]
        used = F.lit(True) if where is None else F.coalesce(where, F.lit(False))
        found = p(F.struct(*columns, used.alias("use")))
        return df.withColumn(output, found if where is None else F.when(used, found))

    def node_table(self, spark: SparkSession) -> DataFrame:
        """(tree, node, feature, cut, gain, value, n): the fitted nodes; a leaf has no feature."""
        rows = []
        for k, t in enumerate(self.trees):
            for i in range(len(t.path)):
                split = t.feature[i] >= 0
                rows.append((k, int(t.path[i]), self.bins.features[t.feature[i]] if split else None,
                             float(self.bins.cuts[t.feature[i]][t.bin[i]]) if split else None,
                             t.gain[i] if split else None, t.value[i], t.n[i]))
        return spark.createDataFrame(rows, "tree INT, node LONG, feature STRING, cut DOUBLE, gain DOUBLE, value DOUBLE, n LONG")


def reached(tree: Tree, n_features: int, width: int) -> tuple[np.ndarray, np.ndarray] | None:
    """(features x bins: the leaves, as bits, that a bin of a feature does not rule out; the leaves' values):
    a row's leaf is the one bit that all its features have.  None beyond 63 leaves."""
    leaves = [k for k, f in enumerate(tree.feature) if f < 0]
    if len(leaves) > 63:
        return None
    masks, number = np.zeros((n_features, width), np.uint64), {k: i for i, k in enumerate(leaves)}
    stack = [(0, [(0, width)] * n_features)]
    while stack:
        k, box = stack.pop()
        f = tree.feature[k]
        if f < 0:
            for j, (lo, hi) in enumerate(box):
                masks[j, lo:hi] |= np.uint64(1 << number[k])
            continue
        (lo, hi), cut = box[f], tree.bin[k] + 1
        stack += [(tree.left[k], [*box[:f], (lo, min(hi, cut)), *box[f + 1:]]),
                  (tree.left[k] + 1, [*box[:f], (max(lo, cut), hi), *box[f + 1:]])]
    return masks, np.array([tree.value[k] for k in leaves])


def mixed_scores(model: TreeModel, own: np.ndarray, inside: Sequence[int], back: np.ndarray) -> np.ndarray:
    """p of every row that takes the features ``inside`` from a row of ``own`` and the others from a row
    of the bin matrix ``back`` (own x back); the same as :meth:`TreeModel.score` of the mixed rows."""
    n_features, width = back.shape[1], model.bins.width
    outside = [j for j in range(n_features) if j not in set(inside)]
    total, whole = np.full((len(own), len(back)), model.start), None
    if model._reached is None:
        model._reached = [reached(t, n_features, width) for t in model.trees]
    for t, known in zip(model.trees, model._reached):
        if known is None:
            if whole is None:
                whole = np.tile(back, (len(own), 1))
                whole[:, inside] = np.repeat(own, len(back), axis=0)
            total = total + t.predict(whole).reshape(total.shape)
            continue
        a, b = np.full(len(own), ~np.uint64(0)), np.full(len(back), ~np.uint64(0))
        for i, j in enumerate(inside):
            a &= known[0][j][own[:, i]]
        for j in outside:
            b &= known[0][j][back[:, j]]
        bit = (a[:, None] & b).astype(np.float64).view(np.int64) >> 52  # one bit: its exponent
        total = total + known[1][bit - 1023]
    if not model.params.boosted:
        return total / max(len(model.trees), 1)
    return 1.0 / (1.0 + np.exp(-total))


@dataclass
class Binned:
    """A training table, binned and written once for any number of fits."""
    bins: Bins
    table: DataFrame
    rows: int
    mean: float
    _sent: object = None

    def held(self):
        """The rows of a small table, sent to the executors once."""
        if self._sent is None:
            rows = self.table.toArrow()  # at most SMALL_CELLS values
            m = as_matrix(rows["bins"].combine_chunks(), np.uint16, len(self.bins.features))
            here = Held.of(rows["id"].to_numpy(), rows["y"].to_numpy(), m, self.bins.width,
                           rows["times"].to_numpy() if "times" in self.table.columns else None)
            self._sent = self.table.sparkSession.sparkContext.broadcast(here)
        return self._sent

    def small(self) -> bool:
        return self.rows * (len(self.bins.features) + 8) <= SMALL_CELLS


class Forest(Sequence):
    """The trees of a forest over a small table.  Grown-out trees have as many nodes as rows, so they
    are grown where they are used (a tree follows from its number), and brought here only when asked for.
    ``cut``: what :func:`cut_back` makes of every tree, before it leaves its task."""

    def __init__(self, data: Binned, params: TreeParams, count: int, cut: tuple[int | None, int, float] | None = None) -> None:
        self.data, self.params, self.count, self.cut, self.found = data, params, count, cut, None

    def __len__(self) -> int:
        return self.count

    def __getitem__(self, k):
        if isinstance(k, slice) and self.found is None and k.start is None and k.step is None:
            return Forest(self.data, self.params, len(range(self.count)[k]), self.cut)
        if self.found is None:
            units = [(0, t, min(t + TREES_A_TASK, self.count)) for t in range(0, self.count, TREES_A_TASK)]
            self.found = _collected(self.data, [self.params], units, self.cut)[0]
        return self.found[k]


def prepare(df: DataFrame, features: Sequence[str], label: str = "y", id_col: str = "row_id",
            max_bins: int = MAX_BINS, known: dict[str, np.ndarray] | None = None) -> Binned:
    df = materialize(df.select(id_col, label, *features), "tree_rows")
    bins = fit_bins(df, features, max_bins, known)
    table = materialize(binned(df, bins, label, id_col), "binned")
    rows, total = table.agg(F.count("y"), F.sum("y")).first()
    if not rows:
        raise ValueError("no training rows")
    return Binned(bins, table, rows, total / rows)


def fit_all(data: Binned, params: Sequence[TreeParams], stay: bool = False) -> list[TreeModel]:
    """Fits all models together: boosted ones tree by tree in lockstep, the trees of the others all
    at once (in groups whose root histograms fit a pass).

    A table counted to have at most ``SMALL_CELLS`` values is broadcast instead, and the models
    (of a forest its trees) are dealt out to the tasks, which hold the rows of every node: sums
    are whole numbers and margins add up tree by tree, so the models are the same, bit for bit.
    So is a larger table whose rows have few distinct bins, where every model sees all rows.
    ``stay``: single trees stay where they are grown as well, like those of a :class:`Forest`."""
    if data.small():
        return fit_dealt_out(data, params, stay)
    if data.rows <= MAX_TIMES and all(p.rows != "bootstrap" and p.rows >= 1.0 for p in params):
        same = materialize(data.table.groupBy("bins", "y").agg(F.count(F.lit(1)).alias("times"))
                           .select(F.lit(0).cast("long").alias("id"), "y", "bins", "times"), "binned_rows")
        fewer = Binned(data.bins, same, same.count(), data.mean)
        if fewer.small():
            return fit_dealt_out(fewer, params, stay)
    boosted = [k for k, p in enumerate(params) if p.boosted]
    models: list[TreeModel | None] = [None] * len(params)
    f, width = len(data.bins.features), data.bins.width
    if boosted:
        for k, m in zip(boosted, boost(data, [params[k] for k in boosted])):
            models[k] = m
    rest = [(k, params[k], t) for k, p in enumerate(params) if not p.boosted for t in range(p.trees)]
    trees: dict[int, list[Tree]] = {k: [] for k, p in enumerate(params) if not p.boosted}
    for i in range(0, len(rest), at_once(f, width)):
        part = rest[i:i + at_once(f, width)]
        for (k, _, _), tree in zip(part, grow(lambda jobs: counted(data.table, jobs, [], f, width, 0), part, f, width)):
            trees[k].append(tree)
    for k, found in trees.items():
        models[k] = TreeModel(data.bins, params[k], found)
    return models


def at_once(n_features: int, width: int) -> int:
    return max(1, PASS_CELLS // (n_features * width * 4))


def start_of(data: Binned) -> float:
    return math.log(data.mean / (1 - data.mean)) if 0 < data.mean < 1 else 0.0


def boost(data: Binned, params: Sequence[TreeParams]) -> list[TreeModel]:
    f, width, n, start = len(data.bins.features), data.bins.width, len(params), start_of(data)
    state = data.table.withColumn("margins", F.lit(np.full(n, start).tobytes()))
    models = [TreeModel(data.bins, p, [], start) for p in params]
    since: list[list[Tree]] = [[] for _ in params]
    for t in range(max(p.trees for p in params)):
        live = [k for k, p in enumerate(params) if t < p.trees]
        grown = grow(lambda jobs: counted(state, jobs, since, f, width, n), [(k, params[k], t) for k in live], f, width)
        for k, tree in zip(live, grown):
            models[k].trees.append(tree)
            since[k].append(tree)
        if (t + 1) % SAVE_EVERY == 0:
            state = materialize(advanced(state, since, f, n), "margins")
            since = [[] for _ in params]
    return models


def fit_dealt_out(data: Binned, params: Sequence[TreeParams], stay: bool = False) -> list[TreeModel]:
    later = [not p.boosted and p.trees > (0 if stay else 1) and p.max_depth > 10 and not p.num_leaves for p in params]
    units = [(k, 0, p.trees) for k, p in enumerate(params) if p.boosted]
    units.sort(key=lambda u: -u[2] * (params[u[0]].num_leaves or 4 * params[u[0]].max_depth))  # the longest first
    units += [(k, t, min(t + TREES_AT_ONCE, p.trees)) for k, p in enumerate(params) if not p.boosted and not later[k]
              for t in range(0, p.trees, TREES_AT_ONCE)]
    found = _collected(data, params, units)
    return [TreeModel(data.bins, p, Forest(data, p, p.trees) if later[k] else found[k], start_of(data) if p.boosted else 0.0)
            for k, p in enumerate(params)]


def _units(data: Binned, params: Sequence[TreeParams], units: list[tuple[int, int, int]], use: Callable, schema: pa.Schema,
           names: str) -> DataFrame:
    """One task a unit (model, first tree, end): grows its trees and yields the records that ``use(unit, trees, held)`` makes of them."""
    sent, width, start, params = data.held(), data.bins.width, start_of(data), list(params)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here = sent.value

        def trees(k: int, first: int, last: int) -> Iterator[tuple[Tree, np.ndarray]]:
            margin = np.full(len(here.m), start)
            for t in range(first, last):
                tree, at = grown_here(here, params[k], t, width, margin)
                if params[k].boosted:
                    margin = margin + np.asarray(tree.value)[at]
                yield tree, at

        for b in batches:
            for unit in b.column(0).to_pylist():
                for record in use(unit, trees(*units[unit]), here):
                    yield pa.RecordBatch.from_pylist([record], schema)

    return data.table.sparkSession.range(0, len(units), 1, max(len(units), 1)).mapInArrow(work, names)


def _collected(data: Binned, params: Sequence[TreeParams], units: list[tuple[int, int, int]],
               cut: tuple[int | None, int, float] | None = None) -> list[list[Tree]]:
    def one(t: Tree) -> dict:
        return (cut_back(t, *cut) if cut else t).__dict__

    out: list[list[Tree]] = [[] for _ in params]
    if units:
        found = _units(data, params, units, lambda unit, trees, _: [{"unit": unit, "trees": pickle.dumps([one(t) for t, _ in trees])}],
                       pa.schema([("unit", pa.int64()), ("trees", pa.binary())]), "unit long, trees binary").collect()
        for r in sorted(found, key=lambda r: units[r["unit"]]):
            for t in pickle.loads(r["trees"]):
                out[units[r["unit"]][0]].append(Tree(**t))
    return out


def advanced(state: DataFrame, since: list[list[Tree]], n_features: int, n_models: int) -> DataFrame:
    """The margins with the trees since the last save added."""
    sent = state.sparkSession.sparkContext.broadcast(since)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m = as_matrix(b.column(2), np.uint16, n_features)
            margins = as_matrix(b.column(3), np.float64, n_models).copy()
            for k, trees in enumerate(sent.value):
                margins[:, k] = with_trees(margins[:, k], trees, m)
            yield pa.RecordBatch.from_arrays([*b.columns[:3], as_binary(margins)], b.schema.names)

    return state.mapInArrow(work, state.schema)


def staged(models: Sequence[TreeModel], df: DataFrame, points: Sequence[tuple[int, int]], label: str = "y",
           id_col: str = "row_id", dataset: str = "val") -> DataFrame:
    """The long ``scored`` table of points (model index, tree count): one scan scores every prefix;
    ``model`` is the point's position."""
    bins = models[0].bins
    if all(isinstance(m.trees, Forest) for m in models) and all(c for _, c in points):
        parts = max(1, -(-df.count() * (len(bins.features) + 8) // SMALL_CELLS))
        part = F.pmod(F.xxhash64(id_col), F.lit(parts))
        return functools.reduce(DataFrame.unionByName, [
            _staged_forests(models, df if parts == 1 else df.where(part == k), points, label, id_col, dataset) for k in range(parts)])
    sent = df.sparkSession.sparkContext.broadcast(([m.slim() for m in models], list(points)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, points = sent.value
        for b in batches:
            m = models[0].bins.of([b.column(k + 2).to_numpy() for k in range(len(models[0].bins.features))])
            p = [None] * len(points)
            for i, model in enumerate(models):
                mine = sorted((c, k) for k, (j, c) in enumerate(points) if j == i)
                if mine:
                    for (_, k), x in zip(mine, model.score(m, [c for c, _ in mine])):
                        p[k] = x
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(np.stack(p, axis=1)), pa.list_(pa.float64()))],
                                             ["row_id", "y", "p"])

    cols = [required(f, f).cast("double").alias(f"f{k}") for k, f in enumerate(bins.features)]
    rows = df.select(F.col(id_col).cast("long").alias("row_id"), required(label, label).cast("int").alias("y"), *cols)
    # thousands of trees a row: a small table lies in few partitions, so it is dealt out to all cores
    wide = rows.repartition(4 * df.sparkSession.sparkContext.defaultParallelism, "row_id").mapInArrow(work, "row_id long, y int, p array<double>")
    return wide.select(F.lit(dataset).alias("dataset"), F.posexplode("p").alias("model", "p"), "row_id", "y").select(
        "dataset", F.col("model").cast("string").alias("model"), "row_id", "y", "p")


def _staged_forests(models: Sequence[TreeModel], df: DataFrame, points: Sequence[tuple[int, int]], label: str, id_col: str,
                    dataset: str) -> DataFrame:
    """The trees are scored where they are grown; what leaves a task is its sum by row."""
    bins, spark = models[0].bins, df.sparkSession
    data = models[0].trees.data
    rows = binned(df, bins, label, id_col).toArrow()  # counted to be small
    ids, y = rows["id"].to_numpy(), rows["y"].to_numpy()
    sent = spark.sparkContext.broadcast(Held.of(ids, y, as_matrix(rows["bins"].combine_chunks(), np.uint16, len(bins.features)),
                                                bins.width))
    # models of one fit that are cut in different ways share the trees, each is grown once
    fits = list(dict.fromkeys(m.params for m in models))
    kinds = list(dict.fromkeys((fits.index(m.params), m.trees.cut) for m in models))
    kind_of = [kinds.index((fits.index(m.params), m.trees.cut)) for m in models]
    units = []
    for k in range(len(fits)):
        ends = sorted({0, *(c for j, c in points if kinds[kind_of[j]][0] == k)})
        units += [(k, t, min(t + TREES_A_TASK, last)) for first, last in zip(ends, ends[1:]) for t in range(first, last, TREES_A_TASK)]

    def add(unit: int, trees, _) -> Iterator[dict]:
        m, (fit, _, end) = sent.value.m, units[unit]
        mine = [(i, cut) for i, (k, cut) in enumerate(kinds) if k == fit]
        grown = (t for t, _ in trees)
        if mine == [(mine[0][0], None)]:
            totals = iter([(mine[0][0], sum(t.predict(m) for t in grown))])
        elif end - units[unit][1] == 1:  # one cut at a time
            totals = ((mine[i][0], t.predict(m)) for i, t in each_cut(next(grown), [cut or WHOLE for _, cut in mine]))
        else:
            cut = [cut_backs(t, [c or WHOLE for _, c in mine]) for t in grown]
            totals = ((i, sum(t[k].predict(m) for t in cut)) for k, (i, _) in enumerate(mine))
        for i, total in totals:
            for k, first in enumerate(range(0, len(m), SLICE)):
                yield {"model": i, "slice": k, "end": end, "data": total[first:first + SLICE].tobytes()}

    def scored(pdf: pd.DataFrame) -> pd.DataFrame:
        here, model, first = sent.value, int(pdf["model"].iloc[0]), int(pdf["slice"].iloc[0]) * SLICE
        parts = pdf.sort_values("end")
        ends, data, done, out = parts["end"].to_list(), parts["data"].to_list(), 0, []
        last = first + len(data[0]) // 8
        # the rows lie in the order of their cells
        at = slice(first, last) if here.cell is None else slice(*np.searchsorted(here.cell, [first, last]))
        total = np.zeros(last - first)
        for c, k in sorted((c, k) for k, (j, c) in enumerate(points) if kind_of[j] == model):
            while done < len(ends) and ends[done] <= c:
                total = total + np.frombuffer(data[done])
                done += 1
            p = total / max(c, 1)
            out.append(pd.DataFrame({"model": np.int32(k), "row_id": here.ids[at], "y": here.y[at].astype(np.int32),
                                     "p": p if here.cell is None else p[here.cell[at] - first]}))
        return pd.concat(out)

    sums = _units(data, fits, units, add, pa.schema([
        ("model", pa.int32()), ("slice", pa.int32()), ("end", pa.int32()), ("data", pa.binary())]), "model int, slice int, end int, data binary")

    long = sums.groupBy("model", "slice").applyInPandas(scored, "model int, row_id long, y int, p double")
    return long.select(F.lit(dataset).alias("dataset"), F.col("model").cast("string").alias("model"), "row_id", "y", "p")


# ---------------------------------------------------------------- pruning, out-of-bag

def pruned_alphas(tree: Tree) -> list[float]:
    """Weakest-link pruning: by node, the alpha from which the node is a leaf (its own split goes,
    or one above it).  The risk of a node is its Gini impurity times its share of the rows."""
    n = len(tree.path)
    total = tree.h[0]
    risk = [2 * tree.g[k] * (tree.h[k] - tree.g[k]) / tree.h[k] / total if tree.h[k] else 0.0 for k in range(n)]
    inner = [tree.feature[k] >= 0 for k in range(n)]
    gone, alpha = [0.0 if not i else math.inf for i in inner], 0.0
    sums, leaves, parent = list(risk), [1] * n, [-1] * n
    for k in range(n - 1, -1, -1):  # children come after their parents
        if inner[k]:
            a, b = tree.left[k], tree.right[k]
            sums[k], leaves[k], parent[a], parent[b] = sums[a] + sums[b], leaves[a] + leaves[b], k, k
    link = [(risk[k] - sums[k]) / (leaves[k] - 1) if inner[k] else math.inf for k in range(n)]
    heap = [(link[k], k) for k in range(n) if inner[k]]
    heapq.heapify(heap)
    while inner[0]:
        at, weakest = heapq.heappop(heap)
        if not inner[weakest] or at != link[weakest]:
            continue  # gone, or changed since
        alpha = max(alpha, at)
        stack = [weakest]
        while stack:
            k = stack.pop()
            if inner[k]:
                inner[k], gone[k] = False, alpha
                stack += [tree.left[k], tree.right[k]]
        sums[weakest], leaves[weakest] = risk[weakest], 1
        k = parent[weakest]
        while k >= 0:  # only the nodes above have changed
            a, b = tree.left[k], tree.right[k]
            sums[k], leaves[k] = sums[a] + sums[b], leaves[a] + leaves[b]
            link[k] = (risk[k] - sums[k]) / (leaves[k] - 1)
            heapq.heappush(heap, (link[k], k))
            k = parent[k]
    return gone


def cut_back(tree: Tree, max_depth: int | None = None, min_split: int = 2, ccp_alpha: float = 0.0) -> Tree:
    """The tree that the same data give under a lower depth bound or a higher ``min_split`` (a node's
    split depends on neither), pruned by weakest links up to ``ccp_alpha``."""
    return cut_backs(tree, [(max_depth, min_split, ccp_alpha)])[0]


WHOLE = (None, 2, 0.0)  # the cut that leaves a tree as it is


def cut_backs(tree: Tree, cuts: Sequence[tuple[int | None, int, float]]) -> list[Tree]:
    """:func:`cut_back` for many (depth, ``min_split``, alpha)."""
    found = dict(each_cut(tree, cuts))
    return [found[i] for i in range(len(cuts))]


def each_cut(tree: Tree, cuts: Sequence[tuple[int | None, int, float]]) -> Iterator[tuple[int, Tree]]:
    """(place in ``cuts``, the tree), one truncation after the other."""
    depth = depths(tree)
    for deepest, least in dict.fromkeys(c[:2] for c in cuts):
        keep = np.asarray(tree.n) >= least
        if deepest is not None:
            keep &= depth < deepest
        short = _without(tree, ~keep)
        for i, c in enumerate(cuts):
            if c[:2] == (deepest, least):
                yield i, short if c[2] <= 0 else _without(short, pruned(short, c[2]))


def depths(tree: Tree) -> np.ndarray:
    depth = np.frexp(np.asarray(tree.path, float))[1] - 1  # paths are below 2^61: a power of two is never passed by rounding
    return depth - (np.asarray(tree.path) < np.left_shift(np.int64(1), np.minimum(depth, 62).astype(np.int64)))


def pruned(tree: Tree, alpha: float) -> np.ndarray:
    """The nodes whose :func:`pruned_alphas` are ``alpha`` or less, level by level from below: a node is a
    leaf if its link to what is left of its subtree at ``alpha`` is no stronger.  Nodes lie as in :func:`compact`."""
    g, h, n = (np.asarray(x, float) for x in (tree.g, tree.h, tree.n))
    risk = np.divide(2 * g * (h - g), h, out=np.zeros(len(h)), where=h > 0) / h[0]
    feature, left, depth = np.asarray(tree.feature), np.asarray(tree.left, np.int64), depths(tree)
    sums, leaves, leaf = risk.copy(), np.ones(len(n), np.int64), feature < 0
    starts = np.searchsorted(depth, np.arange(depth[-1] + 2))
    for first, last in zip(starts[-2::-1], starts[:0:-1]):
        inner = first + np.flatnonzero(feature[first:last] >= 0)
        a = left[inner]
        below, count = sums[a] + sums[a + 1], leaves[a] + leaves[a + 1]
        gone = (risk[inner] - below) / (count - 1) <= alpha
        leaf[inner] = gone
        sums[inner], leaves[inner] = np.where(gone, risk[inner], below), np.where(gone, 1, count)
    return leaf


def _without(tree: Tree, leaf: np.ndarray) -> Tree:
    """The tree whose marked nodes are leaves."""
    t = Tree(tree.number)
    for name in KEPT:
        setattr(t, name, getattr(tree, name))
    t.feature = np.where(leaf, -1, np.asarray(tree.feature))
    return compact(t)


def out_of_bag(model: TreeModel, data: Binned) -> DataFrame:
    """(row_id, y, votes, p): for every training row the mean of the trees that have not seen it (null
    where all have).  Which ones those are follows from the hash of (seed, tree, row id)."""
    f = len(data.bins.features)
    if data.small():
        return _out_of_bag_dealt(model, data)
    sent = data.table.sparkSession.sparkContext.broadcast(model.slim())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for b in batches:
            ids, m = b.column(0).to_numpy(), as_matrix(b.column(2), np.uint16, f)
            total, votes = np.zeros(len(ids)), np.zeros(len(ids), np.int64)
            for t in model.trees:
                w = row_weights(ids, model.params.rows, model.params.seed, t.number)
                if w is not None:
                    free = np.flatnonzero(w == 0)
                    total[free] += t.predict(m[free])
                    votes[free] += 1
            p = pa.array(total / np.maximum(votes, 1), mask=votes == 0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(votes), p], ["row_id", "y", "votes", "p"])

    return data.table.mapInArrow(work, "row_id long, y double, votes long, p double")


def _out_of_bag_dealt(model: TreeModel, data: Binned) -> DataFrame:
    """The votes over the held rows: those of a :class:`Forest` are cast where its trees are grown.  Every task
    sums the votes of its trees by row, and slices of rows are added up."""
    spark, p, sent = data.table.sparkSession, model.params, data.held()
    units = [(0, t, min(t + TREES_A_TASK, len(model.trees))) for t in range(0, len(model.trees), TREES_A_TASK)]
    known = None if isinstance(model.trees, Forest) else spark.sparkContext.broadcast(model.slim())

    def votes(unit: int, trees, here: Held) -> Iterator[dict]:
        sums, seen = np.zeros(len(here.ids)), np.zeros(len(here.ids), np.uint8)
        for t in known.value.trees[units[unit][1]:units[unit][2]] if known else (t for t, _ in trees):
            w = row_weights(here.ids, p.rows, p.seed, t.number)
            if w is None:
                continue
            free = w == 0
            if here.cell is None:
                at = np.flatnonzero(free)
                sums[at] += t.predict(here.m[at])
            else:
                got = t.predict(here.m).take(here.cell)
                got *= free
                sums += got
            seen += free
        for k, first in enumerate(range(0, len(sums), SLICE)):
            yield {"slice": k, "part": unit, "sums": sums[first:first + SLICE].tobytes(), "votes": seen[first:first + SLICE].tobytes()}

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        here, first = sent.value, int(pdf["slice"].iloc[0]) * SLICE
        parts = pdf.sort_values("part")
        sums = sum(np.frombuffer(x) for x in parts["sums"])
        n = sum(np.frombuffer(x, np.uint8).astype(np.int64) for x in parts["votes"])
        at = slice(first, first + len(sums))
        return pd.DataFrame({"row_id": here.ids[at], "y": here.y[at], "votes": n,
                             "p": pd.array(pa.array(sums / np.maximum(n, 1), mask=n == 0), dtype=pd.ArrowDtype(pa.float64()))})

    parts = _units(data, [p], units, votes, pa.schema([("slice", pa.int32()), ("part", pa.int32()), ("sums", pa.binary()), ("votes", pa.binary())]),
                   "slice int, part int, sums binary, votes binary")
    return parts.groupBy("slice").applyInPandas(added, "row_id long, y double, votes long, p double")
