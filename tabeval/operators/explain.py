"""Shapley-value explanations of any probability model (Kernel SHAP and exact).

Every explanation here is one fixed linear map applied to coalition values:
for evaluation row x, coalition S and background sample B,

    v(S) = mean over b in B of f(x_S, b_not_S),     phi_j = sum over S of K[j, S] * v(S)

- exact mode: all 2^M coalitions, K[j, S] = w(|S|-1) if j in S else -w(|S|),
  w(s) = s!(M-s-1)!/M!  (the Shapley formula);
- kernel mode: sampled coalitions with the Shapley kernel, and K the solution map
  of the weighted least squares with the efficiency constraint (Lundberg & Lee 2017),
  computed once on the driver (M x C numbers, C = the coalition budget).

Kernel mode with ``l1`` ("aic" or "bic") is not linear: every row picks its own features on the
L1 path of the kernel regression by that criterion and the efficient solution is refitted on
them.  The design is the same for all rows, so a row's regression is known by M + 3 sums over
its coalitions; Spark adds these up and only they meet the small path solver.

Models come in two forms:

- ``SqlModel``: a SQL expression in the feature names.  A few evaluations per row are
  written out in a projection; beyond that the rows are dealt out by id once and
  v(S) is an aggregation inside the task over literal background and coalitions.
- any pyspark.ml ``Transformer`` producing a probability column (e.g. a fitted
  ``PipelineModel``): each evaluation row is expanded to coalitions x background
  rows (a bounded generator: C x |B| per row), scored by ``transform``, averaged
  per (row, coalition) and mapped by K.  Rows are hash-partitioned by id first,
  so both aggregations run without a further shuffle.

The background is a sample of bounded size (``max_background``), checked before
it is collected into the plan.
"""

from __future__ import annotations

import functools
import itertools
import math
import operator
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.functions.exprs import required
from tabeval.operators.trees import TreeModel, mixed_scores
from tabeval.session import materialize, small_side

MAX_BACKGROUND = 1000
STEP = 128  # rows that meet the background at a time


@dataclass(frozen=True)
class SqlModel:
    """A probability model given as a SQL expression over the feature names."""
    name: str
    expr: str


# ---------------------------------------------------------------- coalitions and maps

def shapley_weight(s: int, m: int) -> float:
    return math.factorial(s) * math.factorial(m - s - 1) / math.factorial(m)


def exact_map(m: int) -> tuple[np.ndarray, np.ndarray]:
    """All 2^m coalitions (C x m booleans, coalition c = bits of c) and K (m x C)."""
    if m > 16:
        raise ValueError("exact Shapley values over more than 16 features: use mode='kernel'")
    masks = np.array([[(c >> j) & 1 == 1 for j in range(m)] for c in range(2 ** m)], dtype=bool)
    sizes = masks.sum(axis=1)
    k = np.zeros((m, 2 ** m))
    for j in range(m):
        inside = masks[:, j]
        k[j, inside] = [shapley_weight(int(s) - 1, m) for s in sizes[inside]]
        k[j, ~inside] = [-shapley_weight(int(s), m) for s in sizes[~inside]]
    return masks, k


def kernel_coalitions(m: int, n_coalitions: int, seed: int = 2025) -> tuple[np.ndarray, np.ndarray]:
    """Coalitions between the empty and the full one (C x m booleans) and their weights.

    When the budget covers every non-trivial coalition they are all enumerated and
    weighted by the Shapley kernel; otherwise sizes are drawn by the kernel's size
    distribution, members uniformly, each draw paired with its complement, and every
    draw weighs the same.
    """
    sizes = np.arange(1, m)
    size_w = (m - 1) / (sizes * (m - sizes))          # kernel mass of each size (up to a constant)
    if 2 ** m - 2 <= n_coalitions:
        inner = [np.array(c, dtype=bool) for c in itertools.product([False, True], repeat=m)]
        inner = [z for z in inner if 0 < z.sum() < m]
        w = np.array([(m - 1) / (math.comb(m, int(z.sum())) * z.sum() * (m - z.sum())) for z in inner])
        z = np.array(inner)
    else:
        rng = np.random.default_rng(seed)
        p = size_w / size_w.sum()
        draws = []
        for _ in range(-(-n_coalitions // 2)):   # whole pairs: a draw and its complement
            s = int(rng.choice(sizes, p=p))
            z = np.zeros(m, dtype=bool)
            z[rng.choice(m, size=s, replace=False)] = True
            draws += [z, ~z]
        # a coalition drawn several times is evaluated once, with the summed weight
        z, times = np.unique(np.array(draws), axis=0, return_counts=True)
        w = times / len(draws)
    return z, w


def kernel_map(m: int, n_coalitions: int, seed: int = 2025) -> tuple[np.ndarray, np.ndarray]:
    """:func:`kernel_coalitions` and the constrained-WLS map K (m x C, empty and full included).
    With all coalitions the result equals exact Shapley values."""
    if m < 2:
        masks = np.array([[False] * m, [True] * m])
        return masks, np.array([[-1.0, 1.0]] * m)
    z, w = kernel_coalitions(m, n_coalitions, seed)
    zf = z.astype(float)
    # min sum_c w_c (v_c - v0 - z_c.phi)^2  s.t.  sum(phi) = v_full - v0
    g = np.linalg.pinv(zf.T @ (w[:, None] * zf))
    p_ = g @ zf.T * w                       # m x C
    one = np.ones(m)
    g1 = g @ one
    s_ = one @ g1
    a_inner = p_ - np.outer(g1, one @ p_) / s_
    a_full = g1 / s_
    # phi = A (v - v0) + a (v_full - v0): put v0 and v_full in as coalitions of their own
    masks = np.vstack([np.zeros((1, m), dtype=bool), z, np.ones((1, m), dtype=bool)])
    k = np.hstack([-(a_inner.sum(axis=1) + a_full)[:, None], a_inner, a_full[:, None]])
    return masks, k


def coalition_map(m: int, mode: str = "exact", n_coalitions: int | None = None, seed: int = 2025):
    if mode == "exact":
        return exact_map(m)
    if mode == "kernel":
        return kernel_map(m, n_coalitions or (2 * m + 2048), seed)
    raise ValueError(f"mode must be 'exact' or 'kernel', not {mode!r}")


# ---------------------------------------------------------------- features by the L1 path

RSS_FLOOR = 1e-13  # a residual below this share of the response is rounding


def l1_path(gram: np.ndarray, c: np.ndarray) -> list[list[int]]:
    """Active sets of min |y - Z b|^2 / 2 + lambda |b|_1 as lambda falls to 0, from Z'Z and Z'y alone:
    between two sets the coefficients move on a line, until a feature joins or a coefficient is 0."""
    m = len(c)
    beta, corr, active, sets = np.zeros(m), c.astype(float).copy(), [], []
    level = first = float(np.abs(corr).max(initial=0.0))
    join = int(np.abs(corr).argmax()) if m else -1
    for _ in range(8 * m):  # every feature joins once, but for those that leave and return
        if level <= 1e-12 * first or level <= 0:
            break
        if join >= 0:
            active.append(join)
        sets.append(sorted(active))
        sub = gram[np.ix_(active, active)]
        step = np.linalg.lstsq(sub, np.sign(corr[active]), rcond=None)[0]
        slope = gram[:, active] @ step
        length, join, leave = level, -1, -1
        out = np.setdiff1d(np.arange(m), active)
        for side in (1.0, -1.0):  # the feature whose correlation meets the level first
            gap, speed = level - side * corr[out], 1.0 - side * slope[out]
            # a feature at the level that falls no slower than it does not join
            with np.errstate(divide="ignore", invalid="ignore"):
                at = np.where(speed > 1e-12, np.maximum(gap, 0.0) / speed, np.inf)
            if len(at) and at.min() < length:
                length, join = float(at.min()), int(out[at.argmin()])
        with np.errstate(divide="ignore", invalid="ignore"):
            zero = -beta[active] / step
        zero[~(zero > 1e-12 * max(level, 1e-300))] = np.inf
        if zero.min() < length:
            length, join, leave = float(zero.min()), -1, active[int(zero.argmin())]
        beta[active] += length * step
        corr -= length * slope
        level -= length
        if leave >= 0:
            beta[leave] = 0.0
            active.remove(leave)
            if not active:
                break
    return sets


class SparseFit:
    """Shapley values of one row at a time on the features that its L1 path and a criterion choose.

    For coalitions z with weights w and sizes s, y = v(z) - v(empty) and d = v(full) - v(empty), the
    path is that of the regression in which every coalition stands twice: z with response y and
    weight w (m - s), and z - 1 with y - d and weight w s, so that efficiency counts while features
    are chosen.  Each set on the path is refitted without the penalty; ``n log(RSS / n)`` plus 2
    (aic) or log n (bic) for a feature decides, of equal ones the smaller set.  The chosen
    features then take the weighted solution whose values add up to d; all others are 0.
    """

    def __init__(self, z: np.ndarray, w: np.ndarray, criterion: str) -> None:
        if criterion not in ("aic", "bic"):
            raise ValueError(f"l1 must be 'aic' or 'bic', not {criterion!r}")
        zf = z.astype(float)
        s = zf.sum(axis=1)
        self.m, self.n = zf.shape[1], 2 * len(zf)
        self.gram = zf.T @ (w[:, None] * zf)
        self.twice = zf.T @ ((w * (self.m - s))[:, None] * zf) + (zf - 1).T @ ((w * s)[:, None] * (zf - 1))
        self.low, self.ws = (zf - 1).T @ (w * s), float((w * s).sum())
        self.scale = np.sqrt(np.diag(self.twice))
        self.price = 2.0 if criterion == "aic" else math.log(self.n)

    def values(self, b: np.ndarray, e: float, yy: float, d: float) -> np.ndarray:
        """phi from b = sum w z y, e = sum w s y, yy = sum w y^2 and d."""
        phi = np.zeros(self.m)
        if not (np.isfinite(b).all() and math.isfinite(e + yy + d)):
            return np.full(self.m, np.nan)
        c = self.m * b - e - d * self.low
        total = self.m * yy - 2 * d * e + d * d * self.ws
        if total <= 0 or not c.any():
            return phi
        best = None
        for chosen in l1_path(self.twice / np.outer(self.scale, self.scale), c / self.scale):
            fit = np.linalg.lstsq(self.twice[np.ix_(chosen, chosen)], c[chosen], rcond=None)[0]
            rss = max(total - float(c[chosen] @ fit), RSS_FLOOR * total)
            mark = (self.n * math.log(rss / self.n) + self.price * len(chosen), len(chosen))
            if best is None or mark < best[0]:
                best = mark, chosen
        chosen = best[1]
        solved = np.linalg.lstsq(self.gram[np.ix_(chosen, chosen)], np.stack([b[chosen], np.ones(len(chosen))], 1),
                                 rcond=None)[0]
        phi[chosen] = solved[:, 0] - solved[:, 1] * ((solved[:, 0].sum() - d) / solved[:, 1].sum())
        return phi


# ---------------------------------------------------------------- background

def collect_background(background: DataFrame, features: Sequence[str],
                       max_background: int = MAX_BACKGROUND) -> list[tuple]:
    """The background sample as driver values, after checking its size bound."""
    rows = background.select(*[F.col(f).cast("double") for f in features]).limit(max_background + 1).collect()
    if len(rows) > max_background:
        raise ValueError(f"background has more than {max_background} rows: sample it (sample_n) first")
    if not rows:
        raise ValueError("empty background")
    return [tuple(r) for r in rows]


def _bg_literal(rows: list[tuple], features: Sequence[str]) -> str:
    return "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'b{i}', {_dbl(v)}" for i, v in enumerate(r)) + ")" for r in rows) + ")"


# string literal, quoted name, name, number, any other character
_TOKEN = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"|`[^`]*`|[A-Za-z_]\w*|\d[\w.]*|.", re.S)


def _substitute(expr: str, features: Sequence[str], repl) -> str:
    """Replace the feature names in a SQL expression: not inside string literals, not where
    the name is called as a function, and not behind a dot."""
    tokens, names, out = _TOKEN.findall(expr), set(features), []
    for i, t in enumerate(tokens):
        name = t[1:-1] if t[0] == "`" else t
        after = next((u for u in tokens[i + 1:] if not u.isspace()), "")
        called = after == "(" and t[0] != "`"
        behind_dot = i > 0 and tokens[i - 1] == "."
        out.append(repl(name) if name in names and t[0] not in "'\"" and not called and not behind_dot else t)
    return "".join(out)


# ---------------------------------------------------------------- explanations

UNROLL_LIMIT = 256   # coalitions x background evaluations per row written out as plain expressions
WIDE_LIMIT = 64      # coalitions that are columns of one aggregation


def _dbl(v) -> str:
    """A double as a literal; NULL, NaN and the infinities too."""
    if v is None:
        return "CAST(NULL AS DOUBLE)"
    v = float(v)
    return f"CAST({v!r} AS DOUBLE)" if math.isfinite(v) else f"CAST('{v!r}' AS DOUBLE)"


def _explain_sql_unrolled(eval_df: DataFrame, id_col: str, features: list[str], model: SqlModel,
                          bg: list[tuple], masks: np.ndarray, k: np.ndarray) -> DataFrame:
    """v(S) written out as sums of plain expressions: whole-stage codegen instead of
    interpreted lambdas.  Same summation order as the lambda form (background in
    sample order, then coalitions in id order), so the results are bit-equal."""
    nb = len(bg)

    def f_at(c: int, b: tuple) -> str:
        return "(" + _substitute(model.expr, features, lambda f: (
            f"`__x_{f}`" if masks[c][features.index(f)] else _dbl(b[features.index(f)]))) + ")"

    x = eval_df.select(F.col(id_col).alias("row_id"), *[F.col(f).cast("double").alias(f"__x_{f}") for f in features])
    vs = [F.expr("(" + " + ".join(f_at(c, b) for b in bg) + f") / {nb}").alias(f"_v{c}") for c in range(len(masks))]
    empty = int(np.where(~masks.any(axis=1))[0][0])
    x = x.select("row_id", *[f"__x_{f}" for f in features], *vs)
    phis = []
    for j, f in enumerate(features):
        phi = None
        for c in range(len(masks)):
            t = F.lit(float(k[j, c])) * F.col(f"_v{c}")
            phi = t if phi is None else phi + t
        phis.append(F.struct(F.lit(f).alias("feature"), F.col(f"__x_{f}").alias("value"), phi.alias("phi")))
    out = x.select("row_id", F.col(f"_v{empty}").alias("base"), F.explode(F.array(*phis)).alias("_p"))
    return out.select(F.lit(model.name).alias("model"), "row_id", "_p.feature", "_p.value", "_p.phi", "base")


def _explain_sql(eval_df: DataFrame, id_col: str, features: list[str], model: SqlModel,
                 bg: list[tuple], masks: np.ndarray, k: np.ndarray, n_partitions: int | None = None) -> DataFrame:
    """Beyond UNROLL_LIMIT: the rows are dealt out once by id, and each makes its background
    (and, beyond WIDE_LIMIT coalitions, its coalitions) inside the task that also sums them
    up, so the generated rows are never exchanged and the model stays compiled."""
    if len(masks) * len(bg) <= UNROLL_LIMIT:
        return _explain_sql_unrolled(eval_df, id_col, features, model, bg, masks, k)
    nb, idx = len(bg), {f: i for i, f in enumerate(features)}
    xs = [f"__x_{f}" for f in features]
    x = eval_df.select(F.col(id_col).alias("row_id"), *[F.col(f).cast("double").alias(f"__x_{f}") for f in features])
    # a small sample sits in one partition, and each of its rows costs coalitions x background
    x = x.repartition(n_partitions or _tasks(eval_df), "row_id").withColumn("_u", F.monotonically_increasing_id())
    keys = ["row_id", "_u", *xs]
    empty = int(np.where(~masks.any(axis=1))[0][0])
    if len(masks) <= WIDE_LIMIT:
        def f_at(c: int) -> str:
            return _substitute(model.expr, features, lambda f: f"`__x_{f}`" if masks[c][idx[f]] else f"_b.b{idx[f]}")

        v = x.select("*", F.explode(F.expr(_bg_literal(bg, features))).alias("_b")).groupBy(*keys).agg(
            *[(F.sum(F.expr(f_at(c))) / nb).alias(f"_v{c}") for c in range(len(masks))])
        sums = [functools.reduce(operator.add, [F.lit(float(k[j, c])) * F.col(f"_v{c}") for c in range(len(masks))])
                for j in range(len(features))]
        v = v.select("row_id", *xs, F.col(f"_v{empty}").alias("base"), *[p.alias(f"_p{j}") for j, p in enumerate(sums)])
    else:
        coal = "array(" + ", ".join(f"named_struct('cid', {c}, " + ", ".join(
            f"'m{j}', {'true' if b else 'false'}" for j, b in enumerate(row)) + ")" for c, row in enumerate(masks)) + ")"
        body = _substitute(model.expr, features,
                           lambda f: f"(CASE WHEN _m{idx[f]} THEN `__x_{f}` ELSE _b.b{idx[f]} END)")
        e = x.select("*", F.explode(F.expr(coal)).alias("_c")).select(
            *keys, F.col("_c.cid").alias("_cid"), *[F.col(f"_c.m{j}").alias(f"_m{j}") for j in range(len(features))])
        e = e.select("*", F.explode(F.expr(_bg_literal(bg, features))).alias("_b"))
        v = e.groupBy(*keys, "_cid").agg((F.sum(F.expr(body)) / nb).alias("_v"))
        kj = ["array(" + ", ".join(f"CAST({float(w)!r} AS DOUBLE)" for w in row) + ")" for row in k]
        v = v.groupBy(*keys).agg(F.max(F.when(F.col("_cid") == empty, F.col("_v"))).alias("base"),
                                 *[F.sum(F.expr(f"{a}[_cid] * _v")).alias(f"_p{j}") for j, a in enumerate(kj)])
    phis = [F.struct(F.lit(f).alias("feature"), F.col(f"__x_{f}").alias("value"), F.col(f"_p{j}").alias("phi"))
            for j, f in enumerate(features)]
    out = v.select("row_id", "base", F.explode(F.array(*phis)).alias("_p"))
    return out.select(F.lit(model.name).alias("model"), "row_id", "_p.feature", "_p.value", "_p.phi", "base")


def _tasks(df: DataFrame) -> int:
    """As many tasks as a shuffle has or the cluster runs at a time, whichever is more."""
    spark = df.sparkSession
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _explain_transformer(eval_df: DataFrame, id_col: str, features: list[str], name: str, model,
                         bg: list[tuple], masks: np.ndarray, k: np.ndarray, prob_col: str,
                         n_partitions: int | None) -> DataFrame:
    spark = eval_df.sparkSession
    m = len(features)
    x = eval_df.select(F.col(id_col).alias("row_id"), *[F.col(f).cast("double").alias(f"__x_{f}") for f in features])
    if isinstance(model, TreeModel):
        return _explain_trees(x, features, name, model, bg, masks, k)
    x = x.repartition(n_partitions, "row_id") if n_partitions else x.repartition("row_id")
    coal = F.expr("array(" + ", ".join(
        f"named_struct('cid', {c}, 'm', array({', '.join('true' if b else 'false' for b in masks[c])}))"
        for c in range(len(masks))) + ")")
    bgl = F.expr(_bg_literal(bg, features))
    e = (x.select("*", F.explode(coal).alias("_c"))
          .select("*", F.explode(bgl).alias("_b"))
          .select("row_id", F.col("_c.cid").alias("cid"),
                  *[F.when(F.col("_c.m")[j], F.col(f"__x_{f}")).otherwise(F.col(f"_b.b{j}")).alias(f)
                    for j, f in enumerate(features)]))
    scored = model.transform(e)
    p = vector_to_array(F.col(prob_col))[1] if dict(scored.dtypes)[prob_col] == "vector" else F.col(prob_col)
    v = scored.groupBy("row_id", "cid").agg(F.avg(p).alias("v"))
    kt = spark.createDataFrame([(int(c), features[j], float(k[j, c])) for j in range(m) for c in range(len(masks))
                                if k[j, c] != 0.0], "cid INT, feature STRING, w DOUBLE")
    # K has m x C entries, a size set by the caller's parameters
    phi = (v.join(F.broadcast(kt), "cid").groupBy("row_id", "feature")
            .agg(F.sum(F.col("w") * F.col("v")).alias("phi")))
    empty = int(np.where(~masks.any(axis=1))[0][0])
    base = v.where(F.col("cid") == empty).select("row_id", F.col("v").alias("base"))
    vals = x.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f"__x_{f}").alias("value")) for f in features])).alias("_u")) \
        .select("row_id", "_u.feature", "_u.value")
    return (phi.join(vals, ["row_id", "feature"]).join(base, "row_id")
               .select(F.lit(name).alias("model"), "row_id", "feature", "value", "phi", "base"))


def _explain_trees(x: DataFrame, features: list[str], name: str, model: TreeModel, bg: list[tuple], masks: np.ndarray,
                   k: np.ndarray) -> DataFrame:
    """Binned trees know of a row only its bins, and v(S) depends on the features in S alone: rows that
    agree in the bins of S share v(S).  Every coalition is evaluated once for each of its distinct bin
    rows (at most the product of the bins, whatever the rows) and joined back."""
    spark, bins = x.sparkSession, model.bins
    at = [features.index(f) for f in bins.features]
    sent = spark.sparkContext.broadcast(model.slim())
    back = bins.of([np.array([b[j] for b in bg], float) for j in at])  # a value in no bin (NaN) goes where transform sends it

    @F.pandas_udf("array<int>")
    def places(it: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for rows in it:
            yield pd.Series(list(sent.value.bins.of([rows[c].to_numpy() for c in rows]).astype(np.int32)))

    xs = [f"__x_{f}" for f in features]
    held = materialize(x.select("row_id", *xs, places(F.struct(*[required(xs[j], features[j]).alias(f"f{i}") for i, j in enumerate(at)]))
                                .alias("_bins")).select("row_id", *xs, *[F.col("_bins")[i].alias(f"_b{i}") for i in range(len(at))]), "shap_rows")
    wide = held
    empty = int(np.where(~masks.any(axis=1))[0][0])
    for c, mask in enumerate(masks):
        inside = [i for i, j in enumerate(at) if mask[j]]
        if not inside:  # the same for every row
            wide = wide.withColumn(f"_v{c}", F.lit(float(np.mean(model.score(back)[0]))))
            continue
        keys = [f"_b{i}" for i in inside]

        def work(batches: Iterator[pa.RecordBatch], inside: list[int] = inside, fixed: bool = len(inside) == len(at)) -> Iterator[pa.RecordBatch]:
            for b in batches:
                own = np.stack([b.column(i).to_numpy() for i in range(len(inside))], axis=1) if b.num_rows else np.zeros((0, len(inside)))
                met, out = back[:1] if fixed else back, []
                for first in range(0, len(own), STEP):
                    out.append(mixed_scores(sent.value, own[first:first + STEP], inside, met).mean(axis=1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0))],
                                                 [*b.schema.names, "v"])

        found = held.select(*keys).distinct().repartition(_tasks(held), *keys).mapInArrow(
            work, ", ".join(f"{q} int" for q in keys) + ", v double")
        found = materialize(found, "shap_values").withColumnRenamed("v", f"_v{c}")
        wide = wide.join(small_side(found), keys)
    phis = [F.struct(F.lit(f).alias("feature"), F.col(xs[j]).alias("value"), functools.reduce(operator.add, [
        F.lit(float(k[j, c])) * F.col(f"_v{c}") for c in range(len(masks)) if k[j, c] != 0.0] or [F.lit(0.0)]).alias("phi"))
        for j, f in enumerate(features)]
    out = wide.select("row_id", F.col(f"_v{empty}").alias("base"), F.explode(F.array(*phis)).alias("_p"))
    return out.select(F.lit(name).alias("model"), "row_id", "_p.feature", "_p.value", "_p.phi", "base")


WORD = 62  # coalition bits in one long


def _coalition_words(z: np.ndarray) -> list[list[int]]:
    return [[sum(1 << j for j in range(WORD) if k + j < z.shape[1] and row[k + j])
             for k in range(0, z.shape[1], WORD)] for row in z]


def _explain_sparse(eval_df: DataFrame, id_col: str, features: list[str], name: str, model, bg: list[tuple],
                    n_coalitions: int, seed: int, criterion: str, prob_col: str,
                    n_partitions: int | None) -> DataFrame:
    """Kernel SHAP with features chosen row by row.  The rows are dealt out once by id; coalitions (as
    bits) and background rows are made inside the tasks and added up there."""
    m = len(features)
    z, w = kernel_coalitions(m, n_coalitions, seed)
    fit = SparseFit(z, w, criterion)
    words = _coalition_words(np.vstack([z, np.ones((1, m), dtype=bool)]))
    full = len(z)  # the last coalition
    spark = eval_df.sparkSession
    xs = [f"__x_{f}" for f in features]
    x = eval_df.select(F.col(id_col).alias("row_id"), *[F.col(f).cast("double").alias(f"__x_{f}") for f in features])
    x = x.repartition(n_partitions or _tasks(eval_df), "row_id").withColumn("_u", F.monotonically_increasing_id())
    parts = [f"w{k}" for k in range(len(words[0]))]
    coal = "array(" + ", ".join(
        "named_struct(" + ", ".join(f"'{p}', {b}L" for p, b in zip(parts, row)) + ")" for row in words) + ")"

    def has(j: int) -> str:
        return f"(_c.{parts[j // WORD]} & {1 << (j % WORD)}L) <> 0"

    e = x.select("*", F.posexplode(F.expr(coal)).alias("_cid", "_c"))
    e = e.select("*", F.explode(F.expr(_bg_literal(bg, features))).alias("_b"))
    base = spark.range(1).select(F.explode(F.expr(_bg_literal(bg, features))).alias("_b"))
    if isinstance(model, SqlModel):
        idx = {f: i for i, f in enumerate(features)}
        p = F.expr(_substitute(model.expr, features,
                               lambda f: f"(CASE WHEN {has(idx[f])} THEN `__x_{f}` ELSE _b.b{idx[f]} END)"))
        base_p = F.expr(_substitute(model.expr, features, lambda f: f"_b.b{idx[f]}"))
    else:
        held = ["row_id", "_u", "_cid", "_c", *xs]
        e = model.transform(e.select(*held, *[F.expr(f"CASE WHEN {has(j)} THEN `__x_{f}` ELSE _b.b{j} END").alias(f)
                                              for j, f in enumerate(features)]))
        base = model.transform(base.select(*[F.col(f"_b.b{j}").alias(f) for j, f in enumerate(features)]))
        p = base_p = (vector_to_array(F.col(prob_col))[1] if dict(e.dtypes)[prob_col] == "vector" else F.col(prob_col))
    v0 = base.agg(F.avg(base_p)).first()[0]  # the empty coalition is the same for every row
    v = e.groupBy("row_id", "_u", *xs, "_cid", "_c").agg((F.avg(p) - F.expr(_dbl(v0))).alias("_y"))
    # C weights, a number set by the parameters; 0 for the full coalition
    weight = F.expr("array(" + ", ".join(_dbl(k) for k in [*w, 0.0]) + ")[_cid]")
    size = functools.reduce(operator.add, [F.bit_count(F.col(f"_c.{q}")) for q in parts])
    sums = v.withColumn("_wy", weight * F.col("_y")).groupBy("row_id", "_u", *xs).agg(
        F.array(*[F.sum(F.expr(f"CASE WHEN {has(j)} THEN _wy ELSE 0D END")) for j in range(m)]).alias("b"),
        F.sum(F.col("_wy") * size).alias("e"), F.sum(F.col("_wy") * F.col("_y")).alias("yy"),
        F.max(F.when(F.col("_cid") == full, F.col("_y"))).alias("d"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = batch.to_pydict()
            phi = [fit.values(np.array(b, float), e_, yy, d).tolist()
                   if None not in b and None not in (e_, yy, d) else [None] * m
                   for b, e_, yy, d in zip(t["b"], t["e"], t["yy"], t["d"])]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("x"),
                                              pa.array(phi, pa.list_(pa.float64()))], ["row_id", "x", "phi"])

    sums = sums.select("row_id", F.array(*[f"`{c}`" for c in xs]).alias("x"), "b", "e", "yy", "d")
    kind = sums.schema["row_id"].dataType.simpleString()
    out = sums.mapInArrow(solve, f"row_id {kind}, x array<double>, phi array<double>")
    names = F.array(*[F.lit(f) for f in features])
    out = out.select("row_id", F.explode(F.arrays_zip(names.alias("feature"), F.col("x").alias("value"),
                                                      F.col("phi").alias("phi"))).alias("_p"))
    return out.select(F.lit(name).alias("model"), "row_id", F.col("_p.feature").alias("feature"),
                      F.col("_p.value").alias("value"), F.col("_p.phi").alias("phi"), F.expr(_dbl(v0)).alias("base"))


def kernel_shap(eval_df: DataFrame, background: DataFrame, features: Sequence[str], models: dict | Sequence,
                id_col: str = "row_id", mode: str = "kernel", n_coalitions: int | None = None, seed: int = 2025,
                max_background: int = MAX_BACKGROUND, prob_col: str = "probability",
                n_partitions: int | None = None, l1: str | None = None) -> DataFrame:
    """Long table (model, row_id, feature, value, phi, base) for every model.

    ``models``: a list of ``SqlModel`` or a dict name -> SqlModel / Transformer.  ``l1`` ("aic" or
    "bic", kernel mode only): every row keeps the features that its L1 path and this criterion choose,
    the others are 0; values still add up to f(x) - base.  A row whose model value is NULL or NaN
    for some coalition has NULL or NaN values.
    """
    features = list(features)
    if l1 is not None and (mode != "kernel" or len(features) < 2):
        raise ValueError("l1 needs mode='kernel' and two features or more")
    bg = collect_background(background, features, max_background)
    if l1 is None:
        masks, k = coalition_map(len(features), mode, n_coalitions, seed)
    items = list(models.items()) if isinstance(models, dict) else [(mm.name, mm) for mm in models]
    if len(items) > 1:
        # every model reads the rows: the source is scanned once, for the columns needed
        eval_df = materialize(eval_df.select(id_col, *[f for f in features if f != id_col]), "explained")
    out = None
    for name, mdl in items:
        if l1 is not None:
            part = _explain_sparse(eval_df, id_col, features, name, mdl, bg,
                                   n_coalitions or (2 * len(features) + 2048), seed, l1, prob_col, n_partitions)
        elif isinstance(mdl, SqlModel):
            part = _explain_sql(eval_df, id_col, features, SqlModel(name, mdl.expr), bg, masks, k, n_partitions)
        else:
            part = _explain_transformer(eval_df, id_col, features, name, mdl, bg, masks, k, prob_col, n_partitions)
        out = part if out is None else out.unionByName(part)
    return out


# ---------------------------------------------------------------- views of the SHAP table

def shap_importance(shap: DataFrame, k: int = 15) -> DataFrame:
    """(model, feature, mean_abs_shap, rank): global importance, top k per model."""
    g = shap.groupBy("model", "feature").agg(F.avg(F.abs("phi")).alias("mean_abs_shap"))
    r = F.row_number().over(Window.partitionBy("model").orderBy(F.desc("mean_abs_shap"), "feature"))
    return g.withColumn("rank", r).where(F.col("rank") <= k)


def shap_points(shap: DataFrame, k: int = 15) -> DataFrame:
    """Beeswarm data: every (row, feature) point of the top-k features, with the rank."""
    imp = shap_importance(shap, k).select("model", "feature", "rank")
    # models x k rows: broadcast, so the points are not dealt out by (model, feature)
    return shap.join(small_side(materialize(imp, "importance")), ["model", "feature"]).select(
        "model", "feature", "rank", "row_id", "value", "phi")


def shap_dependence(shap: DataFrame, x: str, color: str) -> DataFrame:
    """(model, row_id, value, phi, color_value): feature x against its phi, coloured by another."""
    s = shap.where(F.col("feature").isin(x, color))
    return s.groupBy("model", "row_id").agg(
        F.max(F.when(F.col("feature") == x, F.col("value"))).alias("value"),
        F.max(F.when(F.col("feature") == x, F.col("phi"))).alias("phi"),
        F.max(F.when(F.col("feature") == color, F.col("value"))).alias("color_value"))


def shap_force(shap: DataFrame, row_id=None) -> DataFrame:
    """(model, row_id, base, push_up, push_down, fx): forces from the base value to f(x)."""
    s = shap if row_id is None else shap.where(F.col("row_id") == F.lit(row_id))
    return s.groupBy("model", "row_id").agg(
        F.first("base").alias("base"),
        F.sum(F.when(F.col("phi") > 0, F.col("phi")).otherwise(0.0)).alias("push_up"),
        F.sum(F.when(F.col("phi") < 0, F.col("phi")).otherwise(0.0)).alias("push_down"),
    ).withColumn("fx", F.col("base") + F.col("push_up") + F.col("push_down"))


def shap_waterfall(shap: DataFrame, row_id, k: int = 15) -> DataFrame:
    """Waterfall of one row: the k-1 largest |phi| features and the rest as 'other',
    accumulated from the base value (smallest first) to f(x).
    (model, step, feature, value, phi, start, end)."""
    s = shap.where(F.col("row_id") == F.lit(row_id))
    rk = F.row_number().over(Window.partitionBy("model").orderBy(F.desc(F.abs("phi")), "feature"))
    s = s.withColumn("_rk", rk)
    n_other = F.count(F.lit(1)).over(Window.partitionBy("model"))
    s = s.withColumn("_n", n_other)
    shown = s.where((F.col("_rk") < k) | (F.col("_n") <= k))
    rest = (s.where((F.col("_rk") >= k) & (F.col("_n") > k))
             .groupBy("model").agg(F.first("base").alias("base"), F.sum("phi").alias("phi"),
                                   F.count(F.lit(1)).alias("_cnt"))
             .select("model", F.format_string("%d other features", "_cnt").alias("feature"),
                     F.lit(None).cast("double").alias("value"), "phi", "base", F.lit(k).alias("_rk")))
    items = shown.select("model", "feature", "value", "phi", "base", "_rk").unionByName(rest)
    w = Window.partitionBy("model").orderBy(F.desc("_rk")).rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("base") + F.coalesce(F.sum("phi").over(w), F.lit(0.0))
    return items.select("model", F.col("_rk").alias("step"), "feature", "value", "phi",
                        start.alias("start"), (start + F.col("phi")).alias("end"))
