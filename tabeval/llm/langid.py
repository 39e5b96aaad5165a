"""Language identification by multilingual mixture inference.

Each learned language is a smoothed distribution over hashed byte trigrams.  A document is
a mixture of languages: expectation-maximisation estimates the proportions.  The language
set starts with the single likeliest language and grows while the log-likelihood gain
exceeds the penalty of one more parameter.

Learning uses every labelled row that is not held out; only per-language counts (a fixed
number of buckets) leave the tasks.  A text that is null or has no letter is ``und`` with
score 0, as is everything when nothing was learned.  Texts are read whole.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import blocks, partitions, sum_blocks, task_number, unpack
from tabeval.llm.words import doc_slices, text_buffers

BUCKETS = 1 << 14
MAX_LANGUAGES = 256
UNDETERMINED = "und"


class Trigrams:
    """Hashed byte trigrams of the documents of a batch; built inside a task.  A-Z is
    lower-cased, every ASCII byte that is no letter counts as a space."""

    def __init__(self) -> None:
        fold = np.full(256, 32, np.uint32)
        fold[97:123] = np.arange(97, 123)
        fold[65:91] = np.arange(97, 123)
        fold[128:] = np.arange(128, 256)
        self.fold = fold

    def counts(self, col: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(document, distinct buckets, their counts)."""
        data, off = text_buffers(col)
        for i, j in doc_slices(off):
            for d in range(i, j):
                lo, hi, total = int(off[d]), int(off[d + 1]), np.zeros(BUCKETS, np.int64)
                for at in range(lo, hi, 1 << 20):  # the text stands between two spaces
                    b = np.full(min(1 << 20, hi - at) + 2, 32, np.uint32)
                    first, last = max(at - 1, lo), min(at + (1 << 20) + 1, hi)
                    b[first - at + 1:last - at + 1] = self.fold[data[first:last]]
                    x, y, z = b[:-2], b[1:-1], b[2:]
                    h = (x * np.uint32(0x9E3779B1) + y * np.uint32(0x85EBCA77) + z * np.uint32(0xC2B2AE3D)) \
                        * np.uint32(0x27D4EB2F) >> np.uint32(18)
                    total += np.bincount(h[(y != 32) | ((x != 32) & (z != 32))], minlength=BUCKETS)
                at = np.flatnonzero(total)
                yield d, at, total[at]


@dataclass
class Profiles:
    """Learned languages (sorted) and their bucket probabilities, one row each."""

    languages: list[str]
    probability: np.ndarray


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", alpha: float = 0.5) -> Profiles:
    """Trigram profiles of every language in ``lang_col``; rows without text or language add nothing."""
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, total = Trigrams(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for d, at, n in grams.counts(batch.column(1)):
                if langs[d] not in total:
                    if len(total) >= MAX_LANGUAGES:
                        raise ValueError(f"more than {MAX_LANGUAGES} languages")
                    total[langs[d]] = np.zeros(BUCKETS, np.int64)
                total[langs[d]][at] += n
        out = [(lang, b, x) for lang, t in sorted(total.items()) for b, x in blocks(t, BUCKETS)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([o[0] for o in out], pa.string()), pa.array([task_number()] * len(out), pa.int32()),
             pa.array([o[1] for o in out], pa.int32()), pa.array([o[2] for o in out], pa.binary())],
            ["lang", "part", "block", "data"])

    parts = rows.mapInArrow(count, "lang string, part int, block int, data binary")
    found = sum_blocks(parts, partitions(rows), "int64", ["lang"]).limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    found = sorted((r["lang"], unpack(bytes(r["data"]), np.int64)) for r in found)
    p = np.array([n + alpha for _, n in found], np.float64).reshape(len(found), BUCKETS)
    return Profiles([lang for lang, _ in found], p / p.sum(1, keepdims=True) if len(found) else p)


def em(p: np.ndarray, n: np.ndarray, off: np.ndarray, start: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Mixture proportions and log-likelihood per document.  ``p``: probability of each n-gram
    entry under each language (entries x languages), ``n``: counts, ``off``: first entry of each
    document, ``start``: proportions to begin with (documents x languages; zeros stay zero)."""
    size = np.diff(np.append(off, len(n)))
    total = np.add.reduceat(n, off)
    share = start
    for _ in range(rounds):
        part = p * np.repeat(share, size, axis=0)
        part *= (n / part.sum(1))[:, None]
        share = np.add.reduceat(part, off, axis=0) / total[:, None]
    mixed = (p * np.repeat(share, size, axis=0)).sum(1)
    return share, np.add.reduceat(n * np.log(mixed), off)


def infer(p: np.ndarray, n: np.ndarray, off: np.ndarray, penalty: float, rounds: int, tries: int) -> np.ndarray:
    """Proportions per document (documents x languages) of the selected language sets."""
    docs, langs = len(off), p.shape[1]
    size = np.diff(np.append(off, len(n)))
    total = np.add.reduceat(n, off)
    single = np.add.reduceat(n[:, None] * np.log(p), off, axis=0)
    best = single.argmax(1)
    share = np.zeros((docs, langs))
    share[np.arange(docs), best] = 1.0
    fit = single[np.arange(docs), best]
    active = np.arange(docs)
    while len(active) and langs > 1:
        rows = np.repeat(np.isin(np.arange(docs), active), size)
        pa_, na, sa = p[rows], n[rows], size[active]
        oa = np.concatenate(([0], np.cumsum(sa)[:-1]))
        mixed = (pa_ * np.repeat(share[active], sa, axis=0)).sum(1)
        # slope of the log-likelihood when a language is mixed in; it is concave, so a
        # language whose slope is not positive cannot raise it
        slope = np.add.reduceat(pa_ * (na / mixed)[:, None], oa, axis=0) - total[active][:, None]
        slope[share[active] > 0] = -np.inf
        order = np.argsort(-slope, axis=1, kind="stable")[:, :tries]
        new_share, new_fit = share[active].copy(), fit[active].copy()
        for k in range(order.shape[1]):
            add = order[:, k]
            open_ = np.take_along_axis(slope, add[:, None], 1)[:, 0] > 0
            if not open_.any():
                break
            sub = np.flatnonzero(open_)
            keep = np.repeat(open_, sa)
            ss = sa[sub]
            start = share[active[sub]] * 0.8
            start[np.arange(len(sub)), add[sub]] = 0.2
            s, f = em(pa_[keep], na[keep], np.concatenate(([0], np.cumsum(ss)[:-1])), start, rounds)
            better = f > new_fit[sub]
            new_share[sub[better]], new_fit[sub[better]] = s[better], f[better]
        gain = new_fit - fit[active] > penalty * np.log(total[active] + 1)
        grown = active[gain]
        share[grown], fit[grown] = new_share[gain], new_fit[gain]
        active = grown[(share[grown] > 0).sum(1) < langs]
    return share


def has_letter(c: Column) -> Column:
    return F.coalesce(c.rlike(r"\p{L}"), F.lit(False))


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text", penalty: float = 4.0, rounds: int = 12,
             tries: int = 3) -> DataFrame:
    """``docs`` with lang_pred (the language of the largest share; of equal ones the first by
    name), score (that share) and languages (all selected, by descending share).  Columns of
    ``docs`` with these names are replaced."""
    docs = docs.drop("lang_pred", "score", "languages")
    at = docs.columns.index(text_col)
    names, prob = profiles.languages, profiles.probability.T.copy()

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = Trigrams()
        for batch in batches:
            pred, score, sets = [UNDETERMINED] * len(batch), [0.0] * len(batch), [[]] * len(batch)
            ok = batch.column(len(batch.schema) - 1).to_pylist()
            pending, entries = [], 0

            def settle() -> None:
                if pending:
                    idx = np.concatenate([x[1] for x in pending])
                    n = np.concatenate([x[2] for x in pending]).astype(np.float64)
                    off = np.concatenate(([0], np.cumsum([len(x[1]) for x in pending])[:-1])).astype(np.int64)
                    for (d, _, _), s in zip(pending, infer(prob[idx], n, off, penalty, rounds, tries)):
                        top = int(s.argmax())
                        pred[d], score[d] = names[top], float(min(s[top], 1.0))
                        sets[d] = [names[k] for k in np.argsort(-s, kind="stable") if s[k] > 0]
                pending.clear()

            for d, where, n in grams.counts(batch.column(at)) if names else ():
                if ok[d] and len(where):
                    pending.append((d, where, n))
                    entries += len(where)
                    if entries > 200_000:
                        settle()
                        entries = 0
            settle()
            out = [batch.column(k) for k in range(len(batch.schema) - 1)]
            yield pa.RecordBatch.from_arrays(
                out + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string()))],
                names=batch.schema.names[:-1] + ["lang_pred", "score", "languages"])

    from pyspark.sql import types as T
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType()),
                           T.StructField("languages", T.ArrayType(T.StringType()))])
    marked = docs.select(*[docs[c] for c in docs.columns], has_letter(docs[text_col]).alias("_letter"))
    return marked.mapInArrow(predict, schema)


def accepted(docs: DataFrame, profiles: Profiles, min_share: float = 0.0) -> DataFrame:
    """The documents, columns unchanged whatever their names, in which a learned language was found
    (not undetermined), with at least ``min_share`` of the text in the predicted one.  A document in
    several languages is not rejected for that."""
    names = {c.lower() for c in docs.columns}
    fresh = {c: next(n for i in itertools.count() if (n := f"{c.lower()} {i}") not in names)
             for c in docs.columns if c.lower() in ("lang_pred", "score", "languages")}
    out = identify(docs.withColumnsRenamed(fresh), profiles)
    out = out.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= min_share))
    return out.select(*[F.col(f"`{fresh.get(c, c)}`").alias(c) for c in docs.columns])
