"""Target-distribution importance resampling over hashed n-grams.

The words of a whole Arrow batch are found together: its texts are joined with a separator
byte, one regex pass over the joined bytes gives all words, and ``searchsorted`` on the
documents' offsets tells the document of each word.  A run of words is a feature unless its
first and last word lie in different documents; the features that remain go through
``bincount``.  Feature buckets are counted over all rows of the source and of the target; a
bucket's gain is the floored log ratio of their smoothed shares; a document's weight is the
sum of the gains of its features.  Gumbel noise from a hash of the id turns the weights into
a draw without replacement: the highest scores are drawn.

Defined results: a null or empty text has no words (weight 0).  A null id counts as empty in
the noise and comes first among equal scores.  Equal scores go by smaller id; repeated rows
with one id are told apart by their place in the scored table, so each has a rank of its own.
Texts are read whole.  An empty source gives an empty table; an empty target leaves
the smoothed shares.  Only the id and text columns are read, so further columns cannot clash.

The draw is ranked by ranges of (score, id, row): no task sees more than a range, and only
ranges that hold drawn rows are sorted.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabeval.llm.common import blocks, gathered, partitions, saved, sum_blocks, task_number

BUCKETS = 10_000
NGRAM = 1
SEED = 2024
MIN_WORDS = 20
PERCENT = 10
# over UTF-8 bytes: digits, a-z and every byte of a character beyond ASCII
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
SEPARATOR = b"\0"
SLICE = 4 << 20  # bytes joined at a time (a longer text goes alone)


@dataclass(frozen=True)
class Features:
    """The features of a batch, in document order: bucket and document of each; words per document."""
    bucket: np.ndarray
    doc: np.ndarray
    words: np.ndarray


def features(texts: list[bytes], ngram: int, buckets: int) -> Features:
    joined = SEPARATOR.join(texts).lower()  # bytes.lower changes A-Z only
    offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
    starts, hashes, words = [], [], []
    for m in WORD.finditer(joined):
        starts.append(m.start())
        words.append(m.group())
    doc = np.searchsorted(offsets, np.array(starts, np.int64), side="right") - 1
    found, at = [], []
    hashes = list(map(zlib.crc32, words))
    for n in range(1, ngram + 1):
        if n > 1:  # the run that starts a word earlier, and this word
            hashes = [zlib.crc32(w, zlib.crc32(b" ", h)) for h, w in zip(hashes, words[n - 1:])]
        first, last = doc[:max(len(doc) - n + 1, 0)], doc[n - 1:]
        inside = first == last
        found.append(np.array(hashes, np.int64)[inside] % buckets)
        at.append(first[inside])
    bucket, where = np.concatenate(found), np.concatenate(at)
    if ngram > 1:
        order = np.argsort(where, kind="stable")
        bucket, where = bucket[order], where[order]
    return Features(bucket, where, np.bincount(doc, minlength=len(texts)))


def slices(column: pa.Array) -> Iterator[list[bytes]]:
    """The texts of a column in runs of about SLICE bytes."""
    held, size = [], 0
    for t in pc.fill_null(column, "").cast(pa.binary()).to_pylist():
        if held and size + len(t) > SLICE:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t)
    if held:
        yield held


def bucket_counts(docs: DataFrame, text_col: str = "text", ngram: int = NGRAM, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall into each bucket: one array a task, added up in a tree."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for texts in slices(batch.column(0)):
                total += np.bincount(features(texts, ngram, buckets).bucket, minlength=buckets)
        for k, data in blocks(total, buckets):
            yield pa.RecordBatch.from_pylist([{"block": k, "part": task_number(), "data": data}], pa.schema(
                [("block", pa.int32()), ("part", pa.int32()), ("data", pa.binary())]))

    texts = docs.select(text_col)
    parts = texts.mapInArrow(count, "block int, part int, data binary")
    return gathered(sum_blocks(parts, partitions(texts), "int64"), buckets, buckets, "int64")


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares), in doubles."""
    n, all_s, all_t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000.0 * math.log(float(t + 1) * float(all_s + n) / (float(s + 1) * float(all_t + n))))
                     for s, t in zip(source.tolist(), target.tolist())], np.int64)


def weighted(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text",
             ngram: int = NGRAM) -> DataFrame:
    """Per document: id, n_words, n_features, weight."""
    buckets = len(gain)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, n, weight = [], [], []
            for texts in slices(batch.column(1)):
                f = features(texts, ngram, buckets)
                ends = np.searchsorted(f.doc, np.arange(len(texts) + 1))
                sums = np.concatenate(([0], np.cumsum(gain[f.bucket])))[ends]
                words.append(f.words)
                n.append(np.diff(ends))
                weight.append(np.diff(sums))
            if words:
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(np.concatenate(x).astype(np.int64)) for x in (words, n, weight))],
                    [id_col, "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        weigh, f"`{id_col}` {kind}, n_words long, n_features long, weight long")


def noisy(weights: DataFrame, id_col: str = "doc_id", seed: int = SEED) -> DataFrame:
    """With ``score``: the weight plus Gumbel noise from a hash of seed and id, in thousandths."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return weights.withColumn("score", F.col("weight") + F.floor(
        F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long"))


def drawn(scored: DataFrame, id_col: str = "doc_id", min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3... of the drawn rows by falling score, null for the rest."""
    scored = saved(scored.withColumn("_row", F.monotonically_increasing_id()), "scored")
    able = F.col("n_words") >= min_words
    draws = scored.where(able).count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_first(id_col), F.asc("_row")]
    ranges = saved(scored.where(able).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = sorted(ranges.groupBy("_range").count().collect())  # a row a range
    before, begun = 0, []
    for r, n in counts:
        if before < draws:
            begun.append((r, before))
        before += n
    starts = scored.sparkSession.createDataFrame(begun, "_range int, _before long")
    ranges = ranges.join(F.broadcast(starts), "_range", "left")
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    ranked = ranges.where("_before IS NOT NULL").withColumn("rank", place.cast("long"))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= draws, F.col("rank")))
    none = F.lit(None).cast("long").alias("rank")
    columns = [c for c in scored.columns if c != "_row"]
    return (ranked.select(*columns, "rank").unionByName(ranges.where("_before IS NULL").select(*columns, none))
            .unionByName(scored.where(~able).select(*columns, none)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", ngram: int = NGRAM,
             buckets: int = BUCKETS, seed: int = SEED, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """Per document: id, n_words, n_features, weight, score, rank (null where not drawn)."""
    gain = gains(bucket_counts(docs, text_col, ngram, buckets), bucket_counts(target, text_col, ngram, buckets))
    return drawn(noisy(weighted(docs, gain, id_col, text_col, ngram), id_col, seed), id_col, min_words, percent)
