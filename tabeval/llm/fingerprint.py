"""Quartile bucket digests of whole texts.

Every window of five bytes contributes six byte triplets; each triplet is hashed into one
of 128 buckets.  The digest holds, per bucket, the quartile its count falls into (2 bits),
the text's length on a log scale, two quartile ratios and a check byte.  Two digests are
compared by a bounded difference score; likeness is one minus its share of the bound.

Null counts as the empty text.  Equal texts have equal digests.  Texts are read whole,
a piece at a time, so memory does not follow the longest text.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import partitions

BUCKETS = 128
TRIPLETS = [(0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 1, 4), (0, 2, 4), (0, 3, 4)]
PIECE = 1 << 20
BOUND = 208  # expected score of two unrelated digests; larger differences count as this
STEP = np.array([0, 1, 2, 6])  # score of a bucket whose quartiles differ by 0-3
HEADER = 3  # check byte, length byte, ratio byte


class Digester:
    """Digest of one text as bytes; built inside a task."""

    def __init__(self) -> None:
        b = np.arange(256, dtype=np.uint64) + np.uint64(1)
        self.role = [((b * np.uint64(m)) ^ ((b * np.uint64(m)) >> np.uint64(15))).astype(np.uint32)
                     for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

    def counts(self, raw: bytes) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for at in range(0, max(len(raw) - 4, 0), PIECE):
            piece = np.frombuffer(raw[at:at + PIECE + 4], np.uint8)
            a, b, c = (r[piece] for r in self.role)
            n = len(piece) - 4
            for k, (i, j, m) in enumerate(TRIPLETS):
                x = a[i:i + n] + b[j:j + n]
                x += c[m:m + n]
                x *= np.uint32(2654435761 + 2 * k)
                total += np.bincount(x >> np.uint32(25), minlength=BUCKETS)
        return total

    def digest(self, text: str | None) -> np.ndarray:
        raw = (text or "").encode()
        n = self.counts(raw)
        q1, q2, q3 = np.sort(n)[[31, 63, 95]]
        code = (n > q1).astype(np.uint8) + (n > q2) + (n > q3)
        check = hashlib.blake2b(raw, digest_size=1).digest()[0]
        size = min(255, round(8 * math.log2(1 + len(raw))))
        ratio = (int(15 * q1 / q3) << 4 | int(15 * q2 / q3)) if q3 else 0
        return np.concatenate(([check, size, ratio], code)).astype(np.uint8)


def as_hex(d: np.ndarray) -> str:
    c = d[HEADER:].reshape(-1, 4)
    return (d[:HEADER].tobytes() + (c[:, 0] << 6 | c[:, 1] << 4 | c[:, 2] << 2 | c[:, 3]).tobytes()).hex()


def from_hex(s: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(s), np.uint8)
    return np.concatenate((raw[:HEADER], np.stack([raw[HEADER:] >> k & 3 for k in (6, 4, 2, 0)], 1).ravel()))


def difference(a: np.ndarray, b: np.ndarray) -> int:
    """Between 0 (equal digests) and BOUND."""
    x, y = a.astype(np.int16), b.astype(np.int16)
    score = int(STEP[np.abs(x[HEADER:] - y[HEADER:])].sum()) + int(x[0] != y[0]) + abs(int(x[1]) - int(y[1])) // 2
    score += abs((x[2] >> 4) - (y[2] >> 4)) + abs((x[2] & 15) - (y[2] & 15))
    return min(int(score), BOUND)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return 1.0 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """The last quarter of the code points replaced by the first as many of the next text."""
    k = len(text) // 4
    return text[:len(text) - k] + following[:k]


def with_successors(docs: DataFrame, id_col: str, text_col: str, slots: int) -> DataFrame:
    """Rows (slot, borrowed, id, tie, text) such that, in this order, the row after an own row
    is its successor: documents by id (null first, then by a hash of the text), the first after
    the last.  Cut points split the id range into ``slots``; the first row of each slot is
    also lent to the slot before it.  One shuffle of the texts, no global sort."""
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("tie"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    at = [i / slots for i in range(1, slots)] or [0.5]
    cuts = rows.agg(F.percentile_approx("id", at, 20 * slots).alias("c")).first()["c"] or []
    cuts = F.array(*[F.lit(c) for c in sorted(set(cuts))]) if cuts else F.array().cast("array<long>")
    rows = rows.select(F.size(F.filter(cuts, lambda c: c < F.col("id"))).alias("slot"), "id", "tie", "text")
    rows = rows.withColumn("slot", F.when(F.col("slot") < 0, 0).otherwise(F.col("slot")))
    first = rows.groupBy("slot").agg(F.min(F.struct("id", "tie")).alias("f")).orderBy("slot").collect()  # one a slot
    lent = [(r["f"]["id"], r["f"]["tie"], first[k - 1]["slot"]) for k, r in enumerate(first)]
    spark = docs.sparkSession
    small = spark.createDataFrame(lent, f"i {docs.schema[id_col].dataType.simpleString()}, t long, lend int")
    rows = rows.join(F.broadcast(small), rows["id"].eqNullSafe(small["i"]) & (rows["tie"] == small["t"]), "left")
    own = F.struct(F.col("slot"), F.lit(False).alias("borrowed"))
    more = F.struct(F.col("lend").alias("slot"), F.lit(True).alias("borrowed"))
    rows = rows.select(F.explode(F.when(F.col("lend").isNull(), F.array(own)).otherwise(F.array(own, more))).alias("x"),
                       "id", "tie", "text")
    return rows.select("x.slot", "x.borrowed", "id", "tie", "text")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: length, sha256 of the edited text, both digests, and the likeness of its
    digest to the edited text's and to the next document's."""
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), partitions(docs))
    rows = with_successors(docs, id_col, text_col, 4 * tasks)
    rows = rows.repartition(tasks, "slot").sortWithinPartitions("slot", "borrowed", "id", "tie")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, held = Digester(), None  # held: (slot, id, text, digest) waiting for its successor
        for batch in batches:
            ids, n_chars, sha, fp, efp, near_e, near_n = ([] for _ in range(7))
            for slot, borrowed, doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                 batch.column(2).to_pylist(), batch.column(4)):
                text = text.as_py()
                waits = held is not None and held[0] == slot
                if not waits and borrowed:
                    continue  # a further copy of the lent row
                own = d.digest(text)
                if waits:
                    changed = edited(held[2], text)
                    e = d.digest(changed)
                    ids.append(held[1])
                    n_chars.append(len(held[2]))
                    sha.append(hashlib.sha256(changed.encode()).hexdigest())
                    fp.append(as_hex(held[3]))
                    efp.append(as_hex(e))
                    near_e.append(likeness(held[3], e))
                    near_n.append(likeness(held[3], own))
                held = None if borrowed else (slot, doc, text, own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, batch.schema.field(2).type), pa.array(n_chars, pa.int64()), pa.array(sha, pa.string()),
                 pa.array(fp, pa.string()), pa.array(efp, pa.string()), pa.array(near_e, pa.float64()),
                 pa.array(near_n, pa.float64())],
                [id_col, "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return rows.mapInArrow(
        digest, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_chars long, edited_sha256 string, "
                "fingerprint string, edited_fingerprint string, near_edited double, near_next double")
