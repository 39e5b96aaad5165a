"""Small helpers: row keys, Parquet steps in the shared folder, block sums over tasks."""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabeval.session import SMALL_ROWS, checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MAX_VOCABULARY = 32 << 20
FREQUENT = 1000  # a key with more than 1/FREQUENT of the rows is looked up in a broadcast list
FAN_IN = 64  # partial arrays added up in one task


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: later steps read the rows
    instead of computing them again, also after an executor is lost."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column | str, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as an empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % modulus == remainder


def lower_ascii(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def pack(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype)


def blocks(a: np.ndarray, size: int) -> list[tuple[int, bytes]]:
    """(number, packed block) of the blocks of ``a`` that hold a non-zero value."""
    return [(i // size, pack(a[i:i + size])) for i in range(0, len(a), size) if a[i:i + size].any()]


def sum_blocks(parts: DataFrame, tasks: int, dtype: str, keys: list[str] | None = None, combine=np.add) -> DataFrame:
    """Add up (or otherwise combine) packed arrays of many tasks: rows (keys..., block, part, data), ``part`` below
    ``tasks``.  Each group adds at most FAN_IN arrays, so it stays small for any number of tasks."""
    keys = (keys or []) + ["block"]

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = None
        for b in pdf["data"]:
            x = unpack(b, dtype)
            total = x if total is None else combine(total, x)
        out = pdf.iloc[:1].copy()
        out["data"] = [pack(total.astype(dtype))]
        return out

    while True:
        parts = parts.withColumn("part", F.expr(f"part div {FAN_IN}").cast("int"))
        parts = parts.groupBy(*keys, "part").applyInPandas(add, parts.schema)
        tasks = -(-tasks // FAN_IN)
        if tasks <= 1:
            return parts.drop("part")


def gathered(parts: DataFrame, size: int, block: int, dtype: str) -> np.ndarray:
    """The one array of ``size`` values (fixed by a parameter) that the blocks make up."""
    out = np.zeros(size, dtype)
    for r in parts.select("block", "data").toLocalIterator():
        x = unpack(bytes(r["data"]), dtype)
        out[r["block"] * block:r["block"] * block + len(x)] = x
    return out


def task_number() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def partitions(df: DataFrame) -> int:
    return df.rdd.getNumPartitions()



def tokenizer_file(spark: SparkSession, path: str):
    """A tokenizer's vocabulary file (a few MB at most) read once and sent to the executors."""
    with open(path, "rb") as f:
        data = f.read(MAX_VOCABULARY + 1)
    if len(data) > MAX_VOCABULARY:
        raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
    return spark.sparkContext.broadcast(data)


def lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join to ``right`` (one row a key).  A right side counted to be small is broadcast.  Else
    keys with more than 1/FREQUENT of the left rows, at most FREQUENT of them, come from a broadcast
    list; the rest is dealt out by key.  Rows that are already served are dealt out by their
    content, so no key gathers them."""
    if right.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS:
        return left.join(F.broadcast(right), key, "left")
    many = left.groupBy(key).count().where(F.col("count") > left.count() / FREQUENT).select(key)
    values = [c for c in right.columns if c != key]
    hot = right.join(F.broadcast(many), key, "left_semi").select(
        F.col(key), F.struct(*values).alias("_hot"))
    left = left.join(F.broadcast(hot), key, "left")
    spread = F.concat(F.lit("\0"), F.xxhash64(*left.columns[:-1]).cast("string"))
    left = left.withColumn("_key", F.when(F.col("_hot").isNull(), F.col(key)).otherwise(spread))
    cold = right.select(F.col(key).alias("_key"), F.struct(*values).alias("_cold"))
    out = left.join(cold, "_key", "left").withColumn("_v", F.coalesce("_hot", "_cold"))
    return out.select(*[c for c in left.columns if c not in ("_hot", "_key")],
                      *[F.col("_v")[c].alias(c) for c in values])
