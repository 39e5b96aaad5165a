"""Variable-capacity best-fit packing.

Documents (lengths in tokens) go into training sequences of several permitted capacities.
Longest first, each piece takes the open sequence with the least room that fits; otherwise
a sequence is opened at the capacity with the least cost per token it is expected to hold.
At the end every sequence shrinks to the smallest capacity that holds its contents.  The
permitted capacities are optimised jointly: several opening policies are tried on a shard
and the cheapest total wins.

Longer documents are cut into pieces of the largest capacity and a rest.  Shards hold a
bounded number of pieces dealt out by a hash, whatever the size of a source or document.
Nothing is dropped: a document of no tokens (null or empty) has one row with piece 0,
n_tokens 0 and no sequence.  Repeated rows are packed as often as they occur.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import saved
from tabeval.llm.words import SLICE, WordHasher, text_buffers

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD = 20_000  # pieces in a shard, about
FILLS = (0.98, 0.9, 0.75, 0.5)  # policies: the share of a new sequence's room expected to be filled


def attention_cost(capacity: int) -> float:
    """Cost of one sequence: its tokens, a fixed overhead and a quadratic attention share."""
    return capacity + 16 + capacity * capacity / 65536


def best_fit(lengths: list[int], capacities: tuple[int, ...], cost: Callable[[int], float],
             fill: float) -> tuple[list[int], list[int], list[int]]:
    """For lengths in descending order: the bin and offset of each, and the contents of each bin."""
    price = {c: cost(c) for c in capacities}
    rest = sum(lengths)
    room: dict[int, list[int]] = {}  # open bins by their room
    open_rooms = 0  # bit r set: some bin has r left
    used: list[int] = []
    cap: list[int] = []
    where, offset = [], []
    for n in lengths:
        rest -= n
        fits = open_rooms >> n
        if fits:
            r = n + (fits & -fits).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_rooms &= ~(1 << r)
        else:
            c = min((c for c in capacities if c >= n),
                    key=lambda c: (price[c] / (n + min(fill * (c - n), rest)), c))
            b = len(used)
            used.append(0)
            cap.append(c)
        where.append(b)
        offset.append(used[b])
        used[b] += n
        left = cap[b] - used[b]
        if left:
            if not room.get(left):
                room[left] = []
                open_rooms |= 1 << left
            room[left].append(b)
    return where, offset, used


def downsized(used: list[int], capacities: tuple[int, ...]) -> list[int]:
    return [capacities[bisect_left(capacities, u)] for u in used]


def pack_shard(lengths: list[int], capacities: tuple[int, ...],
               cost: Callable[[int], float]) -> tuple[list[int], list[int], list[int]]:
    """The cheapest policy's (bin, offset, capacity of each bin) for descending lengths."""
    best = None
    for fill in FILLS:
        where, offset, used = best_fit(lengths, capacities, cost, fill)
        sizes = downsized(used, capacities)
        total = sum(map(cost, sizes))
        if best is None or total < best[0]:
            best = total, where, offset, sizes
    return best[1:]


def word_lengths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: its id and n_tokens, the number of words of the whole text."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h = WordHasher()
        for batch in batches:
            data, off = text_buffers(batch.column(1))
            n = np.zeros(len(off) - 1, np.int64)
            for at in range(0, len(data), SLICE):
                end = min(at + SLICE, len(data))
                piece = data[max(at - 1, 0):end]  # a word counts where it starts
                starts, _ = h.bounds(piece, off - max(at - 1, 0))
                starts = starts + max(at - 1, 0)
                starts = starts[starts >= at]
                n += np.diff(np.searchsorted(starts, off))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n)], [id_col, "n_tokens"])

    return docs.select(id_col, text_col).mapInArrow(
        count, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long")


def pack(lengths: DataFrame, id_col: str = "doc_id", capacities: tuple[int, ...] = CAPACITIES,
         cost: Callable[[int], float] = attention_cost) -> DataFrame:
    """Rows (id, piece, start, n_tokens, bin_id, bin_capacity, bin_offset): piece ``piece`` of the
    document covers its tokens from ``start`` and lies at ``bin_offset`` of sequence ``bin_id``."""
    capacities = tuple(sorted(set(capacities)))
    largest = capacities[-1]
    n = F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long")
    lengths = saved(lengths.select(F.col(id_col).alias("id"), n.alias("n"),
                                   F.monotonically_increasing_id().alias("row")), "lengths")
    pieces = lengths.select("id", "row", "n", F.explode(F.expr(f"sequence(0L, greatest(n - 1, 0) div {largest})"))
                            .alias("piece"))
    total = lengths.agg(F.sum(F.greatest(F.ceil(F.col("n") / largest), F.lit(1)))).first()[0] or 0
    shards = max(1, -(-total // SHARD))
    start = F.col("piece") * largest
    pieces = pieces.select("id", "row", "piece", start.alias("start"),
                           F.least(F.col("n") - start, F.lit(largest)).alias("n_tokens"),
                           F.pmod(F.xxhash64("row", "piece"), F.lit(shards)).alias("shard"))

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable")
        some = pdf["n_tokens"].to_numpy() > 0
        where, offset, sizes = pack_shard(pdf["n_tokens"][some].tolist(), capacities, cost)
        out = pdf[["id", "piece", "start", "n_tokens"]].copy()
        at = np.array(where, np.int64)
        for name, values in (("bin_id", (int(pdf["shard"].iloc[0]) << 32) + at),
                             ("bin_capacity", np.array(sizes, np.int64)[at]), ("bin_offset", np.array(offset, np.int64))):
            full = pd.array([pd.NA] * len(out), "Int64")
            full[some] = values
            out[name] = full
        return out

    kind = lengths.schema["id"].dataType.simpleString()
    out = pieces.groupBy("shard").applyInPandas(
        fill, f"id {kind}, piece long, start long, n_tokens long, bin_id long, bin_capacity long, bin_offset long")
    return out.withColumnRenamed("id", id_col)
