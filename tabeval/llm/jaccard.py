"""Similarity join on word-shingle sets by vertical partitioning.

The shingles have one global order: first those whose sketch counter shows nothing unusual,
then the frequent ones, each by hash.  A linked pair must share a shingle of both prefixes
in that order.  The order is cut into fragments: prefixes meet fragment by fragment to give
candidates, and the overlap of a candidate pair is counted fragment by fragment and summed
per pair.

Equal sets are one class from the start.  Candidates are not all pairs of a list: in each
round every class meets one pivot per list and size band, verified links merge components,
and only classes of different components go on; what is left at the end is compared in full.
So no link that could join two components is missed, and a large group of copies costs in
proportion to its members.

A document of fewer words than a shingle has its whole sequence as one shingle; null and
empty texts have none and link with nothing.  Repeated rows share their class.  A null
doc_id takes part like any other and comes last as a component's smallest id.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabeval.llm.common import blocks, gathered, lookup, partitions, saved, sum_blocks, task_number
from tabeval.llm.words import WordHasher, mix, shingles
from tabeval.session import small_side

SIZE = 5
LINK = 75  # per cent
SKETCH = 1 << 22  # counters, whatever the input
BLOCK = 1 << 16
LEVELS = 15
PARTS = 8  # vertical fragments of a set when overlaps are counted
FRAGMENT = 1_000_000  # prefix shingles met in one fragment, about
HELD = 250_000  # prefix shingles a task holds before it sends them on
ROUNDS = 4
FEW = 500_000  # rows of a table of two to four numbers that may be broadcast
RATIOS = [1.0, 0.98, 0.9, LINK / 100]  # ranges of the size ratio, met separately in the last round
REACH = 40  # per cent of a class's shingles that are met with others'
MEMBERS = 1 << 26  # bits of the table that marks classes whose sets are fetched


def reach(n: int, per_cent: int) -> int:
    """First shingles that a class sends: its prefix, and on to REACH per cent so that classes
    with too many shingles of their own show."""
    return max(-(-REACH * n // 100), prefix_length(n, per_cent))


def prefix_length(n: int, per_cent: int) -> int:
    """Shingles of a set of ``n`` of which a linked set must hold one: overlap >= per_cent of n."""
    return n - -(-per_cent * n // 100) + 1


def most_unmet(n: Column, per_cent: int) -> Column:
    """Shingles that a class of ``n`` may have sent without meeting a linked class y there.

    They are either its own, at most n - ceil(per_cent n), or shared and behind the end of what y
    sent: with y's own b = ny - overlap all in front, at most reach(n) + b - reach(ny) are unmet.
    overlap >= per_cent (n + ny) / (100 + per_cent), and without rounding reach(ny) is a share of ny,
    so the bound is linear in ny and largest at an end of the sizes that may link."""
    own = n - F.ceil(n * per_cent / 100)
    sent = F.greatest(F.ceil(n * REACH / 100), own + 1)
    ends = (per_cent / 100, 100 / per_cent)
    slope = max(r * (100 / (100 + per_cent) - max(REACH, 100 - per_cent) / 100) for r in ends) - per_cent / (100 + per_cent)
    return F.greatest(own, F.floor(sent + n * slope + 1e-6))


def signature(s: np.ndarray) -> int:
    """Class of a shingle set: equal sets have equal signatures (64 bits, as int64)."""
    with np.errstate(over="ignore"):
        x = mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))
    return int(mix(np.array([x], np.uint64)).view(np.int64)[0])


def summaries(docs: DataFrame, size: int) -> DataFrame:
    """One saved table: per document (doc_id, n, class), and per task its counts of
    shingles in the sketch's counters (rows with ``data``)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, sketch, names = WordHasher(), np.zeros(SKETCH, np.uint32), ["doc_id", "n", "class", "part", "block", "data"]
        kind, held, count = pa.int64(), [], 0

        def add() -> None:
            if held:
                at = (np.concatenate(held) & np.uint64(SKETCH - 1)).astype(np.int64)
                np.add(sketch, np.bincount(at, minlength=SKETCH), out=sketch, casting="unsafe")
                held.clear()

        for b in batches:
            n, cls = [], []
            for _, _, words, off in h.documents(b.column(1)):
                for s in shingles(words, off, size):
                    n.append(len(s))
                    cls.append(signature(s))
                    held.append(s)
                    count += len(s)
                if count >= HELD:
                    add()
                    count = 0
            kind = b.schema.field(0).type
            none = pa.nulls(len(b), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), none, none,
                 pa.nulls(len(b), pa.binary())], names)
        add()
        out = blocks(sketch, BLOCK)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(out), kind), *[pa.nulls(len(out), pa.int64())] * 2, pa.array([task_number()] * len(out), pa.int32()),
             pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    return saved(docs.mapInArrow(run, f"doc_id {kind}, n long, class long, part int, block int, data binary"),
                 "summaries")


def levels(parts: DataFrame, tasks: int) -> np.ndarray:
    """Order level of each counter: 0 unless it stands out above chance, else by its excess."""
    c = gathered(sum_blocks(parts, tasks, "uint32"), SKETCH, BLOCK, "uint32").astype(np.float64)
    mean = c.mean()
    noise = 3 * math.sqrt(mean) + 3  # a counter flagged by chance only changes the order
    over = np.maximum(c - mean, 0) / noise
    return np.where(over < 1, 0, np.minimum(1 + np.log2(np.maximum(over, 1)), LEVELS)).astype(np.uint8)


def order_keys(s: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Sorted positions of the shingles in the global order: 4 bits of level, 60 of hash."""
    return np.sort(level[s & np.uint64(SKETCH - 1)].astype(np.uint64) << np.uint64(60) | s >> np.uint64(4))


def counted(df: DataFrame) -> DataFrame:
    """Broadcast if the (saved) table of a few numbers a row is counted to be small."""
    return small_side(df, FEW)


def runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal values."""
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(np.append(first, len(sorted_values)))


def shared_prefixes(docs: DataFrame, level, size: int, per_cent: int, fragments: int) -> DataFrame:
    """Rows (key, class, beyond), possibly repeated: the first shingles in the order that at least two classes have,
    with those classes; ``beyond`` marks those behind the prefix proper (see :func:`reach`).

    A task sends each fragment the first shingles of its new classes.  A shingle that two of
    the task's own classes have is known to be shared: its entries go straight through and the
    fragment gets a mark instead, so no fragment holds more than one entry per shingle and task
    portion however common the shingle is."""
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, lv, seen, held, count = WordHasher(), level.value, set(), [], 0
        me = task_number()

        def flush() -> pa.RecordBatch:
            key, length = np.concatenate([x[0] for x in held]), [len(x[0]) for x in held]
            cls = np.repeat(np.array([x[1] for x in held], np.int64), length)
            far = np.concatenate([np.arange(len(x[0])) >= x[2] for x in held])
            order = np.argsort(key, kind="stable")
            first, n = runs(key[order])
            many, mark = np.zeros(len(key), bool), np.zeros(len(key), bool)
            many[order] = np.repeat(n > 1, n)
            mark[order[first[n > 1]]] = True
            out = [(-1, me, key[many], cls[many], far[many], key[:0])] if many.any() else []
            place = ((key & np.uint64((1 << 60) - 1)) >> np.uint64(28)) * np.uint64(fragments) >> np.uint64(32)
            order = np.argsort(place, kind="stable")  # a class's entries stay together
            key, cls, far, place, one, mark = (x[order] for x in (key, cls, far, place, ~many, mark))
            for at, n in zip(*runs(place)):
                k, c, f, o, m = (x[at:at + n] for x in (key, cls, far, one, mark))
                out.append((int(place[at]), -1, k[o], c[o], f[o], k[m]))
            return pa.RecordBatch.from_arrays(
                [pa.array([o[0] for o in out], pa.int32()), pa.array([o[1] for o in out], pa.int32()),
                 *[pa.array([o[k].tobytes() for o in out], pa.binary()) for k in (2, 3, 4, 5)]],
                ["fragment", "straight", "keys", "classes", "beyond", "marks"])

        for b in batches:
            for _, _, words, off in h.documents(b.column(0)):
                for s in shingles(words, off, size):
                    if len(s) and (c := signature(s)) not in seen:
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(c)
                        p = order_keys(s, lv)[:reach(len(s), per_cent)]
                        held.append((p, c, prefix_length(len(s), per_cent)))
                        count += len(p)
                        if count >= HELD:
                            yield flush()
                            held, count = [], 0
        if held:
            yield flush()

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        def joined(column: str, dtype) -> np.ndarray:
            return np.concatenate([np.frombuffer(x, dtype) for x in pdf[column]])
        key, cls, far = joined("keys", np.uint64), joined("classes", np.int64), joined("beyond", bool)
        if pdf["straight"].iloc[0] < 0 and len(key):
            order = np.lexsort((cls, key))
            key, cls, far = key[order], cls[order], far[order]
            first, length = runs(key)
            shared = np.minimum.reduceat(cls, first) != np.maximum.reduceat(cls, first)
            shared |= np.isin(key[first], joined("marks", np.uint64))
            keep = np.repeat(shared, length)
            keep[1:] &= (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            key, cls, far = key[keep], cls[keep], far[keep]
        return pd.DataFrame({"key": key.view(np.int64), "class": cls, "beyond": far})

    sent = docs.select("text").mapInArrow(
        send, "fragment int, straight int, keys binary, classes binary, beyond binary, marks binary")
    return sent.groupBy("fragment", "straight").applyInPandas(meet, "key long, class long, beyond boolean")


def candidates(shared: DataFrame, classes: DataFrame, per_cent: int) -> DataFrame:
    """Prefix lists (key, class, n, common) of the classes that may link.

    A class is out when more of the shingles it sent were met with no other class than a link
    allows (:func:`most_unmet`), and a list is out that only such classes shared.
    ``common`` is the shared part of what a class sent."""
    own = F.col("n") - F.ceil(F.col("n") * per_cent / 100)
    sent = F.greatest(F.ceil(F.col("n") * REACH / 100), own + 1)
    # one row a class (its shingles are at most REACH per cent of one text's); a class that several
    # tasks sent is put together here
    each = shared.groupBy("class").agg(F.collect_set(F.struct("key", "beyond")).alias("met"))
    each = each.join(counted(classes.select("class", "n")), "class").where(sent - F.size("met") <= most_unmet(F.col("n"), per_cent))
    kept = F.transform(F.filter("met", lambda m: ~m["beyond"]), lambda m: m["key"])
    lists = each.select("class", "n", (F.size("met") / sent).alias("common"), F.explode(kept).alias("key"))
    lists = saved(lists.select("key", "class", "n", "common"), "lists")
    several = lists.groupBy("key").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).where("lo <> hi")
    return saved(lists.join(counted(saved(several.select("key"), "several")), "key"), "lists")


def filter_of(classes: DataFrame) -> np.ndarray:
    """A bit table of fixed size (MEMBERS bits) with two bits set for each class."""
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(MEMBERS // 8, np.uint8)
        for b in batches:
            for at in places_of(np.asarray(b.column(0)).astype(np.int64)):
                np.bitwise_or.at(table, at >> 3, (1 << (at & 7)).astype(np.uint8))
        out = blocks(table, 1 << 18)
        yield pa.RecordBatch.from_arrays(
            [pa.array([task_number()] * len(out), pa.int32()), pa.array([k for k, _ in out], pa.int32()),
             pa.array([x for _, x in out], pa.binary())], ["part", "block", "data"])

    parts = classes.mapInArrow(mark, "part int, block int, data binary")
    return gathered(sum_blocks(parts, partitions(classes), "uint8", combine=np.bitwise_or), MEMBERS // 8, 1 << 18, "uint8")


def places_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two places of each class in the bit table."""
    x = mix(classes.view(np.uint64) if classes.dtype == np.int64 else classes)
    return (x % np.uint64(MEMBERS)).astype(np.int64), ((x >> np.uint64(32)) % np.uint64(MEMBERS)).astype(np.int64)


def class_sets(docs: DataFrame, wanted: np.ndarray, size: int) -> DataFrame:
    """Rows (class, part, items): the shingle sets of the classes that pass the bit table, cut
    into PARTS.  (A class may come several times, and a few that are not wanted.)"""
    sent = docs.sparkSession.sparkContext.broadcast(wanted)  # MEMBERS / 8 bytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        h, table, seen = WordHasher(), sent.value, set()
        cuts = np.array([(k << 64) // PARTS for k in range(1, PARTS)], np.uint64)
        for b in batches:
            cls, part, items = [], [], []
            for _, _, words, off in h.documents(b.column(0)):
                for s in shingles(words, off, size):
                    c = signature(s)
                    if len(s) and c not in seen and all(table[at[0] >> 3] >> (at[0] & 7) & 1 for at in
                                                        places_of(np.array([c], np.int64))):
                        if len(seen) >= 1_000_000:
                            seen.clear()
                        seen.add(c)
                        at = [0, *np.searchsorted(s, cuts).tolist(), len(s)]
                        for k in range(PARTS):
                            if at[k + 1] > at[k]:
                                cls.append(c)
                                part.append(k)
                                items.append(s[at[k]:at[k + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(cls, pa.int64()), pa.array(part, pa.int32()), pa.array(items, pa.list_(pa.int64()))],
                ["class", "part", "items"])

    return docs.select("text").mapInArrow(run, "class long, part int, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, per_cent: int) -> DataFrame:
    """The pairs (x, y, nx, ny) whose overlap, counted per fragment and summed, makes them links."""
    left = sets.select(F.col("class").alias("x"), "part", F.col("items").alias("ix"))
    left = left.join(counted(saved(pairs.select("x").distinct(), "lefts")), "x", "left_semi")
    right = sets.select(F.col("class").alias("y"), "part", F.col("items").alias("iy"))
    partial = right.join(counted(pairs), "y").join(left, ["x", "part"]).select(
        "x", "y", "nx", "ny", F.size(F.array_intersect("ix", "iy")).alias("shared"))
    total = partial.groupBy("x", "y", "nx", "ny").agg(F.sum("shared").alias("shared"))
    return total.where(100 * F.col("shared") >= per_cent * (F.col("nx") + F.col("ny") - F.col("shared"))).select("x", "y")


def components(edges: DataFrame) -> DataFrame:
    """Rows (class, component): the smallest class reachable, for the classes of ``edges`` (x, y).
    Saved tables; those counted to be small are broadcast, else the joins shuffle."""
    both = saved(edges.select(F.col("x").alias("a"), F.col("y").alias("b")).union(edges.select("y", "x")).distinct(), "edges")
    label = saved(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")), "labels")
    while True:
        near = both.join(counted(label.select(F.col("a").alias("b"), F.col("l").alias("lb"))), "b").groupBy("a").agg(
            F.min("lb").alias("m"))
        # a label is itself a class: step to its label too, so paths halve
        up = label.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = near.join(counted(label), "a").join(counted(up), "l").select("a", F.least("m", "ll").alias("n"), "l")
        new = saved(new, "labels")
        moved = new.where("n <> l").limit(1).count()
        label = new.select("a", F.col("n").alias("l"))
        if not moved:
            return label.select(F.col("a").alias("class"), F.col("l").alias("component"))


def least_met(nx: Column, ny: Column, per_cent: int) -> Column:
    """Prefix shingles a linked pair must share.  Up to the end of the prefix that ends first all
    shared shingles are in both prefixes; behind it that set has ceil(per_cent n) - 1 shingles."""
    overlap = F.ceil((nx + ny) * per_cent / (100 + per_cent))
    return overlap - (F.ceil(F.greatest(nx, ny) * per_cent / 100) - 1)


def remaining_pairs(now: DataFrame, per_cent: int) -> DataFrame:
    """All pairs (x, y, nx, ny) of different components that may link, from the lists ``now`` (key,
    class, n, component, m: entries of the list).

    A linked pair shares at least :func:`least_met` of its listed shingles.  So, with the shortest
    lists first, it shares one of the first k - that + 1 of the k listed ones of either side; only
    those are met, for each range of the size ratio with its own bound.  Then all are counted."""
    each = Window.partitionBy("class")
    now = now.withColumns({"k": F.count(F.lit(1)).over(each), "place": F.row_number().over(each.orderBy("m", "key"))})
    now = saved(now, "placed")
    n, found = F.col("n"), None
    for high, low in zip(RATIOS, RATIOS[1:]):
        # rounding of the two bounds may differ by one
        need = F.least(least_met(n, F.ceil(n * low), per_cent), least_met(F.floor(n / low), n, per_cent)) - 1
        first = now.where(F.col("place") <= F.col("k") - F.greatest(need, F.lit(1)) + 1)
        a = first.select("key", F.col("class").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
        b = first.select("key", F.col("class").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))
        less, more = F.least("nx", "ny"), F.greatest("nx", "ny")
        fits = (less >= low * more) if high == 1.0 else (less >= low * more) & (less < high * more)
        part = a.join(b, "key").where((F.col("cx") != F.col("cy")) & (F.col("x") < F.col("y")) & fits)
        part = part.select("x", "y", "nx", "ny")
        found = part if found is None else found.unionByName(part)
    found = saved(found.distinct(), "met")
    keys = saved(now.groupBy("class").agg(F.collect_list("key").alias("keys")), "keys")
    both = found.join(keys.select(F.col("class").alias("x"), F.col("keys").alias("kx")), "x").join(
        keys.select(F.col("class").alias("y"), F.col("keys").alias("ky")), "y")
    return both.where(F.size(F.array_intersect("kx", "ky")) >= least_met(F.col("nx"), F.col("ny"), per_cent)).select(
        "x", "y", "nx", "ny")


def pivot_pairs(now: DataFrame, turn: int) -> DataFrame:
    """For each class the pivot (x) of another component that it (y) meets in most lists; a list has one
    pivot for each band of sizes, by weight, then by a hash that changes with ``turn``."""
    rank = F.struct(-F.col("weight"), F.xxhash64("class", F.lit(turn)), F.col("class"), F.col("n"), F.col("component"))
    pivot = now.groupBy("key", "band").agg(F.min(rank).alias("p")).select(
        "key", F.explode(F.array(F.col("band"), F.col("band") + 1)).alias("band"),
        F.col("p.class").alias("x"), F.col("p.n").alias("nx"), F.col("p.component").alias("cx"))
    met = now.join(counted(saved(pivot, "pivots")), ["key", "band"]).where("component <> cx")
    met = met.groupBy("class", "n", "x", "nx").agg(F.count(F.lit(1)).alias("met"))
    return met.groupBy(F.col("class").alias("y"), F.col("n").alias("ny")).agg(
        F.max(F.struct("met", "x", "nx")).alias("p")).select(F.col("p.x").alias("x"), "y", F.col("p.nx").alias("nx"), "ny")


def link_components(lists: DataFrame, sets: DataFrame, per_cent: int, rounds: int = ROUNDS) -> DataFrame | None:
    """Components of the linked classes of ``lists`` (key, class, n, common); None if nothing links.

    The first pivots are the classes with the least to themselves: the originals of a group of
    edited copies.  Later ones are other members of the largest component.  Each class is compared
    with the pivot that it meets most often; the last round compares all that is left."""
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / per_cent)).cast("int")
    edges = comps = None
    fruitful = True
    for r in range(rounds + 1):
        if comps is None:
            now = lists.withColumns({"component": F.col("class"), "weight": F.col("common")})
        else:  # larger components first
            sizes = comps.groupBy("component").agg(F.count(F.lit(1)).cast("double").alias("weight"))
            sized = saved(comps.join(sizes, "component"), "components")
            now = lists.join(counted(sized), "class", "left").withColumns({
                "component": F.coalesce("component", "class"), "weight": F.coalesce("weight", F.lit(1.0))})
        # lists that lie in one component need no further look
        open_ = now.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"),
                                       F.count(F.lit(1)).alias("m")).where("lo <> hi").select("key", "m")
        open_ = saved(open_, "open")
        left = open_.agg(F.sum("m").alias("entries"), F.sum(F.col("m") * F.col("m") / 2).alias("pairs")).first()
        if not left["entries"]:
            break
        now = saved(now.join(counted(open_), "key").withColumn("band", band), "lists")
        last = r == rounds or not fruitful or left["pairs"] <= 2 * left["entries"]
        pairs = remaining_pairs(now, per_cent) if last else pivot_pairs(now, r)
        pairs = saved(pairs.where(100 * F.least("nx", "ny") >= per_cent * F.greatest("nx", "ny")), "pairs")
        found = saved(verified(pairs, sets, per_cent), "links")
        edges = found if edges is None else edges.union(found)
        links = found.count()
        fruitful = 20 * links >= pairs.count()
        if links:
            comps = components(edges)
        if last:
            break
    return comps


def near_duplicates(docs: DataFrame, size: int = SIZE, per_cent: int = LINK) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles and component_id, the smallest doc_id
    reachable by links."""
    docs = docs.select("doc_id", "text")
    found = summaries(docs, size)
    level = levels(found.where("data IS NOT NULL").select("part", "block", "data"), partitions(docs))
    rows = found.where("data IS NULL").select("doc_id", "n", "class")
    total = rows.agg(F.sum("n")).first()[0] or 0
    fragments = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")),
                    math.ceil(total * (1 - per_cent / 100) / FRAGMENT))
    sent = docs.sparkSession.sparkContext.broadcast(level)  # SKETCH bytes
    classes = rows.where("n > 0").groupBy("class").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("doc"))
    classes = saved(classes, "classes")
    lists = candidates(saved(shared_prefixes(docs, sent, size, per_cent, fragments), "shared"), classes, per_cent)
    wanted = saved(lists.select("class").distinct(), "wanted")
    sets = class_sets(docs, filter_of(wanted), size).join(counted(wanted), "class", "left_semi")
    sets = saved(sets.dropDuplicates(["class", "part"]), "sets")
    comps = link_components(lists, sets, per_cent)
    ids = classes.select("class", F.col("doc").alias("component_id"))
    if comps is not None:  # the linked classes take the smallest document of their component
        linked = saved(classes.join(counted(comps), "class"), "linked")
        best = saved(linked.groupBy("component").agg(F.min("doc").alias("component_id")), "smallest")
        linked = saved(lookup(linked.select("class", "component"), best, "component").select("class", "component_id"), "linked")
        ids = classes.select("class", "doc").join(counted(linked), "class", "left").select(
            "class", F.coalesce("component_id", "doc").alias("component_id"))
    out = lookup(rows.select("doc_id", "n", "class"), ids, "class")
    return out.select("doc_id", F.col("n").alias("n_shingles"),
                      F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def one_of_each(docs: DataFrame, size: int = SIZE, per_cent: int = LINK) -> DataFrame:
    """One row, columns unchanged, of each component: the smallest by doc_id, then by the text's hash.

    A row is known by its id and text, so an id with two texts stands for two documents, and of rows
    that repeat both one stays.  Rows without an id stand for themselves: of those in a component the
    one with the smallest text hash stays too.  A text without shingles links with nothing."""
    names = {c.lower() for c in docs.columns}
    row = next(n for i in itertools.count() if (n := f"row {i}") not in names)
    mine = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("text"))
    found = near_duplicates(docs.select(mine.alias("doc_id"), "text"), size, per_cent)
    found = saved(found.groupBy("component_id", "doc_id").agg(F.count(F.lit(1)).alias("copies")), "members")
    named = found.where(~F.col("doc_id.none") & (F.col("doc_id") == F.col("component_id"))).select("doc_id", "copies")
    least = F.min(F.struct("doc_id", "copies")).alias("p")
    nameless = found.where("doc_id.none").groupBy("component_id").agg(least).select("p.doc_id", "p.copies")
    chosen = saved(named.unionByName(nameless).withColumnRenamed("doc_id", row), "chosen")
    keyed = docs.withColumn(row, mine)
    out = keyed.join(counted(chosen.where("copies = 1")), row, "left_semi").drop(row)
    if chosen.where("copies > 1").limit(1).count():  # only these rows are dealt out to drop their copies
        several = keyed.join(counted(saved(chosen.where("copies > 1"), "several")), row, "left_semi")
        out = out.unionByName(several.dropDuplicates([row]).drop(row))
    return out
