"""Benchmark decontamination with a distributed positional inverted index, in DataFrame
operations only.

The index stores a posting (term, document, position) for every training token whose term
occurs in the test items (no other list can be asked for), sorted by term within each file.
A test item is cut into windows.  The lists of a window's rarest terms are intersected after
subtracting the term's offset: what is left are places where all of them stand right.  Those
places are compared with the whole window's words (phrase matches), or kept when the
adjusted positions lie within a given slop (proximity matches).

Terms are kept as 64-bit hashes in the index; the comparison is on the words themselves.
Null and empty texts have no words, so they neither match nor get matched.  Rows with the
same id and text get the same result each; an item repeated under one id counts once; an
item without id counts as the item ``""``.  Only id and text columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tabeval.llm.common import lower_ascii, saved

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SIZE = 13
RAREST = 3  # lists intersected before the words are compared
SMALL = 200_000  # rows of a test-side table (two or three numbers each) that may be broadcast


def words_of(c: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(lower_ascii(c), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def small(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it is counted to be small, else left to a shuffle join."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                       F.xxhash64(id_col, text_col).alias("key"))


def test_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> tuple[DataFrame, DataFrame]:
    """(items, terms): items (item, item_id, words), and per window (item, w) its terms with their
    offsets in the item.  An item of fewer than ``size`` words is one window."""
    items = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item_id"),
                         words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.distinct().withColumn("item", F.xxhash64("item_id", "words"))
    items = saved(items, "items")
    starts = items.select("item", "words", F.explode(F.sequence(F.lit(0), F.greatest(F.size("words") - size, F.lit(0))))
                          .alias("w"))
    terms = starts.select("item", "w", F.least(F.size("words") - F.col("w"), F.lit(size)).alias("len"),
                          F.posexplode(F.slice("words", F.col("w") + 1, F.lit(size))).alias("o", "word"))
    return items, saved(terms.select("item", "w", "len", (F.col("w") + F.col("o")).alias("at"),
                                     F.xxhash64("word").alias("term")), "terms")


def build_index(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings (term, key, pos) of the tokens of ``docs`` (key, text) whose term is in ``terms``."""
    tokens = docs.select("key", F.posexplode(words_of(F.col("text"))).alias("pos", "word")).select(
        F.xxhash64("word").alias("term"), "key", "pos")
    wanted = terms.select("term").distinct()
    return saved(tokens.join(small(wanted), "term", "left_semi").sortWithinPartitions("term"), "postings")


def rarest(index: DataFrame, terms: DataFrame, lists: int) -> DataFrame:
    """Per window that can occur at all, its ``lists`` rarest terms: (item, w, len, at, term, need)."""
    freq = saved(index.groupBy("term").agg(F.count(F.lit(1)).alias("freq")), "frequencies")
    each = Window.partitionBy("item", "w")
    known = terms.join(freq, "term").withColumn("have", F.count(F.lit(1)).over(each)).where("have = len")
    place = F.row_number().over(each.orderBy("freq", "at"))
    return saved(known.withColumn("place", place).where(F.col("place") <= lists).select(
        "item", "w", "len", "at", "term", F.least(F.col("len"), F.lit(lists)).alias("need")), "rarest")


def places(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Offset-adjusted lists: (key, item, shift, at) where a chosen term stands at ``shift + at``."""
    anchors = chosen.select("term", "item", "at").distinct()
    return index.join(small(anchors), "term").select("key", "item", (F.col("pos") - F.col("at")).alias("shift"), "at")


def phrase_places(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per (key, item, shift) the windows whose rarest terms all stand right there."""
    least = chosen.groupBy("item").agg(F.min("need").alias("least"))
    met = places(index, chosen).groupBy("key", "item", "shift").agg(F.collect_set("at").alias("ats"))
    met = met.join(small(least), "item").where(F.size("ats") >= F.col("least"))
    met = met.select("key", "item", "shift", F.explode("ats").alias("at"))
    need = chosen.select("item", "at", "w", "len", "need")
    full = met.join(small(need), ["item", "at"]).where("shift + w >= 0").groupBy("key", "item", "shift", "w", "len", "need").agg(
        F.count(F.lit(1)).alias("have")).where("have = need")
    return full.groupBy("key", "item", "shift").agg(F.collect_set(F.struct("w", "len")).alias("windows"))


def with_matches(docs: DataFrame, items: DataFrame, size: int, lists: int, id_col: str, text_col: str, item_col: str,
                 item_text: str) -> DataFrame:
    """Rows (doc, n_words, matches): ``doc`` is the whole row of ``docs``."""
    rows = docs.select(F.struct(*docs.columns).alias("doc"), F.xxhash64(id_col, text_col).alias("key"))
    items, terms = test_windows(items, item_col, item_text, size)
    index = build_index(keyed(docs, id_col, text_col), terms)
    found = phrase_places(index, rarest(index, terms, lists))
    # the item's words from the first to the last window go along for the comparison
    first = F.array_min("windows.w")
    end = F.array_max(F.transform("windows", lambda x: x["w"] + x["len"]))
    own = F.transform("windows", lambda x: F.struct((x["w"] - first).alias("w"), x["len"].alias("len")))
    found = found.join(small(items), "item").select("key", F.struct(
        "item_id", (F.col("shift") + first).alias("start"), F.slice("words", first + 1, end - first).alias("words"),
        own.alias("windows")).alias("place"))
    found = found.groupBy("key").agg(F.collect_list("place").alias("places"))
    rows = rows.join(found.hint("shuffle_hash"), "key", "left").select(
        "doc", words_of(F.col("doc")[text_col]).alias("words"), "places")

    def occurring(p: Column) -> Column:
        same = F.zip_with(F.slice("words", p["start"] + 1, F.size(p["words"])), p["words"], lambda a, b: a.eqNullSafe(b))
        right = F.filter(p["windows"], lambda x: F.forall(F.slice(same, x["w"] + 1, x["len"]), lambda e: e))
        return F.transform(right, lambda x: F.struct(p["item_id"].alias("item_id"), (p["start"] + x["w"]).alias("start"),
                                                     x["len"].alias("len")))

    matches = F.flatten(F.transform("places", occurring))
    return rows.select("doc", F.size("words").cast("long").alias("n_words"), F.coalesce(
        matches, F.array().cast("array<struct<item_id:string,start:int,len:int>>")).alias("matches"))


def phrase_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, lists: int = RAREST, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words and ``matches``, the exact occurrences of item windows as
    (item_id, start, len) in words."""
    out = with_matches(docs.select(id_col, text_col), items, size, lists, id_col, text_col, item_col, item_text)
    return out.select(F.col("doc")[id_col].alias("doc_id"), "n_words", "matches")


def proximity_matches(docs: DataFrame, items: DataFrame, size: int = SIZE, lists: int = RAREST, slop: int = 4,
                      id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text: str = "text") -> DataFrame:
    """Rows (doc_id, item_id, w, start): a window's rarest terms all occur with offset-adjusted
    positions within ``slop`` of each other; ``start`` is the least of them."""
    docs = keyed(docs, id_col, text_col)
    items, terms = test_windows(items, item_col, item_text, size)
    index = build_index(docs, terms)
    chosen = rarest(index, terms, lists)
    hits = places(index, chosen)
    # terms within the slop share a cell of this width or lie in neighbouring ones
    cell = F.floor(F.col("shift") / (slop + 1))
    near = hits.select("key", "item", "shift", "at", F.explode(F.array(cell, cell - 1)).alias("cell"))
    near = near.join(small(chosen.select("item", "at", "w", "need")), ["item", "at"])
    groups = near.groupBy("key", "item", "w", "need", "cell").agg(F.collect_set(F.struct("shift", "at")).alias("hits"))
    groups = groups.where(F.size("hits") >= F.col("need"))

    def complete(h: Column) -> Column:
        inside = F.filter("hits", lambda x: (x["shift"] >= h["shift"]) & (x["shift"] <= h["shift"] + slop))
        return F.size(F.array_distinct(F.transform(inside, lambda x: x["at"]))) == F.col("need")

    start = F.array_distinct(F.transform(F.filter("hits", complete), lambda h: h["shift"]))
    out = groups.select("key", "item", "w", F.explode(start).alias("shift")).distinct()
    out = out.join(small(items.select("item", "item_id")), "item")
    return docs.select("key", "doc_id").join(out, "key").select(
        "doc_id", "item_id", "w", (F.col("shift") + F.col("w")).alias("start"))


def digests(matches: DataFrame, share: int = 20) -> DataFrame:
    """Adds to rows with n_words and matches: hit words, matched items and the verdict (at least
    1/share of the words hit)."""
    hit = F.size(F.array_distinct(F.flatten(F.transform(
        "matches", lambda m: F.sequence(m["start"], m["start"] + m["len"] - 1))))).cast("long")
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return matches.withColumns({"n_hit": hit, "ids": ids}).withColumns({
        "n_items": F.size("ids").cast("long"), "items_sha256": F.sha2(F.concat_ws(",", "ids"), 256),
        "contaminated": (F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("n_words"))}).drop("matches", "ids")


def clean(docs: DataFrame, items: DataFrame, share: int = 20) -> DataFrame:
    """The documents, columns unchanged, that are not contaminated."""
    found = with_matches(docs, items, SIZE, RAREST, "doc_id", "text", "item_id", "text")
    return digests(found, share).where("NOT contaminated").select("doc.*")
