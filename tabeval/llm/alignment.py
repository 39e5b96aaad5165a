"""Alignment of the tokens of two tokenizers over the same bytes.

Each text is encoded by a byte-level BPE (side A, of a space and the text) and by a piece
model (side B, which adds the space itself).  A batch's tokens become two tables of (document,
start byte, token).  ``pandas.merge_asof``, keyed by document, finds for every token start the
other side's token that covers it; the two directions together are all overlapping pairs
(a pair with one common start is found from both sides and kept once).  Bytes where tokens of
both sides end cut the tokens into groups.

How often two ids are linked in the whole corpus is counted by a partially aggregated
``groupBy``.  The most frequent id pairs, at most ``frequent`` of about them, go to the tasks as
sorted arrays; links of rarer pairs are joined to their counts by a shuffle.  A row needs no
other row's text at any point.

Defined results: null and empty texts, and texts whose joined A or B bytes differ from a space
and the text (a tokenizer that changes characters), have no tokens: zeros and empty groups.
Special tokens' strings are plain text.  Of an id pair linked several times in a document
each link counts; ties for a B id's highest count are all best.  Repeated rows each
count; a null id is a row like others; an empty table gives an empty one; very long texts are
aligned whole.  Only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import itertools
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import saved, tokenizer_file

BYTES_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"
# Fixed value: the split of the byte-level pre-tokenizer.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CHUNK = 1 << 19  # characters of text aligned at a time (a longer text goes alone)
KEPT = 300_000  # segments whose ids a task remembers
LONG = 64  # characters; longer segments are encoded anew each time
FREQUENT = 1 << 20  # id pairs whose counts a task holds
MARK = "▁"
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_alphabet() -> dict[str, int]:
    """The character that a byte-level vocabulary writes for each byte: visible Latin-1
    characters stand for themselves, the other bytes follow from U+0100 in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {**{chr(b): b for b in shown}, **{chr(256 + k): b for k, b in enumerate(hidden)}}


class ByteSide:
    """Ids of the byte-level BPE.  A text whose characters all Unicode versions class alike goes
    through the rank form of the same vocabulary, which is several times faster; any
    other, or one with a very long run of white space, through the file's own library."""

    LONG_SPACE = re.compile(r"\s{256}")

    def __init__(self, file: bytes) -> None:
        import tiktoken
        model = json.loads(file)
        special = {t["id"] for t in model["added_tokens"]}
        alphabet = byte_alphabet()
        vocabulary = {i: bytes(alphabet[c] for c in t) for t, i in model["model"]["vocab"].items() if i not in special}
        self.file, self.tokenizer = file, None
        self.fast = tiktoken.Encoding("a", pat_str=SPLIT, mergeable_ranks={b: i for i, b in vocabulary.items()},
                                      special_tokens={}).encode_ordinary
        self.bytes = [vocabulary.get(i, b"") for i in range(max(model["model"]["vocab"].values()) + 1)]
        self.known: set[str] = set()

    @property
    def slow(self):
        """The file's own library, loaded when a text needs it."""
        if self.tokenizer is None:
            from tokenizers import Tokenizer
            self.tokenizer = Tokenizer.from_str(self.file.decode())
            self.tokenizer.encode_special_tokens = True
        return self.tokenizer

    def plain(self, text: str) -> bool:
        if text.isascii():
            return True
        new = set(text) - self.known
        if any(unicodedata.ucd_3_2_0.category(c) == "Cn" for c in new):
            return False
        self.known |= new
        return True

    def ids(self, text: str) -> np.ndarray | None:
        """The ids, None where their joined bytes are not the text (the rank form only cuts the bytes)."""
        if self.plain(text) and not self.LONG_SPACE.search(text):
            return np.array(self.fast(text), np.int32)
        ids = self.slow.encode(text, add_special_tokens=False).ids
        return np.array(ids, np.int32) if b"".join(map(self.bytes.__getitem__, ids)) == text.encode() else None


class PieceSide:
    """Ids of the piece model.  No piece goes on after a space that follows another character, so a text
    is the sum of its segments (spaces and the word after them), and a segment met before is
    looked up.  A model with such a piece encodes whole texts."""

    SEGMENT = re.compile(r" *[^ ]+| +")

    def __init__(self, file: bytes) -> None:
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_proto=file)
        pieces = list(map(self.model.id_to_piece, range(self.model.get_piece_size())))
        self.bytes = [bytes([int(m[1], 16)]) if (m := BYTE_PIECE.fullmatch(p)) else p.replace(MARK, " ").encode()
                      for p in pieces]
        self.size = np.array([len(x) for x in self.bytes], np.int64)
        self.space = self.model.piece_to_id(MARK)
        self.whole = any(MARK in p.lstrip(MARK) for p in pieces)
        self.memo: dict[str, bytes] = {}

    def encoded(self, segments: list[str]) -> list[bytes]:
        """The ids of segments (each begins with the space that the model adds), packed; None where the
        pieces' bytes are not the segment's."""
        # one space at a text's end is a segment of its own
        found = [ids or [self.space] for ids in self.model.encode([x[1:] for x in segments], num_threads=1)]
        flat = [i for ids in found for i in ids]
        packed, ends = np.array(flat, np.int32).tobytes(), list(itertools.accumulate(map(len, found), initial=0))
        out = [packed[4 * a:4 * b] for a, b in zip(ends, ends[1:])]
        raw = [x.encode() for x in segments]
        if b"".join(map(self.bytes.__getitem__, flat)) != b"".join(raw) or \
                self.size[flat].cumsum()[np.array(ends[1:]) - 1].tolist() != list(itertools.accumulate(map(len, raw))):
            out = [x if b"".join(map(self.bytes.__getitem__, ids)) == r else None for x, ids, r in zip(out, found, raw)]
        return out

    def ids(self, texts: list[str]) -> list[np.ndarray | None]:
        """The ids of each text, None where the joined pieces are not a space and the text."""
        split = [[] if not t else [" " + t] if self.whole else self.SEGMENT.findall(" " + t) for t in texts]
        known = {x: self.memo.get(x, b"") for x in set().union(*split)}
        new = [x for x, ids in known.items() if ids == b""]
        known.update(zip(new, self.encoded(new) if new else []))
        if len(self.memo) + len(new) > KEPT:
            self.memo = {}
        self.memo.update((x, known[x]) for x in new if len(x) <= LONG)
        out = []
        for parts in split:
            found = [known[x] for x in parts]
            out.append(None if None in found else np.frombuffer(b"".join(found), np.int32))
        return out


class Aligner:
    """Alignments of a list of texts; built inside a task from the two files' bytes."""

    def __init__(self, file_a: bytes, file_b: bytes) -> None:
        self.a, self.b = ByteSide(file_a), PieceSide(file_b)
        self.size_a, self.size_b = (np.array([len(x) for x in side.bytes], np.int64) for side in (self.a, self.b))
        # an id's text with each sign that can follow it: , and | for A, , and ; for B
        self.signs = [f"{i}{sign}" for side, signs in ((self.a, ",|"), (self.b, ",;"))
                      for sign in signs for i in range(len(side.bytes))]

    def tokens(self, texts: list[str | None]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The ids of both sides; none where one side does not give back the text."""
        out_a, out_b = [], []
        none = np.zeros(0, np.int32)
        for text, ids_b in zip(texts, self.b.ids([t or "" for t in texts])):
            ids_a = self.a.ids(" " + text) if text and ids_b is not None else None
            out_a.append(none if ids_a is None else ids_a)
            out_b.append(none if ids_a is None else ids_b)
        return out_a, out_b

    def aligned(self, texts: list[str | None]) -> dict[str, list]:
        """Columns n_a, n_b, n_groups, n_links, groups, pairs (A ids, B ids, times) of the texts."""
        of_a, of_b = self.tokens(texts)
        a = self.table(of_a, self.size_a)
        b = self.table(of_b, self.size_b)
        covering_b = pd.merge_asof(a[["at", "doc", "id"]], b[["at", "doc", "id"]].assign(start=b["at"]), on="at", by="doc",
                                   suffixes=("_a", "_b"))
        covering_a = pd.merge_asof(b[["at", "doc", "id"]], a[["at", "doc", "id"]].assign(start=a["at"]), on="at", by="doc",
                                   suffixes=("_b", "_a"))
        columns = ["doc", "id_a", "id_b"]
        links = pd.concat([covering_b[columns], covering_a.loc[covering_a["at"] != covering_a["start"], columns]])
        n = len(texts)
        n_links = np.bincount(links["doc"], minlength=n)
        pairs = links.groupby(columns, sort=True).size().reset_index(name="times") if len(links) else \
            links.assign(times=0)
        cuts = np.intersect1d(a["end"], b["end"], assume_unique=True)
        groups = self.written(a, b, cuts, n)
        cut_doc = a["doc"].to_numpy()[np.searchsorted(a["end"].to_numpy(), cuts)]
        return {"n_a": [len(x) for x in of_a], "n_b": [len(x) for x in of_b],
                "n_groups": np.bincount(cut_doc, minlength=n), "n_links": n_links, "groups": groups, "pairs": pairs}

    @staticmethod
    def table(ids: list[np.ndarray], sizes: np.ndarray) -> pd.DataFrame:
        """Tokens in order; ``at`` and ``end`` count bytes over all texts, so they rise with the document."""
        every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
        end = np.cumsum(sizes[every])
        return pd.DataFrame({"doc": np.repeat(np.arange(len(ids)), [len(x) for x in ids]), "id": every,
                             "at": end - sizes[every], "end": end})

    def written(self, a: pd.DataFrame, b: pd.DataFrame, cuts: np.ndarray, n: int) -> list[str]:
        """The groups of each text: A ids | B ids ; and so on."""
        group_a, group_b = (np.searchsorted(cuts, t["end"].to_numpy()) for t in (a, b))
        last_a = np.diff(group_a, append=-1) != 0
        last_b = np.diff(group_b, append=-1) != 0
        va, vb = len(self.a.bytes), len(self.b.bytes)
        code = np.concatenate([a["id"].to_numpy() + last_a * va, 2 * va + b["id"].to_numpy() + last_b * vb])
        order = np.lexsort((np.concatenate([np.zeros(len(a)), np.ones(len(b))]), np.concatenate([group_a, group_b])))
        code = code[order]
        ends = np.searchsorted(np.concatenate([a["doc"], b["doc"]])[order], np.arange(n + 1))
        sign = self.signs.__getitem__
        return ["".join(map(sign, code[s:e].tolist()))[:-1] for s, e in zip(ends, ends[1:])]


def chunks(texts: Iterator[str | None]) -> Iterator[list]:
    held, size = [], 0
    for t in texts:
        if held and size + len(t or "") > CHUNK:
            yield held
            held, size = [], 0
        held.append(t)
        size += len(t or "")
    if held:
        yield held


PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("times", pa.int32())]))


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bytes_bpe: str = BYTES_BPE,
          pieces: str = PIECES) -> DataFrame:
    """Per document: id, n_a, n_b, n_groups, n_links, ``groups`` as text (``a1,a2|b1;a3|b2,b3``) and
    ``pairs``, the linked (A id, B id) with how many of its links hold them."""
    sent_a, sent_b = tokenizer_file(docs.sparkSession, bytes_bpe), tokenizer_file(docs.sparkSession, pieces)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(sent_a.value, sent_b.value)
        for batch in batches:
            at = 0
            for texts in chunks(t.as_py() for t in batch.column(1)):
                got = aligner.aligned(texts)
                p = got["pairs"]
                ends = np.searchsorted(p["doc"].to_numpy(), np.arange(len(texts) + 1)).astype(np.int32)
                listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(
                    [pa.array(p[c].to_numpy(), pa.int32()) for c in ("id_a", "id_b", "times")], fields=list(PAIRS.value_type)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)),
                     *(pa.array(got[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")),
                     pa.array(got["groups"], pa.string()), listed],
                    [id_col, "n_a", "n_b", "n_groups", "n_links", "groups", "pairs"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        work, f"`{id_col}` {kind}, n_a long, n_b long, n_groups long, n_links long, groups string, "
              "pairs array<struct<a:int,b:int,times:int>>")


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(a, b, links): how many links of all documents hold the two ids."""
    return aligned.select(F.explode("pairs").alias("p")).groupBy("p.a", "p.b").agg(F.sum("p.times").alias("links"))


def scored(aligned: DataFrame, counts: DataFrame, frequent: int = FREQUENT) -> DataFrame:
    """``aligned`` (a written table: it is read twice) without ``pairs`` and with n_best, the links whose
    pair is the most frequent of its B id, and count_sum, the pair counts summed over the links.
    ``counts`` is a written table too."""
    spark = aligned.sparkSession
    best = counts.groupBy("b").agg(F.max("links").alias("best"))  # a row a B id at most
    at_least = threshold(counts, frequent)
    held = counts.where(F.col("links") >= at_least).select("a", "b", "links").toArrow()
    keys = held["a"].to_numpy().astype(np.int64) << 32 | held["b"].to_numpy()
    order = np.argsort(keys)
    tops = best.toArrow()
    top = np.zeros(int(tops["b"].to_numpy().max(initial=-1)) + 1, np.int64)
    top[tops["b"].to_numpy()] = tops["best"].to_numpy()
    sent = spark.sparkContext.broadcast((keys[order], held["links"].to_numpy()[order], top))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, links, top = sent.value
        for batch in batches:
            pairs = batch.column(batch.num_columns - 1)
            a, b, times = (x.to_numpy().astype(np.int64) for x in pairs.flatten().flatten())
            rows = np.diff(pairs.offsets.to_numpy()) if len(pairs) else np.zeros(0, np.int64)
            ends = np.concatenate(([0], np.cumsum(rows)))
            key = a << 32 | b
            at = np.minimum(np.searchsorted(keys, key), max(len(keys) - 1, 0))
            hit = keys[at] == key if len(keys) else np.zeros(len(key), bool)
            count = np.where(hit, links[at] if len(keys) else 0, 0)

            def sums(x: np.ndarray) -> pa.Array:
                return pa.array(np.diff(np.concatenate(([0], np.cumsum(x)))[ends]))

            n_best = sums(times * (hit & (count == top[b])) if len(b) else times)
            rare = pa.ListArray.from_arrays(
                np.concatenate(([0], np.cumsum(~hit)))[ends].astype(np.int32), pa.StructArray.from_arrays(
                    [pa.array(x[~hit], pa.int32()) for x in (a, b, times)], fields=list(PAIRS.value_type)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n_best, sums(times * count), rare],
                                             [*batch.schema.names[:-1], "n_best", "count_sum", "rare"])

    rest = [c for c in aligned.columns if c != "pairs"]
    kinds = ", ".join(f"`{c}` {aligned.schema[c].dataType.simpleString()}" for c in rest)
    out = aligned.select(*rest, "pairs").mapInArrow(
        add, f"{kinds}, n_best long, count_sum long, rare array<struct<a:int,b:int,times:int>>")
    if at_least <= 1:  # every pair is held
        return out.drop("rare")
    out = saved(out.withColumn("_row", F.monotonically_increasing_id()), "aligned")
    rare = out.select("_row", F.explode("rare").alias("p")).select("_row", "p.*")
    rare = rare.join(counts.where(F.col("links") < at_least), ["a", "b"]).join(F.broadcast(best), "b")
    rare = rare.groupBy("_row").agg(
        F.sum(F.when(F.col("links") == F.col("best"), F.col("times")).otherwise(0)).alias("_best"),
        F.sum(F.col("times") * F.col("links")).alias("_sum"))
    out = out.drop("rare").join(rare, "_row", "left")
    return out.select(*rest, (F.col("n_best") + F.coalesce("_best", F.lit(0))).alias("n_best"),
                      (F.col("count_sum") + F.coalesce("_sum", F.lit(0))).alias("count_sum"))


def threshold(counts: DataFrame, frequent: int) -> int:
    """The least count that at most about ``frequent`` pairs reach: 1 when they all fit."""
    n, at_least = counts.count(), 1
    if n > frequent:
        at_least = 1 + int(counts.agg(F.percentile_approx("links", 1.0 - frequent / n, 10_000)).first()[0])
        while counts.where(F.col("links") >= at_least).count() > 2 * frequent:
            at_least *= 2
    return at_least
