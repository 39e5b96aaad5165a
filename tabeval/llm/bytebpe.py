"""Byte-level BPE encoding and decoding by a segment tree.

A text is split by the vocabulary's pattern and each match is encoded on its own.  The parts
of a match begin as its bytes; leaf i of a segment tree holds the merge rank of the part that
starts at byte i with its right neighbour, together with i, so the root is the leftmost pair
of least rank.  A merge takes that pair out: the right part's leaf is emptied, the pairs of
the new part and of its live left neighbour are looked up anew, and each of the three point
updates walks up the tree until nothing changes.  So a match of n bytes costs O(n log n),
also where it is a single run of a million letters.

The pattern's classes (letters, numbers, white space) depend on a Unicode version; they are
read from the tokenizer library itself, by splitting all characters once, so the split is
the library's.

Defined results: null and empty texts have no tokens.  Equal ranks merge from the left.
Special tokens' strings are plain text.  Decoding joins the tokens' bytes, null ids counting
as none; an id that is not in the vocabulary is an error.  Rows are independent:
repeated rows give repeated results, an empty table an empty one; only the id and text
columns are read, so further columns cannot clash.  The memory for known matches is bounded.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tabeval.llm.common import tokenizer_file

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KEPT = 400_000  # matches whose ids a task remembers
LONG = 64  # bytes; longer matches are encoded anew each time
FLUSH = 8 << 20  # bytes of texts or ids worked on at a time
TOGETHER = 8192  # short matches merged at a time
NONE = 1 << 62


def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}


def character_class(pattern: str) -> str:
    """The characters that match ``pattern`` in the tokenizer library, as ranges of a class."""
    import tiktoken
    split = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks={bytes([i]): i for i in range(256)},
                              special_tokens={})
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    found = np.array(sorted(map(ord, set(split.decode_bytes(split.encode_ordinary(every)).decode()))))
    cuts = np.flatnonzero(np.diff(found) > 1) + 1
    return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in np.split(found, cuts))


def written_out(pattern: str = PATTERN) -> str:
    """``pattern`` with the library's classes written out."""
    classes = {"L": character_class(r"\p{L}"), "N": character_class(r"\p{N}"), "s": character_class(r"\s")}
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{classes['s']}{classes['L']}{classes['N']}]")
    for sign, name in ((r"\p{L}", "L"), (r"\p{N}", "N"), (r"\s", "s")):
        pattern = pattern.replace(sign, f"[{classes[name]}]")
    return pattern.replace(r"\S", f"[^{classes['s']}]")


class Encoder:
    """Token ids of texts; built inside a task from the vocabulary file's bytes and the split pattern."""

    def __init__(self, vocabulary: bytes, split: str) -> None:
        self.ranks, self.memo = ranks_of(vocabulary), {}
        self.split = re.compile(split).findall
        self.single = [self.ranks[bytes([i])] for i in range(256)]
        # a part is always a token, so a pair's rank is found by the ids of its parts
        self.pairs = {self.ranks[t[:k]] << 32 | self.ranks[t[k:]]: r for t, r in self.ranks.items()
                      for k in range(1, len(t)) if t[:k] in self.ranks and t[k:] in self.ranks}
        self.keys = np.array(sorted(self.pairs), np.int64)
        self.values = np.array([self.pairs[k] for k in self.keys.tolist()], np.int64)

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one match by merging."""
        pairs, n = self.pairs.get, len(piece)
        size = 1 << (n - 2).bit_length() if n > 2 else 1
        token = [self.single[b] for b in piece]  # of the part that starts at i
        tree = [NONE] * size
        tree += [NONE if (r := pairs(a << 32 | b)) is None else r << 32 | i
                 for i, (a, b) in enumerate(zip(token, token[1:]))]
        tree += [NONE] * (2 * size - len(tree))
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        end = list(range(1, n + 1))
        left = list(range(-1, n))  # start of the part before; one entry more for the end
        while (top := tree[1]) < NONE:
            i = top & 0xFFFFFFFF
            gone = end[i]
            end[i] = after = end[gone]
            before = left[i]
            left[after] = i
            token[i] = top >> 32
            # the three leaves that change: the right part, the new part, its live left neighbour
            changed = [(gone, NONE)] if gone < n - 1 else []
            if i < n - 1:
                r = pairs(token[i] << 32 | token[after]) if after < n else None
                changed.append((i, NONE if r is None else r << 32 | i))
            if before >= 0:
                r = pairs(token[before] << 32 | token[i])
                changed.append((before, NONE if r is None else r << 32 | before))
            for at, key in changed:
                at += size
                tree[at] = key
                while at > 1:
                    other = tree[at ^ 1]
                    if other < key:
                        key = other
                    at >>= 1
                    if tree[at] == key:
                        break
                    tree[at] = key
        out, i = [], 0
        while i < n:
            out.append(token[i])
            i = end[i]
        return out

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Ranks of pairs of tokens, shifted as a leaf has them; NONE where the pair is no token."""
        key = a.astype(np.int64) << 32 | b
        if not len(self.keys):
            return np.full(key.shape, NONE)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.values[at] << 32, NONE)

    def merged_together(self, pieces: list[bytes], size: int) -> list[bytes]:
        """The same for many matches of at most ``size`` + 1 bytes at a time: node k of all trees is one row."""
        p, width = len(pieces), size + 1
        n = np.fromiter(map(len, pieces), np.int64, p)
        raw = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in pieces), np.uint8).reshape(p, width).T
        token = np.concatenate([np.array(self.single, np.int64)[raw], np.zeros((1, p), np.int64)])
        place = np.arange(width + 1)[:, None]
        tree = np.full((2 * size, p), NONE)
        tree[size:] = np.where(place[:size] < n - 1, self.rank(token[:size], token[1:width]) | place[:size], NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[2 * k], tree[2 * k + 1], out=tree[k])
        end, left = np.repeat(place + 1, p, axis=1), np.repeat(place - 1, p, axis=1)

        def put(at: np.ndarray, key: np.ndarray, q: np.ndarray) -> None:
            at = at + size
            tree[at, q] = key
            for _ in range(size.bit_length() - 1):
                key = np.minimum(key, tree[at ^ 1, q])
                at >>= 1
                tree[at, q] = key

        def at_least(r: np.ndarray, i: np.ndarray) -> np.ndarray:
            return np.where(r < NONE, r | i, NONE)

        while (q := np.flatnonzero(tree[1] < NONE)).size:
            top = tree[1, q]
            i = top & 0xFFFFFFFF
            gone = end[i, q]
            after, before = end[gone, q], left[i, q]
            end[i, q], left[after, q], token[i, q] = after, i, top >> 32
            m = gone < size
            put(gone[m], np.full(m.sum(), NONE), q[m])
            put(i, np.where(after < n[q], at_least(self.rank(token[i, q], token[after, q]), i), NONE), q)
            m = before >= 0
            i, before, q = i[m], before[m], q[m]
            put(before, at_least(self.rank(token[before, q], token[i, q]), before), q)
        live = np.zeros((width + 1, p), bool)
        i, q = np.zeros(p, np.int64), np.arange(p)
        while q.size:  # the parts that are left, from the first
            live[i, q] = True
            i = end[i, q]
            m = i < n[q]
            i, q = i[m], q[m]
        ids = token.T[live.T].astype("<u4").tobytes()
        ends = np.cumsum(live.sum(axis=0)) * 4
        return [ids[a:b] for a, b in zip([0, *ends.tolist()], ends.tolist())]

    def learn(self, matches: set[str]) -> dict[str, bytes]:
        """The ids of matches that are not known yet; short ones are remembered."""
        out, classes = {}, {}
        for m in matches:
            raw = m.encode()
            whole = self.ranks.get(raw)
            if whole is not None:
                out[m] = whole.to_bytes(4, "little")
            elif len(raw) > LONG:
                out[m] = np.array(self.merged(raw), "<u4").tobytes()
            else:
                classes.setdefault(1 << (len(raw) - 2).bit_length(), []).append((m, raw))
        for size, found in classes.items():
            for k in range(0, len(found), TOGETHER):
                part = found[k:k + TOGETHER]
                out.update(zip((m for m, _ in part), self.merged_together([raw for _, raw in part], size)))
        if len(self.memo) + len(out) > KEPT:
            self.memo = {}
        self.memo.update((m, ids) for m, ids in out.items() if len(m) <= LONG)
        return out

    def texts(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        matches = [self.split(t) if t else [] for t in texts]
        ids = {}
        for m in set().union(*matches):
            ids[m] = self.memo.get(m)
        ids.update(self.learn({m for m, known in ids.items() if known is None}))
        return [b"".join(map(ids.__getitem__, m)) for m in matches]


def runs(rows: Iterator, size) -> Iterator[list]:
    """Rows in lists of about FLUSH bytes."""
    held, total = [], 0
    for r in rows:
        held.append(r)
        total += size(r)
        if total >= FLUSH:
            yield held
            held, total = [], 0
    if held:
        yield held


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           pattern: str = PATTERN, packed: bool = False) -> DataFrame:
    """Per document: its id and ``ids``, an array of integers, or with ``packed`` their
    little-endian unsigned 32-bit form in one binary value."""
    sent, split = tokenizer_file(docs.sparkSession, vocabulary), written_out(pattern)

    def to_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, split)
        for batch in batches:
            at = 0
            for held in runs((t.as_py() or "" for t in batch.column(1)), len):
                held = encoder.texts(held)
                if packed:
                    ids = pa.array(held, pa.binary())
                else:
                    ends = np.cumsum([0, *(len(x) // 4 for x in held)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(ends, np.frombuffer(b"".join(held), "<u4").astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(held)), ids], [id_col, "ids"])
                at += len(held)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        to_ids, f"`{id_col}` {kind}, ids {'binary' if packed else 'array<int>'}")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """Per row of ``encoded``: its id, its ids (as given), n_tokens, and ``decoded``, the tokens' bytes joined."""
    spark = encoded.sparkSession
    sent = tokenizer_file(spark, vocabulary)

    def to_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {r: b for b, r in ranks_of(sent.value).items()}.__getitem__
        for batch in batches:
            ids, lengths, texts = batch.column(1), [], []
            if pa.types.is_binary(ids.type):
                rows = (np.frombuffer(x, "<u4").tolist() for x in pc.fill_null(ids, b"").to_pylist())
            else:
                rows = (x.as_py() or [] for x in ids)
            at = 0
            for held in runs(((len(r), b"".join(map(token, r))) for r in rows), lambda r: len(r[1])):
                lengths, texts = zip(*held)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), ids.slice(at, len(held)), pa.array(lengths, pa.int64()),
                     pa.array(texts, pa.binary())], [id_col, "ids", "n_tokens", "decoded"])
                at += len(held)

    kinds = [encoded.schema[c].dataType.simpleString() for c in (id_col, ids_col)]
    return encoded.select(id_col, ids_col).mapInArrow(
        to_bytes, f"`{id_col}` {kinds[0]}, ids {kinds[1]}, n_tokens long, decoded binary")
