"""Secret scan by token efficiency.

Three patterns give the base spans (credential assignments, access key ids, long hex
strings).  The method adds strings that a tokenizer can hardly compress: few characters
per token of a tiktoken vocabulary means the string looks like nothing in ordinary text.
Known digests and identifiers are left out before that test.

Null and empty texts have no spans.  Every text is scanned whole.  Rows are independent:
repeated rows give repeated results, an empty table an empty one; only the id and text
columns are read, so further columns cannot clash.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabeval.llm.common import tokenizer_file

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenization pattern of the byte-level BPE vocabulary.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ["assign", "access", "hex", "random"]
MASK = "[SECRET]"

HINTS = (b"passw", b"secret", b"token", b"api")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
STRING = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LETTER = re.compile(r"[A-Za-z]")
UUID = re.compile(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", re.IGNORECASE)
DIGEST_LENGTHS = {32, 40, 48, 56, 64, 96, 128}  # md5, sha1, tiger, sha224, sha256, sha384, sha512 in hex
PLAIN_HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")  # no digest is written in mixed case
# Identifiers: words, numbers and dates joined by separators, or camel-case words with a version number.
# A letter run of 8 or more counts as words only if its camel-case parts encode well.
IDENTIFIER = re.compile(r"(?:[A-Za-z]+|[0-9]+)(?:[-_/+=](?:[A-Za-z]+|[0-9]+|$))*|[A-Za-z]+[0-9]{1,4}")

RUN, PART = re.compile(r"[A-Za-z]{8,}"), re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")


class Scanner:
    """Spans of one text; built inside a task from the vocabulary file's bytes."""

    def __init__(self, vocabulary: bytes, max_ratio: float, known: frozenset[str] = frozenset()) -> None:
        import tiktoken
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.encode = tiktoken.Encoding("scan", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.max_ratio, self.known = max_ratio, known

    def base(self, text: str) -> list[tuple[int, int, int]]:
        spans = []
        raw = text.encode().lower()
        if any(h in raw for h in HINTS):
            spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
        if "AKIA" in text:
            spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
        return spans + [(m.start(), 2, m.end()) for m in HEX.finditer(text)]

    def words(self, run: str) -> bool:
        return len(run) >= self.max_ratio * sum(len(self.encode(p)) for p in PART.findall(run))

    def identifier(self, s: str) -> bool:
        return bool(s in self.known or UUID.fullmatch(s)
                    or IDENTIFIER.fullmatch(s) and all(map(self.words, RUN.findall(s)))
                    or len(s) in DIGEST_LENGTHS and PLAIN_HEX.fullmatch(s))

    def random(self, text: str) -> Iterator[tuple[int, int, int]]:
        for m in STRING.finditer(text):
            s = m[0]
            if LETTER.search(s) and not self.identifier(s) \
                    and len(s) < self.max_ratio * len(self.encode(s)):
                yield m.start(), 3, m.end()

    def spans(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end) in order; a random string inside a base span adds nothing."""
        if not text:
            return []
        base = sorted(self.base(text))
        added, at, reach = [], 0, 0
        for r in self.random(text):  # by start: of the base spans that start no later the farthest end decides
            while at < len(base) and base[at][0] <= r[0]:
                reach = max(reach, base[at][2])
                at += 1
            if r[2] > reach:
                added.append(r)
        return sorted(base + added)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if e > at:
            out += [text[at:max(s, at)], MASK if s >= at else ""]
            at = e
    return "".join(out) + text[at:]


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
                 max_ratio: float = 2.2, known: frozenset[str] = frozenset()) -> DataFrame:
    """Per document: its id, counts of the base kinds, sha256 of the joined base spans, all spans
    joined as ``kind:start:end`` (code points, end exclusive), and the number of added spans."""
    sent = tokenizer_file(docs.sparkSession, vocabulary)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, max_ratio, known)
        for batch in batches:
            found = [scanner.spans(t.as_py()) for t in batch.column(1)]
            base = [[x for x in f if x[1] < 3] for f in found]
            count = [pa.array([sum(x[1] == k for x in f) for f in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(joined(f).encode()).hexdigest() for f in base]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *count[:3], pa.array(digest, pa.string()), pa.array(map(joined, found), pa.string()),
                 count[3]], [id_col, "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(
        scan, f"`{id_col}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, "
              "n_random long")


def redacted(docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, max_ratio: float = 2.2,
             known: frozenset[str] = frozenset()) -> DataFrame:
    """The same rows and columns with every span replaced by ``[SECRET]``; a null text stays null."""
    sent, at = tokenizer_file(docs.sparkSession, vocabulary), docs.columns.index(text_col)

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(sent.value, max_ratio, known)
        for batch in batches:
            texts = [None if (t := x.as_py()) is None else masked(t, scanner.spans(t)) for x in batch.column(at)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    out = docs.mapInArrow(mask, docs.schema)
    return out.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType)) \
        if "n_chars" in docs.columns else out
