"""Token counts of a unigram tokenizer without building its tokens.

Spaces become U+2581.  Where the vocabulary has that mark as a piece and, in longer pieces, only
in front, no piece crosses the start of a run of spaces: a run and the word behind it are a
group, and a text's count is the sum over its groups.  With any other vocabulary the whole text is one group.  Within a group an Aho-Corasick automaton
enumerates the vocabulary pieces by end position; a Viterbi pass carries only the best
score and the piece count of the best path.  Tie rule: of equal scores the piece that
starts first (the longest) wins; a character that is no piece itself is an unknown edge at
the lowest score minus ten, counted as its UTF-8 bytes when the vocabulary has byte pieces,
else unknown neighbours count as one.

Null counts as empty, with 0 tokens.  Rows are independent and texts are read whole; the
per-task memory of group counts is bounded.  Repeated rows repeat their counts, an empty table has
none, and only the id and text columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tabeval.llm.common import tokenizer_file

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
KEPT = 400_000  # groups whose count a task remembers
LONG = 64  # longer groups are counted anew each time


def vocabulary(model: bytes) -> tuple[list[tuple[str, float]], bool, float]:
    """(pieces with scores, byte fallback?, lowest score) of a sentencepiece model file."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    ids = range(sp.get_piece_size())
    normal = [(sp.id_to_piece(i), sp.get_score(i)) for i in ids
              if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return normal, sum(sp.is_byte(i) for i in ids) == 256, min(sp.get_score(i) for i in ids)


class Counter:
    """Counts for the groups of a text; built inside a task."""

    def __init__(self, pieces: list[tuple[str, float]], byte_fallback: bool, lowest: float) -> None:
        import ahocorasick
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.bytes, self.unknown, self.memo = byte_fallback, lowest - UNKNOWN_PENALTY, {}
        self.cut = SPACE in self.automaton and not any(SPACE in p.lstrip(SPACE) for p, _ in pieces)

    def group(self, g: str) -> int:
        """Pieces on the best path when every character is itself a piece (else :meth:`full`)."""
        n = len(g)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        at, single = 0, True
        for end, (size, score) in self.automaton.iter(g):
            e = end + 1
            s = best[e - size] + score
            if e != at:
                if not single or e != at + 1:
                    return self.full(g)
                at, single = e, size == 1
            elif s > best[e]:
                single |= size == 1
            else:
                single |= size == 1
                continue
            best[e] = s
            count[e] = count[e - size] + 1
        return count[n] if single and at == n else self.full(g)

    def full(self, g: str) -> int:
        """The same with unknown edges."""
        n = len(g)
        best, count, loose = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        matches = [[] for _ in range(n + 1)]
        for end, match in self.automaton.iter(g):
            matches[end + 1].append(match)  # longest first
        for e in range(1, n + 1):
            reached = single = False
            for size, score in matches[e]:
                s = best[e - size] + score
                if not reached or s > best[e]:
                    best[e], count[e], reached = s, count[e - size] + 1, True
                single |= size == 1
            if not single:
                s = best[e - 1] + self.unknown
                if not reached or s > best[e]:
                    best[e], loose[e] = s, True
                    count[e] = count[e - 1] + (len(g[e - 1].encode()) if self.bytes else not loose[e - 1])
        return count[n]

    def text(self, text: str | None) -> int:
        if not text:
            return 0
        memo, total, spaces = self.memo, 0, 0
        text = text.replace(" ", SPACE)
        text = text[1:] if text[0] == SPACE else text
        if not self.cut:
            return self.group(SPACE + text)
        for part in text.split(SPACE):
            if not part:  # a further space in front of the next word
                spaces += 1
                continue
            if spaces:
                part, spaces = SPACE * spaces + part, 0
            n = memo.get(part)
            if n is None:
                n = self.group(SPACE + part)
                if len(part) <= LONG:
                    if len(memo) >= KEPT:
                        memo.clear()
                    memo[part] = n
            total += n
        return total + self.group(SPACE * spaces) if spaces else total


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """Per document: its id, n_chars (code points) and n_tokens."""
    sent = tokenizer_file(docs.sparkSession, model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(*vocabulary(sent.value))
        for batch in batches:
            texts = [t.as_py() or "" for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array(map(counter.text, texts), pa.int64())],
                [id_col, "n_chars", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(count, f"`{id_col}` {kind}, n_chars long, n_tokens long")
