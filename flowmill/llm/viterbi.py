"""Token counts by a unigram vocabulary: only the best score and the number of pieces are carried.

For each word an Aho-Corasick automaton gives all vocabulary pieces that end at each position. The
dynamic programme keeps, for each position, the best score and the count of pieces on that path, and
nothing to trace the path by. Ties follow the public unigram tokenizers: starts are taken from left to
right, pieces from short to long, a character of its own as unknown last, and only a strictly better
score replaces one, so of equal scores the earliest start wins. Unknown characters cost 10 below the
worst score; neighbouring ones are fused, then spelt in bytes if the vocabulary has the bytes of all,
else one unknown piece.

White space ends words and is dropped; each word begins with the mark U+2581, which also divides
words where it stands in them. Each distinct word is worked on once while it is remembered.

The vocabulary supplied has ranks, not probabilities; `zipf_scores` turns rank r into -ln(r + 1). So the
query's counts are those of a model made up from a public vocabulary, not of any published one; with a
unigram vocabulary's own scores the operator counts as its tokenizer does.

Defined cases: very long texts are read whole, word by word; null, empty and blank texts have 0 tokens; repeated rows and null doc_ids are rows of
their own; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowmill.llm.shared import BoundedMemo, texts_of

MARK = "▁"
UNKNOWN_COST = 10.0
# The characters with Unicode's property White_Space, and those that only Python counts.
WORDS = re.compile("[^\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
CONTROLS = re.compile("[\x1c-\x1f]")


def zipf_scores(path: str) -> list[tuple[str, float]]:
    """A sentencepiece vocabulary's pieces in order, with a log-probability for each rank."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), -math.log(i + 1.0)) for i in range(model.get_piece_size())]


class UnigramCounter:
    def __init__(self, vocabulary: list[tuple[str, float]]):
        self.pieces = ahocorasick.Automaton()
        for piece, score in vocabulary:
            if piece:
                self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_COST
        self.bytes = {piece for piece, _ in vocabulary if len(piece) == 6 and piece.startswith("<0x")}
        self.memo: BoundedMemo = BoundedMemo(500_000)

    def _spelt(self, chars: str) -> int:
        """Pieces of a run of unknown characters."""
        raw = chars.encode()
        return len(raw) if all(f"<0x{b:02X}>" in self.bytes for b in raw) else 1

    def word(self, word: str) -> int:
        """Pieces on the best path through a word that begins with the mark."""
        n = len(word)
        best, count = [0.0] * (n + 1), [0] * (n + 1)
        # start of the run of unknown characters that the best path ends with, or None
        run: list[int | None] = [None] * (n + 1)
        end, top, from_, single = 1, -math.inf, -1, False

        def close() -> None:
            nonlocal end, top, from_, single
            if not single and best[end - 1] + self.unknown > top:
                head = run[end - 1] if run[end - 1] is not None else end - 1
                best[end], run[end], count[end] = best[end - 1] + self.unknown, head, count[head] + self._spelt(word[head:end])
            else:
                best[end], count[end] = top, count[from_] + 1
            end, top, from_, single = end + 1, -math.inf, -1, False

        # matches come by their ends, and the longest first for each
        for last, (length, score) in self.pieces.iter(word):
            while end <= last:
                close()
            if best[end - length] + score > top:
                top, from_ = best[end - length] + score, end - length
            single = single or length == 1
        while end <= n:
            close()
        return count[n]

    def chunk(self, chunk: str) -> int:
        """Pieces of a run of characters without white space."""
        got = self.memo.get(chunk)
        if got is None:
            got = sum(self.word(MARK + part) for part in _marked(chunk))
            if len(chunk) <= 64:
                self.memo[chunk] = got
        return got

    def text(self, text: str) -> int:
        return sum(map(self.chunk, _words(text)))


def _marked(chunk: str) -> list[str]:
    """What follows each mark once one is put first, unless the chunk begins with one."""
    return (chunk if chunk.startswith(MARK) else MARK + chunk).split(MARK)[1:]


def _words(text: str) -> list[str]:
    """Split at Unicode white space; four control characters that Python counts as such are not."""
    return WORDS.findall(text) if CONTROLS.search(text) else text.split()


def token_counts(docs: DataFrame, vocabulary: list[tuple[str, float]]) -> DataFrame:
    """doc_id and n_tokens of every whole text. The vocabulary goes to each task with its code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = UnigramCounter(vocabulary)
        for batch in batches:
            counter.memo.trim()
            counts = np.array([counter.text(t) for t in texts_of(batch.column(1)).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts)], ["doc_id", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long")
