"""Ids of whole texts by a public tokenizer, with the work done once for each distinct word.

The tokenizer drops white space and never lets a piece cross it, so a text's ids are those of its
words in turn. Words made of letters and closing punctuation are cut further, as the tokenizer's
own pattern cuts them, and letter words are encoded many at a time.
"""

from __future__ import annotations

import functools
import itertools
import os

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from flowmill.llm.shared import batch_words, ragged, slices

MARKS = ".,!?;:"
#: Letters that stay one letter when the tokenizer normalizes them; after others a closing mark may join what they leave.
PLAIN = r"^[A-Za-z\x{C0}-\x{12F}\x{131}-\x{24F}\x{400}-\x{45F}]+$"
LONG = 64
#: How the tokenizer's pieces say that they end a word, and how many words are encoded as one text.
WORD_END = "</w>"
RUN = 256
MOST_KEYS = 800_000


class WordEncoder:
    """Encodes batches of texts; each text's ids end with `end_id`.

    `known` maps a key - a letter word with A-Z lower-cased, or any other word as it is - to its ids'
    place in `store`; both are emptied when there are too many keys.
    """

    def __init__(self, path: str, end_id: int):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        pieces = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(pieces.values()) + 1, bool)
        self.ends_word[[i for piece, i in pieces.items() if piece.endswith(WORD_END)]] = True
        self.known: dict[str, int] = {}
        self._empty()

    def _empty(self) -> None:
        self.known.clear()
        self.store, self.ends = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64)
        self._keep([""], np.zeros(0, np.uint32), np.zeros(1, np.int64))
        self._keep(list(MARKS), *self._alone(list(MARKS)))

    def _keep(self, keys: list[str], flat: np.ndarray, counts: np.ndarray) -> None:
        n = len(self.known)
        used = int(self.ends[n - 1]) if n else 0
        while used + len(flat) > len(self.store):
            self.store = np.concatenate([self.store, np.zeros_like(self.store)])
        while n + len(keys) > len(self.ends):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        self.store[used : used + len(flat)] = flat
        self.ends[n : n + len(keys)] = used + np.cumsum(counts)
        self.known.update(zip(keys, range(n, n + len(keys)), strict=True))

    def _alone(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for one in ids for i in one], np.uint32), np.array([len(one) for one in ids], np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and their counts, of letter words, encoded many to a text and cut behind ids that end a word."""
        runs = [" ".join(words[i : i + RUN]) for i in range(0, len(words), RUN)]
        found = [e.ids for e in self.tokenizer.encode_batch_fast(runs, add_special_tokens=False)]
        flat = np.fromiter(itertools.chain.from_iterable(found), np.uint32, sum(map(len, found)))
        last = np.flatnonzero(self.ends_word[flat])
        if len(last) != len(words) or last[-1] + 1 != len(flat):
            return self._alone(words)
        return flat, np.diff(last, prepend=-1)

    def _numbers(self, keys: list[str]) -> np.ndarray:
        """Each distinct key's number, after encoding those that are new."""
        if len(self.known) + len(keys) > max(MOST_KEYS, 2 * len(keys)):
            self._empty()
        new = [k for k in keys if k not in self.known]
        letters = [k for k in new if k.isalpha()]
        for i in range(0, len(letters), 64 * RUN):
            self._keep(letters[i : i + 64 * RUN], *self._together(letters[i : i + 64 * RUN]))
        others = [k for k in new if not k.isalpha()]
        self._keep(others, *self._alone(others))
        return np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the batch (uint32), and where each text's begin, with an end."""
        parts = [self._encode(part) for part in slices(texts)]
        sizes = np.concatenate([np.zeros(1, np.int64), *[np.diff(begin) for _, begin in parts]])
        return np.concatenate([np.zeros(0, np.uint32), *[ids for ids, _ in parts]]), np.cumsum(sizes)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        begin, index, words = batch_words(texts)
        core = pc.utf8_rtrim(words, characters=MARKS)
        tail = np.asarray(pc.subtract(pc.binary_length(words), pc.binary_length(core)))
        regular = np.asarray(pc.match_substring_regex(core, PLAIN)) & np.asarray(pc.utf8_is_alpha(core)) & (tail <= 1) & (np.asarray(pc.binary_length(words)) <= LONG)
        keys = pc.if_else(pa.array(regular), pc.ascii_lower(core), words).dictionary_encode()
        number = self._numbers(keys.dictionary.to_pylist())[np.asarray(keys.indices)]
        tailed = np.flatnonzero(regular & (tail == 1))
        mark = np.zeros(len(words), np.int64)
        mark[tailed] = [self.known[w[-1]] for w in words.take(pa.array(tailed)).to_pylist()]
        pair = np.stack([number, mark], axis=1).ravel()
        heads = np.where(pair > 0, self.ends[pair - 1], 0)
        lengths = self.ends[pair] - heads
        # each distinct word's ids, and as one word more the end id, which closes every text
        once = np.append(self.store[ragged(heads, lengths)], np.uint32(self.end_id))
        sizes = np.append(lengths.reshape(-1, 2).sum(axis=1), 1)
        starts = np.cumsum(sizes) - sizes
        closed = np.insert(index, begin[1:], len(words))
        taken = sizes[closed]
        upto = np.concatenate([[0], np.cumsum(taken)])[begin + np.arange(len(begin))]
        return once[ragged(starts[closed], taken)], upto


@functools.lru_cache(maxsize=2)
def encoder(path: str, end_id: int) -> WordEncoder:
    """A process has one encoder, so that its tasks share what it knows."""
    return WordEncoder(path, end_id)
