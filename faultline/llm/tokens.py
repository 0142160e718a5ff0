"""Token ids of whole texts with a public tokenizer file, word by word from a bounded cache."""

from __future__ import annotations

import os
import re
from functools import lru_cache

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import numpy as np
from tokenizers import Tokenizer

END = 1
#: Words in one generation of a worker's cache, which keeps two.
CACHE_WORDS = 200_000
#: White space on which the tokenizer's idea of a word may differ from str.split; such texts are encoded whole.
ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
#: New words that are encoded together.
LINE = 512
#: A run of these after letters and before white space is a word of its own to the tokenizer.
MARKS = ".,!%&$#*|?;:"


class _Words(dict):
    """word -> number; new words are numbered and noted for encoding."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordEncoder:
    """encode_batch of a tokenizer that drops white space, with the ids of each word remembered.

    The tokenizer never joins characters across white space, so a text's ids are those of its words in turn.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self._reset()

    def _reset(self) -> None:
        """A new generation; the last one is kept to look words up in, so words in use needn't be encoded again."""
        self.old = (self.words, self.flat, self.start, self.length) if hasattr(self, "words") else None
        self.words = _Words()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.used = 0
        self.start = np.zeros(1 << 16, np.int64)
        self.length = np.zeros(1 << 16, np.int64)

    def whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words in turn, and how many each has.

        Letters are one word to the tokenizer, and so are marks. Words of letters, marks or both in this order go in
        by the line, whose ids are told apart where a word ends; any other goes in alone.
        """
        bases = [w.rstrip(MARKS) for w in words]
        pieces = np.fromiter(((not b or b.isalpha()) * ((b != "") + (len(b) < len(w))) for b, w in zip(bases, words)), np.int64, len(words))
        lengths = np.zeros(len(words), np.int64)
        plain = np.flatnonzero(pieces)
        lines = [plain[i : i + LINE] for i in range(0, len(plain), LINE)]
        found: list[tuple[np.ndarray, np.ndarray]] = []  # members and their ids
        alone = np.flatnonzero(pieces == 0).tolist()
        for members, ids in zip(lines, self.whole([" ".join([words[n] for n in line.tolist()]) for line in lines])):
            ids = np.array(ids, np.uint32)
            closed = np.flatnonzero(self.closing[ids]) + 1
            ends = np.cumsum(pieces[members])
            if len(closed) != ends[-1]:
                alone += members.tolist()
                continue
            lengths[members] = np.diff(np.r_[0, closed[ends - 1]])
            found.append((members, ids))
        for n, ids in zip(alone, self.whole([words[n] for n in alone])):
            lengths[n] = len(ids)
            found.append((np.array([n]), np.array(ids, np.uint32)))
        start = np.cumsum(lengths) - lengths
        flat = np.zeros(int(lengths.sum()), np.uint32)
        for members, ids in found:
            own = lengths[members]
            flat[np.repeat(start[members] - np.cumsum(own) + own, own) + np.arange(len(ids))] = ids
        return flat, lengths

    def _from_old(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """`_encode_words`, where words of the last generation are copied."""
        known, flat, start, length = self.old
        at = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        held, fresh = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
        ids, sizes = self._encode_words([words[n] for n in fresh.tolist()])
        lengths = np.zeros(len(words), np.int64)
        lengths[held], lengths[fresh] = length[at[held]], sizes
        first = np.cumsum(lengths) - lengths
        out = np.zeros(int(lengths.sum()), np.uint32)
        for members, source, starts in ((held, flat, start[at[held]]), (fresh, ids, np.cumsum(sizes) - sizes)):
            own = lengths[members]
            within = np.arange(int(own.sum())) - np.repeat(np.cumsum(own) - own, own)
            out[np.repeat(first[members], own) + within] = source[np.repeat(starts, own) + within]
        return out, lengths

    def _learn(self) -> None:
        """Ids of the words noted since the last call."""
        new, self.words.new = self.words.new, []
        if not new:
            return
        ids, lengths = self._from_old(new) if self.old else self._encode_words(new)
        first, total = len(self.words) - len(new), len(ids)
        while len(self.words) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + total] = ids
        self.length[first : len(self.words)] = lengths
        self.start[first : len(self.words)] = self.used + np.cumsum(lengths) - lengths
        self.used += total

    def encode(self, texts: list[str | None], end: int | None = END) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in turn (uint32), and how many each text has, with `end` after each. None is empty."""
        if len(self.words) > CACHE_WORDS:
            self._reset()
        words: list[str] = []
        sizes, odd = [], {}
        for n, text in enumerate(texts):
            before = len(words)
            if text and ODD_SPACE.search(text):
                odd[n] = text
            elif text:
                words += text.split()
            sizes.append(len(words) - before)
        at = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        self._learn()
        lengths = self.length[at]
        ends = np.cumsum(lengths)
        ids = self.flat[np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(int(lengths.sum()))]
        last = np.cumsum(np.array(sizes, np.int64))
        stops = np.r_[0, ends][last]
        counts = np.diff(np.r_[0, stops])
        if odd:
            parts = np.split(ids, stops[:-1])
            for n, found in zip(odd, self.whole(list(odd.values()))):
                parts[n] = np.array(found, np.uint32)
            ids, counts = np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        if end is not None:
            ends = np.cumsum(counts + 1) - 1
            out = np.empty(len(ids) + len(counts), np.uint32)
            inner = np.ones(len(out), bool)
            inner[ends] = False
            out[inner], out[ends] = ids, end
            ids, counts = out, counts + 1
        return ids.astype(np.uint32, copy=False), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """The encoder of this worker process, kept between tasks."""
    return WordEncoder(path)
