"""Token counts of whole texts by byte-pair merging on a heap and linked lists; no token id leaves a merge."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from heapq import heapify, heappop, heappush

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer

LIMIT = 2048
#: Words, and pieces of words, in one generation of a worker's cache, which keeps two.
CACHE_WORDS = 400_000
#: A word of these bytes is split into pieces by `ASCII_PIECE`, the tokenizer's own pattern on such bytes.
PRINTABLE = bytes(range(0x21, 0x7F))
ASCII_PIECE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+").findall


class Merges:
    """The merge table of a tokenizer file: pair of symbols -> rank, rank -> symbol made."""

    def __init__(self, vocabulary: dict[str, int], merges: list, word_end: str):
        self.symbol, self.word_end = vocabulary, word_end
        self.bits = max(vocabulary.values(), default=0).bit_length()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.rank = {vocabulary[a] << self.bits | vocabulary[b]: r for r, (a, b) in enumerate(pairs)}
        self.made = [vocabulary[a + b] for a, b in pairs]

    def count(self, piece: str) -> int:
        """Symbols left of a piece when no adjacent pair can be merged: its initial symbols minus the merges done.

        Symbols are linked both ways. The heap holds (rank, position) of adjacent pairs; the lowest is popped and
        merged into its left symbol unless one of its two symbols has changed since. O(n log n) for n symbols.
        """
        known, bits = self.symbol, self.bits
        symbols = [known[c] for c in piece[:-1] if c in known]
        if piece and (last := piece[-1] + self.word_end) in known:
            symbols.append(known[last])
        n = live = len(symbols)
        if n < 2:
            return n
        rank, made, place = self.rank, self.made, n.bit_length()
        low = (1 << place) - 1
        heap, left = [], symbols[0]
        for i in range(1, n):
            right = symbols[i]
            if (pair := left << bits | right) in rank:
                heap.append(rank[pair] << place | i - 1)
            left = right
        if not heap:
            return n
        heapify(heap)
        before, after = list(range(-1, n)), list(range(1, n + 2))
        symbols.append(-1)  # past the end, as are symbols that were merged away: pairs with it have no rank
        while heap:
            top = heappop(heap)
            i = top & low
            j = after[i]
            if symbols[i] < 0 or rank.get(symbols[i] << bits | symbols[j], -1) != top >> place:
                continue
            symbols[i] = new = made[top >> place]
            symbols[j] = -1
            live -= 1
            after[i] = j = after[j]
            before[j] = i
            if (pair := new << bits | symbols[j]) in rank:
                heappush(heap, rank[pair] << place | i)
            j = before[i]
            if j >= 0 and (pair := symbols[j] << bits | new) in rank:
                heappush(heap, rank[pair] << place | j)
        return live


class _Kept(dict):
    """A cache of two generations: when the young one is full the old one goes, so what is in use stays."""

    def __init__(self, count):
        super().__init__()
        self.count, self.old = count, {}

    def __missing__(self, key):
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        n = self.old.get(key)
        self[key] = n = self.count(key) if n is None else n
        return n


class Counter:
    """Tokens of a text, word by word (UTF-8 bytes without white space); a word is counted when first met.

    A word is normalised and split into pieces as the tokenizer file says; its merges are done by `Merges`. The
    tokenizer joins nothing across white space, so a text has the sum of its words. A special token's string counts
    as one token wherever it stands, which is the library's default.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            held = json.load(file)
        if held["model"]["type"] != "BPE" or held["model"].get("continuing_subword_prefix"):
            raise ValueError(f"{path} is not a byte-pair tokenizer without prefixes")
        self.merges = Merges(held["model"]["vocab"], held["model"]["merges"], held["model"].get("end_of_word_suffix") or "")
        tokenizer = Tokenizer.from_file(path)
        self.normalize = tokenizer.normalizer.normalize_str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str
        self.special = sorted((t["content"].encode() for t in held["added_tokens"]), key=len, reverse=True)
        self.any_special = re.compile(b"|".join(map(re.escape, self.special)) or b"(?!)")
        cuts = held["pre_tokenizer"].get("pretokenizers", [{}])[0].get("pattern", {}).get("Regex")
        lowers = [n["type"] for n in held["normalizer"].get("normalizers", [])][-1:] == ["Lowercase"]
        self.plain = cuts == ASCII_PIECE and lowers
        self.pieces, self.words = _Kept(self.merges.count), _Kept(self._word)

    def _part(self, part: bytes) -> int:
        if self.plain and not part.translate(None, PRINTABLE):
            found = ASCII_PIECES(part.decode().lower())
        else:
            found = [piece for piece, _ in self.split(self.normalize(part.decode()))]
        if len(found) == 1:
            return self.pieces[found[0]]
        return sum(map(self.pieces.__getitem__, found))

    def _word(self, word: bytes) -> int:
        if any(s in word for s in self.special):
            return len(self.any_special.findall(word)) + sum(map(self._part, filter(None, self.any_special.split(word))))
        return self._part(word)

    def of(self, text: bytes | None) -> int:
        return sum(map(self.words.__getitem__, text.split())) if text else 0


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    """The counter of this worker process, kept between tasks."""
    return Counter(path)


def count_tokens(docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_tokens, over_limit.

    A map without a shuffle: each worker reads whole texts and keeps the counts of the words it has met. NULL and
    empty texts have 0 bytes and 0 tokens. Repeated rows and NULL ids are counted row by row; an empty table gives no
    rows; other columns, whatever their names, aren't read. A word of millions of letters takes n log n steps.
    """

    @F.pandas_udf("bigint")
    def tokens(texts: pd.Series) -> pd.Series:
        return texts.map(counter(path).of, na_action=None)

    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("b"))
    counted = rows.select("doc_id", F.octet_length("b").cast("bigint").alias("n_bytes"), tokens("b").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
