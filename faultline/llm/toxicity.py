"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy in rounds over all tasks."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import attach_small, short_batches
from faultline.session import cut

WORDS = re.compile(r"[^\W\d_]+")
#: Byte -> its lower-case letter, or a space.
LETTERS = bytes(ord(chr(i).lower()) if chr(i).isalpha() and i < 128 else 32 for i in range(256))
BUCKETS = 1 << 15
WIDTH = 16
FILTERS = 16
SPANS = (1, 2, 3)
PREFIXES = (3, 4, 5, 6)
#: Labelled rows of one partition, rows that one task of the fit learns from in a round, and rounds over all of them.
#: A task hands on a whole net, so its size bounds what rounds write, however many files the rows lie in.
PART_ROWS = 4096
FIT_ROWS = 8192
EPOCHS = 5
#: Labels (id and flag) that are broadcast; with more, the texts that may be learned from are shuffled once.
LABEL_ROWS = 500_000
#: Texts of one step of the fit, and the words from which it has fewer.
BATCH = 64
BATCH_WORDS = 200_000
#: Rows of the parameters that are merged together.
CHUNK = 1024
#: Steps of a logit in which rows are counted for the thresholds.
STEPS = 1000
#: Words scored in one go; longer texts go in pieces that overlap, so no window is lost.
PIECE = 20_000
#: Words whose filter responses are held at once.
BLOCK_WORDS = 8_000
CUT = 0.7
SEED = 2


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of letters; ASCII texts are cut by a table of bytes, with the same result."""
    if text and text.isascii():
        return text.encode().translate(LETTERS).decode().split()
    return WORDS.findall((text or "").lower())


def hashed(words: list[str]) -> np.ndarray:
    """Buckets of each word: the word itself and its beginnings (the word again where it is shorter)."""
    own = np.fromiter((zlib.crc32(w.encode("utf-8", "replace")) for w in words), np.uint32, len(words)) % BUCKETS
    most = max(PREFIXES)
    heads = np.array([w[:most] for w in words], f"U{most}").view(np.uint32).reshape(-1, most)  # code points, then 0
    found, state = [own], np.full(len(words), 0x811C9DC5, np.uint32)
    for n in range(1, most + 1):
        state = (state ^ heads[:, n - 1]) * np.uint32(0x9E3779B1)
        state ^= state >> np.uint32(15)
        if n in PREFIXES:
            mixed = (state * np.uint32(0x85EBCA6B) + np.uint32(n)) >> np.uint32(16)
            found.append(np.where(heads[:, n - 1] > 0, mixed % BUCKETS, own))
    return np.stack(found, axis=1).astype(np.int64)


class Vocabulary(dict):
    """word -> number within a batch; the buckets of each number. Number 0 stands between texts and has no vector."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self) + 1
        return n

    def numbers(self, text: str | None) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))

    def buckets(self) -> np.ndarray:
        return np.concatenate([np.zeros((1, len(PREFIXES) + 1), np.int64), hashed(list(self))])


@dataclass
class Net:
    """Embedding table, filters by span (span x width x filters), biases, and the last layer."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float
    shift: float = 0.0

    @staticmethod
    def over(flat: np.ndarray) -> Net:
        """A net whose parameters are the rows of `flat` (each of `WIDTH` numbers), not copies of them."""
        table, at, filters = flat[:BUCKETS], BUCKETS, []
        for span in SPANS:
            filters.append(flat[at : at + span * WIDTH].reshape(span, WIDTH, FILTERS))
            at += span * WIDTH
        bias = [flat[at + i] for i in range(len(SPANS))]
        at += len(SPANS)
        return Net(table, filters, bias, flat[at : at + len(SPANS)].reshape(-1), float(flat[-1, 0]))

    @staticmethod
    def fresh(seed: int = SEED) -> np.ndarray:
        """Rows of a net before training."""
        rng = np.random.default_rng(seed)
        flat = np.zeros((BUCKETS + sum(SPANS) * WIDTH + 2 * len(SPANS) + 1, WIDTH), np.float32)
        net = Net.over(flat)
        net.table[:] = rng.normal(0, 0.05, (BUCKETS, WIDTH))
        for f in net.filters:
            f[:] = rng.normal(0, 0.3, f.shape)
            f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2])
        net.out[:] = rng.normal(0, 0.1, len(net.out))
        flat[-1, 0] = -1.0
        return flat

    def vectors(self, buckets: np.ndarray) -> np.ndarray:
        found = self.table[buckets[:, 0]]
        for column in buckets.T[1:]:
            found += self.table[column]
        found[0] = 0
        return found

    def maps(self, x: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Responses of all filters, by span, at each word of a joined sequence, 0 between texts."""
        made = x @ np.concatenate([f[0] for f in self.filters], axis=1)
        for j in range(1, max(SPANS)):
            wide = [k for k, span in enumerate(SPANS) if span > j]  # the last ones
            made[:-j, wide[0] * FILTERS :] += (x @ np.concatenate([self.filters[k][j] for k in wide], axis=1))[j:]
        made += np.concatenate(self.bias)
        np.maximum(made, 0, out=made)
        made[~text] = 0
        return made

    def logits(self, sequences: list[np.ndarray], buckets: np.ndarray) -> np.ndarray:
        """One number per text: largest response of each filter over the whole text, then the last layer."""
        ahead = max(SPANS) - 1
        pieces = [s[i : i + PIECE] for s in sequences for i in range(0, max(1, len(s)), PIECE - ahead)]
        owner = [n for n, s in enumerate(sequences) for _ in range(0, max(1, len(s)), PIECE - ahead)]
        goes_on = np.diff(owner, append=-1) == 0
        block = np.cumsum([len(s) for s in pieces]) // BLOCK_WORDS
        bounds = np.r_[0, np.flatnonzero(np.diff(block)) + 1, len(pieces)].tolist()
        vectors, found = self.vectors(buckets), []
        for a, b in zip(bounds, bounds[1:]):
            seq, starts = join_texts(pieces[a:b])
            text = seq > 0
            for n in np.flatnonzero(goes_on[a:b]).tolist():  # windows from its last words are whole in the next piece
                end = starts[n] + len(pieces[a + n])
                text[end - ahead : end] = False
            found.append(np.maximum.reduceat(self.maps(vectors[seq], text), starts))
        first = np.searchsorted(owner, np.arange(len(sequences)))
        return np.maximum.reduceat(np.concatenate(found), first) @ self.out + self.out_bias + self.shift


def join_texts(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Texts in one row with enough gaps that no window holds words of two, and their starts."""
    gap = np.zeros(max(SPANS), np.int32)
    lengths = np.array([len(s) + len(gap) for s in sequences])
    return np.concatenate([x for s in sequences for x in (s, gap)]), np.cumsum(lengths) - lengths


def step(flat: np.ndarray, sums: np.ndarray, sequences: list[np.ndarray], buckets: np.ndarray, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """One step of AdaGrad on the weighted log loss of some texts, in place; the buckets it touched."""
    net, acc = Net.over(flat), Net.over(sums)
    seq, starts = join_texts(sequences)
    ends = np.r_[starts[1:], len(seq)]
    own = net.vectors(buckets)[seq]
    maps = net.maps(own, seq > 0)
    peak = np.array([a + maps[a:b].argmax(axis=0) for a, b in zip(starts, ends)])
    pooled = np.take_along_axis(maps, peak, 0)
    p = 1 / (1 + np.exp(-(pooled @ net.out + net.out_bias)))
    slope = ((p - toxic) * weight / len(toxic)).astype(np.float32)
    rows, changes = [], []
    steps = []  # parameter, gradient, sums
    pulls = slope[:, None] * net.out * (pooled > 0)
    for k, f in enumerate(net.filters):
        own_filters = slice(k * FILTERS, (k + 1) * FILTERS)
        g, position = pulls[:, own_filters], peak[:, own_filters]
        grad = np.zeros_like(f)
        for j in range(len(f)):
            where = np.minimum(position + j, len(seq) - 1)
            grad[j] = np.einsum("df,dfw->wf", g, own[where])
            real = (seq[where] > 0) & (g != 0)
            rows.append(buckets[seq[where][real]].ravel())
            changes.append(np.repeat((g[:, :, None] * f[j].T)[real], buckets.shape[1], axis=0))
        steps += [(f, grad, acc.filters[k]), (net.bias[k], g.sum(axis=0), acc.bias[k])]
    steps += [(net.out, pooled.T @ slope, acc.out), (flat[-1, :1], slope.sum(keepdims=True), sums[-1, :1])]
    every = np.concatenate(rows)
    order = np.argsort(every, kind="stable")
    touched, first = np.unique(every[order], return_index=True)
    if len(touched):
        total = np.add.reduceat(np.concatenate(changes)[order], first)
        sums[touched] += total**2
        net.table[touched] -= 0.05 * total / np.sqrt(sums[touched])
    for param, grad, total in steps:
        total += grad**2
        param -= (0.05 * grad / np.sqrt(total)).astype(np.float32)
    return touched


PACK = "words binary, lengths binary, buckets binary, toxic binary"


def _pack(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The texts of a step in one row: their words as numbers, words and label of each, and the buckets of each number.

    A step has `BATCH` texts, or fewer from `BATCH_WORDS` words. Made once, so no round takes the texts apart again.
    """
    vocabulary, held, toxic = Vocabulary(), [], []

    def row() -> pd.DataFrame:
        parts = (np.concatenate(held).astype(np.int32), np.array([len(s) for s in held], np.int32), vocabulary.buckets().astype(np.uint16), np.array(toxic, np.int8))
        return pd.DataFrame({name: [x.tobytes()] for name, x in zip(("words", "lengths", "buckets", "toxic"), parts)})

    for pdf in batches:
        for text, y in zip(pdf.text.tolist(), pdf.toxic.tolist()):
            held.append(vocabulary.numbers(text))
            toxic.append(y)
            if len(held) == BATCH or sum(map(len, held)) > BATCH_WORDS:
                yield row()
                vocabulary, held, toxic = Vocabulary(), [], []
    if held:
        yield row()


def unpack(row) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Numbered words of each text of a step, buckets of each number, labels."""
    ends = np.cumsum(np.frombuffer(row.lengths, np.int32))
    buckets = np.frombuffer(row.buckets, np.uint16).reshape(-1, len(PREFIXES) + 1).astype(np.int64)
    return np.split(np.frombuffer(row.words, np.int32), ends[:-1]), buckets, np.frombuffer(row.toxic, np.int8)


def packs(rows: DataFrame, n: int) -> DataFrame:
    """The `n` rows (text, toxic) as steps of the fit, written once, in about `n / FIT_ROWS` partitions."""
    made = cut(short_batches(rows.select("text", "toxic")).mapInPandas(_pack, PACK))
    return made.coalesce(max(1, -(-n // FIT_ROWS)))


def _train_part(model, weight: dict[int, float], epoch: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """The steps of a task from the net of the last round; then its parameters in chunks.

    `n` is how often the task changed a row of parameters.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        flat, sums = (x.copy() for x in model.value)
        changed, part = np.zeros(len(flat), np.float32), TaskContext.get().partitionId()
        rng = np.random.default_rng([SEED, epoch, part])
        for pdf in batches:
            steps = list(pdf.itertuples())
            for n in rng.permutation(len(steps)).tolist():
                sequences, buckets, toxic = unpack(steps[n])
                touched = step(flat, sums, sequences, buckets, toxic, np.where(toxic == 1, weight[1], weight[0]))
                changed[touched] += 1
                changed[BUCKETS:] += 1
        if changed.any():
            for at in range(0, len(flat), CHUNK):
                own = slice(at, at + CHUNK)
                yield pd.DataFrame({"chunk": [at], "part": [part], "n": [changed[own].tobytes()], "flat": [flat[own].tobytes()], "sums": [sums[own].tobytes()]})

    return run


def _merge(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Mean of each row of parameters over the tasks that changed it, by how often they did."""
    held: dict[int, list[np.ndarray]] = {}
    for pdf in batches:
        for chunk, n, flat, sums in zip(pdf.chunk.tolist(), pdf.n, pdf.flat, pdf.sums):
            n = np.frombuffer(n, np.float32).astype(np.float64)
            seen = [n, *[np.frombuffer(x, np.float32).reshape(-1, WIDTH) * n[:, None] for x in (flat, sums)]]
            held[chunk] = [a + b for a, b in zip(held[chunk], seen)] if chunk in held else seen
    for chunk, (n, flat, sums) in held.items():
        some = np.maximum(n, 1)[:, None]
        yield pd.DataFrame({"chunk": [chunk], "n": [n.astype(np.float32).tobytes()], "flat": [(flat / some).astype(np.float32).tobytes()], "sums": [(sums / some).astype(np.float32).tobytes()]})


def _bucket_counts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of each label that a task has, and those with each bucket."""
    seen = np.zeros((2, BUCKETS), np.int64)
    for pdf in batches:
        for row in pdf.itertuples():
            sequences, buckets, toxic = unpack(row)
            for s, y in zip(sequences, toxic.tolist()):
                seen[y, np.unique(buckets[np.unique(s)])] += 1
    label, bucket = np.nonzero(seen)
    yield pd.DataFrame({"toxic": label, "bucket": bucket, "n": seen[label, bucket]})


def fit(rows: DataFrame, count: dict[int, int], epochs: int = EPOCHS) -> np.ndarray:
    """Parameters from all rows (text, toxic), `count` of them by label; both labels occur.

    The first embedding dimension starts as the buckets' log odds over all rows. Each round, every task goes on from the
    same net over its rows, and the nets are merged by chunks; only the merged one comes to the driver.
    """
    sc = rows.sparkSession.sparkContext
    steps = packs(rows, sum(count.values()))
    flat = Net.fresh()
    seen = np.ones((2, BUCKETS))
    for y, bucket, n in steps.mapInPandas(_bucket_counts, "toxic int, bucket int, n bigint").groupBy("toxic", "bucket").agg(F.sum("n")).collect():
        seen[y, bucket] += n
    flat[:BUCKETS, 0] = np.clip(np.log(seen[1] / (count[1] + 2)) - np.log(seen[0] / (count[0] + 2)), -2, 4) * 0.3
    sums = np.full_like(flat, 1e-6)
    weight = {y: 0.5 * sum(count.values()) / count[y] for y in (0, 1)}
    for epoch in range(epochs):
        model = sc.broadcast((flat, sums))
        trained = steps.mapInPandas(_train_part(model, weight, epoch), "chunk int, part int, n binary, flat binary, sums binary")
        merged = trained.repartition("chunk").sortWithinPartitions("chunk", "part").mapInPandas(_merge, "chunk int, n binary, flat binary, sums binary")
        flat, sums = flat.copy(), sums.copy()
        for x in merged.collect():
            some = np.flatnonzero(np.frombuffer(x.n, np.float32))
            for mine, new in ((flat, x.flat), (sums, x.sums)):
                mine[x.chunk + some] = np.frombuffer(new, np.float32).reshape(-1, WIDTH)[some]
    return flat


def score_texts(net: Net, texts: list[str | None]) -> np.ndarray:
    vocabulary = Vocabulary()
    sequences = [vocabulary.numbers(t) for t in texts]
    return 1 / (1 + np.exp(-np.clip(net.logits(sequences, vocabulary.buckets()).astype(np.float64), -40, 40)))


def best_cut(bins: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """Logit of the best F1, in the middle of the gap below it, from the rows and toxic rows of each bin."""
    order = np.argsort(-bins, kind="stable")
    at, n, hits = bins[order], np.cumsum(n[order]), np.cumsum(toxic[order])
    best = int((2 * hits / (n + max(1, hits[-1]))).argmax())
    below = at[best + 1] if best + 1 < len(at) else at[best] - STEPS
    return float(at[best] + below) / 2 / STEPS


def _logit(p: float | np.ndarray):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


def train(rows: DataFrame, min_positives: int = 20) -> tuple[Net, dict[str, float]]:
    """Net and threshold by language from all of rows (text, lang, toxic, cut).

    Rows marked `cut` are kept from the fit and set the thresholds. The net's output is shifted so that 0.7 is the best
    threshold over all of them; a language has its own where it has `min_positives` toxic rows to find it by.
    With one label only there is nothing to learn and every score is low or high by that label.
    """
    count = {(x["cut"], x.toxic): x.n for x in rows.groupBy("cut", "toxic").agg(F.count("*").alias("n")).collect()}
    whole = {y: count.get((True, y), 0) + count.get((False, y), 0) for y in (0, 1)}
    if not all(whole.values()):
        flat = Net.fresh()
        flat[BUCKETS:] = 0
        flat[-1, 0] = 3.0 if whole[1] else -3.0
        return Net.over(flat), {}
    apart = len(count) == 4
    fitted = fit(rows.where("NOT cut"), {y: count[False, y] for y in (0, 1)}) if apart else fit(rows, whole)
    net = Net.over(fitted)
    model = rows.sparkSession.sparkContext.broadcast(net)
    scored = (rows.where("cut") if apart else rows).select("text", F.struct("lang", "toxic").alias("keep")).mapInPandas(
        _score(model, ["keep"]), "keep struct<lang: string, toxic: int>, score double")
    p = F.greatest(F.least("score", F.lit(1 - 1e-9)), F.lit(1e-9))
    logit = F.round((F.log(p) - F.log1p(-p)) * STEPS).cast("bigint").alias("bin")
    bins = scored.select("keep.*", logit).groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toPandas()
    every = bins.groupby("bin", as_index=False)[["n", "toxic"]].sum()
    net.shift = float(_logit(CUT)) - best_cut(*(every[c].to_numpy() for c in ("bin", "n", "toxic")))
    cuts = {}
    for name, own in bins.groupby("lang"):
        if own.toxic.sum() >= min_positives:
            at = best_cut(*(own[c].to_numpy() for c in ("bin", "n", "toxic"))) + net.shift
            cuts[name] = float(1 / (1 + np.exp(-at)))
    return net, cuts


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, lang, toxic, cut) of every row whose label may be learned from, dealt to tasks by hash and written once.

    `cut` marks every fourth id, by hash. Long texts are there whole.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
    each = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    ours = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    found = attach_small(ours, each, ["doc_id"], "inner", LABEL_ROWS)
    parts = max(1, -(-each.count() // PART_ROWS))
    order = F.xxhash64(F.lit(SEED), "doc_id")
    marked = found.withColumn("cut", F.crc32(F.concat(F.lit("cut"), F.col("doc_id").cast("string"))) % 4 == 0)
    return cut(marked.repartition(parts, order).sortWithinPartitions(order, "doc_id", "text"))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels must not be learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _score(model, kept: list[str]) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = pdf.text.str.len().fillna(0).to_numpy()
            group = (np.cumsum(sizes) // 1_000_000).astype(int)  # about a million characters at once
            for g in np.unique(group):
                some = pdf[group == g]
                yield some[kept].assign(score=score_texts(model.value, some.text.tolist()))

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, and by language: lang, threshold, flagged.

    The score comes from the text alone: whole, lower-cased words of letters. NULL and empty texts get the score of a
    text without words. Repeated rows are scored one by one. `threshold` is that of the row's language, else `CUT`.
    """
    net, cuts = train(training_rows(short_batches(docs), labels))
    model = docs.sparkSession.sparkContext.broadcast(net)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", "lang")
    scored = rows.mapInPandas(_score(model, ["doc_id", "lang"]), "doc_id bigint, lang string, score double")
    own = F.lit(CUT)
    for name, at in sorted(cuts.items()):
        own = F.when(F.col("lang") == name, F.lit(at)).otherwise(own)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        "lang",
        own.alias("threshold"),
        (F.col("score") >= own).alias("flagged"),
    )
