"""Token ids of a corpus as a table of compressed blocks in ascending doc_id order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from faultline.llm.common import attach_small, parts_for, short_batches
from faultline.llm.rangecoder import decode_blocks, encode_blocks
from faultline.llm.tokens import encoder

BLOCK = 2048
LANES = 2048
#: Documents of one partition on average.
PART_DOCS = 4096
FILE_KIND = "part int, block int, continued boolean, doc_ids array<bigint>, doc_tokens array<int>, payload binary"


def _encode_part(path: str, block: int, lanes: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, done, open_ = TaskContext.get().partitionId(), 0, False
        held_ids: list[np.ndarray] = []
        held_docs: list = []
        held_counts: list[int] = []

        def flush(final: bool) -> pd.DataFrame | None:
            nonlocal held_ids, held_docs, held_counts, done, open_
            ids = np.concatenate(held_ids)
            n = len(ids) if final else len(ids) // block * block
            if not n:
                held_ids = [ids]
                return None
            blocks = [ids[i : min(i + block, n)] for i in range(0, n, block)]
            ends = np.cumsum(held_counts)
            cuts = np.unique(np.r_[0, ends[ends < n], np.arange(block, n, block), n])
            sizes, of, at = np.diff(cuts), np.searchsorted(ends, cuts[:-1], side="right"), cuts[:-1] // block
            starts = np.r_[0, ends[:-1]]
            first = np.searchsorted(at, np.arange(len(blocks)))
            bounds = np.r_[first, len(at)]
            inside = cuts[first] > starts[of[first]]
            inside[0] |= open_
            frame = pd.DataFrame(
                {
                    "part": part,
                    "block": np.arange(done, done + len(blocks)),
                    "continued": inside,
                    "doc_ids": [[held_docs[i] for i in of[a:b]] for a, b in zip(bounds, bounds[1:])],
                    "doc_tokens": [sizes[a:b].tolist() for a, b in zip(bounds, bounds[1:])],
                    "payload": encode_blocks(blocks),
                }
            )
            done += len(blocks)
            gone = int(np.searchsorted(ends, n, side="right"))  # documents that are wholly written
            open_ = bool(gone < len(ends) and n > starts[gone])
            held_ids, held_docs = [ids[n:]], held_docs[gone:]
            held_counts = np.diff(np.r_[n, ends[gone:]]).tolist()
            return frame

        for pdf in batches:
            for i in range(0, len(pdf), 256):
                some = pdf.iloc[i : i + 256]
                ids, counts = encoder(path).encode(some.text.tolist())
                held_ids.append(ids)
                held_docs += [None if x else int(d) for d, x in zip(some.doc_id, some.doc_id.isna())]
                held_counts += counts.tolist()
                if sum(map(len, held_ids)) >= block * lanes:
                    yield flush(False)
        if held_docs:
            yield flush(True)

    return run


def write(docs: DataFrame, path: str, out: str, block: int = BLOCK, lanes: int = LANES) -> None:
    """Write the ids of `docs` (doc_id, text), an end id after each, as a Parquet table of blocks at `out`.

    The texts are dealt by ranges of doc_id (NULL last, ties by hash of the text) and sorted, and each task encodes its
    range as it reads it, in blocks that don't depend on each other; a long document spans several. Written by Spark,
    so tasks that are run again leave nothing behind.
    """
    rows = short_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    parts = parts_for(docs.sparkSession, rows.count(), PART_DOCS)
    dealt = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    dealt.mapInPandas(_encode_part(path, block, lanes), FILE_KIND).write.parquet(out)


def _decode(lanes: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Pieces of documents within a block, with the CRC of their ids."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in range(0, len(pdf), lanes):
                some = pdf.iloc[i : i + lanes]
                counts = [np.asarray(x, np.int64) for x in some.doc_tokens]
                crcs = []
                for ids, sizes in zip(decode_blocks(some.payload.tolist()), counts):
                    raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(sizes)
                    if ends[-1] != len(ids):
                        raise ValueError("a block's documents don't add up to its ids")
                    crcs += [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), sizes.tolist())]
                lengths = [len(x) for x in counts]
                of = np.repeat(np.arange(len(some)), lengths)
                seq = np.arange(len(of)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                yield pd.DataFrame(
                    {
                        "part": some.part.to_numpy()[of],
                        "block": some.block.to_numpy()[of],
                        "seq": seq,
                        "continued": some.continued.to_numpy()[of] & (seq == 0),
                        "doc_id": pd.array([d for x in some.doc_ids for d in x], "Int64"),
                        "n": np.concatenate(counts),
                        "crc": crcs,
                    }
                )

    return run


def _crc_steps() -> list[np.ndarray]:
    """For k from 0: what 2 ** k zero bytes make of each bit of a CRC-32."""
    bit = np.array([0xEDB88320] + [1 << i for i in range(31)], np.uint64)

    def square(m: np.ndarray) -> np.ndarray:
        return np.array([_apply(m, int(x)) for x in m], np.uint64)

    one = square(square(square(bit)))  # eight bits
    steps = [one]
    for _ in range(40):
        steps.append(square(steps[-1]))
    return steps


def _apply(m: np.ndarray, crc: int) -> int:
    found = 0
    for i in range(32):
        if crc >> i & 1:
            found ^= int(m[i])
    return found


def join_crc(first: int, second: int, n_bytes: int, steps: list[np.ndarray] | None = None) -> int:
    """CRC-32 of two byte strings in turn from their CRCs and the length of the second."""
    steps = _STEPS if steps is None else steps
    k = 0
    while n_bytes:
        if n_bytes & 1:
            first = _apply(steps[k], first)
        n_bytes >>= 1
        k += 1
    return first ^ second


_STEPS = _crc_steps()


def _fold(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Whole documents from the pieces of a file part, which come in order."""
    held = None  # part, tokens before, doc_id, n, crc
    part, total = None, 0
    for pdf in batches:
        out = []
        for p, continued, doc, n, crc in zip(pdf.part.tolist(), pdf.continued.tolist(), pdf.doc_id.tolist(), pdf.n.tolist(), pdf.crc.tolist()):
            if p != part:
                part, total = p, 0
            if continued:
                held = (*held[:3], held[3] + n, join_crc(held[4], crc, 4 * n))
            else:
                if held:
                    out.append(held)
                held = (p, total, doc, n, crc)
            total += n
        if out:
            yield _documents(out)
    if held:
        yield _documents([held])


def _documents(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["part", "before", "doc_id", "n_tokens", "ids_crc32"])
    return frame.assign(doc_id=frame.doc_id.astype("Int64"))


def read_documents(spark: SparkSession, out: str, lanes: int = LANES) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens and ids_crc32 of every document, decoded from the files."""
    kind = "part int, block int, seq int, continued boolean, doc_id bigint, n bigint, crc bigint"
    pieces = spark.read.schema(FILE_KIND).parquet(out).mapInPandas(_decode(lanes), kind)
    ordered = pieces.repartition("part").sortWithinPartitions("part", "block", "seq")
    docs = ordered.mapInPandas(_fold, "part int, before bigint, doc_id bigint, n_tokens bigint, ids_crc32 bigint")
    sizes = spark.read.schema(FILE_KIND).parquet(out).groupBy("part").agg(
        F.sum(F.aggregate("doc_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")
    )
    before = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part")) - F.col("n")
    joined = attach_small(docs, sizes.select("part", before.alias("offset")), ["part"], "inner")
    return joined.select("doc_id", (F.col("offset") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
