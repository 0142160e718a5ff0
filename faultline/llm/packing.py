"""Packing token sequences: first-fit decreasing with a tournament tree, in randomised groups of pieces."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from faultline.llm.common import parts_for, short_batches
from faultline.llm.tokens import encoder
from faultline.session import cut

SEQUENCE = 2048
#: Pieces packed together on average; a task's memory depends on it alone.
GROUP_PIECES = 8192
SEED = 10


def cut_pieces(path: str, sequence: int) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Whole sequences of each document from its start, and the rest as a shorter piece."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), 256):
                part = pdf.iloc[at : at + 256]
                ids, counts = encoder(path).encode(part.text.tolist())
                raw, ends = memoryview(ids.astype("<u4").tobytes()), np.cumsum(counts)
                pieces = -(-counts // sequence)
                of = np.repeat(np.arange(len(part)), pieces)
                start = (np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * sequence
                length = np.minimum(counts[of] - start, sequence)
                first = (ends - counts)[of] + start
                crc = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(first.tolist(), length.tolist())]
                out = {"doc_id": part.doc_id.array[of], "start": start, "length": length, "ids_crc32": crc, "doc_tokens": counts[of]}
                yield pd.DataFrame(out)

    return run


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each item: longest first, each into the first bin that has room.

    The bins are leaves of a tournament tree in which each node keeps the most room below it, so the first
    bin with enough room is found by going down once.
    """
    n = len(lengths)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for item in np.argsort(-lengths, kind="stable").tolist():
        need, node = int(lengths[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item], offsets[item] = node - leaves, capacity - room[node]
        room[node] -= need
        while node > 1:
            node //= 2
            most = max(room[2 * node], room[2 * node + 1])
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def _pack_group(sequence: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "row"], ascending=[False, True, True, True])
        bins, offsets = first_fit_decreasing(pdf.length.to_numpy(), sequence)
        return pdf.assign(sequence_id=(pdf.grp.to_numpy() << 32) + bins, offset=offsets).drop(columns=["grp", "row"])

    return run


def pack(docs: DataFrame, path: str, sequence: int = SEQUENCE, group_pieces: int = GROUP_PIECES, seed: int = SEED) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Documents are cut where a sequence is full, so only their ends, shorter than a sequence, are packed with others.
    Pieces go to groups by a seeded hash of their row, whatever their document, so no group grows with the input or
    with a long document; token ids never move. NULL text: only the end id. Repeated rows are packed one by one.
    """
    spark = docs.sparkSession
    rows = short_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").alias("text"))
    kind = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    pieces = cut(rows.mapInPandas(cut_pieces(path, sequence), kind).withColumn("row", F.monotonically_increasing_id()))
    n = pieces.count()
    groups = max(1, -(-n // group_pieces))
    number = F.pmod(F.xxhash64(F.lit(seed), "row"), F.lit(groups)).cast("bigint")
    dealt = pieces.withColumn("grp", number).repartition(min(groups, parts_for(spark, n, group_pieces)), "grp")
    return dealt.groupBy("grp").applyInPandas(_pack_group(sequence), f"{kind}, sequence_id bigint, offset bigint")
