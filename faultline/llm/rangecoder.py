"""Adaptive context-mixing range coder for token ids, run in step over many independent blocks.

A block codes each id as one of 19 symbols: "as order 2 predicts", "as order 1 predicts", or the number of bits of
the id, whose remaining bits follow as they are. Three adaptive distributions of the symbols are mixed: order 0, order
1 (by how sure the prediction from one id before is, and what came last) and order 2 (by how sure both predictions
are); each weighs by how much probability it gave to the symbols so far. All state starts anew in each block, so blocks
can be read alone, and numpy carries one lane for each block of a batch. Integer arithmetic throughout.

Block: magic (4 bytes), ids (uint32), CRC-32 of the words (uint32), then words of 32 bits, low byte first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

MAGIC = b"FLR1"
HEADER = struct.Struct("<4sII")
SYMBOLS = 19
SLOTS1, SLOTS2 = 512, 1024
U = np.uint64
LOW32, TOP = U(0xFFFFFFFF), U(32)


class _Model:
    """Predictions and distributions of every lane."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.ids = [np.zeros(lanes * n, np.int32) for n in (SLOTS1, SLOTS2)]
        self.sure = [np.zeros(lanes * n, np.int8) for n in (SLOTS1, SLOTS2)]
        self.rows = [np.full((lanes * n, SYMBOLS), 4096 // SYMBOLS, np.uint16) for n in (1, 9, 32)]
        self.score = [np.full(lanes, 1024, np.int32) for _ in range(3)]
        self.last = np.zeros(lanes, np.int64)  # 0 order 2, 1 order 1, 2 other
        self.before = [np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)]

    def look(self) -> np.ndarray:
        """Cumulated mixed frequencies (lane x 20) for the next id."""
        a, b = self.before
        self.slot = [
            self.lane * SLOTS1 + ((a * 0x9E3779B1) >> 7) % SLOTS1,
            self.lane * SLOTS2 + (((a * 0x9E3779B1) ^ (b * 0x85EBCA77)) >> 7) % SLOTS2,
        ]
        self.guess = [self.ids[k][self.slot[k]] for k in (0, 1)]
        sure = [self.sure[k][self.slot[k]].astype(np.int64) for k in (0, 1)]
        same = self.guess[0] == self.guess[1]
        self.at = [
            self.lane,
            self.lane * 9 + np.minimum(sure[0], 2) * 3 + self.last,
            self.lane * 32 + sure[1] * 8 + sure[0] * 2 + same,
        ]
        self.seen = [rows[at] for rows, at in zip(self.rows, self.at)]
        total = self.score[0] + self.score[1] + self.score[2] + 1
        w1, w2 = (self.score[1] * 8) // total, (self.score[2] * 8) // total
        w0 = 8 - w1 - w2
        mixed = self.seen[0] * w0.astype(np.uint16)[:, None]  # weights add up to 8, so sums stay below 2 ** 16
        mixed += self.seen[1] * w1.astype(np.uint16)[:, None]
        mixed += self.seen[2] * w2.astype(np.uint16)[:, None]
        mixed >>= 2
        mixed += 1
        cum = np.zeros((len(self.lane), SYMBOLS + 1), np.uint16)
        np.cumsum(mixed, axis=1, out=cum[:, 1:], dtype=np.uint16)
        return cum

    def learn(self, symbol: np.ndarray, ids: np.ndarray) -> None:
        for k in range(3):
            row = self.seen[k]
            given = row[self.lane, symbol].astype(np.int32)
            self.score[k] += given - (self.score[k] >> 4)
            row -= row >> 4
            row[self.lane, symbol] += 256
            self.rows[k][self.at[k]] = row
        for k in (0, 1):
            slot, hit = self.slot[k], self.guess[k] == ids
            sure = self.sure[k][slot]
            self.sure[k][slot] = np.where(hit, np.minimum(sure + 1, 3), np.maximum(sure - 1, 0))
            replace = ~hit & (sure == 0)
            self.ids[k][slot] = np.where(replace, ids, self.guess[k])
        self.last = np.minimum(symbol, 2)
        self.before = [ids.astype(np.int64), self.before[0]]


def _bits(ids: np.ndarray) -> np.ndarray:
    """Bits of each id: 0 for 0, at most 17 would not fit the symbols."""
    return np.frexp(ids.astype(np.float64))[1].astype(np.int64)


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block of ids (below 65,536) as bytes. All blocks advance together, one id at a time."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks])
    order = np.argsort(-sizes, kind="stable")  # lanes that end early are at the end
    n, steps = len(blocks), int(sizes.max())
    ids = np.zeros((steps, n), np.int32)
    for lane, k in enumerate(order.tolist()):
        ids[: sizes[k], lane] = blocks[k]
    if ids.max(initial=0) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    live = np.searchsorted(-sizes[order], -np.arange(steps), side="left")  # lanes longer than the step
    model = _Model(n)
    low, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    out, used = np.zeros((n, steps + 4), np.uint32), np.zeros(n, np.int64)
    lane = np.arange(n)
    for t in range(steps):
        now = ids[t]
        cum = model.look()
        bits = _bits(now)
        symbol = np.where(model.guess[1] == now, 0, np.where(model.guess[0] == now, 1, bits + 2))
        model.learn(symbol, now)
        cut = cum[lane, symbol]
        part = span // cum[:, -1].astype(U)
        new_low = low + part * cut.astype(U)
        new_span = part * (cum[lane, symbol + 1] - cut).astype(U)
        plain = np.where(symbol > 1, np.maximum(bits - 1, 0), 0)
        new_span >>= plain.astype(U)
        rest = np.where(symbol > 1, now & ((1 << plain) - 1), 0)
        new_low += new_span * rest.astype(U)
        k = live[t]
        low[:k], span[:k] = new_low[:k], new_span[:k]
        while True:
            settled = (low ^ (low + span)) >> TOP == 0
            short = ~settled & (span <= LOW32)
            move = np.flatnonzero((settled | short)[:k])
            if not len(move):
                break
            s = move[short[move]]
            span[s] = (U(0) - low[s]) & LOW32
            out[move, used[move]] = low[move] >> TOP
            used[move] += 1
            low[move] <<= TOP
            span[move] <<= TOP
    out[lane, used] = low >> TOP
    out[lane, used + 1] = low & LOW32
    made: list[bytes] = [b""] * n
    for x, k in enumerate(order.tolist()):
        body = out[x, : used[x] + 2].astype("<u4").tobytes() if sizes[k] else b""
        made[k] = HEADER.pack(MAGIC, int(sizes[k]), zlib.crc32(body)) + body
    return made


def decode_blocks(blocks: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block (uint32). A block that was changed or cut raises ValueError."""
    if not blocks:
        return []
    sizes, words = [], []
    for block in blocks:
        if len(block) < HEADER.size or len(block) % 4:
            raise ValueError("block is cut short")
        magic, size, crc = HEADER.unpack_from(block)
        if magic != MAGIC or zlib.crc32(block[HEADER.size :]) != crc:
            raise ValueError("block fails its checksum")
        sizes.append(size)
        words.append(np.frombuffer(block, "<u4", offset=HEADER.size))
    sizes = np.array(sizes)
    order = np.argsort(-sizes, kind="stable")
    n, steps = len(blocks), int(sizes.max())
    source = np.zeros((n, max(map(len, words)) + 4), np.uint32)
    for lane, k in enumerate(order.tolist()):
        source[lane, : len(words[k])] = words[k]
    live = np.searchsorted(-sizes[order], -np.arange(steps), side="left")
    model = _Model(n)
    low, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    code = (source[:, 0].astype(U) << TOP) | source[:, 1].astype(U)
    read = np.full(n, 2)
    ids = np.zeros((steps, n), np.int32)
    lane = np.arange(n)
    for t in range(steps):
        k = live[t]
        cum = model.look()
        part = span // cum[:, -1].astype(U)
        value = np.minimum((code - low) // part, (cum[:, -1] - 1).astype(U)).astype(np.uint16)
        symbol = np.count_nonzero(cum[:, 1:] <= value[:, None], axis=1)
        cut = cum[lane, symbol]
        new_low = low + part * cut.astype(U)
        new_span = part * (cum[lane, symbol + 1] - cut).astype(U)
        bits = symbol - 2
        plain = np.where(symbol > 1, np.maximum(bits - 1, 0), 0)
        new_span >>= plain.astype(U)
        rest = np.minimum((code - new_low) // new_span, (U(1) << plain.astype(U)) - U(1))
        new_low += new_span * rest
        literal = np.where(bits > 0, (1 << plain) + rest.astype(np.int64), 0)
        now = np.where(symbol == 0, model.guess[1], np.where(symbol == 1, model.guess[0], literal)).astype(np.int32)
        ids[t] = now
        model.learn(symbol, now)
        low[:k], span[:k] = new_low[:k], new_span[:k]
        while True:
            settled = (low ^ (low + span)) >> TOP == 0
            short = ~settled & (span <= LOW32)
            move = np.flatnonzero((settled | short)[:k])
            if not len(move):
                break
            s = move[short[move]]
            span[s] = (U(0) - low[s]) & LOW32
            code[move] = (code[move] << TOP) | source[move, read[move]]
            read[move] += 1
            low[move] <<= TOP
            span[move] <<= TOP
        span[k:] = LOW32  # lanes that have ended: anything but zero
        low[k:] = code[k:] = 0
    made: list[np.ndarray] = [np.zeros(0, np.uint32)] * n
    for x, k in enumerate(order.tolist()):
        made[k] = ids[: sizes[k], x].astype(np.uint32)
    return made
