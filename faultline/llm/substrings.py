"""Exact substring de-duplication: sampled suffixes of the corpus, sorted deep-shallow.

Every string of `LENGTH` bytes has one anchor, the place of the least hash among its substrings of `GRAM` bytes. Equal
strings have equal anchors at equal offsets, so only strings around equal anchors need comparing, and neighbouring strings
with one anchor are handled as one segment:
1. Segments are keyed by the hash of the anchor and of all their bytes. All but the first of equal segments are repeats.
2. First segments that share an anchor but not all bytes are compared byte by byte: the suffixes that start at the
   anchors, and the reversed prefixes before them, are sorted by multikey quicksort to a shallow depth, and the groups
   that still agree by blind tries. Strings are equal where both sides agree long enough.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from faultline.llm.common import parts_for, short_batches
from faultline.session import cut

LENGTH = 100
GRAM = 32
STARTS = LENGTH - GRAM + 1
#: Bytes hashed at once; longer texts go in overlapping pieces.
PIECE = 1 << 20
#: Bytes on one side of an anchor that, with it, a string is sure to hold.
SIDE = (LENGTH - GRAM) // 2
SHALLOW = 32
SEGMENT_ROWS = 400_000
CONTEXT_ROWS = 100_000
U = np.uint64


# --- anchors ---------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(29))
    x = x * U(0xBF58476D1CE4E5B9)
    return x ^ (x >> U(32))


class _Roller:
    """Hashes of any substring from one running sum, modulo 2 ** 64."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self):
        self.values = np.random.default_rng(6).integers(1, 1 << 63, 256, dtype=U)
        self.up = self.down = np.ones(1, U)

    def prepare(self, n: int) -> None:
        if n > len(self.up):
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                steps = np.full(n, base, U)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=U))

    def sums(self, data: np.ndarray) -> np.ndarray:
        self.prepare(len(data) + 1)
        return np.r_[U(0), np.cumsum(self.values[data] * self.up[: len(data)], dtype=U)]

    def of(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (sums[end] - sums[start]) * self.down[start]


_ROLLER = _Roller()


def segments(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> dict[str, np.ndarray]:
    """Segments of joined texts [start, end): piece, lo and hi (first and last string), anchor, h and c (hashes)."""
    found = {k: np.zeros(0, np.int64) for k in ("piece", "lo", "hi", "anchor")} | {k: np.zeros(0, U) for k in "hc"}
    room = np.maximum(ends - starts - LENGTH + 1, 0)
    if not room.sum():
        return found
    sums = _ROLLER.sums(data)
    grams = _mix((sums[GRAM:] - sums[:-GRAM]) * _ROLLER.down[: len(data) - GRAM + 1])
    least = (grams & U(0xFFFFFFFFFF000000)) | np.arange(len(grams), dtype=U)  # ties: the leftmost
    width = 1
    while 2 * width <= STARTS:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < STARTS:
        least = np.minimum(least[: len(least) - (STARTS - width)], least[STARTS - width :])
    piece = np.repeat(np.arange(len(starts)), room)
    at = np.repeat(starts - np.cumsum(room) + room, room) + np.arange(room.sum())
    anchor = (least[at] & U(0xFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(at)] - 1
    lo, hi, a = at[first], at[last], anchor[first]
    shape = (a - lo).astype(U) * U(0x94D049BB133111EB) + (hi - lo).astype(U) * U(0xD6E8FEB86659FD93)
    return {"piece": piece[first], "lo": lo, "hi": hi, "anchor": a, "h": grams[a], "c": _mix(_ROLLER.of(sums, lo, hi + LENGTH) + shape)}


def _batches(rows: Iterable[tuple[int, bytes]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to about `PIECE` bytes; a longer one in pieces that overlap by a string less one byte."""
    names: list[tuple[int, int]] = []
    parts: list[bytes] = []
    size = 0

    def joined():
        lengths = np.array([len(p) for p in parts])
        ends = np.cumsum(lengths)
        return names, np.frombuffer(b"".join(parts), np.uint8), ends - lengths, ends

    for n, raw in rows:
        for s in range(0, max(1, len(raw) - LENGTH + 1), PIECE):
            some = raw[s : s + PIECE + LENGTH - 1]
            if size and size + len(some) > 2 * PIECE:
                yield joined()
                names, parts, size = [], [], 0
            names.append((n, s))
            parts.append(some)
            size += len(some)
    if parts:
        yield joined()


def _anchored(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Segments of the texts; of equal ones within a batch only the first goes on to the shuffle, others are `again`."""
    rows = ((n, (t or "").encode("utf-8", "replace")) for pdf in batches for n, t in zip(pdf.n.tolist(), pdf.text))
    for names, data, starts, ends in _batches(rows):
        s = segments(data, starts, ends)
        if not len(s["lo"]):
            continue
        who, base = (np.array(x, np.int64) for x in zip(*names))
        n = who[s["piece"]]
        place = base[s["piece"]] + s["lo"] - starts[s["piece"]]
        packed = (place << 16) | ((s["anchor"] - s["lo"]) << 8) | (s["hi"] - s["lo"])
        h, c = s["h"].view(np.int64), s["c"].view(np.int64)
        order = np.lexsort((packed, n, c, h))
        same = np.r_[False, (h[order][1:] == h[order][:-1]) & (c[order][1:] == c[order][:-1])]
        h, c, n, packed = h[order], c[order], n[order], packed[order]
        spread = _mix(n.astype(U) * U(0x9E3779B97F4A7C15) + packed.astype(U)).view(np.int64)  # nothing to compare: dealt out evenly
        yield pd.DataFrame({"h": np.where(same, spread, h), "c": c, "n": n, "packed": packed, "again": same})


def _compared(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """From rows sorted by h, c, n, packed: repeats of a segment (kind 0), and first segments of an anchor that has
    several (kind 1). Holds one row between batches, whatever the size of a group."""
    last_h = last_c = None
    pending: tuple[int, int, int] | None = None
    for pdf in batches:
        known = pdf.again.to_numpy()
        if known.any():
            yield pdf.loc[known, ["h", "n", "packed"]].assign(kind=0)[["kind", "h", "n", "packed"]]
            pdf = pdf[~known]
        if not len(pdf):
            continue
        h, c, n, packed = (pdf[x].to_numpy() for x in ("h", "c", "n", "packed"))
        new_h = np.r_[last_h is None or h[0] != last_h, h[1:] != h[:-1]]
        new = new_h | np.r_[last_c is None or c[0] != last_c, c[1:] != c[:-1]]
        first = np.flatnonzero(new)
        shared = ~new_h[first]
        many = shared | np.r_[shared[1:], False]
        kinds, rows = [np.zeros((~new).sum(), np.int64), np.ones(many.sum(), np.int64)], [np.flatnonzero(~new), first[many]]
        at = np.concatenate(rows)
        frame = pd.DataFrame({"kind": np.concatenate(kinds), "h": h[at], "n": n[at], "packed": packed[at]})
        if pending and len(first):
            if shared[0]:
                frame = pd.concat([frame, pd.DataFrame([(1, *pending)], columns=frame.columns)])
            pending = None
        if len(first) and not many[-1]:
            pending = (int(h[first[-1]]), int(n[first[-1]]), int(packed[first[-1]]))
        last_h, last_c = h[-1], c[-1]
        yield frame


# --- deep-shallow sorting --------------------------------------------------------------------


def _words(strings: list[bytes], depth: int) -> np.ndarray:
    """Strings as rows of big-endian 8-byte words, cut or filled up with zeros."""
    wide = -(-depth // 8) * 8
    flat = np.frombuffer(b"".join(s[:depth].ljust(wide, b"\0") for s in strings), ">u8")
    return flat.reshape(len(strings), wide // 8).astype(U)


def blind_trie(strings: list[bytes], members: list[int], depth: int) -> tuple[list[int], list[int]]:
    """Order of `members` and the length of what each shares with the one before, by a trie that keeps only the places
    where strings part.

    A string goes down blindly by the bytes at those places to some leaf; one comparison with that leaf shows where it
    really parts, and it is hung in there.
    """
    root: list = [depth, members[0]]  # leaf: [depth, member, ...equal ones]; inner node: [place, {byte: node}]
    for m in members[1:]:
        s, node = strings[m], root
        while isinstance(node[1], dict):
            at = s[node[0]] if node[0] < len(s) else -1
            node = node[1].get(at) or next(iter(node[1].values()))
        t = strings[node[1]]
        part = _shared(s, t, depth)
        if part >= depth or (part == len(s) == len(t)):
            node.append(m)
            continue
        parent, key, node = None, None, root
        while node[0] < part and isinstance(node[1], dict):
            parent, key = node, (s[node[0]] if node[0] < len(s) else -1)
            node = node[1][key]
        mine = s[part] if part < len(s) else -1
        if isinstance(node[1], dict) and node[0] == part:
            node[1][mine] = [depth, m]
            continue
        split = [part, {mine: [depth, m], (t[part] if part < len(t) else -1): node}]
        if parent is None:
            root = split
        else:
            parent[1][key] = split
    order: list[int] = []
    shared: list[int] = []
    open_: list[tuple[list, int]] = [(root, 0)]
    while open_:
        node, above = open_.pop()
        if isinstance(node[1], dict):
            children = sorted(node[1].items(), reverse=True)
            open_ += [(child, node[0] if k < len(children) - 1 else above) for k, (_, child) in enumerate(children)]
        else:
            order += node[1:]
            shared += [above] + [depth] * (len(node) - 2)
    return order, shared


def _shared(a: bytes, b: bytes, depth: int) -> int:
    """Bytes that two strings have in common from the start."""
    a, b = a[:depth], b[:depth]
    if a == b:
        return len(a)
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def deep_shallow(strings: list[bytes], depth: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of the strings up to `depth` bytes, and what each shares with the one before it.

    Shallow: multikey quicksort, eight bytes at a time as one key, each pass within the groups that agree so far.
    Deep: what agrees on `shallow` bytes is ordered by a blind trie, group by group.
    """
    n = len(strings)
    order, shared = np.arange(n), np.zeros(n, np.int64)
    if not n:
        return order, shared
    shallow = min(shallow, depth) // 8 * 8
    words = _words(strings, shallow) if shallow else np.zeros((n, 0), U)
    group = np.zeros(n, np.int64)
    for k in range(words.shape[1]):
        own = words[order, k]
        step = np.lexsort((own, group))
        order, own = order[step], own[step]
        differs = np.flatnonzero((group[1:] == group[:-1]) & (own[1:] != own[:-1])) + 1
        odd = own[differs] ^ own[differs - 1]
        shared[differs] = k * 8 + sum((odd < U(1 << (56 - 8 * i))).astype(np.int64) for i in range(7))
        new = np.zeros(n, np.int64)
        new[1:] = group[1:] != group[:-1]
        new[differs] = 1
        group = np.cumsum(new)
    bounds = np.r_[np.flatnonzero(np.r_[True, group[1:] != group[:-1]]), n]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a > 1:
            members, inside = blind_trie(strings, order[a:b].tolist(), depth)
            order[a:b] = members
            shared[a + 1 : b] = inside[1:]
    return order, shared


def _classes(order: np.ndarray, shared: np.ndarray, depth: int) -> np.ndarray:
    """Number of the group of strings that agree on `depth` bytes, per string."""
    found = np.empty(len(order), np.int64)
    found[order] = np.cumsum(shared < depth)
    return found


def repeats(rows: pd.DataFrame) -> pd.DataFrame:
    """Of context rows (n, lo, hi, anchor, bytes from lo to hi + LENGTH): runs of strings (n, lo, hi) that an earlier
    row has too. Strings are equal if they agree before and from the anchor on."""
    n, lo, hi, anchor = (rows[x].to_numpy() for x in ("n", "lo", "hi", "anchor"))
    left = [b[: a - s][::-1] for b, a, s in zip(rows.bytes, anchor, lo)]
    right = [b[a - s :] for b, a, s in zip(rows.bytes, anchor, lo)]
    left_sorted, right_sorted = deep_shallow(left, STARTS - 1), deep_shallow(right, LENGTH)
    earlier = np.lexsort((lo, n))
    rank = np.empty(len(n), np.int64)
    rank[earlier] = np.arange(len(n))
    out = []
    for offset in range(STARTS):
        here = np.flatnonzero((anchor - hi <= offset) & (offset <= anchor - lo))
        if len(here) < 2:
            continue
        a, b = _classes(*left_sorted, offset)[here], _classes(*right_sorted, LENGTH - offset)[here]
        by = np.lexsort((rank[here], b, a))
        same = np.r_[False, (a[by][1:] == a[by][:-1]) & (b[by][1:] == b[by][:-1])]
        again = here[by[same]]
        out.append(pd.DataFrame({"n": n[again], "lo": anchor[again] - offset}))
    found = pd.concat(out) if out else pd.DataFrame({"n": n[:0], "lo": lo[:0]})
    found = found.sort_values(["n", "lo"])
    who, at = found.n.to_numpy(), found.lo.to_numpy()
    if not len(who):
        return pd.DataFrame({"n": who, "lo": at, "hi": at})
    first = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (at[1:] > at[:-1] + 1)])
    return pd.DataFrame({"n": who[first], "lo": at[first], "hi": at[np.r_[first[1:], len(at)] - 1]})


# --- the whole job ---------------------------------------------------------------------------


def _contexts(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Bytes around the contested anchors of each text. A string holds at least `SIDE` bytes before or after its anchor;
    by these, and the anchor, each half of a segment is keyed, so that a common anchor doesn't make a large group."""
    for pdf in batches:
        out = []
        for n, text, packed in zip(pdf.n.tolist(), pdf.text, pdf.contested):
            raw = (text or "").encode("utf-8", "replace")
            for x in packed.tolist():
                lo, before, more = x >> 16, (x >> 8) & 255, x & 255
                a, hi = lo + before, lo + more
                if before >= SIDE:
                    end = min(hi, a - SIDE)
                    out.append((n, lo, end, a, hashlib.blake2b(raw[a - SIDE : a + GRAM], digest_size=8).digest(), raw[lo : end + LENGTH]))
                if hi > a - SIDE:
                    start = max(lo, a - SIDE + 1)
                    out.append((n, start, hi, a, hashlib.blake2b(raw[a : a + GRAM + SIDE], digest_size=8).digest(), raw[start : hi + LENGTH]))
        yield pd.DataFrame(out, columns=["n", "lo", "hi", "anchor", "key", "bytes"])


def _repeats(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by key: whole groups, some `CONTEXT_ROWS` at a time; single rows have nothing to compare."""
    held: list[pd.DataFrame] = []
    size = 0

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        return repeats(part[part.key.duplicated(keep=False)].reset_index(drop=True))

    for pdf in batches:
        if not len(pdf):
            continue
        held.append(pdf)
        size += len(pdf)
        if size >= CONTEXT_ROWS:
            whole = pd.concat(held)
            open_ = (whole.key == whole.key.iloc[-1]).to_numpy()
            held, size = [whole[open_]], int(open_.sum())
            if not open_.all():
                yield solve(whole[~open_])
    if held:
        yield solve(pd.concat(held))


def remove(raw: bytes, runs: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left after the strings starting in `runs` are taken out, bytes removed, and maximal removed spans."""
    kept, at, removed, spans = [], 0, 0, 0
    end = -1
    for lo, hi in sorted(runs):
        if lo > end:
            kept.append(raw[at:lo])
            spans += 1
            end = lo
        new = max(end, hi + LENGTH)
        removed += new - end
        at = end = new
    kept.append(raw[at:])
    return b"".join(kept), removed, spans


def _removed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc, text, runs in zip(pdf.doc_id.tolist(), pdf.text, pdf.runs):
            raw = (text or "").encode("utf-8", "replace")
            left, removed, spans = remove(raw, [] if runs is None else [(r["lo"], r["hi"]) for r in runs])
            out.append((doc, len(raw), removed, spans, hashlib.sha256(left).hexdigest(), left))
        frame = pd.DataFrame(out, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])
        yield frame.assign(doc_id=frame.doc_id.astype("Int64"))


def numbered(docs: DataFrame) -> DataFrame:
    """(n, doc_id, text) with n unique and in the order of the documents: doc_id itself where that is unique, else a
    row number of a sorted copy (NULL last; rows of one id by hash of the text)."""
    rows = short_batches(docs).select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty():
        return rows.select(F.col("doc_id").alias("n"), "doc_id", "text")
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text")]
    return cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("n"), "doc_id", "text"))


def _run(lo: Column, hi: Column) -> Column:
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(n, lo, hi): runs of places of a text at which a string starts that also starts earlier in the corpus."""
    spark = rows.sparkSession
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = parts_for(spark, 2 * n_bytes // STARTS, SEGMENT_ROWS)
    found = rows.select("n", "text").mapInPandas(_anchored, "h bigint, c bigint, n bigint, packed bigint, again boolean")
    ordered = found.repartition(parts, "h").sortWithinPartitions("h", "c", "n", "packed")
    table = cut(ordered.mapInPandas(_compared, "kind int, h bigint, n bigint, packed bigint"))
    lo = F.shiftright("packed", 16)
    sure = table.where("kind = 0").select("n", lo.alias("lo"), (lo + F.col("packed").bitwiseAND(F.lit(255))).alias("hi"))
    contested = table.where("kind = 1")
    parts = parts_for(spark, contested.count(), CONTEXT_ROWS)
    of = contested.groupBy("n").agg(F.collect_list("packed").alias("contested"))
    texts = rows.select("n", "text").join(of, "n").select("n", "text", "contested")
    near = texts.mapInPandas(_contexts, "n bigint, lo bigint, hi bigint, anchor bigint, key binary, bytes binary")
    dealt = near.repartition(parts, "key").sortWithinPartitions("key", "n", "lo")
    return sure.unionByName(cut(dealt.mapInPandas(_repeats, "n bigint, lo bigint, hi bigint")))


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (bytes) of each document.

    A byte goes if a string of 100 bytes that covers it starts earlier too, in a document of smaller doc_id or at an
    earlier place of the same one. NULL text is empty. An empty table gives no rows.
    """
    rows = numbered(docs)
    runs = repeated_runs(rows).groupBy("n").agg(F.collect_list(_run(F.col("lo"), F.col("hi"))).alias("runs"))
    joined = rows.join(runs, "n", "left").select("doc_id", "text", "runs")
    kind = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary"
    return joined.mapInPandas(_removed, kind)
