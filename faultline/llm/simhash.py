"""SimHash near-duplicates: fingerprints, bit-sliced comparison within blocks, connected components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

from faultline.llm.common import attach_small, bounded, components, large, roots, short_batches, unite
from faultline.session import cut

RADIUS = 2
SEED = 42
#: A block with more fingerprints is split by further matching bits.
BLOCK_ROWS = 1000
PAIRS = ((0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3))
UNITS = 1 << 19
ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Near copies of the pipeline: words of a run, and the least Jaccard similarity as a fraction.
COPY_SHINGLE = 5
COPY_OF = (4, 5)
#: Runs of words that so many of about so many sampled documents have come last in the order of all sets (at most so
#: many of them). This decides on the work only, not on the result.
SAMPLE_OFTEN = 4
SAMPLE_DOCS = 5_000
SAMPLE_KEPT = 200_000
#: Members from which a list has pivots, random orders that give them, and size classes for a factor of e.
LONG_LIST, PIVOTS, SIZE_CLASSES = 32, 4, 8
#: Pairs that each component may have compared in the first turns, on either side.
TURNS = (4, 32)


# --- fingerprints ----------------------------------------------------------------------------


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of a text: a bit is set if it is in over half of the shingle hashes; 0 without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()  # of bytes: A-Z and ASCII white space only
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    hashes = np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), "<u8", n)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    return int(np.packbits(2 * bits.sum(axis=0, dtype=np.int64) > n, bitorder="little").view("<u8")[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series(np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64))


def hex_digits(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# --- bit-sliced comparison -------------------------------------------------------------------


def bit_planes(values: np.ndarray) -> np.ndarray:
    """Plane b, word w, lane l holds bit b of value 64 * w + l; missing lanes are 0."""
    words = -(-len(values) // 64)
    padded = np.zeros(words * 64, np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # value x bit
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64)


def close_lanes(planes: np.ndarray, query: np.ndarray, word: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units whose word has lanes within two bits of the unit's query value, and those lanes as a mask.

    A unit compares one value with the 64 lanes of one word. Differing bits are added up by a two-bit
    carry-save counter per lane plus an overflow mark; a unit is abandoned once all its valid lanes overflowed.
    """
    unit = np.arange(len(query))
    ones = np.zeros(len(query), np.uint64)
    twos, over = ones.copy(), ~valid
    for b in range(64):
        spread = np.uint64(0) - ((query >> np.uint64(b)) & np.uint64(1))
        differs = planes[b][word] ^ spread
        carry = ones & differs
        ones ^= differs
        twos |= carry
        over |= twos & ones  # three differences
        if b % 8 == 7:
            open_ = np.flatnonzero(over != ALL)
            if len(open_) < len(unit):
                unit, query, word = unit[open_], query[open_], word[open_]
                ones, twos, over = ones[open_], twos[open_], over[open_]
                if not len(unit):
                    break
    return unit, ~over


def linked_in_blocks(values: np.ndarray, block: np.ndarray) -> np.ndarray:
    """For each value the index of the smallest-indexed value its chain of links reaches within its block.

    `block` is ascending; values of a block are distinct. All (value, word of 64 lanes) units of all blocks are
    compared together, a bounded number at a time.
    """
    n = len(values)
    starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
    sizes = np.diff(np.r_[starts, n])
    words = -(-sizes // 64)
    word0 = np.cumsum(words) - words
    slot = np.repeat(word0 * 64 - starts, sizes) + np.arange(n)  # blocks begin at a word
    lanes = np.zeros(words.sum() * 64, np.uint64)
    lanes[slot] = values
    planes = bit_planes(lanes)
    used = np.zeros(len(lanes), np.uint8)
    used[slot] = 1
    used = np.packbits(used, bitorder="little").view(np.uint64)
    owner = np.zeros(len(lanes), np.int64)
    owner[slot] = np.arange(n)
    of = np.repeat(np.arange(len(starts)), sizes)
    own = slot // 64 - word0[of]  # a value meets its own word and those before it: each pair once
    counts = own + 1
    root = roots(n)
    ends = np.cumsum(counts)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + UNITS)))
        who = np.repeat(np.arange(at, to), counts[at:to])
        word = np.arange(len(who)) - np.repeat(ends[at:to] - counts[at:to] - (ends[at - 1] if at else 0), counts[at:to])
        word += word0[of[who]]
        unit, mask = close_lanes(planes, values[who], word, used[word])
        bits = np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        u, lane = np.nonzero(bits)
        a, b = who[unit[u]], owner[word[unit[u]] * 64 + lane]
        less = b < a
        root = unite(root, a[less], b[less])
        at = to
    return root


def _links(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stars (u, v) of linked fingerprints from rows sorted by block; a block never exceeds its proven bound."""

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        change = (part.k1.to_numpy()[1:] != part.k1.to_numpy()[:-1]) | (part.k2.to_numpy()[1:] != part.k2.to_numpy()[:-1])
        block = np.r_[0, np.cumsum(change)]
        many = np.bincount(block)[block] > 1
        fp = part.fp.to_numpy()[many]
        if not len(fp):
            return pd.DataFrame({"u": fp, "v": fp})
        root = linked_in_blocks(fp.view(np.uint64), block[many])
        far = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"u": fp[far], "v": fp[root[far]]})

    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        k1, k2 = pdf.k1.to_numpy(), pdf.k2.to_numpy()
        last = int(np.flatnonzero((k1 != k1[-1]) | (k2 != k2[-1])).max(initial=-1)) + 1  # start of the open block
        closed = held and (held[-1].k1.iloc[-1], held[-1].k2.iloc[-1]) != (k1[0], k2[0])
        if last or closed:
            yield solve(pd.concat([*held, pdf.iloc[:last]]))
            held, pdf = [], pdf.iloc[last:]
        held.append(pdf)
    if held:
        yield solve(pd.concat(held))


# --- the whole job ---------------------------------------------------------------------------


def _parts(value: Column, width: int) -> list[Column]:
    mask = (1 << width) - 1
    return [F.shiftrightunsigned(value, i * width).bitwiseAND(F.lit(mask).cast("bigint")) for i in range(4)]


def _pair_keys(value: Column, width: int) -> Column:
    """Of four parts of a value, each pair as a key: values that differ in two bits agree in one of the six."""
    part = _parts(value, width)
    keys = [
        F.lit(n << (2 * width)).cast("bigint") + F.shiftleft(part[i], width) + part[j] for n, (i, j) in enumerate(PAIRS)
    ]
    return F.array(*keys)


def _rest(fp: Column, pair: Column) -> Column:
    """The 32 bits that a pair of 16-bit parts leaves open."""
    part = _parts(fp, 16)
    other = [(2, 3), (1, 3), (1, 2), (0, 3), (0, 2), (0, 1)]
    return F.get(F.array(*[F.shiftleft(part[i], 16) + part[j] for i, j in other]), pair)


def links(fps: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Links (u, v) that connect all distinct fingerprints `fp` within two bits, as stars.

    Fingerprints meet in blocks that share 32 of 64 bits, six keys each. A block with over `block_rows` members is
    split by six keys of 16 of the open 32 bits, after which 65,536 members is the most there can be.
    """
    keyed = fps.select("fp", F.explode(_pair_keys(F.col("fp"), 16)).alias("k1"))
    hot = cut(keyed.groupBy("k1").agg(F.count("*").alias("n")).where(F.col("n") > block_rows).select("k1", F.lit(1).alias("hot")))
    marked = attach_small(keyed, hot, ["k1"])
    pair = F.shiftright("k1", 32).cast("int")
    k2 = F.when(F.col("hot").isNull(), F.array(F.lit(-1).cast("bigint"))).otherwise(_pair_keys(_rest(F.col("fp"), pair), 8))
    blocks = marked.select("fp", "k1", F.explode(k2).alias("k2"))
    dealt = blocks.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "fp")
    return dealt.mapInPandas(_links, "u bigint, v bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp, fingerprint (hex) and component_id, the smallest id reachable over links of at most two bits.

    NULL or blank texts have fingerprint zero and are linked like any other. Repeated rows each give a row. A NULL
    id never names a component unless no other id is in it. An empty table gives no rows. Other columns are not read.
    """
    prints = cut(short_batches(docs).select(F.col(id_col).alias("doc_id"), _fingerprints(F.col(text_col)).alias("fp")))
    groups = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    reach = components(links(groups)).withColumnRenamed("node", "fp")
    owned = groups.join(reach, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    own = owned.groupBy("root").agg(F.min("least").alias("component_id"))
    of = cut(owned.select("fp", "root").join(own, "root").select("fp", "component_id"))
    joined = prints.join(of, "fp")  # hot fingerprints: the only repeated side, split by adaptive execution
    return joined.select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


# --- near copies by Jaccard similarity -------------------------------------------------------


def shingle_set(text: str | None, shingle: int = COPY_SHINGLE) -> np.ndarray:
    """Ascending distinct hashes of the runs of `shingle` words; a shorter text is one run; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.int64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(words)]
    return np.unique(np.fromiter(map(partial(xxhash.xxh64_intdigest, seed=SEED), runs), "<u8").view(np.int64))


@F.pandas_udf(StringType())
def _signatures(texts: pd.Series) -> pd.Series:
    """128 bits that are the same for equal sets."""
    return pd.Series([xxhash.xxh3_128_hexdigest(shingle_set(t).tobytes()) for t in texts], dtype=object)


@F.pandas_udf(ArrayType(LongType()))
def _shingle_sets(texts: pd.Series) -> pd.Series:
    return pd.Series([shingle_set(t) for t in texts], dtype=object)


def prefix(hs: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first members of a set, as many as one of them must be in any set of similarity 4/5 or more.

    All sets are in one order: by count in the sample (0 if not in `common`, which is ascending), then by hash.
    """
    n = len(hs)
    size = n - -(-COPY_OF[0] * n // COPY_OF[1]) + 1 if n else 0
    if len(common):
        at = np.minimum(np.searchsorted(common, hs), len(common) - 1)
        hs = hs[np.lexsort((hs, np.where(common[at] == hs, counts[at], 0)))]
    return hs[:size]


def prefixes(texts: DataFrame, common: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(rep, n, h) for texts (rep, text): the size of a text's set and each member of its prefix.

    Sets don't leave the Python worker, and one worker per task makes both: a worker that reads from another one would
    double the workers of each executor, which stay, with their memory, for the stages that follow.
    """

    @F.pandas_udf("n int, hs array<bigint>")
    def run(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t) for t in texts]
        return pd.DataFrame({"n": [len(x) for x in sets], "hs": [prefix(x, common, counts) for x in sets]})

    made = texts.select("rep", run("text").alias("made"))
    return made.select("rep", "made.n", F.explode("made.hs").alias("h"))


def _counted(pairs: DataFrame) -> DataFrame:
    """Of (a, n, b, m), a row for each list of both, the pairs (a, b, share) that can be near copies: what is shared outside
    the prefixes is at most the larger rest, so the prefixes must share what is missing. `share` is the part they do."""
    num, den = COPY_OF
    rest = F.greatest(*[F.ceil(F.col(x) * num / den) - 1 for x in ("n", "m")])
    enough = (F.col("c") + rest) * (num + den) >= num * (F.col("n") + F.col("m"))
    return cut(pairs.groupBy("a", "b", "n", "m").agg(F.count("*").alias("c")).where(enough).select("a", "b", (F.col("c") / (F.col("n") + F.col("m"))).alias("share")))


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (u, v) of the pairs (a, b) whose sets have a Jaccard similarity of 4/5 or more."""
    asked = pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    asked = cut(asked.withColumn("asked", F.lit(1)))
    sets = cut(attach_small(texts, asked, ["rep"], "inner").select("rep", _shingle_sets("text").alias("hs")))
    many = sets.count()
    one = bounded(sets.select(F.col("rep").alias("a"), F.col("hs").alias("ha")), many)
    two = bounded(sets.select(F.col("rep").alias("b"), F.col("hs").alias("hb")), many)
    num, den = COPY_OF
    both = F.size(F.array_intersect("ha", "hb"))
    close = both * (num + den) >= num * (F.size("ha") + F.size("hb"))
    return cut(bounded(pairs).join(one, "a").join(two, "b").where(close).select(F.col("a").alias("u"), F.col("b").alias("v")))


def _early_pairs(lists: DataFrame) -> DataFrame:
    """(a, n, b, m) for neighbours in each list (rep, root, n, h, many), by size, and in long lists for each member with
    the pivots: the members of its size class that come first in each of a few random orders. The orders are the same in
    all lists, so a group of near copies meets the same pivots in nearly all lists that it shares. Members of one root
    are linked already."""
    num, den = COPY_OF
    one = F.struct("n", "rep", "root")
    before = F.lag(one).over(Window.partitionBy("h").orderBy("n", "rep"))
    alike = Window.partitionBy("h", F.floor(F.log("n") * SIZE_CLASSES))
    firsts = [F.min(F.struct(F.xxhash64(F.lit(k), "rep").alias("order"), one.alias("one"))).over(alike)["one"] for k in range(PIVOTS)]
    short = lists.where(F.col("many") <= LONG_LIST).select(one.alias("x"), before.alias("y")).where("y IS NOT NULL")
    long = lists.where(F.col("many") > LONG_LIST).select(one.alias("x"), F.array_distinct(F.array_compact(F.array(before, *firsts))).alias("ys"))
    pairs = short.unionByName(long.select("x", F.explode("ys").alias("y")))
    pairs = pairs.where("x.root <> y.root").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    pairs = pairs.select(F.col("x.rep").alias("a"), F.col("x.n").alias("n"), F.col("y.rep").alias("b"), F.col("y.n").alias("m"))
    return pairs.where(F.col("n") * den >= F.col("m") * num)


def _linked_in_turns(pairs: DataFrame, found: DataFrame, texts: DataFrame) -> DataFrame:
    """`found` and links of `pairs`, as many as make the same components as the links of all of them.

    Of the pairs between components, each turn compares those of each component that share most, some for each side,
    and the last turn all that are left. So most members of a large group meet through few pairs.
    """
    for most in (*TURNS, None):
        if pairs.isEmpty():
            break
        known = cut(components(found))
        roots = attach_small(pairs, known.select(F.col("node").alias("a"), F.col("root").alias("of_a")), ["a"])
        roots = attach_small(roots, known.select(F.col("node").alias("b"), F.col("root").alias("of_b")), ["b"])
        roots = roots.select("a", "b", "share", F.coalesce("of_a", "a").alias("of_a"), F.coalesce("of_b", "b").alias("of_b"))
        pairs = cut(roots.where("of_a <> of_b"))
        if most is None:
            return found.unionByName(_confirmed(pairs, texts))
        part = F.pmod(F.xxhash64("a", "b"), F.lit(most)).alias("part")
        best = [pairs.groupBy(side, part).agg(F.max(F.struct("share", "a", "b")).alias("best")).select("best.*") for side in ("of_a", "of_b")]
        chosen = cut(best[0].unionByName(best[1]).distinct())
        found = found.unionByName(_confirmed(chosen, texts))
        pairs = pairs.join(bounded(chosen), ["a", "b"], "left_anti").select("a", "b", "share")
    return found


def print_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of the nodes (rep, fp; a node may have several fingerprints) that connect all whose fingerprints
    are within two bits."""
    nodes = cut(nodes.distinct())
    least = cut(nodes.groupBy("fp").agg(F.min("rep").alias("least")))
    many = least.count()
    same = nodes.join(bounded(least, many), "fp").select(F.col("rep").alias("a"), F.col("least").alias("b"))
    ends = [bounded(least.select(F.col("fp").alias(x), F.col("least").alias(y)), many) for x, y in ("ua", "vb")]
    near = links(least.select("fp")).join(ends[0], "u").join(ends[1], "v").select("a", "b")
    pairs = same.unionByName(near).where("a <> b")
    return cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def copy_groups(rows: DataFrame) -> DataFrame:
    """(row, doc_id, root) for rows (row, doc_id, sig, fp, text): root is the same for rows that chains of near copies link.

    Near copies have a Jaccard similarity of 4/5 or more over runs of five words. SimHashes `fp` within two bits propose
    the first pairs, which are compared exactly. Pairs as far apart as 15 bits were seen among near copies, so the groups
    are then completed by a join that compares texts of different groups only: candidates come from the prefixes of the
    sets (exact for any one order; runs that a sample of documents has often come last). Equal sets are one node.
    Neighbours in a prefix list are compared first, in long lists also each member and the pivots of its list; then pairs
    of a list that are not linked by then, in turns, until none is left. Texts without words are one group. Sets are
    larger than texts, so they are made from the text where needed and only those of candidates are written.
    """
    copied = rows.groupBy("sig").agg(F.min("row").alias("rep"), F.count("*").alias("times"))
    copied = cut(copied.where("times > 1").select("sig", "rep"))
    of = attach_small(rows.select("row", "doc_id", "sig", "fp"), copied, ["sig"])
    of = cut(of.select("row", "doc_id", "fp", F.coalesce("rep", "row").alias("rep")))
    more = of.where("row <> rep").select("row", F.lit(1).alias("more"))
    texts = attach_small(rows.select("row", "text"), more, ["row"]).where("more is null").select(F.col("row").alias("rep"), "text")
    if large(more):  # else each use would shuffle all texts
        texts = cut(texts)
    alike = _confirmed(print_pairs(of.select("rep", "fp")), texts)
    grouped = cut(components(alike))
    every = max(1, of.where("row = rep").count() // SAMPLE_DOCS)
    some = texts.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0)
    sample = some.select(F.explode(_shingle_sets("text")).alias("h"))
    often = sample.groupBy("h").count().where(F.col("count") >= SAMPLE_OFTEN).orderBy(F.desc("count"), "h").limit(SAMPLE_KEPT)
    often = often.toPandas().sort_values("h")
    lists = prefixes(texts, often.h.to_numpy(np.int64), often["count"].to_numpy(np.int64))
    lists = lists.withColumn("many", F.count("*").over(Window.partitionBy("h"))).where("many > 1")
    lists = lists.join(bounded(grouped), F.col("rep") == F.col("node"), "left")
    lists = cut(lists.select("rep", F.coalesce("root", "rep").alias("root"), "n", "h", "many"))
    num, den = COPY_OF
    first = alike.unionByName(_confirmed(_counted(_early_pairs(lists)), texts))
    known = components(first)
    named = lists.drop("root").join(bounded(known), F.col("rep") == F.col("node"), "left").select("rep", "n", "h", F.coalesce("root", "rep").alias("root"))
    both = [end("root").over(Window.partitionBy("h")) for end in (F.min, F.max)]
    named = cut(named.withColumn("open", both[0] != both[1]).where("open").drop("open"))
    other = named.select("h", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("root").alias("other"))
    fits = (F.col("rep") < F.col("b")) & (F.col("root") != F.col("other"))
    fits &= (F.col("m") * den >= F.col("n") * num) & (F.col("n") * den >= F.col("m") * num)
    rest = named.join(bounded(other, named.count()), (named.h == other.h) & fits).select(F.col("rep").alias("a"), "n", "b", "m")
    reach = components(_linked_in_turns(_counted(rest), first, texts))
    joined = of.join(bounded(reach), F.col("rep") == F.col("node"), "left")
    return joined.select("row", "doc_id", F.coalesce("root", "rep").alias("root"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: the one of smallest doc_id, NULL last, then the first in the table.

    Rows have a key of their own, so NULL and repeated ids count as the rows they are.
    """
    keyed = docs.withColumn("__row", F.monotonically_increasing_id())
    keyed = keyed.withColumns({"__sig": _signatures("text"), "__fp": _fingerprints("text")})
    table = cut(short_batches(keyed))
    of = copy_groups(table.select(F.col("__row").alias("row"), "doc_id", F.col("__sig").alias("sig"), F.col("__fp").alias("fp"), "text"))
    best = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row")).alias("best"))
    return table.join(best.select(F.col("best.row").alias("__row")), "__row", "left_semi").select(*docs.columns)
