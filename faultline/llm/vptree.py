"""Nearest neighbours by inner product: a vantage-point tree in each shard, pruned by the triangle inequality."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import FloatType

from faultline.session import cut

K = 20
#: Components of the vectors of one shard: a task holds about four times these as doubles.
SHARD_VALUES = 1 << 22
#: Rows a shard has at least before another one is opened for the sake of parallel work.
LEAST_ROWS = 2048
LEAF = 128
#: A branch is left out when its bound times this exceeds the distance to beat; 1 is exact.
FACTOR = 1.05
QUERY_ROWS = 1024
EPS = 1e-9
#: Error a matrix product may have, relative to the lengths.
ROUGH = 1e-12


class Tree:
    """Vantage-point tree over vectors, with inner products turned into distances.

    Each vector gets one more coordinate so that all have the same length; then the nearest by Euclidean distance is
    the one of largest inner product. A node splits its points at the median distance from one of them; a leaf knows
    the least and greatest distance of its points from every vantage point above it.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.ids, self.vectors, self.size = ids, vectors, leaf
        square = np.einsum("ij,ij->i", vectors, vectors)
        self.reach = float(square.max())
        self.points = np.c_[vectors, np.sqrt(np.maximum(self.reach - square, 0))]
        self.vantage: list[int] = []
        self.leaves: list[np.ndarray] = []
        self.shells: list[list[tuple[int, float, float]]] = []
        open_: list[tuple[np.ndarray, list]] = [(np.arange(len(ids)), [])]
        while open_:
            members, above = open_.pop()
            if len(members) <= leaf:
                self._leaf(members, above)
                continue
            far = self._distance(members, self.points[members[0]]).argmax()
            node, centre = len(self.vantage), members[far]
            d = self._distance(members, self.points[centre])
            inside = d < np.median(d)
            if not inside.any():
                inside = d <= np.median(d)
            if inside.all():  # points that can't be told apart
                self._leaf(members, above)
                continue
            self.vantage.append(int(centre))
            for side in (inside, ~inside):
                open_.append((members[side], [*above, (node, float(d[side].min()), float(d[side].max()))]))

    def _leaf(self, members: np.ndarray, above: list) -> None:
        """Points that can't be told apart may be many; they become several leaves, so that work on one stays small."""
        for i in range(0, len(members), self.size):
            self.leaves.append(members[i : i + self.size])
            self.shells.append(above)

    def _distance(self, members: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.points[members] - to) ** 2).sum(axis=1))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """Least possible distance (query x leaf)."""
        square = np.einsum("ij,ij->i", queries, queries)
        low = np.zeros((len(queries), len(self.leaves)))
        if not self.vantage:
            return low
        inner = queries @ self.vectors[self.vantage].T
        d = np.sqrt(np.maximum(square[:, None] + self.reach - 2 * inner, 0))
        for leaf, shells in enumerate(self.shells):
            for node, least, most in shells:
                np.maximum(low[:, leaf], np.maximum(least - d[:, node], d[:, node] - most), out=low[:, leaf])
        return low

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids (query x k) of the largest inner products, the query's own id left out; -inf where none."""
        low = self.bounds(queries)
        square = np.einsum("ij,ij->i", queries, queries)
        score, found = np.full((len(ids), k), -np.inf), np.full((len(ids), k), np.iinfo(np.int64).max)
        nearest = low.argmin(axis=1)
        # each query's nearest leaf sets the distance to beat; then every leaf takes the queries it may serve, at once
        turns = [(leaf, True) for leaf in np.unique(nearest)] + [(leaf, False) for leaf in low.mean(axis=0).argsort(kind="stable")]
        for leaf, first in turns:
            who = np.flatnonzero((nearest == leaf) == first)
            beat = np.sqrt(np.maximum(square[who] + self.reach - 2 * score[who, -1], 0))
            who = who[low[who, leaf] * factor <= beat + EPS]
            if not len(who):
                continue
            members = self.leaves[leaf]
            rough = queries[who] @ self.vectors[members].T
            rough[ids[who][:, None] == self.ids[members][None, :]] = -np.inf
            slack = ROUGH * np.sqrt(square[who] * self.reach)
            q, m = np.nonzero((rough >= score[who, -1:] - slack[:, None]) & (rough > -np.inf))
            hit, q = np.unique(q, return_inverse=True)
            who = who[hit]
            # added up in one order everywhere, so that equal vectors have equal scores in all leaves and shards
            exact = np.einsum("ij,ij->i", queries[who[q]], self.vectors[members[m]])
            place = k + np.arange(len(q)) - np.searchsorted(q, np.arange(len(who)))[q]
            both = np.full((len(who), int(place.max(initial=k - 1)) + 1), -np.inf)
            names = np.full(both.shape, np.iinfo(np.int64).max)
            both[:, :k], names[:, :k] = score[who], found[who]
            both[q, place], names[q, place] = exact, self.ids[members[m]]
            order = np.lexsort((names, -both), axis=1)[:, :k]
            score[who] = np.take_along_axis(both, order, 1)
            found[who] = np.take_along_axis(names, order, 1)
        return score, found


def _search_shards(k: int, factor: float) -> Callable[[Iterable[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows sorted by shard, its vectors before the queries: build the tree, then run the queries in blocks."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, held, tree = None, [], None
        for pdf in batches:
            for (dim, number, kind), part in pdf.groupby(["dim", "shard", "kind"], sort=True):
                if (dim, number) != shard:
                    shard, held, tree = (dim, number), [], None
                if kind == 0:
                    held.append(part)
                    continue
                if not held and tree is None:
                    continue
                if tree is None:
                    whole = pd.concat(held)
                    tree, held = Tree(whole.vec_id.to_numpy(), np.stack(whole.v.to_numpy()).astype(np.float64)), []
                for i in range(0, len(part), QUERY_ROWS):
                    some = part.iloc[i : i + QUERY_ROWS]
                    ids = some.vec_id.to_numpy()
                    score, found = tree.search(ids, np.stack(some.v.to_numpy()).astype(np.float64), k, factor)
                    q, at = np.nonzero(score > -np.inf)
                    yield pd.DataFrame({"query_id": ids[q], "vec_id": found[q, at], "score": score[q, at]})

    return run


def usable(vector: Column) -> Column:
    """Vectors that are not NULL, not all zero, and have no NULL or non-finite component."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda x: x != 0)


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = K,
    factor: float = FACTOR,
    shard_rows: int | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest inner product, ties to the smaller id.

    Rows are dealt to shards of bounded size by hash of the id (`shard_rows`, else by `SHARD_VALUES`); every query visits
    every shard, a block at a time, and the shards' best are merged. Queries and candidates of different dimension don't meet. Rows without an id, and
    vectors that are not `usable`, take no part. Repeated rows of an id are found as often as they are there.
    """
    ok = F.coalesce(usable(F.col(vector_col)), F.lit(False)) & F.col(id_col).isNotNull()
    single = vectors.schema[vector_col].dataType.elementType == FloatType()  # moved as they are, half the bytes
    vector = F.col(vector_col) if single else F.col(vector_col).cast("array<double>")
    rows = vectors.where(ok).select(
        F.col(id_col).cast("bigint").alias("vec_id"), vector.alias("v"),
        F.size(vector_col).alias("dim"), F.coalesce(is_query, F.lit(False)).alias("is_query"),
    )
    n, width = rows.agg(F.count("*"), F.max("dim")).first()
    if shard_rows is None:
        parallel = -(-n // int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        shard_rows = max(1, min(SHARD_VALUES // (width or 1), max(LEAST_ROWS, parallel)))
    shards = max(1, -(-n // shard_rows))
    own = F.pmod(F.xxhash64(F.lit(3), "vec_id"), F.lit(shards)).cast("int").alias("shard")
    candidates = rows.select("dim", own, F.lit(0).alias("kind"), "vec_id", "v")
    visits = rows.where("is_query").select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(1).alias("kind"), "vec_id", "v"
    )
    dealt = candidates.unionByName(visits).repartitionByRange(shards, "dim", "shard")  # a hash leaves several to one task
    dealt = dealt.sortWithinPartitions("dim", "shard", "kind", "vec_id")
    found = cut(dealt.mapInPandas(_search_shards(k, factor), "query_id bigint, vec_id bigint, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
