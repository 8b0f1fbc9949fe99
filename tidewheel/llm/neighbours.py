"""Approximate nearest neighbours by collision-counting hashing with query-centred windows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import scratch, small_batches, tasks


@dataclass(frozen=True)
class SearchParams:
    k: int = 20
    #: Single projections, each a sorted array.
    projections: int = 96
    #: A vector is verified when it has collided in this share of the projections.
    threshold: float = 0.7
    #: Windows grow until k and so many more are verified, and a vector as near as the k-th best so far would be with this chance.
    more: int = 60
    catch: float = 0.86
    #: First half-width of a window, in standard deviations of the projections, and its growth.
    width: float = 0.9
    growth: float = 1.04
    #: Vectors of one shard, which are indexed together, and as few as a shard has only where there is one.
    shard: int = 32_768
    least: int = 16_384
    seed: int = 9


class CollisionIndex:
    """Sorted single projections of vectors of about one length. A query counts, window by growing window, in how many projections each
    vector lies within the window around the query's own; only what a growth adds is counted anew."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, p: SearchParams):
        self.vectors, self.ids, self.p = vectors, ids, p
        squares = (vectors**2).sum(1)
        self.length = float(np.sqrt(squares.max()))
        # One more coordinate brings all vectors to the same length, so that the largest inner product is the nearest.
        rest = np.sqrt(squares.max() - squares)
        self.axes = np.random.default_rng(p.seed).normal(size=(vectors.shape[1] + 1, p.projections))
        values = (np.column_stack([vectors, rest]) @ self.axes).T
        self.order = np.argsort(values, axis=1, kind="stable").astype(np.int32)
        self.values = np.take_along_axis(values, self.order, 1)
        self.spread = max(float(values.std(axis=1).mean()), 1e-9 * float(np.abs(values).max()), 1e-300)

    def _caught(self, half: float, squared: float) -> bool:
        """Whether windows of this half-width verify a vector at the root of this squared distance often enough.

        Its projections differ from the query's by a normal deviate of that distance; collisions are counted as one too."""
        p = self.p
        one = math.erf(half / math.sqrt(2 * squared)) if squared > 0 else 1.0
        if one >= 1:
            return True
        z = (p.projections * one - math.ceil(p.threshold * p.projections) + 0.5) / math.sqrt(p.projections * one * (1 - one))
        return 0.5 * (1 + math.erf(z / math.sqrt(2))) >= p.catch

    def _windows(self, at: np.ndarray, half: float, growth: float, steps: int = 16):
        """First and last places of the next windows in every projection: each array is searched once for all of them."""
        halves = []
        for _ in range(steps):
            halves.append(half)
            half *= growth
            growth *= 1.01
        halves = np.array(halves)
        a = np.array([v.searchsorted(x - halves) for v, x in zip(self.values, at)])
        z = np.array([v.searchsorted(x + halves, "right") for v, x in zip(self.values, at)])
        return zip(a.T, z.T)

    def top(self, query: np.ndarray, own: int, best: tuple[np.ndarray, np.ndarray], seen: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores): the k best of `best` and of what is verified here but the query's own, best first, ties to the smaller id.

        seen[0] grows by the number of verified vectors."""
        p, n = self.p, len(self.vectors)
        size = float(query @ query)
        if len(best[0]) >= p.k and best[1][-1] > self.length * math.sqrt(size) * (1 + 1e-9):
            return best  # no vector of this length can be as near
        at, least, enough = query @ self.axes[:-1], math.ceil(p.threshold * p.projections), min(n, p.k + p.more)
        counts, verified = np.zeros(n, np.int16), np.zeros(n, bool)
        half, growth, lo, hi, found = p.width * self.spread, p.growth, None, None, 0
        ahead = iter(())
        while True:
            if (edges := next(ahead, None)) is None:
                ahead = self._windows(at, half, growth)
                edges = next(ahead)
            a, z = edges
            if lo is None:
                new = [o[i:j] for o, i, j in zip(self.order, a, z)]
            else:
                new = [o[i:j] for o, i, j in zip(self.order, a, lo)] + [o[i:j] for o, i, j in zip(self.order, hi, z)]
            counts += np.bincount(np.concatenate(new), minlength=n).astype(np.int16)
            lo, hi = a, z
            rows = np.flatnonzero((counts >= least) & ~verified)
            verified[rows] = True
            found += len(rows)
            rows = rows[self.ids[rows] != own]
            if len(rows):
                scores = (self.vectors[rows] * query).sum(1)
                best = _best(np.append(best[0], self.ids[rows]), np.append(best[1], scores), p.k)
            if found == n or (found >= enough and len(best[0]) >= p.k and self._caught(half, self.length**2 + size - 2 * float(best[1][-1]))):
                seen[0] += found
                return best
            half *= growth
            growth *= 1.01


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > k:
        some = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
        ids, scores = ids[some], scores[some]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


class LengthBands:
    """An index for each range of vector lengths (a factor of the square root of 2), so that a few long vectors don't
    flatten the differences between all others. The longest come first: their finds may rule all shorter ones out."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, p: SearchParams):
        band = np.round(np.log2((vectors**2).sum(1)))
        self.verified = [0]
        self.parts = [CollisionIndex(vectors[band == b], ids[band == b], p) for b in np.unique(band)[::-1]]

    def top(self, query: np.ndarray, own: int) -> tuple[np.ndarray, np.ndarray]:
        best = np.empty(0, np.int64), np.empty(0)
        for index in self.parts:
            best = index.top(query, own, best, self.verified)
        return best


def vectors_of(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v) of rows that take part: an id, and a vector of finite components that aren't all zero; one row an id."""
    v = F.col(vector_col).cast("array<double>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).where("id is not null and v is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))
    return rows.groupBy("id").agg(F.min("v").alias("v"))


def nearest(table: DataFrame, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", p: SearchParams = SearchParams()) -> DataFrame:
    """(query_id, rank, vec_id, score): the p.k largest inner products found for each vector whose id `every` divides.

    Candidates are all other ids of the same dimension; all are returned if there are fewer than p.k. Vectors null, zero or
    with null or non-finite components, and rows without an id, take no part; of rows repeated under one id the least
    vector counts. Ties go to the smaller id. Vectors are dealt by hash into shards of about p.shard (as
    many as there are tasks, if they hold p.least then); each vector is shuffled once and each shard indexed once. Queries
    go to every shard, pass its index batch by batch, and the k best of every shard are merged by a shuffle on the query. An empty table gives an empty result."""
    small_batches(table.sparkSession)
    rows = scratch(vectors_of(table, id_col, vector_col), "vectors").withColumn("dim", F.size("v"))
    n = rows.count()
    shards = max(1, -(-n // p.shard), min(tasks(table.sparkSession), n // p.least))
    base = rows.withColumn("shard", F.pmod(F.xxhash64(F.lit(9), "id"), F.lit(shards)).cast("int")).withColumn("kind", F.lit(0))
    asked = rows.where(F.col("id") % every == 0).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("kind", F.lit(1))
    both = base.unionByName(asked).repartition(shards, "dim", "shard").sortWithinPartitions("dim", "shard", "kind", "id")

    def matrix(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy().reshape(len(column), -1)

    def searched(batches):
        """A shard's vectors come first and are indexed once; then its queries pass, batch by batch."""
        here, parts, index = None, [], None
        for b in batches:
            dim, shard, kind = (b.column(c).to_numpy() for c in ("dim", "shard", "kind"))
            cuts = np.flatnonzero((np.diff(dim) != 0) | (np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                if a == z:
                    continue
                if (dim[a], shard[a]) != here:
                    here, parts, index = (dim[a], shard[a]), [], None
                ids, vectors = b.column("id").slice(a, z - a).to_numpy(), matrix(b.column("v").slice(a, z - a))
                if not kind[a]:
                    parts.append((ids.copy(), vectors.copy()))
                    continue
                if index is None:
                    if not parts:
                        continue
                    index, parts = LengthBands(np.concatenate([v for _, v in parts]), np.concatenate([i for i, _ in parts]), p), []
                found = [index.top(q, own) for own, q in zip(ids, vectors)]
                sizes = [len(best) for best, _ in found]
                columns = [np.repeat(ids, sizes), np.concatenate([best for best, _ in found]), np.concatenate([scores for _, scores in found])]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], ["query_id", "vec_id", "score"])

    found = both.mapInArrow(searched, "query_id long, vec_id long, score double")
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.k).select("query_id", "rank", "vec_id", "score")


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every query; see nearest for vectors that take no part, ties, repeated rows and empty tables."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
