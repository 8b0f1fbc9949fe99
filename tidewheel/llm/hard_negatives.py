"""Hard-negative mining over one-dimensional distance keys.

One more coordinate brings all vectors to the same length, so that the larger inner product is the nearer vector. Each
vector is stored under its nearest pivot, sorted by its distance from it. By the triangle inequality a vector within
distance r of a query has a key within r of the query's own distance from that pivot: intervals of keys are read outward from
there, until what is left is provably too far (or, inside an annulus, too near)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import scratch, small_batches, tasks


@dataclass(frozen=True)
class MiningParams:
    #: Ids that `every` divides are anchors. Each has so many positives, and each of these so many negatives.
    every: int = 50
    positives: int = 5
    negatives: int = 3
    #: A negative's score is from low to high hundredths of the positive's.
    low: int = 50
    high: int = 95
    #: Pivots, at most, one for pivot_rows vectors; learned from at most `sample` vectors, chosen by a hash of the id.
    pivots: int = 64
    pivot_rows: int = 2_048
    sample: int = 4_096
    #: Vectors of one block of the stored keys, which a task holds at a time, and as few as give each task a block.
    block: int = 65_536
    least: int = 8_192
    #: Keys that are read at first to either side; then twice as many.
    step: int = 512
    seed: int = 13


#: Longer vectors have inner products beyond a long.
LONGEST = 2.0**62
EXACT = 2.0**53


def pivots_of(vectors: np.ndarray, k: int, seed: int, rounds: int = 8) -> np.ndarray:
    """k centres by Lloyd's rounds from distinct vectors; fewer where there are fewer."""
    found = np.unique(vectors, axis=0)
    rng = np.random.default_rng(seed)
    centres = found[np.sort(rng.permutation(len(found))[:k])].astype(float)
    for _ in range(rounds):
        near = distances(vectors, centres).argmin(1)
        for c in range(len(centres)):
            if (mine := vectors[near == c]).size:
                centres[c] = mine.mean(0)
    return centres


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, (a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T))


def lifted(vectors: np.ndarray, longest: float) -> np.ndarray:
    """The vectors with one more coordinate, all of squared length `longest`."""
    v = vectors.astype(float)
    return np.column_stack([v, np.sqrt(np.maximum(0, longest - (v**2).sum(1)))])


class Best:
    """The k best (score, id) with scores from `low` to `high`, ties to the smaller id. bound: a score below which none counts."""

    def __init__(self, k: int, low: float, high: float):
        self.k, self.low, self.high = k, low, high
        self.scores, self.ids = np.empty(0, np.int64), np.empty(0, np.int64)

    @property
    def bound(self) -> float:
        return max(self.low, self.scores[-1]) if len(self.scores) == self.k else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        some = (scores >= self.bound) & (scores <= self.high)
        if some.any():
            scores, ids = np.append(self.scores, scores[some]), np.append(self.ids, ids[some])
            order = np.lexsort((ids, -scores))[: self.k]
            self.scores, self.ids = scores[order], ids[order]


class KeyedBlock:
    """Vectors of a block, by pivot and distance from it."""

    def __init__(self, ids, labels, vectors, pivot, dist, pivots: np.ndarray, longest: float, step: int):
        self.ids, self.labels, self.vectors, self.dist = ids, labels, vectors, dist
        self.pivots, self.longest, self.step = pivots, longest, step
        edges = np.flatnonzero(np.diff(pivot, prepend=-1))
        self.parts = list(zip(pivot[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(pivot)]))
        self.read = 0

    def search(self, q: np.ndarray, away: np.ndarray, wants: list[Best], take) -> None:
        """Gives every vector that may count to the wants. away: the query's distances from the pivots; take: which labels and ids count."""
        square = float(q.astype(float) @ q.astype(float)) + self.longest
        # Rounding of distances: far below this share of the largest.
        slack = 1e-6 * np.sqrt(square + self.longest) + 1e-9

        def radius(score: float) -> float:
            return np.inf if score == -np.inf else float(np.sqrt(max(0.0, square - 2 * score)))

        def reach() -> float:
            return radius(min(w.bound for w in wants)) + slack

        inner = radius(max(w.high for w in wants)) - slack if max(w.high for w in wants) < np.inf else 0.0
        parts = []
        for p, lo, hi in self.parts:
            d = float(away[p])
            lo = lo + int(np.searchsorted(self.dist[lo:hi], inner - d))  # nearer the pivot, they are within the inner radius
            if lo < hi:
                parts.append((max(0.0, self.dist[lo] - d, d - self.dist[hi - 1]), p, lo, hi, d))
        for gap, _, lo, hi, d in sorted(parts):
            if gap > reach():
                break
            right = lo + int(np.searchsorted(self.dist[lo:hi], d))
            left, step = right, self.step
            while True:
                r = reach()
                a = max(left - step, lo + int(np.searchsorted(self.dist[lo:left], d - r)))
                z = min(right + step, right + int(np.searchsorted(self.dist[right:hi], d + r, "right")))
                if a == left and z == right:
                    break
                for i, j in ((a, left), (right, z)):
                    if i < j:
                        self._read(q, i, j, wants, take)
                left, right, step = a, z, 2 * step

    def _read(self, q, i: int, j: int, wants: list[Best], take) -> None:
        self.read += j - i
        scores = self.vectors[i:j] @ q
        some = np.flatnonzero((scores >= min(w.bound for w in wants)) & take(self.labels[i:j], self.ids[i:j]))
        if len(some):
            scores, ids = scores[some].astype(np.int64), self.ids[i:j][some]
            for w in wants:
                w.add(scores, ids)


def rows_taking_part(table: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, v): one row an id; see hard_negatives."""
    v = F.col(vector_col).cast("array<long>")
    rows = table.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), v.alias("v")).where("id is not null and label is not null and v is not null")
    rows = rows.where(F.forall("v", lambda x: x.isNotNull()))
    rows = rows.where(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x) < LONGEST)
    return rows.groupBy("id").agg(F.min(F.struct("v", "label")).alias("r")).select("id", "r.label", "r.v")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Keys:
    """The stored keys of a table of rows, in blocks, and what of them bounds a query's search."""

    def __init__(self, rows: DataFrame, p: MiningParams):
        self.p, spark = p, rows.sparkSession
        self.spark = spark
        small_batches(spark)
        rows = scratch(rows, "mined")
        dims = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).alias("square"))
        most = dims.orderBy(F.desc("n"), F.desc("dim")).first()
        self.n, self.dim, self.longest = (most["n"], most["dim"], most["square"]) if most else (0, 0, 0.0)
        self.kind = np.float64 if self.longest < EXACT else np.int64
        rows = rows.where(F.size("v") == self.dim)
        some = rows.select("v").orderBy(F.xxhash64(F.lit(p.seed), "id"), "id").limit(p.sample).toArrow().column("v").combine_chunks()
        k = max(1, min(p.pivots, self.n // p.pivot_rows))
        self.pivots = pivots_of(lifted(_matrix(some), self.longest), k, p.seed) if self.n and self.dim else np.zeros((1, self.dim + 1))
        pivots, longest = spark.sparkContext.broadcast(self.pivots), self.longest

        def keyed(batches):
            for b in batches:
                away = distances(lifted(_matrix(b.column(2)), longest), pivots.value) if b.num_rows else np.zeros((0, 1))
                near = away.argmin(1)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near, pa.int32()), pa.array(away[np.arange(len(near)), near])], ["id", "label", "v", "pivot", "dist"])

        keys = rows.mapInArrow(keyed, "id long, label long, v array<long>, pivot int, dist double")
        parts = max(1, -(-self.n // p.block), min(tasks(spark), self.n // p.least))
        ranges = keys.repartitionByRange(parts, "pivot", "dist", "id").sortWithinPartitions("pivot", "dist", "id")
        self.rows = scratch(ranges.withColumn("block", F.spark_partition_id()), "keys")
        # One row for each block and pivot in it: as many as there are blocks and pivots together, at most.
        rings = self.rows.groupBy("block", "pivot").agg(F.min("dist").alias("near"), F.max("dist").alias("far")).orderBy("block", "pivot").toArrow()
        self.rings = tuple(rings.column(c).to_numpy() for c in ("block", "pivot", "near", "far"))

    def search(self, queries: DataFrame, k: int, same: bool) -> DataFrame:
        """(q, want, vec_id, score): candidates among which are, for each query and want, the k best rows of the query's label
        (same) or of another, with scores from want.low to want.high, but not the query's own id.

        queries: (q, label, v, wants array<struct<want int, low long, high long>>), with bounds null for none. Each query first
        goes to the block that may hold its nearest; what is found there bounds which others it goes to."""
        queries = scratch(queries.select("q", "label", "v", "wants"), "asked")
        first = self._scan(self._routed(queries, True), k, same)
        first = scratch(first, "found")
        best = W.partitionBy("q", "want").orderBy(F.desc("score"), "vec_id")
        kth = first.withColumn("n", F.row_number().over(best)).where(F.col("n") == k).groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("kth"))
        higher = F.transform("wants", lambda w: F.struct(w["want"].alias("want"), F.greatest(w["low"], F.try_element_at("kth", w["want"])).alias("low"), w["high"].alias("high")))
        bounded = queries.join(kth, "q", "left").withColumn("wants", F.when(F.col("kth").isNull(), F.col("wants")).otherwise(higher)).select("q", "label", "v", "wants")
        return first.unionByName(self._scan(self._routed(bounded, False), k, same))

    def _routed(self, queries: DataFrame, first: bool) -> DataFrame:
        """queries with the block each goes to: the most promising one, or all others that its bounds don't rule out."""
        pivots, rings, longest = self.spark.sparkContext.broadcast(self.pivots), self.spark.sparkContext.broadcast(self.rings), self.longest

        def routed(batches):
            block, pivot, near, far = rings.value
            starts = np.flatnonzero(np.diff(block, prepend=-1)) if len(block) else np.empty(0, np.int64)
            for b in batches:
                if not len(block) or not b.num_rows:
                    continue
                q = _matrix(b.column(2)).astype(float)
                away = distances(np.column_stack([q, np.zeros(len(q))]), pivots.value)[:, pivot]
                square = (q**2).sum(1) + longest
                slack = 1e-6 * np.sqrt(square + longest) + 1e-9
                least = np.minimum.reduceat(np.maximum(0, np.maximum(near - away, away - far)), starts, axis=1)
                most = np.maximum.reduceat(away + far, starts, axis=1)
                home = least.argmin(1)
                wants = b.column(3)
                flat, edges = wants.flatten(), wants.offsets.to_numpy()
                low, high = (np.array([x if x is not None else end for x in flat.field(c).to_pylist()], float) for c, end in (("low", -np.inf), ("high", np.inf)))
                at, to = [], []
                for k in range(len(q)):
                    if first:
                        goes = home[k : k + 1]
                    else:
                        a, z = edges[k] - edges[0], edges[k + 1] - edges[0]
                        outer = np.sqrt(max(0.0, square[k] - 2 * low[a:z].min(initial=np.inf)))
                        inner = np.sqrt(max(0.0, square[k] - 2 * high[a:z].max(initial=-np.inf)))
                        goes = np.flatnonzero((least[k] <= outer + slack[k]) & (most[k] >= inner - slack[k]))
                        goes = goes[goes != home[k]]
                    at.append(np.full(len(goes), k))
                    to.append(block[starts[goes]])
                at, to = np.concatenate(at), np.concatenate(to)
                for lo in range(0, len(at), 4096):
                    part = b.take(pa.array(at[lo : lo + 4096]))
                    yield pa.RecordBatch.from_arrays([pa.array(to[lo : lo + 4096], pa.int32()), *part.columns], ["block", "q", "label", "v", "wants"])

        return queries.mapInArrow(routed, "block int, q long, label long, v array<long>, wants array<struct<want:int,low:long,high:long>>")

    def _scan(self, routed: DataFrame, k: int, same: bool) -> DataFrame:
        """A task reads its blocks in turn, each one's vectors first, then its queries batch by batch: it holds one block and one batch."""
        none = F.lit(None)
        kept = self.rows.select("block", F.lit(0).alias("kind"), "id", "label", "v", "pivot", "dist", none.cast("array<struct<want:int,low:long,high:long>>").alias("wants"))
        asked = routed.select("block", F.lit(1).alias("kind"), F.col("q").alias("id"), "label", "v", none.cast("int").alias("pivot"), none.cast("double").alias("dist"), "wants")
        blocks = len(np.unique(self.rings[0]))
        both = kept.unionByName(asked).repartition(max(1, blocks), "block").sortWithinPartitions("block", "kind", "pivot", "dist", "id")
        pivots, longest, kind, step = self.spark.sparkContext.broadcast(self.pivots), self.longest, self.kind, self.p.step

        def scanned(batches):
            parts, index, here = [], None, None
            for b in batches:
                block, is_query = b.column(0).to_numpy(), b.column(1).to_numpy()
                cuts = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_query) != 0)) + 1
                for a, z in zip([0, *cuts], [*cuts, b.num_rows]):
                    if a == z:
                        continue
                    if block[a] != here:
                        parts, index, here = [], None, block[a]
                    piece = b.slice(a, z - a)
                    if not is_query[a]:
                        parts.append((piece.column(2).to_numpy().copy(), piece.column(3).to_numpy().copy(), _matrix(piece.column(4)).astype(kind), piece.column(5).to_numpy(zero_copy_only=False).astype(int), piece.column(6).to_numpy(zero_copy_only=False).astype(float)))
                        continue
                    if index is None:
                        if not parts:
                            continue
                        index, parts = KeyedBlock(*[np.concatenate(c) for c in zip(*parts)], pivots.value, longest, step), []
                    yield answers(index, piece)

        def answers(index: KeyedBlock, piece: pa.RecordBatch) -> pa.RecordBatch:
            vectors = _matrix(piece.column(4))
            away = distances(np.column_stack([vectors.astype(float), np.zeros(len(vectors))]), pivots.value)
            out = {"q": [], "want": [], "vec_id": [], "score": []}
            for own, label, q, d, wants in zip(piece.column(2).to_pylist(), piece.column(3).to_pylist(), vectors.astype(kind), away, piece.column(7).to_pylist()):
                best = [Best(k, -np.inf if w["low"] is None else w["low"], np.inf if w["high"] is None else w["high"]) for w in wants]
                if best:
                    index.search(q, d, best, (lambda x, ids: (x == label) & (ids != own)) if same else (lambda x, ids: (x != label) & (ids != own)))
                for w, found in zip(wants, best):
                    for name, x in (("q", np.full(len(found.ids), own)), ("want", np.full(len(found.ids), w["want"])), ("vec_id", found.ids), ("score", found.scores)):
                        out[name].append(x)
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.int64), *x]).astype(np.int64)).cast(pa.int32() if name == "want" else pa.int64()) for name, x in out.items()], list(out))

        return both.mapInArrow(scanned, "q long, want int, vec_id long, score long")


def hard_negatives(table: DataFrame, id_col: str = "vec_id", vector_col: str = "v", label_col: str = "label", p: MiningParams = MiningParams()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of vectors of whole numbers, exactly.

    Anchors are the ids that p.every divides. An anchor's positives are its p.positives best other rows of the same label by
    inner product, ties to the smaller id; for each, the p.negatives best rows of other labels with
    low * positive_score <= 100 * negative_score <= high * positive_score follow. Fewer where there are fewer; a positive
    without such rows has none. Rows with a null id, label, vector or component, of another dimension than most rows
    (ties: the larger) or too long for scores in a long take no part; of rows repeated under one id the least vector, then
    label, counts. An empty table gives an empty result.

    Keys are stored in blocks of about p.block vectors, of ranges of (pivot, distance, id): vectors under one pivot, and
    equal ones, are cut by id. A query goes to one block, then to those that the triangle inequality does not rule out; vectors
    move once a round, whatever the number of queries. The search is exact: what it saves depends on how the vectors cluster."""
    keys = Keys(rows_taking_part(table, id_col, vector_col, label_col), p)
    anchors = keys.rows.where(F.col("id") % p.every == 0).select(F.col("id").alias("q"), "label", "v")
    want = F.struct(F.lit(0).alias("want"), F.lit(None).cast("long").alias("low"), F.lit(None).cast("long").alias("high"))
    found = keys.search(anchors.withColumn("wants", F.array(want)), p.positives, True)
    best = W.partitionBy("q", "want").orderBy(F.desc("score"), "vec_id")
    positives = scratch(found.withColumn("n", F.row_number().over(best)).where(F.col("n") <= p.positives).select("q", F.col("n").cast("int").alias("want"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    # Bounds in whole numbers: the least score not below low hundredths, the largest not above high ones.
    low, high = F.ceil(F.col("positive_score").cast("decimal(20,0)") * p.low / 100).cast("long"), F.floor(F.col("positive_score").cast("decimal(20,0)") * p.high / 100).cast("long")
    wants = positives.select("q", "want", low.alias("low"), high.alias("high")).where("low <= high").groupBy("q").agg(F.array_sort(F.collect_list(F.struct("want", "low", "high"))).alias("wants"))
    found = keys.search(anchors.join(wants, "q"), p.negatives, False)
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= p.negatives)
    out = ranked.join(positives, ["q", "want"])
    return out.select(F.col("q").alias("anchor_id"), "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns; see hard_negatives for rows that take no part, ties, repeated rows and empty tables."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    x = F.col("embedding").cast("array<double>")
    finite = F.coalesce(F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table.where(finite).select("vec_id", label.alias("label"), F.transform(x, lambda c: F.floor(c * 256)).alias("v")))


OP13_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
pos AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
neg AS (
  SELECT anchor_id, positive_id, vec_id AS negative_id, positive_score, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
  FROM pos JOIN s USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM neg WHERE rank <= 3"""
