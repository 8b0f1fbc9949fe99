"""N-gram Jaccard join: MinHash banding, a shuffle on band hashes, verification on full n-gram sets."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import fresh, hot_join, keyed, scratch, small_batches, tasks, without
from tidewheel.llm.components import components
from tidewheel.llm.words import Words, mixed, runs

_U = np.uint64


@dataclass(frozen=True)
class JoinParams:
    words: int = 5
    similarity: float = 0.8
    #: Chance that a pair at the threshold itself meets in a band; bands and rows follow from it.
    recall: float = 0.9999
    most_hashes: int = 192
    #: Members, and bytes of their sets, that are compared in one step; larger buckets are compared in pairs of blocks.
    block: int = 512
    block_bytes: int = 16 << 20
    seed: int = 5


def band_shape(similarity: float, recall: float, most_hashes: int) -> tuple[int, int]:
    """(bands, rows): the most rows a band, and so the fewest false candidates, that reach the recall within most_hashes."""
    best = None
    for rows in range(1, most_hashes + 1):
        hit = similarity**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log1p(-hit))
        if bands * rows > most_hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("no bands reach the recall within most_hashes")
    return best


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat, second, counts): each text's distinct shingle hashes, ascending, with their second lane. A text of fewer
    words than n, but not none, is one shingle."""
    words = Words(texts)
    lanes = [words.hashes(k) for k in (0, 1)]
    whole = words.of[: max(0, len(words.of) - n + 1)] == words.of[n - 1 :]
    of, found = [words.of[: len(whole)][whole]], [[runs(h, n, k)[whole]] for k, h in enumerate(lanes)]
    for m in range(1, n):
        short = np.flatnonzero(words.counts == m)
        of.append(short)
        for k, h in enumerate(lanes):
            found[k].append(runs(h[words.first[short][:, None] + np.arange(m)].ravel(), m, k)[::m])
    of = np.concatenate(of)
    values, second = map(np.concatenate, found)
    order = np.lexsort((values, of))
    values, second, of = values[order], second[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    return values[new], second[new], np.bincount(of[new], minlength=len(texts))


def signatures(docs: DataFrame, p: JoinParams) -> DataFrame:
    """(id, key, n, d1, d2, bands): the size and a 128-bit digest of the shingle set, and band hashes."""
    bands, rows = band_shape(p.similarity, p.recall, p.most_hashes)
    rng = np.random.default_rng(p.seed)
    a = rng.integers(1, 2**63, bands * rows, dtype=np.uint64) * _U(2) + _U(1)
    c = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)
    fold = rng.integers(1, 2**63, rows, dtype=np.uint64) * _U(2) + _U(1)

    def signed(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            flat, second, counts = shingle_sets(texts, p.words)
            full = np.flatnonzero(counts)
            starts = (np.cumsum(counts) - counts)[full]
            out = np.zeros((len(texts), bands), np.uint64)
            digest = np.zeros((2, len(texts)), np.uint64)
            if len(full):
                digest[0, full] = np.add.reduceat(mixed(flat + _U(1)), starts)
                digest[1, full] = np.add.reduceat(mixed(second + _U(1)), starts)
                for k in range(bands):
                    band = np.full(len(full), k + 1, np.uint64)
                    for r in range(rows):
                        j = k * rows + r
                        band = mixed(band + np.minimum.reduceat((flat * a[j]) ^ c[j], starts) * fold[r])
                    out[full, k] = band
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, bands * len(texts) + 1, bands), pa.int32()), pa.array(out.view(np.int64).ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(counts, pa.int64()), *(pa.array(d.view(np.int64)) for d in digest), lists], ["id", "key", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(signed, "id long, key long, n long, d1 long, d2 long, bands array<long>")


#: Bits of a filter for each member, and the most bits that are broadcast (64 MB).
_BITS, _MOST_BITS = 16, 1 << 29


def _places(bits: int) -> Column:
    """Where (id, key) is marked in a filter of so many bits."""
    return F.array(*[F.pmod(F.xxhash64(F.lit(k), "id", "key"), F.lit(bits)) for k in (31, 32)])


def member_filter(members: DataFrame) -> tuple[int, dict[int, np.ndarray]]:
    """(bits, bytes by bitmap number): a filter of bounded size that lets all members pass, and few others."""
    bits = min(_MOST_BITS, max(1 << 15, 1 << (_BITS * members.count()).bit_length()))
    at = members.select(F.explode(F.transform(_places(bits), lambda x: x + 1)).alias("at"))
    maps = at.groupBy(F.bitmap_bucket_number("at").alias("number")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("map"))
    return bits, {r["number"]: np.frombuffer(bytes(r["map"]), np.uint8) for r in maps.collect()}


def _passes(places: np.ndarray, maps: dict[int, np.ndarray]) -> np.ndarray:
    """Which rows of two places each are marked at both; a bitmap holds 2^15 places and is numbered from 1."""
    out = np.zeros(places.shape, bool)
    number, at = (places >> 15) + 1, places & 32767
    for k in np.unique(number):
        if int(k) in maps:
            mine = number == k
            out[mine] = maps[int(k)][at[mine] >> 3] >> (at[mine] & 7) & 1
    return out.all(1)


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, as a matrix product a slice of the common values at a time."""
    m = len(sets)
    if m == 2:
        n = float(len(np.intersect1d(sets[0], sets[1], assume_unique=True)))
        return np.array([[len(sets[0]), n], [n, len(sets[1])]])
    values, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    common = counts > 1
    place = np.cumsum(common) - 1
    keep = common[at]
    col, row = place[at[keep]], row[keep]
    order = np.argsort(col, kind="stable")
    col, row = col[order], row[order]
    out = np.zeros((m, m))
    width, total = max(1, (1 << 21) // m), int(common.sum())
    for lo in range(0, total, width):
        a, z = np.searchsorted(col, (lo, lo + width))
        x = np.zeros((m, min(width, total - lo)), np.float32)
        x[row[a:z], col[a:z] - lo] = 1
        out += x @ x.T
    return out


def compared(sets, weights, buckets, parts, bucket: int, i: int, j: int, similarity: Fraction):
    """For each member of a bucket: documents that it links to and that no smaller common bucket counts, and the
    smallest member that verified links lead to."""
    m = len(sets)
    n = np.array([len(s) for s in sets], dtype=np.int64)
    inter = np.rint(_shared(sets)).astype(np.int64)
    num, den = similarity.numerator, similarity.denominator
    linked = inter * (num + den) >= num * (n[:, None] + n[None, :])
    np.fill_diagonal(linked, False)
    if i != j:
        linked &= parts[:, None] != parts[None, :]
    earlier = [np.array(sorted(x for x in b if x < bucket), dtype=np.int64) for b in buckets]
    if linked.any() and sum(len(e) > 0 for e in earlier) > 1:
        counted = linked & ~(_shared(earlier) > 0.5) if m > 2 else linked & (len(np.intersect1d(*earlier)) == 0)
    else:
        counted = linked
    links = counted @ weights
    label = np.arange(m)
    while True:
        near = np.where(linked, label[None, :], m).min(1)
        new = np.minimum(label, near)
        new = new[new]
        if (new == label).all():
            return links, label
        label = new


def verified(members: DataFrame, p: JoinParams) -> DataFrame:
    """members: (bucket, i, j, part, id, key, weight, buckets, shingles), in partitions sorted by (bucket, i, j, id, key)."""
    similarity = Fraction(str(p.similarity))

    def flush(rows, out):
        if len(rows) < 2:
            return
        bucket, i, j = rows[0]["bucket"], rows[0]["i"], rows[0]["j"]
        sets = [np.frombuffer(r["shingles"], dtype=np.uint64) for r in rows]
        links, label = compared(sets, np.array([r["weight"] for r in rows], dtype=np.int64), [r["buckets"] for r in rows], np.array([r["part"] for r in rows]), bucket, i, j, similarity)
        for r, n, k in zip(rows, links, label):
            if n or rows[k] is not r:
                out.append((r["id"], r["key"], int(n), rows[k]["id"], rows[k]["key"]))

    def checked(batches):
        rows, at = [], None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (k := (r["bucket"], r["i"], r["j"])) != at:
                    flush(rows, out)
                    rows, at = [], k
                rows.append(r)
            yield _links(out)
        out = []
        flush(rows, out)
        yield _links(out)

    return members.mapInArrow(checked, "id long, key long, links long, to_id long, to_key long")


def _links(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "key", "links", "to_id", "to_key"])


def _classes(docs: DataFrame, id_col: str, text_col: str, p: JoinParams) -> DataFrame:
    """(id, key, n, copy_id, root, root_key, links) for every row of docs, where a null id is 2^63 - 1; see jaccard_join."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, id_col, text_col)
    signed = scratch(signatures(rows, p), "signatures")
    classes = signed.where("n > 0").groupBy("n", "d1", "d2").agg(F.min(F.struct("id", "key", "bands")).alias("rep"), F.count("*").alias("weight"))
    classes = scratch(classes.select("n", "d1", "d2", "rep.id", "rep.key", "rep.bands", "weight"), "classes")
    banded = classes.select("id", "key", "n", F.explode("bands").alias("band"))
    mark = F.xxhash64("id", "key")
    shared = banded.groupBy("band").agg(F.count("*").alias("m"), F.sum("n").alias("size"), F.bit_xor(mark).alias("s"), F.min(mark).alias("least")).where("m > 1")
    # Bands whose buckets have the same members are one bucket.
    parts = F.greatest(F.ceil(F.col("m") / p.block), F.ceil(F.col("size") * 8 / p.block_bytes)).cast("int")
    shared = scratch(shared.select("band", F.xxhash64("m", "s", "least").alias("bucket"), parts.alias("parts"), "m"), "bands")
    member = hot_join(banded.select("id", "key", "band"), shared, ["band"], "m").select("id", "key", F.struct("bucket", "parts").alias("b"))
    member = member.groupBy("id", "key").agg(F.collect_set("b").alias("in_buckets"))  # at most one a band
    member = scratch(member.join(classes.select("id", "key", "weight"), ["id", "key"]), "members")

    # Which texts to read again: the filter lets all members pass and few others; the join is exact.
    bits, maps = member_filter(member.select("id", "key"))
    shared_maps = spark.sparkContext.broadcast(maps)

    def hashed(batches):
        for b in batches:
            places = b.column("places").flatten().to_numpy().reshape(-1, 2)
            b = b.filter(pa.array(_passes(places, shared_maps.value)))
            flat, _, counts = shingle_sets(b.column("text").to_pylist(), p.words)
            ends = np.cumsum(counts)
            sets = [flat[z - n : z].tobytes() for n, z in zip(counts, ends)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("key"), pa.array(sets, pa.binary())], ["id", "key", "shingles"])

    sets = rows.withColumn("places", _places(bits)).mapInArrow(hashed, "id long, key long, shingles binary").join(member, ["id", "key"]).dropDuplicates(["id", "key"])
    sets = sets.select("id", "key", "weight", "shingles", F.col("in_buckets.bucket").alias("buckets"), F.explode("in_buckets").alias("b"))
    part = F.pmod(F.xxhash64(F.lit(3), "id", "key"), F.col("b.parts")).cast("int")
    sets = sets.withColumn("part", part).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("b.parts") - 1)))
    sets = sets.select(F.col("b.bucket").alias("bucket"), F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "id", "key", "weight", "buckets", "shingles")
    sets = sets.repartition(tasks(spark), "bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "id", "key")
    links = scratch(verified(sets, p), "links")
    vertex = F.struct("id", "key")
    edges = links.select(vertex.alias("u"), F.struct(F.col("to_id").alias("id"), F.col("to_key").alias("key")).alias("v"))
    roots = components(edges).select("u.id", "u.key", F.col("v.id").alias("root"), F.col("v.key").alias("root_key"))
    sums = links.groupBy("id", "key").agg(F.sum("links").alias("links"))
    known = classes.select("n", "d1", "d2", "id", "key", "weight").join(sums, ["id", "key"], "left").join(roots, ["id", "key"], "left")
    known = known.select("n", "d1", "d2", F.col("id").alias("copy_id"), F.coalesce("root", "id").alias("root"), F.coalesce("root_key", "key").alias("root_key"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"), "weight")
    found = hot_join(signed.where("n > 0").select("id", "key", "n", "d1", "d2"), scratch(known, "classes"), ["n", "d1", "d2"], "weight")
    alone = signed.where("n = 0").select("id", "key", "n", F.col("id").alias("copy_id"), F.col("id").alias("root"), F.col("key").alias("root_key"), F.lit(0).cast("long").alias("links"))
    return found.select(*alone.columns).unionByName(alone)


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", p: JoinParams = JoinParams()) -> DataFrame:
    """(id, class_id, copy_id, n_shingles, n_links): one row for every row of docs.

    Shingles are runs of p.words white-space words, unchanged; documents link when the Jaccard similarity of their
    shingle sets is p.similarity or more. Documents of one set are copies: the smallest id stands for them (copy_id),
    and only it is compared. n_links counts the other documents that a document links to, its copies among them.
    class_id is the smallest id that links lead to. Fewer words than p.words are one shingle; null, empty and blank
    texts have no shingles and no links. A null id sorts last and is returned as null. Rows repeated are copies.
    Shingles are compared by 64 bits, copies by 128 bits of hashes that mix the words' own 128-bit hashes. Links are lost
    only where no band meets (p.recall at the threshold, less often above); what meets is compared exactly on the sets,
    whatever the bucket's size. Counting the links of m different near copies takes m^2 comparisons, in blocks that tasks
    share. An empty table gives an empty result."""

    def real(c):
        return F.when(F.col(c) != 2**63 - 1, F.col(c))

    found = _classes(docs, id_col, text_col, p)
    return found.select(real("id").alias("id"), real("root").alias("class_id"), real("copy_id").alias("copy_id"), F.col("n").alias("n_shingles"), F.col("links").alias("n_links"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document with its class; see jaccard_join for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return jaccard_join(docs).withColumnRenamed("id", "doc_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id and text are the first of their class, with all their columns.

    First is the smallest id, of different texts under one id the one with the smaller hash. Rows repeated under one id
    and text are one document and stay together. Rows without an id stay; null, empty and blank texts link to nothing and
    stay. Only texts that may be among those that go are shuffled. An empty table gives an empty result."""
    found = _classes(docs.where(F.col(id_col).isNotNull()), id_col, text_col, JoinParams())
    gone = scratch(found.where("id <> root or key <> root_key").select("id", "key").distinct(), "gone")
    ident, mark = fresh(docs, "id"), fresh(docs, "key")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select("*", F.col(id_col).cast("long").alias(ident), F.xxhash64(text).alias(mark))
    return without(rows, gone.toDF(ident, mark), [ident, mark]).select(*docs.columns)
