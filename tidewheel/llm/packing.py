"""Best-fit packing of tokenised documents with large-item matching.

Only lengths matter to a packing, and there are at most `capacity` of them. So documents are counted by the length
of their open piece, the counts are packed on the driver into bin patterns with multiplicities, and each document
finds its place by its rank among the documents of its length."""

from __future__ import annotations

import sys
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewheel.llm.common import salted_rank, scratch, small_batches

CAPACITY = 1024
END = 2
VOCABULARY = "byte_bpe_50k"


@dataclass
class Bins:
    """n bins that hold the same lengths, in this order."""

    n: int
    gap: int
    lengths: list[int] = field(default_factory=list)


def pack_counts(counts: dict[int, int], capacity: int = CAPACITY) -> list[Bins]:
    """Patterns that pack counts[n] items of each length n.

    Items above a third of the capacity are matched first, largest first, each with the largest other one that
    still fits, so that they pair at most twice a bin. Smaller items, largest first, go to the smallest gap that
    holds them; new bins open when none does. Bins of one pattern are dealt with together, so the work depends on
    the number of lengths, not of items."""
    left = {n: c for n, c in counts.items() if 0 < n <= capacity and c > 0}
    large = sorted(n for n in left if 3 * n > capacity)
    done: list[Bins] = []
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            done.append(Bins(left.pop(a), capacity - a, [a]))
            large.pop()
            continue
        b = large[k]
        n = left[a] // 2 if a == b else min(left[a], left[b])
        if n:
            done.append(Bins(n, capacity - a - b, [a, b]))
        for x in {a, b}:
            left[x] -= n * (2 if a == b else 1)
        if a == b and left[a]:
            # The odd one: it pairs with the next smaller, if any.
            small = large[k - 1] if k else None
            done.append(Bins(1, capacity - a - (small or 0), [a] + [small] * bool(small)))
            left[a] = 0
            if small:
                left[small] -= 1
        large = [x for x in large if left.get(x)]
        left = {x: c for x, c in left.items() if c}
    by_gap: dict[int, list[Bins]] = {}
    gaps: list[int] = []

    def put(bins: Bins) -> None:
        if bins.gap not in by_gap:
            by_gap[bins.gap] = []
            insort(gaps, bins.gap)
        by_gap[bins.gap].append(bins)

    for bins in done:
        put(bins)
    for length in sorted(left, reverse=True):
        free = left[length]
        while free:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                each = capacity // length
                full, rest = divmod(free, each)
                if full:
                    put(Bins(full, capacity - each * length, [length] * each))
                if rest:
                    put(Bins(1, capacity - rest * length, [length] * rest))
                break
            gap = gaps[at]
            bins = by_gap[gap].pop()
            if not by_gap[gap]:
                del by_gap[gap]
                gaps.pop(at)
            each = min(gap // length, free)
            used = min(bins.n, free // each)
            if used < bins.n:
                put(Bins(bins.n - used, gap, bins.lengths))
            put(Bins(used, gap - each * length, bins.lengths + [length] * each))
            free -= used * each
    return [b for some in by_gap.values() for b in some]


def tokenizer(vocabulary: str = VOCABULARY):
    """text -> little-endian unsigned 32-bit ids, the same as the tokenizers file's without special tokens added.

    The rank file of the same vocabulary is used, which is several times as fast. Between single spaces the splitting
    rule never joins, so ids are kept by space-led chunk; texts with other white space beside a space go through whole."""
    import base64

    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    special = "<|endoftext|>"
    encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: 50256})
    kept: dict[str, bytes | None] = {}

    def packed(ids: list[int]) -> bytes:
        out = array("I", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def raw(text: str) -> bytes:
        return packed(encoding.encode(text, allowed_special="all"))

    ordinary = encoding.encode_ordinary

    def ids(text: str) -> bytes:
        if special in text:
            return raw(text)
        chunks = text.split(" ")
        parts = [raw(chunks[0])] if chunks[0] else []
        if len(chunks) > 1 and (not chunks[0] or chunks[0][-1].isspace()):
            return raw(text)
        for chunk in chunks[1:]:
            try:
                part = kept[chunk]
            except KeyError:
                if len(kept) >= 400_000:
                    kept.clear()
                odd = not chunk or chunk[0].isspace() or chunk[-1].isspace()
                part = None if odd else packed(ordinary(" " + chunk))
                if len(chunk) < 64:
                    kept[chunk] = part
            if part is None:
                return raw(text)
            parts.append(part)
        return b"".join(parts)

    return ids


def tokenized(docs: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str, with_ids: bool) -> DataFrame:
    """(id, first, n, crcs, ids): the first piece's length, all ids, and for each piece its crc32."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    end = np.array([END], dtype="<u4").tobytes()
    step = 4 * capacity
    schema = "id long, first int, n long, crcs array<long>" + ", ids binary" * with_ids

    def encoded(batches):
        ids = tokenizer(vocabulary)
        for b in batches:
            first, n, crcs, raws = [], [], [], []
            for text in b.column("text").to_pylist():
                data = ids(text) + end
                head = len(data) % step or min(step, len(data))
                cuts = [0, *range(head, len(data) + 1, step)]
                first.append(head // 4)
                n.append(len(data) // 4)
                crcs.append([zlib.crc32(data[a:z]) for a, z in zip(cuts, cuts[1:])])
                raws.append(data)
            columns = [b.column("id"), pa.array(first, pa.int32()), pa.array(n, pa.int64()), pa.array(crcs, pa.list_(pa.int64()))]
            columns += [pa.array(raws, pa.binary())] * with_ids
            yield pa.RecordBatch.from_arrays(columns, ["id", "first", "n", "crcs", "ids"][: len(columns)])

    return rows.mapInArrow(encoded, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY, with_ids: bool = False, with_copy: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset[, copy][, ids]): every piece of every row of docs.

    A document longer than capacity is cut; its first piece takes the remainder, so all others fill a sequence.
    Null and empty texts are the end id alone; rows repeated under one id are packed each; an empty table packs to
    nothing. Only counts by length reach the driver, and the places sent back depend on capacity, not on docs."""
    pieces = scratch(tokenized(docs, id_col, text_col, capacity, vocabulary, with_ids), "tokens")
    spark = docs.sparkSession
    counts = {r["first"]: r["c"] for r in pieces.groupBy("first").agg(F.count("*").alias("c")).collect()}
    most = pieces.agg(F.max(F.size("crcs"))).first()[0] or 1
    places: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks = dict.fromkeys(counts, 0)
    sequence = 0
    for bins in pack_counts(counts, capacity):
        offset = 0
        for length in bins.lengths:
            places.setdefault(length, []).append((ranks[length], sequence, offset, bins.n))
            ranks[length] += bins.n
            offset += length
        sequence += bins.n
    tables = {n: tuple(np.array(c, dtype=np.int64) for c in zip(*rows)) for n, rows in places.items()}
    starts, total = {}, 0
    for n in sorted(counts):
        starts[n], total = total, total + counts[n]
    shared = spark.sparkContext.broadcast((tables, starts, sequence))
    ranked = salted_rank(pieces.select("id", "first", "n", "crcs", *["ids"] * with_ids), ["first"], [F.col("id"), F.col("crcs")])
    if with_copy:  # rows of one id are few where copies come from a mix
        ranked = ranked.withColumn("copy", F.row_number().over(W.partitionBy("id").orderBy("first", "rank")))
    schema = "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + ", copy int" * with_copy + ", ids binary" * with_ids
    names = [x.split()[0] for x in schema.split(", ")]

    def placed(batches):
        tables, starts, full = shared.value
        for b in batches:
            first = b.column(b.schema.get_field_index("first")).to_numpy()
            rank = b.column(b.schema.get_field_index("rank")).to_numpy()
            crcs = b.column(b.schema.get_field_index("crcs")).to_pylist()
            sequence, offset = np.empty(len(first), np.int64), np.empty(len(first), np.int64)
            for length in np.unique(first):
                mine = first == length
                at, begins, offsets, _ = tables[int(length)]
                k = np.searchsorted(at, rank[mine], "right") - 1
                sequence[mine] = begins[k] + rank[mine] - at[k]
                offset[mine] = offsets[k]
            # Pieces that fill a sequence take numbers after all others, by the document's place among all documents.
            place = np.array([starts[int(f)] for f in first], np.int64) + rank
            each = np.array([len(c) for c in crcs])
            doc = np.repeat(np.arange(len(first)), each)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(each) - each, each)
            length = np.where(piece == 0, first[doc], capacity)
            start = np.where(piece == 0, 0, first[doc] + (piece - 1) * capacity)
            columns = [
                b.column(b.schema.get_field_index("id")).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                pa.array([x for c in crcs for x in c], pa.int64()), pa.array(np.where(piece == 0, sequence[doc], full + place[doc] * most + piece - 1), pa.int64()), pa.array(np.where(piece == 0, offset[doc], 0), pa.int64()),
            ]
            if with_copy:
                columns.append(b.column(b.schema.get_field_index("copy")).take(pa.array(doc)))
            if with_ids:
                raw = b.column(b.schema.get_field_index("ids")).to_pylist()
                columns.append(pa.array([raw[d][4 * s : 4 * (s + n)] for d, s, n in zip(doc, start, length)], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names)

    return ranked.mapInArrow(placed, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every piece; see pack for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(docs).withColumnRenamed("id", "doc_id")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces as of pack, with copy: which of the rows of one doc_id the piece is of, from 1; see pack for odd rows.

    (doc_id, copy, piece) tells all rows apart, null ids included."""
    return pack(docs, with_copy=True).withColumnRenamed("id", "doc_id")
