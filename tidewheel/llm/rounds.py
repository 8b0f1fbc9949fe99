"""Texts that are dealt into buckets once and then asked and answered in rounds.

One exchange of the texts feeds every round of a job (Spark reuses it), so a round costs what is said in it only:
cells of a sketch, answers by cell, candidates by shard, and verdicts by bucket. No round passes through the driver."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewheel.llm.common import SHARD_BYTES, keyed, tasks
from tidewheel.llm.sketch import TOLD, Shape, answered, packed, told, unpacked

#: Bytes of text that a task works on at a time.
BUCKET_BYTES = 16 << 20


@dataclass(frozen=True)
class Dealt:
    """texts: (bucket, id, key, text) by bucket; size: bytes of all texts."""

    texts: DataFrame
    buckets: int
    size: int

    @classmethod
    def of(cls, docs: DataFrame, id_col: str, text_col: str) -> Dealt:
        rows = keyed(docs, id_col, text_col)
        size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
        parts = max(tasks(docs.sparkSession), -(-size // SHARD_BYTES))
        buckets = max(parts, -(-size // BUCKET_BYTES))
        bucket = F.pmod(F.xxhash64(F.lit(41), "id", "key"), F.lit(buckets)).cast("int")
        return cls(rows.select(bucket.alias("bucket"), "id", "key", "text").repartition(parts, "bucket"), buckets, size)

    def sketched(self, hashes: Callable[[Bucket], np.ndarray], shape: Shape, hot: int | None = None) -> DataFrame:
        """Answers (see sketch) for the hashes of every bucket; with hot also on which are used about so often."""

        def say(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield told(key[0].as_py(), hashes(Bucket(batches)), shape, hot is not None)

        return answered(self.texts.groupBy("bucket").applyInArrow(say, TOLD), shape, hot)

    def with_answers(self, answers: DataFrame, function: Callable[[Bucket, pa.Table], pa.Table], schema: str) -> DataFrame:
        """function for every bucket that has texts, with the rows of answers that are for it."""
        empty = pa.table({f: pa.array([], t) for f, t in _arrow(schema)})

        def both(left: pa.Table, right: pa.Table) -> pa.Table:
            return function(Bucket(left.to_batches()), right) if left.num_rows else empty

        return self.texts.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(both, schema)


_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _arrow(schema: str) -> list[tuple[str, pa.DataType]]:
    return [(name, _TYPES[kind]) for name, kind in (x.split() for x in schema.split(", "))]


def table(rows: list[tuple], schema: str) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * len(_arrow(schema))
    return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, _arrow(schema))})


class Bucket:
    """A bucket's texts by (id, key). Rows repeated are one text; row: for every given row the number of its text."""

    def __init__(self, batches):
        ids, keys, texts, number = [], [], [], -1
        for b in batches:
            ids += b.column("id").to_pylist()
            keys += b.column("key").to_pylist()
            texts += b.column("text").to_pylist()
            number = b.column("bucket")[0].as_py() if b.num_rows else number
        ids, keys = np.array(ids, np.int64), np.array(keys, np.int64)
        order = np.lexsort((keys, ids))
        new = np.ones(len(order), bool)
        new[1:] = (ids[order][1:] != ids[order][:-1]) | (keys[order][1:] != keys[order][:-1])
        self.number, self.row = number, np.empty(len(order), np.int64)
        self.row[order] = np.cumsum(new) - 1
        self.ids, self.texts = ids[order][new], [texts[k] for k in order[new].tolist()]

    def blocks(self, most: int) -> Iterator[tuple[int, list[bytes]]]:
        """(number of the first, texts) of consecutive texts with about `most` bytes; a longer text is a block of its own."""
        first, size = 0, 0
        for k, t in enumerate(self.texts):
            if k > first and size + len(t) > most:
                yield first, self.texts[first:k]
                first, size = k, 0
            size += len(t)
        if self.texts:
            yield first, self.texts[first:]


def places(of: np.ndarray, *more: np.ndarray) -> list[bytes]:
    """Ascending text numbers with some ascending numbers of each text, packed: the texts, how many of each, the numbers."""
    some, first, counts = np.unique(of, return_index=True, return_counts=True)
    # Within a text numbers ascend; one ascending list needs the texts' ends added up.
    top = np.zeros(len(of), np.int64)
    if len(of):
        last = np.maximum.reduceat(np.max(more, 0), first) + 1
        top = np.repeat(np.cumsum(last) - last, counts)
    return [packed(some), packed(np.cumsum(counts)), *(packed(top + m) for m in more), packed(np.cumsum(last) if len(of) else top)]


def placed(data: list[bytes]) -> list[np.ndarray]:
    """(text of each, numbers...) from places()."""
    some, ends, *more, tops = map(unpacked, data)
    counts = np.diff(ends, prepend=0)
    base = np.repeat(np.append(0, tops[:-1]) if len(tops) else tops, counts)
    return [np.repeat(some, counts), *(m - base for m in more)]


VERDICT = "bucket int, texts binary, counts binary, starts binary, ends binary, tops binary"


def verdict_rows(bucket: np.ndarray, of: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple]:
    """VERDICT rows for spans [start, end) of texts of buckets, in any order; overlapping and touching spans are joined."""
    order = np.lexsort((start, of, bucket))
    bucket, of, start, end = bucket[order], of[order], start[order], end[order]
    new = np.ones(len(of), bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (of[1:] != of[:-1])
    # The furthest end so far within a text: texts are told apart by adding up.
    shift = np.cumsum(new) * (int(end.max(initial=0)) + 1)
    reach = np.maximum.accumulate(end + shift)
    new[1:] |= (start + shift)[1:] > reach[:-1]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(of) - 1) if len(first) else first
    bucket, of, start, end = bucket[first], of[first], start[first], (reach - shift)[last]
    edges = np.flatnonzero(np.diff(bucket, prepend=-1))
    return [(int(bucket[a]), *places(of[a:z], start[a:z], end[a:z])) for a, z in zip(edges, np.append(edges[1:], len(bucket)))]


def spans_of(answers: pa.Table, n: int) -> list[list[tuple[int, int]]]:
    """For each of a bucket's n texts the joined spans of all VERDICT rows, in order."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    parts = [placed([r[c] for c in ("texts", "counts", "starts", "ends", "tops")]) for r in answers.to_pylist()]
    if not parts:
        return out
    of, start, end = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((start, of))
    for k, a, z in zip(of[order].tolist(), start[order].tolist(), end[order].tolist()):
        own = out[k]
        if own and a <= own[-1][1]:
            own[-1] = own[-1][0], max(own[-1][1], z)
        else:
            own.append((a, z))
    return out
