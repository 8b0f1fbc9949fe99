"""A Count-min sketch over 64-bit hashes that parts of the data fill and a shuffle merges, shard by shard.

Counters stop at 65,535: asked of it is which hashes may have been seen twice, and which very often. An estimate of two
never is below the count, so no repeated hash is missed; a hash seen once passes if all its counters are shared.

The sketch grows with the hashes and is never in one place: each shard is a range of counters, told which of them every
part of the data uses, and answers every part for just those. So as few hashes seen once pass at any size."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_U = np.uint64
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)


@dataclass(frozen=True)
class Shape:
    """depth rows of 2^log2 counters, each row in 2^cut shards."""

    log2: int
    cut: int
    depth: int = 2

    @classmethod
    def of(cls, hashes: int) -> Shape:
        """Two to four counters a hash and row; shards of 2^20 counters, or larger ones where that would be over 2^16 shards."""
        log2 = max(16, int(max(1, hashes)).bit_length() + 1)
        return cls(log2, min(16, max(2, log2 - 20)))

    def cells(self, hashes: np.ndarray, row: int) -> np.ndarray:
        return (hashes * _U(_ODD[row])) >> _U(64 - self.log2)


def packed(numbers: np.ndarray) -> bytes:
    """Ascending whole numbers, as differences of 7 bits a byte."""
    steps = np.diff(numbers.astype(np.int64), prepend=0).view(np.uint64)
    size = np.ones(len(steps), np.int64)
    for k in range(1, 10):
        above = steps >= _U(1 << 7 * k)
        if not above.any():
            break
        size += above
    out = np.zeros(int(size.sum()), np.uint8)
    at = np.cumsum(size) - size
    for k in range(10):
        some = size > k if k else slice(None)
        if k and not some.any():
            break
        out[at[some] + k] = ((steps[some] >> _U(7 * k)) & _U(127)).astype(np.uint8) | np.where(size[some] > k + 1, 128, 0).astype(np.uint8)
    return out.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(raw < 128)
    begins = np.append(0, ends[:-1] + 1) if len(ends) else ends
    size = ends - begins + 1
    steps = np.zeros(len(ends), np.uint64)
    for k in range(10):
        some = size > k
        if not some.any():
            break
        steps[some] |= (raw[begins[some] + k] & 127).astype(np.uint64) << _U(7 * k)
    return np.cumsum(steps.view(np.int64))


def _used(cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(where each used cell begins in the sorted cells, whether it is used twice)."""
    new = np.ones(len(cells), bool)
    new[1:] = cells[1:] != cells[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(cells))) > 1


def told(bucket: int, hashes: np.ndarray, shape: Shape, counted: bool = False) -> pa.RecordBatch:
    """What a bucket of the data says to each shard: the cells that it uses once, and those that it uses more often; counted:
    for each of these also the whole logarithm, base 2, of how often."""
    out, width = [], shape.log2 - shape.cut
    for row in range(shape.depth):
        cells = np.sort(shape.cells(hashes, row))
        first, two = _used(cells)
        times = np.log2(np.diff(np.append(first, len(cells)))).astype(np.uint8)
        cells = cells[first].astype(np.int64)
        edges = np.searchsorted(cells, np.arange((1 << shape.cut) + 1, dtype=np.int64) << width)
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            a, z = edges[shard], edges[shard + 1]
            own = cells[a:z] - (shard << width)
            out.append((row, shard, bucket, packed(own[~two[a:z]]), packed(own[two[a:z]]), times[a:z][two[a:z]].tobytes() if counted else b""))
    columns = list(zip(*out)) or [[]] * 6
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["line", "shard", "bucket", "one", "two", "times"])


TOLD = "line int, shard int, bucket int, one binary, two binary, times binary"
ANSWER = "bucket int, line int, shard int, bits binary, hot binary"
#: What a counter stops at.
_FULL = 65_535


def answered(parts: DataFrame, shape: Shape, hot: int | None = None) -> DataFrame:
    """ANSWER rows: for every bucket, row and shard of parts (TOLD), which of the cells that it uses once others use as well,
    and which of all that it uses have a sum of at least `hot`. All buckets that use a cell hear the same of it."""
    width = 1 << (shape.log2 - shape.cut)
    if hot is not None and not 2 <= hot <= _FULL:
        raise ValueError(f"hot is 2 to {_FULL}")

    def answer(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(width, np.uint16)
        said = []
        for b in batches:
            for bucket, one, two, times in zip(*(b.column(c).to_pylist() for c in ("bucket", "one", "two", "times"))):
                said.append((bucket, one, two))
                one, two, times = unpacked(one), unpacked(two), np.frombuffer(times, np.uint8)
                for cells, more in ((one, 1), (two, 1 << np.minimum(times, 16).astype(np.int64) if len(times) else 2)):
                    sums[cells] = np.minimum(sums[cells] + np.int64(more), _FULL)
        line, shard = (k.as_py() for k in keys)
        out = []
        for bucket, one, two in said:
            one = unpacked(one)
            often = np.empty(0, np.int64)
            if hot is not None:
                often = np.concatenate([one, unpacked(two)])
                often = np.sort(often[sums[often] >= hot])
            out.append((bucket, line, shard, np.packbits(sums[one] > 1).tobytes(), packed(often)))
        columns = list(zip(*out))
        kinds = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "line", "shard", "bits", "hot"])

    return parts.groupBy("line", "shard").applyInArrow(answer, ANSWER)


def repeated(hashes: np.ndarray, answers: pa.Table, shape: Shape) -> np.ndarray:
    """Which hashes of a bucket the merged sketch estimates at 2 or more, by the answers to what told() said of the same hashes."""
    width = shape.log2 - shape.cut
    bits = {(r["line"], r["shard"]): r["bits"] for r in answers.to_pylist()}
    spare = 64 - shape.log2
    out = np.ones(len(hashes), bool)
    for row in range(shape.depth):
        cells = shape.cells(hashes, row)
        if len(hashes) < 1 << spare:  # cell and place in one number: sorted faster than by argsort
            both = np.sort((cells << _U(spare)) | np.arange(len(hashes), dtype=np.uint64))
            order, cells = (both & _U((1 << spare) - 1)).astype(np.int64), both >> _U(spare)
        else:
            order = np.argsort(cells)
            cells = cells[order]
        first, hit = _used(cells)
        one = np.flatnonzero(~hit)
        edges = np.searchsorted(cells[first[one]].astype(np.int64), np.arange((1 << shape.cut) + 1, dtype=np.int64) << width)
        for shard in np.flatnonzero(np.diff(edges)).tolist():
            a, z = edges[shard], edges[shard + 1]
            hit[one[a:z]] = np.unpackbits(np.frombuffer(bits[row, shard], np.uint8), count=z - a).astype(bool)
        out[order] &= np.repeat(hit, np.diff(np.append(first, len(cells))))
    return out


def often(hashes: np.ndarray, answers: pa.Table, shape: Shape) -> np.ndarray:
    """Which hashes of a bucket are hot by the merged sketch: the same in every bucket that has them.

    Sums add up powers of two, so a hash that is used twice as often as asked is among them, whatever the buckets."""
    out = np.ones(len(hashes), bool)
    rows = [(r["line"], r["shard"], r["hot"]) for r in answers.select(["line", "shard", "hot"]).to_pylist() if r["hot"]]
    for row in range(shape.depth):
        cells = [unpacked(hot) + (shard << (shape.log2 - shape.cut)) for line, shard, hot in rows if line == row]
        out &= np.isin(shape.cells(hashes, row).astype(np.int64), np.concatenate(cells)) if cells else False
    return out
