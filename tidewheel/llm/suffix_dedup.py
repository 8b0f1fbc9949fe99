"""Dedup of repeated byte strings by blockwise suffix sorting with a difference cover.

A full distributed suffix array moves every suffix. Here suffixes are dealt to shards by the least hash among the 32-byte
strings of their first 100 bytes (equal 100-byte strings have the same), so that neighbouring suffixes travel as one
stretch of text, and only stretches travel whose least hash a Count-min sketch estimates to be used twice. A shard's text
gets the ranks of its difference cover sample first. Then its suffixes are sorted one suffix bucket (a range of first
bytes) at a time: by the first 32 bytes, and where these tie by the ranks of the sample, so that no comparison reads on
through a long tie and memory is bounded by the bucket. Only equal bytes decide; hashes only deal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import shards_for, small_batches
from tidewheel.llm.rounds import VERDICT, Bucket, Dealt, placed, places, spans_of, table, verdict_rows
from tidewheel.llm.sketch import TOLD, Shape, answered, often, repeated, told
from tidewheel.llm.words import joined, loads, mixed

LENGTH = 100
#: Bytes of the strings whose hashes deal suffixes, and of the first sorting step.
STEP = 32
#: Bytes of text whose strings are hashed at a time.
BLOCK = 1 << 20
#: Bytes of a shard's text that are given cover ranks together, and suffixes of one suffix bucket. Stretches of one least
#: hash stay together; so does the text of one least hash that alone is longer.
RANGE, SUFFIXES = 4 << 20, 1 << 18
#: Suffixes of one stretch; longer ones are cut.
STRETCH = 1 << 16
#: Places that make a least hash hot: their stretches fill about RANGE.
HOT = RANGE // (2 * LENGTH)
_U = np.uint64
#: Odd numbers that weigh the four parts of a string.
_WEIGHTS = tuple(_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


def difference_cover(v: int) -> list[int]:
    """Residues such that any two numbers, moved on by the same amount below v, fall on two of them; chosen greedily."""
    cover, open_ = [0], set(range(1, v))
    while open_:
        gain = lambda x: len(open_ & {(x - c) % v for c in cover} | open_ & {(c - x) % v for c in cover})
        x = max(range(v), key=gain)
        cover.append(x)
        open_ -= {(a - b) % v for a in cover for b in cover}
    return sorted(cover)


COVER = difference_cover(STEP)
_IN_COVER = np.isin(np.arange(STEP), COVER)
#: For residues a and b the smallest d with a + d and b + d both in the cover.
_MOVE = np.array([[next(d for d in range(STEP) if _IN_COVER[(a + d) % STEP] and _IN_COVER[(b + d) % STEP]) for b in range(STEP)] for a in range(STEP)])


def _least(h: np.ndarray, n: int, pick=np.minimum) -> np.ndarray:
    """pick over h[i:i+n] for every i, by doubling."""
    w = 1
    while 2 * w <= n:
        h = pick(h[: len(h) - w], h[w:])
        w *= 2
    return pick(h[: len(h) - (n - w)], h[n - w :]) if n > w else h


class _Stretches:
    """Runs of suffixes of a bucket's texts, of at least `length` bytes each, that share their least hash."""

    def __init__(self, b: Bucket, length: int):
        self.raw, self.length = b"".join(b.texts), length
        sizes = np.array([len(t) for t in b.texts], np.int64)
        self.begins = np.cumsum(sizes) - sizes
        data = np.frombuffer(self.raw, np.uint8)
        parts = []
        for first, texts in b.blocks(BLOCK):
            at, size = int(self.begins[first]), sum(map(len, texts))
            # A long text is cut; its pieces overlap so that each suffix is in one with its first `length` bytes.
            for c in range(0, max(1, size - length + 1), BLOCK) if len(texts) == 1 else (0,):
                z = min(size, c + BLOCK + length - 1) if len(texts) == 1 else size
                parts.append(self._of(data[at + c : at + z], at + c, [(0, z - c)] if len(texts) == 1 else [(int(self.begins[first + k]) - at, len(t)) for k, t in enumerate(texts)]))
        kinds = (np.uint64, np.int64, np.int64, np.uint64, np.uint64)
        self.seen, self.start, self.count, self.least, self.mark = (np.concatenate([np.empty(0, k), *x]) for k, x in zip(kinds, zip(*parts) if parts else [[]] * 5))
        self.of = np.searchsorted(self.begins, self.start, "right") - 1
        values, counts = np.unique(self.seen, return_counts=True)
        self.own = np.isin(self.least, values[counts > 1])  # such a stretch may repeat within itself

    def _of(self, data: np.ndarray, base: int, spans: list[tuple[int, int]]):
        length, wide, m = self.length, self.length - STEP + 1, len(data) - self.length + 1
        if m <= 0:
            return [np.empty(0, k) for k in (np.uint64, np.int64, np.int64, np.uint64, np.uint64)]
        eight, n = loads(data), len(data) - STEP + 1
        h = eight[:n] * _WEIGHTS[0]
        for k in range(1, STEP // 8):
            h += eight[8 * k : 8 * k + n] * _WEIGHTS[k]
        h = mixed(h)
        least = _least(h, wide)
        valid, change = np.zeros(m + 1, np.int8), np.ones(m, bool)
        change[1:] = least[1:] != least[:-1]
        for a, size in spans:
            if size >= length:
                valid[a] += 1
                valid[a + size - length + 1] -= 1
                change[a] = True
        valid = np.cumsum(valid[:m]).astype(bool)
        least[~valid] = 0
        pad = np.zeros(wide - 1, np.uint64)
        used = np.flatnonzero(_least(np.concatenate([pad, least, pad]), wide, np.maximum)[: len(h)] == h)
        change[1:] |= valid[1:] != valid[:-1]
        change[::STRETCH] = True
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, m))
        keep = valid[start]
        start, count = start[keep], count[keep]
        end = start + count + length - 1
        # Equal stretches have equal marks; which of those are equal, their bytes say.
        mark = joined(joined(h[start], h[end - STEP]), least[start] ^ count.astype(np.uint64))
        return h[used], start + base, count, least[start], mark


def equal_to(raw: bytes, start: np.ndarray, size: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """For stretches in order of places, the number of the first that has the same bytes, or their own number."""
    order = np.argsort(mark, kind="stable")
    group = mark[order]
    out = np.arange(len(mark))
    first = -1
    for k in np.flatnonzero(group[1:] == group[:-1]).tolist():
        if first < 0 or mark[first] != group[k]:
            first = int(order[k])
        at = int(order[k + 1])
        a, z, n = int(start[first]), int(start[at]), int(size[at])
        if size[first] == n and raw[a : a + n] == raw[z : z + n]:
            out[at] = first
    return out


def _cut(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes data[start:start+size] of all rows, joined."""
    ends = np.cumsum(size)
    return data[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - size), size)]


#: Stretches of a bucket for one shard, by place, with their bytes; or, where sure, spans that are known to be repeats.
_FOUND = "shard int, sure boolean, bucket int, texts binary, counts binary, starts binary, ends binary, tops binary, ids binary, least binary, mark binary, own binary, data binary"


def string_hashes(raw: bytes, at: np.ndarray, length: int) -> np.ndarray:
    """Hashes of raw[i:i+length] for the i of at."""
    eight, out = loads(np.frombuffer(raw, np.uint8)), np.zeros(len(at), np.uint64)
    for k in [*range(0, length - 7, 8), length - 8]:
        out = joined(out, eight[at + k])
    return out


def _each(count: np.ndarray) -> np.ndarray:
    """0 to n - 1 for every n of count, joined."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


class _Hits:
    """A bucket's stretches whose least hash is estimated to be used twice (numbers in s), which of them are equal to an
    earlier one, and which have a hot hash."""

    def __init__(self, b: Bucket, answers: pa.Table, length: int, shape: Shape):
        self.s = s = _Stretches(b, length)
        self.at = np.flatnonzero(np.isin(s.least, np.unique(s.seen[repeated(s.seen, answers, shape)])))
        self.start, self.size = s.start[self.at], s.count[self.at] + length - 1
        same = equal_to(s.raw, self.start, self.size, s.mark[self.at])
        self.late = same != np.arange(len(self.at))
        self.hot = np.isin(s.least[self.at], np.unique(s.seen[often(s.seen, answers, shape)])) & ~self.late
        #: Every suffix of the first ones of hot stretches: where it begins, and the hash of its first `length` bytes.
        count = s.count[self.at[self.hot]]
        self.suffix = np.repeat(self.start[self.hot], count) + _each(count)
        self.hash = string_hashes(s.raw, self.suffix, length)


def _hot_suffixes(dealt: Dealt, answers: DataFrame, length: int, shape: Shape) -> DataFrame:
    """Answers of a second sketch on the suffixes of hot stretches; a bucket says equal ones once. Without such it does not look at its texts."""

    def say(b: Bucket, answers: pa.Table) -> pa.Table:
        if not any(answers.column("hot").to_pylist()):
            return table([], TOLD)
        return pa.Table.from_batches([told(b.number, np.unique(_Hits(b, answers, length, shape).hash), shape)])

    return answered(dealt.with_answers(answers, say, TOLD), shape)


def _candidates(dealt: Dealt, answers: DataFrame, length: int, shape: Shape, shards: int) -> DataFrame:
    """Stretches whose least hash is estimated to be used twice, those of hot hashes as single suffixes that are estimated to be
    in other buckets; of what is equal within a bucket only the first."""
    second = _hot_suffixes(dealt, answers, length, shape).withColumn("line", F.col("line") + shape.depth)

    def found(b: Bucket, answers: pa.Table) -> pa.Table:
        line = answers.column("line").to_numpy()
        hits = _Hits(b, answers.filter(pa.array(line < shape.depth)), length, shape)
        s, data, out = hits.s, np.frombuffer(hits.s.raw, np.uint8), []

        def sure(start: np.ndarray, size: np.ndarray) -> None:
            of = np.searchsorted(s.begins, start, "right") - 1
            own = start - s.begins[of]
            out.extend((b.number % shards, True, *row, *[b""] * 5) for row in verdict_rows(np.full(len(of), b.number), of, own, own + size))

        def sent(start: np.ndarray, size: np.ndarray, least: np.ndarray, mark: np.ndarray, within: np.ndarray) -> None:
            shard = ((least >> _U(20)) % _U(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            edges = np.flatnonzero(np.diff(shard[order], prepend=-1))
            for a, z in zip(edges, np.append(edges[1:], len(order))):
                mine = order[a:z]
                of = np.searchsorted(s.begins, start[mine], "right") - 1
                own = start[mine] - s.begins[of]
                ids = np.diff(b.ids[np.unique(of)], prepend=0)
                more = (ids, least[mine], mark[mine], within[mine])
                out.append((int(shard[order[a]]), False, b.number, *places(of, own, own + size[mine]), *(x.tobytes() for x in more), _cut(data, start[mine], size[mine]).tobytes()))

        sure(hits.start[hits.late], hits.size[hits.late])
        cold = ~hits.late & ~hits.hot
        at = hits.at[cold]
        sent(hits.start[cold], hits.size[cold], s.least[at], s.mark[at], s.own[at])
        if hits.hot.any():
            values, number, counts = np.unique(hits.hash, return_inverse=True, return_counts=True)
            twice = (counts > 1)[number]
            count = s.count[hits.at[hits.hot]]
            some = np.logical_or.reduceat(twice, np.cumsum(count) - count)  # stretches with a suffix that may repeat here
            at = hits.at[hits.hot][some]
            at = at[np.argsort(s.least[at], kind="stable")]
            gone = [np.empty(0, np.int64)]
            for which, inside in _late(data, s.start[at], s.count[at] + length - 1, s.least[at], s.start[at], length):
                gone.append(s.start[at[which]] + inside)
            late = np.concatenate(gone)
            sure(late, np.full(len(late), length))
            go = repeated(values, answers.filter(pa.array(line >= shape.depth)).set_column(1, "line", pa.array(line[line >= shape.depth] - shape.depth)), shape)[number]
            go &= ~np.isin(hits.suffix, late)
            sent(hits.suffix[go], np.full(int(go.sum()), length), hits.hash[go], hits.hash[go], np.zeros(int(go.sum()), bool))
        return table(out, _FOUND)

    return dealt.with_answers(answers.unionByName(second), found, _FOUND)


class CoverRanks:
    """Ranks of a text's difference cover sample by the first bytes, as many as any tie of `length` bytes can need."""

    def __init__(self, data: np.ndarray, length: int):
        n = len(data)
        self.data, self.length = data, length
        self.eight = loads(np.append(data, np.zeros(STEP * 8, np.uint8)), ">u8")
        sample = np.flatnonzero(_IN_COVER[np.arange(n) % STEP])
        self.rank = np.zeros(n + 8 * STEP + 1, np.int32)  # 0: beyond the end
        order, new = self.sorted_by(sample)
        self.rank[sample[order]] = np.cumsum(new)
        depth = STEP
        while depth < length + STEP and not new.all():  # doubling, in steps that stay in the sample
            both = (self.rank[sample].astype(np.int64) << 32) | self.rank[np.minimum(sample + depth, n + 1)]
            order = np.argsort(both)
            both = both[order]
            new = np.ones(len(order), bool)
            new[1:] = both[1:] != both[:-1]
            self.rank[sample[order]] = np.cumsum(new)
            depth *= 2

    def words(self, at: np.ndarray) -> np.ndarray:
        return self.eight[at].astype(np.uint64)

    def sorted_by(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(order by the first 32 bytes, where such a group begins)."""
        keys = [self.words(at + 8 * k) for k in range(STEP // 8)]
        order = np.lexsort(keys[::-1])
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k in keys:
            k = k[order]
            new[1:] |= k[1:] != k[:-1]
        return order, new

    def sorted_bucket(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(suffixes, new): starts in an order that has those with equal first `length` bytes side by side, and where such a group begins."""
        order, new = self.sorted_by(starts)
        at = starts[order]
        group = np.cumsum(new) - 1
        size = np.bincount(group) if len(group) else np.empty(0, np.int64)
        open_ = np.flatnonzero(size[group] > 1)
        rng = np.random.default_rng(1)
        # A quicksort of all tied groups at once, each around its own pivot.
        while len(open_):
            own = at[open_]
            edges = np.flatnonzero(np.diff(group[open_], prepend=-1))
            sizes = np.diff(np.append(edges, len(open_)))
            pivot = own[np.repeat(edges + rng.integers(0, 1 << 31, len(edges)) % sizes, sizes)]
            move = _MOVE[own % STEP, pivot % STEP]
            side = np.sign(self.rank[own + move] - self.rank[pivot + move])
            turn = np.lexsort((side, np.repeat(np.arange(len(edges)), sizes)))
            at[open_] = own[turn]
            side = side[turn]
            base = np.repeat(edges, sizes)
            begin = np.ones(len(open_), bool)
            begin[1:] = (side[1:] != side[:-1]) | (base[1:] != base[:-1])
            begin_at = np.flatnonzero(begin)
            group[open_] = open_[np.maximum.accumulate(np.where(begin, np.arange(len(open_)), 0))] + len(starts)
            part = np.diff(np.append(begin_at, len(open_)))
            open_ = open_[np.repeat((part > 1) & (side[begin_at] != 0), part)]
        new = np.zeros(len(at), bool)
        new[:1] = True
        for k in [*range(0, self.length - 7, 8), self.length - 8]:
            w = self.words(at + k)
            new[1:] |= w[1:] != w[:-1]
        return at, new

    def buckets(self, starts: np.ndarray) -> Iterator[np.ndarray]:
        """starts by suffix buckets: ranges of the first eight bytes with about SUFFIXES suffixes each."""
        parts = -(-len(starts) // SUFFIXES)
        if parts < 2:
            yield starts
            return
        first = self.words(starts)
        splitters = np.unique(np.sort(first[:: max(1, len(first) // (64 * parts))])[::64])
        bucket = np.searchsorted(splitters, first, "right").astype(np.uint16)
        order = np.argsort(bucket, kind="stable")
        edges = np.flatnonzero(np.diff(bucket[order].astype(np.int64), prepend=-1))
        for a, z in zip(edges, np.append(edges[1:], len(order))):
            yield starts[order[a:z]]


def _sorter(length: int):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one shard's stretches the suffixes whose first `length` bytes an earlier place has, by bucket and text."""
        out, parts, data = [], [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["sure"]:
                    out.append((r["bucket"], r["texts"], r["counts"], r["starts"], r["ends"], r["tops"]))
                    continue
                of, start, end = placed([r[c] for c in ("texts", "counts", "starts", "ends", "tops")])
                new = np.flatnonzero(np.diff(of, prepend=-1))
                ids = np.repeat(np.cumsum(np.frombuffer(r["ids"], np.int64)), np.diff(np.append(new, len(of))))
                parts.append((ids, np.full(len(of), r["bucket"]), of, start, end - start, np.frombuffer(r["least"], np.uint64), np.frombuffer(r["mark"], np.uint64), np.frombuffer(r["own"], bool)))
                data.append(r["data"])
        if parts:
            found = [np.concatenate(x) for x in zip(*parts)]
            parts.clear()
            raw = b"".join(data)
            data.clear()
            out += verdict_rows(*_repeats(*found, raw, length))
        yield from table(out, VERDICT).to_batches()

    return grouped


def _repeats(ids, bucket, of, start, size, least, mark, own, raw, length):
    """(bucket, text, start, end) of what an earlier place of the shard's stretches has."""
    begins = np.cumsum(size) - size
    order = np.lexsort((start, of, bucket, ids))
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    same = np.empty(len(order), np.int64)
    same[order] = order[equal_to(raw, begins[order], size[order], mark[order])]
    late = same != np.arange(len(order))
    gone = [[bucket[late], of[late], start[late], (start + size)[late]]]
    # A least hash that one stretch alone has, and that this one has once, needs no sorting.
    first = np.flatnonzero(~late)
    first = first[np.argsort(least[first], kind="stable")]
    new = np.append(True, least[first][1:] != least[first][:-1])
    edges = np.flatnonzero(new[: len(first)])
    each = np.diff(np.append(edges, len(first)))
    if len(first):
        first = first[np.repeat((each > 1) | np.logical_or.reduceat(own[first], edges), each)]
    spot = (place[first] << 32) | start[first]  # places of stretches are in order of theirs
    for which, inside in _late(np.frombuffer(raw, np.uint8), begins[first], size[first], least[first], spot, length):
        who = first[which]
        gone.append([bucket[who], of[who], start[who] + inside, start[who] + inside + length])
    return [np.concatenate(x) for x in zip(*gone)]


def _late(data: np.ndarray, begins: np.ndarray, size: np.ndarray, least: np.ndarray, spot: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(stretch, offset) of suffixes of stretches whose first `length` bytes a suffix of an earlier spot has.

    Stretches are given by least hash; spot is where each one's first suffix stands in the order of all places."""
    new = np.append(True, least[1:] != least[:-1])
    total, cut = np.cumsum(size), np.append(np.flatnonzero(new[: len(least)]), len(least))
    at = 0
    while at < len(least):
        z = int(np.searchsorted(total, (total[at - 1] if at else 0) + RANGE, "right"))
        z = int(max(cut[np.searchsorted(cut, z, "right") - 1], cut[np.searchsorted(cut, at, "right")]))
        text, ends = _cut(data, begins[at:z], size[at:z]), np.cumsum(size[at:z])
        base, count = ends - size[at:z], size[at:z] - length + 1
        suffixes = np.repeat(base, count) + _each(count)
        cover = CoverRanks(text, length)
        for some in cover.buckets(suffixes):
            found, begin = cover.sorted_bucket(some)
            stretch = np.searchsorted(base, found, "right") - 1
            inside = found - base[stretch]
            own = spot[at + stretch] + inside
            edge = np.flatnonzero(begin)
            hit = own > np.repeat(np.minimum.reduceat(own, edge), np.diff(np.append(edge, len(own))))
            yield at + stretch[hit], inside[hit]
        at = z


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True, hot: int = HOT) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]): each text's UTF-8 bytes without repeated strings of `length` bytes.

    A byte goes if such a string of its text covers it that also starts at an earlier place (a smaller id, or the same
    text before; they may overlap); strings are judged on the input and never cross texts. Null text counts as empty;
    texts shorter than length stay whole. kept is binary, as a cut may split a character. A null id comes after all
    others; rows of one id with different texts come in an order of their hashes. Rows repeated are one place: none
    removes from the other. An empty table gives an empty result. hot: places from which on a least hash is split (the
    result is the same)."""
    if not 64 <= length <= 160:
        raise ValueError("length is 64 to 160")
    small_batches(docs.sparkSession)
    dealt = Dealt.of(docs, id_col, text_col)
    shape = Shape.of(2 * dealt.size // (length - STEP))
    answers = dealt.sketched(lambda b: _Stretches(b, length).seen, shape, hot)
    found = _candidates(dealt, answers, length, shape, shards_for(docs.sparkSession, dealt.size))
    verdicts = found.groupBy("shard").applyInArrow(_sorter(length), VERDICT)
    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text

    def applied(b: Bucket, answers: pa.Table) -> pa.Table:
        out = []
        for ident, text, spans in zip(b.ids.tolist(), b.texts, spans_of(answers, len(b.texts))):
            kept, end = [], 0
            for a, z in spans:
                kept.append(text[end:a])
                end = z
            whole = b"".join([*kept, text[end:]])
            out.append((ident, len(text), len(text) - len(whole), len(spans), hashlib.sha256(whole).hexdigest(), *[whole] * with_text))
        return table(out, schema).take(pa.array(b.row))

    out = dealt.with_answers(verdicts, applied, schema)
    return out.withColumn("id", F.when(F.col("id") != 2**63 - 1, F.col("id")))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see suffix_dedup for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return suffix_dedup(docs, with_text=False).withColumnRenamed("id", "doc_id")
