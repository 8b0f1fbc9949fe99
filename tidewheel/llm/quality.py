"""Document quality by a small convolutional network over bytes, in numpy.

A text is cut into overlapping chunks that together cover it wholly. Each byte has a learned vector, learned filters run
over a chunk's byte windows, and the largest response of each filter stands for the chunk. A document's largest and mean
responses over its chunks are combined into one probability."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import fresh, small_batches


@dataclass(frozen=True)
class NetParams:
    #: Labelled rows to learn from, at most, by a hash of the id; of one text at most so many chunks, chosen by chance.
    max_rows: int = 4_000
    max_chunks: int = 48
    #: Bytes from one chunk's start to the next, width of a filter, and bytes from one window to the next.
    chunk: int = 512
    width: int = 12
    stride: int = 2
    #: Numbers of a byte's vector, and filters.
    dim: int = 8
    filters: int = 32
    epochs: int = 10
    batch: int = 32
    rate: float = 5e-3
    l2: float = 1e-4
    seed: int = 5

    @property
    def span(self) -> int:
        """Bytes of a chunk: windows that start in it end in it, so that neighbours overlap by width - stride."""
        return self.chunk + self.width - self.stride


#: Stands for what lies behind a text's end; its vector is zero.
PAD = 256
#: Chunks that go through the filters at a time.
AT_ONCE = 64


def chunked(text: bytes, p: NetParams) -> np.ndarray:
    """(chunks, p.span) byte numbers: every byte of the text is in one chunk at least; an empty text is one chunk of padding."""
    n = max(1, -(-len(text) // p.chunk))
    data = np.full((n - 1) * p.chunk + p.span, PAD, np.int16)
    raw = np.frombuffer(text, np.uint8)[: len(data)]
    data[: len(raw)] = raw
    return np.lib.stride_tricks.sliding_window_view(data, p.span)[:: p.chunk]


class ByteNet:
    """Parameters by name: bytes (257, dim), filters (width * dim, filters), bias, out (2 * filters), level."""

    def __init__(self, p: NetParams, values: dict[str, np.ndarray]):
        self.p, self.values = p, values

    @classmethod
    def fresh(cls, p: NetParams, share: float) -> ByteNet:
        rng = np.random.default_rng(p.seed)
        values = {
            "bytes": rng.normal(0, 0.5, (257, p.dim)), "filters": rng.normal(0, (2 / (p.width * p.dim)) ** 0.5, (p.width * p.dim, p.filters)),
            "bias": np.zeros(p.filters), "out": rng.normal(0, 0.05, 2 * p.filters), "level": np.array([np.log(share / (1 - share))]),
        }
        values["bytes"][PAD] = 0
        return cls(p, {k: v.astype(np.float32) for k, v in values.items()})

    def windows(self, chunks: np.ndarray) -> np.ndarray:
        """(chunks, windows, width * dim): what the filters see."""
        p, v = self.p, self.values["bytes"][chunks]
        n = p.chunk // p.stride
        step = v.strides[1]
        view = np.lib.stride_tricks.as_strided(v, (len(v), n, p.width * p.dim), (v.strides[0], p.stride * step, v.itemsize))
        return np.ascontiguousarray(view)

    def pooled(self, chunks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each chunk the largest response of each filter, from 0 on, and at which window."""
        out = np.empty((len(chunks), self.p.filters), np.float32)
        at = np.empty((len(chunks), self.p.filters), np.int32)
        for k in range(0, len(chunks), AT_ONCE):
            got = self.windows(chunks[k : k + AT_ONCE]) @ self.values["filters"]
            at[k : k + AT_ONCE] = got.argmax(1)
            out[k : k + AT_ONCE] = np.take_along_axis(got, at[k : k + AT_ONCE, None, :], 1)[:, 0]
        return np.maximum(out + self.values["bias"], 0), at

    def largest(self, chunks: np.ndarray) -> np.ndarray:
        """pooled() without the places."""
        out = [(self.windows(chunks[k : k + AT_ONCE]) @ self.values["filters"]).max(1) for k in range(0, len(chunks), AT_ONCE)]
        return np.maximum(np.concatenate(out) + self.values["bias"], 0)

    def combined(self, pooled: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, 2 * filters) largest and mean responses over each document's chunks, and the probabilities."""
        starts = np.cumsum(counts) - counts
        both = np.concatenate([np.maximum.reduceat(pooled, starts), np.add.reduceat(pooled, starts) / counts[:, None]], 1)
        z = both @ self.values["out"] + self.values["level"][0]
        return both, 1 / (1 + np.exp(-np.clip(z, -30, 30)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A long text is worked on in pieces of whole chunks, so memory is bounded by the texts themselves."""
        if not texts:
            return np.empty(0)
        pooled, counts = [], []
        pieces, held = [], 0

        def flush():
            nonlocal held
            if pieces:
                pooled.append(self.largest(np.concatenate(pieces)))
                pieces.clear()
                held = 0

        for t in texts:
            some = chunked(t, self.p)
            counts.append(len(some))
            for k in range(0, len(some), AT_ONCE):
                pieces.append(some[k : k + AT_ONCE])
                held += len(pieces[-1])
                if held >= AT_ONCE:
                    flush()
        flush()
        return self.combined(np.concatenate(pooled), np.array(counts))[1].astype(float)

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean logistic loss; only the windows that gave a largest response learn."""
        p, v = self.p, self.values
        pooled, at = self.pooled(chunks)
        both, probability = self.combined(pooled, counts)
        err = ((probability - labels) / len(labels)).astype(np.float32)
        back = err[:, None] * v["out"][None, :]
        of = np.repeat(np.arange(len(counts)), counts)
        top = pooled == both[of, : p.filters]
        d = back[of, p.filters :] / counts[of][:, None] + top * back[of, : p.filters]
        d *= pooled > 0
        k, f = np.nonzero(d)
        d = d[k, f]
        bytes_of = chunks[k[:, None], at[k, f][:, None] * p.stride + np.arange(p.width)]
        seen = v["bytes"][bytes_of].reshape(len(k), -1)
        order = np.argsort(f, kind="stable")
        edges = np.searchsorted(f[order], np.arange(p.filters + 1))
        filters = np.stack([d[order[a:z]] @ seen[order[a:z]] for a, z in zip(edges, edges[1:])], 1)
        to_bytes = (d[:, None] * v["filters"].T[f]).reshape(-1, p.dim)
        flat = bytes_of.ravel()
        emb = np.stack([np.bincount(flat, to_bytes[:, c], 257) for c in range(p.dim)], 1)
        emb[PAD] = 0
        bias = np.bincount(f, d, p.filters)
        return {"bytes": emb, "filters": filters, "bias": bias, "out": err @ both, "level": np.array([err.sum()])}

    @classmethod
    def fit(cls, texts: list[list[bytes]], labels: np.ndarray, p: NetParams) -> ByteNet:
        """Adam over mini-batches. texts: of each row its chunks' bytes. Without rows of both labels the score is constant."""
        share = float((labels.sum() + 0.5) / (len(labels) + 1))
        net = cls.fresh(p, share)
        if not len(labels) or labels.min() == labels.max():
            net.values["out"][:] = 0
            return net
        rng = np.random.default_rng(p.seed + 1)
        one = {k: np.zeros_like(v) for k, v in net.values.items()}
        two = {k: np.zeros_like(v) for k, v in net.values.items()}
        step, steps = 0, p.epochs * -(-len(labels) // p.batch)
        for _ in range(p.epochs):
            order = rng.permutation(len(labels))
            for k in range(0, len(order), p.batch):
                some = order[k : k + p.batch]
                chunks = np.concatenate([np.stack([chunked(c, p)[0] for c in texts[r]]) for r in some])
                grads = net.gradients(chunks, np.array([len(texts[r]) for r in some]), labels[some])
                step += 1
                rate = p.rate * (1 - step / (steps + 1))
                for name, g in grads.items():
                    g = g + p.l2 * net.values[name] * (name in ("filters", "out"))
                    one[name] = 0.9 * one[name] + 0.1 * g
                    two[name] = 0.99 * two[name] + 0.01 * g * g
                    change = rate * (one[name] / (1 - 0.9**step)) / (np.sqrt(two[name] / (1 - 0.99**step)) + 1e-6)
                    net.values[name] = (net.values[name] - change).astype(np.float32)
        return net


def picked(text: bytes, p: NetParams, seed: int) -> list[bytes]:
    """The bytes of a text's chunks, p.max_chunks of them at most."""
    n = max(1, -(-len(text) // p.chunk))
    some = range(n) if n <= p.max_chunks else np.sort(np.random.default_rng(seed).choice(n, p.max_chunks, replace=False)).tolist()
    return [text[k * p.chunk : k * p.chunk + p.span] for k in some]


def train(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> ByteNet:
    """Learns from labelled rows whose crc32(id as text) mod 5 is not 0, at most p.max_rows of them by a hash of the id.

    At most p.max_rows * p.max_chunks chunks reach the driver, which bounds its bytes. Null labels and labels other than 0
    and 1 are no labels; of labels under one id the larger counts, of different texts under one id the one with the smaller
    hash. Null text is empty. Without labelled rows, or with rows of one label only, all texts score alike."""
    small_batches(docs.sparkSession)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    marks = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("id"), F.lit(p.seed)), "id").limit(p.max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    rows = texts.join(F.broadcast(marks), "id")  # at most p.max_rows rows of two numbers

    def cut(batches):
        for b in batches:
            some = [picked(t, p, k) for k, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("hash"), pa.array(some, pa.list_(pa.binary()))], ["id", "label", "hash", "chunks"])

    cuts = rows.select("id", "label", F.xxhash64("text").alias("hash"), "text").mapInArrow(cut, "id long, label int, hash long, chunks array<binary>")
    got = cuts.groupBy("id", "label").agg(F.min_by("chunks", "hash").alias("chunks")).toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    chunks = got.column("chunks").to_pylist()
    return ByteNet.fit([chunks[k] for k in order], got.column("label").to_numpy()[order].astype(np.float32), p)


def score(docs: DataFrame, net: ByteNet, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability that a text is good, as the last column; one of that name goes.

    The whole text counts, whatever its length. Null and empty texts score what one chunk of padding does; repeated rows
    are scored each; an empty table gives an empty result. A task gets the parameters, some 40 KB, by broadcast."""
    if score_col.lower() == text_col.lower():
        raise ValueError("the score can't take the text's column")
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast((net.p, net.values))
    out = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()]).withColumn(score_col, F.lit(None).cast("double"))
    names = out.columns
    at = [c.lower() for c in names].index(text_col.lower())

    def scored(batches):
        own = ByteNet(*model.value)
        for b in batches:
            texts = [t.as_buffer().to_pybytes() if t.is_valid else b"" for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.scores(texts), pa.float64())], names)

    return out.mapInArrow(scored, out.schema)


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score and predicted for every document; held_out marks those whose labels were never looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    net = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, net)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, p: NetParams = NetParams(), least: float = 0.3) -> DataFrame:
    """The documents that score at least `least`, with their columns; see train and score for odd rows."""
    col = fresh(docs, "score")
    return score(docs, train(docs, labels, p), score_col=col).where(F.col(col) >= least).drop(col)
