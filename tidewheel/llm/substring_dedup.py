"""Substring dedup by words: a Count-min prefilter, then exact groups of the windows it estimates repeated."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import shards_for, small_batches
from tidewheel.llm.rounds import VERDICT, Bucket, Dealt, placed, places, spans_of, table, verdict_rows
from tidewheel.llm.sketch import Shape, repeated
from tidewheel.llm.words import Words

WINDOW = 20
#: Bytes of text whose words are told apart at a time.
BLOCK = 2 << 20


def windows_of(b: Bucket, n: int, *lanes: int) -> list[np.ndarray]:
    """(text, first word, a hash for each lane) of every window of n words of a bucket's texts, in order of places."""
    parts = []
    for first, texts in b.blocks(BLOCK):
        of, at, *hashes = Words(texts).windows(n, *lanes)
        parts.append(((of + first).astype(np.int32), at.astype(np.int32), *hashes))
    if not parts:
        return [np.empty(0, np.int32)] * 2 + [np.empty(0, np.uint64)] * len(lanes)
    return [np.concatenate(x) for x in zip(*parts)]


def later(h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Of windows in order of places, which ones an earlier one equals in both hashes."""
    order = np.argsort(h1, kind="stable")
    a, b = h1[order], h2[order]
    same = a[1:] == a[:-1]
    if (same & (b[1:] != b[:-1])).any():  # equal in one hash only: the second one has to sort too
        order = np.lexsort((h2, h1))
        a, b = h1[order], h2[order]
        same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    out = np.zeros(len(h1), bool)
    out[order[1:][same]] = True
    return out


#: Windows of a bucket for one shard of hashes, by place; or, where sure, spans that are known to be repeats.
_FOUND = "shard int, sure boolean, bucket int, texts binary, counts binary, starts binary, ends binary, tops binary, ids binary, h1 binary, h2 binary"


def _candidates(dealt: Dealt, answers: DataFrame, n: int, shape: Shape, shards: int) -> DataFrame:
    """Windows estimated repeated, by hash shard in one row a bucket; of those equal within a bucket only the first.

    The later ones are known to be repeats: they come as spans, in rows that are sure."""

    def found(b: Bucket, answers: pa.Table) -> pa.Table:
        of, at, h1, h2 = windows_of(b, n, 0, 1)
        hit = np.flatnonzero(repeated(h1, answers, shape))
        of, at, h1, h2 = of[hit], at[hit].astype(np.int64), h1[hit], (h2[hit] >> np.uint64(32)).astype(np.uint32)
        late = later(h1, h2)
        known = np.full(int(late.sum()), b.number)
        out = [(b.number % shards, True, *row, b"", b"", b"") for row in verdict_rows(known, of[late], at[late], at[late] + n)]
        first = np.flatnonzero(~late)
        shard = ((h1[first] >> np.uint64(32)) % np.uint64(shards)).astype(np.int64)
        order = np.argsort(shard, kind="stable")
        first, shard = first[order], shard[order]
        edges = np.flatnonzero(np.diff(shard, prepend=-1))
        for a, z in zip(edges, np.append(edges[1:], len(shard))):
            mine = first[a:z]
            texts, counts, starts, tops = places(of[mine], at[mine])
            ids = np.diff(b.ids[np.unique(of[mine])], prepend=0)  # ascending
            out.append((int(shard[a]), False, b.number, texts, counts, starts, b"", tops, ids.tobytes(), h1[mine].tobytes(), h2[mine].tobytes()))
        return table(out, _FOUND)

    return dealt.with_answers(answers, found, _FOUND)


def _grouper(n: int):
    def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one shard's windows all but the first of each group, by bucket and text."""
        sure, parts = [], []
        for batch in batches:
            for r in batch.to_pylist():
                if r["sure"]:
                    sure.append((r["bucket"], r["texts"], r["counts"], r["starts"], r["ends"], r["tops"]))
                    continue
                of, at = placed([r[c] for c in ("texts", "counts", "starts", "tops")])
                new = np.flatnonzero(np.diff(of, prepend=-1))
                ids = np.cumsum(np.frombuffer(r["ids"], np.int64))
                parts.append((np.repeat(ids, np.diff(np.append(new, len(of)))), np.full(len(of), r["bucket"]), of, at, np.frombuffer(r["h1"], np.uint64), np.frombuffer(r["h2"], np.uint32)))
        if parts:
            ids, bucket, of, at, h1, h2 = (np.concatenate(x) for x in zip(*parts))
            parts.clear()
            order = np.lexsort((at, of, bucket, ids))
            gone = order[later(h1[order], h2[order])]
            sure += verdict_rows(bucket[gone], of[gone], at[gone], at[gone] + n)
        yield from table(sure, VERDICT).to_batches()

    return grouped


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]): each text without the words of repeated windows.

    A word goes if a window of `window` words of its text covers it whose words also start at an earlier place (a
    smaller id, or the same text before); windows are judged on the input. Texts are dealt into buckets once. Each bucket
    counts its windows in a Count-min sketch; the shards of the merged sketch answer every bucket. Then windows that are
    estimated repeated, and there is no repeated one that is not, are grouped by 96 bits of hashes that mix the words' own
    128-bit hashes: among 10^13 windows the chance of any two different ones in one group is below 0.001.
    A bucket sends a window once however often it holds it, so a frequent window does not fill a task.
    Null text counts as empty; texts shorter than a window stay whole. A null id comes after all others; rows of one id
    with different texts come in an order of their hashes. Rows repeated are one place: none removes from the other.
    An empty table gives an empty result."""
    small_batches(docs.sparkSession)
    dealt = Dealt.of(docs, id_col, text_col)
    shape = Shape.of(dealt.size // 6)
    answers = dealt.sketched(lambda b: windows_of(b, window, 0)[2], shape)
    found = _candidates(dealt, answers, window, shape, shards_for(docs.sparkSession, dealt.size))
    verdicts = found.groupBy("shard").applyInArrow(_grouper(window), VERDICT)
    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text

    def applied(b: Bucket, answers: pa.Table) -> pa.Table:
        out = []
        for ident, text, spans in zip(b.ids.tolist(), b.texts, spans_of(answers, len(b.texts))):
            words = text.split()
            kept, end = [], 0
            for a, z in spans:
                kept += words[end:a]
                end = z
            kept += words[end:]
            whole = b" ".join(kept)
            out.append((ident, len(words), len(words) - len(kept), hashlib.sha256(whole).hexdigest(), *[whole.decode("utf-8", "replace")] * with_text))
        return table(out, schema).take(pa.array(b.row))

    out = dealt.with_answers(verdicts, applied, schema)
    return out.withColumn("id", F.when(F.col("id") != 2**63 - 1, F.col("id")))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see substring_dedup for nulls, empty texts, ties, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs, with_text=False).withColumnRenamed("id", "doc_id")
