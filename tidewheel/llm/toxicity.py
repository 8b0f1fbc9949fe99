"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text. The pairwise
part learns what linear weights can't, such as an insult beside the mention of a group."""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import fresh, small_batches

_LETTERS = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class FMParams:
    #: Labelled rows to learn from, at most; more are cut by a hash of the id, so the same rows each time.
    max_rows: int = 8_000
    bits: int = 26
    #: Terms are learned that at least min_rows labelled rows have and that tell the labels apart: alone, by least_z
    #: standard errors, or among the rows of another term, by least_pair_z. The others count nothing: tens of thousands
    #: of chance weights would drown the few that matter. The other term is one that tells the labels apart alone, or any
    #: that a share of pair_share of the rows has, as this one then has to: so two words that are neutral each are
    #: found by what they are together, if by least_neutral_z, as tens of millions of such pairs are compared.
    min_rows: int = 6
    least_z: float = 4.0
    least_pair_z: float = 6.0
    least_neutral_z: float = 9.0
    pair_share: float = 0.01
    factors: int = 4
    epochs: int = 16
    rate: float = 0.3
    l2: float = 1e-5
    seed: int = 7


def term_ids(text: str, mask: int) -> list[int]:
    """Hashes of the distinct words and of their first four letters, lower-cased."""
    words = set(_LETTERS.findall(text.lower()))
    stems = {w[:4] + "~" for w in words if len(w) > 4}
    return sorted({zlib.crc32(w.encode("utf-8", "surrogatepass")) & mask for w in words | stems})


def differences(counts: np.ndarray, have: np.ndarray, n: int, ones: float) -> np.ndarray:
    """By how many standard errors the share of rows with a term differs between the labels; 0 where there is nothing to compare.

    counts: rows with the term, have: those of them labelled 1, of n rows of which `ones` are labelled 1."""
    with np.errstate(divide="ignore", invalid="ignore"):
        share = counts / n
        z = (have / ones - (counts - have) / (n - ones)) / np.sqrt(share * (1 - share) * (1 / ones + 1 / (n - ones)))
    return np.nan_to_num(z, posinf=0, neginf=0)


def _apart(c: np.ndarray, h: np.ndarray, n, ones, p: FMParams, least_z: float) -> np.ndarray:
    """Whether terms that c of n rows have, h of the `ones` labelled 1 among them, tell the labels apart.

    A normal deviate says little of small counts, so that the smallest of the four counts that chance would give has to
    reach 1, and the counts are corrected by a half."""
    with np.errstate(divide="ignore", invalid="ignore"):
        chance = c * ones / n
        least = np.minimum(np.minimum(chance, c - chance), np.minimum(ones - chance, n - ones - c + chance))
        nearer = chance + np.sign(h - chance) * np.maximum(np.abs(h - chance) - 0.5, 0)
        return (c >= p.min_rows) & (least >= 1) & (np.abs(differences(c, nearer, n, ones)) >= least_z)


def beside(kept: np.ndarray, at: np.ndarray, of: np.ndarray, labels: np.ndarray, counts: np.ndarray, p: FMParams) -> np.ndarray:
    """Which terms tell the labels apart among the rows of a kept term, whatever they do over all rows.

    at, of: the term and the row of every occurrence."""
    found = np.zeros(len(counts), bool)
    often = counts >= p.min_rows
    use = often[at]
    at, of = at[use], of[use]
    edges = np.searchsorted(of, np.arange(len(labels) + 1))
    by_term = np.argsort(at, kind="stable")
    first = np.searchsorted(at, kept, sorter=by_term)
    for f, k in zip(first, kept):
        has = of[by_term[f : f + counts[k]]]
        n, ones = len(has), labels[has].sum()
        if not 0 < ones < n:
            continue
        pos = [at[edges[r] : edges[r + 1]] for r in has if labels[r]]
        neg = [at[edges[r] : edges[r + 1]] for r in has if not labels[r]]
        h = np.bincount(np.concatenate(pos), minlength=len(counts))
        c = h + np.bincount(np.concatenate(neg), minlength=len(counts))
        found |= _apart(c, h, n, ones, p, p.least_pair_z)
    return found & often


def together(at: np.ndarray, of: np.ndarray, labels: np.ndarray, counts: np.ndarray, p: FMParams, block: int = 512) -> np.ndarray:
    """Which terms tell the labels apart among the rows of any other term, of those that a share of p.pair_share of the rows has.

    All pairs are counted, as products of blocks of the 0/1 matrix of rows and terms."""
    n = len(labels)
    often = np.flatnonzero(counts >= max(p.min_rows, p.pair_share * n))
    place = np.full(len(counts), -1)
    place[often] = np.arange(len(often))
    use = place[at] >= 0
    held = np.zeros((n, len(often)), bool)
    held[of[use], place[at[use]]] = True
    held = held[np.argsort(-labels, kind="stable")]  # rows labelled 1 first
    ones = int(labels.sum())
    with_one = held[:ones].sum(0).astype(float)
    size = counts[often].astype(float)
    found = np.zeros(len(often), bool)
    for a in range(0, len(often), block):
        x, i = held[:, a : a + block].astype(np.float32), slice(a, a + block)
        for b in range(a, len(often), block):
            y, j = held[:, b : b + block].astype(np.float32), slice(b, b + block)
            h = (x[:ones].T @ y[:ones]).astype(float)
            c = h + x[ones:].T @ y[ones:]
            found[j] |= _apart(c, h, size[i, None], with_one[i, None], p, p.least_neutral_z).any(0)
            found[i] |= _apart(c, h, size[None, j], with_one[None, j], p, p.least_neutral_z).any(1)
    out = np.zeros(len(counts), bool)
    out[often] = found
    return out


class FactorizationMachine:
    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.terms, self.bias, self.weights, self.factors = terms, bias, weights, factors
        self.place = {int(t): k for k, t in enumerate(terms)}

    @classmethod
    def fit(cls, rows: list[np.ndarray], labels: np.ndarray, p: FMParams) -> FactorizationMachine:
        """AdaGrad on the logistic loss, in mini-batches; without rows of both labels the score is constant."""
        rng = np.random.default_rng(p.seed)
        share = (labels.sum() + 0.5) / (len(labels) + 1)
        flat = np.concatenate(rows) if rows else np.empty(0, np.int32)
        terms, at, counts = np.unique(flat, return_inverse=True, return_counts=True)
        n, ones = len(labels), labels.sum()
        of = np.repeat(np.arange(n, dtype=np.int32), [len(r) for r in rows])
        have = np.bincount(at, labels[of], len(terms))
        kept = (counts >= p.min_rows) & (np.abs(differences(counts, have, n, ones)) >= p.least_z)
        if 0 < ones < n:
            at = at.astype(np.int32)
            kept = kept | beside(np.flatnonzero(kept), at, of, labels, counts, p) | together(at, of, labels, counts, p)
        terms = terms[kept]
        fm = cls(terms, float(np.log(share / (1 - share))), np.zeros(len(terms) + 1), rng.normal(0, 0.01, (len(terms) + 1, p.factors)))
        fm.factors[-1] = 0
        if not len(terms) or labels.min() == labels.max():
            fm.factors[:] = 0
            return fm
        found = [fm.known(r) for r in rows]
        g_w, g_v, g_b = np.full(len(terms) + 1, 1e-2), np.full((len(terms) + 1, p.factors), 1e-2), 1e-2
        for _ in range(p.epochs):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), 64):
                some = order[at : at + 64]
                sizes = np.array([len(found[k]) for k in some])
                idx = np.concatenate([found[k] for k in some])
                of = np.repeat(np.arange(len(some)), sizes)
                z, sums = fm._raw(idx, of, len(some))
                err = 1 / (1 + np.exp(-z)) - labels[some]
                g_b += float((err**2).sum())
                fm.bias -= p.rate * float(err.sum()) / len(some) / np.sqrt(g_b)
                uniq, back = np.unique(idx, return_inverse=True)
                gw = np.bincount(back, err[of], len(uniq)) + p.l2 * fm.weights[uniq]
                dv = err[of, None] * (sums[of] - fm.factors[idx])
                gv = np.stack([np.bincount(back, dv[:, f], len(uniq)) for f in range(p.factors)], 1) + p.l2 * fm.factors[uniq]
                g_w[uniq] += gw**2
                g_v[uniq] += gv**2
                fm.weights[uniq] -= p.rate * gw / np.sqrt(g_w[uniq])
                fm.factors[uniq] -= 0.1 * p.rate * gv / np.sqrt(g_v[uniq])
        return fm

    def known(self, ids) -> np.ndarray:
        get = self.place.get
        return np.array([k for k in map(get, (int(i) for i in ids)) if k is not None], dtype=np.int64)

    def _raw(self, idx: np.ndarray, of: np.ndarray, n: int):
        """Scores before the sigmoid, and the factor sums, by (sum v)^2 - sum v^2."""
        k = self.factors.shape[1]
        v = self.factors[idx]
        sums = np.stack([np.bincount(of, v[:, f], n) for f in range(k)], 1) if k else np.zeros((n, 0))
        squares = np.bincount(of, (v**2).sum(1), n)
        z = self.bias + np.bincount(of, self.weights[idx], n) + 0.5 * ((sums**2).sum(1) - squares)
        return np.clip(z, -30, 30), sums

    def scores(self, found: list[np.ndarray]) -> np.ndarray:
        if not found:
            return np.empty(0)
        sizes = np.array([len(x) for x in found])
        z, _ = self._raw(np.concatenate(found).astype(np.int64), np.repeat(np.arange(len(found)), sizes), len(found))
        return 1 / (1 + np.exp(-z))


def train(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams(), id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> FactorizationMachine:
    """Learns from labelled rows whose crc32(id as text) mod 5 is not 0, at most p.max_rows of them by a hash of the id.

    What reaches the driver is bounded by p.max_rows. Null labels and labels other than 0 and 1 are no labels; of labels
    under one id the larger counts, of different texts under one id the one with the smaller hash. Null text is empty.
    Without labelled rows, or with rows of one label only, the model scores every text alike."""
    small_batches(docs.sparkSession)
    mask = (1 << p.bits) - 1
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label"))
    marks = marks.where(F.col("id").isNotNull() & F.col("label").isin(0, 1)).where(F.crc32(F.col("id").cast("string").cast("binary")) % 5 != 0)
    marks = marks.groupBy("id").agg(F.max("label").alias("label")).orderBy(F.xxhash64(F.col("id"), F.lit(p.seed)), "id").limit(p.max_rows)
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = texts.join(F.broadcast(marks), "id")  # at most p.max_rows rows of two numbers
    rows = rows.groupBy("id").agg(F.min(F.struct(F.xxhash64("text"), "text", "label")).alias("r")).select("id", "r.text", "r.label")

    def hashed(batches):
        for b in batches:
            terms = [term_ids(t, mask) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(terms, pa.list_(pa.int32()))], ["id", "label", "terms"])

    got = rows.mapInArrow(hashed, "id long, label int, terms array<int>").toArrow()
    order = np.argsort(got.column("id").to_numpy(), kind="stable")
    terms = got.column("terms").combine_chunks()
    edges, values = terms.offsets.to_numpy(), terms.values.to_numpy()
    rows = [values[edges[k] : edges[k + 1]] for k in order]
    return FactorizationMachine.fit(rows, got.column("label").to_numpy().astype(float)[order], p)


def score(docs: DataFrame, fm: FactorizationMachine, p: FMParams = FMParams(), text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col, the probability that a text is toxic, as the last column; one of that name goes.

    Null and empty texts get the bias alone; rows repeated are scored each; an empty table gives an empty result. The
    model that each task gets holds terms that p.min_rows of at most p.max_rows labelled rows share, so its size does not
    grow with docs."""
    if score_col.lower() == text_col.lower():
        raise ValueError("the score can't take the text's column")
    small_batches(docs.sparkSession)
    mask = (1 << p.bits) - 1
    model = docs.sparkSession.sparkContext.broadcast((fm.terms, fm.bias, fm.weights, fm.factors))
    out = docs.drop(*[c for c in docs.columns if c.lower() == score_col.lower()]).withColumn(score_col, F.lit(None).cast("double"))
    names = out.columns
    at = [c.lower() for c in names].index(text_col.lower())

    def scored(batches):
        own = FactorizationMachine(*model.value)
        for b in batches:
            column = b.column(at)
            found = [own.known(term_ids(t or "", mask)) for t in column.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(own.scores(found), pa.float64())], names)

    return out.mapInArrow(scored, out.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """score and predicted for every document; held_out marks those whose labels were never looked at."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    fm = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score(docs, fm)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def clean_documents(docs: DataFrame, labels: DataFrame, p: FMParams = FMParams()) -> DataFrame:
    """The documents that the model does not call toxic, with their columns; see train and score for odd rows."""
    fm = train(docs, labels, p)
    col = fresh(docs, "score")
    return score(docs, fm, p, score_col=col).where(F.col(col) < 0.5).drop(col)
