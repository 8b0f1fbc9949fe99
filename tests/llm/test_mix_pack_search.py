import tracemalloc
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tidewheel.llm import mixing, neighbours, packing
from tidewheel.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_targets():
    got = mixing.targets({"b": 10, "a": 10, None: 10, "c": 70})
    # a 5, b 2, c 1, null 5 of 13: a and null stop at 30, and c and b share what is left.
    assert got == {"a": 30, None: 30, "b": Fraction(80, 3), "c": Fraction(40, 3)} and sum(got.values()) == 100
    assert mixing.targets({}) == {} and mixing.targets({"a": 0, "b": 4}) == {"a": 0, "b": 4}


def test_the_fit_of_a_very_long_text_is_bounded_in_bytes():
    """Lengths 1 to 1,000, 100 of each, and one text of ten million words: three bytes a sum, not a set of sums a step."""
    lengths = {n: 100 for n in range(1, 1001)} | {10_000_000: 1}
    tracemalloc.start()
    took = mixing.fit_budget(lengths, 45_000_000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(n * k for n, k in took.items()) == 45_000_000 and all(0 < k <= lengths[n] for n, k in took.items())
    assert peak < 200 << 20


def test_fit_budget():
    r = random.Random(1)
    for _ in range(60):
        lengths = {r.randint(1, 30): r.randint(1, 4) for _ in range(r.randint(1, 6))}
        total = sum(n * c for n, c in lengths.items())
        budget = r.randint(0, total)
        took = mixing.fit_budget(lengths, budget)
        assert all(0 < k <= lengths[n] for n, k in took.items())
        sums = {sum(n * k for n, k in zip(lengths, ks)) for ks in itertools.product(*[range(c + 1) for c in lengths.values()])}
        miss = abs(sum(n * k for n, k in took.items()) - budget)
        # Never further off than the best by more than the shortest length.
        assert miss <= max(min(abs(s - budget) for s in sums), min(lengths)), (lengths, budget, took)
    big = {n: 10_000 + n for n in range(1, 3000)}
    budget = sum(n * c for n, c in big.items()) // 3 + 1
    assert sum(n * k for n, k in mixing.fit_budget(big, budget).items()) == budget


def test_mix(docs, rows, none):
    got = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = mixing.targets(sizes)
    assert Counter((r["id"], r["source"], r["size"]) for r in got) == Counter((r[0], r[3], len(WORD.findall(r[1] or ""))) for r in rows)
    taken, longest = Counter(), Counter()
    for r in got:
        assert 0 <= r["copies"] <= 3 and r["source_size"] == sizes[r["source"]] and r["target"] == float(target[r["source"]])
        taken[r["source"]] += r["size"] * r["copies"]
        longest[r["source"]] = max(longest[r["source"]], r["size"])
    for s in sizes:
        assert abs(taken[s] - target[s]) <= max(1, longest[s] / 2), s
    assert mixing.mix(none).count() == 0


def test_mixed_documents(docs, none):
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns and mixing.mixed_documents(none).count() == 0
    copies = {r["id"]: r["copies"] if r["size"] else 1 for r in mixing.mix(docs).collect() if r["id"] is not None and r["id"] != 5}
    got = Counter(r["doc_id"] for r in out.collect())
    for k, n in copies.items():
        if list(copies).count(k) == 1:
            assert got[k] == n, k


def test_mixed_documents_of_one_id(spark):
    """Texts of one id have copies of their own, and the words taken come near the targets."""
    r = random.Random(3)
    rows = [(k % 40, " ".join(["w"] * r.randint(1, 30)) + f" {k}", ["a", "b", None][k % 3]) for k in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes, taken = Counter(), Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    for x in mixing.mixed_documents(docs).collect():
        taken[x["source"]] += len(x["text"].split())
    target = mixing.targets(sizes)
    assert all(abs(taken[s] - target[s]) <= 16 for s in sizes)


def test_pack_counts():
    r = random.Random(2)
    for _ in range(200):
        cap = r.choice([10, 30, 100])
        counts = {r.randint(1, cap): r.randint(1, 50) for _ in range(r.randint(0, 12))}
        bins = packing.pack_counts(counts, cap)
        held = Counter()
        for b in bins:
            assert b.n > 0 and sum(b.lengths) <= cap and b.gap == cap - sum(b.lengths) and sum(3 * n > cap for n in b.lengths) <= 2
            for n in b.lengths:
                held[n] += b.n
        assert held == Counter(counts)
        used, whole = sum(b.n for b in bins), sum(n * c for n, c in counts.items())
        items = sorted((n for n, c in counts.items() for _ in range(c)), reverse=True)
        gaps = []
        for n in items:  # first fit decreasing
            k = next((k for k, g in enumerate(gaps) if g >= n), None)
            if k is None:
                gaps.append(cap - n)
            else:
                gaps[k] -= n
        assert -(-whole // cap) <= used <= len(gaps) + max(1, len(gaps) // 20)
    assert packing.pack_counts({}, 10) == []


@pytest.fixture(scope="module")
def ids_of():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids + [2]


def test_tokenizer_equals_the_file(ids_of):
    fast = packing.tokenizer()
    r = random.Random(3)
    texts = ["", " ", "  a", "a  b", "a \n b", " \n\n x", "a\t b ", "x<|endoftext|> y", "it's we'll 123,456 ñandú ¼² Ⅷ 漢字 　wide  no", "a  b", "word\n", "\nword"]
    texts += ["".join(r.choice(" \n\tab1.é'²") for _ in range(r.randint(0, 60))) for _ in range(500)]
    for t in texts:
        assert np.frombuffer(fast(t), "<u4").tolist() == ids_of(t)[:-1], repr(t)


def test_pack(docs, rows, none, ids_of):
    out = packing.pack(docs, capacity=64, with_ids=True).collect()
    places, per_doc = defaultdict(list), defaultdict(list)
    for p in out:
        assert 0 < p["length"] <= 64 and len(p["ids"]) == 4 * p["length"] and p["ids_crc32"] == zlib.crc32(p["ids"])
        places[p["sequence_id"]].append((p["offset"], p["length"]))
        per_doc[p["id"]].append(p)
    for some in places.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 64
    expect = defaultdict(list)
    for r in rows:
        expect[r[0]].append(ids_of(r[1] or ""))
    for ident, docs_ids in expect.items():
        pieces = per_doc[ident]
        assert sum(p["length"] for p in pieces) == sum(map(len, docs_ids))
        if len(docs_ids) == 1:
            pieces.sort(key=lambda p: p["piece"])
            assert [p["piece"] for p in pieces] == list(range(len(pieces)))
            assert np.frombuffer(b"".join(p["ids"] for p in pieces), "<u4").tolist() == docs_ids[0]
            assert [p["start"] for p in pieces] == np.cumsum([0, *[p["length"] for p in pieces]])[:-1].tolist()
            assert all(p["length"] == 64 for p in pieces[1:])
            assert len(pieces) == 1 or len(docs_ids[0]) > 64
    assert packing.pack(none).count() == 0
    named = packing.packed_documents(docs)
    assert named.select("doc_id", "copy", "piece").distinct().count() == named.count() == packing.pack(docs).count()


def _vectors(spark, n=900, d=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, d))
    x = centres[rng.integers(0, 30, n)] + 0.4 * rng.normal(size=(n, d))
    x[5] = x[25]
    x[40] *= 5
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * d), (1040, [float("nan")] * d), (1060, [None] * d), (1080, [float("inf")] + [0.0] * (d - 1)), (None, [1.0] * d), (60, x[60].tolist()), (2000, [1.0, 2.0]), (2020, [3.0, 1.0])]
    return x, spark.createDataFrame(rows, "vec_id long, embedding array<double>")


def test_nearest(spark):
    x, table = _vectors(spark)
    for shard, least in ((16_384, 8_192), (200, 8_192), (16_384, 100)):
        got = defaultdict(list)
        for r in neighbours.nearest(table.repartition(4), p=neighbours.SearchParams(shard=shard, least=least)).collect():
            got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
        assert sorted(got) == [*range(0, 900, 20), 2000, 2020]
        hits = 0
        for q in range(0, 900, 20):
            best = sorted(got[q])
            assert [r for r, _, _ in best] == list(range(1, 21)) and q not in [v for _, v, _ in best]
            assert all(s == pytest.approx(float(x[v] @ x[q])) for _, v, s in best)
            assert [(-s, v) for _, v, s in best] == sorted((-s, v) for _, v, s in best)
            scores = x @ x[q]
            scores[q] = -np.inf
            hits += len(set(np.argsort(-scores, kind="stable")[:20].tolist()) & {v for _, v, _ in best})
        assert hits / (45 * 20) >= 0.9
        assert got[2000] == [(1, 2020, 5.0)]
    assert neighbours.nearest(table.limit(0)).count() == 0


def test_components(spark):
    r = random.Random(5)
    edges = [(k, k + 1) for k in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(40)] + [(500, 500)]
    parent = {v: v for e in edges for v in e}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    got = {x["u"]: x["v"] for x in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {v: root(v) for v in parent if root(v) != v}
