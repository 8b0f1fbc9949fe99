import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewheel.llm import hard_negatives as H
from tidewheel.llm import periodic as P
from tidewheel.llm import quality as Q
from tidewheel.llm.registry import ORACLE_SQL, QUERIES


def runs_by_hand(words):
    """Every maximal run, by comparing words."""
    n, out = len(words), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(6, 4 * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def kept_by_hand(words, runs):
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    return [w for k, w in enumerate(words) if k not in gone]


def test_runs_are_those_of_comparing_words():
    r = random.Random(3)
    for _ in range(600):
        n, letters = r.randint(0, 90), r.choice([1, 2, 2, 3, 5])
        words = [r.randrange(letters) for _ in range(n)]
        if r.random() < 0.6 and n:
            start, p = r.randrange(n), r.randint(1, 12)
            words[start:] = [words[min(n - 1, start + j % p)] for j in range(n - start)]
            for _ in range(r.randint(0, 2)):
                words[r.randrange(n)] = r.randrange(letters)
        assert [tuple(x) for x in P.runs_of(P.named([b"%d" % w for w in words])).tolist()] == runs_by_hand(words)


def test_many_runs_of_one_period_and_a_very_long_text():
    words = [b"x"] * 7 + [b"y"]
    found = P.runs_of(P.named([w for k in range(50) for w in [*words, b"%d" % k]]))
    assert [tuple(x) for x in found.tolist()] == [(9 * k, 7, 1) for k in range(50)]
    names = np.arange(1_000_000) % 1000
    assert P.runs_of(names.astype(np.int32)).tolist() == [[0, 1_000_000, 1000]]
    assert P.runs_of(np.zeros(1_000_000, np.int32)).tolist() == [[0, 1_000_000, 1]]
    with pytest.raises(ValueError):
        P.runs_of(names, turns=2)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        return [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def test_collapse_by_brute_force(docs, rows, none):
    out = P.collapse_runs(docs.select("doc_id", "text", "rank", F.lit("z").alias("Runs")))
    assert out.columns == ["doc_id", "text", "rank", "runs", "kept_text"]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "", tuple(map(tuple, r["runs"])), r["kept_text"]) for r in out.collect())
    want = []
    for r in rows:
        words = (r[1] or "").encode().split()
        runs = runs_by_hand(words)
        want.append((-1 if r[0] is None else r[0], r[1] or "", tuple(runs), b" ".join(kept_by_hand(words, runs)).decode()))
    assert got == sorted(want)
    assert P.collapse_runs(none).count() == 0
    with pytest.raises(ValueError):
        P.collapse_runs(docs, runs_col="text")


def test_op12_by_brute_force(spark, docs, rows, tmp_path):
    more = spark.createDataFrame([(k, " ".join(f"w{j % 97}" for j in range(k % 300)), "en", "s", 0, 0.0, "", 0, 0) for k in range(2000, 2200)], docs.schema)
    docs.unionByName(more).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(-1 if x is None else x for x in r) for r in QUERIES["op12_periodic_runs"](spark, str(tmp_path)).collect())
    want, some = [], 0
    for k, text, *_ in [*rows, *more.collect()]:
        words = planted(k, text)
        runs = runs_by_hand(words)
        some += bool(runs)
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        digest = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
        kept = hashlib.sha256(b" ".join(kept_by_hand(words, runs))).hexdigest()
        want.append((-1 if k is None else k, len(runs), *(best or (-1, -1, -1)), 1000 * best[1] // best[2] if best else -1, digest, kept))
    assert got == sorted(want) and some > 8


def _labelled(spark, n=700, seed=4):
    """Good texts, and bad ones that are good ones with a passage of shouted or marked words somewhere."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(500)]
    rows = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(1, 300))]
        bad = k % 3 == 0
        if bad:
            at = r.randrange(len(words))
            words[at:at] = [w.upper() + "!!" if k % 2 else w + "&&&" for w in r.choices(vocabulary, k=12)]
        rows.append((k, " ".join(words), int(not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int")


def test_gradients_are_those_of_the_loss():
    p = Q.NetParams(chunk=32, width=6, dim=3, filters=5)
    net = Q.ByteNet.fresh(p, 0.6)
    net.values = {k: v.astype(np.float64) for k, v in net.values.items()}
    texts = [b"some text that is longer than one chunk of bytes", b"short", b"a third one, of other words, and longer still than both of the others are"]
    chunks, counts = np.concatenate([Q.chunked(t, p) for t in texts]), np.array([len(Q.chunked(t, p)) for t in texts])
    labels = np.array([1, 0, 1], np.float32)

    def loss():
        probability = net.combined(net.pooled(chunks)[0], counts)[1]
        return -np.mean(np.where(labels == 1, np.log(probability), np.log(1 - probability)))

    grads = net.gradients(chunks, counts, labels)
    for name, at in (("out", 2), ("out", 7), ("bias", 1), ("level", 0), ("filters", (4, 2)), ("filters", (11, 0)), ("bytes", (ord("t"), 1))):
        kept = net.values[name][at]
        net.values[name][at] = kept + 1e-3
        up = loss()
        net.values[name][at] = kept - 1e-3
        down = loss()
        net.values[name][at] = kept
        assert grads[name][at] == pytest.approx((up - down) / 2e-3, abs=2e-4)


def test_chunks_cover_the_text_and_score_alike_however_cut():
    p = Q.NetParams()
    for n in (0, 1, 511, 512, 513, 522, 1024, 5000):
        text = bytes(random.Random(n).randrange(256) for _ in range(n))
        chunks = Q.chunked(text, p)
        whole = np.concatenate([*[c[: p.chunk] for c in chunks[:-1]], chunks[-1]])
        assert bytes(whole[:n].astype(np.uint8)) == text and (whole[n:] == Q.PAD).all()
        assert [bytes(c[c != Q.PAD].astype(np.uint8)) for c in chunks] == Q.picked(text, p, 0) if len(chunks) <= p.max_chunks else True
    net = Q.ByteNet.fresh(p, 0.5)
    texts = [b"x" * 100_000, b"", b"abc" * 700]
    assert net.scores(texts) == pytest.approx([net.scores([t])[0] for t in texts], abs=1e-6)
    assert len(Q.picked(b"x" * 10**6, p, 1)) == p.max_chunks


def test_quality_on_held_out_rows_and_odd_rows(spark, docs, none):
    table = _labelled(spark).persist()
    net = Q.train(table.select("doc_id", "text"), table.select("doc_id", "quality"), Q.NetParams(epochs=14))
    held = Q.score(table, net).where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0").collect()
    assert len(held) > 100 and sum((r["score"] >= 0.3) == r["quality"] for r in held) / len(held) > 0.93
    got = Q.score(docs, net)
    assert got.columns[-1] == "score" and got.columns.count("score") == 1
    found = got.collect()
    assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
    blank = [r["score"] for r in found if not r["text"]]
    assert len(blank) > 3 and len(set(blank)) == 1
    assert Q.score(none, net).count() == 0
    # A passage behind a very long good text is seen.
    good = "and then the same words come again " * 30_000
    pair = spark.createDataFrame([(1, good), (2, good + "SHOUTED!! WORDS!! ARE!! WHAT!! THIS!! TEXT!! ENDS!! WITH!!")], "doc_id long, text string")
    a, b = (r["score"] for r in Q.score(pair, net).orderBy("doc_id").collect())
    assert b < a
    kept = Q.good_documents(table.select("doc_id", "text"), table.select("doc_id", "quality"))
    assert kept.columns == ["doc_id", "text"] and 0 < kept.count() < table.count()


def test_quality_without_labels_of_both_kinds(spark, docs, none):
    labels = spark.createDataFrame([(k, 1) for k in range(40)] + [(None, 0), (3, None), (4, 7)], "doc_id long, quality int")
    assert Q.train(none, labels).values["out"].any() == False  # noqa: E712
    scores = {r["score"] for r in Q.score(docs, Q.train(docs, labels)).collect()}
    assert len(scores) == 1 and scores.pop() > 0.5
    assert Q.good_documents(docs, labels.limit(0)).count() == docs.count()


def mined_by_hand(rows, every=50, k=5, m=3):
    rows = [(i, c, v) for i, c, v in rows if i is not None and c is not None and v is not None and None not in v]
    out = []
    for i, c, v in rows:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, y)), j, d) for j, d, y in rows if j != i)
        for s, j, _ in [x for x in scored if x[2] == c][:k]:
            some = [x for x in scored if x[2] != c and 50 * -s <= 100 * -x[0] <= 95 * -s][:m]
            out += [(i, j, n + 1, x[1], -s, -x[0]) for n, x in enumerate(some)]
    return sorted(out)


@pytest.mark.parametrize("shape", ["spread", "clusters", "ties", "copies", "huge"])
def test_negatives_by_brute_force(spark, shape):
    r = np.random.default_rng(7)
    n, d = 900, 6
    if shape == "spread":
        v = r.integers(-300, 300, (n, d))
    elif shape == "clusters":
        v = r.integers(-900, 900, (12, d))[r.integers(0, 12, n)] + r.integers(-20, 20, (n, d))
    elif shape == "ties":
        v = r.integers(-1, 2, (n, d))
    elif shape == "copies":
        v = np.where(np.arange(n)[:, None] % 3 == 0, 50, r.integers(-300, 300, (n, d)))
    else:
        v = r.integers(-(2**29), 2**29, (n, d))
    rows = [(int(k), int(k % 4), x) for k, x in enumerate(v.tolist())]
    rows += [(5000, None, [1] * d), (5050, 1, None), (5100, 2, [1, 2, None, 4, 5, 6]), (None, 1, [1] * d), (5150, 1, [7]), (5200, 3, [2**40] * d)]
    rows += rows[:5]
    table = spark.createDataFrame([(*x, "e") for x in rows], "vec_id long, label int, v array<long>, block string")
    p = H.MiningParams(block=200, step=16, pivot_rows=40)
    got = sorted(map(tuple, H.hard_negatives(table, p=p).collect()))
    want = mined_by_hand([x for x in dict((x[0], x) for x in rows).values() if x[2] and len(x[2]) == d and x[0] != 5200])
    assert got == want and len(want) > 20
    assert sorted(map(tuple, H.hard_negatives(table, p=H.MiningParams()).collect())) == want


def test_negatives_skip_what_cannot_count():
    r = np.random.default_rng(3)
    centres = r.integers(-4000, 4000, (20, 8))
    v = centres[r.integers(0, 20, 8000)] + r.integers(-30, 30, (8000, 8))
    longest = float((v.astype(float) ** 2).sum(1).max())
    pivots = H.pivots_of(H.lifted(v, longest), 20, 1)
    away = H.distances(H.lifted(v, longest), pivots)
    near = away.argmin(1)
    dist = away[np.arange(len(v)), near]
    order = np.lexsort((dist, near))
    block = H.KeyedBlock(order, near[order] * 0, v[order].astype(float), near[order], dist[order], pivots, longest, 64)
    for k in range(5):
        q = v[k].astype(float)
        best = H.Best(5, -np.inf, np.inf)
        block.search(q, H.distances(np.append(q, 0)[None], pivots)[0], [best], lambda labels, ids: ids != k)
        scores = v @ v[k]
        want = [j for j in np.lexsort((np.arange(len(v)), -scores)) if j != k][:5]
        assert best.ids.tolist() == want and best.scores.tolist() == scores[want].tolist()
    assert block.read < 0.6 * 5 * len(v)


def test_negatives_of_little(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, v array<long>")
    assert H.hard_negatives(empty).count() == 0
    one = spark.createDataFrame([(0, 1, [3, 4])], empty.schema)
    assert H.hard_negatives(one).count() == 0
    two = spark.createDataFrame([(0, 1, [3, 4]), (1, 1, [3, 4]), (2, 2, [2, 2]), (3, 2, [0, 0]), (4, 2, [30, 40])], empty.schema)
    assert list(map(tuple, H.hard_negatives(two).collect())) == [(0, 1, 1, 2, 25, 14)]


def test_op13_is_its_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    r = np.random.default_rng(1)
    rows = [(k, int(k % 10), [float(x) for x in r.normal(0, 0.2, 8)]) for k in range(600)]
    rows += [(1000, 3, None), (1050, 3, [math.nan] * 8), (1100, None, [0.1] * 8), (1150, 2, [math.inf] * 8), (1200, 2, [None] * 8), (None, 1, [0.1] * 8)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    got = QUERIES["op13_hard_negatives"](spark, str(tmp_path))
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert got.columns == names
    want = con.sql(ORACLE_SQL["op13_hard_negatives"]).fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and len(want) > 50
