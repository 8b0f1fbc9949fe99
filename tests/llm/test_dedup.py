import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from tidewheel.llm import exact_dedup, near_join, rounds, substring_dedup, suffix_dedup
from tidewheel.llm.rounds import placed, places, spans_of, table, verdict_rows
from tidewheel.llm.sketch import TOLD, Shape, answered, often, packed, repeated, told, unpacked
from tidewheel.llm.words import Words, loads, mixed, runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 2**63


def order(row):
    return LAST if row[0] is None else row[0]


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def repeats(sequences, n, key):
    """For each (id, sequence), which elements windows of n cover that another row's or an earlier own place has, ids in order."""
    first, out = {}, []
    for ident, s in sequences:
        for k in range(len(s) - n + 1):
            place = (ident, k)
            w = key(s[k : k + n])
            first[w] = min(first.get(w, place), place)
    for ident, s in sequences:
        gone = [False] * len(s)
        for k in range(len(s) - n + 1):
            if first[key(s[k : k + n])] < (ident, k):
                gone[k : k + n] = [True] * n
        out.append((ident, s, gone))
    return out


def ident_of(row):
    """Rows of one id with different texts are apart; repeated rows are one."""
    return order(row), row[1] or ""


def test_exact_dedup(docs, rows, none, spark):
    got = exact_dedup.exact_dedup(docs, exact_dedup.new_index(spark), "a").collect()
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expect = Counter((r[0], sha(r[1] or ""), best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""]) for r in rows)
    assert Counter((r["id"], bytes(r["digest"]).hex(), r["keep_id"], r["group_size"], r["kept"]) for r in got) == expect
    assert exact_dedup.exact_dedup(none, exact_dedup.new_index(spark), "a").count() == 0


def test_index_persists_and_does_not_append_twice(spark, tmp_path):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, 4, "first_name")
    exact_dedup.exact_dedup(make([(1, "a"), (2, "b"), (3, "a")]), first, "one").count()
    spark.sql("DROP TABLE first_name")
    again = exact_dedup.DigestIndex(spark, path, 4, "second_name")
    got = {r["id"]: r["kept"] for r in exact_dedup.exact_dedup(make([(4, "a"), (5, "c"), (6, "c")]), again, "two").collect()}
    assert got == {4: False, 5: False, 6: True}
    got = {r["id"]: r["kept"] for r in exact_dedup.exact_dedup(make([(4, "a"), (5, "c"), (6, "c")]), again, "two").collect()}
    assert got == {4: False, 5: False, 6: True} and again.rows().count() == 3
    plan = again.rows().join(again.rows().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_interrupted_batches_and_compaction(spark, tmp_path):
    make = lambda rows: exact_dedup.digests_of(spark.createDataFrame(rows, "doc_id long, text string"))
    path = f"file://{tmp_path}/index"
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.add(make([(1, "a"), (2, "b")]), "one")
    # What a broken append leaves: rows of a batch that is not registered.
    part = make([(3, "c"), (4, "d")]).selectExpr("digest", "id AS keep_id", "1L AS group_size", "'two' AS batch").limit(1)
    index._write(part, "batch-broken")
    assert index.rows().count() == 2
    index.add(make([(3, "c"), (4, "d"), (5, "a")]), "two")
    before = sorted(map(str, index.rows().collect()))
    assert len(before) == 4
    index.compact()
    index.drop_unused()
    again = exact_dedup.DigestIndex(spark, path, 4, "compacted")
    assert sorted(map(str, again.rows().collect())) == before and len(set(again._registered()[1].values())) == 1
    again.add(make([(9, "d"), (9, "e")]), "three")
    again.add(make([(9, "f")]), "two")  # is there already
    assert again.rows().count() == 5


def test_batches_meet_an_index_that_is_not_empty(docs, rows, none, spark):
    groups = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    best = {t: max((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    expect = Counter((r[0], sha(r[1] or ""), best[r[1] or ""], len(groups[r[1] or ""]), r[0] == best[r[1] or ""]) for r in rows)
    for parts in (1, 3):
        index = exact_dedup.new_index(spark)
        got = exact_dedup.dedup_in_batches(docs, index, parts).collect()
        assert Counter((r["id"], bytes(r["digest"]).hex(), r["keep_id"], r["group_size"], r["kept"]) for r in got) == expect
        assert index.rows().select("batch").distinct().count() == parts
    assert exact_dedup.dedup_in_batches(none, exact_dedup.new_index(spark)).count() == 0


def test_unique_documents(docs, rows, none):
    got = exact_dedup.unique_documents(docs)
    assert got.columns == docs.columns and exact_dedup.unique_documents(none).count() == 0
    kept = [(r["doc_id"], r["text"] or "") for r in got.collect()]
    assert sorted(t for _, t in kept) == sorted({r[1] or "" for r in rows})
    for t in {r[1] or "" for r in rows}:
        ids = [r[0] for r in rows if (r[1] or "") == t and r[0] is not None]
        assert (max(ids, default=None), t) in kept


def thue_morse(n):
    """Two strings of 2^n bytes that all polynomial hashes modulo 2^64 confuse from n = 10 on."""
    a, b = b"a", b"b"
    for _ in range(n):
        a, b = a + b, b + a
    return a.decode(), b.decode()


def test_words_and_hashes():
    texts = [b" a  bb\tccc ", b"", b"bb", "é\n".encode()]
    words = Words(texts)
    assert [bytes(words.data[a:z]) for a, z in zip(words.starts, words.ends)] == [b"a", b"bb", b"ccc", b"bb", "é".encode()]
    assert words.of.tolist() == [0, 0, 0, 2, 3] and words.counts.tolist() == [3, 0, 1, 1]
    r = random.Random(4)
    some = [t[:k].encode() for k in (8, 9, 63, 200, 255, 256, 257, 1024) for t in thue_morse(10)] + ["".join(r.choice("ab") for _ in range(r.choice([1, 2, 8, 9, 16, 17, 40]))).encode() for _ in range(2000)]
    for lane in (0, 1):
        h = words.hashes(lane)
        assert h[1] == h[3] and len(set(h.tolist())) == 4
        h = Words([b" ".join(some)]).hashes(lane)
        assert len(set(zip(some, h.tolist()))) == len(set(h.tolist())) == len(set(some))
        for n in (1, 2, 3, 5, 20):
            values = np.array([r.randrange(3) for _ in range(400)], np.uint64)
            got, strings = runs(values, n, lane).tolist(), [tuple(values[k : k + n].tolist()) for k in range(400 - n + 1)]
            assert len(set(zip(got, strings))) == len(set(got)) == len(set(strings))
        assert len(runs(np.zeros(3, np.uint64), 4, lane)) == 0


def test_sketch_misses_no_repeat(spark):
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 50_000, dtype=np.uint64)
    h = np.append(h, h[:7000])
    rng.shuffle(h)
    values, counts = np.unique(h, return_counts=True)
    twice = values[counts > 1]
    shape = Shape.of(len(h))
    parts = np.array_split(h, 5)
    rows = [r for k, x in enumerate(parts) for r in told(k, x, shape).to_pylist()]
    answers = answered(spark.createDataFrame([tuple(r.values()) for r in rows], TOLD).repartition(3), shape).toArrow()
    for k, x in enumerate(parts):
        hit = repeated(x, answers.filter(pc.equal(answers["bucket"], k)), shape)
        again = np.isin(x, twice)
        assert hit[again].all() and hit[~again].mean() < 0.3
    for numbers in ([], [0], [0, 127, 128, 300, 20_000, 3_000_000, 2**32 - 1, 2**61], [-(2**63), -5, 0, 2**63 - 1]):
        assert unpacked(packed(np.array(numbers, np.int64))).tolist() == numbers


def test_hot_hashes_are_hot_in_every_bucket(spark):
    rng = np.random.default_rng(2)
    common = rng.integers(0, 2**63, 3, dtype=np.uint64)
    parts = [np.concatenate([rng.integers(0, 2**63, 9000, dtype=np.uint64), np.repeat(common, [n, 40, 9])]) for n in (900, 0, 1, 300)]
    shape = Shape.of(40_000)
    rows = [r for k, x in enumerate(parts) for r in told(k, x, shape, True).to_pylist()]
    answers = answered(spark.createDataFrame([tuple(r.values()) for r in rows], TOLD).repartition(3), shape, 100).toArrow()
    for k, x in enumerate(parts):
        hit = often(x, answers.filter(pc.equal(answers["bucket"], k)), shape)
        assert set(x[hit].tolist()) == set(common[:2].tolist()) & set(x.tolist())


def test_verdicts_come_back_as_joined_spans():
    r = random.Random(6)
    rows = [(r.randrange(3), r.randrange(4), a, a + r.randint(1, 9)) for a in (r.randrange(60) for _ in range(80))]
    cut = [verdict_rows(*(np.array(c) for c in zip(*some))) for some in (rows[:30], rows[30:])]
    for bucket in range(3):
        answers = table([x for part in cut for x in part if x[0] == bucket], "bucket int, texts binary, counts binary, starts binary, ends binary, tops binary")
        for of, spans in enumerate(spans_of(answers, 4)):
            held = {k for b, o, a, z in rows if (b, o) == (bucket, of) for k in range(a, z)}
            assert {k for a, z in spans for k in range(a, z)} == held
            assert all(y[0] > x[1] for x, y in zip(spans, spans[1:]))
    of, at = np.array([0, 0, 4, 9, 9]), np.array([7, 9, 0, 3, 2**20])
    assert [x.tolist() for x in placed(places(of, at))] == [of.tolist(), at.tolist()]
    assert verdict_rows(*[np.empty(0, np.int64)] * 4) == [] and spans_of(table([], "bucket int, texts binary"), 2) == [[], []]


def test_substring_dedup(docs, rows, none):
    got = Counter((r["id"], r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"]) for r in substring_dedup.substring_dedup(docs).collect())
    seqs = [(ident_of(r), WORD.findall(r[1] or "")) for r in rows]
    expect = Counter()
    for r, (_, words, gone) in zip(rows, repeats(seqs, 20, tuple)):
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        expect[r[0], len(words), sum(gone), sha(kept), kept] += 1
    assert sum(x[2] for x in expect) > 0
    # Rows without an id come last, by text hash among themselves: only their number is fixed here.
    known = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None})
    assert known(got) == known(expect) and sum(got.values()) == len(rows)
    assert substring_dedup.substring_dedup(none).count() == 0


def test_suffix_dedup(docs, rows, none):
    got = Counter((r["id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.suffix_dedup(docs).collect())
    seqs = [(ident_of(r), (r[1] or "").encode()) for r in rows]
    expect = Counter()
    for r, (_, data, gone) in zip(rows, repeats(seqs, 100, bytes)):
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(g and not p for g, p in zip(gone, [False, *gone]))
        expect[r[0], len(data), sum(gone), spans, sha(kept)] += 1
    known = lambda c: Counter({k: n for k, n in c.items() if k[0] is not None})
    assert known(got) == known(expect) and sum(got.values()) == len(rows)
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffixes_of_a_hot_hash_are_split(spark, docs, rows):
    """One 32-byte string in a third of the texts, each time in other surroundings, and a passage that begins with it."""
    r = random.Random(8)
    text = lambda n: bytes(r.choice(b"abcdefghijklmnop ") for _ in range(n))

    def hash_of(t):
        eight = loads(np.frombuffer(t, np.uint8))
        return int(mixed(sum(eight[8 * k : 8 * k + 1] * suffix_dedup._WEIGHTS[k] for k in range(4)))[0])

    common = min((text(32) for _ in range(6000)), key=hash_of)  # the least hash of nearly all strings around it
    passage, made = common + text(170), []
    for k in range(1500):
        t = text(r.randint(150, 500))
        at = r.randrange(len(t))
        made.append((k, (t[:at] + (passage if k % 30 == 0 else common) + t[at:] if k % 3 == 0 else t).decode()))
    made += [(k, made[r.randrange(1500)][1][: r.randint(120, 400)]) for k in range(1500, 1560)]
    df = spark.createDataFrame(made, "doc_id long, text string").repartition(4)
    expect = Counter((k, sum(gone), sha(bytes(b for b, g in zip(t, gone) if not g))) for k, t, gone in repeats([(k, t.encode()) for k, t in made], 100, bytes))
    for hot in (40, 60_000):
        got = Counter((x["id"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.suffix_dedup(df, hot=hot).collect())
        assert got == expect
    dealt, shape = rounds.Dealt.of(df, "doc_id", "text"), Shape.of(20_000)

    def loads_of(hot):
        answers = dealt.sketched(lambda b: suffix_dedup._Stretches(b, 100).seen, shape, hot)
        found = suffix_dedup._candidates(dealt, answers, 100, shape, 8)
        return sorted(x[1] for x in found.where("not sure").selectExpr("shard", "length(data) AS n").groupBy("shard").sum("n").collect())

    even, uneven = loads_of(40), loads_of(60_000)
    assert uneven[-1] > 3 * uneven[len(uneven) // 2] and even[-1] <= 3 * even[len(even) // 2]
    # Every hash hot: all suffixes go by the second sketch.
    plain = Counter(map(str, suffix_dedup.suffix_dedup(docs).collect()))
    assert Counter(map(str, suffix_dedup.suffix_dedup(docs, hot=2).collect())) == plain


def test_difference_cover_and_suffix_order(monkeypatch):
    v = suffix_dedup.STEP
    assert {(a - b) % v for a in suffix_dedup.COVER for b in suffix_dedup.COVER} == set(range(v))
    r = random.Random(2)
    for alphabet in ("a", "ab", "abcdefgh"):
        data = "".join(r.choice(alphabet) for _ in range(900)).encode() * 2
        starts = np.array(r.sample(range(len(data) - 100), 600))
        cover = suffix_dedup.CoverRanks(np.frombuffer(data, np.uint8), 100)
        at, new = cover.sorted_bucket(starts)
        assert sorted(at.tolist()) == sorted(starts.tolist())
        groups = np.cumsum(new)
        strings = [data[k : k + 100] for k in at]
        assert len(set(strings)) == groups[-1] and len(set(zip(strings, groups.tolist()))) == groups[-1]
        monkeypatch.setattr(suffix_dedup, "SUFFIXES", 50)
        parts = list(cover.buckets(starts))
        assert sorted(np.concatenate(parts).tolist()) == sorted(starts.tolist()) and (alphabet == "a" or len(parts) > 2)
        tops = [max(data[k : k + 8] for k in part) for part in parts]
        assert all(min(data[k : k + 8] for k in part) > top for part, top in zip(parts[1:], tops))


def test_jaccard_join(docs, rows, none):
    texts = {}
    for k, r in enumerate(rows):
        w = WORD.findall(r[1] or "")
        texts[k] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    links, parent = Counter(), {k: k for k in texts}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in texts:
        for b in texts:
            if a < b and texts[a] and texts[b] and 9 * len(texts[a] & texts[b]) >= 4 * (len(texts[a]) + len(texts[b])):
                links[a] += 1
                links[b] += 1
                x, y = root(a), root(b)
                if (order(rows[x]), x) > (order(rows[y]), y):
                    x, y = y, x
                parent[y] = x
    expect = Counter((rows[k][0], rows[root(k)][0], len(s), links[k]) for k, s in texts.items())
    got = Counter((r["id"], r["class_id"], r["n_shingles"], r["n_links"]) for r in near_join.jaccard_join(docs).collect())
    assert got == expect and max(links.values()) > 1
    assert near_join.jaccard_join(none).count() == 0


def test_near_copies_are_compared_in_blocks(spark):
    r = random.Random(3)
    base = [f"w{r.randrange(500)}" for _ in range(120)]
    rows = []
    for k in range(40):
        words = list(base)
        words[r.randrange(120)] = f"x{k}"
        rows.append((k, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (512, 7):
        got = near_join.jaccard_join(df, p=near_join.JoinParams(block=block)).collect()
        assert all(x["class_id"] == 0 for x in got)
        shingles = [{tuple(t.split()[i : i + 5]) for i in range(116)} for _, t in rows]
        expect = [sum(a is not b and 9 * len(a & b) >= 4 * (len(a) + len(b)) for b in shingles) for a in shingles]
        assert [x["n_links"] for x in sorted(got, key=lambda x: x["id"])] == expect
    kept = near_join.distinct_documents(df)
    assert [x["doc_id"] for x in kept.collect()] == [0]


def test_no_hash_takes_different_texts_for_equal(spark):
    """Strings that a polynomial hash confuses, long words, and repeated rows, by brute force for op1, op4 and op8."""
    a, b = thue_morse(10)
    r, words = random.Random(9), []
    pool = [a, b, a[:256], b[:256], a[:257], b[:257], *(t[k : k + 64] for t in (a, b) for k in (0, 64, 128)), "p", "q", "r"]
    head = " ".join(f"w{k}" for k in range(19))
    rows = [(1, f"{head} {a}"), (2, f"{head} {b}"), (3, f"p q r s {a}"), (4, f"p q r s {b}"), (5, a), (6, b), (7, a + b), (8, b + a)]
    rows += [(k, " ".join(r.choice(pool) for _ in range(r.randint(0, 60)))) for k in range(9, 60)]
    rows += [rows[0], rows[20]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = Counter((x["id"], x["n_removed"], x["kept_sha256"]) for x in substring_dedup.substring_dedup(docs).collect())
    expect = Counter()
    for (ident, _), words, gone in repeats([(ident_of(x), WORD.findall(x[1])) for x in rows], 20, tuple):
        expect[ident, sum(gone), sha(" ".join(w for w, g in zip(words, gone) if not g))] += 1
    assert got == expect and {x[1] for x in got if x[0] in (1, 2)} == {0}
    got = Counter((x["id"], x["n_removed"], x["kept_sha256"]) for x in suffix_dedup.suffix_dedup(docs).collect())
    expect = Counter()
    for (ident, _), data, gone in repeats([(ident_of(x), x[1].encode()) for x in rows], 100, bytes):
        expect[ident, sum(gone), sha(bytes(c for c, g in zip(data, gone) if not g))] += 1
    assert got == expect
    links = {x["id"]: (x["class_id"], x["n_links"]) for x in near_join.jaccard_join(docs).collect()}
    # 1 and 2 share 15 of 17 shingles, and 1 is there twice; all others have nothing in common.
    assert all(links[k] == (k, 0) for k in range(3, 9)) and links[1] == links[2] == (1, 2)


def test_very_long_text_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    monkeypatch.setattr(substring_dedup, "BLOCK", 700)
    r = random.Random(11)
    passage = "".join(r.choice("abc d") for _ in range(400))
    text = "".join(passage if k % 40 == 3 else r.choice(["x", "y ", "zz", passage[k : k + 90]]) for k in range(200))
    b = suffix_dedup._Stretches(rounds.Bucket([pa.record_batch({"bucket": pa.array([0] * 2, pa.int32()), "id": [1, 2], "key": [5, 6], "text": [text.encode(), passage.encode()]})]), 100)
    held = Counter(s + k for s, n in zip(b.start.tolist(), b.count.tolist()) for k in range(n))
    assert held == Counter([*range(len(text) - 99), *range(len(text), len(text) + 301)])
    by_string = {}
    for s, n, h in zip(b.start.tolist(), b.count.tolist(), b.least.tolist()):
        for k in range(s, s + n):
            assert by_string.setdefault(b.raw[k : k + 100], h) == h


def test_distinct_documents_tells_texts_of_one_id_apart(spark):
    base = [f"w{k}" for k in range(60)]
    near = " ".join(["x", *base[1:]])
    rows = [(1, " ".join(base)), (2, near), (2, "all other words"), (2, "all other words"), (3, None), (None, near)]
    kept = near_join.distinct_documents(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], *rows[2:]], key=str)


def test_band_shape():
    bands, per = near_join.band_shape(0.8, 0.9999, 192)
    assert bands * per <= 192 and 1 - (1 - 0.8**per) ** bands >= 0.9999
    with pytest.raises(ValueError):
        near_join.band_shape(0.1, 0.9999, 5)


def shuffled(df, column):
    """The most rows that one exchange of this column sends."""
    top = df._jdf.queryExecution()
    top.toRdd().count()
    nodes, most = [top.executedPlan()], 0
    while nodes:
        node = nodes.pop()
        some = node.children()
        nodes += [some.apply(k) for k in range(some.size())]
        if node.nodeName() == "Exchange" and f"{column}#" in node.output().mkString(","):
            most = max(most, node.metrics().apply("shuffleRecordsWritten").value())
    return most


def test_only_texts_that_may_go_are_shuffled(spark):
    texts = [" ".join(f"w{(k * 7919 + j * j) % 5003}" for j in range(40)) for k in range(2000)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(5000 + k, texts[k]) for k in range(40)] + [(6000 + k, texts[k] + " end") for k in range(50, 90)] + [(None, texts[3]), (None, "alone")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        unique, distinct = exact_dedup.unique_documents(df), near_join.distinct_documents(df)
        sent = [shuffled(unique, "text"), shuffled(distinct, "text")]
        got = sorted(r["doc_id"] for r in unique.where("doc_id is not null").collect())
        assert got == [*range(40, 2000), *range(5000, 5040), *range(6050, 6090)] and unique.where("doc_id is null").count() == 1
        assert sorted(r["doc_id"] for r in distinct.where("doc_id is not null").collect()) == list(range(2000)) and distinct.where("doc_id is null").count() == 2
    finally:
        for name in conf:
            spark.conf.unset(name)
    assert all(0 < n < 400 for n in sent), sent
