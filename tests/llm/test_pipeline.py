import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidewheel.llm import mixing, toxicity


def test_stages_and_run(spark, docs, tmp_path):
    docs.where("doc_id is not null").write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 9 == 0)) for k in range(60)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    counts = [now.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        assert now.columns == docs.columns
        counts.append(now.count())
    assert counts[1] <= counts[0] and counts[2] < counts[1] and counts[3] <= counts[2]
    unique = spark.read.parquet(f"{tmp_path}/1")
    assert unique.count() == unique.select(F.coalesce("text", F.lit(""))).distinct().count() == spark.read.parquet(f"{tmp_path}/0").select(F.coalesce("text", F.lit(""))).distinct().count()
    packed = corpus_pipeline.run(spark, str(tmp_path))
    per = packed.groupBy("doc_id").agg(F.count_if(F.col("piece") == 0).alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in per} == {r["doc_id"]: r["n"] for r in now.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}


def test_run_equals_brute_force(spark, rows, tmp_path):
    """Every stage by its rule: all pairs of terms, equal texts, all pairs of shingle sets, targets, tokens."""
    given = [(r[0], f"{r[1]} you nitwit scum", *r[2:]) if r[0] % 4 == 3 and r[0] < 60 else r for r in dict.fromkeys(r for r in rows if r[0] is not None)]
    docs = spark.createDataFrame(given, "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, rank int, Copy long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(k, int(k % 4 == 3)) for k in range(60)], "doc_id long, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    text = {r[0]: r[1] or "" for r in given}
    source = {r[0]: r[3] for r in given}
    p = toxicity.FMParams()
    fm = toxicity.train(docs, labels, p)
    place, left = {int(t): k for k, t in enumerate(fm.terms)}, {}
    for i, t in text.items():
        k = [place[x] for x in toxicity.term_ids(t, (1 << p.bits) - 1) if x in place]
        z = fm.bias + fm.weights[k].sum() + sum(fm.factors[a] @ fm.factors[b] for n, a in enumerate(k) for b in k[:n])
        if z < 0:
            left[i] = t
    assert 0 < len(left) < len(text)
    last = {t: i for i, t in sorted(left.items())}
    left = {i: t for t, i in last.items()}
    sets = {}
    for i, t in left.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            a, b = sets[i], sets[j]
            if i < j and a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                x, y = sorted((root[i], root[j]))
                root = {k: x if v == y else v for k, v in root.items()}
    left = {i: t for i, t in left.items() if root[i] == i}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t in left.items()}
    whole, taken, longest = Counter(), Counter(), Counter()
    for i, n in size.items():
        whole[source[i]] += n
        longest[source[i]] = max(longest[source[i]], n)
    pieces = defaultdict(list)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    for x in out:
        pieces[x["doc_id"], x["copy"]].append(x)
    assert {i for i, _ in pieces} <= set(left) and {i for i, n in size.items() if not n} <= {i for i, _ in pieces}
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (i, c), some in pieces.items():
        assert 1 <= c <= 3
        taken[source[i]] += size[i]
        ids = np.array([*tokenizer.encode(left[i], add_special_tokens=False).ids, 2], "<u4")
        some.sort(key=lambda x: x["piece"])
        assert [x["start"] for x in some] == [0, *np.cumsum([x["length"] for x in some])[:-1]] and sum(x["length"] for x in some) == len(ids)
        assert all(x["ids_crc32"] == zlib.crc32(ids[x["start"] : x["start"] + x["length"]].tobytes()) for x in some)
    for s, target in mixing.targets(whole).items():
        assert abs(taken[s] - target) <= max(1, longest[s] / 2), s
    held = defaultdict(list)
    for x in out:
        held[x["sequence_id"]].append((x["offset"], x["length"]))
    for some in held.values():
        some.sort()
        assert [o for o, _ in some] == [0, *np.cumsum([n for _, n in some])[:-1]] and sum(n for _, n in some) <= 1024


def test_stages_on_an_empty_table(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
