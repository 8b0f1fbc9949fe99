"""Licence scans by a positional index of rare words."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewheel.llm.common import small_batches
from tidewheel.llm.licence_texts import BASE, FILES, NAMES, SPDX, TEXTS

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

#: A word of a text stands in its place if it is at most so many words off, as where a name was put in.
SLACK = 8
#: The most that a licence's name alone scores.
NAME = 0.5
#: Words of a key phrase in a whole licence text, and of the stretches that have one each.
PHRASE, STRETCH = 8, 250
#: Words of a key phrase that are looked up before the whole phrase is compared.
RARE = 3


@dataclass
class Phrase:
    """A mandatory key phrase of a template, and the stretch of the template that stands or falls with it."""

    template: int
    start: int
    size: int
    begin: int
    end: int


@dataclass
class Template:
    label: str
    words: list[bytes]
    keys: list[tuple[int, int]]  # start and size of its key phrases, by place
    base: bool = False
    most: float = 1.0  # what the whole template scores

    def phrases(self, number: int) -> list[Phrase]:
        """Its key phrases; a stretch reaches half-way to the neighbouring phrases."""
        edges = [0, *((a + m + b) // 2 for (a, m), (b, _) in zip(self.keys, self.keys[1:])), len(self.words)]
        return [Phrase(number, a, m, *edges[k : k + 2]) for k, (a, m) in enumerate(self.keys)]


def marked(label: str, text: str) -> Template:
    """A template whose key phrases are in brackets."""
    words, keys = [], []
    for k, part in enumerate(re.split(r"[\[\]]", text)):
        found = words_of(part.encode())
        if k % 2:
            keys.append((len(words), len(found)))
        words += found
    return Template(label, words, keys)


def keyed(texts: Iterable[tuple[str, list[bytes]]], others: Iterable[Template] = ()) -> list[Template]:
    """Templates of whole texts, whose key phrases go by a rule: in each stretch of about STRETCH words the PHRASE words in a
    row, found in no text of another label, of which the rarest words stand in the fewest texts."""
    texts = list(texts)
    known = [*texts, *((t.label, t.words) for t in others)]
    grams: dict[tuple, set[str]] = {}
    for label, words in known:
        for k in range(len(words) - PHRASE + 1):
            grams.setdefault(tuple(words[k : k + PHRASE]), set()).add(label)
    spread = Counter(w for _, words in known for w in set(words))
    out = []
    for label, words in texts:
        keys = []
        parts = max(1, round(len(words) / STRETCH))
        for k in range(parts):
            places = range(len(words) * k // parts, len(words) * (k + 1) // parts - PHRASE + 1)
            own = [p for p in places if len(grams[tuple(words[p : p + PHRASE])]) == 1]
            if own:
                keys.append((min(own, key=lambda p: (sorted(spread[w] for w in words[p : p + PHRASE]), p)), PHRASE))
        out.append(Template(label, words, keys))
    return out


def templates(base=BASE, names=NAMES, spdx=SPDX, texts=TEXTS, whole=FILES) -> list[Template]:
    """base: label by phrase; names, spdx: phrases and identifiers by label; texts: by label, with key phrases in brackets;
    whole: files of the folder texts/ by label."""
    phrase = lambda label, text, **more: Template(label, w := words_of(text.encode()), [(0, len(w))], **more)
    out = [phrase(label, p, base=True, most=NAME) for p, label in base.items()]
    out += [phrase(label, p, most=NAME) for label, some in names.items() for p in some]
    out += [phrase(label, f"SPDX-License-Identifier: {x}") for label, some in spdx.items() for x in some]
    out += [marked(label, t) for label, some in texts.items() for t in some]
    folder = files("tidewheel.llm") / "texts"
    read = [(label, (folder / name).read_bytes().partition(b"END OF TERMS AND CONDITIONS")[0]) for label, some in whole.items() for name in some]
    return out + keyed([(label, words_of(t)) for label, t in read], out)


class RareWordIndex:
    """Positional postings of the words of all key phrases.

    A file's licence words are looked up from the highest IDF downwards. A word that is a phrase's rarest opens it, with one
    place for each of its own; the phrase's next words keep the places that they stand beside. As a phrase's words come in
    the same order in every file, postings of its RARE highest are all that a look-up can need, and no phrase that stands in
    the file is lost. What is left is compared word by word."""

    def __init__(self, known: list[Template], idf: dict[bytes, float], rare: int = RARE):
        self.templates, self.idf = known, idf
        self.phrases = [p for k, t in enumerate(known) for p in t.phrases(k)]
        self.mass = [sum(idf[w] for w in t.words) for t in known]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}  # word: (phrase, offset in the template)
        self.opener: list[bytes] = []  # each phrase's rarest word
        for k, p in enumerate(self.phrases):
            words = known[p.template].words
            order = sorted(range(p.start, p.start + p.size), key=lambda o: (-idf[words[o]], words[o], o))[:rare]
            self.opener.append(words[order[0]])
            for o in order:
                self.postings.setdefault(words[o], []).append((k, o))
        self.openers = set(self.opener)

    def matches(self, words: list[bytes]) -> list[tuple[int, int]]:
        """(phrase, place of its template's first word, perhaps before the text) of all places where a key phrase stands."""
        held = self.postings.keys() & set(words)
        if not self.openers & held:
            return []
        places: dict[bytes, set[int]] = {}
        for p, w in enumerate(words):
            if w in held:
                places.setdefault(w, set()).add(p)
        found: dict[int, set[int]] = {}
        for w in sorted(held, key=lambda w: (-self.idf[w], w)):
            for k, o in self.postings[w]:
                if k in found:
                    found[k] = {at for at in found[k] if at + o in places[w]}
                elif w == self.opener[k]:
                    found[k] = {p - o for p in places[w]}
        out = []
        for k, some in found.items():
            p = self.phrases[k]
            key = self.templates[p.template].words[p.start : p.start + p.size]
            out += [(k, at) for at in some if at + p.start >= 0 and words[at + p.start : at + p.start + p.size] == key]
        return out

    def scores(self, words: list[bytes], found: list[tuple[int, int]]) -> float:
        """The largest part of a template, by IDF, of which each word stands at most SLACK words off its place beside its
        stretch's key phrase; of a stretch that stands several times the best place counts, and none without its phrase."""
        best: dict[int, float] = {}
        for k, at in found:
            best[k] = max(best.get(k, 0.0), self._held(words, self.phrases[k], at))
        sums: dict[int, float] = {}
        for k in sorted(best):
            number = self.phrases[k].template
            sums[number] = sums.get(number, 0.0) + best[k]
        return max((self.templates[number].most * min(1.0, s / self.mass[number]) for number, s in sums.items()), default=0.0)

    def _held(self, words: list[bytes], p: Phrase, at: int) -> float:
        """The IDF of the words of p's stretch that stand in their places."""
        near: dict[bytes, list[int]] = {}
        for q in range(max(0, at + p.begin - SLACK), min(len(words), at + p.end + SLACK)):
            near.setdefault(words[q], []).append(q)
        own = self.templates[p.template].words
        return sum(self.idf[own[o]] for o in range(p.begin, p.end) if any(abs(q - at - o) <= SLACK for q in near.get(own[o], ())))


def words_of(text: bytes) -> list[bytes]:
    """Words of a text in UTF-8; only A-Z are lower-cased."""
    return _WORD.findall(text.lower())


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: list[Template] | None = None) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row of docs.

    First, document frequencies of the templates' words are counted over all docs; one number a template word reaches
    the driver, so that what is collected and sent to tasks follows the templates, not docs. Then each text's licence words
    are looked up, the rarest first, their postings are intersected by relative position, and the mandatory key phrase is
    verified word by word. Names and SPDX lines are templates that are all key phrase; of an SPDX expression the first
    identifier counts. A licence text of several key phrases is labelled by any of them, each of which no other licence has.
    score is the largest part, by IDF, of a verified template that stands in its place (names: at most NAME); 0 for none.
    Null text counts as empty: no words, empty labels, null places. Rows repeated are scanned each; an empty table gives an
    empty result."""
    small_batches(docs.sparkSession)
    known = known or templates()
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    vocabulary = {w for t in known for w in t.words}

    def counted(batches):
        seen, n = dict.fromkeys(vocabulary, 0), 0
        for b in batches:
            for t in b.column("text").to_pylist():
                n += 1
                for w in vocabulary.intersection(words_of(t)):
                    seen[w] += 1
        seen[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.binary()), pa.array(seen.values(), pa.int64())], ["word", "n"])

    sums = rows.mapInArrow(counted, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in sums}
    idf = {w: math.log((n.get(b"", 0) + 1) / (n.get(w, 0) + 1)) + 1 for w in vocabulary}
    index = RareWordIndex(known, idf)
    names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]

    def scanned(batches):
        for b in batches:
            out = []
            for ident, t in zip(b.column("id").to_pylist(), b.column("text").to_pylist()):
                words = words_of(t)
                found = index.matches(words)
                named = [(at, known[index.phrases[k].template]) for k, at in found]
                base = [(at, x.label) for at, x in named if x.base]
                places = [at for at, _ in base]
                labels = {x.label for _, x in named}
                score = index.scores(words, found)
                out.append((ident, len(words), len(base), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return rows.mapInArrow(scanned, "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op2_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract columns for every document; see scan for nulls, empty texts, repeated rows and empty tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).withColumnRenamed("id", "doc_id")
