import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, rank int, Copy long"


def rows_of(seed=1, n=60):
    """Random texts with copies, near copies, shared passages, long runs, licences, blanks and nulls; extra columns with names that operators use."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 7))) for _ in range(400)]
    passage = " ".join(r.choice(vocabulary) for _ in range(45))
    texts = []
    for k in range(n):
        words = [r.choice(vocabulary) for _ in range(r.randint(0, 120))]
        if k % 7 == 3 and texts:
            words = texts[r.randrange(len(texts))].split(" ")
            if k % 2 and len(words) > 30:
                words[r.randrange(len(words))] = "changed"
        if k % 5 == 2:
            words[len(words) // 2 : len(words) // 2] = passage.split(" ")
        texts.append(" ".join(words))
    texts += ["", " \t\n ", "one", "two words", "a" * 700, "ab" * 300, ("the same line again\n") * 60, "x" * 99, "y" * 100, passage, "MIT\nLicense, and the mit-license. Apache License; GNU General Public License", "é" * 400]
    texts += [texts[-1], texts[0], "word " * 5000 + "end"]
    out = [(k, t, "en", f"src{k % 5 if k % 3 else 0}", len(t), 0.5, "x", 1, 7) for k, t in enumerate(texts)]
    out += [(900, None, None, None, None, None, None, None, None), (901, None, "en", None, 0, None, None, None, None), (None, texts[1], "en", "src1", 0, None, None, None, None), (None, None, None, "", 0, None, None, None, None)]
    out += [out[5], out[5]]  # repeated rows
    r.shuffle(out)
    return out


@pytest.fixture(scope="session")
def rows():
    return rows_of()


@pytest.fixture(scope="session")
def docs(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3).persist()
    df.count()
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
