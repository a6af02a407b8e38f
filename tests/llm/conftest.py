import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus_rows(n=60, seed=3):
    """Random texts with exact and near copies, shared passages, very short, empty, null and one very long text."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passage = text(70)
    out = [text(rnd.randint(30, 200)) for _ in range(n)]
    out += [out[3]] * 5 + [out[4] + " " + text(2), out[4].replace(" ", "\n", 1), text(20) + " " + passage + " " + text(20), passage, text(5) + passage]
    out += ["", None, "a", "one two", "one two", " \t\n", "x" * 300, "ab" * 200, out[5] + "\n" + out[5], " ".join([out[6]] * 3), text(30_000)]
    sources = ["s1", "s1", "s1", "s2", None, "ä"]
    return [(i, t, None if i % 7 == 0 else "en", sources[i % len(sources)], None if t is None else len(t)) for i, t in enumerate(out)]


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
