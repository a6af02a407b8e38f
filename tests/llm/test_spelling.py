"""Spelling variants against brute force."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from terrafold.llm import spelling


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(counts, ratio=2):
    out = []
    form = {}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v.encode()), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def words_of(seed, letters, n, long):
    rnd = random.Random(seed)
    made = {"".join(rnd.choice(letters) for _ in range(rnd.randint(5, long))) for _ in range(n)}
    for w in rnd.sample(sorted(made), len(made) // 3):
        k = rnd.randrange(len(w))
        made |= {w[:k] + w[k + 1 :], w[:k] + rnd.choice(letters) + w[k:], w[:k] + rnd.choice(letters) + w[k + 1 :]}
    return {w: rnd.choice([3, 3, 4, 6, 8, 12, 50]) for w in made if len(w) >= 5}


@pytest.mark.parametrize(("letters", "n", "long", "often"), [("ab", 150, 9, 100), ("ab", 150, 9, 0), ("abcdeé", 250, 12, 3), ("a", 30, 40, 5), ("xyzß", 120, 7, 1)])
def test_variants(spark, letters, n, long, often):
    counts = words_of(n, letters, n, long)
    df = spark.createDataFrame(list(counts.items()), "word string, n long").withColumn("form", F.lit(1)).withColumn("gram", F.lit(2))
    found = [tuple(r) for r in spelling.variants(df, often=often).collect()]
    assert sorted(found, key=str) == brute(counts)
    assert any(r[1] for r in found)


def test_forms_in_a_chain_and_ties(spark):
    counts = {"aaaaa": 3, "aaaaab": 6, "aaaaabb": 12, "zzzzz": 3, "zzzzy": 6, "zzzzx": 6, "ééééé": 3}
    found = sorted([tuple(r) for r in spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long")).collect()], key=str)
    assert found == brute(counts)
    by = {r[0]: r for r in found}
    assert by["aaaaa"][1:3] == ("aaaaab", "aaaaabb") and by["zzzzz"][1] == "zzzzx" and by["ééééé"][1:] == (None, "ééééé", 3, 0, None)
    assert spelling.variants(spark.createDataFrame([], "word string, n long")).collect() == []


def cut(doc_id, run):
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    k = h % len(run)
    return run[:k] + run[k + 1 :] if h % 97 == 0 else run


def test_query_on_documents(spark, docs, rows, tmp_path):
    more = [(1000 + i, "Paragraph PARAGRAPHS über-Größe×Maß don't ÜBERS überS ÀÉîõü Ābcdef paragraf" * 3) for i in range(300)]
    all_ = [(i, t) for i, t, *_ in rows] + more
    df = spark.createDataFrame([*all_, (None, "paragraph nulls nulls nulls nulls")], "doc_id long, text string").withColumn("run", F.lit("x")).withColumn("n", F.lit(0))
    df.repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    counts = collections.Counter()
    for i, t in [*all_, (None, "paragraph nulls nulls nulls nulls")]:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            low = "".join(c.lower() if c < "\x80" else c for c in run)
            counts[cut(i, low) if i is not None else low] += 1
    kept = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    found = [tuple(r) for r in spelling.op12_spelling_variants(spark, str(tmp_path)).collect()]
    assert sorted(found, key=str) == brute(kept)
    assert any(r[1] for r in found) and "nulls" in kept
