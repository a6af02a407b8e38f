"""The metric join against brute force."""

import random

import numpy as np
import pytest

from terrafold.llm import common, metric, minhash
from test_dedup import brute_components

SCHEMA = "doc_id long, text string"


def components(df, **more):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in metric.near_components(df, **more).collect()}


def expected(texts, size=3, percent=90):
    want, sizes = brute_components(texts, size, percent)
    return {k: (sizes[k], want[k]) for k in texts}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (2, 80)])
def test_components(docs, rows, size, percent):
    assert components(docs, size=size, percent=percent) == expected({i: t for i, t, *_ in rows}, size, percent)


def edited(rnd, words, n, tag):
    out = list(words)
    for k in rnd.sample(range(len(out)), n):
        kind = rnd.random()
        out[k] = f"{tag}e{k}" if kind < 0.6 else "" if kind < 0.8 else f"{out[k]} {tag}i{k}"
    return [w for x in out for w in x.split()]


@pytest.mark.parametrize(("leaf", "pivots", "common_least"), [(512, 8, 1), (9, 3, 0.1)])
def test_families_of_edits(spark, monkeypatch, leaf, pivots, common_least):
    """Edited copies of texts of 8 to 400 words, a passage that a third of all texts share, chains, and texts around each limit."""
    monkeypatch.setattr(metric, "LEAF", leaf)
    monkeypatch.setattr(metric, "PIVOTS", pivots)
    monkeypatch.setattr(metric, "COMMON_SHARE", common_least)
    rnd = random.Random(leaf)
    texts = {}
    passage = [f"p{k}" for k in range(60)]
    for b in range(36):
        n = rnd.choice([8, 11, 12, 13, 20, 33, 60, 150, 400])
        base = [f"b{b}w{rnd.randint(0, 3 * n)}" for _ in range(n)] + (passage if b % 3 == 0 else [])
        for c in range(rnd.randint(1, 7)):
            texts[len(texts)] = " ".join(edited(rnd, base, min(len(base), rnd.randint(0, 1 + len(base) // 40)), f"{b}c{c}"))
    chain = [f"k{k}" for k in range(300)]
    for i in range(14):
        texts[1000 - i] = " ".join(chain[4 * i :] + [f"t{k}" for k in range(4 * i)])
    ten = [f"q{k}" for k in range(21)]
    texts |= {2000: " ".join(ten), 2001: " ".join([*ten[:-1], "other"]), 2002: " ".join([*ten, "x", "y"]), 2003: " ".join(ten[:-2])}
    want = expected(texts)
    assert 30 < len({c for _, c in want.values()}) < 0.8 * len(texts)
    assert components(spark.createDataFrame(list(texts.items()), SCHEMA)) == want


def test_classes_keep_every_link():
    """Sets that differ in as many items as a link allows agree in a part that both are known by."""
    rnd = np.random.default_rng(5)
    classes = metric.Classes(90)
    for n in [9, 10, 11, 13, 14, 19, 27, 28, 40, 79, 80, 112, 500, 3000]:
        for share in (0, 0.3, 0.9):
            for _ in range(20):
                x = rnd.integers(0, 2**63, n).astype(np.uint64)
                gone = int(rnd.integers(0, n // 9 + 1))
                more = rnd.integers(0, 2**63, n // 9 - gone).astype(np.uint64)
                y = np.concatenate((x[gone:], more))
                if 100 * (n - gone) < 90 * (n + len(more)):
                    continue
                h = np.concatenate((x, y))
                rare = np.concatenate((np.arange(n) >= share * n, np.arange(gone, gone + len(y)) >= share * n))
                key, of = metric._part_keys(h, rare, np.array([len(x), len(y)]), classes)
                assert len(y) == n == gone or np.array_equal(x, y) or set(key[of == 0]) & set(key[of == 1]), (n, share, gone)


def test_nulls_repeats_and_empty(spark, none):
    assert metric.near_components(none).collect() == []
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, t, 1), (None, t, 2), (7, t, 3), (7, t, 3), (3, t + " x", 4), (9, "", 5), (8, None, 6), (5, "a b", 7), (4, "A  B", 8)], SCHEMA + ", component_id int")
    found = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in metric.near_components(df).collect())
    assert found == [("3", 29, "3"), ("4", 1, "4"), ("5", 1, "4"), ("7", 28, "3"), ("7", 28, "3"), ("8", 0, "8"), ("9", 0, "9"), ("None", 28, "None"), ("None", 28, "None")]


def test_rows_of_ids_by_a_bitmap(spark):
    ids = common.checkpoint(spark.range(0, 9000, 3).withColumnRenamed("id", "doc_id"))
    rows = spark.range(-50, 9050).selectExpr("if(id % 1000 = 7, null, id) as doc_id", "id as text")
    for few in (0, 100_000):
        kept = {r.text for r in common.with_ids(rows, ids, few).collect()}
        assert kept == {k for k in range(0, 9000, 3) if k % 1000 != 7}
        assert {r.text for r in common.without_ids(rows, ids, few).collect()} == set(range(-50, 9050)) - kept
    hits = common._hit(rows, ids, "doc_id", 3000).where("_hit").count()
    assert 3000 <= hits + 9 and hits < 3700


def test_near_duplicates_past_few(spark, docs, rows, monkeypatch):
    monkeypatch.setattr(minhash, "FEW", 0)
    want, _ = brute_components({i: t for i, t, *_ in rows}, 5)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(docs, 5).collect()} == want
    assert sorted(r.doc_id for r in minhash.dedup(docs).collect()) == sorted(i for i in want if want[i] == i)
