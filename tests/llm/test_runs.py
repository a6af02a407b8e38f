"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from terrafold.llm import runs

SCHEMA = "doc_id long, text string"


def brute(words, least=6, exponent=4):
    """start, length, period of every run, by trying all periods at all starts."""
    n, found = len(words), {}
    code = {w: k for k, w in enumerate(words)}
    value = np.array([code[w] for w in words])
    for q in range(1, n // exponent + 1):
        same = np.concatenate(([False], value[:-q] == value[q:], [False]))
        edge = np.flatnonzero(same[1:] != same[:-1])
        for i, j in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            if j - i + q >= max(least, exponent * q):
                found.setdefault((i, j - i + q), q)
    return sorted((s, length, q) for (s, length), q in found.items() if not any(q % p == 0 and p < q and (s, length, p) in found for p in range(1, q)))


def collapsed(words, found):
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def planted(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return [w.decode() for w in words]


def found_by_kernel(words, least=6, exponent=4):
    code = {w: k for k, w in enumerate(dict.fromkeys(words))}
    h = np.array([code[w] for w in words], np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    out = runs.runs_of(h, np.zeros(len(words), np.int64), least, exponent)
    return [tuple(r) for r in out[0].tolist()] if out else []


@settings(max_examples=300, deadline=None)
@given(st.text("ab", max_size=60), st.sampled_from([(6, 4), (3, 3), (1, 3), (12, 4), (9, 5)]))
def test_runs_of_two_words(text, limits):
    assert found_by_kernel(list(text), *limits) == sorted(brute(list(text), *limits), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc", min_size=1, max_size=5), st.integers(1, 9)), max_size=8))
def test_runs_of_powers(parts):
    words = list("".join(x * k for x, k in parts))
    assert found_by_kernel(words) == brute(words)


def test_runs_within_runs():
    """A run of short runs, runs that overlap by less than a period, and one that starts with the text."""
    words = list(("aaaaaabb" * 5) + "c" + "abcabcabcabcab" + "dabdabdabdab" + "x" * 3000)
    assert found_by_kernel(words) == brute(words) and len(brute(words)) > 7


def test_query_on_documents(spark, docs, rows, tmp_path):
    rnd = random.Random(4)
    more = [(1000 + i, " ".join(rnd.choice("xyz") for _ in range(rnd.randint(1, 90)))) for i in range(150)]
    more += [(2000, "a " * 40), (2001, "  é é é é é é\n"), (2002, ""), (2003, None), (2004, "\x0b".join(["p", "q"] * 9)), (2005, "w " * 20_000), (2005, "w " * 5)]
    all_ = [(i, t) for i, t, *_ in rows] + more
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in all_) > 10
    spark.createDataFrame([(*r, 9, "mine") for r in all_], SCHEMA + ", n_runs int, collapsed string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in all_:
        words = planted(i, t)
        found = brute(words)
        best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None,) * 3
        text = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
        milli = 1000 * best[1] // best[2] if found else None
        want.append((i, len(found), *best, milli, hashlib.sha256(text.encode()).hexdigest(), hashlib.sha256(collapsed(words, found).encode()).hexdigest()))
    got = [tuple(r) for r in runs.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(r[1] > 0 for r in want) > 30


def test_nulls_and_empty_tables(spark, none):
    assert runs.periodic_runs(none).collect() == []
    df = spark.createDataFrame([(None, "z " * 9), (None, None), (3, "z " * 9)], SCHEMA)
    assert sorted((str(r.doc_id), r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in runs.periodic_runs(df).collect()) == [
        ("3", 9, [(0, 9, 1)], "z"), ("None", 0, [], ""), ("None", 9, [(0, 9, 1)], "z"),
    ]
    with pytest.raises(ValueError, match="three periods"):
        runs.periodic_runs(df, exponent=2)
