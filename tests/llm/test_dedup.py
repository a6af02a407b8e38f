"""Near-duplicates, repeat removal and chunk dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.llm import arrays, chunking, minhash, suffix
from terrafold.operators.linked import connected

SCHEMA = "doc_id long, text string"


def brute_set(t, size):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)]) if w else frozenset()


def brute_components(texts, size, percent=80):
    sets = {k: brute_set(t, size) for k, t in texts.items()}
    up = {k: k for k in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                r, s = root(a), root(b)
                up[max(r, s)] = min(r, s)
    return {k: root(k) for k in keys}, {k: len(s) for k, s in sets.items()}


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(docs, rows, size):
    want, sizes = brute_components({i: t for i, t, *_ in rows}, size)
    found = {r.doc_id: r for r in minhash.near_duplicates(docs, size).collect()}
    for i in want:
        assert (found[i].component_id, found[i].n_shingles, found[i].kept) == (want[i], sizes[i], want[i] == i)


def test_near_duplicates_in_chains(spark):
    """Neighbours of a chain are alike, its ends are not; a group of copies hangs at either end; one text is at 0.8 exactly."""
    base = [f"w{k}" for k in range(200)]
    texts = {i: " ".join(base[6 * i :] + [f"t{k}" for k in range(6 * i)]) for i in range(12)}
    texts |= {100 + i: texts[0] for i in range(30)} | {200 + i: texts[11] + f" z{i}" for i in range(30)}
    nine = [f"q{k}" for k in range(10)]
    texts |= {300: " ".join(nine), 301: " ".join(nine[:-1] + ["other"])}  # 8 of 10 shingles of two words are shared
    want, _ = brute_components(texts, 2)
    assert want[300] == want[301] == 300 and len(set(want.values())) == 2
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == want


def test_near_duplicates_nulls_and_repeated_rows(spark, none):
    assert minhash.near_duplicates(none).collect() == []
    t = "one two three four five six seven eight"
    df = spark.createDataFrame([(None, t, 1), (None, t, 2), (7, t, 3), (7, t, 3), (3, t, 4), (9, "", 5), (8, None, 6)], SCHEMA + ", component_id int")
    found = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in minhash.near_duplicates(df).collect())
    assert found == [("3", "3", True), ("7", "3", False), ("7", "3", False), ("8", "8", True), ("9", "9", True), ("None", "None", True), ("None", "None", True)]
    assert sorted(str(r.doc_id) for r in minhash.dedup(df).collect()) == ["3", "8", "9", "None", "None"]


@pytest.mark.parametrize("block", [2048, 7])
def test_near_duplicates_in_a_family_of_edits(spark, monkeypatch, block):
    """One text edited in 0 to 16 places each: many versions are near it, others near no one, a few only near each other."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    rnd = random.Random(12)
    base = [f"w{k}" for k in range(140)]

    def edited(words, n, tag):
        out = list(words)
        for k in rnd.sample(range(len(out)), n):
            out[k] = f"{tag}e{k}"
        return out

    far = edited(base, 14, "f")
    texts = {1000 - i: " ".join(edited(base, i % 17, f"t{i}")) for i in range(90)}
    texts |= {10 + i: " ".join(edited(far, 4, f"u{i}")) for i in range(8)} | {50: " ".join(base), 51: " ".join(base[:120]), 52: " ".join(base[:60])}
    want, _ = brute_components(texts, 2)
    assert 10 < len(set(want.values())) < 70
    df = spark.createDataFrame(list(texts.items()), SCHEMA)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(df, 2).collect()} == want


def test_near_duplicates_of_one_doc_id_with_several_texts(spark, monkeypatch):
    """One of the texts, always the same, stands for the doc_id, whatever the order of rows and the way tables are joined."""
    a, b = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(5, a), (5, b), (5, ""), (7, a), (8, b), (9, a + " x"), (9, a + " x"), (3, None)]
    out = set()
    for few in (1_000_000, 0):
        monkeypatch.setattr(minhash, "FEW", few)
        for order in (rows, rows[::-1]):
            found = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(order, SCHEMA), 2).collect())
            assert len(found) == len(rows)
            out.add(str(found))
    assert len(out) == 1
    got = {(r[0], r[2]) for r in found}
    assert got in ({(5, 5), (7, 5), (8, 8), (9, 5), (3, 3)}, {(5, 5), (7, 7), (8, 5), (9, 7), (3, 3)})
    kept = minhash.dedup(spark.createDataFrame(rows, SCHEMA).withColumn("kept", F.lit("mine")), 2).collect()
    assert len([r for r in kept if r.doc_id == 5]) == 1 and {r.kept for r in kept} == {"mine"}


def test_shingles_of_long_texts_in_pieces():
    rnd = random.Random(2)
    text = " ".join(f"w{rnd.randint(0, 99)}" for _ in range(4000)).encode()
    whole, cut = arrays.words_of([b"a b", text, b"c"]), arrays.words_of([b"a b", text, b"c"], most=1000)
    for k in ("doc", "hash", "start", "stop"):
        assert np.array_equal(getattr(whole, k), getattr(cut, k)), k


def test_connected(spark):
    rnd = random.Random(5)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rnd.randint(0, 60), 100 + rnd.randint(0, 60)) for _ in range(50)] + [(500, 501), (501, 500), (500, 501)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in pairs:
        if a != b:
            r, s = root(a), root(b)
            up[max(r, s)] = min(r, s)
    found = {r.id: r.component for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {k: root(k) for k in up}
    assert connected(spark.createDataFrame([], "a long, b long")).collect() == []


def brute_repeats(texts, n=50):
    first, out = {}, {}
    for i, t in sorted(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - n + 1):
            if first.setdefault(b[p : p + n], i) < i:
                gone[p : p + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[i] = (len(b), sum(gone), sum(1 for s in bytes(gone).split(b"\0") if s), hashlib.sha256(kept).hexdigest())
    return out


def test_repeats(docs, rows):
    want = brute_repeats([(i, t) for i, t, *_ in rows])
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(docs).collect()}
    assert found == want


@pytest.mark.parametrize("seed", range(3))
def test_repeats_with_few_letters(spark, seed):
    """Texts of two letters, with runs, copies, edits and shared stretches around the threshold."""
    rnd = random.Random(seed)
    pool = ["".join(rnd.choice("ab") for _ in range(rnd.randint(40, 120))) for _ in range(12)]
    texts = ["".join(rnd.choice(pool)[rnd.randint(0, 3) :] for _ in range(rnd.randint(1, 6))) for _ in range(60)]
    texts += ["a" * k for k in (49, 50, 51, 99, 200)] + [pool[0][:49], "x" + pool[0][:49] + "y", pool[0][:50] + "é" + pool[1][:50]]
    rows = list(enumerate(texts))
    want = brute_repeats(rows)
    found = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == want


def test_repeats_of_one_doc_id_and_nulls(spark, none):
    t = "".join(chr(97 + k % 26) * (1 + k % 3) for k in range(60))
    df = spark.createDataFrame([(1, t), (1, t), (2, t), (None, t), (None, None), (3, None)], SCHEMA).withColumn("n_bytes", F.lit("x"))
    found = sorted((str(r.doc_id), r.n_bytes, r.n_removed) for r in suffix.remove_repeats(df).collect())
    n = len(t)
    assert found == sorted([("1", n, 0), ("1", n, 0), ("2", n, n), ("None", n, 0), ("None", 0, 0), ("3", 0, 0)])
    assert suffix.remove_repeats(none).collect() == []


def test_repeats_of_large_and_negative_ids(spark):
    t = "".join(chr(97 + k * k % 26) for k in range(80))
    ids = (2**62 + 5, -(2**61), 3, 2**40, 2**62 + 6)
    assert [suffix.room(0, m) for m in (0, 255, 2**62)] == [56, 48, 0]
    found = {r.doc_id: r.n_removed for r in suffix.remove_repeats(spark.createDataFrame([(i, t) for i in ids], SCHEMA)).collect()}
    assert found == {i: 0 if i == min(ids) else 80 for i in ids}


def test_repeats_of_a_line_that_all_texts_share(spark, monkeypatch):
    """Each text has the line in other surroundings; its windows are spread over buckets, and the result is exact."""
    rnd = random.Random(8)
    text = lambda k: "".join(rnd.choice("abcdefghijklmnop ") for _ in range(k))
    line = text(70)
    rows = [(i, text(rnd.randint(20, 60)) + line + text(rnd.randint(0, 60)) + (line[:60] if i % 9 == 0 else "")) for i in range(600)]
    rows += [(600, line), (601, line[:49]), (3, rows[5][1]), (None, line)]
    whole = suffix._windows

    def bounded(table):
        spans = table.num_rows - table.column("span").null_count
        alike = [x for x in table.column("window").to_pylist() if x is not None] if "window" in table.column_names else []
        assert spans <= 200 and len(alike) <= 4 * len(set(alike)), "one bucket has the line of all texts"
        return whole(table)

    monkeypatch.setattr(suffix, "_windows", bounded)
    want = {}
    first = {}
    for i, t in sorted(r for r in rows if r[0] is not None):
        for p in range(len(t) - 49):
            first.setdefault(t[p : p + 50], i)
    for i, t in rows:
        gone = {q for p in range(len(t) - 49) if i is not None and first[t[p : p + 50]] < i for q in range(p, p + 50)}
        want[i, len(t)] = (len(gone), hashlib.sha256("".join(c for q, c in enumerate(t) if q not in gone).encode()).hexdigest())
    for most in (50, 1):
        monkeypatch.setattr(suffix, "HOT", most, raising=False)
        found = {(r.doc_id, r.n_bytes): (r.n_removed, r.kept_sha256) for r in suffix.remove_repeats(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()}
        assert found == want


def test_repeats_go_on_with_long_ranks_only(spark, monkeypatch):
    """Texts that share many strings of 16 to 31 bytes, but none of 32, put next to nothing into the second round; ranks travel in a close code."""
    rnd = random.Random(4)
    pool = ["".join(rnd.choice("abcdefgh") for _ in range(20)) for _ in range(30)]
    rows = [(i, "".join(rnd.choice(pool) + "".join(rnd.choice("stuvwxyz") for _ in range(9)) for _ in range(40))) for i in range(60)]
    made, whole = [], suffix._verdicts
    monkeypatch.setattr(suffix, "_verdicts", lambda c: made.append(c) or whole(c))
    docs = spark.createDataFrame(rows, SCHEMA)
    assert {r.n_removed for r in suffix.remove_repeats(docs).collect()} == {0}
    assert made[0].count() < 200  # chance alone; ranks of 16 bytes made 1,996
    rows = [(100, rows[0][1][:400]), (101, rows[0][1][100:300])]
    found = {r.doc_id: r.n_removed for r in suffix.remove_repeats(docs.unionByName(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert {k: v for k, v in found.items() if v} == {100: 400, 101: 200}
    key = np.unique(np.random.default_rng(1).integers(0, 1 << 40, 5000).astype(np.uint64))
    for low in (1, 13, 40):
        assert (suffix._unbits(suffix._bits(key, low), len(key), low) == key & np.uint64((1 << low) - 1)).all()


def brute_chunks(b):
    h, cuts = 0, [0]
    for p, x in enumerate(b):
        h = ((h << 1) + int(chunking.GEAR[x])) & 0xFFFFFFFF
        if p + 1 >= chunking.REACH and h >> (32 - chunking.CUT_BITS) == 0:
            cuts.append(p + 1)
    cuts = sorted({*cuts, len(b)})
    return [(a, min(a + chunking.MOST, z)) for x, z in zip(cuts, cuts[1:], strict=False) for a in range(x, z, chunking.MOST)]


def test_chunks(docs, rows):
    first, want = {}, {}
    for i, t, *_ in sorted(rows):
        b = (t or "").encode()
        spans = brute_chunks(b)
        assert b"".join(b[a:z] for a, z in spans) == b
        again = [first.setdefault(b[a:z], (i, a)) != (i, a) for a, z in spans]
        kept, k = b"", 0
        while k < len(spans):
            e = k + 1
            while e < len(spans) and again[e] == again[k]:
                e += 1
            piece = b[spans[k][0] : spans[e - 1][1]]
            kept += b"" if again[k] and len(piece) >= chunking.MIN_RUN else piece
            k = e
        want[i] = (len(b), len(spans), sum(again), len(b) - len(kept), hashlib.sha256(kept).hexdigest())
    found = {r.doc_id: (r.n_bytes, r.n_chunks, r.n_repeated, r.n_removed, r.kept_sha256) for r in chunking.dedup_substrings(docs).collect()}
    assert found == want


def test_chunks_resist_insertions():
    rnd = np.random.default_rng(4)
    text = rnd.integers(97, 123, 4000).astype(np.uint8).tobytes()
    moved = text[:1000] + b"inserted" + text[1000:]
    a, b = ({t[x:z] for x, z in brute_chunks(t)} for t in (text, moved))
    assert len(a & b) >= len(a) - 3


def test_chunks_of_nulls_and_nothing(spark, none):
    df = spark.createDataFrame([(None, "abc"), (1, None), (2, "")], SCHEMA)
    found = {str(r.doc_id): (r.n_bytes, r.n_chunks, r.n_removed) for r in chunking.dedup_substrings(df).collect()}
    assert found == {"None": (3, None, 0), "1": (0, 0, 0), "2": (0, 0, 0)}
    assert chunking.dedup_substrings(none).collect() == []
