"""Mixing, audio alignment and the pipeline."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from terrafold.llm import audio, minhash, mixing, quality, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes):
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in names if s not in capped)
        goal = {s: 3 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in names if s not in capped and goal[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return goal
        capped |= over


def check_mix(out, rows):
    sizes, taken, goal = {}, {}, {}
    source = {i: s for i, _, _, s, _ in rows}
    for r in out:
        s = source[r.doc_id]
        sizes[s] = sizes.get(s, 0) + r.size
        taken[s] = taken.get(s, 0) + r.taken
        goal[s] = r.target
        assert 0 <= r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
    want = brute_targets(sizes)
    for s in sizes:
        largest = max(r.size for r in out if source[r.doc_id] == s)
        assert goal[s] == pytest.approx(want[s], rel=1e-9)
        assert abs(taken[s] - goal[s]) <= largest / 2 + 1e-3 * goal[s] + 1
    assert all(r.source_size == sizes[source[r.doc_id]] for r in out)


def test_mix(docs, rows):
    out = mixing.mix(docs).collect()
    want = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    assert {r.doc_id: r.size for r in out} == want
    check_mix(out, rows)
    assert sorted(out) == sorted(mixing.mix(docs.repartition(3)).collect())


def test_mix_of_many_sources(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(rnd.integers(1, 400))), None, f"s{int(rnd.integers(0, 1 + i % 7))}", None) for i in range(600)]
    rows += [(1000 + i, "a b", None, f"t{i}", None) for i in range(4)] + [(2000, None, None, "empty", None)]
    check_mix(mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect(), rows)


def test_mix_of_nothing_and_repeated_rows(spark, none):
    assert mixing.mix(none).collect() == []
    df = spark.createDataFrame([(5, "q w e", "y"), (5, "q w e", "y"), (None, "a b", "z"), (6, None, None)], "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    assert len(out) == 4 and {r.source_size for r in out if r.doc_id == 5} == {6}
    clash = df.withColumns({"size": F.lit("s"), "_rate": F.lit("r"), "target": F.lit("t"), "copies": F.lit("c"), "_source": F.lit("o")})
    again = mixing.mixed(clash)
    assert again.columns == clash.columns and {tuple(r)[3:] for r in again.collect()} == {("s", "r", "t", "c", "o")}
    assert sorted(str(r.doc_id) for r in again.collect()) == sorted(str(r.doc_id) for r in out for _ in range(r.copies))


def test_mix_of_ties(spark):
    """Each source meets its target to within half its largest document, where doc_ids are null, repeated or unlike, and texts equal
    or not; copies of a text taken by rows and by mix() agree, in any order of rows."""
    rows = [(7 + i % 3, "a b c", None, s, i) for s, n in (("x", 80), ("y", 83)) for i in range(n)] + [(i, "a b c", None, "z", i) for i in range(100)]
    rows += [(None, "d e", None, "n", i) for i in range(300)] + [(None, f"t{i} u", None, "m", i) for i in range(160)] + [(5, None, None, "n", 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = mixing.mix(df.select("doc_id", "text", "source")).collect()
    for source_size in {r.source_size for r in out}:
        mine = [r for r in out if r.source_size == source_size]
        assert abs(sum(r.taken for r in mine) - mine[0].target) <= max(r.size for r in mine) / 2 + 1e-6, source_size
        assert all(r.taken <= 3 * r.size for r in mine)
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    took = {}
    for r in out:
        took[r.doc_id, r.size, r.source_size] = took.get((r.doc_id, r.size, r.source_size), 0) + r.copies
    size = {}
    for _, t, _, s, _ in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    texts = [tuple(r)[:4] for r in mixing.mixed(df).collect()]
    found = {}
    for i, t, _, s in texts:
        key = (i, len((t or "").split()), size[s])
        found[key] = found.get(key, 0) + 1
    assert found == {k: v for k, v in took.items() if v}
    assert sorted(texts, key=str) == sorted((tuple(r)[:4] for r in mixing.mixed(df.repartition(3)).collect()), key=str)


def tone(freqs, n=256):
    t = np.arange(n * len(freqs)) / audio.RATE
    return sum(np.sin(2 * np.pi * np.repeat(freqs, n) * k * t) / k for k in (1, 2, 3))


def test_alignment_finds_shifted_noisy_copies(spark):
    rnd = np.random.default_rng(7)
    notes = [rnd.choice([262, 294, 330, 392, 440, 523], 12).astype(float) for _ in range(12)]
    clips = {i: tone(n) for i, n in enumerate(notes)}
    clips[50] = clips[0][: 2048 + 16 * 20][16 * 20 :]  # a part of clip 0, 20 frames in
    clips[100] = clips[3] + rnd.normal(0, 0.01, len(clips[3]))
    clips[150], clips[200] = np.zeros(10), np.zeros(3000)
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in clips.items()] + [(None, [1.0] * 600), (301, None)], "rec_id long, samples array<double>")
    prints = audio.fingerprint(df, audio.fit_cuts(df))
    found = {(r.query_id, r.rec_id): r for r in audio.align(prints, prints.where("rec_id % 50 = 0")).collect()}
    assert found[50, 0].offset == 20 and found[50, 0].bit_errors == 0.0
    assert found[100, 3].offset == 0 and found[100, 3].bit_errors < 0.1
    assert (0, 50) in found and found[0, 50].offset == -20 and all(q != r for q, r in found)


def test_fingerprints_match_a_plain_loop():
    rnd = np.random.default_rng(1)
    samples = rnd.normal(size=1024)
    c = audio.chroma(samples)
    cuts = np.tile([-0.1, 0.0, 0.1], (audio.FILTERS, 1))
    fast = audio.fingerprints(samples, cuts)
    for start in (0, 5, len(fast) - 1):
        packed = 0
        for k, (kind, y, h, w) in enumerate(audio.filters()):
            area = lambda t0, t1, y0, y1: c[start + t0 : start + t1, y0:y1].sum()
            whole, mt, my = area(0, w, y, y + h), w // 2, y + h // 2
            part = {0: area(0, w, 0, 12) - whole, 1: area(0, w, my, y + h), 2: area(mt, w, y, y + h), 3: area(0, mt, my, y + h) + area(mt, w, y, my), 4: area(0, w, y + h // 3, y + h - h // 3), 5: area(w // 3, w - w // 3, y, y + h)}[kind]
            level = int((np.log((1 + (whole if kind == 0 else whole - part)) / (1 + part)) > cuts[k]).sum())
            packed |= [0, 1, 3, 2][level] << (2 * k)
        assert fast[start] == packed


def test_index_recall_against_all_pairs(spark, sf):
    """What the index finds, beside a comparison of every pair without it."""
    recordings = audio.recordings_of(spark.read.parquet(f"{sf}/embeddings.parquet"), 8)
    prints = audio.fingerprint(recordings, audio.fit_cuts(recordings))
    found = {(r.query_id, r.rec_id) for r in audio.align(prints, prints).collect()}
    held = {r.rec_id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}
    want = set()
    for a, x in held.items():
        for b, y in held.items():
            if a != b and len(x) and len(y):
                i, j = np.nonzero(x[:, None] == y[None])
                if len(i):
                    n = np.bincount(j - i + len(x))
                    o = int(n.argmax()) - len(x)
                    s, e = max(0, -o), min(len(x), len(y) - o)
                    if n.max() >= audio.LEAST_HITS and np.bitwise_count(x[s:e] ^ y[s + o : e + o]).sum() / (32 * (e - s)) <= audio.MOST_ERRORS:
                        want.add((a, b))
    assert found == want


def test_recall_of_steady_tones_and_silence(spark):
    """Recordings whose fingerprints are one value, or few, beside a comparison of every pair without the index."""
    rnd = np.random.default_rng(4)
    clips = {i: tone(rnd.choice([262, 294, 330, 392], 6).astype(float)) for i in range(4)}
    clips |= {10: tone([500.0] * 6), 11: tone([500.0] * 6), 12: tone([500.0] * 3), 20: np.zeros(900), 21: np.zeros(900), 22: np.zeros(600), 30: np.zeros(audio.FRAME + 15 * audio.HOP)}
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in clips.items()], "rec_id long, samples array<double>")
    prints = audio.fingerprint(df, audio.fit_cuts(df))
    found = {(r.query_id, r.rec_id): (r.n_hits, r.bit_errors) for r in audio.align(prints, prints).collect()}
    held = {r.rec_id: np.array(r.prints, np.int32).view(np.uint32) for r in prints.collect()}
    assert len(set(held[20])) == 1 and len(held[30]) == 1
    want = {}
    for a, x in held.items():
        for b, y in held.items():
            if a != b:
                hits = {o: sum(int(x[i]) == int(y[i + o]) for i in range(len(x)) if 0 <= i + o < len(y)) for o in range(1 - len(x), len(y))}
                o = min(hits, key=lambda k: (-hits[k], k))
                s, e = max(0, -o), min(len(x), len(y) - o)
                wrong = np.bitwise_count(x[s:e] ^ y[s + o : e + o]).sum() / (32 * (e - s))
                if hits[o] >= audio.LEAST_HITS and wrong <= audio.MOST_ERRORS:
                    want[a, b] = (hits[o], wrong)
    assert found == want and {(10, 11), (11, 10), (20, 21), (22, 20)} <= set(found)


@pytest.mark.parametrize("listed", [1 << 20, 4])
def test_offsets_against_a_plain_loop(monkeypatch, listed):
    """Sustained values are counted together, others one by one."""
    monkeypatch.setattr(audio, "LISTED", listed)
    rnd = np.random.default_rng(2)
    pairs = [(rnd.integers(0, k, n), rnd.integers(0, k, m)) for k, n, m in ((3, 40, 25), (100, 30, 60), (1, 200, 150), (2, 1, 1))]
    pairs += [(np.zeros(400, int), np.concatenate((np.zeros(300, int), np.arange(300)))), (np.arange(3), np.arange(5, 9))]
    for x, y in pairs:
        want = np.zeros(len(x) + len(y), int)
        for i in range(len(x)):
            for j in range(len(y)):
                want[len(x) + j - i] += x[i] == y[j]
        assert np.array_equal(audio.offsets(x.astype(np.uint32), y.astype(np.uint32)), want)


def test_alignment_of_nothing_ties_and_repeated_ids(spark):
    cuts = np.zeros((audio.FILTERS, 3))
    schema = "rec_id long, samples array<double>, prints string"
    assert audio.align(audio.fingerprint(spark.createDataFrame([], schema), cuts), audio.fingerprint(spark.createDataFrame([], schema), cuts)).collect() == []
    a = [float(v) for v in tone([262.0, 330.0, 392.0])]
    df = spark.createDataFrame([(1, a, "x"), (1, a, "x"), (2, a + a, "y"), (None, a, "z"), (3, None, "z"), (4, [None] * 600, "z")], schema)
    prints = audio.fingerprint(df, audio.fit_cuts(df.select("rec_id", "samples")))
    assert prints.count() == 6 and prints.where("rec_id = 3").first().prints == []
    found = audio.align(prints, prints).collect()
    assert [(r.query_id, r.rec_id, r.offset) for r in found if {r.query_id, r.rec_id} == {1, 2}] and len(found) == len({(r.query_id, r.rec_id) for r in found})
    assert next(r.offset for r in found if (r.query_id, r.rec_id) == (1, 2)) == 0  # of two places alike, the first


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in quality.judge(docs, labels).where("kept").collect()}
    first = corpus_pipeline.STAGES[0][1](spark, docs, sf)
    assert first.columns == docs.columns and {r.doc_id for r in first.collect()} == kept
    second = corpus_pipeline.STAGES[1][1](spark, first, sf)
    near = {r.doc_id for r in minhash.near_duplicates(first, 5, 80).where("kept").collect()}
    assert second.columns == docs.columns and {r.doc_id for r in second.collect()} == near and near < kept
    third = corpus_pipeline.STAGES[2][1](spark, second, sf)
    assert third.columns == docs.columns and third.count() == second.count()
    assert secrets.scan(third).where("n_hex > 0 or n_access > 0 or spans like '%entropy%'").count() == 0
    fourth = corpus_pipeline.STAGES[3][1](spark, third, sf)
    copies = {r.doc_id: r.copies for r in mixing.mix(third).collect() if r.copies}
    assert fourth.columns == docs.columns
    assert {r.doc_id: r["count"] for r in fourth.groupBy("doc_id").count().collect()} == copies
    out = corpus_pipeline.run(spark, sf)
    assert out.count() == sum(copies.values()) and out.where("text <> decoded or n_tokens <> length(ids) / 4").count() == 0


def brute_stage_texts(rows):
    """doc_id and redacted text of the rows that the base rule and near-dedup keep: plain Python, none of the operators."""
    kept = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        again = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(5)}
        if len(w) >= 10 and 100 * len(again) <= 20 * len(w):
            kept[i] = t
    words = {i: t.encode().lower().split() for i, t in kept.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    group = {i: i for i in kept}
    for i in sorted(kept):
        for j in sorted(kept):
            if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = {k: new if g == old else g for k, g in group.items()}
    secret = re.compile(r"""(?:password|token)\s*[:=]\s*[A-Za-z0-9+/_.=-]{6,}|AKIA[A-Z0-9]{16,}|(?<![0-9a-f])[0-9a-f]{24,}""")
    return {i: secret.sub("[SECRET]", t) for i, t in kept.items() if group[i] == i}


def test_pipeline_against_brute_force(spark, tmp_path):
    """run() over a table with copies, secrets, junk, nulls and columns named like those of the stages."""
    import random

    import public_tokenizers
    import tiktoken

    rnd = random.Random(21)
    vocab = ["".join(rnd.choice("abcdeéü") for _ in range(rnd.randint(2, 8))) for _ in range(200)]
    text = lambda n: " ".join(rnd.choice(vocab) for _ in range(n))
    texts = [text(rnd.randint(30, 120)) for _ in range(40)]
    texts += [texts[0]] * 4 + [texts[1] + " " + text(3), text(5), "", None, " ".join([text(8)] * 6)]
    texts += [f"{text(20)} token = abcdef123456 {text(15)} AKIA{'Q7' * 8} {text(9)} {'0f1e2d3c' * 5} end {text(4)}" for _ in range(3)]
    rows = [(i, t, f"s{i % 4}" if i % 9 else None, i) for i, t in enumerate(texts)]
    names = ("spans", "kept", "n_words", "_text", "found", "_rate", "_row")
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars long").withColumns({n: F.concat(F.lit(n), F.col("doc_id")) for n in names})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "n_tokens", "ids", "decoded"]
    found = out.collect()
    want = brute_stage_texts([(i, t) for i, t, *_ in rows])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        import base64

        ranks = {base64.b64decode(k): int(v) for k, v in map(bytes.split, f)}
    enc = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    copies = {}
    for r in found:
        assert r.text == want[r.doc_id] == r.decoded and r.n_chars == len(r.text) and all(r[n] == f"{n}{r.doc_id}" for n in names)
        ids = enc.encode_ordinary(r.text)
        assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids)
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    size = {i: len(WORD.findall(t)) for i, t in want.items()}
    source = {i: s for i, _, s, _ in rows if i in want}
    totals = {s: sum(size[i] for i in want if source[i] == s) for s in set(source.values())}
    goals = brute_targets(totals)
    assert max(copies.values()) <= 3 and set(copies) <= set(want)
    for s, goal in goals.items():
        largest = max(size[i] for i in want if source[i] == s)
        assert abs(sum(size[i] * copies.get(i, 0) for i in want if source[i] == s) - goal) <= largest / 2 + 1e-3 * goal + 1


def test_stages_with_null_ids_and_repeats(spark, sf):
    t = " ".join(f"w{k}" for k in range(40))
    rows = [(5, t, "a"), (5, t, "a"), (5, t + " x", "a"), (None, t, "a"), (None, t, "a"), (9, t + " y", "b"), (8, None, "b"), (7, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("kept", F.lit("mine"))
    counts = []
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        assert out.columns[: len(docs.columns)] == docs.columns and {r.kept for r in out.collect()} == {"mine"}
        counts.append(sorted(str(r.doc_id) for r in out.collect()))
    assert counts[0] == ["5", "5", "5", "9", "None", "None"]  # those with words enough
    assert counts[1] == ["5", "7", "8", "None", "None"]
    assert counts[2] == counts[4] == sorted(str(i) for i, *_ in rows)
    assert {"7", "8"} <= set(counts[3]) and counts[3].count("7") == 1


def test_pipeline_of_nothing(spark, sf, none, tmp_path):
    labels = spark.read.parquet(f"{sf}/labels.parquet").limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_cuts_come_from_all_recordings(spark):
    """700 recordings, more than any sample of 500: the median of their quartiles, each of them counted."""
    rnd = np.random.default_rng(8)
    data = [(k, (rnd.normal(size=700) * (1 + k % 5)).tolist()) for k in range(700)] + [(None, [1.0] * 700), (700, [0.5])]
    df = spark.createDataFrame(data, "rec_id long, samples array<double>").repartition(3)
    q = [np.quantile(audio.responses(audio.chroma(np.array(s))), (0.25, 0.5, 0.75), axis=0).T for k, s in data if k is not None and len(s) > 1]
    cuts = audio.fit_cuts(df)
    assert cuts.shape == (audio.FILTERS, 3) and np.abs(cuts - np.median(q, axis=0)).max() <= 0.51 / audio.STEPS
    assert (audio.fit_cuts(df.limit(0)) == 0).all()
