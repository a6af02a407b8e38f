"""Periodic runs of words, found by enumerating maximal pairs on an LCP-interval tree."""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import arrays, common


def _gram(least: int, exponent: int) -> int:
    """Words that the two occurrences of a maximal pair of any run share at least."""
    return min(max(least - q, (exponent - 1) * q) for q in range(1, least + 1))


def _promising(word: np.ndarray, doc: np.ndarray, gram: int, exponent: int) -> np.ndarray:
    """Documents that can have runs, by a test that no run fails.

    In a run of period q the `gram` words at (exponent - 1) * q - gram + 1 places in succession occur again within q words.
    Periods are tested up to each power of two.
    """
    n = len(word) - gram + 1
    if n < 1:
        return np.zeros(0, np.int64)
    value = doc[:n].astype(np.uint64)
    for k in range(gram):
        value = arrays.mix(value * np.uint64(arrays.BASE) + word[k : k + n])
    whole = doc[:n] == doc[gram - 1 :]
    place = np.flatnonzero(whole)
    order = place[np.argsort(value[place], kind="stable")]
    again = value[order[1:]] == value[order[:-1]]
    near, gap = order[:-1][again], np.diff(order)[again]
    by_place = np.argsort(near)
    near, gap = near[by_place], gap[by_place]
    found = []
    top = 1
    while len(near):
        at = near[gap <= top]
        need = max(1, (exponent - 1) * (top // 2 + 1) - gram + 1)
        edge = np.flatnonzero(np.diff(np.concatenate(([-2], at, [np.iinfo(np.int64).max]))) != 1)
        long = np.diff(edge) >= need
        found.append(doc[at[edge[:-1][long]]])
        if len(at) == len(near):
            break
        top *= 2
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _suffixes(word: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array over the words of whole documents, a document's suffixes together, and the words that each suffix shares with
    the one before it. Prefix doubling; ranks of every length that was sorted are kept for the shared words."""
    n = len(word)
    end = np.searchsorted(doc, doc, "right")
    at = np.lexsort((word, doc))
    slot = np.arange(n)

    def ranked(new: np.ndarray) -> np.ndarray:
        out = np.empty(n, np.int32)
        out[at] = np.maximum.accumulate(np.where(new, slot, 0))
        return out

    new = np.ones(n, bool)
    new[1:] = (word[at[1:]] != word[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    levels = [ranked(new)]
    size = 1
    while not new.all():
        rank = levels[-1]
        open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
        here = at[open_]
        inside = here + size < end[here]
        follow = np.where(inside, rank[np.minimum(here + size, n - 1)].astype(np.int64) + 1, 0)
        key = rank[here].astype(np.int64) * (n + 1) + follow
        order = np.argsort(key, kind="stable")
        at[open_], key = here[order], key[order]
        new[open_[1:]] |= key[1:] != key[:-1]
        levels.append(ranked(new))
        size *= 2
    shared = np.zeros(n, np.int64)
    a, b = at[:-1], at[1:]
    same = np.flatnonzero(doc[a] == doc[b])
    a, b = a[same], b[same]
    x = np.zeros(len(a), np.int64)
    for k in range(len(levels) - 1, -1, -1):
        ok = np.maximum(a, b) + x < end[a]
        p, q = a[ok] + x[ok], b[ok] + x[ok]
        x[np.flatnonzero(ok)[levels[k][p] == levels[k][q]]] += 1 << k
    shared[same + 1] = x
    return at, shared


def _pairs(at: list[int], shared: list[int], left: dict[int, int], least: int, exponent: int) -> list[tuple[int, int, int]]:
    """start, length, period of the runs among the maximal pairs of suffixes at, neighbours of which share so many words.

    Intervals close bottom up. An interval has its places in order and the class of left words that they all have, or none
    where they have several. When two children of an interval meet, the places of the smaller look for their neighbours in
    the larger: a pair of unlike classes is maximal to the left, and to the right since its places come from two
    children. Two places of an interval that share s words and are d <= s / (exponent - 1) apart, with no third between,
    are a run of the smallest period d from the first place on, s + d words long. So neighbours are all that need looking at, and
    children of one class and the same need none.
    """
    found: dict[tuple[int, int], int] = {}

    def merged(a, b, s):
        if len(a[0]) < len(b[0]):
            a, b = b, a
        large, one = a
        small, other = b
        if one is None or other is None or one != other:
            pairs = []
            for x in small:
                k = bisect_left(large, x)
                if k:
                    pairs.append((large[k - 1], x))
                if k < len(large):
                    pairs.append((x, large[k]))
            for x, y in pairs:
                d = y - x
                if (exponent - 1) * d <= s and s + d >= least and left[x] != left[y]:
                    found[x, s + d] = min(d, found.get((x, s + d), d))
            one = None
        for x in small:
            insort(large, x)
        return large, one

    stack: list[tuple] = []  # open children, and the words that each shares with the one below it
    for place, s in zip([*at, -1], [*shared, 0], strict=True):
        while stack and stack[-1][1] > s:
            node, depth = stack.pop()
            stack[-1] = (merged(stack[-1][0], node, depth), stack[-1][1])
        if not s:
            stack.clear()
        stack.append((([place], left.get(place)), s))
    return sorted((start, length, d) for (start, length), d in found.items())


def runs_of(word: np.ndarray, doc: np.ndarray, least: int = 6, exponent: int = 4) -> dict[int, np.ndarray]:
    """start, length, period (rows in order of start, then period) of the runs in each document that has any.

    word: 64-bit hashes, doc: their documents in order; starts count from a document's first word. A document alone takes some
    150 bytes a word at most.
    """
    gram = _gram(least, exponent)
    some = _promising(word, doc, gram, exponent)
    keep = np.isin(doc, some)
    word, doc = word[keep], doc[keep]
    if not len(word):
        return {}
    at, shared = _suffixes(word, doc)
    _, left_word = np.unique(word, return_inverse=True)
    left = np.concatenate(([-1], left_word[:-1]))
    left[np.flatnonzero(np.diff(doc, prepend=-1))] = -1
    # intervals of `gram` words or more; those of one class of left words, or too far apart, hold no run
    top = np.cumsum(shared < gram) - 1
    first = np.flatnonzero(shared < gram)
    size = np.diff(np.append(first, len(at)))
    unlike = np.maximum.reduceat(left[at], first) != np.minimum.reduceat(left[at], first)
    most = np.maximum.reduceat(np.where(shared < gram, 0, shared), first)
    order = np.lexsort((at, top))
    gap = np.append(np.diff(at[order]), np.iinfo(np.int64).max)
    gap[np.append(np.diff(top[order]), 1) != 0] = np.iinfo(np.int64).max // exponent
    close = np.minimum.reduceat(gap, first)
    live = (size > 1) & unlike & ((exponent - 1) * close <= most)
    rows = live[top]
    places, words = at[rows], np.where(shared < gram, 0, shared)[rows]
    begins = np.searchsorted(doc, np.arange(doc[-1] + 1))
    out: dict[int, list] = {}
    of = doc[places]
    for k in np.unique(of):
        mine = slice(*np.searchsorted(of, (k, k + 1)))
        start = int(begins[k])
        own = {p: c for p, c in zip((places[mine] - start).tolist(), left[places[mine]].tolist(), strict=True)}
        rows_of = _pairs((places[mine] - start).tolist(), words[mine].tolist(), own, least, exponent)
        if rows_of:
            out[int(k)] = np.array(sorted(rows_of, key=lambda r: (r[0], r[2])), np.int64)
    return out


def periodic_runs(docs: DataFrame, least: int = 6, exponent: int = 4, text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, by start, then period) and collapsed of each row of docs.

    A run is a stretch of words with smallest period q (words q apart are equal), at least `least` words and `exponent` (3 or
    more) periods long, that no neighbouring word extends. collapsed is the text's words, one space apart, without those
    that a run holds after its first q words. Null and empty texts have no words, no runs and an empty collapsed text. Every row
    is judged alone, so rows of repeated or null doc_ids have their results each; no rows give no rows. Other columns are
    ignored. Words are compared by 64-bit hashes. Whole texts are worked on, a megabyte of them at a time, a longer text alone.
    """
    if exponent < 3:
        raise ValueError("runs of fewer than three periods are not told by neighbouring places alone")
    schema = common.row_schema(docs, "doc_id", "n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
    kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [x.as_py() or b"" for x in batch.column(1)]
            for a, b in arrays.blocks(texts):
                w = arrays.words_of(texts[a:b], lower=False)
                counts = np.bincount(w.doc, minlength=b - a)
                runs = runs_of(w.hash, w.doc, least, exponent)
                kept = []
                for k, t in enumerate(texts[a:b]):
                    own = t.split()
                    if k in runs:
                        change = np.zeros(len(own) + 1, np.int64)
                        np.add.at(change, runs[k][:, 0] + runs[k][:, 2], 1)
                        np.add.at(change, runs[k][:, 0] + runs[k][:, 1], -1)
                        own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
                    kept.append(b" ".join(own).decode())
                some = [runs.get(k, np.zeros((0, 3), np.int64)) for k in range(b - a)]
                flat = np.concatenate(some)
                stops = np.concatenate(([0], np.cumsum([len(x) for x in some]))).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(flat[:, j]) for j in range(3)], fields=list(kind))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], pa.array(counts, pa.int64()), pa.ListArray.from_arrays(pa.array(stops), items), pa.array(kept, pa.string())], names=schema.names
                )

    return docs.select(F.col("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("_text")).mapInArrow(run, schema)


def _planted(docs: DataFrame) -> DataFrame:
    """doc_id and text; where crc32 of the decimal doc_id ends in 0, its tail becomes periodic, by the contract of the query."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(words: Column) -> Column:
        n = F.size(words)
        a = F.pmod(g, n.cast("long")).cast("int")
        p = (1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))).cast("int")
        return F.array_join(F.transform(words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, a + F.pmod(i - a, p)))), " ")

    changed = common.bind(common.words(F.col("text")), lambda words: F.when(F.size(words) > 0, periodic(words)).otherwise(""))
    return docs.select("doc_id", F.when((h % 10 == 0) & F.col("text").isNotNull(), changed).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A null doc_id has no digits to hash, so its text stays as it is."""
    found = periodic_runs(_planted(common.documents(spark, sf_dir)))
    line = lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))
    longest = F.array_sort("runs", lambda x, y: F.when(x["length"] != y["length"], F.when(x["length"] > y["length"], -1).otherwise(1)).when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1)).otherwise(F.when(x["period"] < y["period"], -1).otherwise(0)))
    best = F.get(longest, F.lit(0))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.floor(F.col("best.length") * 1000 / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
