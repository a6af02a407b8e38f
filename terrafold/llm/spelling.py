"""Spelling variants of words, joined by an index of grams of variable length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import common
from terrafold.operators.linked import rooted, sent

#: Lengths of grams, the marks around a word included. A word of SHORTEST code points or more keeps a gram in common with each
#: word one edit away, since an edit touches LONG grams at most.
LEAST, LONG, SHORTEST = 2, 4, 5
#: Places that a gram of fewer than LONG characters has among all words at most; more frequent ones are made longer.
OFTEN = 100


def word_counts(docs: DataFrame, word: Column, least: int = 3, text: str = "text") -> DataFrame:
    """word and n of what `word` makes of each run of letters (a column named run, A to Z in lower case, beside doc_id) of all
    texts, for results of SHORTEST code points or more that occur `least` times. Null texts have no runs."""
    low = F.translate(text, "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123))))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(low, F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0))).alias("run"))
    made = runs.where(F.length("run") >= SHORTEST).select(word.alias("word")).where(F.length("word") >= SHORTEST)
    return made.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def _places(words: DataFrame) -> DataFrame:
    """word, size (of the word with its marks), p and grams of LEAST to LONG characters from each place p on, null past its end."""
    marked = words.select("word", F.concat(F.lit("\x01"), "word", F.lit("\x02")).alias("m"), (F.length("word") + 2).alias("size"))
    at = marked.select("word", "m", "size", F.explode(F.sequence(F.lit(0), F.col("size") - LEAST)).alias("p"))
    gram = lambda q: F.when(F.col("p") + q <= F.col("size"), F.substring("m", F.col("p") + 1, F.lit(q)))
    return at.select("word", "size", "p", *[gram(q).alias(f"g{q}") for q in range(LEAST, LONG + 1)])


def frequent_grams(words: DataFrame, often: int | None = None) -> DataFrame:
    """gram and c of the grams of LEAST to LONG characters that have more than `often` places among the words. A prefix of one is
    one too, so these are the inner nodes of the dictionary; its leaves are the shortest grams that are none."""
    grams = _places(words).select(F.explode(F.array(*[f"g{q}" for q in range(LEAST, LONG + 1)])).alias("gram")).where("gram is not null")
    return grams.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > (OFTEN if often is None else often))


def gram_lists(words: DataFrame, frequent: DataFrame) -> DataFrame:
    """word, size, most and grams (array of c, h, p, q: rarest first) of each word; h is a hash of the gram of length q at p.

    From every place the shortest gram is taken that is not frequent, else the one of LONG characters or up to the end; c is 0 or
    a frequent gram's places. So a gram follows from its own characters, and an edit changes only those that cover it: `most`
    at the worst place of the word.
    """
    rows = _places(words)
    small = sent(frequent)
    for q in range(LEAST, LONG + 1):
        rows = rows.join(small.select(F.col("gram").alias(f"g{q}"), F.col("c").alias(f"c{q}")), f"g{q}", "left")
    q = F.lit(LONG)
    for k in reversed(range(LEAST, LONG)):
        q = F.when(F.col(f"c{k}").isNull() | F.col(f"g{k + 1}").isNull(), F.lit(k)).otherwise(q)
    of = lambda name: F.coalesce(*[F.when(F.col("q") == k, F.col(f"{name}{k}")) for k in range(LEAST, LONG + 1)])
    chosen = rows.withColumn("q", q).select("word", "size", F.struct(F.coalesce(of("c"), F.lit(0)).alias("c"), F.xxhash64(of("g")).alias("h"), "p", "q").alias("g"))
    grams = chosen.groupBy("word", "size").agg(F.sort_array(F.collect_list("g")).alias("grams"))
    touched = lambda i: F.size(F.filter("grams", lambda g: (g["p"] <= i) & (i < g["p"] + g["q"])))
    return grams.withColumn("most", F.array_max(F.transform(F.sequence(F.lit(0), F.col("size") - 1), touched)))


def _keys(lists: DataFrame) -> DataFrame:
    """word, size, x, p, y, r: the keys of each word's lists; a key is one gram x at p, or two, x at p and y at r further on.

    Of a word's size - 1 grams a word one edit away keeps all but `most`. So the rarest one that both have is among the
    most + 1 rarest of either. Where it is frequent, so are all others that both have, and two of them are among the most + 2
    rarest of either, unless neither word keeps more than one. Lists of frequent grams are hence merged two at a time.
    """
    first = F.filter(F.slice("grams", F.lit(1), F.col("most") + 1), lambda g: (g["c"] == 0) | (F.col("size") - 1 - F.col("most") < 2))
    one = F.transform(first, lambda g: F.struct(g["h"].alias("x"), g["p"].alias("p"), F.lit(None).cast("long").alias("y"), F.lit(None).cast("int").alias("r")))
    often = F.filter(F.slice("grams", F.lit(1), F.col("most") + 2), lambda g: g["c"] > 0)
    two = F.flatten(F.transform("often", lambda g: F.transform(F.filter("often", lambda k: k["p"] > g["p"]), lambda k: F.struct(g["h"].alias("x"), g["p"].alias("p"), k["h"].alias("y"), k["p"].alias("r")))))
    rows = lists.select("word", "size", one.alias("one"), often.alias("often")).select("word", "size", F.explode(F.concat("one", two)).alias("k"))
    return rows.select("word", "size", "k.*")


def near_words(words: DataFrame, often: int | None = None) -> DataFrame:
    """a, b: the pairs of words, either way round, that differ by one inserted, deleted or replaced code point. words (word) has
    each word once, of SHORTEST code points or more.

    Two such words share a gram at the same place, or in the longer of them one place further on; keys hold place and size.
    Whatever meets is verified, so a chance collision of keys adds nothing.
    """
    words = common.checkpoint(words.select("word"))
    keys = common.checkpoint(_keys(gram_lists(words, common.checkpoint(frequent_grams(words, often)))))
    key = lambda a, b, more: F.xxhash64("x", F.col("p") + a, F.coalesce("y", F.lit(0)), F.coalesce(F.col("r") + b, F.lit(0)), F.col("size") + more)
    probes = keys.select(F.col("word").alias("a"), F.explode(F.array(key(0, 0, 0), key(0, 0, 1), key(1, 1, 1), F.when(F.col("y").isNotNull(), key(0, 1, 1)))).alias("key")).where("key is not null")
    lists = keys.select(F.col("word").alias("b"), key(0, 0, 0).alias("key"))
    apart = (F.length("a") < F.length("b")) | (F.col("a") < F.col("b")) & (F.length("a") == F.length("b"))
    met = probes.join(lists, "key").where(apart & (F.levenshtein("a", "b", 1) == 1)).select("a", "b").distinct()
    return met.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("x")).select("x.*")


def variants(counts: DataFrame, ratio: int = 2, often: int | None = None) -> DataFrame:
    """word, form, root, n, n_near, form_n of each row of counts (word, n: each word once, of SHORTEST code points or more).

    Words are near that differ by one edit. form is the near word of largest n, the smallest of equals, if that is `ratio` times
    the word's n or more (ratio over 1, so forms lead to no circle); root is where forms lead to. No words give no rows.
    """
    counts = common.checkpoint(counts.select("word", "n"))
    pairs = near_words(counts, often)
    best = F.min(F.struct((-F.col("m.n")).alias("n"), F.col("b").alias("word"))).alias("best")
    near = pairs.join(counts.alias("m").select(F.col("word").alias("b"), F.struct("n").alias("m")), "b").groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    taken = -F.col("best.n") >= ratio * F.col("n")
    found = common.checkpoint(counts.join(near, "word", "left").select("word", F.when(taken, F.col("best.word")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(taken, -F.col("best.n")).alias("form_n")))
    roots = rooted(common.checkpoint(found.where("form is not null").select(F.col("word").alias("id"), F.col("form").alias("root"))))
    return found.join(roots.select(F.col("id").alias("word"), "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of a null doc_id lose no code point, since there is nothing to hash."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), "run").cast("binary"))
    k = F.pmod(h, F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), k), F.substring("run", k + 2, F.length("run")))
    return variants(word_counts(common.documents(spark, sf_dir), F.when(h % 97 == 0, cut).otherwise(F.col("run"))))
