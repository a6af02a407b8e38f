"""Quality rules: text statistics, and a decision list learned from labelled statistics, as Spark expressions."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.llm import common

SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5
#: Labelled rows that the rule learner may see; the smallest hashes of doc_id are taken.
FIT_ROWS = 20_000
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("n_words", "mean_word", "symbol_ratio", "dup_line_ratio", "repeat_ratio")


def _repeat_words(words: Column) -> Column:
    """Words inside WINDOW-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Equal windows are neighbours once (hash, start) pairs are sorted; a text
    without equal windows stops at the count of distinct hashes.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def repeated(x: Column, k: Column) -> Column:
                before = F.when(k > 0, F.get(s, k - 1)["h"])
                return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))

            return F.array_sort(F.transform(F.filter(s, repeated), lambda x: x["i"]))

        zero = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).cast("long").alias("n"))
        return F.aggregate(
            common.bind(pairs, starts),
            zero,
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), i - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        )

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
        return common.bind(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))

    return common.bind(words, lambda w: F.when(F.size(w) > WINDOW, of(w)).otherwise(F.lit(0).cast("long")))


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns of STATS, all long. Null text counts as empty: all zero."""
    t = common.text_or_empty(text)
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(common.WORD))
    w = common.words(t)
    counts = common.bind(
        w,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeat_words(w).alias("n_repeat_words"),
        ),
    )
    dup = common.bind(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    first = docs.withColumns({"_counts": counts, "n_symbols": F.regexp_count(t, F.lit(SYMBOLS)).cast("long"), "n_dup_lines": dup, "_lines": F.size(F.split(t, "\n"))})
    return first.withColumns({k: F.col(f"_counts.{k}") for k in ("n_words", "word_chars", "n_repeat_words")}).drop("_counts")


def features() -> dict[str, Column]:
    """Scale-free statistics that rules test; 0 where a text has no words."""
    per_word = lambda c: F.coalesce(F.try_divide(F.col(c), F.col("n_words")), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": per_word("word_chars"),
        "symbol_ratio": per_word("n_symbols"),
        "dup_line_ratio": F.coalesce(F.try_divide(F.col("n_dup_lines"), F.col("_lines")), F.lit(0.0)),
        "repeat_ratio": per_word("n_repeat_words"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def holds(self, row) -> bool:
        return row[self.feature] > self.cut if self.above else row[self.feature] <= self.cut

    def column(self) -> Column:
        c = features()[self.feature]
        return c > self.cut if self.above else c <= self.cut


Rule = tuple[Condition, ...]


def _counts(rule: Rule, rows: list) -> tuple[int, int]:
    hit = [r["bad"] for r in rows if all(c.holds(r) for c in rule)]
    return sum(hit), len(hit) - sum(hit)


def _cuts(rows: list, feature: str, most: int = 24) -> list[float]:
    values = sorted({r[feature] for r in rows})
    step = max(1, len(values) // most)
    return [(a + b) / 2 for a, b in zip(values[::step], values[1::step], strict=False)]


def _grow(rows: list, depth: int) -> Rule:
    """A conjunction grown by the largest information gain, until it holds for bad rows only."""
    rule: Rule = ()
    while len(rule) < depth:
        p, n = sum(r["bad"] for r in rows), sum(not r["bad"] for r in rows)
        if not p or not n:
            break
        best, gain = None, 1e-9
        for f in FEATURES:
            order = sorted(rows, key=lambda r: r[f])
            cuts, at, below_p, below_n = _cuts(rows, f), 0, 0, 0
            for cut in cuts:
                while at < len(order) and order[at][f] <= cut:
                    below_p, below_n, at = below_p + order[at]["bad"], below_n + (not order[at]["bad"]), at + 1
                for above, pp, nn in ((False, below_p, below_n), (True, p - below_p, n - below_n)):
                    if pp and (g := pp * (math.log2(pp / (pp + nn)) - math.log2(p / (p + n)))) > gain:
                        best, gain = Condition(f, above, cut), g
        if best is None:
            break
        rule, rows = (*rule, best), [r for r in rows if best.holds(r)]
    return rule


def _prune(rule: Rule, rows: list) -> Rule:
    """The prefix of rule with the best (p - n) / (p + n) on rows that did not grow it; the shortest of equals."""

    def worth(k: int) -> tuple[float, int]:
        p, n = _counts(rule[:k], rows)
        return ((p - n) / (p + n) if p + n else -1.0, -k)

    return rule[: -max(worth(k) for k in range(1, len(rule) + 1))[1]] if rule else rule


def learn(rows: list, precision: float = 0.95, depth: int = 4, most: int = 8) -> list[Rule]:
    """Sequential covering. rows: mappings with FEATURES, bad (bool) and grow (bool, else the row prunes).

    A rule is kept, in the order learned, while (p + 1) / (p + n + 2) of the pruning rows that it rejects reaches
    `precision`, so a handful of rows never makes a rule; learning ends at the first that does not. No rows, or none
    that is bad, give no rule.
    """
    grow, prune, rules = [r for r in rows if r["grow"]], [r for r in rows if not r["grow"]], []
    while len(rules) < most and any(r["bad"] for r in grow):
        rule = _prune(_grow(grow, depth), prune)
        p, n = _counts(rule, prune)
        if not rule or p + 1 < precision * (p + n + 2):
            break
        rules.append(rule)
        grow, prune = ([r for r in part if not all(c.holds(r) for c in rule)] for part in (grow, prune))
    return rules


def labelled_rows(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> list:
    """Statistics of at most `bound` labelled documents, those of the smallest hash of doc_id, ordered by it; one row a doc_id,
    the least statistics where it has several rows, and the least label.

    Documents that fail the base rule are left out: the learned rules decide about the others only. They are dropped
    here, not by a filter, which would move below the join and count the words of all documents.
    """
    some = (
        labels.select("doc_id", "quality").where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .select("doc_id", (F.col("quality") == 0).alias("bad"), F.xxhash64("doc_id").alias("_h"))
        .orderBy("_h", "doc_id").limit(bound)
    )
    stats = with_stats(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))
    row = F.struct("bad", (F.pmod("_h", F.lit(3)) > 0).alias("grow"), base_failed().alias("failed"), *[c.alias(k) for k, c in features().items()])
    found = stats.select("doc_id", row.alias("r")).groupBy("doc_id").agg(F.min("r").alias("r")).select("doc_id", "r.*")
    return sorted((r for r in found.collect() if not r["failed"]), key=lambda r: r["doc_id"])


def verdict(rules: list[Rule]) -> Column:
    """The ordered list as one conditional expression: false at the first rule that holds, else true."""
    out = None
    for rule in rules:
        test = rule[0].column()
        for c in rule[1:]:
            test = test & c.column()
        out = F.when(test, F.lit(False)) if out is None else out.when(test, F.lit(False))
    return F.lit(True) if out is None else out.otherwise(F.lit(True))


def _judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The columns of docs in _row, out of the way of STATS, base_failed and kept."""
    rules = learn(labelled_rows(docs, labels))
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col("text"))
    out = with_stats(held).withColumn("base_failed", base_failed())
    return out.withColumn("kept", ~F.col("base_failed") & verdict(rules))


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with STATS, base_failed and kept; the rules are learned from labels.

    Null or empty text has no words and fails. Rows, repeated ones included, keep their number and their other columns;
    columns of docs with one of these names are replaced. Labels without a matching document or with nulls do not count, of
    several labels of a doc_id the least does; no labels, no rules.
    """
    names = (*STATS, "base_failed", "kept")
    return _judged(docs, labels).select(*[F.col(f"_row.`{c}`") for c in docs.columns if c.lower() not in names], *names)


def passing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that judge() keeps, with their columns as they are, whatever their names."""
    return _judged(docs, labels).where("kept").select(*[F.col(f"_row.`{c}`") for c in docs.columns])


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return judge(common.documents(spark, sf_dir).select("doc_id", "text"), labels).select("doc_id", *STATS, "base_failed", "kept")
