"""Mixing sources to target weights by entropy balancing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrafold.llm import common

#: Weights of the sources by rank, repeating.
WEIGHTS = (5, 2, 1)
#: No document is taken more often than this.
MOST = 3
BINS = 4096
#: A table of this many sources or fewer is sent to all tasks: a row a source, its number counted before.
FEW = 10_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """A row for each source key (_null, _source): source_size, n_docs and target.

    A source is capped where MOST times its size is at most the level times its weight, so in order of that ratio the
    capped sources come first, and the level follows from what the capped leave over to the weights of the rest. One row
    a source goes through the windows, never documents.
    """
    src = sizes.groupBy("_null", "_source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    ranked = src.withColumn("_rank", F.row_number().over(Window.orderBy("_null", "_source")))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("_rank") - 1, F.lit(len(weights))).cast("int") + 1)
    ratio = ranked.withColumn("_w", weight).withColumn("_cap", MOST * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    everything = Window.partitionBy()
    before = Window.orderBy("_ratio", "_rank").rowsBetween(Window.unboundedPreceding, -1)
    level = ratio.withColumns({
        "_total": F.sum("source_size").over(everything),
        "_capped": F.coalesce(F.sum("_cap").over(before), F.lit(0)),
        "_left": F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0)),
    }).withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_left"))
    # the first source in this order that its share does not fill sets the level of all that follow
    free = F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_rank", "_level"))).over(everything)
    level = level.withColumn("_free", free)
    capped = F.col("_free").isNull() | (F.struct("_ratio", "_rank") < F.struct(F.col("_free._ratio"), F.col("_free._rank")))
    target = F.when(capped, F.col("_cap").cast("double")).otherwise(F.col("_free._level") * F.col("_w"))
    return level.select("_null", "_source", "source_size", "n_docs", target.alias("target"))


def _rate(lam: Column, x: Column) -> Column:
    return F.when(x > 0, F.least(F.lit(float(MOST)), F.exp(lam * x))).otherwise(F.lit(1.0))


def balance(sizes: DataFrame, goals: DataFrame, tolerance: float = 1e-5, rounds: int = 60) -> DataFrame:
    """The multiplier of each source: rates min(MOST, exp(multiplier * size / mean size)) take its target.

    These rates are the closest to 1 in relative entropy that meet the constraint, and the multipliers maximise the convex
    dual, one for each constraint. A Newton round is one aggregate over the counts of equal sizes; steps that leave the
    bracket known so far are halved into it. Sums are decimal, so that reruns agree in every digit.
    """
    mean = F.col("source_size") / F.col("n_docs")
    counts = common.checkpoint(
        sizes.where("size > 0").groupBy("_null", "_source", "size").count().join(goals, ["_null", "_source"])
        .select("_null", "_source", (F.col("count") * F.col("size")).cast("double").alias("mass"), (F.col("size") / mean).alias("x"))
    )
    start = counts.groupBy("_null", "_source").agg(F.min("x").alias("least")).join(goals, ["_null", "_source"])
    full = F.col("target") >= MOST * F.col("source_size") * (1 - 1e-12)
    state = start.select(
        "_null", "_source", "target",
        F.when(full, F.lit(math.log(MOST)) / F.col("least")).otherwise(F.lit(0.0)).alias("lam"),
        F.when(full | (F.col("target") >= F.col("source_size")), F.lit(0.0)).otherwise(F.lit(-math.inf)).alias("lo"),
        F.when(F.col("target") >= F.col("source_size"), F.lit(math.log(MOST)) / F.col("least")).otherwise(F.lit(0.0)).alias("hi"),
        full.alias("done"),
    )
    state = common.checkpoint(state)
    exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    for _ in range(rounds):
        if state.where(~F.col("done")).isEmpty():
            break
        x, mass, rate = F.col("x"), F.col("mass"), _rate(F.col("lam"), F.col("x"))
        slope = F.when(rate < MOST, mass * x * rate).otherwise(F.lit(0.0))
        sums = counts.join(state.where(~F.col("done")).select("_null", "_source", "lam"), ["_null", "_source"]).groupBy("_null", "_source").agg(exact(mass * rate).alias("got"), exact(slope).alias("slope"))
        s = state.join(sums, ["_null", "_source"], "left").withColumn("_gap", F.col("got") - F.col("target"))
        s = s.withColumns({"lo": F.when(F.col("_gap") < 0, F.col("lam")).otherwise(F.col("lo")), "hi": F.when(F.col("_gap") > 0, F.col("lam")).otherwise(F.col("hi"))})
        newton = F.col("lam") - F.try_divide(F.col("_gap"), F.col("slope"))
        half = F.when(F.col("lo") == -math.inf, F.col("hi") * 2 - 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        step = F.when(newton.isNull() | (newton <= F.col("lo")) | (newton >= F.col("hi")), half).otherwise(newton)
        near = F.abs(F.col("_gap")) <= tolerance * F.col("target") + 1e-3
        done = F.col("done") | near | F.col("got").isNull()
        state = common.checkpoint(s.select("_null", "_source", "target", F.when(done, F.col("lam")).otherwise(step).alias("lam"), "lo", "hi", done.alias("done")))
    return state.select("_null", "_source", "lam")


def _sent(sources: DataFrame, few: bool) -> DataFrame:
    """sources as the small side of a join, so that a source with many documents is not gathered; else left to the planner."""
    return F.broadcast(sources) if few else sources


KEY = ["_null", "_source"]


def _sized(docs: DataFrame, text: str, *columns: Column) -> DataFrame:
    source = F.col("source")
    size = F.regexp_count(common.text_or_empty(text), F.lit(common.WORD)).cast("long")
    sized = docs.select(*columns, F.col("doc_id"), source.isNull().alias("_null"), F.coalesce(source, F.lit("")).alias("_source"), size.alias("size"), F.xxhash64(F.col(text)).alias("_t"))
    return sized.withColumn("_g", F.xxhash64("_null", "_source", F.col("doc_id").isNull(), "doc_id", "_t", "size"))


def _numbered(sized: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """sized (of a checkpoint) with _k, which numbers the rows of one source, doc_id and text from 0; and the _g of such rows, if any.

    They are interchangeable, so any numbers will do: those within a partition go on from the rows of the partitions
    before, and nobody gathers all rows of a text. Rows without repeats, as all are in a well-kept table, are not shuffled.
    """
    again = common.checkpoint(sized.groupBy("_g").agg(F.count("*").alias("_m")).where("_m > 1").select("_g"))
    if again.isEmpty():
        return sized.withColumn("_k", F.lit(0).cast("long")), None
    small = F.broadcast(again) if again.count() <= common.FEW else again
    alike = sized.withColumn("_p", F.spark_partition_id()).join(small, "_g")
    counts = alike.groupBy("_g", "_p").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_at", F.sum("_n").over(Window.partitionBy("_g").orderBy("_p")) - F.col("_n")).drop("_n")
    rank = F.row_number().over(Window.partitionBy("_g", "_p").orderBy("size"))
    alike = alike.withColumn("_r", rank).join(starts, ["_g", "_p"]).withColumn("_k", F.col("_at") + F.col("_r") - 1)
    rest = sized.join(small, "_g", "left_anti").withColumn("_k", F.lit(0).cast("long"))
    return common.checkpoint(rest.unionByName(alike.drop("_p", "_r", "_at"))), again


def _scored(sized: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """sized with the columns of its source, its rate, what of it is sure, and the score by which it is rounded up.

    A row's score is the fraction of its rate less a hash of its doc_id, text and number among its equals in [0, 1).
    """
    x = F.try_divide(F.col("size"), F.col("source_size") / F.col("n_docs"))
    rated = sized.join(_sent(sources, few), KEY).withColumn("_x", x)
    full = F.col("target") >= MOST * F.col("source_size")
    has = F.coalesce("_x", F.lit(0.0)) > 0
    rated = rated.withColumn("_rate", F.when(has & full, F.lit(float(MOST))).when(has, _rate(F.col("lam"), F.col("_x"))).otherwise(F.lit(1.0)))
    unit = F.shiftrightunsigned(F.xxhash64("doc_id", "_t", "_k"), 11) / F.lit(float(1 << 53))
    scored = rated.withColumn("_low", F.floor("_rate").cast("long")).withColumn("_score", F.col("_rate") - F.col("_low") - unit)
    scored = scored.withColumn("_open", (F.col("_low") < MOST) & (F.col("size") > 0))
    return scored.withColumn("_bin", F.floor((F.col("_score") + 1) * (BINS // 2)).cast("int"))


def _order() -> Column:
    """Rows are rounded up in this order; no two rows are alike in it."""
    return F.struct((-F.col("_score")).alias("s"), F.col("doc_id").alias("d"), F.col("size").alias("z"), F.col("_t").alias("t"), F.col("_k").alias("k"))


def _edges(scored: DataFrame) -> DataFrame:
    """For each source: whether all open rows are rounded up, or else the bin in which rounding up ends and the last row that is.

    Rows of the highest scores of their source are rounded up until the words lacking are taken. A histogram of scores finds
    the bin where that happens; only the rows of that one bin are ordered.
    """
    bins = scored.groupBy(*KEY, "_bin").agg(F.sum(F.col("size") * F.col("_low")).alias("sure"), F.sum(F.when(F.col("_open"), F.col("size")).otherwise(0)).alias("more"), F.first("target").alias("target"))
    by = Window.partitionBy(*KEY)
    lacking = F.col("target") - F.sum("sure").over(by)
    above = F.coalesce(F.sum("more").over(by.orderBy(F.desc("_bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bins = common.checkpoint(bins.withColumns({"_lacking": lacking, "_above": above}))
    edge = bins.where((F.col("_above") + F.col("more") > F.col("_lacking")) & (F.col("_above") <= F.col("_lacking"))).select(*KEY, F.col("_bin").alias("_edge"), "_lacking", "_above")
    all_up = bins.groupBy(*KEY).agg((F.max("_lacking") > 0).alias("_all"))
    close = scored.join(F.broadcast(edge), KEY).where(F.col("_open") & (F.col("_bin") == F.col("_edge"))) if edge.count() <= FEW else scored.join(edge, KEY).where(F.col("_open") & (F.col("_bin") == F.col("_edge")))
    run = F.sum("size").over(by.orderBy(_order()).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_above")
    last = close.select(*KEY, "size", _order().alias("_o"), run.alias("_run"), "_lacking").where(F.col("_run") - F.col("size") / 2 <= F.col("_lacking"))
    return all_up.join(edge.select(*KEY, "_edge"), KEY, "left").join(last.groupBy(*KEY).agg(F.max("_o").alias("_last")), KEY, "left")


def _copies() -> Column:
    up = F.when(F.col("_edge").isNull(), F.col("_all")).otherwise((F.col("_bin") > F.col("_edge")) | (F.col("_bin") == F.col("_edge")) & F.coalesce(_order() <= F.col("_last"), F.lit(False)))
    return F.col("_low") + (F.col("_open") & up).cast("long")


def _plan(sizes: DataFrame, weights: tuple[int, ...]) -> tuple[DataFrame, bool]:
    """All that decides a row's copies beside the row itself: one row for each source, and whether these are few."""
    goals = common.checkpoint(targets(sizes, weights))
    few = goals.count() <= FEW
    sources = common.checkpoint(goals.join(balance(sizes, goals), KEY, "left"))
    edges = _edges(_scored(sizes, sources, few))
    return common.checkpoint(sources.join(edges, KEY, "left")), few


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """doc_id, size, source_size, target, taken, copies and rate for each row of docs.

    Size is the number of words, 0 for null and empty texts, which take nothing. Null is a source of its own, the last.
    Repeated rows count each, and some may be taken once more than others; null doc_ids are rows like others. Other columns are not
    read. No rows give no rows.
    """
    sizes, _ = _numbered(common.checkpoint(_sized(docs, text)))
    sources, few = _plan(sizes, weights)
    out = _scored(sizes, sources, few).withColumn("copies", _copies())
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.col("_rate").alias("rate"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, text: str = "text") -> DataFrame:
    """The rows of docs, each as often as mix() takes it; its columns stay as they are, whatever their names.

    What a row needs for that is its source's row, so texts are read twice but not shuffled. Rows of null or empty text, which
    take no words, stay once. Rows of one source, doc_id and text are interchangeable: each is taken as often as all can be, and
    what is left over is copies of one of them, the first by a digest of its columns; only candidates for that one are shuffled.
    """
    sizes, again = _numbered(common.checkpoint(_sized(docs, text)))
    sources, few = _plan(sizes, weights)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    sized = _sized(docs, text, row).withColumn("_k", F.lit(0).cast("long"))
    repeated = lambda df, n: df.withColumn("_c", F.explode(F.when(n > 0, F.sequence(F.lit(1), n)))).select(*[F.col(f"_row.`{c}`") for c in docs.columns])
    if again is None:
        return repeated(_scored(sized, sources, few), _copies())
    taken = _scored(sizes, sources, few).withColumn("_c", _copies())
    small = F.broadcast(again) if again.count() <= common.FEW else again
    groups = common.checkpoint(taken.join(small, "_g").groupBy("_g").agg(F.sum("_c").alias("_all"), F.count("*").alias("_m")))
    groups = groups.select("_g", F.floor(F.col("_all") / F.col("_m")).alias("_each"), (F.col("_all") % F.col("_m")).alias("_over"))
    scored = _scored(sized, sources, few).join(F.broadcast(groups) if again.count() <= common.FEW else groups, "_g", "left")
    out = repeated(scored, F.coalesce("_each", _copies()))
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f"_row.`{c}`").cast("string"), F.lit("\0")).alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256)
    left_over = scored.where("_over > 0").groupBy("_g").agg(F.min_by("_row", digest).alias("_row"), F.first("_over").alias("_over"))
    return out.unionByName(repeated(left_over, F.col("_over")))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.documents(spark, sf_dir))
