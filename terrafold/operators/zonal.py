"""Aggregates over instances and classes of label rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def zonal_stats(labels: DataFrame, values: DataFrame) -> DataFrame:
    """label, n, max, mean, and half-open bounds y0..y1, x0..x1 of each instance; 0 is background.

    The mean comes from a decimal sum, so it is the same in every order of the pixels.
    """
    both = labels.where("label <> 0").join(values.select("y", "x", "z"), ["y", "x"])
    return both.groupBy("label").agg(
        F.count("*").alias("n"), F.max("z").alias("z_max"), F.bround(F.sum(F.col("z").cast("decimal(20,6)")).cast("double") / F.count("*"), 6).alias("z_mean"),
        F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"),
    )


def bounds(labels: DataFrame, by: list[str]) -> DataFrame:
    return labels.where("label <> 0").groupBy(*by).agg(F.min("y").alias("y0"), (F.max("y") + 1).alias("y1"), F.min("x").alias("x0"), (F.max("x") + 1).alias("x1"))


def area(labels: DataFrame, scale: float) -> DataFrame:
    return labels.where("label <> 0").groupBy("label").agg(F.bround(F.count("*") * F.lit(scale * scale), 3).alias("area"))


def centers(labels: DataFrame) -> DataFrame:
    """A pixel of each instance: the upper median row, then the upper median column on that row.

    Counts a row and label come first, so a median is found among rows of the raster, not among pixels.
    """
    fg = labels.where("label <> 0")

    def upper(df: DataFrame, by: list[str], v: str) -> DataFrame:
        counts = df.groupBy(*by, v).agg(F.count("*").alias("_n"))
        w = Window.partitionBy(*by)
        run = counts.withColumn("_run", F.sum("_n").over(w.orderBy(v))).withColumn("_all", F.sum("_n").over(w))
        return run.where(F.col("_run") > F.floor(F.col("_all") / 2)).groupBy(*by).agg(F.min(v).alias(v))

    rows = upper(fg, ["label"], "y")
    return upper(fg.join(rows, ["label", "y"]), ["label", "y"], "x")


def without_low(labels: DataFrame, heights: DataFrame, least: float) -> DataFrame:
    """labels whose instances below `least` everywhere are background."""
    tall = labels.where("label <> 0").join(heights.select("y", "x", "z"), ["y", "x"]).groupBy("label").agg(F.max("z").alias("_m")).where(F.col("_m") >= least).select("label", F.lit(True).alias("_tall"))
    return labels.join(tall, "label", "left").select("y", "x", F.when(F.col("_tall"), F.col("label")).otherwise(0).alias("label"))


def class_weights(pixels: DataFrame, tile: str | None = None, cls: str = "cls") -> DataFrame:
    """Share of each class: of all pixels, or, with tile, the mean over tiles of the shares within each."""
    if tile is None:
        counts = pixels.groupBy(cls).agg(F.count("*").alias("_n"))
        total = counts.agg(F.sum("_n").alias("_all"))
        return counts.crossJoin(F.broadcast(total)).select(cls, (F.col("_n") / F.col("_all")).alias("weight"))
    counts = pixels.groupBy(tile, cls).agg(F.count("*").alias("_n"))
    share = counts.join(counts.groupBy(tile).agg(F.sum("_n").alias("_all")), tile).select(cls, (F.col("_n") / F.col("_all")).alias("_s"))
    tiles = counts.agg(F.count_distinct(tile).alias("_tiles"))
    return share.groupBy(cls).agg(F.sum("_s").alias("_s")).crossJoin(F.broadcast(tiles)).select(cls, (F.col("_s") / F.col("_tiles")).alias("weight"))


def spread_unknown(weights: DataFrame, n: int, cls: str = "cls") -> DataFrame:
    """weights with the unknown class (1) shared evenly by the classes from 1 to n - 1."""
    unknown = weights.where(F.col(cls) == 1).agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_u"))
    own = F.when(F.col(cls) == 1, 0.0).otherwise(F.col("weight"))
    more = F.when(F.col(cls) == 0, 0.0).otherwise(F.col("_u") / (n - 1))
    return weights.crossJoin(F.broadcast(unknown)).select(cls, (own + more).alias("weight"))


def mask_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """iou of two sets of pixels (y, x): one row; 0 where both are empty."""
    both = a.select("y", "x", F.lit(1).alias("_a")).join(b.select("y", "x", F.lit(1).alias("_b")), ["y", "x"], "full")
    n = both.agg(F.count(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), 1)).alias("_i"), F.count("*").alias("_u"))
    return n.select(F.coalesce(F.try_divide("_i", "_u"), F.lit(0.0)).alias("iou"))


def label_iou(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_a, label_b, iou of the instances of two label rasters that share a pixel."""
    size = lambda df, k: df.where("label <> 0").groupBy(F.col("label").alias(k)).agg(F.count("*").alias(f"_{k}"))
    hit = a.where("label <> 0").select("y", "x", F.col("label").alias("label_a")).join(b.where("label <> 0").select("y", "x", F.col("label").alias("label_b")), ["y", "x"])
    common = hit.groupBy("label_a", "label_b").agg(F.count("*").alias("_i"))
    out = common.join(size(a, "label_a"), "label_a").join(size(b, "label_b"), "label_b")
    return out.select("label_a", "label_b", (F.col("_i") / (F.col("_label_a") + F.col("_label_b") - F.col("_i"))).alias("iou"))


def soft_jaccard(df: DataFrame, t: str, p: str) -> DataFrame:
    s = df.agg(F.sum(F.col(t) * F.col(p)).alias("i"), F.sum(t).alias("a"), F.sum(p).alias("b"))
    return s.select(((F.col("i") + 1) / (F.col("a") + F.col("b") - F.col("i") + 1)).alias("jaccard"))


def weighted_mean_iou(df: DataFrame, truth: str, guess: str, weights: DataFrame, skip_background: bool = False) -> DataFrame:
    """Mean of the classes' smoothed Jaccard coefficients, weighted by weights (cls, weight)."""
    per = df.select(F.explode(F.array(F.struct(F.col(truth).alias("c"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col(truth) == F.col(guess)).cast("int").alias("i")), F.struct(F.col(guess).alias("c"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("i")))).alias("v"))
    sums = per.groupBy(F.col("v.c").alias("cls")).agg(F.sum("v.t").alias("t"), F.sum("v.p").alias("p"), F.sum("v.i").alias("i"))
    used = weights.where("cls <> 0") if skip_background else weights
    iou = (F.coalesce("i", F.lit(0)) + 1) / (F.coalesce("t", F.lit(0)) + F.coalesce("p", F.lit(0)) - F.coalesce("i", F.lit(0)) + 1)
    return used.join(sums, "cls", "left").agg((F.sum(F.col("weight") * iou) / F.sum("weight")).alias("mean_iou"))


def tops(labels: DataFrame, values: DataFrame, share: float = 0.15) -> DataFrame:
    """label, y, x of each instance's top: its pixels above a level of its scaled height (0..1), which is lowered by hundredths from 0.99
    until `share` of its pixels lie above it, as far as they also lie above 1 - share."""
    both = labels.where("label <> 0").join(values.select("y", "x", "z"), ["y", "x"])
    span = both.groupBy("label").agg(F.min("z").alias("_lo"), F.max("z").alias("_hi"), F.count("*").alias("_n"))
    u = (F.col("z") - F.col("_lo")) / F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    scaled = both.join(span, "label").withColumn("_u", u)
    # the first level that a pixel lies above, from a histogram of at most a hundred rows for each instance
    level = F.array_min(F.filter(F.sequence(F.lit(0), F.lit(99)), lambda k: F.col("_u") > (99 - k) / 100.0))
    counted = scaled.withColumn("_k", level).where("_k is not null").groupBy("label", "_n", "_k").agg(F.count("*").alias("_m"))
    reached = counted.withColumn("_m", F.sum("_m").over(Window.partitionBy("label").orderBy("_k"))).where(F.col("_m") >= share * F.col("_n")).groupBy("label").agg(F.min("_k").alias("_k"))
    return scaled.join(reached, "label").where((F.col("_u") > (99 - F.col("_k")) / 100.0) & (F.col("_u") > 1 - share)).select("label", "y", "x")


def silhouette(columns: DataFrame, padding: int = 0) -> DataFrame:
    """y, x of a filled outline from the heights of its columns (x, n), the ground at the bottom; columns of 0 or less are empty."""
    top = columns.agg(F.max("n").alias("_h"))
    filled = columns.where("n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1), F.col("n")))).crossJoin(F.broadcast(top))
    return filled.select((F.col("_h") - F.col("_i") + padding).cast("int").alias("y"), (F.col("x") + padding).cast("int").alias("x"))
