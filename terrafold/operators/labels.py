"""Instance labels: renumbering, stacking, predicates on pairs of instances."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.model import RasterError
from terrafold.operators.focal import dilate
from terrafold.operators.linked import numbered


def relabel(labels: DataFrame) -> DataFrame:
    """labels numbered 1..k in order of their values; 0 stays. Values are dealt by range and numbered in every part at once."""
    ranks = numbered(labels.where("label <> 0").select("label").distinct(), "label", "_new").withColumn("_new", F.col("_new").cast("int"))
    return labels.join(ranks, "label", "left").select("y", "x", F.coalesce("_new", F.lit(0)).alias("label"))


def replace_values(labels: DataFrame, old: list[int], new: list[int]) -> DataFrame:
    """Values of old become those of new, all at once; of a value given twice the first counts; others stay."""
    if len(old) != len(new):
        raise RasterError("old and new values differ in number")
    change = dict(zip(reversed(old), reversed(new), strict=True))
    if not change:
        return labels
    table = F.create_map(*[F.lit(v) for kv in change.items() for v in kv])
    return labels.withColumn("label", F.coalesce(F.try_element_at(table, F.col("label")), F.col("label")))


def stack(first: DataFrame, second: DataFrame, shift: int, axis: str = "y") -> DataFrame:
    """second moved by shift along axis behind first, its labels above those of first; renumbered."""
    top = first.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top"))
    moved = second.crossJoin(F.broadcast(top)).withColumn("label", F.when(F.col("label") != 0, F.col("label") + F.col("_top")).otherwise(0)).withColumn(axis, F.col(axis) + shift)
    return relabel(first.select("y", "x", "label").unionByName(moved.select("y", "x", "label")))


def border_labels(labels: DataFrame, h: int, w: int, width: int = 1, sides: str = "tblr") -> DataFrame:
    """label of each instance with a pixel within width of one of the sides (t, b, l, r)."""
    tests = {"t": F.col("y") < width, "b": F.col("y") >= h - width, "l": F.col("x") < width, "r": F.col("x") >= w - width}
    on = F.lit(False)
    for s in sides:
        on = on | tests[s]
    return labels.where(F.col("label") != 0).where(on).select("label").distinct()


def split_by_border(labels: DataFrame, h: int, w: int, width: int, sides: str = "tblr") -> tuple[DataFrame, DataFrame]:
    """labels of the instances that touch the border, and of those that do not."""
    edge = border_labels(labels, h, w, width, sides)
    fg = labels.where("label <> 0")
    return fg.join(edge, "label", "left_semi"), fg.join(edge, "label", "left_anti")


def overlapping(a: DataFrame, b: DataFrame) -> DataFrame:
    """label_a, label_b, n for instances of two rasters that share n pixels."""
    x = a.where("label <> 0").select("y", "x", F.col("label").alias("label_a"))
    return x.join(b.where("label <> 0").select("y", "x", F.col("label").alias("label_b")), ["y", "x"]).groupBy("label_a", "label_b").agg(F.count("*").alias("n"))


def touching(labels: DataFrame, h: int, w: int) -> DataFrame:
    """label_a < label_b of instances of one raster with pixels side by side."""
    fg = labels.where("label <> 0")
    grown = dilate(fg, h, w, radius=1, keep=["label"]).select("y", "x", F.col("label").alias("label_a"))
    pairs = grown.join(fg.select("y", "x", F.col("label").alias("label_b")), ["y", "x"]).where("label_a < label_b")
    return pairs.select("label_a", "label_b").distinct()


def inside_pairs(a: DataFrame, b: DataFrame, factor: int = 4, ratio: float = 0.8) -> DataFrame:
    """label_a, label_b where, on every factor-th pixel, the shared ones reach ratio of the smaller instance."""
    thin = lambda df: df.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0) & (F.col("label") != 0))
    size = lambda df, k: thin(df).groupBy(F.col("label").alias(k)).agg(F.count("*").alias(f"_{k}"))
    hit = overlapping(thin(a), thin(b))
    out = hit.join(size(a, "label_a"), "label_a").join(size(b, "label_b"), "label_b")
    return out.where(F.col("n") >= F.least("_label_a", "_label_b") * ratio).select("label_a", "label_b")


def clip_to(labels: DataFrame, region: DataFrame) -> DataFrame:
    """Instances of labels without a pixel in region (y, x)."""
    hit = labels.where("label <> 0").join(region.select("y", "x"), ["y", "x"], "left_semi").select("label").distinct()
    return labels.where("label <> 0").join(hit, "label", "left_anti")
