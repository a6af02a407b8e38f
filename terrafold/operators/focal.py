"""Neighbourhood operators as joins over offsets and as window frames along rows and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def disk(radius: int) -> list[tuple[int, int]]:
    return [(dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1) if dy * dy + dx * dx <= radius * radius]


def dilate(mask: DataFrame, h: int, w: int, radius: int = 1, keep: list[str] | None = None) -> DataFrame:
    """Pixels (y, x, with the columns to keep) within radius of a pixel of mask: each is moved by every offset of the disk."""
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk(radius)])
    moved = mask.withColumn("_m", F.explode(moves)).select((F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"), *(keep or []))
    return moved.where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w)).distinct()


def erode(mask: DataFrame, h: int, w: int, radius: int = 1) -> DataFrame:
    """Pixels of mask whose whole disk, as far as it is on the raster, is in mask: counted, not subtracted from a grid."""
    offsets = disk(radius)
    moves = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    votes = mask.select("y", "x").withColumn("_m", F.explode(moves)).select((F.col("y") + F.col("_m.dy")).alias("y"), (F.col("x") + F.col("_m.dx")).alias("x"))
    need = F.lit(0)
    for dy, dx in offsets:
        need = need + ((F.col("y") + dy >= 0) & (F.col("y") + dy < h) & (F.col("x") + dx >= 0) & (F.col("x") + dx < w)).cast("int")
    counted = votes.groupBy("y", "x").agg(F.count("*").alias("_n")).where((F.col("y") >= 0) & (F.col("y") < h) & (F.col("x") >= 0) & (F.col("x") < w))
    return counted.where(F.col("_n") == need).select("y", "x")


def opened(mask: DataFrame, h: int, w: int, radius: int = 1) -> DataFrame:
    return dilate(erode(mask, h, w, radius), h, w, radius)


def closed(mask: DataFrame, h: int, w: int, radius: int = 1) -> DataFrame:
    return erode(dilate(mask, h, w, radius), h, w, radius)


#: Rows or columns of a band: a line of pixels is cut into bands, so no task holds a whole one, however long.
BAND = 2048


def _along(df: DataFrame, fixed: str, moving: str, radius: int, value: Column, name: str) -> DataFrame:
    """df with value over the pixels within radius along one axis. Pixels near a band's end go to both bands."""
    band = lambda shift: F.floor((F.col(moving) + shift) / BAND)
    banded = df.withColumn("_band", F.explode(F.array_distinct(F.array(band(-radius), band(0), band(radius)))))
    w = Window.partitionBy(fixed, "_band").orderBy(moving).rangeBetween(-radius, radius)
    return banded.withColumn(name, value.over(w)).where(F.col("_band") == band(0)).drop("_band")


def focal_max(df: DataFrame, radius: int = 1, z: str = "z") -> DataFrame:
    """The largest z of the square around each pixel: along columns, then along rows."""
    first = _along(df.select("y", "x", z), "x", "y", radius, F.max(z), "_c")
    return _along(first.select("y", "x", "_c"), "y", "x", radius, F.max("_c"), z).select("y", "x", z)


def column_median(df: DataFrame, radius: int = 2, z: str = "z") -> DataFrame:
    """Median of z over 2 * radius + 1 rows of a column; frames end at the raster."""
    return _along(df.select("y", "x", F.col(z).alias("_z")), "x", "y", radius, F.percentile("_z", F.lit(0.5)), z).select("y", "x", z)


def border_coords(mask: DataFrame, h: int, w: int, step: int) -> DataFrame:
    """y and x of the outline of mask on every step-th pixel, and of the raster's own frame, at the middle of a step."""
    small = mask.where((F.col("y") % step == 0) & (F.col("x") % step == 0)).select(F.floor(F.col("y") / step).cast("int").alias("y"), F.floor(F.col("x") / step).cast("int").alias("x"))
    sh, sw = -(-h // step), -(-w // step)
    ring = dilate(small, sh, sw).join(small, ["y", "x"], "left_anti")
    spark = mask.sparkSession
    rows, cols = spark.range(sh).select(F.col("id").cast("int").alias("y")), spark.range(sw).select(F.col("id").cast("int").alias("x"))
    frame = rows.select("y", F.explode(F.array(F.lit(0), F.lit(sw - 1))).alias("x")).unionByName(cols.select(F.explode(F.array(F.lit(0), F.lit(sh - 1))).alias("y"), "x"))
    return ring.unionByName(frame).distinct().select((F.col("y") * step + step // 4).alias("y"), (F.col("x") * step + step // 4).alias("x"))
