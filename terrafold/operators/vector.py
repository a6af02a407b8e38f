"""Polygons as vertex rows (poly, idx, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sides(verts: DataFrame) -> DataFrame:
    """poly, idx, x1, y1, x2, y2 of the closed ring's sides."""
    w = Window.partitionBy("poly").orderBy("idx")
    all_ = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = lambda v: F.coalesce(F.lead(v).over(w), F.first(v).over(all_))
    return verts.select("poly", "idx", F.col("x").alias("x1"), F.col("y").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"))


def area(verts: DataFrame) -> DataFrame:
    cross = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    return sides(verts).groupBy("poly").agg(F.bround(F.abs(F.sum(cross)) / 2, 6).alias("area"))


def perimeter(verts: DataFrame) -> DataFrame:
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return sides(verts).groupBy("poly").agg(F.bround(F.sum(F.sqrt(dx * dx + dy * dy)), 6).alias("perimeter"))


def points_inside(verts: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """poly, pid of the points inside, by the parity of sides to their right.

    Sides are dealt to the rows of cells that they span and, there, to the columns of their polygon and one more at either end;
    points to their cell. So only sides at a point's height, of polygons about it, meet it.
    """
    span = lambda lo, hi: F.sequence(F.floor(lo / cell), F.floor(hi / cell))
    wide = verts.groupBy("poly").agg(F.min("x").alias("_lo"), F.max("x").alias("_hi"))
    dealt = sides(verts).where(F.col("y1") != F.col("y2")).join(wide, "poly").withColumn("_row", F.explode(span(F.least("y1", "y2"), F.greatest("y1", "y2"))))
    dealt = dealt.withColumn("_col", F.explode(span(F.col("_lo") - cell, F.col("_hi") + cell)))
    at = points.withColumns({"_row": F.floor(F.col("y") / cell), "_col": F.floor(F.col("x") / cell)})
    cut = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    hit = dealt.join(at, ["_row", "_col"]).where(((F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))) & (F.col("x") < cut))
    return hit.groupBy("poly", "pid").agg(F.count("*").alias("_n")).where(F.col("_n") % 2 == 1).select("poly", "pid")


def all_inside(verts: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """poly, inside: whether every point is inside; false where there is none."""
    found = points_inside(verts, points, cell).groupBy("poly").agg(F.count("*").alias("_in"))
    total = points.agg(F.count("*").alias("_all"))
    return verts.select("poly").distinct().join(found, "poly", "left").crossJoin(F.broadcast(total)).select("poly", ((F.col("_all") > 0) & (F.coalesce("_in", F.lit(0)) == F.col("_all"))).alias("inside"))
