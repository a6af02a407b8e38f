"""Polygons laid on rasters: masks, crops and regions outside an image."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrafold.model import Geo
from terrafold.operators import focal, vector


def to_pixels(verts: DataFrame, geo: Geo) -> DataFrame:
    """verts (poly, idx, x, y in coordinates) with y and x in pixels, as fractions."""
    return verts.select("poly", "idx", ((F.col("y") - geo.oy) / geo.sy).alias("y"), ((F.col("x") - geo.ox) / geo.sx).alias("x"))


def mask(verts: DataFrame, h: int, w: int) -> DataFrame:
    """poly, y, x of the pixels of an h x w raster inside each polygon (poly, idx, y, x in pixels), by the parity of its sides.

    A row of pixels cuts some sides of a polygon; in order of their places, the cuts open and close runs of pixels. Rows are
    those of sides, then of pixels inside; the raster is not read.
    """
    sides = vector.sides(verts).where(F.col("y1") != F.col("y2"))
    lo, hi = F.greatest(F.lit(0), F.ceil(F.least("y1", "y2"))), F.least(F.lit(h - 1), F.ceil(F.greatest("y1", "y2")) - 1)
    cut = (F.col("x2") - F.col("x1")) * (F.col("_y") - F.col("y1")) / (F.col("y2") - F.col("y1")) + F.col("x1")
    cuts = sides.where(lo <= hi).withColumn("_y", F.explode(F.sequence(lo, hi))).select("poly", "_y", F.ceil(cut).alias("_c"))
    runs = cuts.groupBy("poly", "_y").agg(F.sort_array(F.collect_list("_c")).alias("_c"))
    pairs = F.transform(F.sequence(F.lit(0), (F.size("_c") / 2).cast("int") - 1), lambda k: F.struct(F.greatest(F.lit(0), F.get("_c", 2 * k)).alias("a"), F.least(F.lit(w), F.get("_c", 2 * k + 1)).alias("z")))
    open_ = runs.select("poly", F.col("_y").cast("int").alias("y"), F.explode(F.filter(pairs, lambda p: p["a"] < p["z"])).alias("_p"))
    return open_.select("poly", "y", F.explode(F.sequence(F.col("_p.a").cast("int"), (F.col("_p.z") - 1).cast("int"))).alias("x"))


def boxes(verts: DataFrame, h: int, w: int) -> DataFrame:
    """poly, y0, x0, y1, x1: half-open bounds of each polygon's pixels on an h x w raster; none for those beside it."""
    low = lambda v: F.greatest(F.lit(0), F.floor(F.min(v)).cast("int"))
    high = lambda v, n: F.least(F.lit(n), F.floor(F.max(v)).cast("int") + 1)
    out = verts.groupBy("poly").agg(low("y").alias("y0"), low("x").alias("x0"), high("y", h).alias("y1"), high("x", w).alias("x1"))
    return out.where((F.col("y0") < F.col("y1")) & (F.col("x0") < F.col("x1")))


def crop(df: DataFrame, verts: DataFrame, h: int, w: int, fill: float = 0.0, tile: int = 256) -> DataFrame:
    """poly, y, x, z: df cut to each polygon's box, with fill outside the polygon; y and x count from the box's corner.

    Pixels meet boxes in the tiles of the raster that a box spans.
    """
    b = boxes(verts, h, w)
    spread = lambda lo, hi: F.explode(F.sequence(F.floor(F.col(lo) / tile), F.floor((F.col(hi) - 1) / tile)))
    dealt = b.withColumn("_ty", spread("y0", "y1")).withColumn("_tx", spread("x0", "x1"))
    px = df.select("y", "x", "z", F.floor(F.col("y") / tile).alias("_ty"), F.floor(F.col("x") / tile).alias("_tx"))
    held = px.join(dealt, ["_ty", "_tx"]).where((F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    inside = mask(verts, h, w).withColumn("_in", F.lit(True))
    z = F.when(F.col("_in"), F.col("z")).otherwise(F.lit(fill))
    return held.join(inside, ["poly", "y", "x"], "left").select("poly", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), z.alias("z"))


def outside(alpha: DataFrame, h: int, w: int, radius: int = 2, value: str = "a") -> DataFrame:
    """y, x of the pixels without image (value 0), and of those within radius of one."""
    return focal.dilate(alpha.where(F.col(value) == 0).select("y", "x"), h, w, radius)


def buffered(verts: DataFrame, distance: float, steps: int = 16) -> DataFrame:
    """poly, idx, x, y of convex polygons grown by distance: sides moved outwards, corners rounded by `steps` places a quarter.

    Corners turn one way in a convex polygon, whichever way its vertices run; for others the result is that of its hull's turns.
    """
    s = vector.sides(verts)
    area2 = s.groupBy("poly").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("_a"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    turn = F.signum("_a")
    heading = s.join(area2, "poly").withColumn("_t", F.atan2(-dx * turn, dy * turn)).withColumn("_turn", turn)
    w = Window.partitionBy("poly").orderBy("idx")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("_t").over(w), F.last("_t").over(whole))
    corner = heading.withColumn("_before", before)
    sweep = F.pmod((F.col("_t") - F.col("_before")) * F.col("_turn"), F.lit(2 * math.pi)) * F.col("_turn")
    n = F.greatest(F.lit(1), F.ceil(F.abs(sweep) / (math.pi / 2) * steps)).cast("int")
    arc = corner.withColumns({"_sweep": sweep, "_n": n}).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    angle = F.col("_before") + F.col("_sweep") * F.col("_k") / F.col("_n")
    out = arc.select("poly", F.struct("idx", "_k").alias("_o"), (F.col("x1") + distance * F.cos(angle)).alias("x"), (F.col("y1") + distance * F.sin(angle)).alias("y"))
    return out.withColumn("idx", (F.row_number().over(Window.partitionBy("poly").orderBy("_o")) - 1)).select("poly", "idx", "x", "y")
