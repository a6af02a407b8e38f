"""Two-dimensional windows: tiling, cropping, splitting, mosaics, and resampling by index."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.model import Geo, RasterError

STAR = ("top", "left", "bottom", "right")


def _shift(df: DataFrame, y0: Column | int, x0: Column | int) -> DataFrame:
    return df.withColumns({"y": (F.col("y") - y0).cast("int"), "x": (F.col("x") - x0).cast("int")})


def crop(df: DataFrame, y0: int, x0: int, h: int, w: int) -> DataFrame:
    return _shift(df.where((F.col("y") >= y0) & (F.col("y") < y0 + h) & (F.col("x") >= x0) & (F.col("x") < x0 + w)), y0, x0)


def center_crop(df: DataFrame, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    return crop(df, (h - new_h) // 2, (w - new_w) // 2, new_h, new_w)


def split_four(df: DataFrame, h: int, w: int) -> DataFrame:
    """df with quadrant (0 top left, 1 top right, 2, 3) and y, x within it; an odd last row or column goes."""
    hh, hw = h // 2, w // 2
    inside = df.where((F.col("y") < 2 * hh) & (F.col("x") < 2 * hw))
    q = (F.floor(F.col("y") / hh) * 2 + F.floor(F.col("x") / hw)).cast("int")
    return inside.withColumn("quadrant", q).withColumns({"y": F.col("y") % hh, "x": F.col("x") % hw})


def split_star(df: DataFrame, h: int, w: int) -> DataFrame:
    """df with side, for four overlapping half-size windows in the middle of each side."""
    hh, hw = h // 2, w // 2
    starts = {"top": (0, hw // 2), "left": (hh // 2, 0), "bottom": (h - hh, hw // 2), "right": (hh // 2, w - hw)}
    spots = F.array(*[F.struct(F.lit(k).alias("side"), F.lit(starts[k][0]).alias("y0"), F.lit(starts[k][1]).alias("x0")) for k in STAR])
    hit = F.filter(spots, lambda s: (F.col("y") >= s["y0"]) & (F.col("y") < s["y0"] + hh) & (F.col("x") >= s["x0"]) & (F.col("x") < s["x0"] + hw))
    out = df.withColumn("_s", F.explode(hit)).withColumn("side", F.col("_s.side"))
    return _shift(out, F.col("_s.y0"), F.col("_s.x0")).drop("_s")


def patch_starts(length: int, size: int, overlap: float = 0.25) -> list[int]:
    """Starts of overlapping patches along an axis; one patch starts at 0."""
    if length < size:
        raise RasterError(f"patches of {size} do not fit into {length}")
    n = 1 + math.ceil((length - size) / (size - size * overlap))
    offset = int((length - size) / (n - 1)) if n > 1 else 0
    return [k * offset for k in range(n)]


def sliding_patches(df: DataFrame, h: int, w: int, size: int, overlap: float = 0.25) -> DataFrame:
    """df with py, px (the patch's start), each pixel once for each patch that covers it, y and x within the patch."""

    def covering(length: int, v: str) -> Column:
        starts = patch_starts(length, size, overlap)
        n, offset = len(starts), starts[-1] // max(1, len(starts) - 1)
        if offset == 0:
            return F.filter(F.array(*[F.lit(s) for s in starts]), lambda s: (F.col(v) >= s) & (F.col(v) < s + size))
        first, last = F.greatest(F.lit(0), F.floor((F.col(v) - size) / offset) + 1), F.least(F.lit(n - 1), F.floor(F.col(v) / offset))
        return F.when(first <= last, F.transform(F.sequence(first, last), lambda k: (k * offset).cast("int")))

    out = df.withColumn("py", F.explode(covering(h, "y"))).withColumn("px", F.explode(covering(w, "x")))
    return _shift(out, F.col("py"), F.col("px"))


def tile_grid(spark, geo: Geo, size: float) -> DataFrame:
    """tile, cx, cy, y0, x0, y1, x1 of the tiles of size metres that start inside the raster, columns first."""
    step = round(size / abs(geo.sx))
    fx, fy = math.floor(geo.ox / size) * size, math.floor(geo.oy / size) * size
    fx += size if fx < geo.ox else 0.0
    fy -= size if fy > geo.oy else 0.0
    nx, ny = math.floor(geo.w * abs(geo.sx) / size) + 1, math.floor(geo.h * abs(geo.sy) / size) + 1
    ids = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"))
    at = ids.select((F.col("i") * ny + F.col("j")).alias("tile"), (F.lit(fx) + F.col("i") * size).alias("cx"), (F.lit(fy) - F.col("j") * size).alias("cy"))
    y0, x0 = F.bround((F.col("cy") - geo.oy) / geo.sy, 0).cast("int"), F.bround((F.col("cx") - geo.ox) / geo.sx, 0).cast("int")
    out = at.withColumns({"y0": y0, "x0": x0, "y1": y0 + step, "x1": x0 + step})
    return out.where((F.col("y0") >= 0) & (F.col("x0") >= 0) & (F.col("y1") <= geo.h) & (F.col("x1") <= geo.w))


def in_tiles(df: DataFrame, size: int) -> DataFrame:
    """df with ty and tx: the number of the size x size tile of each pixel."""
    return df.withColumns({"ty": F.floor(F.col("y") / size).cast("int"), "tx": F.floor(F.col("x") / size).cast("int")})


def tile_valid_ratio(mask: DataFrame, size: int, value: str = "a") -> DataFrame:
    """ty, tx, ratio: share of the whole raster's largest value that a tile's mean reaches."""
    top = mask.agg(F.max(value).alias("_m"))
    sums = in_tiles(mask, size).groupBy("ty", "tx").agg(F.sum(value).alias("_s"))
    return sums.crossJoin(F.broadcast(top)).select("ty", "tx", (F.col("_s") / (size * size) / F.col("_m")).alias("ratio"))


def nearest_border(tiles: DataFrame, border: DataFrame, cell: int) -> DataFrame:
    """tiles (tile, y, x) with distance, in pixels, to the nearest border pixel at most cell away; others have null.

    Both sides are dealt by cells of that size, and a tile looks into the nine cells around it: no pair is further apart.
    """
    key = lambda df: df.withColumns({"_cy": F.floor(F.col("y") / cell), "_cx": F.floor(F.col("x") / cell)})
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    near = key(tiles).withColumn("_d", F.explode(steps)).withColumns({"_cy": F.col("_cy") + F.col("_d.i"), "_cx": F.col("_cx") + F.col("_d.j")})
    b = key(border).select("_cy", "_cx", F.col("y").alias("_by"), F.col("x").alias("_bx"))
    d = F.sqrt((F.col("y") - F.col("_by")) * (F.col("y") - F.col("_by")) + (F.col("x") - F.col("_bx")) * (F.col("x") - F.col("_bx")))
    found = near.join(b, ["_cy", "_cx"]).withColumn("_v", d).where(F.col("_v") <= cell).groupBy("tile").agg(F.min("_v").alias("distance"))
    return tiles.join(found, "tile", "left")


def mosaic(tiles: DataFrame) -> DataFrame:
    """y, x, z of tiles (seq, oy, ox, y, x, z) laid at their offsets; the tile with the largest seq covers others."""
    placed = tiles.select((F.col("y") + F.col("oy")).alias("y"), (F.col("x") + F.col("ox")).alias("x"), "seq", "z")
    return placed.groupBy("y", "x").agg(F.max_by("z", "seq").alias("z"))


def dense(df: DataFrame, h: int, w: int, fill: float = 0.0, z: str = "z") -> DataFrame:
    """df on every pixel of h x w, with fill where it has none."""
    grid = df.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    return grid.join(df.select("y", "x", z), ["y", "x"], "left").withColumn(z, F.coalesce(z, F.lit(fill)))


def downsample(df: DataFrame, factor: int) -> DataFrame:
    kept = df.where((F.col("y") % factor == 0) & (F.col("x") % factor == 0))
    return kept.withColumns({"y": F.floor(F.col("y") / factor).cast("int"), "x": F.floor(F.col("x") / factor).cast("int")})


def upscale(df: DataFrame, factor: int) -> DataFrame:
    steps = F.sequence(F.lit(0), F.lit(factor - 1))
    out = df.withColumn("_i", F.explode(steps)).withColumn("_j", F.explode(steps))
    return out.withColumns({"y": F.col("y") * factor + F.col("_i"), "x": F.col("x") * factor + F.col("_j")}).drop("_i", "_j")


def resize_nearest(df: DataFrame, h: int, w: int, new_h: int, new_w: int) -> DataFrame:
    """Each target pixel takes the source pixel floor(i * old / new): sources list the targets that read them, those outside the raster none."""

    def readers(v: str, old: int, new: int) -> Column:
        at = F.col(v).cast("long")  # v * new is more than an int on a raster of 50,000 rows
        lo, hi = F.greatest(F.lit(0), F.ceil(at * new / old)), F.least(F.lit(new - 1), F.ceil((at + 1) * new / old) - 1)
        return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<long>"))

    out = df.withColumn("_i", F.explode(readers("y", h, new_h))).withColumn("_j", F.explode(readers("x", w, new_w)))
    return out.withColumns({"y": F.col("_i").cast("int"), "x": F.col("_j").cast("int")}).drop("_i", "_j")


def flip(df: DataFrame, h: int, w: int, axis: int = 0) -> DataFrame:
    return df.withColumn("y", h - 1 - F.col("y")) if axis == 0 else df.withColumn("x", w - 1 - F.col("x"))


def shrink(mask: DataFrame, h: int, w: int, factor: float = 0.1) -> DataFrame:
    """mask made smaller about the middle: padded by a share of each side, then resized back."""
    ph, pw = int(h * factor), int(w * factor)
    padded = mask.withColumns({"y": F.col("y") + ph, "x": F.col("x") + pw})
    return resize_nearest(padded, h + 2 * ph, w + 2 * pw, h, w)


def pad_place(df: DataFrame, h: int, w: int, cy: int, cx: int, size: int) -> DataFrame:
    """df centred at (cy, cx) on a size x size canvas; what lies outside goes."""
    moved = df.withColumns({"y": F.col("y") + (cy - h // 2), "x": F.col("x") + (cx - w // 2)})
    return moved.where((F.col("y") >= 0) & (F.col("y") < size) & (F.col("x") >= 0) & (F.col("x") < size))


def sample_points(spark, h: int, w: int, most: int = 3, halve: bool = True, center: bool = True) -> DataFrame:
    """py, px of a grid of seeds: `most` along the long side, in proportion along the other."""
    long_, short = max(h, w), min(h, w)
    n_short = most if h == w else max(1, math.ceil(most / (long_ / short)))
    nh, nw = (most, n_short) if h >= w else (n_short, most)
    k = F.col("id")
    at = spark.range(nh * nw).select((k + 1).alias("_k"), ((F.floor(k / nw) + 1) * (h / (nh + 1))).cast("int").alias("py"), ((k % nw + 1) * (w / (nw + 1))).cast("int").alias("px"))
    if halve and nh > 2 and nw > 2:
        at = at.where(F.col("_k") % 2 == 0)
    out = at.select("py", "px")
    if center:
        out = out.unionByName(spark.range(1).select(F.lit(h // 2).alias("py"), F.lit(w // 2).alias("px")))
    return out.distinct()
