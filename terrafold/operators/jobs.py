"""Whole jobs over rasters, composed of operators."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.functions import paths
from terrafold.model import EPSG_GPS, Geo, RasterError
from terrafold.operators import blocks, focal, geodesy, grid, ground, halo, linked, mapalg, regions, trees, vector, zonal


def height_model(surface: DataFrame, surface_geo: Geo, terrain: DataFrame, terrain_geo: Geo, capture: float = 60.0, correct: bool = False, like: Geo | None = None, step: int = 500) -> tuple[DataFrame, Geo]:
    """Heights above ground and their grid: both rasters brought to the size of `like` if it is given, the terrain smoothed if it is to
    be corrected, and the difference. Rasters of unlike size or system are refused."""

    def sized(df: DataFrame, geo: Geo) -> tuple[DataFrame, Geo]:
        if like is None or (geo.h, geo.w) == (like.h, like.w):
            return df, geo
        return halo.resize(df, geo.h, geo.w, like.h, like.w, "cubic"), Geo(like.h, like.w, geo.epsg, geo.ox, geo.oy, like.sx, like.sy)

    (surface, geo), (terrain, other) = sized(surface, surface_geo), sized(terrain, terrain_geo)
    geo.require_same_grid(other)
    if correct:
        terrain = ground.ground(terrain, geo.h, geo.w, step)
    return mapalg.height_above_ground(surface, terrain, capture), geo


def rescaled(df: DataFrame, geo: Geo, scale: float) -> tuple[DataFrame, Geo]:
    """df at another pixel size, with its grid: as many whole pixels as fit best, and the size that these then have."""
    h, w = max(1, round(geo.h * abs(geo.sy) / scale)), max(1, round(geo.w * abs(geo.sx) / scale))
    new = geo.w * abs(geo.sx) / w
    return halo.resize(df, geo.h, geo.w, h, w, "cubic"), Geo(h, w, geo.epsg, geo.ox, geo.oy, new, -new)


def valid_tiles(alpha: DataFrame, geo: Geo, size: float, step: int, ratio: float = 0.98, least: float | None = None, value: str = "a") -> DataFrame:
    """tile, cx, cy, y0, x0, y1, x1, ratio, distance of the tiles of size metres that lie on the image: its mask's mean reaches ratio of the
    largest value, and no outline, on every step-th pixel, is nearer to the tile's middle than least metres."""
    if geo.epsg == EPSG_GPS:
        raise RasterError("tiles are cut in metres")
    least = size / 2 * 1.414 * 1.01 if least is None else least
    side = round(size / abs(geo.sx))
    at = grid.tile_grid(alpha.sparkSession, geo, size)
    first = at.agg(F.min("y0").alias("_fy"), F.min("x0").alias("_fx"))
    snap = lambda v, f: (F.floor((F.col(v) - F.col(f)) / side) * side + F.col(f)).cast("int")
    sums = alpha.crossJoin(F.broadcast(first)).groupBy(snap("y", "_fy").alias("y0"), snap("x", "_fx").alias("x0")).agg(F.sum(value).alias("_s"))
    top = alpha.agg(F.max(value).alias("_m"))
    full = at.join(sums, ["y0", "x0"]).crossJoin(F.broadcast(top)).withColumn("ratio", F.col("_s") / (side * side) / F.col("_m")).where(F.col("ratio") >= ratio).drop("_s", "_m")
    middle = full.withColumns({"y": (F.col("y0") + side / 2).cast("int"), "x": (F.col("x0") + side / 2).cast("int")})
    rim = focal.border_coords(alpha.where(F.col(value) != 0).select("y", "x"), geo.h, geo.w, step).withColumn("z", F.lit(0.0))
    near = ground.nearest(middle.select("y", "x").distinct(), rim, max(geo.h, geo.w), cell=max(8, math.ceil(least / abs(geo.sx)))).select("y", "x", (F.floor(F.sqrt("d2")) * abs(geo.sx)).alias("distance"))
    return middle.join(near, ["y", "x"]).where(F.col("distance") >= least).drop("y", "x")


def cut_tiles(df: DataFrame, tiles: DataFrame, size: float, geo: Geo, date: str | None = None) -> DataFrame:
    """tile (a file name that tells size, place, date and distance), y, x and the other columns of df on each of valid_tiles()."""
    side = round(size / abs(geo.sx))
    name = paths.tile_name(F.lit(int(size)), F.col("cx"), F.col("cy"), F.lit(date).cast("string"), F.col("distance"))
    named = tiles.select(name.alias("tile"), "y0", "x0")
    first = named.agg(F.min("y0").alias("_fy"), F.min("x0").alias("_fx"))
    snap = lambda v, f: (F.floor((F.col(v) - F.col(f)) / side) * side + F.col(f)).cast("int")
    keyed = df.crossJoin(F.broadcast(first)).withColumns({"y0": snap("y", "_fy"), "x0": snap("x", "_fx")})
    rest = [c for c in df.columns if c not in ("y", "x")]
    return keyed.join(named, ["y0", "x0"]).select("tile", (F.col("y") - F.col("y0")).alias("y"), (F.col("x") - F.col("x0")).alias("x"), *rest)


def city_zones(streets: DataFrame, geo: Geo, seeds: int = 3, radius: float = 500.0, safe: float = 10.0, least: float = 2500.0, skip: list[str] | None = None) -> DataFrame:
    """uuid, nodes, ring, area, n of the city blocks around a grid of seeds on the raster, those that lie, with `safe` metres around them,
    within it. streets are in the raster's system."""
    at = grid.sample_points(streets.sparkSession, geo.h, geo.w, seeds)
    points = at.select(F.concat_ws("_", "py", "px").alias("seed"), (geo.ox + F.col("px") * geo.sx).alias("x"), (geo.oy + F.col("py") * geo.sy).alias("y"))
    found = blocks.zones(blocks.around(streets, points, radius, skip), least)
    x0, y0, x1, y1 = geo.bbox()
    inside = F.forall("ring", lambda p: (p["x"] - safe >= x0) & (p["x"] + safe <= x1) & (p["y"] - safe >= y0) & (p["y"] + safe <= y1))
    return found.where(inside)


def crop_zones(df: DataFrame, zones: DataFrame, geo: Geo, dilate: float = 15.0, fill: float = 0.0) -> DataFrame:
    """poly (the zone's uuid), y, x, z of df cut to each zone, grown by dilate metres as its outline's hull turns; fill outside."""
    verts = blocks.rows_of(zones).withColumnRenamed("uuid", "poly")
    wide = regions.buffered(verts, dilate) if dilate > 0 else verts
    return regions.crop(df, regions.to_pixels(wide, geo), geo.h, geo.w, fill)


def registration(image_point: tuple[float, float], map_point: tuple[float, float], geo: Geo) -> tuple[tuple[float, float], Geo]:
    """The translation, to the decimetre, that brings a place of the image to its place on the map, and the grid moved by it."""
    x, y = (round(m - i, 1) for m, i in zip(map_point, image_point, strict=True))
    return (x, y), geo.translated(x, y)


def tree_models(labels: DataFrame, heights: DataFrame, terrain: DataFrame, alpha: DataFrame, geo: Geo, uuid: str, least_height: float = 3.0, least_radius: float = 1.5, offset: float | bool = True) -> tuple[DataFrame, DataFrame]:
    """OBJ lines (section, seq, line) and metadata rows of the trees that lie wholly on the image, are wide and are tall enough."""
    scale = abs(geo.sx)
    picked = linked.checkpoint(trees.chosen(labels, heights, regions.outside(alpha, geo.h, geo.w), geo.h, geo.w, scale, least_height, least_radius))
    kept = labels.join(picked.select("label"), "label", "left_semi")
    solid = linked.checkpoint(trees.solids(kept, heights, zonal.tops(kept, heights), scale))
    meta = linked.checkpoint(trees.metadata(solid, picked, terrain, geo, uuid, offset))
    return trees.lines(solid, meta, geo), meta


def in_system(verts: DataFrame, source: int, target: int) -> DataFrame:
    """verts (poly, idx, x, y) in another coordinate system."""
    moved = geodesy.reproject(verts.select("poly", "idx", F.col("x").alias("cx"), F.col("y").alias("cy")), source, target)
    return moved.select("poly", "idx", F.col("cx").alias("x"), F.col("cy").alias("y"))


def covered(verts: DataFrame, points: DataFrame, cell: float) -> DataFrame:
    """poly, inside: whether all points lie in a polygon."""
    return vector.all_inside(verts, points, cell)
