"""Tables of many tiles: pixels (tile, y, x) with an image, heights, instances and classes; a tile is a bounded raster.

What concerns one tile is grouped by it; nothing gathers more than a tile's pixels in one task, and most of it only aggregates.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.model import BACKGROUND, CLIP_HEIGHT, MAX_GROUND_HEIGHT, MAX_INSTANCES, MIN_GROUND_RATIO, MIN_MASK_SIZE, UNKNOWN
from terrafold.operators import grid, halo, kernels, mapalg
from terrafold.operators.semantics import int_code

AT = ["tile", "y", "x"]
#: Names of the parts of a tile, by the side that they lie on.
QUARTERS = ("nw", "ne", "sw", "se")
SIDES = {"top": "nc", "left": "wc", "bottom": "sc", "right": "ec"}


def relabel(labels: DataFrame) -> DataFrame:
    """labels (tile, y, x, label) numbered 1..k within each tile, in order of their values; 0 stays."""
    names = labels.where("label <> 0").select("tile", "label").distinct().withColumn("_new", F.row_number().over(Window.partitionBy("tile").orderBy("label")))
    return labels.join(names, ["tile", "label"], "left").select(*AT, F.coalesce("_new", F.lit(0)).alias("label"))


def _hole(m: np.ndarray) -> np.ndarray:
    """Places outside m that no step in eight directions leads from to the array's edge."""
    out = np.zeros_like(m)
    out[[0, -1], :], out[:, [0, -1]] = ~m[[0, -1], :], ~m[:, [0, -1]]
    while True:
        wide = np.pad(out, 1)
        grown = np.zeros_like(out)
        for dy in range(3):
            for dx in range(3):
                grown |= wide[dy : dy + m.shape[0], dx : dx + m.shape[1]]
        grown &= ~m
        if np.array_equal(grown, out):
            return ~m & ~out
        out = grown


def without_holes(labels: DataFrame) -> DataFrame:
    """labels whose instances also hold the patches that they surround, as far as these do not reach the tile's edge; where two
    instances claim a pixel, the larger label has it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
        a = np.zeros((y.max() + 1, x.max() + 1), np.int32)
        a[y, x] = pdf["label"]
        out = a.copy()
        for v in np.unique(a[a > 0]):
            ys, xs = np.nonzero(a == v)
            s = np.s_[max(0, ys.min() - 1) : ys.max() + 2, max(0, xs.min() - 1) : xs.max() + 2]
            out[s] = np.where(_hole(a[s] == v), np.maximum(out[s], v), out[s])
        return pdf.assign(label=out[y, x])

    return labels.select(*AT, F.col("label").cast("int")).groupBy("tile").applyInPandas(run, labels.select(*AT, F.col("label").cast("int")).schema)


def without_small(labels: DataFrame, least: int = MIN_MASK_SIZE) -> DataFrame:
    """labels whose patches of `least` pixels or fewer are background."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        on = pdf["label"].to_numpy() != 0
        out = pdf["label"].to_numpy().copy()
        if on.any():
            fg = pdf[on].rename(columns={"label": "value"})
            _, patch, n = np.unique(kernels._label(fg, int(pdf["x"].max()) + 1), return_inverse=True, return_counts=True)
            out[np.flatnonzero(on)[n[patch] <= least]] = 0
        return pdf.assign(label=out)

    src = labels.select(*AT, F.col("label").cast("int"))
    return src.groupBy("tile").applyInPandas(run, src.schema)


def classes(labels: DataFrame, points: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """tile, y, x, cls: of the first point on each instance; UNKNOWN for instances without one, background in tiles without points."""
    hit = points.join(labels.where("label <> 0"), AT).groupBy("tile", "label").agg(F.min_by("code", "row_id").alias("_code"))
    told = points.select("tile").distinct().withColumn("_told", F.lit(True))
    named = labels.join(hit, ["tile", "label"], "left").join(told, "tile", "left")
    cls = F.when(F.col("_told").isNull() | (F.col("label") == 0), F.lit(BACKGROUND)).when(F.col("_code").isNull(), F.lit(dictionary.get("UNKNOWN", UNKNOWN))).otherwise(int_code(F.col("_code"), dictionary))
    return named.select(*AT, cls.alias("cls"))


def assemble(image: DataFrame, heights: DataFrame, labels: DataFrame | None = None, points: DataFrame | None = None, dictionary: dict[str, int] | None = None, fill: bool = True) -> DataFrame:
    """tile, y, x, r, g, b, z, label, cls of the tiles that have an image (r, g, b) and heights (z).

    Instances and points are optional, as a whole or for single tiles: without them labels, and classes, are 0. Instances are
    renumbered and, with fill, their holes are closed.
    """
    out = image.select(*AT, "r", "g", "b").join(heights.select(*AT, "z"), AT)
    if labels is None:
        return out.withColumns({"label": F.lit(0), "cls": F.lit(0)})
    clean = relabel(labels)
    clean = without_holes(clean) if fill else clean
    out = out.join(clean, AT, "left").withColumn("label", F.coalesce("label", F.lit(0)))
    if points is None:
        return out.withColumn("cls", F.lit(0))
    return out.join(classes(clean, points, dictionary or {}), AT, "left").withColumn("cls", F.coalesce("cls", F.lit(0)))


def clipped(tiles: DataFrame, height: float = CLIP_HEIGHT) -> DataFrame:
    return tiles.withColumn("z", F.greatest(F.lit(0.0), F.least(F.lit(height), F.col("z"))))


def byte_heights(tiles: DataFrame, height: float = CLIP_HEIGHT) -> DataFrame:
    """tiles with z as 0..255 of the clip height."""
    return tiles.withColumn("z", mapalg.to_uint8(mapalg.clip_rescale(F.col("z"), height)))


def byte_image(tiles: DataFrame) -> DataFrame:
    """tiles with r, g, b scaled to 0..255 by the extremes of all three within a tile; a tile of one value becomes 0."""
    each = tiles.groupBy("tile").agg(F.min(F.least("r", "g", "b")).alias("_lo"), F.max(F.greatest("r", "g", "b")).alias("_hi"))
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise((F.col("_hi") - F.col("_lo")).cast("double"))
    return tiles.join(each, "tile").withColumns({c: mapalg.to_uint8((F.col(c) - F.col("_lo")) / span) for c in "rgb"}).drop("_lo", "_hi")


def preprocess(tiles: DataFrame, least: int = MIN_MASK_SIZE) -> DataFrame:
    """tiles ready for training: small patches gone from the instances and their classes, image and heights as bytes."""
    kept = without_small(tiles, least).select(*AT, F.col("label").alias("_l"))
    out = tiles.join(kept, AT).withColumns({"label": F.col("_l"), "cls": F.when(F.col("_l") == 0, F.lit(BACKGROUND)).otherwise(F.col("cls"))}).drop("_l")
    return byte_heights(byte_image(out))


def channels(tiles: DataFrame, mode: str) -> DataFrame:
    """tile, y, x, channels for a mode: rgb, bgr, rgbd, bgrd or depth, d being z."""
    known = {"rgb": "rgb", "bgr": "bgr", "rgbd": "rgbz", "bgrd": "bgrz", "depth": "zzz"}
    if mode not in known:
        raise ValueError(f"no mode {mode}; there are {', '.join(known)}")
    return tiles.select(*AT, F.array(*[F.col(c).cast("double") for c in known[mode]]).alias("channels"))


def parts(tiles: DataFrame, h: int, w: int, count: int = 4) -> DataFrame:
    """tiles of h x w cut into parts of half their size, `tile` being the tile's name with its part's: nw, ne, sw, se; from 5 on ff,
    the whole one thinned; from 6 on cc, its middle; from 10 on nc, wc, sc, ec, the middles of its sides."""
    named = lambda df, part: df.withColumn("tile", F.concat("tile", F.lit(" ("), part, F.lit(")"))).select(*tiles.columns)
    quarter = F.element_at(F.array(*[F.lit(q) for q in QUARTERS]), F.col("quadrant") + 1)
    out = named(grid.split_four(tiles, h, w), quarter)
    if count >= 5:
        out = out.unionByName(named(grid.resize_nearest(tiles, h, w, h // 2, w // 2), F.lit("ff")))
    if count >= 6:
        out = out.unionByName(named(grid.center_crop(tiles, h, w, h // 2, w // 2), F.lit("cc")))
    if count >= 10:
        side = F.element_at(F.create_map(*[F.lit(x) for kv in SIDES.items() for x in kv]), F.col("side"))
        out = out.unionByName(named(grid.split_star(tiles, h, w), side))
    return out


def local_tiles(tiles: DataFrame, h: int, w: int, ignore_border: bool = True) -> DataFrame:
    """tile, id, y, x and the other columns: for each instance its pixels' box, with nothing but its own pixels in it.

    y and x count from the box's corner; other pixels of the box are not rows. Instances at the tile's edge are left out.
    """
    fg = tiles.where("label <> 0")
    box = fg.groupBy("tile", "label").agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"))
    if ignore_border:
        box = box.where((F.col("_y0") > 0) & (F.col("_x0") > 0) & (F.col("_y1") < h - 1) & (F.col("_x1") < w - 1))
    out = fg.join(box, ["tile", "label"]).withColumns({"id": F.col("label"), "y": F.col("y") - F.col("_y0"), "x": F.col("x") - F.col("_x0")})
    return out.select("tile", "id", *[c for c in tiles.columns if c != "tile"])


def zoomed_local(tile: DataFrame, h: int, w: int, factor: float = 1.0, epsilon: float = 0.0) -> tuple[DataFrame, int, int]:
    """One local tile (y, x, z, label) of h x w resized by a factor between 0.1 and 1.9, heights with it, and its new size."""
    factor = max(min(1.9, factor), 0.1)
    nh, nw = int(h * factor), int(w * factor)
    z = halo.resize(tile.select("y", "x", "z"), h, w, nh, nw).withColumn("z", (F.col("z") + epsilon) * factor)
    label = grid.resize_nearest(tile.select("y", "x", (F.col("label") != 0).cast("int").alias("label")), h, w, nh, nw)
    return z.join(label, ["y", "x"]), nh, nw


def _three_means(pdf: pd.DataFrame) -> pd.DataFrame:
    """The centres of three groups of a tile's heights, ascending, by Lloyd's rounds over a histogram; from its sextiles on."""
    v, n = pdf.sort_values("bin")[["bin", "n"]].to_numpy(float).T
    below = np.cumsum(n) - n / 2
    c = np.array([v[min(np.searchsorted(below, q * n.sum()), len(v) - 1)] for q in (1 / 6, 3 / 6, 5 / 6)])
    for _ in range(100):
        group = np.abs(v[:, None] - c[None]).argmin(axis=1)
        new = np.array([np.average(v[group == k], weights=n[group == k]) if (group == k).any() else c[k] for k in range(3)])
        if np.array_equal(new, c):
            break
        c = new
    c = np.sort(c)
    return pd.DataFrame({"tile": [pdf["tile"].iloc[0]], "low": [c[0] / 100], "mid": [c[1] / 100], "high": [c[2] / 100]})


def height_groups(tiles: DataFrame) -> DataFrame:
    """tile, low, mid, high: centres of three groups of the heights above 0, to the centimetre; only a tile's histogram is gathered."""
    bins = tiles.where("z > 0").groupBy("tile", F.bround(F.col("z") * 100).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    return bins.groupBy("tile").applyInPandas(_three_means, f"tile {tiles.schema['tile'].dataType.simpleString()}, low double, mid double, high double")


def pastable(tiles: DataFrame, most: int = MAX_INSTANCES, ratio: float = MIN_GROUND_RATIO, height: float = MAX_GROUND_HEIGHT) -> DataFrame:
    """tile, pastable: few instances, low on the whole, and mostly ground, which is what lies below the mean of the two lower groups
    of heights. A tile without heights above 0 is all ground."""
    z = F.least(F.col("z"), F.lit(CLIP_HEIGHT))
    exact = lambda c: F.sum(c.cast("decimal(20,6)")).cast("double")
    split = height_groups(tiles).select("tile", ((F.col("low") + F.col("mid")) / 2).alias("_t"))
    with_split = tiles.join(split, "tile", "left")
    ground = F.coalesce(F.col("z") <= F.col("_t"), F.lit(True))
    seen = with_split.groupBy("tile").agg(
        F.count("*").alias("_n"), F.count_distinct(F.when(F.col("label") != 0, F.col("label"))).alias("_k"), exact(z).alias("_z"), F.count_if(ground).alias("_g"),
        exact(F.when(ground, z).otherwise(F.lit(-1.0))).alias("_gz"),
    )
    good = (F.col("_k") <= most) & (F.col("_z") / F.col("_n") <= height) & (F.col("_g") / F.col("_n") >= ratio) & (F.col("_gz") / F.col("_n") <= height)
    return seen.select("tile", good.alias("pastable"))


def brightened(tiles: DataFrame, seed: int = 0) -> DataFrame:
    """tiles with r, g, b under a gamma (0.7 to 1.3), a contrast (0.8 to 1.2) and noise (up to 4) that a hash of seed, tile and place
    draws; the same for the same seed."""
    unit = lambda *key: F.pmod(F.xxhash64(F.lit(seed), *key), F.lit(1_000_003)) / F.lit(1_000_003.0)
    gamma, contrast = 0.7 + 0.6 * unit(F.lit("g"), F.col("tile")), 0.8 + 0.4 * unit(F.lit("c"), F.col("tile"))

    def changed(c: str) -> Column:
        v = F.pow(F.col(c) / 255.0, gamma) * 255.0
        v = (v - 127.5) * contrast + 127.5 + 8 * (unit(F.lit(c), F.col("tile"), F.col("y"), F.col("x")) - 0.5)
        return F.greatest(F.lit(0), F.least(F.lit(255), F.bround(v).cast("int")))

    return tiles.withColumns({c: changed(c) for c in "rgb"})


def draws(tiles: DataFrame, locals_: DataFrame, n: int, h: int, w: int, seed: int = 0) -> DataFrame:
    """tile, k, id, cy, cx, angle, zoom, overlap: n pastings for each tile, each of a local tile (id 0..count-1) at a place, all drawn by
    a hash of seed, tile and k."""
    count = locals_.select("id").distinct().count()
    unit = lambda name: F.pmod(F.xxhash64(F.lit(seed), F.lit(name), F.col("tile"), F.col("k")), F.lit(1_000_003)) / F.lit(1_000_003.0)
    at = tiles.select("tile").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    whole = lambda name, top: F.floor(unit(name) * top).cast("int")
    return at.withColumns({"id": whole("id", count), "cy": whole("y", h), "cx": whole("x", w), "angle": unit("angle") * 360, "zoom": 0.8 + 0.4 * unit("zoom"), "overlap": 0.6 * unit("overlap")})
