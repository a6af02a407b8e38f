"""Ground and canopy surfaces: gaps filled from the nearest valid pixel, thinned, smoothed and laid back over the raster."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators import focal, halo
from terrafold.operators.linked import checkpoint, written

NODATA = -9999.0


def nearest(ask: DataFrame, valid: DataFrame, most: int, cell: int = 16) -> DataFrame:
    """y, x, z, d2 of ask (y, x), each with the z of the nearest row of valid (y, x, z), of equally near ones the first by y, x, and the
    square of its distance.

    Both sides meet in cells and the cells around them, which decides every distance up to a cell's side. What is left goes on
    with cells four times as large, until a cell is as large as the raster (most).
    """
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left, out = checkpoint(ask.select("y", "x")), None
    while True:
        key = lambda v: F.floor(F.col(v) / cell)  # noqa: B023, E731
        near = left.withColumn("_s", F.explode(steps)).withColumns({"_cy": key("y") + F.col("_s.i"), "_cx": key("x") + F.col("_s.j")})
        source = valid.select(key("y").alias("_cy"), key("x").alias("_cx"), F.col("y").alias("_y"), F.col("x").alias("_x"), F.col("z").alias("_z"))
        d = (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y")) + (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x"))
        met = near.join(source, ["_cy", "_cx"]).groupBy("y", "x").agg(F.min(F.struct(d.cast("long").alias("d"), "_y", "_x", "_z")).alias("m"))
        near_enough = F.lit(cell >= most) | (F.col("m.d") <= cell * cell)  # one cell that holds the whole raster decides all
        done = checkpoint(met.where(near_enough).select("y", "x", F.col("m._z").alias("z"), F.col("m.d").alias("d2")))
        out = done if out is None else out.unionByName(done)
        if cell >= most:
            return out
        left = checkpoint(left.join(done, ["y", "x"], "left_anti"))
        if left.isEmpty():
            return out
        cell *= 4


#: How far a chunk looks for the nearest valid pixel; what is left goes on in cells.
REACH = 16


def _thinned_near(kept: DataFrame, h: int, w: int, step: int, chunk: int = halo.CHUNK) -> DataFrame:
    """y, x, z, found of every step-th row and column of kept (y, x, z, null for gaps); a gap takes the z of the nearest valid pixel, of
    equally near ones the first by y, x, if one is within REACH."""
    span = range(-REACH, REACH + 1)
    offsets = sorted((i * i + j * j, i, j) for i in span for j in span if i * i + j * j <= REACH * REACH)
    side = chunk + 2 * REACH

    def run(key: tuple, table: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * chunk - REACH, key[1].as_py() * chunk - REACH
        y, x, valid = table.column("y").to_numpy(), table.column("x").to_numpy(), table.column("z").is_valid().to_numpy()
        z, ok = np.zeros((side, side)), np.zeros((side, side), bool)
        z[y[valid] - top, x[valid] - left] = table.column("z").drop_null().to_numpy()
        ok[y[valid] - top, x[valid] - left] = True
        asked = (y % step == 0) & (x % step == 0) & (y - top >= REACH) & (y - top < REACH + chunk) & (x - left >= REACH) & (x - left < REACH + chunk)
        y, x = y[asked], x[asked]
        out, open_ = np.zeros(len(y)), np.arange(len(y))
        for _, i, j in offsets:
            at = y[open_] - top + i, x[open_] - left + j
            hit = ok[at]
            out[open_[hit]] = z[at][hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        found = np.ones(len(y), bool)
        found[open_] = False
        return pa.table({"y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "z": pa.array(out), "found": pa.array(found)})

    y, x = F.col("y"), F.col("x")
    dealt = halo._dealt(kept, (y - REACH, y + REACH), (x - REACH, x + REACH), h, w, chunk, "z")
    return dealt.groupBy("_cy", "_cx").applyInArrow(run, "y int, x int, z double, found boolean")


def thinned(df: DataFrame, valid: Column, h: int, w: int, step: int) -> DataFrame:
    """y, x, z of every step-th row and column of df (y, x, z), numbered anew; where valid does not hold, z of the nearest pixel
    where it does. Chunks find what is within REACH; for the rest, only pixels beside one that is not valid can be the nearest."""
    kept = df.select("y", "x", F.when(F.coalesce(valid, F.lit(False)), F.col("z").cast("double")).alias("z"))
    small = written(_thinned_near(kept, h, w, step))
    left, small = small.where("not found").select("y", "x"), small.where("found").select("y", "x", "z")
    if not left.isEmpty():
        gaps = kept.where("z is null").select("y", "x")
        rim = kept.where("z is not null").join(focal.dilate(gaps, h, w), ["y", "x"], "left_semi").select("y", "x", "z")
        small = small.unionByName(nearest(left, rim, max(h, w), 4 * REACH).drop("d2"))
    return small.select(F.floor(F.col("y") / step).cast("int").alias("y"), F.floor(F.col("x") / step).cast("int").alias("x"), "z")


def median(df: DataFrame, h: int, w: int, size: int) -> DataFrame:
    """The median of the size x size square around each pixel (size odd); rows and columns are mirrored at the edges, the edge
    itself included."""
    r = size // 2
    steps = F.sequence(F.lit(-r), F.lit(r))

    def readers(v: str, n: int) -> Column:
        """The targets, with repeats, whose square shows a pixel: its own place and its mirror images."""
        images = F.array(F.col(v), -F.col(v) - 1, 2 * n - 1 - F.col(v))
        spread = F.flatten(F.transform(images, lambda m: F.transform(steps, lambda k: m + k)))
        return F.filter(spread, lambda t: (t >= 0) & (t < n))

    if min(h, w) < r:
        raise ValueError(f"a square of {size} needs a raster of {r} rows and columns at least")
    votes = df.select(F.explode(readers("y", h)).alias("y"), "x", "z").select("y", F.explode(readers("x", w)).alias("x"), "z")
    return votes.groupBy("y", "x").agg(F.element_at(F.sort_array(F.collect_list("z")), (F.count("*") / 2).cast("int") + 1).alias("z"))


def _smooth(df: DataFrame, valid: Column, onto: DataFrame, h: int, w: int, step: int, size: int) -> DataFrame:
    """onto with _s, the smooth surface of df at its pixels."""
    sh, sw = -(-h // step), -(-w // step)
    small = median(thinned(df, valid, h, w, step), sh, sw, size)
    return halo.resize(small, sh, sw, h, w, "cubic", onto=onto)


def ground(df: DataFrame, h: int, w: int, step: int = 500, size: int = 5) -> DataFrame:
    """df (y, x, z), a terrain whose least value means no data, as a smooth surface; NODATA where it has none.

    Every valid pixel takes the smooth surface's value. Null z counts as no data.
    """
    low = df.agg(F.min("z").alias("_low")).first()[0]
    valid = F.coalesce(F.col("z") > F.lit(low), F.lit(False))
    smooth = _smooth(df, valid, df.where(valid).select("y", "x"), h, w, step, size)
    return smooth.select("y", "x", F.col("_s").alias("z")).unionByName(df.where(~valid).select("y", "x", F.lit(NODATA).alias("z")))


def canopy(df: DataFrame, labels: DataFrame, h: int, w: int, step: int = 8, size: int = 3) -> DataFrame:
    """Heights df (y, x, z) within instances, lifted to the mean of themselves and a smooth surface where that is higher; 0
    outside. Pixels below half the mean of those that are not 0 are gaps of the surface.

    Heights and labels are joined and written once; only pixels within instances meet the surface.
    """
    both = written(df.select("y", "x", "z").join(labels.select("y", "x", "label"), ["y", "x"], "left"))
    half = both.where("z <> 0").agg((F.sum(F.col("z").cast("decimal(20,6)")).cast("double") / F.count("z") / 2).alias("_h")).first()[0] or 0.0
    within = F.coalesce(F.col("label") != 0, F.lit(False))
    lifted = _smooth(both, F.col("z") >= half, both.where(within).select("y", "x", "z"), h, w, step, size)
    lifted = lifted.select("y", "x", F.greatest("z", (F.col("_s") + F.col("z")) / 2).alias("z"))
    return lifted.unionByName(both.where(~within).select("y", "x", F.lit(0.0).alias("z")))
