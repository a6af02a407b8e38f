"""Components by chunks, what follows from them, pasting and hulls."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators.linked import connected

CHUNK = 256


def _label(pdf: pd.DataFrame, w: int) -> np.ndarray:
    """For the pixels (y, x, value) of a chunk, the smallest y * w + x of each one's 8-connected patch of equal values."""
    y, x, v = (pdf[c].to_numpy() for c in ("y", "x", "value"))
    y0, x0 = y.min(), x.min()
    spot = np.full((y.max() - y0 + 2, x.max() - x0 + 3), -1, np.int64)
    order = np.lexsort((x, y))
    spot[y[order] - y0, x[order] - x0 + 1] = np.arange(len(order))
    ids, value = (y * w + x)[order], v[order]
    a, b = [], []
    for dy, dx in ((0, 1), (1, -1), (1, 0), (1, 1)):
        one = spot[: spot.shape[0] - dy, max(0, -dx) : spot.shape[1] - max(0, dx)]
        two = spot[dy:, max(0, dx) : spot.shape[1] - max(0, -dx)]
        on = (one >= 0) & (two >= 0)
        a.append(one[on])
        b.append(two[on])
    a, b = np.concatenate(a), np.concatenate(b)
    same = value[a] == value[b]
    a, b = a[same], b[same]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[a], up[b])
        if np.array_equal(up[a], up[b]):
            break
        np.minimum.at(up, up[a], low)
        np.minimum.at(up, up[b], low)
        while not np.array_equal(up, up[up]):
            up = up[up]
    out = np.empty(len(ids), np.int64)
    out[order] = ids[up]
    return out


def components(df: DataFrame, w: int, value: str | None = None, chunk: int = CHUNK) -> DataFrame:
    """y, x, value, component of 8-connected patches of equal value (all pixels of df if none is named).

    A chunk's pixels are labelled in one task by their smallest pixel number; pairs of pixels across chunk borders then
    link these labels, and only the links, not the pixels, go through rounds.
    """
    src = df.select("y", "x", (F.col(value) if value else F.lit(1)).cast("long").alias("value"))
    keyed = src.withColumns({"_cy": F.floor(F.col("y") / chunk), "_cx": F.floor(F.col("x") / chunk)})

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"y": pdf["y"], "x": pdf["x"], "value": pdf["value"], "local": _label(pdf, w)})

    local = keyed.groupBy("_cy", "_cx").applyInPandas(run, "y int, x int, value long, local long")
    rim = local.where((F.col("y") % chunk == 0) | (F.col("y") % chunk == chunk - 1) | (F.col("x") % chunk == 0) | (F.col("x") % chunk == chunk - 1))
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((0, 1), (1, -1), (1, 0), (1, 1))])
    near = rim.withColumn("_s", F.explode(steps)).select((F.col("y") + F.col("_s.i")).alias("y"), (F.col("x") + F.col("_s.j")).alias("x"), "value", F.col("local").alias("a"))
    links = near.join(rim.select("y", "x", "value", F.col("local").alias("b")), ["y", "x", "value"]).where("a <> b").select("a", "b").distinct()
    merged = connected(links)
    out = local.join(merged, F.col("local") == F.col("id"), "left")
    return out.select("y", "x", "value", F.coalesce("component", "local").alias("component"))


def without_small(labels: DataFrame, w: int, least: int) -> DataFrame:
    """labels whose patches of `least` pixels or fewer are background."""
    parts = components(labels.where("label <> 0"), w, "label")
    big = parts.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") > least).select("component")
    kept = parts.join(big, "component", "left_semi").select("y", "x", F.lit(True).alias("_keep"))
    return labels.join(kept, ["y", "x"], "left").select("y", "x", F.when(F.col("_keep"), F.col("label")).otherwise(0).alias("label"))


def biggest(labels: DataFrame, w: int) -> DataFrame:
    """The largest patch of each label; of equals the one with the first pixel."""
    parts = components(labels.where("label <> 0"), w, "label")
    sizes = parts.groupBy("value", "component").agg(F.count("*").alias("_n"))
    best = sizes.groupBy("value").agg(F.max_by("component", F.struct("_n", -F.col("component"))).alias("component"))
    return parts.join(best, ["value", "component"], "left_semi").select("y", "x", F.col("value").cast("int").alias("label"))


def filled(mask: DataFrame, h: int, w: int) -> DataFrame:
    """mask (y, x) with its holes: patches of the rest that do not reach the raster's border."""
    grid = mask.sparkSession.range(h * w).select(F.floor(F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"))
    rest = components(grid.join(mask.select("y", "x"), ["y", "x"], "left_anti"), w)
    open_ = rest.where((F.col("y") == 0) | (F.col("y") == h - 1) | (F.col("x") == 0) | (F.col("x") == w - 1)).select("component").distinct()
    holes = rest.join(open_, "component", "left_anti").select("y", "x")
    return mask.select("y", "x").unionByName(holes).distinct()


def paste(copy: DataFrame, base: DataFrame) -> DataFrame:
    """base (y, x, z, label) with copy where copy is at least as high; its instance has a label above all of base."""
    top = base.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top"))
    c = copy.where("label <> 0").select("y", "x", F.col("z").alias("_z"))
    both = base.join(c, ["y", "x"], "left").crossJoin(F.broadcast(top))
    on = F.coalesce(F.col("_z") >= F.col("z"), F.lit(False))
    return both.select("y", "x", F.when(on, F.col("_z")).otherwise(F.col("z")).alias("z"), F.when(on, F.col("_top") + 1).otherwise(F.col("label")).alias("label"))


def hulls(labels: DataFrame) -> DataFrame:
    """label, idx, y, x of the convex hull of each instance, from the first and last pixel of each of its rows."""
    ends = labels.where("label <> 0").groupBy("label", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pts = sorted({(int(y), int(x)) for y, a, b in pdf[["y", "x0", "x1"]].itertuples(index=False) for x in (a, b)})

        def half(points):
            out = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out

        ring = pts if len(pts) < 3 else half(pts)[:-1] + half(pts[::-1])[:-1]
        return pd.DataFrame({"label": int(pdf["label"].iloc[0]), "idx": range(len(ring)), "y": [p[0] for p in ring], "x": [p[1] for p in ring]})

    return ends.groupBy("label").applyInPandas(run, "label int, idx int, y int, x int")
