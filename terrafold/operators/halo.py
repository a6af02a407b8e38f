"""Kernels over square chunks of a raster, each with what it needs of its neighbours: one Arrow call a chunk.

Only rows near a chunk's edge are copied to the chunks beside it, so what is shuffled grows with the raster, not with the
neighbourhood; a chunk with its halo is the most that one call holds.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

CHUNK = 256
PIXELS = "y int, x int, z double"


def _dealt(df: DataFrame, y: tuple[Column, Column], x: tuple[Column, Column], h: int, w: int, chunk: int, z: str) -> DataFrame:
    """y, x, z of df, once for each chunk of h x w that holds any of the rows y[0]..y[1] and columns x[0]..x[1]."""
    span = lambda lo, hi, n: F.sequence(F.floor(F.greatest(F.lit(0), lo) / chunk), F.floor(F.least(F.lit(n - 1), hi) / chunk))
    rows = df.where((y[1] >= 0) & (y[0] < h) & (x[1] >= 0) & (x[0] < w))
    return rows.select("y", "x", F.col(z).cast("double").alias("z"), F.explode(span(*y, h)).alias("_cy"), x[0].alias("_x0"), x[1].alias("_x1")).select(
        "y", "x", "z", "_cy", F.explode(span(F.col("_x0"), F.col("_x1"), w)).alias("_cx")
    )


def _rows(y: np.ndarray, x: np.ndarray, z: np.ndarray) -> pa.Table:
    return pa.table({"y": pa.array(y.astype(np.int32)), "x": pa.array(x.astype(np.int32)), "z": pa.array(z.astype(np.float64))})


def focal(df: DataFrame, h: int, w: int, halo: int, f: Callable[[np.ndarray, np.ndarray], np.ndarray], z: str = "z", chunk: int = CHUNK) -> DataFrame:
    """y, x, z of f over each chunk: f gets a square of values (NaN: no pixel) and which of its places lie on the raster, and
    gives values, NaN for none. What it gives for a place may depend on places up to halo away."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        top, left = key[0].as_py() * chunk - halo, key[1].as_py() * chunk - halo
        size = chunk + 2 * halo
        held = np.full((size, size), np.nan)
        held[table.column("y").to_numpy() - top, table.column("x").to_numpy() - left] = table.column("z").to_numpy()
        on = np.zeros((size, size), bool)
        on[max(0, -top) : h - top, max(0, -left) : w - left] = True
        inner = np.where(on, f(held, on), np.nan)[halo : halo + chunk, halo : halo + chunk]
        y, x = np.nonzero(~np.isnan(inner))
        return _rows(y + top + halo, x + left + halo, inner[y, x])

    y, x = F.col("y"), F.col("x")
    return _dealt(df, (y - halo, y + halo), (x - halo, x + halo), h, w, chunk, z).groupBy("_cy", "_cx").applyInArrow(run, PIXELS)


def _near(on: np.ndarray, radius: int) -> np.ndarray:
    """Places within radius of a true one: for each row of the disk, a run of a running count."""
    out = np.zeros_like(on)
    for dy in range(-radius, radius + 1):
        k = math.isqrt(radius * radius - dy * dy)
        count = np.zeros((on.shape[0], on.shape[1] + 2 * k + 1), np.int32)
        count[:, k + 1 : k + 1 + on.shape[1]] = on
        count = count.cumsum(axis=1)
        count[:, k + 1 + on.shape[1] :] = count[:, [k + on.shape[1]]]
        hit = count[:, 2 * k + 1 :] - count[:, : on.shape[1]] > 0
        a, b = max(0, dy), min(on.shape[0], on.shape[0] + dy)
        out[a:b] |= hit[a - dy : b - dy]
    return out


def morphology(mask: DataFrame, h: int, w: int, steps: str, radius: int, chunk: int = CHUNK) -> DataFrame:
    """y, x of mask (y, x) after steps: d grows it by a disk, e takes away what is within one of a place outside it.

    "ed" opens, "de" closes. What lies off the raster counts as outside when growing and as inside when taking away.
    """

    def f(held: np.ndarray, on: np.ndarray) -> np.ndarray:
        m = ~np.isnan(held)
        for s in steps:
            m = _near(m, radius) & on if s == "d" else m & ~_near(~m & on, radius)
        return np.where(m, 1.0, np.nan)

    return focal(mask.select("y", "x", F.lit(1.0).alias("z")), h, w, radius * len(steps), f, chunk=chunk).select("y", "x")


def blur(df: DataFrame, h: int, w: int, sigma: float, z: str = "z", chunk: int = CHUNK) -> DataFrame:
    """Gaussian blur, along columns then rows, with weights rescaled where pixels are missing."""
    r = max(1, int(4 * sigma + 0.5))
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]

    def along(a: np.ndarray) -> np.ndarray:
        wide = np.pad(a, ((r, r), (0, 0)))
        return sum(g * wide[k : k + len(a)] for k, g in enumerate(weights))

    def f(held: np.ndarray, on: np.ndarray) -> np.ndarray:
        has = ~np.isnan(held)
        with np.errstate(invalid="ignore", divide="ignore"):
            v = np.where(has, along(np.where(has, held, 0.0)) / along(has.astype(float)), 0.0)
            return np.where(has, along(v.T).T / along(has.T.astype(float)).T, np.nan)

    return focal(df, h, w, r, f, z, chunk)


def _cubic(t: np.ndarray, a: float = -0.75) -> np.ndarray:
    t = np.abs(t)
    return np.where(t <= 1, (a + 2) * t**3 - (a + 3) * t**2 + 1, np.where(t < 2, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a, 0.0))


def _linear(t: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, 1 - np.abs(t))


TAPS = {"linear": (range(0, 2), _linear), "cubic": (range(-1, 3), _cubic)}


def _place(known: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Where each of v stands in known (in order), len(known) for those that are not in it."""
    at = np.searchsorted(known, v)
    return np.where(known[np.minimum(at, len(known) - 1)] == v, at, len(known))


Locate = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def gathered(df: DataFrame, h: int, w: int, new_h: int, new_w: int, readers: tuple[tuple[Column, Column], tuple[Column, Column]], locate: Locate, kind: str, z: str = "z", outside: float | None = None, chunk: int = CHUNK, onto: DataFrame | None = None) -> DataFrame:
    """y, x, z of new_h x new_w targets that read df at fractional places, edges repeated.

    locate gives the place (sy, sx) of targets (y, x). readers bound the target rows and columns that may read a pixel, so a
    pixel goes only to the chunks of its targets. Targets outside df get `outside`, or are left out if it is None; with it, locate must
    take columns too and keep differences, wherever the targets are, as a turn does.
    onto: targets (y, x and more) that meet their chunk's pixels there; its rows come back with what they read as _s, null for
    none, and no other targets are shuffled.
    """
    taps, weight = TAPS[kind]

    def values(cy: int, cx: int, table: pa.Table) -> tuple[np.ndarray, ...]:
        ty, tx = np.meshgrid(np.arange(cy * chunk, min(new_h, (cy + 1) * chunk)), np.arange(cx * chunk, min(new_w, (cx + 1) * chunk)), indexing="ij")
        sy, sx = locate(ty.astype(float), tx.astype(float))
        inside = (sy >= -0.5) & (sy <= h - 0.5) & (sx >= -0.5) & (sx <= w - 0.5)
        out, seen = np.zeros(ty.shape), np.zeros(ty.shape, bool)
        real = table.filter(pa.compute.is_valid(table.column("y")))
        if real.num_rows:
            y, x = real.column("y").to_numpy(), real.column("x").to_numpy()
            rows, cols = np.unique(y), np.unique(x)
            held = np.full((len(rows) + 1, len(cols) + 1), np.nan)  # the last row and column stay empty
            held[np.searchsorted(rows, y), np.searchsorted(cols, x)] = real.column("z").to_numpy()
            sy, sx = sy[inside], sx[inside]
            fy, fx = np.floor(sy).astype(int), np.floor(sx).astype(int)
            total, some = np.zeros(len(sy)), np.zeros(len(sy), bool)
            for i in taps:
                py = _place(rows, np.clip(fy + i, 0, h - 1))
                for j in taps:
                    px = _place(cols, np.clip(fx + j, 0, w - 1))
                    g, v = weight(sy - fy - i) * weight(sx - fx - j), held[py, px]
                    has = ~np.isnan(v)
                    total += np.where(has, g * v, 0.0)
                    some |= has & (g != 0)
            out[inside], seen[inside] = total, some
        return ty, tx, out, inside & seen

    def run(key: tuple, table: pa.Table) -> pa.Table:
        ty, tx, out, keep = values(key[0].as_py(), key[1].as_py(), table)
        if outside is not None:
            out, keep = np.where(keep, out, outside), np.ones_like(keep)
        return _rows(ty[keep], tx[keep], out[keep])

    def laid(key: tuple, asked: pa.Table, table: pa.Table) -> pa.Table:
        cy, cx = key[0].as_py(), key[1].as_py()
        asked = asked.drop_columns(["_cy", "_cx"])
        if not asked.num_rows:
            return asked.append_column("_s", pa.array([], pa.float64()))
        _, _, out, keep = values(cy, cx, table)
        y, x = asked.column("y").to_numpy() - cy * chunk, asked.column("x").to_numpy() - cx * chunk
        on = (y < out.shape[0]) & (x < out.shape[1])
        read = np.full(len(y), np.nan)
        read[on] = np.where(keep, out, np.nan)[y[on], x[on]]
        return asked.append_column("_s", pa.array(read, mask=np.isnan(read)))

    (y0, y1), (x0, x1) = readers
    rows = _dealt(df, (F.floor(y0), F.ceil(y1)), (F.floor(x0), F.ceil(x1)), new_h, new_w, chunk, z)
    if onto is not None:
        asked = onto.withColumns({"_cy": F.floor(F.col("y") / chunk), "_cx": F.floor(F.col("x") / chunk)})
        schema = StructType([*onto.schema.fields, StructField("_s", DoubleType())])
        return asked.groupBy("_cy", "_cx").cogroup(rows.groupBy("_cy", "_cx")).applyInArrow(laid, schema)
    out = rows.groupBy("_cy", "_cx").applyInArrow(run, PIXELS)
    if outside is None:
        return out
    # chunks that no pixel reaches are rows of one value, which need no kernel: those far from df are told by their place alone
    corner = np.array([0, 0, chunk - 1, chunk - 1, (chunk - 1) / 2]), np.array([0, chunk - 1, 0, chunk - 1, (chunk - 1) / 2])
    reach = [float(np.abs(v[:4] - v[4]).max()) + 8 for v in locate(*corner)]

    def near(cy: Column, cx: Column) -> Column:
        sy, sx = locate(cy * float(chunk) + (chunk - 1) / 2, cx * float(chunk) + (chunk - 1) / 2)
        return (sx >= -reach[1]) & (sx <= w + reach[1]) & (sy >= -reach[0]) & (sy <= h + reach[0])

    spark, ny, nx = df.sparkSession, -(-new_h // chunk), -(-new_w // chunk)
    ids = lambda n: spark.range(0, n, 1, max(spark.sparkContext.defaultParallelism, n >> 24))
    places = ids(new_h * new_w).select(F.expr(f"id div {new_w}").alias("y"), (F.col("id") % new_w).alias("x"))
    void = places.where(~near(F.floor(F.col("y") / chunk), F.floor(F.col("x") / chunk)))
    chunks = ids(ny * nx).select(F.expr(f"id div {nx}").alias("_cy"), (F.col("id") % nx).alias("_cx")).where(near(F.col("_cy"), F.col("_cx")))
    bare = chunks.join(rows.select("_cy", "_cx").distinct(), ["_cy", "_cx"], "left_anti")
    side = lambda k, n: F.sequence(F.col(k) * chunk, F.least(F.lit(n), (F.col(k) + 1) * chunk) - 1)
    lines = bare.withColumn("y", F.explode(side("_cy", new_h))).withColumn("x", F.explode(side("_cx", new_w)))
    for part in (void, lines):
        out = out.unionByName(part.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), F.lit(float(outside)).alias("z")))
    return out


def resize(df: DataFrame, h: int, w: int, new_h: int, new_w: int, kind: str = "linear", z: str = "z", chunk: int = CHUNK, onto: DataFrame | None = None) -> DataFrame:
    """df resized with half-pixel centres, whole or at the pixels of onto. Where a side shrinks, only rows or columns that a target
    reads are shuffled."""
    first, last = min(TAPS[kind][0]), max(TAPS[kind][0])

    def reading(v: str, old: int, new: int) -> tuple[Column, Column]:
        lo, hi = (F.col(v) - last - 0.5) * (new / old) - 1.5, (F.col(v) - first + 1.5) * (new / old) + 0.5
        return F.when(F.col(v) == 0, F.lit(0.0)).otherwise(lo), F.when(F.col(v) == old - 1, F.lit(new - 1.0)).otherwise(hi)

    def read(v: str, old: int, new: int) -> Column:
        lo, hi = reading(v, old, new)
        near = F.exists(F.sequence(F.floor(lo).cast("long"), F.ceil(hi).cast("long")), lambda t: F.floor((t + 0.5) * (old / new) - 0.5).between(F.col(v) - last - 1, F.col(v) - first + 1))
        return F.lit(True) if new >= old else F.col(v).isin(0, old - 1) | near

    locate = lambda y, x: ((y + 0.5) * (h / new_h) - 0.5, (x + 0.5) * (w / new_w) - 0.5)
    df = df.where(read("y", h, new_h) & read("x", w, new_w))
    return gathered(df, h, w, new_h, new_w, (reading("y", h, new_h), reading("x", w, new_w)), locate, kind, z, chunk=chunk, onto=onto)


def rotate(df: DataFrame, h: int, w: int, degrees: float, z: str = "z", chunk: int = CHUNK) -> tuple[DataFrame, int, int]:
    """df turned counterclockwise on a canvas that holds all of it, with the canvas's height and width; 0 outside."""
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    nh, nw = math.ceil(abs(h * c) + abs(w * s) - 1e-9), math.ceil(abs(h * s) + abs(w * c) - 1e-9)

    def locate(y: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dy, dx = y - (nh - 1) / 2, x - (nw - 1) / 2
        return dy * c + dx * s + (h - 1) / 2, dx * c - dy * s + (w - 1) / 2

    dy, dx = F.col("y") - (h - 1) / 2, F.col("x") - (w - 1) / 2
    ty, tx = dy * c - dx * s + (nh - 1) / 2, dy * s + dx * c + (nw - 1) / 2
    return gathered(df, h, w, nh, nw, ((ty - 3, ty + 3), (tx - 3, tx + 3)), locate, "linear", z, outside=0.0, chunk=chunk), nh, nw


def zoom(df: DataFrame, h: int, w: int, factor: float, z: str = "z", chunk: int = CHUNK) -> tuple[DataFrame, int, int]:
    """df resized by a factor, both sides rounded, at least 1 pixel, with the new height and width."""
    nh, nw = max(1, round(h * factor)), max(1, round(w * factor))
    return resize(df, h, w, nh, nw, "linear", z, chunk), nh, nw
