"""Solids of trees: from each instance's pixels and heights, a closed mesh of 24 vertices in four rings, and its metadata.

What is done for one tree needs its own pixels only, so trees are grouped by label and the most that a task holds is a tree.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.model import Geo
from terrafold.operators import grid, linked
from terrafold.operators import labels as instance_labels

#: Share of a tree's pixels, and of its height below the top, that make its top.
TOP = 0.15
#: Pixels by which a cross section is smoothed.
SMOOTH = 10.0


def hull(points: np.ndarray) -> np.ndarray:
    """Vertices of the convex hull of points (n x 2), in turn, from the smallest on."""
    pts = sorted({(float(a), float(b)) for a, b in points})
    if len(pts) < 3:
        return np.array(pts)

    def half(seq: list) -> list:
        out: list = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(half(pts) + half(pts[::-1]))


def polygon(ring: np.ndarray, edges: int) -> np.ndarray:
    """A convex ring with exactly so many vertices: those that span the least area go, or the longest sides are halved."""
    ring = ring.astype(float)
    while len(ring) > edges:
        a, b = np.roll(ring, 1, axis=0), np.roll(ring, -1, axis=0)
        area = np.abs((ring - a)[:, 0] * (b - a)[:, 1] - (ring - a)[:, 1] * (b - a)[:, 0])
        ring = np.delete(ring, area.argmin(), axis=0)
    while len(ring) < edges:
        side = np.roll(ring, -1, axis=0) - ring
        k = int((side**2).sum(axis=1).argmax())
        ring = np.insert(ring, k + 1, ring[k] + side[k] / 2, axis=0)
    return ring


def axis_angle(y: np.ndarray, x: np.ndarray) -> float:
    """By how much, in radians, the longest axis of the pixels leans from the direction of y towards x."""
    dy, dx = y - y.mean(), x - x.mean()
    return 0.5 * math.atan2(2 * (dy * dx).mean(), (dy * dy).mean() - (dx * dx).mean())


def turned(points: np.ndarray, angle: float) -> np.ndarray:
    """points (y, x) about the origin so that what leans by angle comes to lie along y; the negative angle undoes it."""
    c, s = math.cos(angle), math.sin(angle)
    return np.stack((points[:, 0] * c + points[:, 1] * s, points[:, 1] * c - points[:, 0] * s), axis=1)


def cross_section(along: np.ndarray, across: np.ndarray, z: np.ndarray) -> np.ndarray:
    """The height along an axis, a value a pixel, of what lies within half a pixel of it, smoothed; columns without pixels are 0."""
    on = np.abs(across) <= 0.5
    at = np.rint(along[on] - along.min()).astype(int)
    n = int(np.rint(along.max() - along.min())) + 1
    count = np.bincount(at, minlength=n)
    height = np.bincount(at, z[on], minlength=n) / np.maximum(count, 1)
    reach = np.arange(-3 * int(SMOOTH), 3 * int(SMOOTH) + 1)
    weight = np.exp(-0.5 * (reach / SMOOTH) ** 2)
    has = np.convolve((count > 0).astype(float), weight)[len(reach) // 2 :][:n]
    return np.divide(np.convolve(height * (count > 0), weight)[len(reach) // 2 :][:n], has, out=np.zeros(n), where=(count > 0) & (has > 0))


def shoulder(profile: np.ndarray, scale: float) -> float:
    """The mean height of the two shoulders of a cross section: of its outline as a six-sided polygon, the lower vertex of either side
    between the ground and the top."""
    at = np.arange(len(profile), dtype=float)
    outline = np.concatenate((np.stack((at, profile / scale), axis=1), np.stack((at[[0, -1]], np.zeros(2)), axis=1)))
    ring = hull(outline)
    if len(ring) < 3:
        return float(profile.max(initial=0.0))
    ring = polygon(ring, 6)
    ground = np.lexsort((ring[:, 0], ring[:, 1]))[:2]
    first = next(k for k in range(6) if k in ground and (k + 1) % 6 not in ground)
    rest = [ring[(first + j) % 6, 1] for j in range(1, 6) if (first + j) % 6 not in ground]
    return scale * (min(rest[:2]) + min(rest[2:])) / 2


def ring_heights(top: float, shoulders: float) -> tuple[float, float, float, float]:
    """Heights of the four rings from the top's and the second one's. A tall tree stands clear of the ground by a quarter."""
    third = top - shoulders
    lower = max(0.0, shoulders - third)
    lowest = max(0.0, lower - third / 2)
    return (top, shoulders, top / 4 + third / 2, top / 4) if lowest > top / 4 else (top, shoulders, lower, lowest)


def triangles(points: np.ndarray) -> list[tuple[int, int, int]]:
    """A Delaunay triangulation of a few points, by adding them one at a time."""
    lo, hi = points.min(axis=0), points.max(axis=0)
    mid, span = (lo + hi) / 2, float((hi - lo).max()) * 100 + 1
    pts = np.concatenate((points, mid + span * np.array([[-1.0, -1.0], [0.0, 1.5], [1.0, -1.0]])))
    n = len(points)

    def around(t: tuple[int, int, int]) -> tuple[np.ndarray, float]:
        (ay, ax), (by, bx), (cy, cx) = pts[list(t)]
        d = 2 * (ay * (bx - cx) + by * (cx - ax) + cy * (ax - bx))
        a2, b2, c2 = ay * ay + ax * ax, by * by + bx * bx, cy * cy + cx * cx
        if d == 0:
            return np.zeros(2), math.inf
        centre = np.array([(a2 * (bx - cx) + b2 * (cx - ax) + c2 * (ax - bx)) / d, (a2 * (cy - by) + b2 * (ay - cy) + c2 * (by - ay)) / d])
        return centre, float(((pts[t[0]] - centre) ** 2).sum())

    held = [(n, n + 1, n + 2)]
    for k in range(n):
        bad = [t for t in held for c, r in (around(t),) if ((pts[k] - c) ** 2).sum() < r * (1 - 1e-12)]
        sides = [tuple(sorted(s)) for t in bad for s in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2]))]
        held = [t for t in held if t not in bad] + [(*s, k) for s in sides if sides.count(s) == 1]
    return [t for t in held if max(t) < n]


def belt() -> list[tuple[int, int, int]]:
    """The triangles between the second ring of the upper and of the lower half, for rings of 4 and 8 vertices."""
    return [t for k in range(8) for a, b in ((4 + k, 4 + (k + 1) % 8),) for t in ((a, b, b + 12), (a, b + 12, a + 12))]


SOLID = "label int, part string, k int, y double, x double, z double, a int, b int, c int"


def _solid(scale: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, x, z = (pdf[c].to_numpy(float) for c in ("y", "x", "z"))
        top = pdf["top"].to_numpy(bool)
        if not top.any():
            top = z == z.max()
        centre = np.array([(y.min() + y.max()) / 2, (x.min() + x.max()) / 2])
        angle = axis_angle(y, x)
        p = turned(np.stack((y, x), axis=1) - centre, angle)
        ring1, ring0 = polygon(hull(p), 8), polygon(hull(p[top]), 4)
        r0 = float(z[top].max())
        cut = np.minimum(z, r0)
        r1 = (shoulder(cross_section(p[:, 0], p[:, 1], cut), scale) + shoulder(cross_section(p[:, 1], p[:, 0], cut), scale)) / 2
        h = ring_heights(r0, min(r1, r0))
        flat = np.concatenate((ring0, ring1))
        back = turned(flat, -angle) + centre
        cap = triangles(flat)
        faces = [*cap, *((a + 12, b + 12, c + 12) for a, b, c in cap), *belt()]
        label = int(pdf["label"].iloc[0])
        trunk = turned(ring0.mean(axis=0)[None], -angle)[0] + centre
        rows = [(label, "vertex", k, back[k % 12, 0], back[k % 12, 1], (h[0] if k % 12 < 4 else h[1]) if k < 12 else (h[3] if k % 12 < 4 else h[2]), None, None, None) for k in range(24)]
        rows += [(label, "face", k, None, None, None, *f) for k, f in enumerate(faces)]
        rows.append((label, "trunk", 0, float(np.rint(trunk[0])), float(np.rint(trunk[1])), 0.0, None, None, None))
        return pd.DataFrame(rows, columns=[c.split(" ")[0] for c in SOLID.split(", ")]).astype({"a": "Int32", "b": "Int32", "c": "Int32"})

    return run


def chosen(labels: DataFrame, heights: DataFrame, reject: DataFrame | None, h: int, w: int, scale: float, least_height: float = 3.0, least_radius: float = 1.5, shrink: float = 0.2) -> DataFrame:
    """label, area, crown_height of the instances worth a model: clear of reject (y, x), of a square of twice the least radius at
    least, and tall enough on the mask shrunk about the middle of its box."""
    kept = labels.where("label <> 0") if reject is None else instance_labels.clip_to(labels, reject)
    box = kept.groupBy("label").agg(F.min("y").alias("_y0"), F.min("x").alias("_x0"), F.max("y").alias("_y1"), F.max("x").alias("_x1"), F.count("*").alias("_n"))
    both = kept.join(heights.select("y", "x", "z"), ["y", "x"]).join(box, "label")
    # a pixel of the smaller mask is one whose place, moved away from the middle, is on the mask; inner places always are
    inner = lambda v, lo, hi: F.abs(F.col(v) - (F.col(lo) + F.col(hi)) / 2) <= (F.col(hi) - F.col(lo) + 1) / (2 * (1 + 2 * shrink))
    tall = both.where(inner("y", "_y0", "_y1") & inner("x", "_x0", "_x1")).groupBy("label").agg(F.bround(F.max("z"), 3).alias("crown_height"))
    area = F.bround(F.col("_n") * F.lit(scale * scale), 3)
    return box.select("label", area.alias("area")).join(tall, "label").where((F.col("area") >= (2 * least_radius) ** 2) & (F.col("crown_height") >= least_height))


def solids(labels: DataFrame, heights: DataFrame, tops: DataFrame, scale: float) -> DataFrame:
    """Rows of SOLID: vertices 0..23 of each instance, its triangles by these numbers, and its trunk's pixel. tops: label, y, x."""
    both = labels.where("label <> 0").select("y", "x", F.col("label").cast("int")).join(heights.select("y", "x", "z"), ["y", "x"])
    marked = both.join(tops.select(F.col("label").cast("int"), "y", "x", F.lit(True).alias("top")), ["label", "y", "x"], "left").withColumn("top", F.coalesce("top", F.lit(False)))
    return marked.groupBy("label").applyInPandas(_solid(scale), SOLID)


def metadata(solid: DataFrame, picked: DataFrame, terrain: DataFrame, geo: Geo, uuid: str, offset: float | bool = True) -> DataFrame:
    """name, label, origin_x, origin_y, origin_z, area, crown_height, elevation_offset of each tree; the offset is the terrain's height at the
    trunk, 0, or the given one."""
    trunk = solid.where("part = 'trunk'").select("label", F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))
    ground = trunk.join(terrain.select("y", "x", F.bround("z", 3).alias("origin_z")), ["y", "x"])
    at = {"origin_x": F.bround(geo.ox + F.col("x") * geo.sx, 3), "origin_y": F.bround(geo.oy + F.col("y") * geo.sy, 3)}
    up = F.col("origin_z") if offset is True else F.lit(0.0 if offset is False else float(offset))
    out = ground.join(picked, "label").withColumns(at).withColumn("elevation_offset", up).withColumn("name", F.concat(F.lit(f"{uuid}_"), F.col("label").cast("string")))
    return out.select("name", "label", "origin_x", "origin_y", "origin_z", "area", "crown_height", "elevation_offset")


def placed(solid: DataFrame, meta: DataFrame, geo: Geo) -> DataFrame:
    """label, k, x, y, z of all vertices in the raster's coordinates, lifted by their tree's offset."""
    v = solid.where("part = 'vertex'").join(meta.select("label", "elevation_offset"), "label")
    mm = lambda c: F.bround(c, 3)
    return v.select("label", "k", mm(geo.ox + F.col("x") * geo.sx).alias("x"), mm(geo.oy + F.col("y") * geo.sy).alias("y"), mm(F.col("z") + F.col("elevation_offset")).alias("z"))


def lines(solid: DataFrame, meta: DataFrame, geo: Geo, sub_name: str = "SolitaryVegetationObject", group: str = "lod_cfd") -> DataFrame:
    """section, seq, line of the OBJ text of all trees: each different vertex once, then each tree's names and faces."""
    at = linked.checkpoint(placed(solid, meta, geo))
    seq = F.col("label").cast("long") * 24 + F.col("k")
    distinct = at.withColumn("_s", seq).groupBy("x", "y", "z").agg(F.min("_s").alias("first"))
    numbers = linked.checkpoint(linked.numbered(distinct, "first", "vertex"))
    known = at.join(numbers, ["x", "y", "z"]).select("label", "k", "vertex")
    top = numbers.select(F.lit(0).alias("section"), F.col("vertex").cast("long").alias("seq"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("line"))
    head = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), t.alias("t")) for i, t in enumerate((F.concat(F.lit("o "), F.col("name")), F.lit(f"o {sub_name}"), F.lit(f"g {group}")))]))
    names = meta.select("label", head.alias("h")).select(F.lit(1).alias("section"), (F.col("label").cast("long") * 1000 + F.col("h.i")).alias("seq"), F.col("h.t").alias("line"))
    faces = solid.where("part = 'face'").select("label", F.col("k").alias("f"), F.posexplode(F.array("a", "b", "c")).alias("i", "k")).join(known, ["label", "k"])
    rows = faces.groupBy("label", "f").agg(F.array_sort(F.collect_list(F.struct("i", "vertex"))).alias("v"))
    text = F.concat_ws(" ", F.lit("f"), F.array_join(F.transform("v", lambda p: p["vertex"].cast("string")), " "))
    body = rows.select(F.lit(1).alias("section"), (F.col("label").cast("long") * 1000 + 3 + F.col("f")).alias("seq"), text.alias("line"))
    return top.unionByName(names).unionByName(body)


def shrunk(labels: DataFrame, h: int, w: int, factor: float = 0.2) -> DataFrame:
    """labels made smaller about the raster's middle."""
    return grid.shrink(labels, h, w, factor)
