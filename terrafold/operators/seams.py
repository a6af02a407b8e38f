"""Instances cut by the seam between two rasters that lie side by side, joined again where they look like parts of one circle.

Only instances at the seam are gathered, each pair of them in one task; all others pass as rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.model import CIRCLE_TOLERANCE, PIXEL_TOLERANCE
from terrafold.operators import coords, halo, kernels, linked
from terrafold.operators import labels as instance_labels


def thin(m: np.ndarray) -> np.ndarray:
    """A line one pixel wide in the middle of m: pixels go from either side in turn while their ring of neighbours stays in one piece."""
    m = np.pad(m.astype(bool), 1)
    while True:
        before = m.sum()
        for odd in (0, 1):
            p = [np.roll(m, s, (0, 1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]
            count = sum(q.astype(int) for q in p)
            steps = sum((~p[k] & p[(k + 1) % 8]).astype(int) for k in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            open_ = ~(n & e & s) & ~(e & s & w) if odd == 0 else ~(n & e & w) & ~(n & s & w)
            m = m & ~((count >= 2) & (count <= 6) & (steps == 1) & open_)
        if m.sum() == before:
            return m[1:-1, 1:-1]


def _square(pdf: pd.DataFrame, margin: int) -> tuple[np.ndarray, int, int]:
    """A pair's pixels as an array of 1 (first), 2 (second) and 0, with margin around, and the raster place of its corner."""
    y, x = pdf["y"].to_numpy(), pdf["x"].to_numpy()
    top, left = int(y.min()) - margin, int(x.min()) - margin
    a = np.zeros((y.max() - top + margin + 1, x.max() - left + margin + 1), np.int8)
    a[y - top, x - left] = np.where(pdf["first"].to_numpy(bool), 1, 2)
    return a, top, left


MET = "a int, b int, area_a long, area_b long, seam long"


def _meeting(reach: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, _, _ = _square(pdf, reach + 1)
        near = halo._near(m == 1, reach)
        touch = (halo._near(near, 1) & (m == 2)).any()
        seam = int(thin(near & (m == 2)).sum()) if touch else -1
        return pd.DataFrame({"a": [int(pdf["a"].iloc[0])], "b": [int(pdf["b"].iloc[0])], "area_a": [int((m == 1).sum())], "area_b": [int((m == 2).sum())], "seam": [seam]})

    return run


def _closed(reach: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        m, top, left = _square(pdf, 2 * reach + 1)
        on = m > 0
        full = ~halo._near(~halo._near(on, reach), reach)
        y, x = np.nonzero(full)
        patch = kernels._label(pd.DataFrame({"y": y, "x": x, "value": 1}), full.shape[1])
        ids, n = np.unique(patch, return_counts=True)
        keep = patch == ids[n.argmax()]
        return pd.DataFrame({"a": int(pdf["a"].iloc[0]), "b": int(pdf["b"].iloc[0]), "y": y[keep] + top, "x": x[keep] + left})

    return run


def pairs(first: DataFrame, second: DataFrame, axis: str, at: int, reach: int = PIXEL_TOLERANCE) -> DataFrame:
    """a, b, area_a, area_b, seam of instances of first and second that come within reach of each other across the seam at `at` along
    axis: pixels of the thinned strip where a, grown by reach, covers b. Only those within reach of the seam are looked at."""
    side = "x" if axis == "y" else "y"
    rim_a = first.where((F.col("label") != 0) & (F.col(axis) >= at - reach)).select("y", "x", F.col("label").alias("a"))
    rim_b = second.where((F.col("label") != 0) & (F.col(axis) < at + reach)).select("y", "x", F.col("label").alias("b"))
    far = reach + 2
    cell = F.floor(F.col(side) / far)
    near = rim_a.withColumn("_c", F.explode(F.array(cell - 1, cell, cell + 1))).groupBy("a", "_c").agg(F.max(axis).alias("_m"), F.min(side).alias("_lo"), F.max(side).alias("_hi"))
    far_b = rim_b.withColumn("_c", cell).groupBy("b", "_c").agg(F.min(axis).alias("_n"), F.min(side).alias("_l"), F.max(side).alias("_h"))
    close = near.join(far_b, "_c").where((F.col("_n") - F.col("_m") <= far) & (F.col("_l") <= F.col("_hi") + far) & (F.col("_h") >= F.col("_lo") - far)).select("a", "b").distinct()
    pixels = first.where("label <> 0").select("y", "x", F.col("label").alias("a"), F.lit(True).alias("first")).join(close, "a")
    other = second.where("label <> 0").select("y", "x", F.col("label").alias("b"), F.lit(False).alias("first")).join(close, "b")
    both = pixels.select("a", "b", "y", "x", "first").unionByName(other.select("a", "b", "y", "x", "first"))
    return both.groupBy("a", "b").applyInPandas(_meeting(reach), MET).where("seam >= 0")


def matches(met: DataFrame, tolerance: float = CIRCLE_TOLERANCE) -> DataFrame:
    """a, b of pairs (as pairs() gives them) that belong together: the seam's length is near that of the chord that cuts a circle of both
    areas into them, by tolerance, and neither has a better partner; of equals the smaller labels."""
    ratio = F.try_divide("seam", coords.chord(F.col("area_a"), F.col("area_b")))
    scored = met.withColumn("_d", F.when(ratio > 1, ratio - 1).otherwise(1 - ratio)).where(F.col("_d") <= tolerance)
    best_a = scored.groupBy("a").agg(F.min(F.struct("_d", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    best_b = scored.groupBy("b").agg(F.min(F.struct("_d", "a")).alias("m")).select("b", F.col("m.a").alias("a"))
    return best_a.join(best_b, ["a", "b"])


def combine(first: DataFrame, second: DataFrame, size: int, axis: str = "y", reach: int = PIXEL_TOLERANCE, tolerance: float = CIRCLE_TOLERANCE) -> DataFrame:
    """y, x, label of second laid behind first along axis at size, cut instances joined and their cracks closed; renumbered.

    A pixel that closing adds belongs to the joined instance where nothing else is; pixels of 0 are rows only where they were.
    """
    first = linked.checkpoint(first.select("y", "x", F.col("label").cast("int")))
    top = first.agg(F.coalesce(F.max("label"), F.lit(0)).alias("_top")).first()[0]
    moved = second.withColumn(axis, (F.col(axis) + size).cast("int")).withColumn("label", F.when(F.col("label") != 0, F.col("label") + top).otherwise(0))
    moved = linked.checkpoint(moved.select("y", "x", F.col("label").cast("int")))
    both = first.unionByName(moved)
    joined = linked.checkpoint(matches(linked.checkpoint(pairs(first, moved, axis, size, reach)), tolerance))
    parts = both.where("label <> 0").join(joined.select(F.col("a").alias("label"), "a", "b").unionByName(joined.select(F.col("b").alias("label"), "a", "b")), "label")
    whole = parts.select("a", "b", "y", "x", (F.col("label") == F.col("a")).alias("first")).groupBy("a", "b").applyInPandas(_closed(reach), "a int, b int, y int, x int")
    grown = whole.groupBy("y", "x").agg(F.min("a").alias("_w"))
    gone = joined.select(F.col("b").alias("label"), F.col("a").alias("_a")).unionByName(joined.select(F.col("a").alias("label"), F.col("a").alias("_a")))
    named = both.join(gone, "label", "left").join(grown, ["y", "x"], "left")
    label = F.when(F.col("_a").isNotNull(), F.coalesce("_w", F.lit(0))).when(F.col("label") == 0, F.coalesce("_w", F.lit(0))).otherwise(F.col("label"))
    return instance_labels.relabel(linked.checkpoint(named.select("y", "x", label.alias("label"))))


def combine_four(quarters: list[DataFrame], h: int, w: int, reach: int = PIXEL_TOLERANCE, tolerance: float = CIRCLE_TOLERANCE) -> DataFrame:
    """Four rasters of h x w (top left, top right, bottom left, bottom right) as one."""
    rows = [combine(quarters[k], quarters[k + 1], w, "x", reach, tolerance) for k in (0, 2)]
    return combine(rows[0], rows[1], h, "y", reach, tolerance)
