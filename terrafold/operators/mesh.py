"""Meshes: height grids and vertex dictionaries as OBJ rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.operators import linked


def grid_faces(df: DataFrame, h: int, w: int) -> DataFrame:
    """face, a, b, c: two triangles for each square of four pixels, by 1-based vertex numbers in row order."""
    v = F.col("y") * w + F.col("x") + 1
    quads = df.where((F.col("y") < h - 1) & (F.col("x") < w - 1)).select((F.col("y") * (w - 1) + F.col("x")).alias("_q"), v.alias("_v"))
    pair = F.array(F.struct(F.lit(0).alias("k"), F.col("_v").alias("a"), (F.col("_v") + 1).alias("b"), (F.col("_v") + w + 1).alias("c")), F.struct(F.lit(1).alias("k"), F.col("_v").alias("a"), (F.col("_v") + w + 1).alias("b"), (F.col("_v") + w).alias("c")))
    return quads.select("_q", F.explode(pair).alias("f")).select((F.col("_q") * 2 + F.col("f.k")).alias("face"), "f.a", "f.b", "f.c")


def grid_vertices(df: DataFrame, w: int, sx: float = 1.0, sy: float = 1.0, ox: float = 0.0, oy: float = 0.0) -> DataFrame:
    """vertex, line: an OBJ line for each pixel."""
    x, y = F.col("x") * abs(sx) + ox, F.col("y") * abs(sy) + oy
    return df.select((F.col("y") * w + F.col("x") + 1).alias("vertex"), F.format_string("v %.3f %.3f %.3f", x.cast("double"), y.cast("double"), F.col("z").cast("double")).alias("line"))


def vertex_dictionary(vertices: DataFrame, decimals: int | None = None) -> DataFrame:
    """x, y, z, first, n of the distinct vertices of rows (seq, x, y, z), rounded: first is the smallest seq."""
    rounded = vertices if decimals is None else vertices.withColumns({c: F.bround(c, decimals) for c in "xyz"})
    return rounded.groupBy("x", "y", "z").agg(F.min("seq").alias("first"), F.count("*").alias("n"))


def numbered(dictionary: DataFrame) -> DataFrame:
    """dictionary with vertex, 1-based in order of first."""
    return linked.numbered(dictionary, "first", "vertex")


def translated(vertices: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return vertices.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy, "z": F.col("z") + dz})


def obj_lines(dictionary: DataFrame, faces: DataFrame, name: str, swap_yz: bool = False) -> DataFrame:
    """section, seq, line: vertex lines, then the object's name, then its faces (face, a, b, c)."""
    order = ("x", "z", "y") if swap_yz else ("x", "y", "z")
    v = dictionary.select(F.lit(0).alias("section"), F.col("vertex").cast("long").alias("seq"), F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in order]).alias("line"))
    head = dictionary.sparkSession.range(1).select(F.lit(1).alias("section"), F.col("id").alias("seq"), F.lit(f"o {name}").alias("line"))
    f = faces.select(F.lit(2).alias("section"), F.col("face").cast("long").alias("seq"), F.concat_ws(" ", F.lit("f"), "a", "b", "c").alias("line"))
    return v.unionByName(head).unionByName(f)
