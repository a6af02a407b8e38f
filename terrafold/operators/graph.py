"""Street graphs as edge rows (u, v)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.operators.linked import checkpoint


def canonical(edges: DataFrame) -> DataFrame:
    """a <= b of each edge, once."""
    return edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()


def bfs(edges: DataFrame, seed: int, depth: int) -> DataFrame:
    """node, depth: the fewest steps from seed along edges, up to depth. A round joins the frontier and drops nodes known."""
    spark = edges.sparkSession
    frontier = spark.range(1).select(F.lit(seed).cast("long").alias("node"))
    seen = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(frontier, F.col("u") == F.col("node")).select(F.col("v").cast("long").alias("node")).distinct()
        frontier = step.join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(d)))
    return seen


def loops(edges: DataFrame, seed: int, most: int = 10) -> DataFrame:
    """path of nodes of each closed walk from seed without repeated nodes, of at most `most` edges, in both directions."""
    out = None
    paths = edges.where((F.col("u") == seed) & (F.col("v") != seed)).select(F.array("u", "v").alias("path"))
    for _ in range(most - 1):
        step = checkpoint(paths.join(edges, F.element_at("path", -1) == F.col("u")).where((F.col("v") == seed) | ~F.array_contains("path", F.col("v"))))
        back = step.where((F.col("v") == seed) & (F.size("path") > 2)).select("path")
        out = back if out is None else out.unionByName(back)
        paths = step.where(~F.array_contains("path", F.col("v"))).select(F.concat("path", F.array("v")).alias("path"))
    return out


def path_uuid(nodes: Column) -> Column:
    """A version-4 UUID of a set of nodes: the first 16 bytes of the SHA-256 of their sorted list, stamped."""
    h = F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(nodes), lambda n: n.cast("string")), ", "), F.lit("]")), 256)
    nibble = F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 14, 3)), F.concat(nibble, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def nearest_edge(edges: DataFrame, x: float, y: float, skip: list[str] | None = None) -> DataFrame:
    """The edge (u, v, name, x1, y1, x2, y2) nearest to a point, by its straight segment; names holding one of skip do not count."""
    kept = edges
    for word in skip or []:
        kept = kept.where(F.col("name").isNull() | ~F.lower(F.col("name")).contains(word.lower()))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - F.col("x1")) * dx + (y - F.col("y1")) * dy, dx * dx + dy * dy), F.lit(0.0))))
    px, py = F.col("x1") + t * dx - x, F.col("y1") + t * dy - y
    return kept.withColumn("distance", F.sqrt(px * px + py * py)).orderBy("distance", "u", "v").limit(1)


def at_node(edges: DataFrame) -> DataFrame:
    """node, n, end: how many streets (u, v) leave each node, and the smallest node that one leads to."""
    return edges.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n"), F.min("v").alias("end"))


def at_points(edges: DataFrame, points: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """pid, u, v, key of edges (u, v, key, geometry: an array of x, y) whose first or last point lies within tolerance of a point
    (pid, x, y), once each. Ends and points meet in square cells as wide as the tolerance; without one, in equal coordinates.
    Edges without geometry and points without coordinates meet nothing."""
    if not 0 <= tolerance < float("inf"):
        raise ValueError(f"a tolerance is 0 or more, not {tolerance}")
    end = F.explode(F.array(F.element_at("geometry", 1), F.element_at("geometry", -1)))
    ends = edges.where(F.size("geometry") > 0).select("u", "v", "key", end.alias("e")).select("u", "v", "key", F.col("e.x").alias("ex"), F.col("e.y").alias("ey"))
    near = points.select("pid", "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    if tolerance == 0:
        return ends.join(near, (F.col("ex") == F.col("x")) & (F.col("ey") == F.col("y"))).select("pid", "u", "v", "key").distinct()
    cell = lambda c: F.floor(F.col(c) / tolerance)
    around = lambda c: F.explode(F.sequence(cell(c) - 1, cell(c) + 1))
    spread = near.select("*", around("x").alias("cx")).select("*", around("y").alias("cy"))
    met = ends.withColumns({"cx": cell("ex"), "cy": cell("ey")}).join(spread, ["cx", "cy"])
    apart = (F.col("ex") - F.col("x")) ** 2 + (F.col("ey") - F.col("y")) ** 2
    return met.where(F.sqrt(apart) <= tolerance).select("pid", "u", "v", "key").distinct()
