"""City blocks: the shortest closed walk along streets around each of many points.

Streets are rows (u, v, key, name, geometry): the nodes at their ends, a number among streets of the same ends, a name or null,
and their line as an array of (x, y) from u to v. All searches go on together, one for each street that is nearest to a seed; a round
joins the ends of paths to streets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.functions.paths import contains_any
from terrafold.operators.graph import path_uuid
from terrafold.operators.linked import written

#: Names that are never part of a block.
LANES = ("Ruelle",)


def usable(streets: DataFrame, skip: list[str] | None = None) -> DataFrame:
    """streets that have a line and whose name holds none of the words to skip, whatever the case."""
    named = contains_any(F.lower("name"), [w.lower() for w in (*(skip or []), *LANES)])
    return streets.where(F.col("geometry").isNotNull() & (F.size("geometry") > 1) & ~F.coalesce(named, F.lit(False)))


def both_ways(streets: DataFrame) -> DataFrame:
    """eid, a, b, line: each street from either end; eid tells the street, whichever way it is given."""
    eid = F.concat_ws(":", F.least("u", "v").cast("string"), F.greatest("u", "v").cast("string"), F.col("key").cast("string"))
    there = streets.select(eid.alias("eid"), F.col("u").alias("a"), F.col("v").alias("b"), F.col("geometry").alias("line"))
    return there.unionByName(there.select("eid", F.col("b").alias("a"), F.col("a").alias("b"), F.reverse("line").alias("line"))).dropDuplicates(["eid", "a", "b"])


def _segments(line: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(line) - 1), lambda k: F.struct(F.element_at(line, k).alias("p"), F.element_at(line, k + 1).alias("q")))


def line_distance(line: Column, x: Column, y: Column) -> Column:
    """The distance of a point to a line of at least two places."""

    def of(s: Column) -> Column:
        dx, dy = s["q"]["x"] - s["p"]["x"], s["q"]["y"] - s["p"]["y"]
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - s["p"]["x"]) * dx + (y - s["p"]["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))))
        ex, ey = s["p"]["x"] + t * dx - x, s["p"]["y"] + t * dy - y
        return F.sqrt(ex * ex + ey * ey)

    return F.array_min(F.transform(_segments(line), of))


def surrounds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a point lies inside a closed ring, by the parity of its sides to the right."""

    def cuts(s: Column) -> Column:
        at = (s["q"]["x"] - s["p"]["x"]) * F.try_divide(y - s["p"]["y"], s["q"]["y"] - s["p"]["y"]) + s["p"]["x"]
        return ((s["p"]["y"] > y) != (s["q"]["y"] > y)) & F.coalesce(x < at, F.lit(False))

    return F.size(F.filter(_segments(ring), cuts)) % 2 == 1


def nearest_streets(streets: DataFrame, seeds: DataFrame, radius: float) -> DataFrame:
    """seed, x, y, u, v, eid: for each seed (seed, x, y) the street nearest to it within radius, of equals the first by eid, given from
    u to v as the table has it; seeds without one are left out. Streets and seeds meet in cells of the radius."""
    cell = lambda v: F.floor(v / radius)
    xs, ys = F.transform("geometry", lambda p: p["x"]), F.transform("geometry", lambda p: p["y"])
    spans = lambda a: F.explode(F.sequence(cell(F.array_min(a)) - 1, cell(F.array_max(a)) + 1))
    eid = F.concat_ws(":", F.least("u", "v").cast("string"), F.greatest("u", "v").cast("string"), F.col("key").cast("string"))
    dealt = streets.withColumns({"eid": eid, "_cx": spans(xs)}).withColumn("_cy", spans(ys))
    at = seeds.select("seed", "x", "y", cell(F.col("x")).alias("_cx"), cell(F.col("y")).alias("_cy"))
    near = at.join(dealt, ["_cx", "_cy"]).withColumn("_d", line_distance(F.col("geometry"), F.col("x"), F.col("y"))).where(F.col("_d") <= radius)
    best = near.groupBy("seed", "x", "y").agg(F.min(F.struct("_d", "eid", "u", "v")).alias("m"))
    return best.select("seed", "x", "y", "m.u", "m.v", "m.eid")


#: What tells a search: a street, and the end that it starts from.
SEARCH = ["u", "v", "eid"]


def _returns(ways: DataFrame, starts: DataFrame, most: int) -> DataFrame:
    """u, v, eid, node, left: the fewest streets from a node back to the street's u, without that street, up to most."""
    frontier = starts.select(*SEARCH, F.col("u").alias("node"))
    seen = frontier.withColumn("left", F.lit(0))
    for d in range(1, most + 1):
        step = frontier.join(ways.select(F.col("a").alias("node"), "b", F.col("eid").alias("_e")), "node").where("_e <> eid").select(*SEARCH, F.col("b").alias("node")).distinct()
        frontier = written(step.join(seen.drop("left"), [*SEARCH, "node"], "left_anti"))
        seen = seen.unionByName(frontier.withColumn("left", F.lit(d)))
        if frontier.isEmpty():
            break
    return seen


def around(streets: DataFrame, seeds: DataFrame, radius: float = 500.0, skip: list[str] | None = None, most: int = 10) -> DataFrame:
    """seed, uuid, nodes, ring of the block around each seed (seed, x, y): the closed walk of fewest streets, `most` at most, that begins
    with the street nearest to the seed, repeats no node and has the seed inside; of equals the first by its streets.

    Seeds without such a walk are left out. Walks are searched once for a street, however many seeds are near it, and tried on
    the different places of its seeds. Paths that can't be back in time are dropped each round, and a street's search ends in
    the round in which the last of its places has a block.
    """
    ways = written(both_ways(usable(streets, skip)))
    seeds = seeds.select("seed", "x", "y")
    places = seeds.select(F.struct("x", "y").alias("seed"), "x", "y").distinct()
    open_ = written(nearest_streets(usable(streets, skip), places, radius).drop("seed"))
    starts = written(open_.select(*SEARCH).distinct())
    home = _returns(ways, starts, most - 1)
    first = starts.join(ways.select("eid", F.col("a").alias("u"), F.col("b").alias("v"), "line"), SEARCH)
    paths = written(first.where("u <> v").select(*SEARCH, F.col("v").alias("node"), F.array("eid").alias("eids"), F.array("u", "v").alias("nodes"), F.col("line").alias("ring")))
    out = None
    for n in range(2, most + 1):
        step = paths.join(ways.select(F.col("a").alias("node"), F.col("b").alias("_b"), F.col("eid").alias("_e"), "line"), "node").where(~F.array_contains("eids", F.col("_e")))
        longer = step.select(*SEARCH, F.col("_b").alias("node"), F.concat("eids", F.array("_e")).alias("eids"), "nodes", F.concat("ring", F.slice("line", F.lit(2), F.size("line"))).alias("ring"))
        shut = longer.where(F.col("node") == F.col("u")).drop("node")
        back = open_.join(shut, SEARCH).where(surrounds(F.col("ring"), F.col("x"), F.col("y")))
        done = written(back.groupBy("x", "y").agg(F.min_by(F.struct("eids", "nodes", "ring"), "eids").alias("b")).select("x", "y", F.lit(n).alias("n"), "b.*"))
        out = done if out is None else out.unionByName(done)
        open_ = written(open_.join(done, ["x", "y"], "left_anti"))
        on = longer.where((F.col("node") != F.col("u")) & ~F.array_contains("nodes", F.col("node"))).withColumn("nodes", F.concat("nodes", F.array("node")))
        on = on.join(home, [*SEARCH, "node"]).where(F.col("left") <= most - n).drop("left").join(open_.select(*SEARCH).distinct(), SEARCH, "left_semi")
        paths = written(on)
        if paths.isEmpty():
            break
    # a seed that is given at several places has the block of fewest streets
    found = seeds.join(out, ["x", "y"]).groupBy("seed").agg(F.min_by(F.struct("nodes", "ring"), F.struct("n", "eids")).alias("b")).select("seed", "b.nodes", "b.ring")
    return found.select("seed", path_uuid(F.col("nodes")).alias("uuid"), "nodes", "ring")


def zones(blocks: DataFrame, least: float = 2500.0) -> DataFrame:
    """uuid, nodes, ring, area and n of the different blocks found from many seeds, those of at least `least` square metres."""
    cross = F.aggregate(_segments(F.col("ring")), F.lit(0.0), lambda acc, s: acc + s["p"]["x"] * s["q"]["y"] - s["q"]["x"] * s["p"]["y"])
    one = blocks.groupBy("uuid").agg(F.min_by(F.struct("nodes", "ring"), "seed").alias("b"), F.count("*").alias("n")).select("uuid", "b.nodes", "b.ring", "n")
    return one.withColumn("area", F.abs(cross) / 2).where(F.col("area") >= least)


def rows_of(blocks: DataFrame) -> DataFrame:
    """uuid, idx, x, y: the rings' places without the one that closes them, as polygons are given."""
    return blocks.select("uuid", F.posexplode(F.slice("ring", F.lit(1), F.size("ring") - 1)).alias("idx", "p")).select("uuid", "idx", "p.x", "p.y")
