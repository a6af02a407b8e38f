"""What is walked round step by step: outlines of labels, and loose streets put in order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from terrafold.operators.linked import checkpoint, written

#: Edges of a path that one call puts in order; those of longer paths are walked by doubling.
MOST = 1 << 18


def rings(links: DataFrame) -> DataFrame:
    """id, head (the smallest id of its ring), seq (steps from head) and n (ids of the ring) of links (id, next) that form rings:
    every id once, every next the id of one row. Ids are of any type with an order; no links give no rows.

    Each round doubles the reach of every id: it knows the smallest id within reach, how far off that is, and the id beyond. Where
    the next stretch has the same smallest id, the ring is closed. All of a ring find that in one round or the next, so long rings
    go on without short ones, as many rounds as the longest has binary digits.
    """
    live = written(links.select("id", "next", F.col("id").alias("head"), F.lit(0).cast("long").alias("off")))
    done, fresh, reach = [], None, 1
    while not live.isEmpty():
        ahead = live if fresh is None else live.unionByName(fresh)
        ahead = ahead.select(F.col("id").alias("next"), F.col("next").alias("_next"), F.col("head").alias("_head"), F.col("off").alias("_off"))
        near = F.col("head") <= F.col("_head")
        step = written(live.join(ahead, "next").select(
            "id", F.col("_next").alias("next"), F.when(near, F.col("head")).otherwise(F.col("_head")).alias("head"),
            F.when(near, F.col("off")).otherwise(F.col("_off") + reach).alias("off"), F.when(F.col("head") == F.col("_head"), F.col("_off") - F.col("off") + reach).alias("n"),
        ))
        done.append(step.where("n IS NOT NULL"))
        fresh, live, reach = done[-1].drop("n"), step.where("n IS NULL").drop("n"), reach * 2
    found = reduce(DataFrame.unionByName, done) if done else live.withColumn("n", F.lit(0).cast("long"))
    return found.select("id", "head", ((F.col("n") - F.col("off")) % F.col("n")).alias("seq"), "n")


def _sides(pixels: DataFrame, keys: list[str]) -> DataFrame:
    """Straight boundary sides (keys, dir, y, x, y1, x1) of labels, corner to corner, with the label to the right hand: dir 0 goes to
    larger x along tops, 1 to larger y, 2 back along bottoms, 3 to smaller y."""
    out = []
    for along, across, (low, high) in (("x", "y", (0, 2)), ("y", "x", (3, 1))):
        w = Window.partitionBy(*keys, along).orderBy(across)
        bare = lambda f, to, w=w, across=across: ~f(across).over(w).eqNullSafe(F.col(across) + to)
        side = lambda on, d, line: F.when(on, F.struct(F.lit(d).alias("dir"), line.alias("line")))
        pair = F.array(side(bare(F.lag, -1), low, F.col(across)), side(bare(F.lead, 1), high, F.col(across) + 1))
        one = pixels.select(*keys, F.col(along).alias("at"), F.array_compact(pair).alias("s")).select(*keys, "at", F.explode("s").alias("s")).select(*keys, "s.dir", "s.line", "at")
        run = one.withColumn("run", F.col("at") - F.row_number().over(Window.partitionBy(*keys, "dir", "line").orderBy("at")))
        runs = run.groupBy(*keys, "dir", "line", "run").agg(F.min("at").alias("lo"), (F.max("at") + 1).alias("hi"))
        up = F.col("dir").isin(0, 1)
        start, end = F.when(up, F.col("lo")).otherwise(F.col("hi")), F.when(up, F.col("hi")).otherwise(F.col("lo"))
        place = {along: (start, end), across: (F.col("line"), F.col("line"))}
        out.append(runs.select(*keys, "dir", place["y"][0].alias("y"), place["x"][0].alias("x"), place["y"][1].alias("y1"), place["x"][1].alias("x1")))
    return out[0].unionByName(out[1])


def outlines(pixels: DataFrame, by: tuple[str, ...] = (), diagonal: bool = True) -> DataFrame:
    """by, label, ring_y, ring_x, ring_dir, hole, seq, y, x, n: the corners of every outline of every label over 0 of pixels (by, y, x,
    label; one row a pixel), in order, from the uppermost corner (the leftmost of these) on, with the label to the right hand.

    Pixel (y, x) reaches from corner (y, x) to (y + 1, x + 1). Pixels that touch at a corner are of one outline if diagonal, else of
    two. A ring is named by the place and direction of its first side. Null and other labels have no outline; no pixels give no rows.
    """
    keys = [*by, "label"]
    sides = written(_sides(pixels.where("label > 0").select(*keys, "y", "x"), keys))
    name = F.struct(*keys, "y", "x", "dir")
    starts = sides.select(*keys, F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("dir").alias("turn"), name.alias("next"), F.count("*").over(Window.partitionBy(*keys, "y", "x")).alias("ways"))
    links = sides.join(starts, [*keys, "y1", "x1"]).where((F.col("ways") == 1) | (F.col("turn") == (F.col("dir") + (3 if diagonal else 1)) % 4))
    walk = rings(links.select(name.alias("id"), "next"))
    return walk.select(
        *[F.col(f"id.{k}").alias(k) for k in keys], F.col("head.y").alias("ring_y"), F.col("head.x").alias("ring_x"), F.col("head.dir").alias("ring_dir"),
        (F.col("head.dir") != 0).alias("hole"), "seq", F.col("id.y").alias("y"), F.col("id.x").alias("x"), "n",
    )


RING = ("ring_y", "ring_x", "ring_dir")


def simplified(corners: DataFrame, edges: int, by: tuple[str, ...] = ()) -> DataFrame:
    """corners (of outlines) without those that change a ring's area least, until a ring has edges of them or fewer; seq and n are
    those of the corners left, in order from 0.

    A round drops corners whose triangle with their neighbours is smaller than those of both neighbours (equal ones: the earlier
    goes), of these the smallest first where not all may go. Every ring over its number loses at least one each round.
    """
    if edges < 3:
        raise ValueError(f"a ring has 3 edges or more, not {edges}")
    keys = [*by, "label", *RING]
    w = Window.partitionBy(*keys).orderBy("seq")
    live, done = corners, []
    while True:
        live = written(live.withColumn("n", F.count("*").over(Window.partitionBy(*keys))).withColumn("seq", F.row_number().over(w).cast("long") - 1))
        done.append(live.where(F.col("n") <= edges))
        live = live.where(F.col("n") > edges)
        if live.isEmpty():
            return reduce(DataFrame.unionByName, done)
        ends = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

        def beside(c: str, ends=ends) -> tuple[Column, Column]:
            """c of the corner before and of the one after, round the ring."""
            return F.coalesce(F.lag(c).over(w), F.last(c).over(ends)), F.coalesce(F.lead(c).over(w), F.first(c).over(ends))

        (y0, y2), (x0, x2) = beside("y"), beside("x")
        area = F.abs((F.col("x") - x0) * (y2 - y0) - (x2 - x0) * (F.col("y") - y0)).cast("long")
        weighed = live.withColumn("_w", F.struct(area.alias("a"), F.col("seq").alias("s")))
        before, after = beside("_w")
        weighed = weighed.withColumn("_least", (F.col("_w") < before) & (F.col("_w") < after))
        turn = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_least").desc(), "_w"))
        live = weighed.withColumn("_turn", turn).where(~F.col("_least") | (F.col("_turn") > F.col("n") - edges)).drop("_w", "_least", "_turn")


def contours(corners: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by, label, contour (an array of y, x in order) of the outer ring of each label that has most corners (of those the first): as
    large as the simplified ring, for label lines."""
    point = F.struct(F.col("seq"), F.col("y").cast("double").alias("y"), F.col("x").cast("double").alias("x"))
    whole = corners.where(~F.col("hole")).groupBy(*by, "label", *RING).agg(F.array_sort(F.collect_list(point)).alias("p"))
    best = whole.groupBy(*by, "label").agg(F.min_by("p", F.struct(-F.size("p"), *RING)).alias("p"))
    return best.select(*by, "label", F.transform("p", lambda c: F.struct(c.y.alias("y"), c.x.alias("x"))).alias("contour"))


def _by_doubling(edges: DataFrame) -> DataFrame:
    """ordered, of paths of any length: each edge is walked both ways, and a walk that ends turns back, so that all walks are rings."""
    way = lambda s, t, d: F.struct(F.col(s).alias("s"), F.col(t).alias("t"), F.lit(d).alias("dir"))
    darts = edges.select("path", "edge", F.explode(F.array(way("u", "v", 0), way("v", "u", 1))).alias("d")).select("path", "edge", "d.*")
    leaving = F.struct("edge", "dir")
    twos = written(darts.groupBy("path", "s").agg(F.count("*").alias("n"), F.min(leaving).alias("lo"), F.max(leaving).alias("hi")).where("n = 2").drop("n"))
    inner = darts.join(twos.select("path", "s", F.lit(True).alias("inner")), ["path", "s"], "left").withColumn("inner", F.coalesce("inner", F.lit(False)))
    both = inner.join(twos.withColumnRenamed("s", "t"), ["path", "t"], "left")

    def name(inside: Column, node: Column, edge: Column, direction: Column) -> Column:
        return F.struct(F.col("path"), inside.alias("inner"), F.when(~inside, node).alias("end"), edge.alias("edge"), direction.alias("dir"))

    back = F.struct(F.col("edge"), (1 - F.col("dir")).alias("dir"))
    on = F.when(F.col("lo") == back, F.col("hi")).otherwise(F.col("lo"))
    goes = F.col("lo").isNotNull()
    links = both.select(name(F.col("inner"), F.col("s"), F.col("edge"), F.col("dir")).alias("id"), F.when(goes, name(F.lit(True), F.col("t"), on["edge"], on["dir"])).otherwise(name(F.lit(False), F.col("t"), back["edge"], back["dir"])).alias("next"))
    walk = rings(links)
    closed = F.col("head.inner")
    kept = walk.where(F.when(closed, F.col("head.dir") == 0).otherwise(F.col("seq") * 2 < F.col("n")))
    kept = kept.select(
        F.col("id.path").alias("_path"), F.col("id.edge").alias("_edge"), F.col("head.edge").alias("chain"), closed.alias("closed"), "seq", (F.col("id.dir") == 1).alias("flipped"),
        F.when(closed, F.col("n")).otherwise(F.floor(F.col("n") / 2)).alias("n"),
    )
    turned = edges.join(kept, edges["path"].eqNullSafe(F.col("_path")) & (edges["edge"] == F.col("_edge"))).drop("_path", "_edge")
    return turned.withColumns({"u": F.when(F.col("flipped"), F.col("v")).otherwise(F.col("u")), "v": F.when(F.col("flipped"), F.col("u")).otherwise(F.col("v"))})


def _walk(u: list, v: list) -> list[tuple[int, bool, int, bool, int]]:
    """Chain (its first edge), closed, seq, flipped and n of each edge of a path, given in order of edges. 2 k and 2 k + 1 are edge k
    forward and back."""
    ends, leaving = (u, v), {}
    for k in range(len(u)):
        for way in (0, 1):
            leaving.setdefault(ends[way][k], []).append(2 * k + way)
    inner = lambda node: node is not None and len(leaving[node]) == 2
    source = lambda d: ends[d & 1][d >> 1]
    outer = sorted((d for d in range(2 * len(u)) if not inner(source(d))), key=lambda d: (False, 0, d) if source(d) is None else (True, source(d), d))
    out: list = [None] * len(u)
    for first in (*outer, *range(0, 2 * len(u), 2)):  # what is left after the open chains is closed
        if out[first >> 1] is not None:
            continue
        run, at, closed = [], first, False
        while True:
            run.append(at)
            node = source(at ^ 1)
            if not inner(node):
                break
            a, b = leaving[node]
            at = b if a == at ^ 1 else a
            if at == first:
                closed = True
                break
        for seq, d in enumerate(run):
            out[d >> 1] = (first >> 1, closed, seq, d & 1 == 1, len(run))
    return out


def _in_order(edges: DataFrame) -> DataFrame:
    """ordered, of paths that a task can hold one by one: shuffled once, by path."""

    def walked(rows: pa.Table, cuts: list[int]) -> Iterator[pa.RecordBatch]:
        u, v = rows.column("u").to_pylist(), rows.column("v").to_pylist()
        nowhere = rows.column("path").is_null().to_pylist()
        found = []
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if nowhere[lo]:  # a chain of its own, from the smaller of its ends
                found.append((lo, False, 0, v[lo] is None and u[lo] is not None or None not in (u[lo], v[lo]) and v[lo] < u[lo], 1))
            else:
                found += [(lo + c, *more) for c, *more in _walk(u[lo:hi], v[lo:hi])]
        chain, closed, seq, flipped, n = (list(c) for c in zip(*found, strict=True))
        turned = pa.array(flipped, pa.bool_())
        a, b = rows.column("u"), rows.column("v")
        rows = rows.set_column(rows.schema.get_field_index("u"), "u", pa.compute.if_else(turned, b, a)).set_column(rows.schema.get_field_index("v"), "v", pa.compute.if_else(turned, a, b))
        more = {"chain": rows.column("edge").take(pa.array(chain, pa.int64())), "closed": pa.array(closed, pa.bool_()), "seq": pa.array(seq, pa.int64()), "flipped": turned, "n": pa.array(n, pa.int64())}
        for name, column in more.items():
            rows = rows.append_column(name, column)
        yield from rows.combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []  # the last path so far, which may go on
        for batch in batches:
            held.append(batch)
            rows = pa.Table.from_batches(held).combine_chunks()
            if not rows.num_rows:
                continue
            path = rows.column("path").combine_chunks()
            new = pa.compute.fill_null(pa.compute.not_equal(path[1:], path[:-1]), True)
            cuts = [0, *(np.flatnonzero(new.to_numpy(zero_copy_only=False)) + 1).tolist()]
            if len(cuts) > 1:
                yield from walked(rows.slice(0, cuts[-1]), cuts)
            held = rows.slice(cuts[-1]).to_batches()
        rows = pa.Table.from_batches(held) if held else None
        if rows is not None and rows.num_rows:
            yield from walked(rows, [0, rows.num_rows])

    more = [T.StructField("chain", edges.schema["edge"].dataType), T.StructField("closed", T.BooleanType()), *[T.StructField(k, t()) for k, t in (("seq", T.LongType), ("flipped", T.BooleanType), ("n", T.LongType))]]
    return edges.repartition("path").sortWithinPartitions("path", "edge").mapInArrow(run, T.StructType([*edges.schema.fields, *more]))


def ordered(edges: DataFrame) -> DataFrame:
    """edges (path, edge, u, v and other columns) with chain, closed, seq, flipped, n; u and v as the walk takes them.

    Edges of a path come in any order and direction; edge names one of a path. A chain goes on through nodes of two edges and ends
    at others, so a path that branches has several; it is named by its first edge. A closed chain starts with its smallest edge, as
    that one is directed; an open one at the smaller of its ends. A null node ends a chain; edges of a null path are chains of one.
    Paths are put in order one by one as they stream through a task; those of more than MOST edges, and nodes that are neither whole
    numbers nor strings, are walked by doubling.
    """
    if not all(isinstance(edges.schema[k].dataType, (T.IntegralType, T.StringType)) for k in ("u", "v")):
        return _by_doubling(edges)
    wide = checkpoint(edges.groupBy("path").agg(F.count("*").alias("_n")).where((F.col("_n") > MOST) & F.col("path").isNotNull()).select("path"))
    if wide.isEmpty():
        return _in_order(edges)
    wide = F.broadcast(wide)
    return _in_order(edges.join(wide, "path", "left_anti")).unionByName(_by_doubling(edges.join(wide, "path", "left_semi").select(*edges.columns)))


def walked_nodes(walk: DataFrame) -> DataFrame:
    """path, chain, seq, node of ordered edges: a closed chain's first node is not repeated at its end."""
    stop = lambda seq, node: F.struct(seq.alias("seq"), F.col(node).alias("node"))
    here, last = stop(F.col("seq"), "u"), stop(F.col("seq") + 1, "v")
    ends = ~F.col("closed") & (F.col("seq") == F.col("n") - 1)
    return walk.select("path", "chain", F.explode(F.when(ends, F.array(here, last)).otherwise(F.array(here))).alias("s")).select("path", "chain", "s.seq", "s.node")


def walked_points(walk: DataFrame, close: bool = True) -> DataFrame:
    """path, chain, seq, pos, x, y of the geometry (an array of x, y) of ordered edges, in order of seq and pos; where edges meet, the
    point stands once. close: a chain that does not end where it began goes back there. Edges without geometry add no points."""
    way = F.when(F.col("flipped"), F.reverse("geometry")).otherwise(F.col("geometry"))
    rows = walk.select("path", "chain", "seq", F.posexplode(way).alias("pos", "p")).where("seq = 0 OR pos > 0").select("path", "chain", "seq", "pos", "p.x", "p.y")
    if not close:
        return rows
    point, place = F.struct("x", "y"), F.struct("seq", "pos")
    ends = rows.groupBy("path", "chain").agg(F.min_by(point, place).alias("a"), F.max_by(point, place).alias("b"), F.max("seq").alias("seq")).where("a <> b")
    return rows.unionByName(ends.select("path", "chain", (F.col("seq") + 1).alias("seq"), F.lit(0).alias("pos"), "a.x", "a.y"))
