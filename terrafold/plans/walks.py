"""Registered queries that walk outlines and loose streets, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from terrafold.operators import chains, detect, graph, groups
from terrafold.plans import fixtures as fx
from terrafold.plans.registry import query

# Outlines. The SQL walks pixel side by pixel side, from every side as long as no smaller one is met.

WALK = """, p AS MATERIALIZED (SELECT * FROM inst WHERE label > 0),
    s AS MATERIALIZED (SELECT row_number() OVER (ORDER BY label, y, x, dir) i, * FROM (
        SELECT a.label, a.y + sy y, a.x + sx x, dir, a.y + ty y1, a.x + tx x1
        FROM p a, (VALUES (0, 0, 0, 0, 1, -1, 0), (1, 0, 1, 1, 1, 0, 1), (2, 1, 1, 1, 0, 1, 0), (3, 1, 0, 0, 0, 0, -1)) d(dir, sy, sx, ty, tx, ny, nx)
        WHERE NOT EXISTS (SELECT 1 FROM p b WHERE b.label = a.label AND b.y = a.y + ny AND b.x = a.x + nx))),
    k AS MATERIALIZED (SELECT label, y, x, count(*) c FROM s GROUP BY ALL),
    f AS MATERIALIZED (SELECT a.i, b.i nxt, b.y, b.x, b.dir <> a.dir corner FROM s a JOIN k ON k.label = a.label AND k.y = a.y1 AND k.x = a.x1 JOIN s b ON b.label = a.label AND b.y = a.y1 AND b.x = a.x1 AND (c = 1 OR b.dir = (a.dir + 3) % 4)),
    w AS (SELECT i head, i cur, 0 step FROM s UNION ALL SELECT head, nxt, step + 1 FROM w JOIN f ON f.i = cur WHERE nxt > head),
    r AS MATERIALIZED (SELECT head FROM w JOIN f ON f.i = cur WHERE nxt = head),
    c AS (SELECT head, step, t.label, t.y, t.x FROM r JOIN w USING (head) JOIN s t ON t.i = cur WHERE EXISTS (SELECT 1 FROM f WHERE f.nxt = cur AND corner))
    """


@query(WALK + "SELECT c.label, h.y ring_y, h.x ring_x, h.dir <> 0 AS hole, row_number() OVER (PARTITION BY head ORDER BY step) - 1 AS seq, c.y, c.x FROM c JOIN s h ON h.i = head", "inst")
def outlines(spark, d):
    """Corners of the rings around the instances, holes too."""
    return chains.outlines(fx.inst(spark, d)).select("label", "ring_y", "ring_x", "hole", "seq", "y", "x")


@query("SELECT label, count(*) * 2 AS area2 FROM inst WHERE label > 0 GROUP BY label", "inst")
def outline_areas(spark, d):
    """Twice the area that the rings of a label enclose, holes taken off: twice its pixels."""
    c = chains.outlines(fx.inst(spark, d))
    w = Window.partitionBy("label", *chains.RING).orderBy("seq")
    first = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = lambda k: F.coalesce(F.lead(k).over(w), F.first(k).over(first))
    return c.select("label", (F.col("x") * after("y") - after("x") * F.col("y")).alias("t")).groupBy("label").agg(F.sum("t").alias("area2"))


@query()
def instance_label_lines(spark, d):
    """Label lines of the instances, each by its longest outline of at most 32 edges, on a square as high as the raster."""
    c = chains.contours(chains.simplified(chains.outlines(fx.inst(spark, d)), 32))
    return detect.label_lines(c.select(F.col("label").alias("image"), (F.col("label") % 7).alias("cls"), "contour"), fx.geo(spark, d).h)


# Loose streets: the orders of a customer as nodes under mixed numbers, every third customer's closed to a round


LOOSE = """WITH o AS (SELECT o_custkey path, o_orderkey * 2654435761 % 4294967296 node, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY o_custkey) k,
        coalesce(lead(o_orderkey) OVER w, first_value(o_orderkey) OVER w) * 2654435761 % 4294967296 AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    m AS MATERIALIZED (SELECT path, node edge, node a, nxt b, i, k, path % 3 = 0 AND k > 2 AS closed, node % 2 = 1 AS odd FROM o WHERE i < k - 1 OR path % 3 = 0 AND k > 2),
    g AS (SELECT path, arg_min(i, edge) h, arg_min(odd, edge) hodd, arg_min(edge, i) e0, arg_max(edge, i) e1, arg_min(a, i) n0, arg_max(b, i) n1 FROM m GROUP BY path),
    z AS MATERIALIZED (SELECT m.*, CASE WHEN closed THEN hodd ELSE n1 < n0 END AS back, CASE WHEN closed THEN (CASE WHEN hodd THEN h - i ELSE i - h END + k) % k WHEN n1 < n0 THEN k - 2 - i ELSE i END AS seq,
        CASE WHEN closed THEN min(edge) OVER (PARTITION BY path) WHEN n1 < n0 THEN e1 ELSE e0 END AS chain FROM m JOIN g USING (path))
    """


def _loose(spark, d):
    k = F.col("o_orderkey")
    node = lambda c: c * 2654435761 % 4294967296
    by = Window.partitionBy("o_custkey")
    o = fx.table(spark, d, "orders").select(
        F.col("o_custkey").alias("path"), node(k).alias("a"), F.lead(k).over(by.orderBy(k)).alias("after"), F.min(k).over(by).alias("first"), F.count("*").over(by).alias("k"),
    )
    e = o.withColumn("b", node(F.coalesce("after", F.when((F.col("path") % 3 == 0) & (F.col("k") > 2), F.col("first"))))).where("b IS NOT NULL")
    odd = F.col("a") % 2 == 1
    return e.select("path", F.col("a").alias("edge"), F.when(odd, F.col("b")).otherwise(F.col("a")).alias("u"), F.when(odd, F.col("a")).otherwise(F.col("b")).alias("v"))


@query(LOOSE + "SELECT path, chain, closed, seq, edge, CASE WHEN back THEN b ELSE a END AS u, CASE WHEN back THEN a ELSE b END AS v FROM z")
def ordered_streets(spark, d):
    """Edges of all customers, loose and turned at random, in the order and direction of a walk."""
    return chains.ordered(_loose(spark, d)).select("path", "chain", "closed", "seq", "edge", "u", "v")


@query(LOOSE + "SELECT path, chain, seq, CASE WHEN back THEN b ELSE a END AS node FROM z UNION ALL SELECT path, chain, seq + 1, CASE WHEN back THEN a ELSE b END FROM z WHERE NOT closed AND seq = k - 2")
def ordered_nodes(spark, d):
    return chains.walked_nodes(chains.ordered(_loose(spark, d)))


@query(
    """WITH e AS (SELECT k u, k + step v, k % 25 * 100.0::DOUBLE ux, k // 25 * 100.0::DOUBLE uy, (k + step) % 25 * 100.0::DOUBLE vx, (k + step) // 25 * 100.0::DOUBLE vy
            FROM (SELECT s_suppkey k FROM supplier), (VALUES (1), (25)) t(step) WHERE step = 25 OR (k + 1) % 25 <> 0),
        p AS (SELECT c_custkey pid, c_custkey * 37 % 2400 + 0.5::DOUBLE x, c_custkey * 53 % 4000 + 0.25::DOUBLE y FROM customer)
    SELECT pid, u, v FROM p, e WHERE (ux - x) * (ux - x) + (uy - y) * (uy - y) <= 900 OR (vx - x) * (vx - x) + (vy - y) * (vy - y) <= 900"""
)
def streets_at_points(spark, d):
    """Streets that begin or end within 30 of a customer's place."""
    return graph.at_points(fx.streets(spark, d), fx.street_seeds(spark, d).withColumnRenamed("seed", "pid"), 30.0).select("pid", "u", "v")


@query(
    """, v AS (SELECT cls, CAST(round_even(d.z / 0.5, 0) AS BIGINT) bin, count(*) n FROM dsm d JOIN px USING (y, x) GROUP BY ALL),
    h AS MATERIALIZED (SELECT *, row_number() OVER o i, sum(n) OVER o w, sum(n * bin) OVER o s, sum(n * bin * bin) OVER o q FROM v WINDOW o AS (PARTITION BY cls ORDER BY bin)),
    e AS (SELECT cls, max(i) m, arg_max(w, i) w, arg_max(s, i) s, arg_max(q, i) q FROM h GROUP BY cls),
    c AS (SELECT e.cls, a.i i, b.i j, e.q - a.s * a.s / a.w::DOUBLE - (b.s - a.s) * (b.s - a.s) / (b.w - a.w)::DOUBLE - (e.s - b.s) * (e.s - b.s) / (e.w - b.w)::DOUBLE AS cost
        FROM e JOIN h a ON a.cls = e.cls JOIN h b ON b.cls = e.cls AND b.i > a.i AND b.i < e.m),
    b AS (SELECT cls, arg_min(i, cost) i, arg_min(j, cost) j FROM c GROUP BY cls)
    SELECT cls, CASE WHEN h.i <= b.i THEN 0 WHEN h.i <= b.j THEN 1 ELSE 2 END AS grp, min(bin) * 0.5::DOUBLE low, max(bin) * 0.5::DOUBLE high, round(sum(n * bin) / sum(n)::DOUBLE * 0.5::DOUBLE, 6) centre, CAST(sum(n) AS BIGINT) n
    FROM h JOIN b USING (cls) GROUP BY ALL""", "px", "dsm",
)
def height_divisions(spark, d):
    """The best three groups of heights of each class, to half a metre."""
    cells = fx.px(spark, d).select("cls", F.bround(40 + 60 * F.col("z"), 3).alias("z"))
    return groups.value_groups(cells, 3, 0.5, ("cls",)).withColumn("centre", F.round("centre", 6))
