"""Registered queries of the raster library over the fixtures, each beside the same query in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.functions import paths
from terrafold.model import EPSG_MTM8
from terrafold.operators import coords, detect, focal, graph, grid, halo, kernels, labels, mapalg, mesh, semantics, vector, zonal
from terrafold.plans import fixtures as fx
from terrafold.plans.registry import query

#: Codes of the fixture's part types.
DICTIONARY = {"BACKGROUND": 0, "UNKNOWN": 1, "PROM": 2, "ST": 3, "LARG": 4, "SM": 5}


# Map algebra

NDSM = "SELECT y, x, round_even(CASE WHEN a.z - b.z < 0 OR a.z - b.z > 25 THEN 0.0 ELSE a.z - b.z END, 3) z FROM dsm a JOIN dtm b USING (y, x)"


@query(NDSM, "dsm", "dtm")
def ndsm(spark, d):
    return mapalg.height_above_ground(fx.dsm(spark, d), fx.dtm(spark, d), 25.0)


@query("SELECT count(*) n, count(*) FILTER (a.z - b.z < 0) below, count(*) FILTER (a.z - b.z > 25) above FROM dsm a JOIN dtm b USING (y, x)", "dsm", "dtm")
def ndsm_clamp_report(spark, d):
    both = fx.dsm(spark, d).alias("a").join(fx.dtm(spark, d).alias("b"), ["y", "x"])
    diff = F.col("a.z") - F.col("b.z")
    return both.agg(F.count("*").alias("n"), F.count_if(diff < 0).alias("below"), F.count_if(diff > 25).alias("above"))


@query("SELECT y, x, (z - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END z FROM px, (SELECT min(z) lo, max(z) hi FROM px)", "px")
def normalize_minmax(spark, d):
    return mapalg.normalize(fx.px(spark, d)).select("y", "x", "z")


@query("SELECT y, x, cls, (z - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END z FROM px JOIN (SELECT cls, min(z) lo, max(z) hi FROM px GROUP BY cls) USING (cls)", "px")
def normalize_by_class(spark, d):
    return mapalg.normalize(fx.px(spark, d), by=["cls"]).select("y", "x", "cls", "z")


@query("SELECT y, x, greatest(0.0, least(1.0, z / 25.5)) z FROM dsm", "dsm")
def clip_rescale(spark, d):
    return fx.dsm(spark, d).withColumn("z", mapalg.clip_rescale(F.col("z"), 25.5))


@query("SELECT y, x, CAST(trunc((z - lo) / (hi - lo) * 255) AS INT) v FROM px, (SELECT min(z) lo, max(z) hi FROM px)", "px")
def to_uint8(spark, d):
    return mapalg.normalize(fx.px(spark, d)).select("y", "x", mapalg.to_uint8(F.col("z")).alias("v"))


@query("SELECT y, x, round_even(z, 3) z FROM px", "px")
def round_mm(spark, d):
    return fx.px(spark, d).select("y", "x", F.bround("z", 3).alias("z"))


@query("SELECT y, x, CAST(floor(z / 5) * 5 AS INT) v FROM dsm", "dsm")
def floor_to_step(spark, d):
    return fx.dsm(spark, d).select("y", "x", mapalg.floor_to(F.col("z"), 5).alias("v"))


@query(", q AS (SELECT y, x, round_even(z, 0) z FROM px), m AS (SELECT min(z) lo, count(*) n FROM q), s AS (SELECT count(*) k FROM q, m WHERE z = lo) SELECT y, x, z = lo AND k > CAST(trunc(n * 0.02) AS INT) masked FROM q, m, s", "px")
def nodata_mask(spark, d):
    return mapalg.nodata_mask(fx.px(spark, d).select("y", "x", F.bround("z", 0).alias("z"))).select("y", "x", "masked")


@query(", m AS (SELECT min(z) lo FROM dtm), s AS (SELECT min(z) hi FROM dtm, m WHERE z > lo) SELECT y, x, CASE WHEN z = lo THEN hi ELSE z END z, CASE WHEN z = lo THEN 0.0::DOUBLE ELSE 1.0 END valid FROM dtm, m, s", "dtm")
def dsm_fill_mask(spark, d):
    return mapalg.lifted_floor(fx.dtm(spark, d)).select("y", "x", "z", "valid")


@query("SELECT y, x, i AS cls, (CASE WHEN cls = i AND i <> 1 THEN 1.0::DOUBLE ELSE 0 END) + (CASE WHEN cls = 1 AND i <> 0 THEN 1.0::DOUBLE / 9 ELSE 0 END) share FROM px, range(0, 10) t(i)", "px")
def one_hot_unknown_spread(spark, d):
    hot = fx.px(spark, d).select("y", "x", F.posexplode(mapalg.one_hot(F.col("cls"), 10)).alias("cls", "share"))
    return hot.select("y", "x", F.col("cls").cast("long").alias("cls"), "share")


@query("SELECT y, x, [b, g, r, d] bands FROM (SELECT y, x, CAST(y % 256 AS INT) r, CAST(x % 256 AS INT) g, CAST((y + x) % 256 AS INT) b, cls d FROM px)", "px")
def channel_bgrd(spark, d):
    rgbd = fx.px(spark, d).select("y", "x", (F.col("y") % 256).alias("r"), (F.col("x") % 256).alias("g"), ((F.col("y") + F.col("x")) % 256).alias("b"), F.col("cls").alias("d"))
    return mapalg.channels(rgbd, "bgrd").select("y", "x", "bands")


# Coordinates


@query("SELECT y, x, round_even(ox + x * sx, 3) cx, round_even(oy + y * sy, 3) cy FROM px, geo", "px", "geo")
def pixel_to_coord(spark, d):
    return coords.pixel_to_coord(fx.px(spark, d).select("y", "x"), fx.geo(spark, d))


COORDS = ", p AS (SELECT pid, ox + (x - 100) / 10 AS cx, oy - y / 300 AS cy FROM points, geo) SELECT pid, CAST(trunc((cy - oy) / sy) AS INT) y, CAST(trunc((cx - ox) / sx) AS INT) x FROM p, geo"


def _moved_points(spark, d):
    g = fx.geo(spark, d)
    return fx.points(spark, d).select("pid", (F.lit(g.ox) + (F.col("x") - 100) / 10).alias("cx"), (F.lit(g.oy) - F.col("y") / 300).alias("cy"))


@query(COORDS, "points", "geo")
def coord_to_pixel_trunc(spark, d):
    return coords.coord_to_pixel(_moved_points(spark, d), fx.geo(spark, d)).select("pid", "y", "x")


@query(COORDS.replace("trunc(", "floor("), "points", "geo")
def coord_to_pixel_floor(spark, d):
    return coords.coord_to_pixel(_moved_points(spark, d), fx.geo(spark, d), floor=True).select("pid", "y", "x")


@query("SELECT round_even(ox + x * sx, 3) cx, round_even(oy + y * sy, 3) cy, z cz FROM dsm, geo", "dsm", "geo")
def to_xyz(spark, d):
    return coords.point_cloud(fx.dsm(spark, d), fx.geo(spark, d))


@query("SELECT ox + 12.5 ox, oy - 3.25 oy, h, w, min(z) z_min, max(z) z_max FROM geo, dsm GROUP BY ALL", "geo", "dsm")
def translate_meta(spark, d):
    g = fx.geo(spark, d).translated(12.5, -3.25)
    return fx.dsm(spark, d).agg(F.min("z").alias("z_min"), F.max("z").alias("z_max")).select(F.lit(g.ox).alias("ox"), F.lit(g.oy).alias("oy"), F.lit(g.h).alias("h"), F.lit(g.w).alias("w"), "z_min", "z_max")


@query("SELECT min(cx) minx, max(cx) maxx, min(cy) miny, max(cy) maxy, count(*) n FROM (SELECT round_even(ox + x * sx, 3) cx, round_even(oy + y * sy, 3) cy FROM px, geo)", "px", "geo")
def bbox_of_pixels(spark, d):
    return coords.pixel_to_coord(fx.px(spark, d), fx.geo(spark, d)).agg(F.min("cx").alias("minx"), F.max("cx").alias("maxx"), F.min("cy").alias("miny"), F.max("cy").alias("maxy"), F.count("*").alias("n"))


@query("SELECT pid, round((y - 120) * cos(radians(30)) - (x - 500) * sin(radians(30)) + 120, 6) ry, round((y - 120) * sin(radians(30)) + (x - 500) * cos(radians(30)) + 500, 6) rx FROM points", "points")
def rotate_points(spark, d):
    return coords.rotated(fx.points(spark, d), (120.0, 500.0), 30.0).select("pid", F.round("ry", 6).alias("ry"), F.round("rx", 6).alias("rx"))


@query("SELECT pid, CAST(trunc(sqrt((y - 120) * (y - 120) + (x - 500) * (x - 500))) AS INT) distance FROM points", "points")
def distance_to_point(spark, d):
    return fx.points(spark, d).select("pid", coords.distance(F.col("y"), F.col("x"), (120.0, 500.0)).alias("distance"))


@query("SELECT c_custkey pid, round(2 * h * tan(radians(f / 2)) / sqrt(1 + 1.5 * 1.5) * 0.3 / 2.0, 6) speed FROM (SELECT c_custkey, 60.0::DOUBLE + c_nationkey f, 40.0::DOUBLE + c_custkey % 80 h FROM customer)")
def airspeed(spark, d):
    c = fx.table(spark, d, "customer").select(F.col("c_custkey").alias("pid"), (F.lit(60.0) + F.col("c_nationkey")).alias("f"), (F.lit(40.0) + F.col("c_custkey") % 80).alias("h"))
    return c.select("pid", F.round(coords.airspeed(F.col("f"), F.lit(1.5), F.col("h")), 6).alias("speed"))


@query("SELECT y, x, CAST(trunc((z + 0.0005) / 0.03::DOUBLE) AS INT) + 4 px, CAST(trunc((z + 0.0005) / 0.03::DOUBLE) AS INT) * 0.03::DOUBLE h FROM dsm", "dsm")
def height_pixels(spark, d):
    px = coords.height_to_pixel(F.col("z") + F.lit(0.0005), 0.03, 4)
    return fx.dsm(spark, d).select("y", "x", px.alias("px"), coords.pixel_to_height(px, 0.03, 4).alias("h"))


@query()
def chord_lengths(spark, d):
    return zonal.area(fx.inst(spark, d), 1.0).select("label", coords.chord(F.col("area"), F.col("area") * 2).alias("chord"))


# Zones


@query("SELECT label, count(*) n, max(z) z_max, round_even(CAST(sum(CAST(z AS DECIMAL(20, 6))) AS DOUBLE) / count(*), 6) z_mean, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1 FROM inst JOIN dsm USING (y, x) WHERE label <> 0 GROUP BY label", "inst", "dsm")
def zonal_stats(spark, d):
    return zonal.zonal_stats(fx.inst(spark, d), fx.dsm(spark, d))


@query("SELECT label, min(y) y0, max(y) + 1 y1, min(x) x0, max(x) + 1 x1 FROM inst WHERE label <> 0 GROUP BY label", "inst")
def instance_bbox(spark, d):
    return zonal.bounds(fx.inst(spark, d), ["label"])


@query("SELECT label, round_even(count(*) * (0.02 * 0.02)::DOUBLE, 3) area FROM inst WHERE label <> 0 GROUP BY label", "inst")
def instance_area_m2(spark, d):
    return zonal.area(fx.inst(spark, d), 0.02)


@query(", r AS (SELECT label, list_sort(list(y))[count(*) // 2 + 1] y FROM inst WHERE label <> 0 GROUP BY label) SELECT label, y, list_sort(list(x))[count(*) // 2 + 1] x FROM inst JOIN r USING (label, y) GROUP BY label, y", "inst")
def label_centers_upper_median(spark, d):
    return zonal.centers(fx.inst(spark, d))


@query(", t AS (SELECT label FROM inst JOIN px USING (y, x) WHERE label <> 0 GROUP BY label HAVING max(z) >= 0.35) SELECT y, x, CASE WHEN label IN (SELECT label FROM t) THEN label ELSE 0 END label FROM inst", "inst", "px")
def remove_instances_below(spark, d):
    return zonal.without_low(fx.inst(spark, d), fx.px(spark, d), 0.35)


@query("SELECT cls, count(*)::DOUBLE / sum(count(*)) OVER () weight FROM px GROUP BY cls", "px")
def class_weights_micro(spark, d):
    return zonal.class_weights(fx.px(spark, d))


@query(", c AS (SELECT y // 25 t, CASE WHEN z > 0.1 THEN cls ELSE 0 END cls, count(*) n FROM px GROUP BY ALL) SELECT cls, round(sum(n::DOUBLE / a) / (SELECT count(DISTINCT t) FROM c), 9) weight FROM c JOIN (SELECT t, sum(n) a FROM c GROUP BY t) USING (t) GROUP BY cls", "px")
def class_weights_macro(spark, d):
    p = fx.px(spark, d).select(F.floor(F.col("y") / 25).alias("tile"), F.when(F.col("z") > 0.1, F.col("cls")).otherwise(0).alias("cls"))
    return zonal.class_weights(p, "tile").withColumn("weight", F.round("weight", 9))


@query(", w AS (SELECT cls, count(*)::DOUBLE / sum(count(*)) OVER () weight FROM px GROUP BY cls) SELECT cls, round((CASE WHEN cls = 1 THEN 0 ELSE weight END) + (CASE WHEN cls = 0 THEN 0 ELSE (SELECT weight FROM w WHERE cls = 1) / 9 END), 9) weight FROM w", "px")
def rebalance_unknown(spark, d):
    return zonal.spread_unknown(zonal.class_weights(fx.px(spark, d)), 10).withColumn("weight", F.round("weight", 9))


@query("SELECT count(*) FILTER (z > 0.1 AND cls < 5)::DOUBLE / count(*) FILTER (z > 0.1 OR cls < 5) iou FROM px", "px")
def iou_masks(spark, d):
    p = fx.px(spark, d)
    return zonal.mask_iou(p.where("z > 0.1"), p.where("cls < 5"))


@query(", a AS (SELECT * FROM inst WHERE label <> 0), b AS (SELECT y, x + 3 x, label FROM a WHERE x < 61) SELECT a.label label_a, b.label label_b, count(*)::DOUBLE / (any_value(na) + any_value(nb) - count(*)) iou FROM a JOIN b USING (y, x) JOIN (SELECT label, count(*) na FROM a GROUP BY label) ca ON ca.label = a.label JOIN (SELECT label, count(*) nb FROM b GROUP BY label) cb ON cb.label = b.label GROUP BY a.label, b.label", "inst")
def iou_pairs_masks(spark, d):
    a = fx.inst(spark, d)
    return zonal.label_iou(a, a.where("label <> 0 and x < 61").withColumn("x", F.col("x") + 3))


@query("SELECT round((sum(t * p) + 1) / (sum(t) + sum(p) - sum(t * p) + 1), 9) jaccard FROM (SELECT CASE WHEN z > 0.1 THEN 1.0::DOUBLE ELSE 0 END t, greatest(0.0, least(1.0, z + 0.5)) p FROM px)", "px")
def jaccard_soft(spark, d):
    p = fx.px(spark, d).select(F.when(F.col("z") > 0.1, 1.0).otherwise(0.0).alias("t"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("z") + 0.5)).alias("p"))
    return zonal.soft_jaccard(p, "t", "p").select(F.round("jaccard", 9).alias("jaccard"))


@query(", v AS (SELECT cls t, CASE WHEN z > 0.1 THEN (cls + 1) % 10 ELSE cls END p FROM px), c AS (SELECT i cls, count(*) FILTER (t = i) nt, count(*) FILTER (p = i) np, count(*) FILTER (t = i AND p = i) ni FROM v, range(0, 10) r(i) GROUP BY i), w AS (SELECT cls, count(*)::DOUBLE / sum(count(*)) OVER () weight FROM px GROUP BY cls) SELECT round(sum(weight * (ni + 1) / (nt + np - ni + 1)) / sum(weight), 9) mean_iou FROM w JOIN c USING (cls) WHERE cls <> 0", "px")
def weighted_mean_iou(spark, d):
    p = fx.px(spark, d).select(F.col("cls").alias("t"), F.when(F.col("z") > 0.1, (F.col("cls") + 1) % 10).otherwise(F.col("cls")).alias("p"))
    return zonal.weighted_mean_iou(p, "t", "p", zonal.class_weights(fx.px(spark, d)), True).select(F.round("mean_iou", 9).alias("mean_iou"))


# Labels

SPARSE = "(SELECT y, x, CASE WHEN label % 3 = 0 THEN 0 ELSE label * 7 END label FROM inst)"


def _sparse(spark, d):
    return fx.inst(spark, d).withColumn("label", F.when(F.col("label") % 3 == 0, 0).otherwise(F.col("label") * 7))


@query(f", s AS {SPARSE}, r AS (SELECT label, row_number() OVER (ORDER BY label) k FROM (SELECT DISTINCT label FROM s WHERE label <> 0)) SELECT y, x, CAST(coalesce(k, 0) AS INT) label FROM s LEFT JOIN r USING (label)", "inst")
def relabel_dense(spark, d):
    return labels.relabel(_sparse(spark, d))


@query("SELECT y, x, CASE label WHEN 1 THEN 2 WHEN 2 THEN 1 WHEN 5 THEN 0 ELSE label END label FROM inst", "inst")
def replace_values(spark, d):
    return labels.replace_values(fx.inst(spark, d), [1, 2, 5, 1], [2, 1, 0, 9])


def _stacked(axis: str, size: str) -> str:
    y, x = (f"y + {size}", "x") if axis == "y" else ("y", f"x + {size}")
    return f", u AS (SELECT y, x, label FROM inst UNION ALL SELECT {y}, {x}, CASE WHEN label <> 0 THEN label + (SELECT max(label) FROM inst) ELSE 0 END FROM inst), r AS (SELECT label, row_number() OVER (ORDER BY label) k FROM (SELECT DISTINCT label FROM u WHERE label <> 0)) SELECT y, x, CAST(coalesce(k, 0) AS INT) label FROM u LEFT JOIN r USING (label)"


@query(_stacked("y", "(SELECT h FROM geo)"), "inst", "geo")
def stack_vertical(spark, d):
    return labels.stack(fx.inst(spark, d), fx.inst(spark, d), fx.geo(spark, d).h, "y")


@query(_stacked("x", "64"), "inst")
def stack_horizontal(spark, d):
    return labels.stack(fx.inst(spark, d), fx.inst(spark, d), 64, "x")


EDGE = "SELECT DISTINCT label FROM inst, geo WHERE label <> 0 AND (y < 4 OR y >= h - 4 OR x < 4 OR x >= w - 4)"


@query(EDGE, "inst", "geo")
def border_instances(spark, d):
    g = fx.geo(spark, d)
    return labels.border_labels(fx.inst(spark, d), g.h, g.w, 4)


@query(f"SELECT label, count(*) n FROM inst WHERE label <> 0 AND label NOT IN ({EDGE}) GROUP BY label", "inst", "geo")
def inside_instances(spark, d):
    g = fx.geo(spark, d)
    return labels.split_by_border(fx.inst(spark, d), g.h, g.w, 4)[1].groupBy("label").agg(F.count("*").alias("n"))


@query(", f AS (SELECT * FROM inst WHERE label <> 0) SELECT DISTINCT least(a.label, b.label) label_a, greatest(a.label, b.label) label_b FROM f a JOIN f b ON abs(a.y - b.y) + abs(a.x - b.x) = 1 AND b.y BETWEEN a.y - 1 AND a.y + 1 WHERE a.label <> b.label", "inst")
def touching_pairs(spark, d):
    g = fx.geo(spark, d)
    return labels.touching(fx.inst(spark, d), g.h, g.w)


SHIFTED = ", b AS (SELECT y + 6 y, x, label FROM inst WHERE y + 6 < (SELECT h FROM geo))"


def _shifted(spark, d):
    g = fx.geo(spark, d)
    return fx.inst(spark, d).withColumn("y", F.col("y") + 6).where(F.col("y") < g.h)


@query(SHIFTED + " SELECT a.label label_a, b.label label_b, count(*) n FROM inst a JOIN b USING (y, x) WHERE a.label <> 0 AND b.label <> 0 GROUP BY ALL", "inst", "geo")
def overlap_pairs(spark, d):
    return labels.overlapping(fx.inst(spark, d), _shifted(spark, d))


@query(SHIFTED + ", s AS (SELECT * FROM inst WHERE y % 4 = 0 AND x % 4 = 0 AND label <> 0), t AS (SELECT * FROM b WHERE y % 4 = 0 AND x % 4 = 0 AND label <> 0), k AS (SELECT s.label label_a, t.label label_b, count(*) n FROM s JOIN t USING (y, x) GROUP BY ALL) SELECT label_a, label_b FROM k JOIN (SELECT label label_a, count(*) na FROM s GROUP BY label) USING (label_a) JOIN (SELECT label label_b, count(*) nb FROM t GROUP BY label) USING (label_b) WHERE n >= least(na, nb) * 0.3::DOUBLE", "inst", "geo")
def mask_inside_pairs(spark, d):
    return labels.inside_pairs(fx.inst(spark, d), _shifted(spark, d), ratio=0.3)


@query(", hit AS MATERIALIZED (SELECT DISTINCT label FROM inst JOIN px USING (y, x) WHERE z > 0.4 AND label <> 0) SELECT y, x, label FROM inst WHERE label <> 0 AND label NOT IN (SELECT label FROM hit)", "inst", "px")
def reject_overlap_anti(spark, d):
    return labels.clip_to(fx.inst(spark, d), fx.px(spark, d).where("z > 0.4"))


# Semantics

FIRST_POINT = "SELECT label, arg_min(code, row_id) code FROM pts JOIN inst USING (y, x) WHERE label <> 0 GROUP BY label"


def _int_code(c: str) -> str:
    short = lambda k: "CASE " + " ".join(f"WHEN substr(upper({c}), 1, {k}) = '{n}' THEN {v}" for n, v in DICTIONARY.items()) + " END"
    return f"coalesce({short(4)}, {short(2)}, 1)"


@query(FIRST_POINT, "pts", "inst")
def points_to_instances(spark, d):
    return semantics.points_to_instances(fx.pts(spark, d), fx.inst(spark, d))


@query(f", p AS ({FIRST_POINT}) SELECT y, x, CASE WHEN label = 0 THEN 0 ELSE coalesce({_int_code('code')}, 1) END cls FROM inst LEFT JOIN p USING (label)", "pts", "inst")
def semantic_raster(spark, d):
    i = fx.inst(spark, d)
    return semantics.semantic_raster(i, semantics.points_to_instances(fx.pts(spark, d), i), DICTIONARY)


@query(f"SELECT p_type, {_int_code('p_type')} int_code FROM (SELECT DISTINCT p_type FROM part)")
def semantic_intcode(spark, d):
    return fx.table(spark, d, "part").select("p_type").distinct().withColumn("int_code", semantics.int_code(F.col("p_type"), DICTIONARY))


COUNTS = f", n AS (SELECT cls, CASE WHEN cls <= 1 THEN 0 ELSE count(code) END n FROM range(0, 6) r(cls) LEFT JOIN (SELECT {_int_code('code')} cls, code FROM pts) USING (cls) GROUP BY cls)"


@query(COUNTS + " SELECT CAST(cls AS INT) cls, n FROM n", "pts")
def semantic_count(spark, d):
    return semantics.counts(fx.pts(spark, d), DICTIONARY)


@query(COUNTS + " SELECT CAST(cls AS INT) cls, n::DOUBLE / sum(n) OVER () share FROM n", "pts")
def semantic_distribution(spark, d):
    return semantics.distribution(semantics.counts(fx.pts(spark, d), DICTIONARY))


@query(COUNTS + ", s AS (SELECT cls, n::DOUBLE / sum(n) OVER () s FROM n), w AS (SELECT cls, CASE WHEN s <> 0 THEN 2 * (SELECT max(s) FROM s) - s ELSE 0 END w FROM s) SELECT CAST(cls AS INT) cls, round(w / sum(w) OVER (), 9) share FROM w", "pts")
def augmentation_distribution(spark, d):
    return semantics.augmentation(semantics.distribution(semantics.counts(fx.pts(spark, d), DICTIONARY))).withColumn("share", F.round("share", 9))


@query("SELECT y, x, cls * 10 cls FROM px WHERE cls IN (1, 2, 3)", "px")
def remap_classes(spark, d):
    return detect.remap(fx.px(spark, d).select("y", "x", "cls"), {1: 10, 2: 20, 3: 30, 4: -1})


SPLIT = "CASE WHEN ('0x' || substr(md5('7:' || {k}), 1, 8))::BIGINT % 1000000 < 800000 THEN 'train' ELSE 'val' END part"


@query("SELECT name, prefix, " + SPLIT.format(k="name") + " FROM manifest", "manifest")
def split_dataset_hash(spark, d):
    return semantics.split_by_hash(fx.manifest(spark, d), "name", seed=7)


@query("SELECT name, prefix, " + SPLIT.format(k="prefix") + " FROM manifest", "manifest")
def split_dataset_safe_hash(spark, d):
    return semantics.split_by_hash(fx.manifest(spark, d), "prefix", seed=7)


EXACT = ", k AS (SELECT k, row_number() OVER (ORDER BY ('0x' || substr(md5('7:' || k), 1, 15))::BIGINT) rn, count(*) OVER () n FROM (SELECT DISTINCT {k} k FROM manifest)) SELECT name, prefix, CASE WHEN rn <= CAST(floor(0.8 * n) AS BIGINT) THEN 'train' ELSE 'val' END part FROM manifest JOIN k ON k.k = {k}"


@query(EXACT.format(k="name"), "manifest")
def split_dataset_exact(spark, d):
    return semantics.split_exactly(fx.manifest(spark, d), "name", seed=7)


@query(EXACT.format(k="prefix"), "manifest")
def split_dataset_safe_exact(spark, d):
    return semantics.split_exactly(fx.manifest(spark, d), "prefix", seed=7)


@query("SELECT prefix, list_sort(list(name))[CAST(trunc(0.5 * count(*)) AS INT) + 1] AS name FROM manifest GROUP BY prefix", "manifest")
def instance_percentile_pick(spark, d):
    return semantics.percentile_pick(fx.manifest(spark, d), "prefix", "name", 0.5)


# Windows in two dimensions


@query(", q AS (SELECT *, h // 2 hh FROM px, geo) SELECT CAST((y // hh) * 2 + x // 32 AS INT) quadrant, CAST(y % hh AS INT) y, CAST(x % 32 AS INT) x, z FROM q WHERE y < 2 * hh", "px", "geo")
def split_four(spark, d):
    g = fx.geo(spark, d)
    return grid.split_four(fx.px(spark, d).drop("cls"), g.h, g.w)


@query(", g AS (SELECT h, h // 2 hh FROM geo), s AS (SELECT 'top' side, 0 y0, 16 x0 UNION ALL SELECT 'left', CAST(hh // 2 AS INT), 0 FROM g UNION ALL SELECT 'bottom', CAST(h - hh AS INT), 16 FROM g UNION ALL SELECT 'right', CAST(hh // 2 AS INT), 32 FROM g) SELECT side, y - y0 y, x - x0 x, z FROM px, s, g WHERE y >= y0 AND y < y0 + hh AND x >= x0 AND x < x0 + 32", "px", "geo")
def split_star(spark, d):
    g = fx.geo(spark, d)
    return grid.split_star(fx.px(spark, d).drop("cls"), g.h, g.w)


@query("SELECT CAST(y - (h - 40) // 2 AS INT) y, x - 16 x, z FROM px, geo WHERE y >= (h - 40) // 2 AND y < (h - 40) // 2 + 40 AND x >= 16 AND x < 48", "px", "geo")
def center_crop(spark, d):
    g = fx.geo(spark, d)
    return grid.center_crop(fx.px(spark, d).drop("cls"), g.h, g.w, 40, 32)


@query(", n AS (SELECT 1 + CAST(ceil((h - 32) / 24.0) AS INT) ny FROM geo), s AS (SELECT i * CAST(trunc((h - 32)::DOUBLE / (ny - 1)) AS INT) py FROM geo, n, range(0, 1000) r(i) WHERE i < ny), t AS (SELECT j * 16 px FROM range(0, 3) r(j)) SELECT CAST(py AS INT) py, CAST(t.px AS INT) AS px, count(*) n, max(z) z_max FROM px p JOIN s ON y >= py AND y < py + 32 JOIN t ON x >= t.px AND x < t.px + 32 GROUP BY ALL", "px", "geo")
def sliding_patches(spark, d):
    g = fx.geo(spark, d)
    return grid.sliding_patches(fx.px(spark, d), g.h, g.w, 32).groupBy("py", "px").agg(F.count("*").alias("n"), F.max("z").alias("z_max"))


@query("SELECT y // 50 ty, x // 50 tx, sum(a) / 2500 / (SELECT max(a) FROM alpha)::DOUBLE ratio FROM alpha GROUP BY ALL", "alpha")
def tile_valid_ratio(spark, d):
    return grid.tile_valid_ratio(fx.alpha(spark, d), 50)


GRID = (
    ", f AS (SELECT *, floor(ox / 0.2::DOUBLE) * 0.2::DOUBLE x, floor(oy / 0.2::DOUBLE) * 0.2::DOUBLE y FROM geo), s AS (SELECT h, w, ox, oy, x + CASE WHEN x < ox THEN 0.2::DOUBLE ELSE 0 END fx, y - CASE WHEN y > oy THEN 0.2::DOUBLE ELSE 0 END fy, "
    "CAST(floor(w * 0.02::DOUBLE / 0.2::DOUBLE) AS INT) + 1 nx, CAST(floor(h * 0.02::DOUBLE / 0.2::DOUBLE) AS INT) + 1 ny FROM f), "
    "t AS (SELECT h, w, CAST(i * ny + j AS BIGINT) tile, fx + i * 0.2::DOUBLE cx, fy - j * 0.2::DOUBLE cy, ox, oy FROM s, range(0, 100) a(i), range(0, 100000) b(j) WHERE i < nx AND j < ny), "
    "p AS (SELECT tile, cx, cy, h, w, CAST(round_even((cy - oy) / -0.02::DOUBLE, 0) AS INT) y0, CAST(round_even((cx - ox) / 0.02::DOUBLE, 0) AS INT) x0 FROM t), q AS MATERIALIZED (SELECT *, y0 + 10 y1, x0 + 10 x1 FROM p WHERE y0 >= 0 AND x0 >= 0 AND y0 + 10 <= h AND x0 + 10 <= w) "
)


@query(
    GRID + "SELECT y0, x0, tile, cx, cy, y1, x1, count(*) n, max(z) z_max FROM q JOIN px ON y BETWEEN y0 AND y1 - 1 AND x BETWEEN x0 AND x1 - 1 GROUP BY ALL",
    "px", "geo",
)
def tile_grid(spark, d):
    """Tiles of the raster with the pixels in each."""
    g = fx.geo(spark, d)
    tiles = grid.tile_grid(spark, g, 0.2)
    p = fx.px(spark, d)
    step = 10
    # starts are snapped to one lattice, so a pixel's tile follows from the first one's offset
    first = tiles.agg(F.min("y0").alias("_fy"), F.min("x0").alias("_fx"))
    keyed = p.crossJoin(F.broadcast(first)).withColumns({"y0": (F.floor((F.col("y") - F.col("_fy")) / step) * step + F.col("_fy")).cast("int"), "x0": (F.floor((F.col("x") - F.col("_fx")) / step) * step + F.col("_fx")).cast("int")})
    return tiles.join(keyed.groupBy("y0", "x0").agg(F.count("*").alias("n"), F.max("z").alias("z_max")), ["y0", "x0"])


@query(", b AS (SELECT y, x FROM alpha WHERE a = 0), t AS (SELECT DISTINCT (y // 25) * 4 + x // 16 tile, (y // 25) * 25 + 12 y, (x // 16) * 16 + 8 x FROM px) SELECT tile, t.y, t.x, min(CASE WHEN sqrt((t.y - b.y) * (t.y - b.y) + (t.x - b.x) * (t.x - b.x)) <= 16 THEN sqrt((t.y - b.y) * (t.y - b.y) + (t.x - b.x) * (t.x - b.x)) END) distance FROM t, b GROUP BY ALL", "px", "alpha")
def tile_border_distance(spark, d):
    ty, tx = F.floor(F.col("y") / 25), F.floor(F.col("x") / 16)
    tiles = fx.px(spark, d).select((ty * 4 + tx).alias("tile"), (ty * 25 + 12).alias("y"), (tx * 16 + 8).alias("x")).distinct()
    return grid.nearest_border(tiles, fx.alpha(spark, d).where("a = 0"), 16)


@query(", t AS (SELECT cls seq, (cls * 3) % 7 oy, cls ox, y, x, z FROM px) SELECT y + oy y, x + ox x, arg_max(z, seq) z FROM t GROUP BY ALL", "px")
def mosaic_last_wins(spark, d):
    t = fx.px(spark, d).select(F.col("cls").alias("seq"), (F.col("cls") * 3 % 7).alias("oy"), F.col("cls").alias("ox"), "y", "x", "z")
    # tiles of one class never overlap themselves at the same offset
    return grid.mosaic(t)


@query("SELECT y, x, coalesce(z, 0.0) z FROM (SELECT CAST(i AS INT) y, CAST(j AS INT) x FROM geo, range(0, 1000000) a(i), range(0, 64) b(j) WHERE i < h) LEFT JOIN (SELECT * FROM px WHERE z > 0.2) USING (y, x)", "px", "geo")
def dense_fill(spark, d):
    return grid.dense(fx.px(spark, d).where("z > 0.2"), fx.geo(spark, d).h, 64)


@query("SELECT CAST(y // 4 AS INT) y, CAST(x // 4 AS INT) x, z FROM px WHERE y % 4 = 0 AND x % 4 = 0", "px")
def downsample(spark, d):
    return grid.downsample(fx.px(spark, d).drop("cls"), 4)


@query("SELECT CAST(y * 2 + i AS INT) y, CAST(x * 2 + j AS INT) x, z FROM px, range(0, 2) a(i), range(0, 2) b(j)", "px")
def upscale_nn(spark, d):
    return grid.upscale(fx.px(spark, d).drop("cls"), 2)


@query(", t AS (SELECT CAST(i AS INT) y, CAST(j AS INT) x, CAST(i * h // 90 AS INT) sy, CAST(j * 64 // 50 AS INT) sx FROM geo, range(0, 90) a(i), range(0, 50) b(j)) SELECT t.y, t.x, z FROM t JOIN px p ON p.y = sy AND p.x = sx", "px", "geo")
def resize_nn(spark, d):
    g = fx.geo(spark, d)
    return grid.resize_nearest(fx.px(spark, d).drop("cls"), g.h, g.w, 90, 50)


@query("SELECT CAST(h - 1 - y AS INT) y, x, z FROM px, geo", "px", "geo")
def flip(spark, d):
    g = fx.geo(spark, d)
    return grid.flip(fx.px(spark, d).drop("cls"), g.h, g.w)


@query(", p AS (SELECT CAST(trunc(h * 0.1) AS INT) ph, 6 pw, h FROM geo), t AS (SELECT CAST(i AS INT) y, CAST(j AS INT) x, i * (h + 2 * ph) // h - ph sy, j * 76 // 64 - pw sx FROM p, range(0, 100000) a(i), range(0, 64) b(j) WHERE i < h) SELECT t.y, t.x FROM t JOIN px q ON q.y = sy AND q.x = sx WHERE z > 0.1", "px", "geo")
def shrink_mask(spark, d):
    g = fx.geo(spark, d)
    return grid.shrink(fx.px(spark, d).where("z > 0.1").select("y", "x"), g.h, g.w)


@query("SELECT CAST(y + 60 - h // 2 AS INT) y, x + 10 - 32 x, z FROM px, geo WHERE y + 60 - h // 2 BETWEEN 0 AND 119 AND x + 10 - 32 BETWEEN 0 AND 119", "px", "geo")
def pad_place(spark, d):
    g = fx.geo(spark, d)
    return grid.pad_place(fx.px(spark, d).drop("cls"), g.h, g.w, 60, 10, 120)


@query(", p AS (SELECT CAST(trunc((i + 1) * (h / 6.0)) AS INT) py, 32 px FROM geo, range(0, 5) r(i)) SELECT DISTINCT py, px, z FROM (SELECT py, px FROM p UNION ALL SELECT CAST(h // 2 AS INT), 32 FROM geo) s JOIN px q ON q.y = py AND q.x = s.px", "px", "geo")
def sample_grid_points(spark, d):
    g = fx.geo(spark, d)
    at = grid.sample_points(spark, g.h, g.w, 5)
    return at.join(fx.px(spark, d).select(F.col("y").alias("py"), F.col("x").alias("px"), "z"), ["py", "px"])


# Neighbourhoods

GROW = ", m AS (SELECT y, x FROM px WHERE z > 0.3), g AS (SELECT DISTINCT y + dy y, x + dx x FROM m, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), geo WHERE y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 63)"


@query(GROW + " SELECT y, x FROM g", "px", "geo")
def dilate_disk1(spark, d):
    g = fx.geo(spark, d)
    return focal.dilate(fx.px(spark, d).where("z > 0.3").select("y", "x"), g.h, g.w)


@query(", m AS (SELECT y, x FROM px WHERE z > -0.1), b AS (SELECT y, x FROM px WHERE NOT z > -0.1) SELECT y, x FROM m WHERE NOT EXISTS (SELECT 1 FROM b WHERE abs(b.y - m.y) + abs(b.x - m.x) = 1)", "px")
def erode_disk1(spark, d):
    g = fx.geo(spark, d)
    return focal.erode(fx.px(spark, d).where("z > -0.1").select("y", "x"), g.h, g.w)


@query("SELECT a.y, a.x, max(b.z) z FROM px a JOIN px b ON b.y BETWEEN a.y - 1 AND a.y + 1 AND b.x BETWEEN a.x - 1 AND a.x + 1 GROUP BY ALL", "px")
def focal_max_3(spark, d):
    return focal.focal_max(fx.px(spark, d))


@query("SELECT y, x, quantile_cont(z, 0.5) OVER (PARTITION BY x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) z FROM px", "px")
def column_median_5(spark, d):
    return focal.column_median(fx.px(spark, d))


RIM = ", ms AS (SELECT y // 4 y, x // 4 x FROM {mask}), mn AS (SELECT CAST(ceil(h / 4.0) AS INT) sh, 16 sw FROM geo), mg AS (SELECT DISTINCT y + dy y, x + dx x FROM ms, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(dy, dx), mn WHERE y + dy BETWEEN 0 AND sh - 1 AND x + dx BETWEEN 0 AND sw - 1), mr AS (SELECT * FROM mg EXCEPT SELECT * FROM ms), mf AS (SELECT i y, j x FROM mn, range(0, 100000) a(i), range(0, 16) b(j) WHERE i < sh AND (i = 0 OR i = sh - 1 OR j = 0 OR j = 15))"


@query(RIM.format(mask="px WHERE y % 4 = 0 AND x % 4 = 0 AND z > 0.1") + " SELECT CAST(y * 4 + 1 AS INT) y, CAST(x * 4 + 1 AS INT) x FROM (SELECT * FROM mr UNION SELECT * FROM mf)", "px", "geo")
def border_coords(spark, d):
    g = fx.geo(spark, d)
    return focal.border_coords(fx.px(spark, d).where("z > 0.1"), g.h, g.w, 4)


# Detections


@query("SELECT image, det_id, score FROM det WHERE score >= 0.5", "det")
def detections_filter(spark, d):
    return detect.strong(fx.det(spark, d)).select("image", "det_id", "score")


@query("SELECT image, det_id, CAST(row_number() OVER (PARTITION BY image ORDER BY score DESC, det_id) AS INT) AS rank FROM det QUALIFY rank <= 3", "det")
def detections_topk_per_image(spark, d):
    return detect.top_boxes(fx.det(spark, d), 3).select("image", "det_id", "rank")


@query(", p AS (SELECT a.image, a.det_id a, b.det_id b, least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) iw, least(a.ymax, b.ymax) - greatest(a.ymin, b.ymin) ih, (a.xmax - a.xmin) * (a.ymax - a.ymin) + (b.xmax - b.xmin) * (b.ymax - b.ymin) s FROM det a JOIN det b ON a.image = b.image AND a.det_id < b.det_id) SELECT image, a, b, round_even(iw * ih / (s - iw * ih), 6) iou FROM p WHERE iw > 0 AND ih > 0", "det")
def box_iou_pairs(spark, d):
    return detect.iou_pairs(fx.det(spark, d), None)


#: Boxes of an image one by one, the best first; kept holds those that stay.
GREEDY = """, o AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY score DESC, det_id) rn FROM det),
  r AS (SELECT image, 1::BIGINT k, [{'id': det_id, 'score': score, 'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax}] kept FROM o WHERE rn = 1
    UNION ALL SELECT r.image, r.k + 1, CASE WHEN len(list_filter(r.kept, lambda q: greatest(0, least(q.x1, xmax) - greatest(q.x0, xmin)) * greatest(0, least(q.y1, ymax) - greatest(q.y0, ymin))
        >= 0.5 * ((xmax - xmin) * (ymax - ymin) + (q.x1 - q.x0) * (q.y1 - q.y0) - greatest(0, least(q.x1, xmax) - greatest(q.x0, xmin)) * greatest(0, least(q.y1, ymax) - greatest(q.y0, ymin))))) > 0
      THEN r.kept ELSE list_append(r.kept, {'id': det_id, 'score': score, 'x0': xmin, 'y0': ymin, 'x1': xmax, 'y1': ymax}) END
    FROM r JOIN o ON o.image = r.image AND o.rn = r.k + 1),
  f AS (SELECT image, unnest(arg_max(kept, k)) q FROM r GROUP BY image) SELECT image, q.id det_id, q.score score FROM f"""


@query(GREEDY, "det")
def nms_greedy(spark, d):
    return detect.suppress(fx.det(spark, d)).select("image", "det_id", "score")


MASKS = """, m AS (SELECT DISTINCT image, det_id mask, gy y, gx x FROM det, range(0, 16) a(gy), range(0, 16) b(gx) WHERE gy BETWEEN floor(ymin / 10) AND floor(ymax / 10) AND gx BETWEEN floor(xmin / 10) AND floor(xmax / 10)),
  s AS (SELECT image, mask, count(*) n FROM m GROUP BY 1, 2),
  p AS MATERIALIZED (SELECT a.image, a.mask a, b.mask b, count(*) met FROM m a JOIN m b ON a.image = b.image AND a.y = b.y AND a.x = b.x AND a.mask < b.mask GROUP BY 1, 2, 3),
  e AS MATERIALIZED (SELECT p.image, a, b FROM p JOIN s sa ON sa.image = p.image AND sa.mask = a JOIN s sb ON sb.image = p.image AND sb.mask = b WHERE met >= 0.4 * (sa.n + sb.n - met)),
  w AS MATERIALIZED (SELECT image, a l, list(b) ls FROM (SELECT image, a, b FROM e UNION ALL SELECT image, b, a FROM e) GROUP BY 1, 2),
  o AS MATERIALIZED (SELECT det.image, det_id, score, coalesce(ls, []) ls, row_number() OVER (PARTITION BY det.image ORDER BY score DESC, det_id) rn FROM det LEFT JOIN w ON w.image = det.image AND l = det_id),
  r AS (SELECT image, 1::BIGINT k, [det_id] kept FROM o WHERE rn = 1
    UNION ALL SELECT r.image, r.k + 1, CASE WHEN list_has_any(r.kept, ls) THEN r.kept ELSE list_append(r.kept, det_id) END FROM r JOIN o ON o.image = r.image AND o.rn = r.k + 1)
  SELECT image, unnest(arg_max(kept, k)) mask FROM r GROUP BY image"""


@query(MASKS, "det")
def nms_masks(spark, d):
    """Masks are the cells of ten pixels that the boxes touch."""
    b = fx.det(spark, d)
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / 10), F.floor(F.col(hi) / 10))
    cells = F.flatten(F.transform(span("ymin", "ymax"), lambda y: F.transform(span("xmin", "xmax"), lambda x: detect.cell_of(y, x))))
    return detect.suppress_cells(b.select("image", F.col("det_id").alias("mask"), "score", cells.alias("cells")), 0.4).select("image", "mask")


@query("SELECT image, (image % 7) || ' ' || printf('%.3f', xmin / 199) || ' ' || printf('%.3f', ymin / 199) || ' ' || printf('%.3f', xmax / 199) || ' ' || printf('%.3f', ymax / 199) AS line FROM det", "det")
def label_lines(spark, d):
    b = fx.det(spark, d)
    corner = lambda y, x: F.struct(F.col(y).alias("y"), F.col(x).alias("x"))
    return detect.label_lines(b.select("image", (F.col("image") % 7).alias("cls"), F.array(corner("ymin", "xmin"), corner("ymax", "xmax")).alias("contour")), 200)


# Polygons and graphs

SIDES = ", s AS (SELECT poly, idx, x x1, y y1, coalesce(lead(x) OVER w, first_value(x) OVER w) x2, coalesce(lead(y) OVER w, first_value(y) OVER w) y2 FROM verts WINDOW w AS (PARTITION BY poly ORDER BY idx))"


@query(SIDES + " SELECT poly, round_even(abs(sum(x1 * y2 - x2 * y1)) / 2, 6) area FROM s GROUP BY poly", "verts")
def polygon_area(spark, d):
    return vector.area(fx.verts(spark, d))


@query(SIDES + " SELECT poly, round_even(sum(sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1))), 6) perimeter FROM s GROUP BY poly", "verts")
def polygon_perimeter(spark, d):
    return vector.perimeter(fx.verts(spark, d))


@query(SIDES + " SELECT poly, pid FROM s JOIN points p ON (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY poly, pid HAVING count(*) % 2 = 1", "verts", "points")
def points_in_polygon(spark, d):
    return vector.points_inside(fx.verts(spark, d), fx.points(spark, d), 10.0)


@query("SELECT DISTINCT least(u, v) a, greatest(u, v) b FROM edges", "edges")
def edge_canonical(spark, d):
    return graph.canonical(fx.edges(spark, d))


@query(", r(n, d) AS (SELECT 0, 0 UNION SELECT v, d + 1 FROM r JOIN edges ON n = u WHERE d < 4) SELECT n AS node, min(d) AS depth FROM r GROUP BY n", "edges")
def bfs_depth_n(spark, d):
    return graph.bfs(fx.edges(spark, d), 0, 4)


@query("SELECT u, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || (CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS uuid FROM (SELECT u, sha256('[' || string_agg(v::VARCHAR, ', ' ORDER BY v) || ']') h FROM edges GROUP BY u)", "edges")
def path_uuid(spark, d):
    return fx.edges(spark, d).groupBy("u").agg(F.collect_list("v").alias("_v")).select("u", graph.path_uuid(F.col("_v")).alias("uuid"))


UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-4' || substr(h, 14, 3) || '-' || (CASE WHEN substr(h, 17, 1) IN ('0', '4', '8', 'c') THEN '8' WHEN substr(h, 17, 1) IN ('1', '5', '9', 'd') THEN '9' WHEN substr(h, 17, 1) IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END) || substr(h, 18, 3) || '-' || substr(h, 21, 12)"


@query(
    ", w(p, done) AS (SELECT [u, v], false FROM edges WHERE u = 1 AND v <> 1 UNION ALL SELECT CASE WHEN v = 1 THEN p ELSE list_append(p, v) END, v = 1 FROM w JOIN edges ON u = p[-1] WHERE NOT done AND len(p) <= 4 AND (v = 1 AND len(p) > 2 OR NOT list_contains(p, v))), "
    "l AS (SELECT p, sha256('[' || array_to_string(list_sort(p), ', ') || ']') h FROM w WHERE done) SELECT array_to_string(p, ',') AS path, " + UUID + " AS uuid FROM l",
    "edges",
)
def closed_loops(spark, d):
    """Closed walks of up to 4 edges from node 1, with the UUIDs of their nodes."""
    found = graph.loops(fx.edges(spark, d), 1, 4)
    return found.select(F.array_join(F.transform("path", lambda n: n.cast("string")), ",").alias("path"), graph.path_uuid(F.col("path")).alias("uuid"))


# Meshes and text


@query("SELECT (y * 63 + x) * 2 + k face, y * 64 + x + 1 a, CASE WHEN k = 0 THEN y * 64 + x + 2 ELSE y * 64 + x + 66 END b, CASE WHEN k = 0 THEN y * 64 + x + 66 ELSE y * 64 + x + 65 END c FROM px, geo, range(0, 2) r(k) WHERE y < h - 1 AND x < 63", "px", "geo")
def height_mesh_faces(spark, d):
    g = fx.geo(spark, d)
    return mesh.grid_faces(fx.px(spark, d), g.h, g.w)


@query("SELECT y * 64 + x + 1 vertex, printf('v %.3f %.3f %.3f', x * 0.02::DOUBLE, y * 0.02::DOUBLE, z) AS line FROM dsm", "dsm")
def height_mesh_vertices(spark, d):
    return mesh.grid_vertices(fx.dsm(spark, d), 64, 0.02, -0.02)


VERTICES = "SELECT poly * 4 + idx seq, round_even(x, 0) x, round_even(y, 0) y, CAST(poly % 3 AS DOUBLE) z FROM verts"


def _vertices(spark, d):
    return fx.verts(spark, d).select((F.col("poly") * 4 + F.col("idx")).alias("seq"), "x", "y", (F.col("poly") % 3).cast("double").alias("z"))


@query(f"SELECT x, y, z, min(seq) AS first, count(*) n, row_number() OVER (ORDER BY min(seq)) vertex FROM ({VERTICES}) GROUP BY x, y, z", "verts")
def vertex_dictionary(spark, d):
    return mesh.numbered(mesh.vertex_dictionary(_vertices(spark, d), 0))


@query(
    "SELECT 0 AS section, CAST(y * 64 + x + 1 AS BIGINT) seq, 'v ' || CAST(x AS DOUBLE) || ' ' || CAST(y AS DOUBLE) || ' ' || z AS line FROM dsm UNION ALL SELECT 1, 0, 'o terrain' UNION ALL "
    "SELECT 2, CAST((y * 63 + x) * 2 + k AS BIGINT), 'f ' || (y * 64 + x + 1) || ' ' || CASE WHEN k = 0 THEN y * 64 + x + 2 ELSE y * 64 + x + 66 END || ' ' || CASE WHEN k = 0 THEN y * 64 + x + 66 ELSE y * 64 + x + 65 END FROM px, geo, range(0, 2) r(k) WHERE y < h - 1 AND x < 63",
    "dsm", "px", "geo",
)
def obj_lines(spark, d):
    g = fx.geo(spark, d)
    vertices = fx.dsm(spark, d).select((F.col("y") * g.w + F.col("x") + 1).alias("vertex"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"), "z")
    return mesh.obj_lines(vertices, mesh.grid_faces(fx.px(spark, d), g.h, g.w), "terrain")


@query("SELECT c_custkey pid, '50_' || CAST(trunc(c_custkey % 1000 + 0.75) AS BIGINT) || '_' || c_nationkey * 10 || ' (0000-00-00) (' || CAST(round_even(abs(c_acctbal), 0) AS BIGINT) || 'm).tif' AS name FROM customer")
def tile_names(spark, d):
    c = fx.table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("pid"), paths.tile_name(F.lit(50), F.col("c_custkey") % 1000 + F.lit(0.75), F.col("c_nationkey") * 10, F.lit(None).cast("string"), F.abs("c_acctbal")).alias("name"))


@query("SELECT page_id, regexp_extract(url, '^(.*)/[^/]*$', 1) folder, string_split(url, '/')[-1] AS name, CASE WHEN contains(string_split(url, '/')[-1], '.') THEN string_split(string_split(url, '/')[-1], '.')[-1] ELSE '' END ext FROM pages")
def path_parts(spark, d):
    u = F.col("url")
    return fx.table(spark, d, "pages").select("page_id", paths.folder(u).alias("folder"), paths.filename(u).alias("name"), paths.extension(u).alias("ext"))


@query(f"SELECT pid, printf('https://epsg.io/map#srs={EPSG_MTM8}&x=%.6f&y=%.6f&z=18&layer=osm', x, y) url, x cx, y cy FROM points", "points")
def epsgio_links(spark, d):
    p = fx.points(spark, d).select("pid", paths.map_link(F.col("x"), F.col("y"), F.lit(EPSG_MTM8)).alias("url"))
    return p.withColumn("_c", paths.map_link_coord(F.col("url"))).select("pid", "url", F.col("_c.cx").alias("cx"), F.col("_c.cy").alias("cy"))


# Kernels


PATCHES = (
    ", m AS MATERIALIZED (SELECT y, x, y * 64 + x id FROM px WHERE z > 0.2), e AS MATERIALIZED (SELECT a.id a, b.id b FROM m a, (VALUES (-1, -1), (-1, 0), (-1, 1), (0, -1), (0, 1), (1, -1), (1, 0), (1, 1)) o(dy, dx), m b WHERE b.y = a.y + dy AND b.x = a.x + dx), "
    "w(id, c) AS (SELECT id, id FROM m UNION SELECT e.b, w.c FROM w JOIN e ON e.a = w.id WHERE w.c < e.b) SELECT y, x, CAST(1 AS BIGINT) AS value, CAST(min(c) AS BIGINT) component FROM w JOIN m USING (id) GROUP BY y, x"
)


@query(PATCHES, "px")
def components_8(spark, d):
    return kernels.components(fx.px(spark, d).where("z > 0.2"), 64, chunk=32)


@query()
def remove_small(spark, d):
    return kernels.without_small(fx.inst(spark, d), 64, 6)


@query()
def biggest_component(spark, d):
    return kernels.biggest(fx.inst(spark, d), 64)


@query()
def remove_holes(spark, d):
    g = fx.geo(spark, d)
    return kernels.filled(fx.px(spark, d).where("z > -0.15").select("y", "x"), g.h, g.w)


@query(
    ", t AS (SELECT CAST(i AS INT) y, CAST(j AS INT) x, (i + 0.5) * (h / 100.0::DOUBLE) - 0.5 sy, (j + 0.5) * 0.64::DOUBLE - 0.5 sx, h FROM geo, range(0, 100) a(i), range(0, 100) b(j)), "
    "k AS (SELECT y, x, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) w, greatest(0, least(h - 1, CAST(floor(sy) AS INT) + dy)) py, greatest(0, least(63, CAST(floor(sx) AS INT) + dx)) px FROM t, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx)) "
    "SELECT k.y, k.x, round(sum(w * z), 6) z FROM k JOIN px p ON p.y = py AND p.x = k.px GROUP BY ALL",
    "px", "geo",
)
def bilinear(spark, d):
    g = fx.geo(spark, d)
    return halo.resize(fx.px(spark, d), g.h, g.w, 100, 100).withColumn("z", F.round("z", 6))


CUBIC = "CASE WHEN abs({t}) <= 1 THEN 1.25 * abs({t}) * abs({t}) * abs({t}) - 2.25 * {t} * {t} + 1 WHEN abs({t}) < 2 THEN -0.75 * abs({t}) * abs({t}) * abs({t}) + 3.75 * {t} * {t} - 6 * abs({t}) + 3 ELSE 0 END::DOUBLE"


@query(
    ", t AS (SELECT CAST(i AS INT) y, CAST(j AS INT) x, (i + 0.5) * (h / 100.0::DOUBLE) - 0.5 sy, (j + 0.5) * 0.64::DOUBLE - 0.5 sx, h FROM geo, range(0, 100) a(i), range(0, 100) b(j)), "
    "k AS MATERIALIZED (SELECT y, x, " + CUBIC.format(t="(sy - floor(sy) - dy)") + " * " + CUBIC.format(t="(sx - floor(sx) - dx)") + " w, greatest(0, least(h - 1, CAST(floor(sy) AS INT) + dy)) py, greatest(0, least(63, CAST(floor(sx) AS INT) + dx)) px "
    "FROM t, (VALUES (-1), (0), (1), (2)) a(dy), (VALUES (-1), (0), (1), (2)) b(dx)) SELECT k.y, k.x, round(sum(w * z), 6) z FROM k JOIN px p ON p.y = py AND p.x = k.px GROUP BY ALL",
    "px", "geo",
)
def bicubic(spark, d):
    g = fx.geo(spark, d)
    return halo.resize(fx.px(spark, d), g.h, g.w, 100, 100, "cubic").withColumn("z", F.round("z", 6))


TURNED = (
    ", c AS (SELECT h, cos(radians(30.0)) c, sin(radians(30.0)) s FROM geo), n AS (SELECT *, CAST(ceil(h * c + 64 * s - 1e-9) AS INT) nh, CAST(ceil(h * s + 64 * c - 1e-9) AS INT) nw FROM c), "
    "t AS MATERIALIZED (SELECT CAST(i // nw AS INT) y, CAST(i % nw AS INT) x, (i // nw - (nh - 1) / 2.0::DOUBLE) * c + (i % nw - (nw - 1) / 2.0::DOUBLE) * s + (h - 1) / 2.0::DOUBLE sy, (i % nw - (nw - 1) / 2.0::DOUBLE) * c - (i // nw - (nh - 1) / 2.0::DOUBLE) * s + 31.5 sx, h FROM n, range(0, (SELECT nh * nw FROM n)) r(i)), "
    "k AS MATERIALIZED (SELECT y, x, (1 - abs(sy - floor(sy) - dy)) * (1 - abs(sx - floor(sx) - dx)) w, greatest(0, least(h - 1, CAST(floor(sy) AS INT) + dy)) py, greatest(0, least(63, CAST(floor(sx) AS INT) + dx)) px FROM t, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx) WHERE sy BETWEEN -0.5 AND h - 0.5 AND sx BETWEEN -0.5 AND 63.5), "
    "v AS (SELECT k.y, k.x, sum(w * z) z FROM k JOIN px p ON p.y = py AND p.x = k.px GROUP BY ALL) SELECT t.y, t.x, round(coalesce(z, 0), 6) z FROM t LEFT JOIN v USING (y, x)"
)


@query(TURNED, "px", "geo")
def rotate(spark, d):
    g = fx.geo(spark, d)
    return halo.rotate(fx.px(spark, d), g.h, g.w, 30.0)[0].withColumn("z", F.round("z", 6) + F.lit(0.0))


def _blurred(axis: str, source: str) -> str:
    other = "x" if axis == "y" else "y"
    return f"(SELECT a.y, a.x, sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis}) * (b.{axis} - a.{axis})) * b.z) / sum(exp(-0.5::DOUBLE * (b.{axis} - a.{axis}) * (b.{axis} - a.{axis}))) z FROM {source} a JOIN {source} b ON a.{other} = b.{other} AND b.{axis} BETWEEN a.{axis} - 4 AND a.{axis} + 4 GROUP BY ALL)"


@query(f", v AS MATERIALIZED {_blurred('y', 'px')} SELECT y, x, round(z, 6) z FROM {_blurred('x', 'v')}", "px")
def gaussian_blur(spark, d):
    g = fx.geo(spark, d)
    return halo.blur(fx.px(spark, d), g.h, g.w, 1.0).withColumn("z", F.round("z", 6))


@query(", c AS (SELECT y, x, z + 0.05 z FROM px WHERE y < 50 AND cls > 4) SELECT y, x, CASE WHEN c.z >= p.z THEN c.z ELSE p.z END z, CASE WHEN c.z >= p.z THEN (SELECT max(label) FROM inst) + 1 ELSE label END label FROM px p JOIN inst USING (y, x) LEFT JOIN c USING (y, x)", "px", "inst")
def copy_paste(spark, d):
    base = fx.px(spark, d).select("y", "x", "z").join(fx.inst(spark, d), ["y", "x"])
    copy = fx.px(spark, d).where("y < 50 and cls > 4").select("y", "x", (F.col("z") + 0.05).alias("z"), F.lit(1).alias("label"))
    return kernels.paste(copy, base)


@query()
def instance_hulls(spark, d):
    return kernels.hulls(fx.inst(spark, d))


def entry_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height above ground, then its zonal statistics for each instance."""
    return zonal.zonal_stats(fx.inst(spark, sf_dir), ndsm(spark, sf_dir))
