"""Registered queries over surfaces, polygons on rasters, tables of tiles and projections, each beside its SQL where it has one."""

from __future__ import annotations

from pyspark.sql import functions as F

from terrafold.model import EPSG_GPS, EPSG_MTM8
from terrafold.operators import blocks, coords, detect, geodesy, graph, ground, halo, jobs, mapalg, mesh, regions, seams, semantics, tiles, zonal
from terrafold.plans import fixtures as fx
from terrafold.plans.library import CUBIC, DICTIONARY, GRID, NDSM, RIM, SIDES, _int_code, ndsm
from terrafold.plans.registry import query

# Ground and canopy


def _smoothed(source: str, step: int, size: int) -> str:
    """m: source (y, x, z, ok) thinned, filled and smoothed; v: m laid back over the raster by cubic weights."""
    r = size // 2
    mirror = lambda k, n: f"CASE WHEN {k} < 0 THEN -({k}) - 1 WHEN {k} >= {n} THEN 2 * {n} - 1 - ({k}) ELSE {k} END"
    return (
        f", d AS MATERIALIZED ({source}), g AS MATERIALIZED (SELECT * FROM d WHERE y % {step} = 0 AND x % {step} = 0), n AS (SELECT CAST(ceil(h / {step}.0) AS INT) sh, CAST(ceil(64 / {step}.0) AS INT) sw, h FROM geo), "
        "f AS (SELECT g.y, g.x, arg_min(v.z, ((g.y - v.y) * (g.y - v.y) + (g.x - v.x) * (g.x - v.x), v.y, v.x)) z FROM g, d v WHERE NOT g.ok AND v.ok GROUP BY g.y, g.x), "
        f"s AS MATERIALIZED (SELECT CAST(y // {step} AS INT) y, CAST(x // {step} AS INT) x, z FROM (SELECT y, x, z FROM g WHERE ok UNION ALL SELECT * FROM f)), "
        f"a AS MATERIALIZED (SELECT s.y, s.x, {mirror('s.y + i', 'sh')} ny, {mirror('s.x + j', 'sw')} nx FROM s, n, range({-r}, {r + 1}) p(i), range({-r}, {r + 1}) q(j)), "
        f"m AS MATERIALIZED (SELECT a.y, a.x, list_sort(list(s.z))[{size * size // 2 + 1}] z FROM a JOIN s ON s.y = a.ny AND s.x = a.nx GROUP BY a.y, a.x), "
        "t AS (SELECT y, x, sh, sw, (y + 0.5) * (sh / h::DOUBLE) - 0.5 sy, (x + 0.5) * (sw / 64.0::DOUBLE) - 0.5 sx FROM d, n), "
        "k AS MATERIALIZED (SELECT y, x, " + CUBIC.format(t="(sy - floor(sy) - dy)") + " * " + CUBIC.format(t="(sx - floor(sx) - dx)") + " w, "
        "greatest(0, least(sh - 1, CAST(floor(sy) AS INT) + dy)) py, greatest(0, least(sw - 1, CAST(floor(sx) AS INT) + dx)) px FROM t, (VALUES (-1), (0), (1), (2)) a1(dy), (VALUES (-1), (0), (1), (2)) b1(dx)), "
        "v AS (SELECT k.y, k.x, sum(w * m.z) sz FROM k JOIN m ON m.y = py AND m.x = k.px GROUP BY ALL)"
    )


@query(_smoothed("SELECT y, x, z, z > (SELECT min(z) FROM dtm) ok FROM dtm", 5, 5) + " SELECT y, x, round(CASE WHEN ok THEN sz ELSE -9999 END, 6) z FROM d JOIN v USING (y, x)", "dtm", "geo")
def ground_surface(spark, d):
    g = fx.geo(spark, d)
    return ground.ground(fx.dtm(spark, d), g.h, g.w, 5, 5).withColumn("z", F.round("z", 6))


@query(
    f", e AS MATERIALIZED ({NDSM}), q AS (SELECT CAST(sum(CAST(z AS DECIMAL(20, 6))) AS DOUBLE) / count(*) / 2 half FROM e WHERE z <> 0)"
    + _smoothed("SELECT y, x, z, z >= half ok FROM e, q", 4, 3) + " SELECT y, x, round(CASE WHEN label <> 0 THEN greatest(z, (sz + z) / 2) ELSE 0 END, 6) z FROM d JOIN v USING (y, x) JOIN inst USING (y, x)",
    "dsm", "dtm", "inst", "geo",
)
def canopy_surface(spark, d):
    g = fx.geo(spark, d)
    return ground.canopy(ndsm(spark, d), fx.inst(spark, d), g.h, g.w, 4, 3).withColumn("z", F.round("z", 6) + F.lit(0.0))


@query(", k AS MATERIALIZED (SELECT y, x FROM px WHERE z > 0.42), o AS (SELECT i dy, j dx FROM range(-9, 10) a(i), range(-9, 10) b(j) WHERE i * i + j * j <= 81) SELECT DISTINCT CAST(y + dy AS INT) y, CAST(x + dx AS INT) x FROM k, o, geo WHERE y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 63", "px", "geo")
def dilate_disk9(spark, d):
    g = fx.geo(spark, d)
    return halo.morphology(fx.px(spark, d).where("z > 0.42"), g.h, g.w, "d", 9, chunk=32)


DISK = "(SELECT i dy, j dx FROM range(-3, 4) a(i), range(-3, 4) b(j) WHERE i * i + j * j <= 9)"


@query(
    f", k AS MATERIALIZED (SELECT y, x FROM px WHERE z > 0.3), o AS {DISK}, w AS MATERIALIZED (SELECT DISTINCT CAST(y + dy AS INT) y, CAST(x + dx AS INT) x FROM k, o, geo WHERE y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 63), "
    "b AS MATERIALIZED (SELECT y, x FROM px EXCEPT SELECT y, x FROM w), c AS MATERIALIZED (SELECT DISTINCT CAST(y + dy AS INT) y, CAST(x + dx AS INT) x FROM b, o) SELECT y, x FROM w EXCEPT SELECT y, x FROM c",
    "px", "geo",
)
def close_disk3(spark, d):
    g = fx.geo(spark, d)
    return halo.morphology(fx.px(spark, d).where("z > 0.3"), g.h, g.w, "de", 3, chunk=40)


# Polygons on rasters

OUTLINES = "SELECT poly, idx, x * 0.064::DOUBLE x, y * 2.0::DOUBLE y FROM verts"
ON_RASTER = SIDES.replace("FROM verts", f"FROM ({OUTLINES})")
INSIDE = "SELECT s.poly, p.y, p.x FROM s JOIN px p ON p.y BETWEEN floor(least(y1, y2)) AND ceil(greatest(y1, y2)) AND (y1 > p.y) <> (y2 > p.y) AND p.x < (x2 - x1) * (p.y - y1) / nullif(y2 - y1, 0) + x1 GROUP BY ALL HAVING count(*) % 2 = 1"


def _outlines(spark, d):
    return fx.verts(spark, d).select("poly", "idx", (F.col("x") * 0.064).alias("x"), (F.col("y") * 2.0).alias("y"))


@query(ON_RASTER + " " + INSIDE, "verts", "px")
def polygon_mask(spark, d):
    g = fx.geo(spark, d)
    return regions.mask(_outlines(spark, d), g.h, g.w)


@query(
    ON_RASTER + f", i AS MATERIALIZED ({INSIDE}), b AS (SELECT poly, greatest(0, CAST(floor(min(y)) AS INT)) y0, greatest(0, CAST(floor(min(x)) AS INT)) x0, least(h, CAST(floor(max(y)) AS INT) + 1) y1, least(64, CAST(floor(max(x)) AS INT) + 1) x1 FROM ({OUTLINES}), geo GROUP BY poly, h) "
    "SELECT b.poly, p.y - y0 y, p.x - x0 x, CASE WHEN i.poly IS NOT NULL THEN z ELSE 0 END z FROM b JOIN px p ON p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 LEFT JOIN i ON i.poly = b.poly AND i.y = p.y AND i.x = p.x",
    "verts", "px", "geo",
)
def polygon_crop(spark, d):
    g = fx.geo(spark, d)
    return regions.crop(fx.px(spark, d), _outlines(spark, d), g.h, g.w, tile=32)


@query(", o AS (SELECT i dy, j dx FROM range(-2, 3) a(i), range(-2, 3) b(j) WHERE i * i + j * j <= 4) SELECT DISTINCT CAST(y + dy AS INT) y, CAST(x + dx AS INT) x FROM alpha, o, geo WHERE a = 0 AND y + dy BETWEEN 0 AND h - 1 AND x + dx BETWEEN 0 AND 63", "alpha", "geo")
def outside_region(spark, d):
    g = fx.geo(spark, d)
    return regions.outside(fx.alpha(spark, d), g.h, g.w)


@query()
def polygon_buffer(spark, d):
    return regions.buffered(fx.verts(spark, d), 10.0, 8)


# Projections


def _plane_sql(source: str) -> str:
    z = geodesy.zone(EPSG_MTM8)
    terms = lambda outer, inner, var: " + ".join(f"{a!r}::DOUBLE * {outer}({2 * j} * xi) * {inner}({2 * j} * eta)" for j, a in enumerate(geodesy.FORWARD, 1)) + f" + {var}"
    scale = f"{z.k0 * geodesy.RADIUS!r}::DOUBLE"
    return (
        f", p AS ({source}), q AS (SELECT pid, radians(lat) phi, radians(lon - ({z.lon0!r})) lam FROM p), r AS (SELECT *, sinh(atanh(sin(phi)) - {geodesy.E!r}::DOUBLE * atanh({geodesy.E!r}::DOUBLE * sin(phi))) t FROM q), "
        "u AS (SELECT pid, atan2(t, cos(lam)) xi, atanh(sin(lam) / sqrt(1 + t * t)) eta FROM r), "
        f"g AS (SELECT pid, {scale} * ({terms('cos', 'sinh', 'eta')}) + {z.fe!r} cx, {scale} * ({terms('sin', 'cosh', 'xi')}) cy FROM u)"
    )


DEGREES = "SELECT pid, -73.5::DOUBLE + (x - 500) / 2000.0::DOUBLE lon, 45.0::DOUBLE + y / 500.0::DOUBLE lat FROM points"


def _degrees(spark, d):
    return fx.points(spark, d).select("pid", (F.lit(-73.5) + (F.col("x") - 500) / 2000.0).alias("cx"), (F.lit(45.0) + F.col("y") / 500.0).alias("cy"))


@query(_plane_sql(DEGREES) + " SELECT pid, round_even(cx, 3) cx, round_even(cy, 3) cy FROM g", "points")
def reproject_to_plane(spark, d):
    return geodesy.reproject(_degrees(spark, d), EPSG_GPS, EPSG_MTM8)


@query(_plane_sql(DEGREES) + " SELECT pid, round(lon, 8) cx, round(lat, 8) cy FROM g JOIN p USING (pid)", "points")
def reproject_round_trip(spark, d):
    """To the plane, unrounded, and back: the degrees that went in."""
    back = geodesy.reproject(geodesy.reproject(_degrees(spark, d), EPSG_GPS, EPSG_MTM8, None), EPSG_MTM8, EPSG_GPS)
    return back.select("pid", F.round("cx", 8).alias("cx"), F.round("cy", 8).alias("cy"))


@query()
def reproject_raster(spark, d):
    return geodesy.reproject_raster(fx.px(spark, d), fx.geo(spark, d), EPSG_GPS)[0]


@query(
    "SELECT h, w, ox + (w // 2) * 0.02::DOUBLE cx, round_even(oy - (h // 2) * 0.02::DOUBLE, 3) cy, 2 AS precision, round_even(w * 0.02::DOUBLE, 2) width, round_even(h * 0.02::DOUBLE, 2) height, ox minx, oy - h * 0.02::DOUBLE miny, ox + w * 0.02::DOUBLE maxx, oy maxy FROM geo",
    "geo",
)
def raster_info(spark, d):
    g = fx.geo(spark, d)
    (cx, cy), (width, height), (minx, miny, maxx, maxy) = g.center(), g.size(), g.bbox()
    return spark.createDataFrame([(g.h, g.w, cx, cy, g.precision(), width, height, minx, miny, maxx, maxy)], "h int, w int, cx double, cy double, precision int, width double, height double, minx double, miny double, maxx double, maxy double")


# Tables of tiles

TILED = {
    "image": "SELECT 't' || (y // 50) tile, CAST(y % 50 AS INT) y, x, CAST(floor((z + 2) * 60) AS INT) % 256 r, CAST(floor((z + 2) * 90) AS INT) % 256 g, (y * 7 + x * 3) % 256 b FROM px",
    "heights": "SELECT 't' || (y // 50) tile, CAST(y % 50 AS INT) y, x, z FROM dsm",
    "instances": "SELECT 't' || (y // 50) tile, CAST(y % 50 AS INT) y, x, label FROM inst WHERE (y // 50) % 2 = 0",
    "marks": "SELECT 't' || (y // 50) tile, CAST(y % 50 AS INT) y, x, row_id, code FROM pts WHERE (y // 50) % 4 = 0",
}
TILE_SQL = (
    ", " + ", ".join(f"{k} AS MATERIALIZED ({v})" for k, v in TILED.items()) + ", ids AS (SELECT tile, label, CAST(row_number() OVER (PARTITION BY tile ORDER BY label) AS INT) k FROM (SELECT DISTINCT tile, label FROM instances WHERE label <> 0)), "
    "fresh AS MATERIALIZED (SELECT tile, y, x, coalesce(k, 0) label FROM instances LEFT JOIN ids USING (tile, label)), firsts AS (SELECT tile, label, arg_min(code, row_id) code FROM marks JOIN fresh USING (tile, y, x) WHERE label <> 0 GROUP BY tile, label), "
    f"tile_rows AS MATERIALIZED (SELECT i.tile, i.y, i.x, r, g, b, z, coalesce(f.label, 0) label, CASE WHEN coalesce(f.label, 0) = 0 OR i.tile NOT IN (SELECT tile FROM marks) THEN 0 WHEN c.code IS NULL THEN 1 ELSE {_int_code('c.code')} END cls "
    "FROM image i JOIN heights USING (tile, y, x) LEFT JOIN fresh f USING (tile, y, x) LEFT JOIN firsts c ON c.tile = i.tile AND c.label = f.label)"
)
TILE_FIXTURES = ("px", "dsm", "inst", "pts")


def _tiled(df, *columns):
    return df.select(F.concat(F.lit("t"), F.floor(F.col("y") / 50).cast("string")).alias("tile"), (F.col("y") % 50).cast("int").alias("y"), "x", *columns)


def _tiles(spark, d, fill=False):
    z = F.col("z")
    byte = lambda k: F.pmod(F.floor((z + 2) * k).cast("int"), F.lit(256))
    image = _tiled(fx.px(spark, d).withColumns({"r": byte(60), "g": byte(90), "b": (F.col("y") * 7 + F.col("x") * 3) % 256}), "r", "g", "b")
    image = image.withColumn("b", F.col("b").cast("int"))
    block = F.floor(F.col("y") / 50)
    return tiles.assemble(image, _tiled(fx.dsm(spark, d), "z"), _tiled(fx.inst(spark, d).where(block % 2 == 0), "label"), _tiled(fx.pts(spark, d).where(block % 4 == 0), "row_id", "code"), DICTIONARY, fill)


@query(TILE_SQL + " SELECT * FROM tile_rows", *TILE_FIXTURES)
def tile_assembly(spark, d):
    return _tiles(spark, d)


@query()
def tile_assembly_filled(spark, d):
    return _tiles(spark, d, fill=True)


@query(
    TILE_SQL + ", lim AS (SELECT tile, min(least(r, g, b)) lo, max(greatest(r, g, b)) hi FROM tile_rows GROUP BY tile), u AS (SELECT *, CASE WHEN hi = lo THEN 1 ELSE (hi - lo)::DOUBLE END s FROM tile_rows JOIN lim USING (tile)) "
    "SELECT tile, y, x, CAST(trunc((r - lo) / s * 255) AS INT) r, CAST(trunc((g - lo) / s * 255) AS INT) g, CAST(trunc((b - lo) / s * 255) AS INT) b, CAST(trunc(greatest(0.0, least(1.0, z / 25.5::DOUBLE)) * 255) AS INT) z, label, cls FROM u",
    *TILE_FIXTURES,
)
def tile_bytes(spark, d):
    return tiles.byte_heights(tiles.byte_image(_tiles(spark, d)))


@query()
def tile_preprocess(spark, d):
    return tiles.preprocess(_tiles(spark, d), 6)


@query(TILE_SQL + " SELECT tile, y, x, [b::DOUBLE, g::DOUBLE, r::DOUBLE, z] channels FROM tile_rows", *TILE_FIXTURES)
def tile_channels(spark, d):
    return tiles.channels(_tiles(spark, d), "bgrd")


@query(
    TILE_SQL + ", spots AS (SELECT * FROM (VALUES ('nw', 0, 0), ('ne', 0, 32), ('sw', 25, 0), ('se', 25, 32), ('cc', 12, 16), ('nc', 0, 16), ('wc', 12, 0), ('sc', 25, 16), ('ec', 12, 32)) s(part, y0, x0)) "
    "SELECT tile || ' (' || part || ')' AS tile, y - y0 y, x - x0 x, z, label FROM tile_rows, spots WHERE y >= y0 AND y < y0 + 25 AND x >= x0 AND x < x0 + 32 "
    "UNION ALL SELECT tile || ' (ff)', CAST(i AS INT), CAST(j AS INT), z, label FROM tile_rows, range(0, 25) a(i), range(0, 32) b(j) WHERE y = i * 2 AND x = j * 2",
    *TILE_FIXTURES,
)
def tile_parts(spark, d):
    return tiles.parts(_tiles(spark, d).select("tile", "y", "x", "z", "label"), 50, 64, 10)


@query(
    TILE_SQL + ", box AS (SELECT tile, label, min(y) y0, min(x) x0 FROM tile_rows WHERE label <> 0 GROUP BY tile, label HAVING min(y) > 0 AND min(x) > 0 AND max(y) < 49 AND max(x) < 63) SELECT tile, label AS id, y - y0 y, x - x0 x, z, label, cls FROM tile_rows JOIN box USING (tile, label)",
    *TILE_FIXTURES,
)
def local_tiles(spark, d):
    return tiles.local_tiles(_tiles(spark, d).select("tile", "y", "x", "z", "label", "cls"), 50, 64)


@query(TILE_SQL + " SELECT min(ox) minx, min(oy) miny, max(ox + 64) maxx, max(oy + 50) maxy, count(*) n FROM (SELECT DISTINCT tile, 0 ox, CAST(substr(tile, 2) AS INT) * 50 oy FROM tile_rows)", *TILE_FIXTURES)
def tile_set_bbox(spark, d):
    at = _tiles(spark, d).select("tile").distinct().select(F.lit(0).alias("ox"), (F.substring("tile", 2, 9).cast("int") * 50).alias("oy"))
    return at.agg(F.min("ox").alias("minx"), F.min("oy").alias("miny"), F.max(F.col("ox") + 64).alias("maxx"), F.max(F.col("oy") + 50).alias("maxy"), F.count("*").alias("n"))


@query()
def height_groups(spark, d):
    return tiles.height_groups(_tiles(spark, d))


@query()
def pastable_tiles(spark, d):
    return tiles.pastable(_tiles(spark, d).withColumn("z", F.greatest(F.lit(0.0), F.col("z") - 40)))


@query()
def paste_draws(spark, d):
    t = _tiles(spark, d)
    return tiles.draws(t, tiles.local_tiles(t, 50, 64), 3, 50, 64, seed=4)


@query(TILE_SQL + " SELECT tile, y, x, greatest(0.0, least(25.5::DOUBLE, z)) z FROM tile_rows", *TILE_FIXTURES)
def tile_clip_height(spark, d):
    return tiles.clipped(_tiles(spark, d)).select("tile", "y", "x", "z")


# Instances

TOPS = (
    ", e AS (SELECT label, y, x, z FROM inst JOIN px USING (y, x) WHERE label <> 0), r AS (SELECT *, (z - min(z) OVER l) / CASE WHEN max(z) OVER l = min(z) OVER l THEN 1 ELSE max(z) OVER l - min(z) OVER l END u, count(*) OVER l n FROM e WINDOW l AS (PARTITION BY label)), "
    "c AS (SELECT label, k, n, count(*) FILTER (u > (99 - k) / 100.0::DOUBLE) m FROM r, range(0, 100) t(k) GROUP BY label, k, n), f AS (SELECT label, min(k) k FROM c WHERE m >= 0.15::DOUBLE * n GROUP BY label) "
    "SELECT label, y, x FROM r JOIN f USING (label) WHERE u > (99 - k) / 100.0::DOUBLE AND u > 0.85::DOUBLE"
)


@query(TOPS, "inst", "px")
def instance_tops(spark, d):
    return zonal.tops(fx.inst(spark, d), fx.px(spark, d))


@query(", c AS (SELECT x, CAST(round_even(max(z) * 20, 0) AS INT) n FROM px WHERE z > 0 GROUP BY x), t AS (SELECT max(n) h FROM c) SELECT CAST(h - 1 - i AS INT) y, x FROM c, t, range(0, 100) r(i) WHERE i < n", "px")
def silhouette(spark, d):
    tops = fx.px(spark, d).where("z > 0").groupBy("x").agg(F.bround(F.max("z") * 20, 0).cast("int").alias("n"))
    return zonal.silhouette(tops)


@query(", m AS (SELECT min(z) lo FROM px) SELECT y, x, CASE WHEN z = lo AND (SELECT count(*) FROM px, m WHERE z = lo) > CAST(trunc((SELECT count(*) FROM px) * 0.0::DOUBLE) AS INT) THEN NULL ELSE z END z FROM px, m", "px")
def nodata_to_null(spark, d):
    return mapalg.without_nodata(fx.px(spark, d).select("y", "x", "z"), 0.0)


@query("SELECT y, x, [1 - z, 1 - z, 1 - z] channels FROM px", "px")
def grey_channels(spark, d):
    return fx.px(spark, d).select("y", "x", mapalg.grey(F.col("z"), True).alias("channels"))


@query("SELECT pid, x cx, y cy, 12.5::DOUBLE cz FROM points", "points")
def points_with_height(spark, d):
    return coords.with_height(fx.points(spark, d).select("pid", F.col("x").alias("cx"), F.col("y").alias("cy")), 12.5)


@query("SELECT poly, idx, x + 1.5::DOUBLE x, y - 2.0::DOUBLE y, 3.0::DOUBLE z FROM verts", "verts")
def mesh_moved(spark, d):
    return mesh.translated(fx.verts(spark, d).withColumn("z", F.lit(0.0)), 1.5, -2.0, 3.0)


@query(f"SELECT name, {_int_code('upper(prefix)')} code FROM manifest WHERE name LIKE '%.npz' AND prefix LIKE '%1'", "manifest")
def dataset_names(spark, d):
    m = fx.manifest(spark, d)
    return semantics.dataset_names(m, subset="1").select("name", semantics.int_code(F.col("prefix"), DICTIONARY).alias("code"))


@query("SELECT image, det_id, xmin, ymin, xmax, ymax, CAST(trunc((xmin + xmax) / 2) AS INT) xcenter, score FROM det", "det")
def detection_rows(spark, d):
    boxes = fx.det(spark, d).groupBy("image").agg(F.collect_list(F.struct("det_id", "xmin", "ymin", "xmax", "ymax", "score")).alias("boxes"))
    return detect.objects(boxes)


BLURRED = "(SELECT a.y, a.x, sum(exp(-0.5::DOUBLE * (b.{m} - a.{m}) * (b.{m} - a.{m})) * b.z) / sum(exp(-0.5::DOUBLE * (b.{m} - a.{m}) * (b.{m} - a.{m}))) z FROM {s} a JOIN {s} b ON a.{o} = b.{o} AND b.{m} BETWEEN a.{m} - 4 AND a.{m} + 4 GROUP BY ALL)"


@query(
    f", v AS MATERIALIZED {BLURRED.format(m='y', o='x', s='px')}, w AS MATERIALIZED {BLURRED.format(m='x', o='y', s='v')}, b AS (SELECT CAST(ymin AS INT) y0, CAST(ymax AS INT) y1, CAST(xmin AS INT) x0, CAST(xmax AS INT) x1 FROM det WHERE image % 100 = 0), "
    "i AS MATERIALIZED (SELECT DISTINCT y, x FROM px JOIN b ON y >= y0 AND y < y1 AND x >= x0 AND x < x1) SELECT p.y, p.x, round(CASE WHEN i.y IS NULL THEN p.z ELSE w.z END, 6) z FROM px p JOIN w USING (y, x) LEFT JOIN i USING (y, x)",
    "px", "det",
)
def blur_boxes(spark, d):
    g = fx.geo(spark, d)
    b = fx.det(spark, d).where("image % 100 = 0").select(F.col("ymin").cast("int").alias("y0"), F.col("ymax").cast("int").alias("y1"), F.col("xmin").cast("int").alias("x0"), F.col("xmax").cast("int").alias("x1"))
    return detect.blurred_boxes(fx.px(spark, d).select("y", "x", "z"), b, g.h, g.w, 1.0).withColumn("z", F.round("z", 6))


# Streets


@query("SELECT CAST(s_nationkey AS BIGINT) node, count(*) n, min(s_suppkey % 25) least FROM supplier GROUP BY s_nationkey")
def street_ends(spark, d):
    """Streets that begin at a node, from both ways of each."""
    e = fx.table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("u"), (F.col("s_suppkey") % 25).alias("v"))
    return graph.at_node(e).withColumnRenamed("end", "least")


@query()
def city_blocks(spark, d):
    """Blocks of a street lattice around the customers that lie in it: streets are the lattice's sides that a supplier keeps open."""
    return blocks.around(fx.streets(spark, d), fx.street_seeds(spark, d), radius=60.0, most=8).select("seed", "uuid", F.size("nodes").alias("n"))


# Jobs


@query(
    ", d0 AS (SELECT y, x, z FROM dtm)" + _smoothed("SELECT y, x, z, z > (SELECT min(z) FROM d0) ok FROM d0", 5, 5)
    + ", c AS (SELECT y, x, CASE WHEN ok THEN sz ELSE -9999 END z FROM d JOIN v USING (y, x)) SELECT y, x, round_even(CASE WHEN a.z - c.z < 0 OR a.z - c.z > 60 THEN 0.0 ELSE a.z - c.z END, 3) z FROM dsm a JOIN c USING (y, x)",
    "dsm", "dtm", "geo",
)
def ndsm_corrected(spark, d):
    g = fx.geo(spark, d)
    return jobs.height_model(fx.dsm(spark, d), g, fx.dtm(spark, d), g, 60.0, correct=True, step=5)[0]


@query(
    GRID + RIM.format(mask="alpha WHERE y % 4 = 0 AND x % 4 = 0 AND a <> 0") + ", rim AS MATERIALIZED (SELECT CAST(y * 4 + 1 AS INT) y, CAST(x * 4 + 1 AS INT) x FROM (SELECT * FROM mr UNION SELECT * FROM mf)), "
    "u AS MATERIALIZED (SELECT tile, cx, cy, y0, x0, y1, x1, sum(a) / 100 / 255.0::DOUBLE ratio FROM q JOIN alpha ON y BETWEEN y0 AND y1 - 1 AND x BETWEEN x0 AND x1 - 1 GROUP BY ALL) "
    "SELECT u.*, floor(sqrt(min((y0 + 5 - rim.y) * (y0 + 5 - rim.y) + (x0 + 5 - rim.x) * (x0 + 5 - rim.x)))) * 0.02::DOUBLE distance FROM u, rim WHERE ratio >= 0.9::DOUBLE GROUP BY ALL HAVING distance >= 0.02::DOUBLE",
    "px", "alpha", "geo",
)
def valid_tiles(spark, d):
    return jobs.valid_tiles(fx.alpha(spark, d), fx.geo(spark, d), 0.2, 4, 0.9, 0.02)


@query()
def tree_lines(spark, d):
    """OBJ lines of the fixture's instances as trees, all of which are tall and wide enough at this scale."""
    g = fx.geo(spark, d)
    return jobs.tree_models(fx.inst(spark, d), fx.px(spark, d), fx.dtm(spark, d), fx.alpha(spark, d).withColumn("a", F.lit(255)), g, "tree", -1.0, 0.0)[0]


@query()
def tree_metadata(spark, d):
    g = fx.geo(spark, d)
    return jobs.tree_models(fx.inst(spark, d), fx.px(spark, d), fx.dtm(spark, d), fx.alpha(spark, d).withColumn("a", F.lit(255)), g, "tree", -1.0, 0.0)[1]


@query()
def seam_merge(spark, d):
    """The instances of a raster and its copy below it, joined across the seam."""
    g = fx.geo(spark, d)
    return seams.combine(fx.inst(spark, d), fx.inst(spark, d), g.h, "y", reach=3)
