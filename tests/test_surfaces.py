"""Surfaces, polygons, tiles, projections and city blocks without SQL, against NumPy and known values."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_kernels import array, frame

from terrafold.model import Geo, RasterError
from terrafold.operators import blocks, geodesy, ground, halo, regions, tiles, zonal


def sparse(spark, m):
    return spark.createDataFrame([(int(y), int(x)) for y, x in zip(*np.nonzero(m), strict=True)], "y int, x int")


@pytest.mark.parametrize("steps", ["d", "e", "ed", "de"])
def test_morphology_against_a_plain_loop(spark, steps):
    rnd = np.random.default_rng(3)
    m = rnd.random((23, 31)) < 0.6
    m[5:15, 5:18] = True
    off = [(i, j) for i in range(-3, 4) for j in range(-3, 4) if i * i + j * j <= 9]

    def near(a):
        out = np.zeros_like(a)
        for y, x in zip(*np.nonzero(a), strict=True):
            for i, j in off:
                if 0 <= y + i < a.shape[0] and 0 <= x + j < a.shape[1]:
                    out[y + i, x + j] = True
        return out

    want = m
    for s in steps:
        want = near(want) if s == "d" else want & ~near(~want)
    got = {tuple(r) for r in halo.morphology(sparse(spark, m), 23, 31, steps, 3, chunk=7).collect()}
    assert got == set(zip(*np.nonzero(want), strict=True))


def test_chunks_do_not_show(spark):
    a = np.random.default_rng(4).normal(size=(37, 29))
    df = frame(spark, a)
    for f in (lambda c: halo.resize(df, 37, 29, 50, 21, "cubic", chunk=c), lambda c: halo.rotate(df, 37, 29, 33.0, chunk=c)[0], lambda c: halo.blur(df, 37, 29, 1.5, chunk=c)):
        one, many = ({(r.y, r.x): r.z for r in f(c).collect()} for c in (256, 8))
        assert one.keys() == many.keys() and all(abs(one[k] - many[k]) < 1e-9 for k in one)
    assert halo.zoom(df, 37, 29, 0.5)[1:] == (18, 14)


def test_nearest_of_all_pixels(spark):
    rnd = np.random.default_rng(5)
    valid = [(int(y), int(x), float(y * 1000 + x)) for y, x in rnd.integers(0, 300, (40, 2))]
    ask = [(int(y), int(x)) for y, x in rnd.integers(0, 300, (60, 2))]
    want = {(y, x): min(((y - p) ** 2 + (x - q) ** 2, p, q, z) for p, q, z in valid)[3] for y, x in ask}
    got = ground.nearest(spark.createDataFrame(sorted(set(ask)), "y int, x int"), spark.createDataFrame(sorted(set(valid)), "y int, x int, z double"), 300, cell=4)
    assert {(r.y, r.x): r.z for r in got.collect()} == want
    assert ground.nearest(spark.createDataFrame([], "y int, x int"), spark.createDataFrame([], "y int, x int, z double"), 300).collect() == []


def test_gaps_far_from_any_pixel(spark, monkeypatch):
    """Gaps near a valid pixel are filled within chunks, those far from all in cells, up to one that is as large as the raster."""
    asked, whole = [], ground.nearest
    monkeypatch.setattr(ground, "nearest", lambda ask, *r: asked.append(ask.count()) or whole(ask, *r))
    a = np.zeros((64, 64))
    a[63, 63], a[60, 2], a[63, 1] = 5.0, 3.0, 4.0
    got = {(r.y, r.x): r.z for r in ground.thinned(frame(spark, a), F.col("z") > 0, 64, 64, 4).collect()}
    valid = [(60, 2), (63, 1), (63, 63)]
    want = {(y // 4, x // 4): a[min(((y - p) ** 2 + (x - q) ** 2, p, q) for p, q in valid)[1:]] for y in range(0, 64, 4) for x in range(0, 64, 4)}
    assert got == want and 0 < asked[0] < len(want)
    a = np.where(np.random.default_rng(2).random((40, 30)) < 0.5, 0.0, 1.0)
    assert ground.thinned(frame(spark, a), F.col("z") > 0, 40, 30, 4).count() == 80 and len(asked) == 1
    corner = spark.createDataFrame([(0, 0, 7.0)], "y int, x int, z double")
    assert [r.d2 for r in whole(spark.createDataFrame([(63, 63)], "y int, x int"), corner, 64, 64).collect()] == [2 * 63 * 63]


def test_ground_keeps_a_plane_and_marks_gaps(spark):
    a = np.fromfunction(lambda y, x: 100 + 0.0 * y, (40, 30))
    a[10:14, 10:14] = 1.0
    got = array(ground.ground(frame(spark, a), 40, 30, 4, 3), (40, 30))
    assert np.allclose(got[a > 1], 100) and (got[a == 1] == ground.NODATA).all()


def test_projection_of_known_places(spark):
    """The northing on a zone's meridian is the arc along it; both ways undo each other."""
    z = geodesy.zone(2950)
    phi = np.linspace(0, math.radians(45.5), 200_001)
    arc = np.trapezoid(geodesy.AXIS * (1 - geodesy.E**2) / (1 - geodesy.E**2 * np.sin(phi) ** 2) ** 1.5, phi)
    x, y = geodesy.to_plane(-73.5, 45.5, z, math)
    assert abs(x - 304800) < 1e-6 and abs(y - 0.9999 * arc) < 1e-3
    assert geodesy.to_degrees(*geodesy.to_plane(-72.3, 47.1, z, math), z, math) == pytest.approx((-72.3, 47.1), abs=1e-9)
    df = spark.createDataFrame([(1, -73.6, 45.5), (2, None, 45.0)], "id int, cx double, cy double")
    out = {r.id: (r.cx, r.cy) for r in geodesy.reproject(df, 4326, 2950).collect()}
    assert out[1] == pytest.approx(geodesy.to_plane(-73.6, 45.5, z, math), abs=1e-3) and out[2][0] is None
    utm = geodesy.reproject(geodesy.reproject(df.where("id = 1"), 4326, 2950, None), 2950, 2959, None).first()
    assert (utm.cx, utm.cy) == pytest.approx(geodesy.to_plane(-73.6, 45.5, geodesy.zone(2959), math), abs=1e-4)
    with pytest.raises(RasterError):
        geodesy.reproject(df, 4326, 1)


def test_raster_reprojection_reads_the_middle_of_each_pixel(spark):
    geo = Geo(12, 9, 2950, 300000.0, 5040000.0, 10.0, -10.0)
    a = np.fromfunction(lambda y, x: y * 100 + x, (12, 9))
    out, to = geodesy.reproject_raster(frame(spark, a), geo, 4326)
    z = geodesy.zone(2950)
    rows = out.collect()
    assert len(rows) > 60 and to.epsg == 4326
    for r in rows:
        x, y = geodesy.to_plane(to.ox + (r.x + 0.5) * to.sx, to.oy + (r.y + 0.5) * to.sy, z, math)
        assert r.z == a[int((y - geo.oy) // geo.sy), int((x - geo.ox) // geo.sx)]


def test_buffered_square(spark):
    square = [(0, 0.0, 0.0), (1, 4.0, 0.0), (2, 4.0, 3.0), (3, 0.0, 3.0)]
    for ring in (square, [(i, *p[1:]) for i, p in enumerate(reversed(square))]):
        out = regions.buffered(spark.createDataFrame([("p", *v) for v in ring], "poly string, idx int, x double, y double"), 2.0, 32)
        pts = [(r.x, r.y) for r in out.orderBy("idx").collect()]
        area = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(pts, pts[1:] + pts[:1], strict=True))) / 2
        assert area == pytest.approx(12 + 2 * 14 + math.pi * 4, rel=2e-3)


def tile_frame(spark, label, z=None, name="t"):
    h, w = label.shape
    z = np.zeros((h, w)) if z is None else z
    rows = [(name, y, x, 10, 20, 30, float(z[y, x]), int(label[y, x]), 1) for y in range(h) for x in range(w)]
    return spark.createDataFrame(rows, "tile string, y int, x int, r int, g int, b int, z double, label int, cls int")


def test_tiles_without_holes_and_small_patches(spark):
    a = np.zeros((12, 14), int)
    a[1:7, 1:7] = 3
    a[3:5, 3:5] = 0  # a hole
    a[0, 10] = 5  # one pixel
    a[8:12, 9:14] = 7
    a[9:12, 10:12] = 0  # open to the edge
    t = tile_frame(spark, a)
    filled = {(r.y, r.x): r.label for r in tiles.without_holes(t).collect()}
    want = a.copy()
    want[3:5, 3:5] = 3
    assert all(filled[y, x] == want[y, x] for y, x in np.ndindex(a.shape))
    kept = {(r.y, r.x): r.label for r in tiles.without_small(t, 1).collect()}
    assert kept[0, 10] == 0 and sum(v == 3 for v in kept.values()) == (a == 3).sum()
    done = {(r.y, r.x): r for r in tiles.preprocess(t, 1).collect()}
    assert done[0, 10].label == done[0, 10].cls == 0 and done[1, 1].r == 0 and done[1, 1].b == 255 and len(done) == a.size


def test_pastable(spark):
    label, low = np.zeros((20, 20), int), np.full((20, 20), 0.1)
    low[:2, :] = 6.0
    label[0, 0] = 1
    many = np.arange(400).reshape(20, 20)
    df = tile_frame(spark, label, low, "flat").unionByName(tile_frame(spark, label, low + 9, "high")).unionByName(tile_frame(spark, many, low, "many")).unionByName(tile_frame(spark, label, None, "empty"))
    assert {r.tile: r.pastable for r in tiles.pastable(df).collect()} == {"flat": True, "high": False, "many": False, "empty": True}


def test_three_groups_of_heights(spark):
    z = np.repeat([1.0, 1.1, 5.0, 5.2, 9.0, 9.1], 20).reshape(10, 12)
    r = tiles.height_groups(tile_frame(spark, np.zeros((10, 12), int), z)).first()
    assert (r.low, r.mid, r.high) == pytest.approx((1.05, 5.1, 9.05))


def test_draws_and_brightness_repeat(spark):
    t = tile_frame(spark, np.ones((6, 6), int))
    loc = tiles.local_tiles(t, 6, 6, ignore_border=False)
    a, b, c = (sorted(map(tuple, tiles.draws(t, loc, 5, 6, 6, seed=s).collect())) for s in (1, 1, 2))
    assert a == b != c and len(a) == 5 and all(0 <= r[3] < 6 and 0.8 <= r[6] <= 1.2 for r in a)
    one, two = (sorted(map(tuple, tiles.brightened(t, 3).collect())) for _ in range(2))
    assert one == two and all(0 <= r[3] <= 255 for r in one)
    small, h, w = tiles.zoomed_local(t.where("y < 4").select("y", "x", "z", "label"), 4, 6, 0.5, 1.0)
    assert (h, w) == (2, 3) and {(r.z, r.label) for r in small.collect()} == {(0.5, 1)}
    assert tiles.channels(t, "depth").first().channels == [0.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        tiles.channels(t, "cmyk")


def test_tops_of_a_cone(spark):
    z = np.fromfunction(lambda y, x: 10 - np.hypot(y - 10, x - 10), (21, 21))
    label = (z > 1).astype(int)
    got = {(r.y, r.x) for r in zonal.tops(frame(spark, label, "label"), frame(spark, z)).collect()}
    lo = z[label == 1].min()
    assert got == {(y, x) for y, x in np.ndindex(z.shape) if label[y, x] and (z[y, x] - lo) / (z.max() - lo) > 0.85}


def city(spark):
    """A lattice of 4 x 4 corners; the middle of the top row of blocks is cut by a lane."""
    rows = []
    for y in range(4):
        for x in range(4):
            n = y * 4 + x
            rows += [(n, n + 1, f"Rue {y}", (x, y), (x + 1, y))] if x < 3 else []
            rows += [(n + 4, n, f"Avenue {x}", (x, y + 1), (x, y))] if y < 3 else []  # one-way streets run either way
    rows.append((100, 101, "Ruelle X", (1.5, 0.2), (1.5, 0.8)))
    data = [(u, v, 0, name, [(float(a[0]) * 100, float(a[1]) * 100), (float(b[0]) * 100, float(b[1]) * 100)]) for u, v, name, a, b in rows]
    return spark.createDataFrame(data, "u int, v int, key int, name string, geometry array<struct<x:double,y:double>>")


def test_city_blocks(spark):
    seeds = spark.createDataFrame([(1, 150.0, 45.0), (2, 152.0, 60.0), (3, 50.0, 250.0), (4, 900.0, 900.0), (5, 350.0, 50.0)], "seed int, x double, y double")
    found = {r.seed: r for r in blocks.around(city(spark), seeds, radius=120.0).collect()}
    assert set(found) == {1, 2, 3}  # 4 has no street near it, 5 lies outside the city
    assert set(found[1].nodes) == {1, 2, 5, 6} and set(found[3].nodes) == {8, 9, 12, 13}
    assert found[1].uuid == found[2].uuid != found[3].uuid and found[1].ring[0] == found[1].ring[-1] and len(found[1].ring) == 5
    z = {r.uuid: (r.area, r.n) for r in blocks.zones(blocks.around(city(spark), seeds, radius=120.0)).collect()}
    assert z == {found[1].uuid: (10_000.0, 2), found[3].uuid: (10_000.0, 1)}
    closed = {r.seed: set(r.nodes) for r in blocks.around(city(spark), seeds.where("seed = 1"), 120.0, skip=["rue 1"]).collect()}
    assert closed[1] == {1, 2, 5, 6, 9, 10}  # without that street two blocks are one
    assert blocks.around(city(spark), seeds.where("seed = 4")).collect() == []


def test_walks_are_searched_once_for_a_street(spark, monkeypatch):
    """Many seeds near one street make no more paths than one seed does; a seed at two places has the block of fewest streets."""
    sizes, whole = {}, blocks.written

    def counted(df):
        out = whole(df)
        if {"node", "ring"} <= set(df.columns):
            sizes[key] = sizes.get(key, 0) + out.count()
        return out

    monkeypatch.setattr(blocks, "written", counted)
    one, many = [(1, 150.0, 45.0)], [(k, 140.0 + k % 20, 30.0 + k % 7) for k in range(300)]
    got = {}
    for key, rows in ((1, one), (300, many)):
        got[key] = blocks.around(city(spark), spark.createDataFrame(rows, "seed int, x double, y double"), 120.0).collect()
    assert sizes[1] == sizes[300] > 0
    assert len(got[300]) == 300 and {r.uuid for r in got[300]} == {got[1][0].uuid}
    twice = spark.createDataFrame([(1, 150.0, 145.0), (1, 150.0, 45.0), (1, 150.0, 45.0)], "seed int, x double, y double")
    closed = [r for r in blocks.around(city(spark).where("name <> 'Rue 2'"), twice, 120.0).collect()]
    assert len(closed) == 1 and set(closed[0].nodes) == {1, 2, 5, 6}


def test_raster_metadata():
    g = Geo(500, 64)
    assert g.center() == (290000.64, 5039995.0) and g.precision() == 2 and g.size() == (1.28, 10.0)
    assert g.ring(True)[0] == g.ring(True)[-1] and len(g.ring()) == 4 and Geo(1, 1, sx=1e-05).precision() == 0


def test_shrinking_reads_few_rows(spark, monkeypatch):
    """Only rows that a target reads are dealt to chunks: the values of the whole, from a bounded part of a long raster."""
    a = np.random.default_rng(9).normal(size=(4000, 5))
    df, dealt = frame(spark, a), []
    whole = halo._dealt
    monkeypatch.setattr(halo, "_dealt", lambda rows, *r: dealt.append(rows.count()) or whole(rows, *r))
    for kind, taps, weight in (("linear", *halo.TAPS["linear"]), ("cubic", *halo.TAPS["cubic"])):
        got = {(r.y, r.x): r.z for r in halo.resize(df, 4000, 5, 10, 8, kind).collect()}
        for ty, tx in np.ndindex(10, 8):
            sy, sx = (ty + 0.5) * (4000 / 10) - 0.5, (tx + 0.5) * (5 / 8) - 0.5
            p, q = int(np.floor(sy)), int(np.floor(sx))
            want = sum(float(weight(np.array(sy - p - i)) * weight(np.array(sx - q - j))) * a[min(max(p + i, 0), 3999), min(max(q + j, 0), 4)] for i in taps for j in taps)
            assert abs(got[ty, tx] - want) < 1e-9
    assert max(dealt) <= 10 * 6 * 5 + 2 * 5


def test_bare_chunks_of_a_turned_raster(spark):
    """Chunks without pixels need no kernel; every place of the canvas comes once."""
    turned, h, w = halo.rotate(frame(spark, np.ones((60, 4))), 60, 4, 45.0, chunk=8)
    rows = turned.collect()
    assert len(rows) == len({(r.y, r.x) for r in rows}) == h * w and 200 < sum(r.z for r in rows) < 280
    assert "LeftAnti" in turned._jdf.queryExecution().toString()


@pytest.mark.parametrize("degrees", [0.0, 30.0, 90.0, 200.0, -33.0])
def test_turned_raster_with_gaps_against_a_plain_loop(spark, degrees):
    """Every place of the canvas comes once: from its chunk, as a chunk beside the raster or far from it, or within a gap of whole chunks."""
    rnd = np.random.default_rng(6)
    a = rnd.normal(size=(50, 6))
    a[rnd.random(a.shape) < 0.3] = np.nan
    a[15:35] = np.nan
    df = frame(spark, a).where(~F.isnan("z"))
    turned, h, w = halo.rotate(df, 50, 6, degrees, chunk=5)
    rows = turned.collect()
    got = {(r.y, r.x): r.z for r in rows}
    assert len(rows) == len(got) == h * w
    c, s = math.cos(math.radians(degrees)), math.sin(math.radians(degrees))
    for y, x in np.ndindex(h, w):
        dy, dx = y - (h - 1) / 2, x - (w - 1) / 2
        sy, sx = dy * c + dx * s + 24.5, dx * c - dy * s + 2.5
        want = 0.0
        if -0.5 <= sy <= 49.5 and -0.5 <= sx <= 5.5:
            for i, j in np.ndindex(2, 2):
                p, q = math.floor(sy) + i, math.floor(sx) + j
                v = a[min(max(p, 0), 49), min(max(q, 0), 5)]
                want += 0.0 if np.isnan(v) else (1 - abs(sy - p)) * (1 - abs(sx - q)) * v
        assert abs(got[y, x] - want) < 1e-9
    assert f"Range (0, {h * w}," in turned._jdf.queryExecution().toString()
