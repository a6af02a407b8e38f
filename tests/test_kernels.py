"""Operators without SQL, against NumPy."""

import numpy as np
import pytest

from terrafold.model import Geo, RasterError
from terrafold.operators import coords, detect, focal, graph, grid, halo, kernels, labels, mapalg, vector
from terrafold.sources import files


def frame(spark, a, name="z"):
    rows = [(int(y), int(x), float(a[y, x]) if name == "z" else int(a[y, x])) for y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"y int, x int, {name} {'double' if name == 'z' else 'int'}")


def array(df, shape, name="z"):
    out = np.zeros(shape)
    for r in df.collect():
        out[r["y"], r["x"]] = r[name]
    return out


def brute_components(a):
    out, todo = np.zeros(a.shape, int), [(y, x) for y, x in np.ndindex(a.shape) if a[y, x]]
    for start in todo:
        if out[start]:
            continue
        stack, mark = [start], start[0] * a.shape[1] + start[1] + 1
        while stack:
            y, x = stack.pop()
            if out[y, x]:
                continue
            out[y, x] = mark
            stack += [(j, i) for j in range(max(0, y - 1), min(a.shape[0], y + 2)) for i in range(max(0, x - 1), min(a.shape[1], x + 2)) if a[j, i] == a[y, x] and not out[j, i]]
    return out


def test_components_across_chunks(spark):
    a = np.random.default_rng(1).integers(0, 3, (20, 23))
    a[10, :] = 1
    df = frame(spark, a, "label").where("label <> 0")
    got = array(kernels.components(df, 23, "label", chunk=6), a.shape, "component")
    assert np.array_equal(np.where(a > 0, got + 1, 0), brute_components(a))


def test_holes_and_small_patches(spark):
    m = np.zeros((9, 9), int)
    m[1:6, 1:6] = 1
    m[2:4, 2:4] = 0
    m[8, 8] = 1
    m[0, 7] = 1
    got = array(kernels.filled(frame(spark, m, "label").where("label = 1"), 9, 9).selectExpr("y", "x", "1 as z"), (9, 9))
    want = m.copy()
    want[2:4, 2:4] = 1
    assert np.array_equal(got, want)
    small = array(kernels.without_small(frame(spark, m, "label"), 9, 1), (9, 9), "label")
    assert small.sum() == m.sum() - 2
    assert array(kernels.biggest(frame(spark, m, "label"), 9), (9, 9), "label").sum() == m.sum() - 2


def test_interpolation_reproduces_planes(spark):
    y, x = np.indices((12, 10))
    plane = 2.0 * y - 0.5 * x
    got = array(halo.resize(frame(spark, plane), 12, 10, 24, 20), (24, 20))
    sy, sx = (np.indices((24, 20)) + 0.5) / 2 - 0.5
    assert np.allclose(got[2:-2, 2:-2], (2.0 * sy - 0.5 * sx)[2:-2, 2:-2])
    assert np.allclose(array(halo.resize(frame(spark, plane), 12, 10, 12, 10, "cubic"), (12, 10)), plane)
    assert np.allclose(array(halo.resize(frame(spark, np.full((5, 5), 2.0)), 5, 5, 9, 7, "cubic"), (9, 7)), 2.0)
    turned, h, w = halo.rotate(frame(spark, plane), 12, 10, 90.0)
    assert (h, w) == (10, 12) and np.allclose(array(turned, (h, w)), np.rot90(plane))


def test_blur_keeps_a_constant(spark):
    assert np.allclose(array(halo.blur(frame(spark, np.full((6, 7), 3.0)), 6, 7, 1.0), (6, 7)), 3.0)


def test_morphology(spark):
    m = np.random.default_rng(2).random((14, 15)) < 0.55
    df = frame(spark, m.astype(int), "label").where("label = 1").select("y", "x")
    for r in (1, 2):
        want = {(y, x) for y, x in np.ndindex(m.shape) if any(0 <= y + a < 14 and 0 <= x + b < 15 and m[y + a, x + b] for a, b in focal.disk(r))}
        assert {(p.y, p.x) for p in focal.dilate(df, 14, 15, r).collect()} == want
        want = {(y, x) for y, x in np.ndindex(m.shape) if all(m[y + a, x + b] for a, b in focal.disk(r) if 0 <= y + a < 14 and 0 <= x + b < 15)}
        assert {(p.y, p.x) for p in focal.erode(df, 14, 15, r).collect()} == want


def test_suppression_drops_at_the_threshold(spark):
    rows = [(1, "a", 0.0, 0.0, 2.0, 1.0, 0.9), (1, "b", 1.0, 0.0, 3.0, 1.0, 0.8), (1, "c", 0.0, 0.0, 3.0, 1.0, 0.7), (1, "d", 10.0, 0.0, 11.0, 1.0, 0.1), (2, "e", 0.0, 0.0, 1.0, 1.0, 0.5)]
    df = spark.createDataFrame(rows, "image int, det_id string, xmin double, ymin double, xmax double, ymax double, score double")
    assert sorted(r.det_id for r in detect.suppress(df, 2 / 3).collect()) == ["a", "b", "d", "e"]
    assert detect.suppress(df.limit(0)).collect() == []


def test_hull_and_chord(spark):
    m = np.zeros((8, 8), int)
    m[2:6, 1:7] = 4
    got = [(r.y, r.x) for r in kernels.hulls(frame(spark, m, "label")).orderBy("idx").collect()]
    assert sorted(got) == [(2, 1), (2, 6), (5, 1), (5, 6)]
    from pyspark.sql import functions as F

    half = spark.range(1).select(coords.chord(F.lit(5000.0), F.lit(5000.0)).alias("c")).first().c
    assert half == round(2 * np.sqrt(10000 / np.pi))


def test_loops(spark):
    edges = spark.createDataFrame([(u, v) for a, b in ((1, 2), (2, 3), (3, 4), (4, 1), (2, 5)) for u, v in ((a, b), (b, a))], "u int, v int")
    assert sorted(r.path for r in graph.loops(edges, 1, 4).collect()) == [[1, 2, 3, 4], [1, 4, 3, 2]]


def test_patches_and_errors():
    assert grid.patch_starts(100, 100) == [0] and grid.patch_starts(64, 32, 0.5) == [0, 16, 32]
    with pytest.raises(RasterError):
        grid.patch_starts(10, 20)
    with pytest.raises(RasterError):
        Geo(3, 3).require_same_grid(Geo(3, 4))
    with pytest.raises(RasterError):
        Geo(3, 3, epsg=4326).translated(1, 1)
    with pytest.raises(RasterError):
        labels.replace_values(None, [1], [])
    with pytest.raises(ValueError):
        mapalg.channels(None, "xyz")


def test_files(spark, tmp_path):
    a = np.arange(12, dtype=np.uint16).reshape(3, 4)
    np.savez_compressed(tmp_path / "a.npz", arr_0=a)
    df = files.read_npz(spark, str(tmp_path / "a.npz"))
    assert np.array_equal(array(df, (3, 4)), a)
    raw = files.to_npz(df, "path").first().content
    (tmp_path / "b.npz").write_bytes(bytes(raw))
    assert np.array_equal(np.load(tmp_path / "b.npz")["arr_0"], a)
    square = spark.createDataFrame([(0, 0.0, 0.0), (1, 2.0, 0.0), (2, 2.0, 2.0)], "idx int, x double, y double")
    lines = [r.line for r in files.polygon_lines(square, 2950, {"uuid": "u"}).orderBy("seq").collect()]
    (tmp_path / "p.csv").write_text("\n".join(lines))
    rows, meta = files.read_polygons(spark, str(tmp_path / "p.csv"))
    assert [(r.x, r.y) for r in rows.orderBy("idx").collect()] == [(0.0, 0.0), (2.0, 0.0), (2.0, 2.0)]
    assert {r.key: r.value for r in meta.collect()} == {"uuid": "u", "epsg": "2950"}
    (tmp_path / "m.obj").write_text("o t\nv 0 1 2.5\nf 1 2 3\n")
    v, f = files.read_obj(spark, str(tmp_path / "m.obj"))
    assert v.first().z == 2.5 and f.first().c == 3


def test_resampling_rows_of_large_rasters(spark):
    """v * new passes 2**31 from 46,341 rows on."""
    df = spark.createDataFrame([(y, 3) for y in (0, 59_999)], "y int, x int")
    assert sorted((r.y, r.x) for r in grid.resize_nearest(df, 60_000, 10, 60_000, 10).collect()) == [(0, 3), (59_999, 3)]
    assert all(0 < r.y < 59_999 for r in grid.shrink(df, 60_000, 10).collect())


def test_resampling_leaves_the_raster_to_no_target_outside(spark):
    """Rows that are numbered with gaps lie beyond a raster of as many rows; no target there reads them."""
    df = spark.createDataFrame([(y, x) for y in (-4, -1, 0, 9, 10, 14, 40) for x in (-1, 0, 5, 9)], "y int, x int")
    targets = lambda d: sorted((r.y, r.x) for r in d.collect())
    assert targets(grid.resize_nearest(df, 10, 6, 20, 6)) == [(y, x) for y in (0, 1, 18, 19) for x in (0, 5)]
    want = [(i, j) for i in range(10) for j in range(10) if i * 12 // 10 - 1 in (-4, -1, 0, 9, 10, 14, 40) and j * 12 // 10 - 1 in (-1, 0, 5, 9)]
    assert targets(grid.shrink(df, 10, 10)) == want


def test_patches_of_long_rasters(spark):
    """As many rows as patches cover a pixel, without a list of all patches in the plan."""
    h, size = 50_000, 32
    df = spark.createDataFrame([(y, x, 1.0) for y in (0, 23, 24, 31, 32, 24_990, 49_998, 49_999) for x in (0, 16, 63)], "y int, x int, z double")
    patches = grid.sliding_patches(df, h, 64, size)
    got = sorted((r.py, r.px, r.y, r.x) for r in patches.collect())
    want = sorted((p, q, r.y - p, r.x - q) for r in df.collect() for p in grid.patch_starts(h, size) if p <= r.y < p + size for q in grid.patch_starts(64, size) if q <= r.x < q + size)
    assert got == want and len(patches._jdf.queryExecution().toString()) < 20_000


def test_points_inside_meet_polygons_about_them(spark):
    """A polygon far to the right has no part in a point's parity, and no pair with it."""
    ring = [(0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)]
    verts = spark.createDataFrame([(p, i, p * 10.0 + dx * 3, dy * 3.0) for p in range(300) for i, dx, dy in ring], "poly int, idx int, x double, y double")
    points = spark.createDataFrame([(k, k * 1.0, 0.0) for k in range(50)], "pid int, x double, y double")
    inside = vector.points_inside(verts, points, 10.0)
    assert {(r.poly, r.pid) for r in inside.collect()} == {(p, k) for p in range(300) for k in range(50) if p * 10 - 3 <= k < p * 10 + 3}
    assert "_col" in inside._jdf.queryExecution().analyzed().toString()
