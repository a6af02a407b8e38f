"""Trees, seams, file sources and whole jobs on hand-made rasters."""

import math
from collections import Counter

import numpy as np
import pytest
from test_kernels import array, frame
from test_surfaces import city, sparse

from terrafold.model import Geo, RasterError
from terrafold.operators import jobs, labels, seams, trees
from terrafold.sources import files


def cone(h, w, cy, cx, r, top):
    d = np.hypot(*(np.indices((h, w)) - np.array([cy, cx])[:, None, None]))
    return np.where(d < r, top * (1 - d / r), 0.0), d < r


def test_hull_and_polygon():
    square = np.array([(y, x) for y in range(5) for x in range(5)])
    assert sorted(map(tuple, trees.hull(square))) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert len(trees.polygon(trees.hull(square), 8)) == 8 and len(trees.polygon(trees.hull(square), 3)) == 3
    disk = np.argwhere(cone(41, 41, 20, 20, 18, 1)[1])
    ring = trees.polygon(trees.hull(disk), 8)
    assert len(ring) == 8 and (np.hypot(*(ring - 20).T) > 15).all()


def test_triangles_cover_a_hull():
    pts = np.random.default_rng(2).random((12, 2))
    area = lambda p: abs((p[1] - p[0])[0] * (p[2] - p[0])[1] - (p[1] - p[0])[1] * (p[2] - p[0])[0]) / 2
    ring = trees.hull(pts)
    whole = abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, np.roll(ring, -1, axis=0), strict=True))) / 2
    assert sum(area(pts[list(t)]) for t in trees.triangles(pts)) == pytest.approx(whole)


def test_ring_heights():
    assert trees.ring_heights(10, 7) == (10, 7, 4, 2.5)
    assert trees.ring_heights(10, 9) == (10, 9, 3.0, 2.5)  # clear of the ground


@pytest.fixture(scope="module")
def grove(spark):
    h, w = 90, 120
    a, ma = cone(h, w, 40, 30, 24, 9.0)
    b, mb = cone(h, w, 45, 85, 20, 6.0)
    z, label = a + b, ma * 1 + mb * 2
    label[80:84, 5:9] = 3  # small
    label[0:12, 100:118] = 4  # at the image's edge
    z[label >= 3] = 8.0
    alpha = np.full((h, w), 255)
    alpha[0] = 0
    a_frame = frame(spark, alpha, "label").withColumnRenamed("label", "a")
    return frame(spark, label, "label"), frame(spark, z), frame(spark, np.full((h, w), 31.5)), a_frame, Geo(h, w, 2950, 1000.0, 2000.0, 0.1, -0.1)


def test_tree_models(spark, grove):
    label, z, terrain, alpha, geo = grove
    lines, meta = jobs.tree_models(label, z, terrain, alpha, geo, "u", 3.0, 0.5)
    m = {r.name: r for r in meta.collect()}
    assert set(m) == {"u_1", "u_2"} and m["u_1"].origin_z == m["u_1"].elevation_offset == 31.5
    assert m["u_1"].crown_height == pytest.approx(9.0, abs=0.01) and m["u_1"].area == pytest.approx(math.pi * 2.4**2, rel=0.02)
    assert (m["u_2"].origin_x, m["u_2"].origin_y) == pytest.approx((1008.5, 1995.5), abs=0.3)
    rows = lines.orderBy("section", "seq").collect()
    text = [r.line for r in rows]
    v = [tuple(map(float, t.split()[1:])) for t in text if t.startswith("v ")]
    faces = [tuple(map(int, t.split()[1:])) for t in text if t.startswith("f ")]
    assert len(v) == len(set(v)) == 48 and len(faces) == 88 and text[48:51] == ["o u_1", "o SolitaryVegetationObject", "g lod_cfd"]
    edges = Counter(tuple(sorted(e)) for a, b, c in faces for e in ((a, b), (b, c), (a, c)))
    assert set(edges.values()) == {2}  # closed
    assert max(p[2] for p in v) == pytest.approx(31.5 + 9.0, abs=0.01) and min(p[2] for p in v) >= 31.5
    assert jobs.tree_models(label.limit(0), z, terrain, alpha, geo, "u")[1].collect() == []


def test_thin_line():
    m = np.zeros((9, 20), bool)
    m[2:7, 2:18] = True
    t = seams.thin(m)
    assert 8 <= t.sum() <= 16 and not (t & ~m).any() and t.sum(axis=0).max() <= 3


def test_seam_of_half_disks(spark):
    """A disk cut in two is one again; an instance that only touches the seam stays, as does one whose part is far smaller."""
    h, w = 40, 60
    whole = np.zeros((2 * h, w), int)
    whole[cone(2 * h, w, h - 0.5, 20, 14, 1)[1]] = 5
    whole[2:6, 40:50] = 7
    whole[h - 8 : h, 50:53] = 9
    top, bottom = whole[:h], whole[h:].copy()
    bottom[bottom == 5] = 3
    bottom[:30, 54:60] = 4
    out = array(seams.combine(frame(spark, top, "label"), frame(spark, bottom, "label"), h, "y", reach=3), (2 * h, w), "label")
    disk = whole == 5
    assert len(np.unique(out[disk])) == 1 and (out == out[20 + 15, 20]).sum() >= disk.sum()
    assert set(np.unique(out)) == set(range(5)) and out[3, 45] != out[h - 2, 51]
    side = array(seams.combine(frame(spark, top.T, "label"), frame(spark, bottom.T, "label"), h, "x", reach=3), (w, 2 * h), "label")
    assert np.array_equal(side.T > 0, out > 0)
    quarters = [frame(spark, q, "label") for q in (whole[:h, :30], whole[:h, 30:], bottom[:, :30], bottom[:, 30:])]
    four = array(seams.combine_four(quarters, h, 30, reach=3), (2 * h, w), "label")
    assert len(np.unique(four[disk & (np.indices(disk.shape)[1] < 30)])) == 1


def test_relabel_over_parts(spark):
    a = np.random.default_rng(3).choice([0, 7, 19, 400, 23], (12, 12))
    got = array(labels.relabel(frame(spark, a, "label")), a.shape, "label")
    assert np.array_equal(got, np.searchsorted(np.array([0, 7, 19, 23, 400]), a))


def test_height_model(spark):
    geo = Geo(12, 10)
    dsm, dtm = np.full((12, 10), 50.0), np.full((12, 10), 45.0)
    dtm[3, 3] = 1.0
    out, _ = jobs.height_model(frame(spark, dsm), geo, frame(spark, dtm), geo, correct=True, step=2)
    z = array(out, (12, 10))
    assert z[3, 3] == 0 and (np.delete(z.ravel(), 33) == 5).all()
    big, to = jobs.height_model(frame(spark, dsm), geo, frame(spark, np.full((6, 5), 45.0)), Geo(6, 5), like=Geo(24, 20))
    assert (to.h, to.w) == (24, 20) and np.allclose(array(big, (24, 20)), 5)
    with pytest.raises(RasterError):
        jobs.height_model(frame(spark, dsm), geo, frame(spark, dtm), Geo(6, 5))
    half, to = jobs.rescaled(frame(spark, dsm), geo, 0.04)
    assert (to.h, to.w, to.sx) == (6, 5, 0.04) and half.count() == 30


def test_tiles_of_an_image(spark):
    geo = Geo(100, 80, 2950, 1000.0, 2000.0, 1.0, -1.0)
    alpha = np.full((100, 80), 255)
    alpha[:, :15] = 0
    a = frame(spark, alpha, "label").withColumnRenamed("label", "a")
    found = jobs.valid_tiles(a, geo, 20.0, 5)
    rows = {(r.y0, r.x0): r for r in found.collect()}
    assert set(rows) == {(20, 40), (40, 40), (60, 40)} or set(rows) <= {(y, x) for y in (20, 40, 60) for x in (20, 40)} and rows
    assert all(r.distance >= 14.28 and r.ratio == 1.0 for r in rows.values())
    cut = jobs.cut_tiles(frame(spark, alpha.astype(float)), found, 20.0, geo, "2024-05-01")
    one = cut.groupBy("tile").count().collect()
    assert {r["count"] for r in one} == {400} and all(r.tile.startswith("20_10") and "(2024-05-01)" in r.tile for r in one)
    with pytest.raises(RasterError):
        jobs.valid_tiles(a, Geo(100, 80, 4326), 20.0, 5)


def test_zones_and_their_crops(spark):
    geo = Geo(400, 400, 2950, -20.0, 340.0, 1.0, -1.0)
    zones = jobs.city_zones(city(spark), geo, 5, 130.0, safe=5.0)
    rows = zones.collect()
    assert len(rows) >= 3 and all(r.area >= 2500 for r in rows)
    assert jobs.city_zones(city(spark), geo, 5, 130.0, safe=200.0).count() == 0
    one = zones.orderBy("uuid").limit(1)
    a = np.ones((400, 400))
    cut = jobs.crop_zones(frame(spark, a), one, geo, dilate=10.0).groupBy("poly").agg({"z": "sum", "y": "max"}).collect()[0]
    area = one.collect()[0].area
    assert area * 1.2 < cut["sum(z)"] < area * 1.6
    moved, to = jobs.registration((100.0, 50.0), (103.26, 48.0), geo)
    assert moved == (3.3, -2.0) and (to.ox, to.oy) == (-16.7, 338.0)


def test_file_sources(spark, tmp_path):
    rows = [("a", y, x, float(y * x)) for y in range(3) for x in range(4)] + [("b", 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "tile string, y int, x int, z double")
    files.write_tiles(df, str(tmp_path / "tiles"))
    back = files.read_tiles(spark, str(tmp_path / "tiles"))
    assert back.where("tile = 'a'").count() == 12 and "PartitionFilters: [isnotnull(tile" in back.where("tile = 'a'")._jdf.queryExecution().executedPlan().toString()
    (tmp_path / "points").mkdir()
    (tmp_path / "points" / "t 1.csv").write_text("axis-0,axis-1,code\n1.7,2.2,PRO\n3.0,4.0,STA\n")
    assert [tuple(r) for r in files.read_points(spark, str(tmp_path / "points")).orderBy("row_id").select("tile", "y", "x", "code").collect()] == [("t 1", 1, 2, "PRO"), ("t 1", 3, 4, "STA")]
    (tmp_path / "move.csv").write_text("x,y\n1.5,-2.5\n9,9\n")
    assert files.read_translation(spark, str(tmp_path / "move.csv")) == (1.5, -2.5)
    np.savez_compressed(tmp_path / "m.npz", data=np.zeros(2), metadata='{"a": 1}')
    np.savez_compressed(tmp_path / "n.npz", data=np.zeros(2))
    assert sorted((r.metadata or "", r.type or "") for r in files.read_npz_metadata(spark, str(tmp_path / "*.npz")).collect()) == [("", ""), ('{"a": 1}', "map")]
    assert files.json_lines(spark.createDataFrame([("k", 1, None)], "name string, n int, s string"), "name").first().json == '{"n":1,"s":null}'
    lines = spark.createDataFrame([(1, 1, "f 1 2 3"), (0, 2, "v 2"), (0, 1, "v 1")], "section int, seq int, line string")
    files.mesh_text(lines, str(tmp_path / "mesh"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "mesh").glob("part-*")))
    assert text == "v 1\nv 2\nf 1 2 3\n"
    assert sparse(spark, np.eye(3, dtype=bool)).count() == 3
