"""Rings, outlines, simplified rings and loose streets, against walks one by one."""

import random

import numpy as np
import pytest

from terrafold.operators import chains, graph


def labels(spark, a):
    return spark.createDataFrame([(int(y), int(x), int(a[y, x])) for y, x in np.ndindex(a.shape)], "y int, x int, label int")


def areas(df):
    """label -> list of signed areas of its rings."""
    rings, out = {}, {}
    for r in sorted(df.collect(), key=lambda r: r.seq):
        rings.setdefault((r.label, r.ring_y, r.ring_x, r.ring_dir), []).append((r.y, r.x))
    for (label, *_), p in rings.items():
        out.setdefault(label, []).append(sum(x0 * y1 - x1 * y0 for (y0, x0), (y1, x1) in zip(p, p[1:] + p[:1], strict=True)) / 2)
    return out


def test_rings_of_any_length(spark):
    pairs, want, start = [], {}, 0
    for n in (1, 2, 3, 5, 8, 31, 64):
        ids = list(range(start, start + n))
        random.Random(n).shuffle(ids)
        pairs += list(zip(ids, ids[1:] + ids[:1], strict=True))
        at = ids.index(start)
        want |= {k: (start, (i - at) % n, n) for i, k in enumerate(ids)}
        start += n
    got = {r.id: (r.head, r.seq, r.n) for r in chains.rings(spark.createDataFrame(pairs, "id long, next long")).collect()}
    assert got == want
    assert chains.rings(spark.createDataFrame([], "id long, next long")).count() == 0


def test_outlines_of_a_hole_and_a_bridge(spark):
    a = np.zeros((9, 9), int)
    a[0:5, 0:5] = 1
    a[1:3, 1:3] = 0
    a[3, 3] = 0  # touches the hole at a corner only
    a[5, 5] = 1  # touches the block at a corner only
    a[5:8, 6:9] = 2
    df = labels(spark, a)
    got = areas(chains.outlines(df))
    assert sorted(got[1]) == [-4, -1, 21 + 5] and got[2] == [9]
    assert sorted(areas(chains.outlines(df, diagonal=False))[1]) == [-5, 1, 25]
    first = {(r.hole, r.ring_y, r.ring_x) for r in chains.outlines(df).where("label = 1").collect()}
    assert first == {(False, 0, 0), (True, 1, 1), (True, 3, 3)}


def test_outlines_of_noise_enclose_the_pixels(spark):
    a = np.random.default_rng(3).integers(0, 4, (30, 30))
    got = areas(chains.outlines(labels(spark, a)))
    assert {k: sum(v) for k, v in got.items()} == {k: (a == k).sum() for k in (1, 2, 3)}


def test_outlines_by_image_and_of_nothing(spark):
    df = spark.createDataFrame([("a", 0, 0, 1), ("b", 0, 1, 1), ("b", 7, 7, None), ("b", 8, 8, 0)], "image string, y int, x int, label int")
    got = chains.outlines(df, ("image",)).orderBy("image", "seq").collect()
    assert [(r.image, r.y, r.x) for r in got] == [("a", 0, 0), ("a", 0, 1), ("a", 1, 1), ("a", 1, 0), ("b", 0, 1), ("b", 0, 2), ("b", 1, 2), ("b", 1, 1)]
    assert chains.outlines(df.where("label = 9"), ("image",)).count() == 0


def test_simplified_keeps_the_number_asked(spark):
    yy, xx = np.indices((40, 40))
    a = ((yy - 20) ** 2 + (xx - 20) ** 2 < 300).astype(int)
    a[0:2, 0:2] = 2
    corners = chains.outlines(labels(spark, a))
    kept = chains.simplified(corners, 12)
    n = {k: [r.n for r in kept.where(f"label = {k}").collect()] for k in (1, 2)}
    assert n == {1: [12] * 12, 2: [4] * 4}
    assert abs(areas(kept)[1][0] - (a == 1).sum()) < 0.06 * (a == 1).sum()
    assert {(r.y, r.x) for r in kept.collect()} <= {(r.y, r.x) for r in corners.collect()}
    with pytest.raises(ValueError):
        chains.simplified(corners, 2)
    shape = {r.label: r.contour for r in chains.contours(kept).collect()}
    assert len(shape[1]) == 12 and [(p.y, p.x) for p in shape[2]] == [(0, 0), (0, 2), (2, 2), (2, 0)]


def walk(edges):
    """The reference walk: the first edge, then ever the one that has the node searched for."""
    edges = list(edges)
    e, u, v = edges.pop(0)
    out = [(e, u, v)]
    while edges:
        i = next(i for i, (_, a, b) in enumerate(edges) if v in (a, b))
        e, a, b = edges.pop(i)
        u, v = v, b if a == v else a
        out.append((e, u, v))
    return out


def test_closed_streets_as_walked_one_by_one(spark):
    rng, rows, want = random.Random(5), [], {}
    for path in range(40):
        n = rng.randint(3, 30)
        nodes = rng.sample(range(10_000), n)
        loose = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in zip(nodes, nodes[1:] + nodes[:1], strict=True)]
        rng.shuffle(loose)
        edges = [(i, u, v) for i, (u, v) in enumerate(loose)]
        want[path] = walk(edges)
        rows += [(path, *e) for e in edges]
    rng.shuffle(rows)
    got = {}
    for r in sorted(chains.ordered(spark.createDataFrame(rows, "path int, edge int, u int, v int")).collect(), key=lambda r: r.seq):
        assert r.closed and r.chain == 0 and r.n == len(want[r.path])
        got.setdefault(r.path, []).append((r.edge, r.u, r.v))
    assert got == want


def test_streets_that_branch_end_or_lack_a_node(spark):
    rows = [
        (1, 0, 5, 2), (1, 1, 2, 9), (1, 2, 9, 7), (1, 3, 9, 8), (1, 4, 8, 3),  # three chains meet at 9
        (2, 0, 4, 4),  # a loop of one edge
        (3, 0, 1, 2), (3, 1, 2, 1),  # two edges of the same nodes
        (4, 0, 1, None), (4, 1, 2, 1), (None, 0, 1, 2), (None, 1, 2, 3),
    ]
    walked = chains.ordered(spark.createDataFrame(rows, "path int, edge int, u int, v int"))
    got = {(r.path, r.edge): (r.chain, r.closed, r.seq, r.u, r.v) for r in walked.collect()}
    assert got[1, 0] == (0, False, 0, 5, 2) and got[1, 1] == (0, False, 1, 2, 9)
    assert got[1, 2] == (2, False, 0, 7, 9) and got[1, 3] == (4, False, 1, 8, 9) and got[1, 4] == (4, False, 0, 3, 8)
    assert got[2, 0] == (0, True, 0, 4, 4)
    assert [got[3, e] for e in (0, 1)] == [(0, True, 0, 1, 2), (0, True, 1, 2, 1)]
    assert len(got) == len(rows) and {got[4, 0][0], got[4, 1][0]} in ({0}, {1}) and got[None, 0][:3] == (0, False, 0)
    nodes = {}
    for r in sorted(chains.walked_nodes(walked).where("path = 1").collect(), key=lambda r: r.seq):
        nodes.setdefault(r.chain, []).append(r.node)
    assert nodes == {0: [5, 2, 9], 2: [7, 9], 4: [3, 8, 9]}


def test_points_of_a_walk(spark):
    line = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(1, 0, 1, 2, line((0, 0), (1, 0), (2, 0))), (1, 1, 3, 2, line((2, 2), (2, 1), (2, 0))), (1, 2, 3, 4, None), (2, 0, 1, 1, line((0, 0), (5, 5), (0, 0)))]
    walked = chains.ordered(spark.createDataFrame(rows, "path int, edge int, u int, v int, geometry array<struct<x: double, y: double>>"))

    def points(path, close):
        return [(r.x, r.y) for r in chains.walked_points(walked, close).where(f"path = {path}").orderBy("seq", "pos").collect()]

    assert points(1, False) == [(0, 0), (1, 0), (2, 0), (2, 1), (2, 2)]
    assert points(1, True) == [*points(1, False), (0, 0)] and points(2, True) == [(0, 0), (5, 5), (0, 0)]


@pytest.mark.parametrize("tolerance", [0.0, 0.5, 3.0])
def test_edges_at_points_against_all_pairs(spark, tolerance):
    rng = random.Random(9)
    at = lambda: (rng.randint(-12, 12) / 2, rng.randint(-12, 12) / 2)
    edges = [(i, i + 1, 0, [at() for _ in range(rng.randint(1, 3))]) for i in range(60)] + [(90, 91, 0, []), (92, 93, 0, None)]
    points = [(i, *at()) for i in range(40)] + [(99, None, 1.0)]
    got = graph.at_points(
        spark.createDataFrame(edges, "u int, v int, key int, geometry array<struct<x: double, y: double>>"), spark.createDataFrame(points, "pid int, x double, y double"), tolerance
    ).collect()
    close = lambda p, x, y: ((p[0] - x) ** 2 + (p[1] - y) ** 2) ** 0.5 <= tolerance
    want = {(pid, u, v, k) for pid, x, y in points if x is not None for u, v, k, g in edges if g and (close(g[0], x, y) or close(g[-1], x, y))}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    with pytest.raises(ValueError):
        graph.at_points(None, None, -1.0)


def test_paths_one_by_one_as_by_doubling(spark, monkeypatch):
    """Random graphs with branches, rings, loops, null nodes and paths cut by batches: the same rows either way, none by doubling unless long."""
    rng, rows = random.Random(11), []
    for path in [None, *range(60)]:
        nodes = [None, *range(rng.randint(2, 12))]
        rows += [(path, e, rng.choice(nodes), rng.choice(nodes), e * 2) for e in range(rng.randint(1, 14))]
    df = spark.createDataFrame(rows, "path int, edge int, u int, v int, more int")
    key = lambda d: sorted(map(tuple, d.collect()), key=repr)
    want = chains._by_doubling(df)
    names = want.columns
    slow = key(want)
    text = df.withColumns({c: df[c].cast("string") for c in ("u", "v")})
    monkeypatch.setattr(chains, "MOST", 8)
    assert key(chains.ordered(df).select(*names)) == slow
    assert key(chains.ordered(text).select(*names)) == key(chains._by_doubling(text))
    monkeypatch.undo()
    monkeypatch.setattr(chains, "rings", None)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        fast = chains.ordered(df)
        assert fast.columns == names and fast.dtypes == want.dtypes and key(fast) == slow
        assert chains.ordered(df.limit(0)).collect() == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
