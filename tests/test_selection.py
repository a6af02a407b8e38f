"""Suppression in rounds and exact splits against plain loops."""

import hashlib
import random

from terrafold.operators import detect, linked, semantics
from terrafold.plans.library import box_iou_pairs

BOX = "image int, det_id string, xmin double, ymin double, xmax double, ymax double, score double"


def greedy(items, over):
    kept = []
    for x in sorted((i for i in items if i["score"] is not None), key=lambda i: (-i["score"], i["id"])):
        if not any(over(x, y) for y in kept):
            kept.append(x)
    return {(x["image"], x["id"]) for x in kept}


def test_boxes_in_long_chains(spark):
    """Boxes that overlap their neighbours in a row, in falling order of score: each second one stays; others at random, with ties."""
    rnd = random.Random(1)
    rows = [(0, f"c{i:03}", i * 1.0, 0.0, i + 2.0, 1.0, 100.0 - i) for i in range(15)]
    rows += [(1 + i % 3, f"r{i:03}", x := rnd.randint(0, 90) / 1.0, y := rnd.randint(0, 20) / 1.0, x + rnd.randint(0, 30), y + rnd.randint(1, 9), rnd.choice([None, 0.5, 0.5, 0.7, 0.9])) for i in range(160)]

    def over(p, q):
        (a, b, c, d), (e, f, g, h) = p["box"], q["box"]
        both = max(0, min(c, g) - max(a, e)) * max(0, min(d, h) - max(b, f))
        return p["image"] == q["image"] and both > 0 and both >= 0.3 * ((c - a) * (d - b) + (g - e) * (h - f) - both)

    want = greedy([{"image": r[0], "id": r[1], "box": r[2:6], "score": r[6]} for r in rows], over)
    df = spark.createDataFrame(rows, BOX)
    assert {(r.image, r.det_id) for r in detect.suppress(df, 0.3, cell=8.0).collect()} == want
    assert sum(i == 0 for i, _ in want) == 8


def test_masks(spark):
    rnd = random.Random(2)
    masks = {(i % 2, k): {(rnd.randint(0, 5), rnd.randint(0, 5)) for _ in range(rnd.randint(1, 25))} for i in range(2) for k in range(i, 60, 2)}
    scores = [(i, k, rnd.choice([None, 0.1, 0.2, 0.3]), "more") for i, k in masks] + [(0, 999, 0.9, "empty")]
    items = [{"image": i, "id": k, "score": s} for i, k, s, _ in scores]
    of = lambda x: masks.get((x["image"], x["id"]), set())
    over = lambda p, q: p["image"] == q["image"] and bool(of(p) & of(q)) and len(of(p) & of(q)) >= 0.3 * len(of(p) | of(q))
    pixels = spark.createDataFrame([(i, k, y, x) for (i, k), m in masks.items() for y, x in m], "image int, mask int, y int, x int")
    found = detect.suppress_masks(pixels, spark.createDataFrame(scores, "image int, mask int, score double, note string"), 0.3)
    assert found.columns == ["image", "mask", "score", "note"]
    assert {(r.image, r.mask) for r in found.collect()} == greedy(items, over)
    assert detect.suppress_masks(pixels.limit(0), found.limit(0)).collect() == []


def test_splits_meet_their_ratio(spark):
    for n, ratio in ((1, 0.8), (7, 0.5), (1003, 0.8), (50, 0.0), (50, 1.0)):
        names = [f"n{i}" for i in range(n)]
        df = spark.createDataFrame([(x, i) for x in names for i in range(2)], "name string, part int")
        got = {(r.name, r.part) for r in semantics.split_exactly(df, "name", ratio, 3).collect()}
        by_hash = sorted(names, key=lambda x: int(hashlib.md5(f"3:{x}".encode()).hexdigest()[:15], 16))
        assert got == {(x, "train" if k < int(n * ratio) else "val") for k, x in enumerate(by_hash)}
    none = spark.createDataFrame([(None, 1), ("a", 2)], "name string, x int")
    assert sorted(r.part for r in semantics.split_exactly(none, "name", 0.5).collect()) == ["train", "val"]
    assert semantics.split_exactly(none.limit(0), "name").collect() == []


def test_written_tables_hold_what_they_were_given(spark):
    rows = [(1, "a", [1, 2]), (1, "a", [1, 2]), (None, None, None), (3, "", [])]
    df = spark.createDataFrame(rows, "id long, name string, items array<long>").repartition(3)
    for n in (None, 4):
        out = linked.written(df, n)
        assert out.dtypes == df.dtypes and sorted(map(tuple, out.collect()), key=repr) == sorted(rows, key=repr)
    assert linked.written(df.where("id > 3")).collect() == linked.written(df.where("id > 3"), 0).collect() == []


def crowd(rnd, n):
    """n boxes of one image, whole numbers, with ties of score and copies of a place."""
    return [(7, f"d{i:05}", x := rnd.randint(0, 99), y := rnd.randint(0, 99), x + (s := rnd.randint(1, 50)), y + s, rnd.randint(0, 10) / 10) for i in range(n)]


def test_crowded_images_list_no_pairs(spark, monkeypatch):
    """Boxes and masks by thousands in an image, more than a chunk holds: the greedy result, without a table of overlaps."""
    rows = crowd(random.Random(3), 3000)
    df = spark.createDataFrame(rows, "image int, det_id string, xmin int, ymin int, xmax int, ymax int, score double")

    def over(p, q):
        (a, b, c, d), (e, f, g, h) = p["box"], q["box"]
        both = max(0, min(c, g) - max(a, e)) * max(0, min(d, h) - max(b, f))
        return both > 0 and both >= 0.5 * ((c - a) * (d - b) + (g - e) * (h - f) - both)

    items = [{"image": r[0], "id": r[1], "box": r[2:6], "score": r[6]} for r in rows]
    touched = [{(y, x) for y in range(r[3] // 10, r[5] // 10 + 1) for x in range(r[2] // 10, r[4] // 10 + 1)} for r in rows]
    for i, m in zip(items, touched, strict=True):
        i["cells"] = m
    alike = lambda p, q: bool(p["cells"] & q["cells"]) and len(p["cells"] & q["cells"]) >= 0.4 * len(p["cells"] | q["cells"])
    pixels = spark.createDataFrame([(7, r[1], y, x) for r, m in zip(rows, touched, strict=True) for y, x in m], "image int, mask string, y int, x int")
    scores = df.select("image", df.det_id.alias("mask"), "score")
    boxes, masks = greedy(items, over), greedy(items, alike)
    with monkeypatch.context() as m:
        m.setattr(detect, "suppressed", None)
        assert {(r.image, r.det_id) for r in detect.suppress(df).collect()} == boxes
        assert {(r.image, r.mask) for r in detect.suppress_masks(pixels, scores, 0.4).collect()} == masks
    monkeypatch.setattr(detect, "MOST", 100)  # larger images go in rounds; 300 boxes of another id do
    few = spark.createDataFrame([(8 + (i % 5 == 0), *r[1:]) for i, r in enumerate(rows[:300])] + [(None, *r[1:]) for r in rows[:3]], df.schema)
    want = {x for k in (8, 9) for x in greedy([{**i, "image": k} for n, i in enumerate(items[:300]) if (n % 5 == 0) == (k == 9)], over)} | {(None, r[1]) for r in rows[:3]}
    assert {(r.image, r.det_id) for r in detect.suppress(few).collect()} == want


def test_pairs_of_an_image_without_cells(spark):
    """The same pairs, each box shuffled once, by its image: no grid cell makes copies of it."""
    df = spark.createDataFrame([(i % 2, *r[1:]) for i, r in enumerate(crowd(random.Random(4), 200))], BOX.replace("xmin double", "xmin int").replace("ymin double", "ymin int").replace("xmax double", "xmax int").replace("ymax double", "ymax int"))
    key = lambda d: sorted((r.image, r.a, r.b, r.iou) for r in d.collect())
    assert key(detect.iou_pairs(df, None)) == key(detect.iou_pairs(df, 16.0)) != []
    assert "explode" not in detect.iou_pairs(df, None)._jdf.queryExecution().toString()


def test_boxes_are_shuffled_once(spark, sf):
    """box_iou_pairs deals rows by image before they are hashed; copies of a box are found there, and pairs by a sorted join."""
    plan = box_iou_pairs(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 2 and all("hashpartitioning(image#" in line and "det_id" not in line and "REPARTITION_BY_NUM" in line for line in dealt)
    assert "SortMergeJoin" in plan


def test_pairs_of_odd_boxes(spark):
    """Empty, touching and nameless boxes are in no pair; shares are rounded half to even, as in SQL."""
    rows = [(1, "a", 0.0, 0.0, 16.0, 8.0), (1, "b", 0.0, 0.0, 1.0, 1.0), (1, "c", 16.0, 0.0, 17.0, 8.0), (1, "d", 2.0, 2.0, 2.0, 4.0), (1, "e", 5.0, 1.0, 3.0, 4.0), (1, None, 0.0, 0.0, 9.0, 9.0), (1, "f", None, 0.0, 9.0, 9.0), (None, "g", 0.0, 0.0, 9.0, 9.0), (2, "h", 0.0, 0.0, 9.0, 9.0)]
    df = spark.createDataFrame(rows, "image int, det_id string, xmin double, ymin double, xmax double, ymax double")
    assert [tuple(r) for r in detect.iou_pairs(df, None).collect()] == [(1, "a", "b", 0.007812)]
