"""The npz data source: round trips, what filters leave unread, writes that fail, streams that start again."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrafold.model import RasterError
from terrafold.sources import npz


@pytest.fixture
def folder(tmp_path):
    rng = np.random.default_rng(1)
    for i in range(6):
        np.savez_compressed(
            tmp_path / f"t{i} ({i}).npz", ndsm=rng.random((5 + i, 7), np.float32), orthophoto=rng.integers(0, 255, (5 + i, 7, 3), np.uint8),
            instance_labels=rng.integers(0, 60_000, (5 + i, 7), np.uint16), metadata=np.array("{}"),
        )
    (tmp_path / "notes.txt").write_text("no archive")
    return tmp_path


def read(spark, path, **options):
    return npz.read_npz_tiles(spark, str(path), **options)


def test_columns_of_all_members(spark, folder):
    df = read(spark, folder)
    assert dict(df.dtypes) == {"tile": "string", "y": "int", "x": "int", "ndsm": "float", "orthophoto": "array<smallint>", "instance_labels": "int"}
    rows = df.collect()
    assert len(rows) == sum((5 + i) * 7 for i in range(6))
    held = {f"t{i} ({i})": np.load(folder / f"t{i} ({i}).npz") for i in range(6)}
    for r in rows:
        a = held[r.tile]
        assert (r.ndsm, r.orthophoto, r.instance_labels) == (a["ndsm"][r.y, r.x], a["orthophoto"][r.y, r.x].tolist(), a["instance_labels"][r.y, r.x])


def test_only_what_is_asked_for_is_read(spark, folder):
    (folder / "t9.npz").write_bytes(b"no archive at all")  # fails if it is opened
    assert read(spark, folder, members=["ndsm"], group=1).rdd.getNumPartitions() == 7
    one = read(spark, folder, members=["ndsm"], tiles=["t3 (3)", "none"], y=(2, 4), x=(6, None), group=1)
    assert one.columns == ["tile", "y", "x", "ndsm"] and one.rdd.getNumPartitions() == 1
    assert sorted((r.tile, r.y, r.x) for r in one.collect()) == [("t3 (3)", 2, 6), ("t3 (3)", 3, 6)]
    assert read(spark, folder, prefix="t4", y=(8, 100)).count() == 7 and read(spark, folder, prefix="t4", x=(7, None)).count() == 0
    assert read(spark, folder, tiles=[]).count() == 0
    with pytest.raises(Exception, match="pickled"):
        read(spark, folder).count()


def test_filters_of_one_query_are_not_those_of_the_next(spark, folder):
    df = read(spark, folder)
    n = df.count()
    assert df.where("tile = 't1 (1)' AND y = 2").count() == 7 and df.count() == n
    assert df.where("tile = 't1 (1)'").join(df.where("tile = 't0 (0)'"), ["y", "x"]).count() == 35


def test_round_trip_and_modes(spark, folder, tmp_path):
    out = f"{tmp_path}/out"
    df = read(spark, folder)
    npz.write_npz_tiles(df, out)
    again = read(spark, out).select(df.columns)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, df.collect()))
    one = spark.createDataFrame([("new", 1, 1, 2.5), ("new", 0, 0, None)], "tile string, y int, x int, z double")
    npz.write_npz_tiles(one, out)
    assert len(os.listdir(out)) == 7 and np.load(f"{out}/new.npz")["z"].tolist() == [[0, 0], [0, 2.5]]
    npz.write_npz_tiles(one, out, "overwrite")
    assert os.listdir(out) == ["new.npz"]


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    npz.register(spark)
    good = spark.range(40).select(F.concat(F.lit("t"), (F.col("id") % 8).cast("string")).alias("tile"), F.col("id").cast("int").alias("y"), F.lit(0).alias("x"), F.lit(1).alias("z"))
    bad = good.unionByName(good.limit(1).withColumn("tile", F.lit("a/b")))
    out = tmp_path / "out"
    with pytest.raises(Exception, match="names no file"):
        npz.write_npz_tiles(bad, str(out))
    with pytest.raises(Exception, match="needs tile"):
        npz.write_npz_tiles(good.withColumn("x", F.lit(None).cast("int")), str(out))
    with pytest.raises(Exception, match="two tasks"):  # rows of a tile were not brought together
        good.repartition(4, "y").sortWithinPartitions("tile").write.format("npz_tiles").mode("append").save(str(out))
    assert not out.exists() or os.listdir(out) == []
    npz.write_npz_tiles(good, str(out))
    assert len(os.listdir(out)) == 8


def test_refused(spark, tmp_path):
    np.savez(tmp_path / "a.npz", z=np.zeros((2, 2)), wide=np.zeros((2, 3)), o=np.array([[object()]]))
    with pytest.raises(Exception, match="of one size"):
        read(spark, tmp_path).count()
    assert read(spark, tmp_path, members=["z"]).count() == 4
    with pytest.raises(Exception, match="no rasters"):
        read(spark, tmp_path, members=["o"]).count()
    with pytest.raises(Exception, match="no folder"):
        read(spark, tmp_path / "none").count()
    with pytest.raises(RasterError):
        npz.NpzWriter(spark.range(1).schema, {"path": "x"}, False)


def test_a_stream_that_starts_again_reads_none_twice(spark, folder, tmp_path):
    seen, checkpoint = f"{tmp_path}/seen", f"{tmp_path}/checkpoint"

    def run():
        stream = npz.stream_npz_tiles(spark, str(folder), "tile string, y int, x int, ndsm float")
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(seen).awaitTermination()
        return spark.read.parquet(seen)

    assert run().count() == sum((5 + i) * 7 for i in range(6))
    np.savez(folder / "late.npz", ndsm=np.ones((2, 2), np.float32))
    got = run()
    assert got.count() == sum((5 + i) * 7 for i in range(6)) + 4 and got.select("tile").distinct().count() == 7
