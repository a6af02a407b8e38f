from terrafold.streaming.tiles import append_tiles, running_stats


def test_running_stats_and_append(spark, tmp_path):
    rows = [("a", 1, 0, 0, 2.0), ("a", 1, 0, 1, 3.0), ("b", 2, 1, 0, 1.0), ("b", 0, 1, 1, 9.0)]
    src, schema = str(tmp_path / "in"), "tile string, label int, y int, x int, z double"
    spark.createDataFrame(rows[:2], schema).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(schema).parquet(src)
    q = running_stats(stream).writeStream.outputMode("complete").format("memory").queryName("running").start()
    q.processAllAvailable()
    spark.createDataFrame(rows[2:], schema).coalesce(1).write.mode("append").parquet(src)
    q.processAllAvailable()
    q.stop()
    assert {r.label: (r.n, r.z_max) for r in spark.table("running").collect()} == {1: (2, 3.0), 2: (1, 1.0)}
    for _ in range(2):
        append_tiles(stream.drop("label"), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 4
