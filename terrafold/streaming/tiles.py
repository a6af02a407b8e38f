"""Tiles that arrive over time: running zonal statistics of pixel rows from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def running_stats(pixels: DataFrame) -> DataFrame:
    """label, n, z_max and z_sum over all pixel rows (label, z) that a stream has brought; 0 is background."""
    return pixels.where("label <> 0").groupBy("label").agg(F.count("*").alias("n"), F.max("z").alias("z_max"), F.sum(F.col("z").cast("decimal(20,6)")).alias("z_sum"))


def append_tiles(tiles: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch of tiles (tile, y, x, z) under path by tile; the checkpoint makes a restart write none twice."""
    return tiles.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("tile").trigger(availableNow=True).start()
