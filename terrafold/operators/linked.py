"""Connected components of a table of links."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of ids that are sent to all tasks; larger tables are joined by a shuffle. The driver holds what it sends for a while,
#: so this is well below what it could hold once.
FEW = 200_000
#: Rows of a small table that make a task worth its while.
ROWS_A_TASK = 20_000


def shared_folder(spark: SparkSession) -> str:
    """A folder of this session below spark.checkpoint.dir; a session of one machine that sets none gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        path = spark.conf.get("spark.checkpoint.dir", None)
        if path is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """df written to the shared folder, as it is partitioned. Spark works it out twice: once for a count, once to write it."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df written to the shared folder as a Parquet table, worked out once. How it was partitioned is forgotten. rows: at most so
    many are known to come, which makes few tasks of a small table."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    (df if rows is None else df.coalesce(tasks_for(rows))).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks_for(rows: int) -> int:
    """Tasks for a table of so many small rows: few for a small one, in proportion for a large one."""
    return max(1, math.ceil(rows / ROWS_A_TASK))


def sent(rows: DataFrame) -> DataFrame:
    """rows (of a checkpoint) as the small side of a join: to all tasks if they are FEW or fewer, else left to the planner, which
    splits crowded keys at run time."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def rooted(up: DataFrame) -> DataFrame:
    """id and root of pointers up (id, root), one for each id, that lead to an id without a pointer or one that points to itself.

    Only ids that others point to are followed, by joins with themselves, as many as the depth has binary digits; then each id
    looks its parent's root up. In a star, the commonest tree, nothing is left to follow, and nobody meets at its centre.
    """
    moving = up.where("id <> root")
    mid = checkpoint(moving.join(moving.select(F.col("root").alias("id")).distinct(), "id", "left_semi").select("id", "root"))
    if mid.isEmpty():
        return up
    while True:
        x, y = mid.alias("x"), sent(mid).alias("y")
        step = x.join(y, F.col("x.root") == F.col("y.id"), "left").select(F.col("x.id").alias("id"), F.coalesce("y.root", "x.root").alias("root"), F.col("y.root").isNotNull().alias("moved"))
        step = checkpoint(step)
        mid = step.select("id", "root")
        if step.where("moved").isEmpty():
            break
    found = sent(mid.select(F.col("id").alias("root"), F.col("root").alias("_r")))
    return checkpoint(up.join(found, "root", "left").select("id", F.coalesce("_r", "root").alias("root")))


def connected(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 100) -> DataFrame:
    """id and component (the smallest id reachable) of every id in links; no links give no rows.

    A round hangs every id below the smallest id next to it and lets it look for the root of its tree. Links are rewritten
    between roots, and only those between different ones stay, so every tree at least joins another each round. Tables of a
    round are checkpointed, in as many parts as their rows are worth.
    """
    pairs = links.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    live = checkpoint(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = None
    for _ in range(rounds):
        left = live.count()
        if not left:
            break
        live = live.coalesce(tasks_for(left))
        up = rooted(checkpoint(live.groupBy("a").agg(F.min("b").alias("_m")).select(F.col("a").alias("id"), F.least("a", "_m").alias("root")).coalesce(tasks_for(left))))
        if labels is None:
            labels = up.select("id", F.col("root").alias("component"))
        else:
            labels = checkpoint(labels.join(up.select(F.col("id").alias("component"), "root"), "component", "left").select("id", F.coalesce("root", "component").alias("component")))
        ends = live.join(up.select(F.col("id").alias("a"), F.col("root").alias("u")), "a").select("u", "b")
        ends = ends.join(up.select(F.col("id").alias("b"), F.col("root").alias("v")), "b").where("u <> v")
        live = checkpoint(ends.select(F.col("u").alias("a"), F.col("v").alias("b")).distinct().coalesce(tasks_for(left)))
    return live.select(F.col("a").alias("id"), F.col("b").alias("component")) if labels is None else labels


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """rows with name, 1-based in the order of a column without repeats, without one task for all: the rows are dealt by range and
    kept so, and a part's rows count on from those of the parts before."""
    dealt = checkpoint(rows.repartitionByRange(order).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).select("_p", "_start")  # a row a part
    ranked = dealt.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(order)))
    return ranked.join(F.broadcast(starts), "_p").withColumn(name, F.col("_start") + F.col("_r")).drop("_p", "_r", "_start")
