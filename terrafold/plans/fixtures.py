"""Rasters, points, boxes and graphs derived from the star-schema tables, for Spark and, as SQL, for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.model import Geo

#: The fixture raster is as wide as an embedding.
WIDTH = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def px(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("int").alias("y"), F.col("label").alias("cls"), F.posexplode("embedding").alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("z"), "cls")


def geo(spark: SparkSession, sf_dir: str) -> Geo:
    """Height from the number of embeddings, which number the rows without gaps."""
    return Geo(table(spark, sf_dir, "embeddings").count(), WIDTH)


def dsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("y", "x", F.bround(40 + 60 * F.col("z"), 3).alias("z"))


def dtm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("y", "x", (F.lit(30.0) + F.col("cls") * F.lit(0.5)).alias("z"))


def inst(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("z") > 0.1, F.floor(F.col("y") / 25) * 4 + F.floor(F.col("x") / 16) + 1).otherwise(0)
    return px(spark, sf_dir).select("y", "x", label.cast("int").alias("label"))


def alpha(spark: SparkSession, sf_dir: str) -> DataFrame:
    return px(spark, sf_dir).select("y", "x", F.when((F.col("y") * 64 + F.col("x")) % 97 == 0, 0).otherwise(255).alias("a"))


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("row_id"), (k % 500).cast("int").alias("y"), (k * 7 % 64).cast("int").alias("x"), F.col("p_type").alias("code"))


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes. det_id is a hash of the row, so that no window orders all rows in one task.

    Rows are dealt by image before they are hashed, so what goes image by image needs no other shuffle. Their number of partitions is
    given: work on an image grows faster than its bytes, by which Spark would join them."""
    image, cents = (F.col("l_orderkey") % 5000).cast("int"), F.bround(F.col("l_extendedprice") * 100, 0).cast("long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    r = table(spark, sf_dir, "lineitem").select(image.alias("image"), "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", cents.alias("cents"), "l_discount").repartition(parts, "image")
    key = F.md5(F.concat_ws("|", "l_orderkey", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"), "cents"))
    size = F.col("l_quantity")
    return r.select(
        "image", key.alias("det_id"),
        (F.col("l_partkey") % 100).cast("double").alias("xmin"), (F.col("l_suppkey") % 100).cast("double").alias("ymin"),
        ((F.col("l_partkey") % 100) + size).alias("xmax"), ((F.col("l_suppkey") % 100) + size).alias("ymax"), (F.col("l_discount") * 10).alias("score"),
    ).dropDuplicates(["image", "det_id"])


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("u"), (F.col("s_suppkey") % 25).cast("int").alias("v")).distinct()


def verts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("poly"), (F.col("s_suppkey") * 10).alias("mx"), (F.col("s_nationkey") * 10).alias("my"), (1 + F.abs("s_acctbal") / 1000).alias("r"))
    corners = F.array(*[F.struct(F.lit(i).alias("idx"), F.lit(sx).alias("sx"), F.lit(sy).alias("sy")) for i, (sx, sy) in enumerate(((-1, -1), (1, -1), (1, 1), (-1, 1)))])
    return s.select("poly", "mx", "my", "r", F.explode(corners).alias("c")).select("poly", "c.idx", (F.col("mx") + F.col("c.sx") * F.col("r")).alias("x"), (F.col("my") + F.col("c.sy") * F.col("r")).alias("y"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("pid"), (F.col("c_custkey") % 1000).cast("double").alias("x"), (F.col("c_nationkey") * 10).cast("double").alias("y"))


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    prefix = F.concat("source", F.lit("_"), F.lpad((F.col("doc_id") % 50).cast("string"), 3, "0"))
    return d.select(F.concat(prefix, F.lit(" ("), F.col("doc_id").cast("string"), F.lit(").npz")).alias("name"), prefix.alias("prefix"))


def streets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sides of a lattice of 25 columns, 100 apart, one for each supplier and way on from it; some bear a lane's name."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(k.alias("u"), F.explode(F.array(k + 1, k + 25)).alias("v"), F.when(k % 11 == 0, "Ruelle Nord").otherwise(F.concat(F.lit("Rue "), k.cast("string"))).alias("name"))
    at = lambda n: F.struct((n % 25 * 100).cast("double").alias("x"), (F.floor(n / 25) * 100).cast("double").alias("y"))
    return s.where((F.col("v") != F.col("u") + 1) | (F.col("v") % 25 != 0)).select("u", "v", F.lit(0).alias("key"), "name", F.array(at(F.col("u")), at(F.col("v"))).alias("geometry"))


def street_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(c.alias("seed"), (c * 37 % 2400 + 0.5).alias("x"), (c * 53 % 4000 + 0.25).alias("y"))


SQL = {
    "px": "SELECT CAST(vec_id AS INT) y, CAST(i - 1 AS INT) x, CAST(embedding[i] AS DOUBLE) z, label cls FROM embeddings, range(1, 65) t(i)",
    "geo": "SELECT CAST(count(*) AS INT) h, 64 w, 290000.0::DOUBLE ox, 5040000.0::DOUBLE oy, 0.02::DOUBLE sx, -0.02::DOUBLE sy FROM embeddings",
    "dsm": "SELECT y, x, round_even(40 + 60 * z, 3) z FROM px",
    "dtm": "SELECT y, x, 30.0::DOUBLE + cls * 0.5::DOUBLE z FROM px",
    "inst": "SELECT y, x, CAST(CASE WHEN z > 0.1 THEN (y // 25) * 4 + (x // 16) + 1 ELSE 0 END AS INT) label FROM px",
    "alpha": "SELECT y, x, CASE WHEN (y * 64 + x) % 97 = 0 THEN 0 ELSE 255 END a FROM px",
    "pts": "SELECT p_partkey row_id, CAST(p_partkey % 500 AS INT) y, CAST(p_partkey * 7 % 64 AS INT) x, p_type code FROM part",
    "det": """SELECT DISTINCT ON (image, det_id) * FROM (SELECT CAST(l_orderkey % 5000 AS INT) image,
        md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, CAST(l_quantity AS INT), CAST(round_even(l_extendedprice * 100, 0) AS BIGINT))) det_id,
        CAST(l_partkey % 100 AS DOUBLE) xmin, CAST(l_suppkey % 100 AS DOUBLE) ymin, (l_partkey % 100) + l_quantity xmax, (l_suppkey % 100) + l_quantity ymax, l_discount * 10 score
        FROM lineitem)""",
    "edges": "SELECT DISTINCT s_nationkey u, CAST(s_suppkey % 25 AS INT) v FROM supplier",
    "verts": """SELECT s_suppkey poly, idx, s_suppkey * 10 + sx * (1 + abs(s_acctbal) / 1000) x, s_nationkey * 10 + sy * (1 + abs(s_acctbal) / 1000) y
        FROM supplier, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 1), (3, -1, 1)) c(idx, sx, sy)""",
    "points": "SELECT c_custkey pid, CAST(c_custkey % 1000 AS DOUBLE) x, CAST(c_nationkey * 10 AS DOUBLE) y FROM customer",
    "manifest": """SELECT source || '_' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') || ' (' || doc_id || ').npz' AS name, source || '_' || lpad(CAST(doc_id % 50 AS VARCHAR), 3, '0') AS prefix FROM documents""",
}
NEEDS = {"dsm": ["px"], "dtm": ["px"], "inst": ["px"], "alpha": ["px"]}


def sql(body: str, *names: str) -> str:
    """body behind a WITH of the named fixtures and what they need; body may go on with `, more AS (...) SELECT`."""
    order: list[str] = []
    for n in names:
        order += [m for m in [*NEEDS.get(n, []), n] if m not in order]
    body = body.strip()
    if not order:
        return body
    return "WITH RECURSIVE " + ", ".join(f"{n} AS MATERIALIZED ({SQL[n]})" for n in order) + ("" if body.startswith(",") else " ") + body
