"""Files of the raster world: npz archives, polygon CSV with a header of `#key,value` lines, OBJ text."""

from __future__ import annotations

import io

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrafold.model import EPSG_GPS, RasterError


def read_npz(spark: SparkSession, path: str, member: str = "arr_0") -> DataFrame:
    """path, y, x, z of a two-dimensional member of each archive under path. Spark reads the files; pickles are refused."""

    def run(batches):
        for b in batches:
            for name, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                a = np.load(io.BytesIO(raw), allow_pickle=False)[member]
                if a.ndim != 2:
                    raise RasterError(f"{name}: {member} has {a.ndim} dimensions")
                y, x = np.indices(a.shape, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([name] * a.size), pa.array(y.ravel()), pa.array(x.ravel()), pa.array(a.ravel().astype(np.float64))], names=["path", "y", "x", "z"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, y int, x int, z double")


def to_npz(df: DataFrame, key: str, member: str = "arr_0", dtype: str = "uint16") -> DataFrame:
    """key, content: an npz archive for each raster of df (key, y, x, z), with 0 where it has no pixel; for one raster's size."""

    def run(table: pa.Table) -> pa.Table:
        y, x, z = (table.column(c).to_numpy() for c in ("y", "x", "z"))
        a = np.zeros((y.max() + 1, x.max() + 1), dtype)
        a[y, x] = z
        out = io.BytesIO()
        np.savez_compressed(out, **{member: a})
        return pa.table({key: table.column(key).slice(0, 1), "content": pa.array([out.getvalue()], pa.binary())})

    return df.select(key, "y", "x", "z").groupBy(key).applyInArrow(run, f"`{key}` {df.schema[key].dataType.simpleString()}, content binary")


def read_polygons(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """path, idx, x, y of CSV polygons, and path, key, value of their header lines (`#key,value` or `#key=value`)."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    head = F.regexp_extract(F.col("line"), r"^#\s*([^,=]+)[,=](.*)$", 1)
    meta = lines.where(F.col("line").startswith("#")).select("path", F.trim(head).alias("key"), F.trim(F.regexp_extract("line", r"^#\s*([^,=]+)[,=](.*)$", 2)).alias("value"))
    cells = F.split("line", ",")
    rows = lines.where(~F.col("line").startswith("#") & (F.trim("line") != "") & ~F.lower("line").rlike(r"^\s*x\s*,")).select("path", F.col("n").alias("idx"), F.element_at(cells, 1).cast("double").alias("x"), F.element_at(cells, 2).cast("double").alias("y"))
    return rows, meta


def polygon_lines(verts: DataFrame, epsg: int = EPSG_GPS, metadata: dict[str, str] | None = None) -> DataFrame:
    """seq, line of the CSV text of one polygon (idx, x, y): header lines, column names, vertices."""
    head = [f"#{k},{v}" for k, v in {**(metadata or {}), "epsg": str(epsg)}.items()] + ["x,y"]
    top = verts.sparkSession.createDataFrame([(i - len(head), line) for i, line in enumerate(head)], "seq long, line string")
    return top.unionByName(verts.select(F.col("idx").cast("long").alias("seq"), F.concat_ws(",", "x", "y").alias("line")))


def read_obj(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """vertex rows (line, x, y, z) and face rows (line, a, b, c) of an OBJ text, by the number of their line."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("line", "t"))
    cells = F.split("t", " ")
    at = lambda i, kind: F.element_at(cells, i).cast(kind)
    v = lines.where(F.col("t").startswith("v ")).select("line", at(2, "double").alias("x"), at(3, "double").alias("y"), at(4, "double").alias("z"))
    return v, lines.where(F.col("t").startswith("f ")).select("line", at(2, "long").alias("a"), at(3, "long").alias("b"), at(4, "long").alias("c"))


def read_npz_metadata(spark: SparkSession, path: str, member: str = "metadata") -> DataFrame:
    """path, metadata, type of the text member that holds an archive's metadata as JSON; null where there is none."""

    def run(batches):
        for b in batches:
            names, raws = b.column(0).to_pylist(), b.column(1).to_pylist()
            held = [np.load(io.BytesIO(raw), allow_pickle=False) for raw in raws]
            text = [str(a[member]) if member in a.files else None for a in held]
            kind = ["map" if t and t.lstrip().startswith("{") else None if t is None else "string" for t in text]
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(text, pa.string()), pa.array(kind, pa.string())], names=["path", "metadata", "type"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, metadata string, type string")


def write_tiles(tiles: DataFrame, path: str) -> None:
    """tiles (tile, y, x, ...) as Parquet, a folder for each tile, so that reading one tile reads its files only."""
    tiles.repartition("tile").write.partitionBy("tile").mode("overwrite").parquet(path)


def read_tiles(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """tile, row_id, y, x, code of point files (axis-0, axis-1, code; one for each tile, named like it); rows off the grid of whole
    pixels are truncated to it, and a file's rows keep their order in row_id."""
    raw = spark.read.option("header", True).csv(path, schema="`axis-0` double, `axis-1` double, code string").select("*", "_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row_id"))
    name = F.regexp_extract(F.url_decode("file_path"), r"([^/]+)\.csv$", 1)
    return raw.select(name.alias("tile"), "row_id", F.col("`axis-0`").cast("int").alias("y"), F.col("`axis-1`").cast("int").alias("x"), "code")


def read_translation(spark: SparkSession, path: str) -> tuple[float, float]:
    """x and y of the first row of a CSV with these columns."""
    row = spark.read.option("header", True).csv(path).select(F.col("x").cast("double"), F.col("y").cast("double")).first()
    if row is None:
        raise RasterError(f"no translation in {path}")
    return row.x, row.y


def json_lines(df: DataFrame, key: str) -> DataFrame:
    """key, json: each row's other columns as a JSON object, null ones included."""
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns if c != key])
    return df.select(key, F.to_json(rest, {"ignoreNullFields": "false"}).alias("json"))


def mesh_text(lines: DataFrame, path: str) -> None:
    """lines (section, seq, line) in order as text; parts are ranges, so no task has all of them."""
    lines.orderBy("section", "seq").select("line").write.mode("overwrite").text(path)
