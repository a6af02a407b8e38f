"""Helpers shared by the corpus operators."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from terrafold.operators.linked import FEW, checkpoint

__all__ = ["SPACE", "WORD", "bind", "bytes_of", "checkpoint", "documents", "free_name", "one_each", "parts_for", "row_schema", "text_or_empty", "with_ids", "without", "without_ids", "words"]

#: ASCII white space, the word separator of every contract.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def bind(value: Column, body) -> Column:
    """body(value) with value computed once a row, however often body uses it inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words(text: Column) -> Column:
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def bytes_of(docs: DataFrame, text: str = "text") -> int:
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def parts_for(docs: DataFrame, total: int, part_mb: float = 24.0) -> int:
    """Parts of about part_mb of text each, of total bytes, so that one part is a bounded piece of work at any size."""
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, math.ceil(total / (part_mb * 1e6)))


def free_name(docs: DataFrame) -> str:
    """A column name that docs does not have, in any case of letters."""
    taken, name = {c.lower() for c in docs.columns}, "_text"
    while name in taken:
        name = "_" + name
    return name


def without(docs: DataFrame, *names: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in names])


def one_each(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs with one row of each key, the first by a digest of its columns; rows of a null key all stay.

    Keys that occur once, as all do in a well-kept table, are told by an aggregate of the keys alone, and their rows are
    not shuffled.
    """
    again = checkpoint(docs.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key))
    n = again.count()
    if not n:
        return docs
    again = F.broadcast(again) if n <= FEW else again
    digest = F.sha2(F.to_json(F.struct(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")).alias(f"c{i}") for i, c in enumerate(docs.columns)])), 256)
    rows = docs.join(again, key, "left_semi").withColumn("_row", F.struct(digest.alias("d"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("r")))
    first = rows.groupBy(key).agg(F.min_by("_row.r", "_row.d").alias("_r")).select("_r.*")
    return docs.join(again, key, "left_anti").select(*docs.columns).unionByName(first.select(*docs.columns))


def row_schema(docs: DataFrame, key: str, ddl: str) -> StructType:
    """The key column of docs, then nullable columns."""
    return StructType([docs.schema[key], *StructType.fromDDL(ddl).fields])


#: Bits of a filter for each id, and bits of a filter at most: 32 MB.
BITS, MOST_BITS = 16, 1 << 28


def _hit(docs: DataFrame, ids: DataFrame, key: str, n: int) -> DataFrame:
    """docs with _hit: true where a bitmap over hashes of the n ids has the hash of the row's key, so for all rows of an id, and for
    few others; else false or null. The bitmap is bounded in size, whatever n, and goes to all tasks; docs are not shuffled."""
    bits, word = min(MOST_BITS, 1 << (BITS * n).bit_length()), 1 << 15
    slot = F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(bits))
    bitmap = ids.select(slot.alias("s")).groupBy(F.floor(F.col("s") / word).alias("_b")).agg(F.bitmap_construct_agg((F.col("s") % word).cast("long")).alias("_m"))
    at = slot % word
    byte = F.conv(F.hex(F.substring(F.col("_m"), (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (at % 8 + 1).cast("int"))) > 0
    return docs.join(F.broadcast(bitmap), F.floor(slot / word) == F.col("_b"), "left").withColumn("_hit", bit).drop("_b", "_m")


def with_ids(docs: DataFrame, ids: DataFrame, few: int = FEW, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is among ids (of a checkpoint, each once, no null).

    Up to `few` ids are sent to all tasks. More are joined by a shuffle, of the rows that a bitmap of the ids lets through.
    """
    n = ids.count()
    if n <= few:
        return docs.join(F.broadcast(ids), key, "left_semi").select(*docs.columns)
    return _hit(docs, ids, key, n).where("_hit").join(ids, key, "left_semi").select(*docs.columns)


def without_ids(docs: DataFrame, ids: DataFrame, few: int = FEW, key: str = "doc_id") -> DataFrame:
    """The rows of docs whose key is not among ids; joined as in with_ids, so that most rows that stay are not shuffled."""
    n = ids.count()
    if n <= few:
        return docs.join(F.broadcast(ids), key, "left_anti").select(*docs.columns)
    hit = _hit(docs, ids, key, n)
    return hit.where("_hit is null or not _hit").drop("_hit").select(*docs.columns).unionByName(hit.where("_hit").join(ids, key, "left_anti").select(*docs.columns))
