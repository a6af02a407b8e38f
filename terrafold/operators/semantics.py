"""Semantic codes, their dictionary and distributions, and splits of data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.model import UNKNOWN
from terrafold.operators.linked import checkpoint


def int_code(code: Column, dictionary: dict[str, int]) -> Column:
    """The number of a code by its first four letters, else its first two, in upper case; else that of UNKNOWN."""
    table = F.create_map(*[F.lit(v) for kv in dictionary.items() for v in kv])
    up = F.upper(code)
    return F.coalesce(F.try_element_at(table, F.substring(up, 1, 4)), F.try_element_at(table, F.substring(up, 1, 2)), F.lit(dictionary.get("UNKNOWN", UNKNOWN)))


def code_of(number: Column, dictionary: dict[str, int]) -> Column:
    table = F.create_map(*[x for k, v in dictionary.items() for x in (F.lit(v), F.lit(k))])
    return F.try_element_at(table, number)


def points_to_instances(points: DataFrame, labels: DataFrame) -> DataFrame:
    """label, code of the first point (by row_id) on each instance."""
    hit = points.join(labels.where("label <> 0"), ["y", "x"])
    return hit.groupBy("label").agg(F.min_by("code", "row_id").alias("code"))


def semantic_raster(labels: DataFrame, codes: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """y, x, cls: the class of each pixel's instance; UNKNOWN without a point, 0 on background. codes: label, code."""
    named = codes.select("label", int_code(F.col("code"), dictionary).alias("_c"))
    cls = F.when(F.col("label") == 0, 0).otherwise(F.coalesce("_c", F.lit(dictionary.get("UNKNOWN", UNKNOWN))))
    return labels.join(named, "label", "left").select("y", "x", cls.alias("cls"))


def counts(points: DataFrame, dictionary: dict[str, int]) -> DataFrame:
    """cls, n for every class of the dictionary; absent ones, and background and unknown, have 0."""
    spark = points.sparkSession
    classes = spark.createDataFrame([(v,) for v in sorted(set(dictionary.values()))], "cls int")
    found = points.groupBy(int_code(F.col("code"), dictionary).alias("cls")).agg(F.count("*").alias("n"))
    return F.broadcast(classes).join(found, "cls", "left").select("cls", F.when(F.col("cls") <= UNKNOWN, 0).otherwise(F.coalesce("n", F.lit(0))).cast("long").alias("n"))


def distribution(counted: DataFrame) -> DataFrame:
    total = counted.agg(F.sum("n").alias("_t"))
    return counted.crossJoin(F.broadcast(total)).select("cls", F.coalesce(F.try_divide("n", "_t"), F.lit(0.0)).alias("share"))


def augmentation(shares: DataFrame) -> DataFrame:
    """Shares that favour rare classes: twice the largest less each, for classes that occur, scaled to sum 1."""
    top = shares.agg(F.max("share").alias("_m"))
    raw = shares.crossJoin(F.broadcast(top)).select("cls", F.when(F.col("share") != 0, 2 * F.col("_m") - F.col("share")).otherwise(0.0).alias("_w"))
    return raw.crossJoin(F.broadcast(raw.agg(F.sum("_w").alias("_s")))).select("cls", F.coalesce(F.try_divide("_w", "_s"), F.lit(0.0)).alias("share"))


def split_by_hash(manifest: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """manifest with part: train or val by a hash of key, so rows of one key stay together, at any number of rows.

    Shares meet the ratio in expectation; no order of all rows is needed.
    """
    unit = F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key))), 1, 8), 16, 10).cast("long"), F.lit(1_000_000))
    return manifest.withColumn("part", F.when(unit < int(ratio * 1_000_000), "train").otherwise("val"))


#: Bits of the hashes that splits order keys by, and bits that a round of the search for one of them settles.
HASH_BITS, ROUND_BITS = 60, 15


def kth_smallest(values: DataFrame, k: int) -> int:
    """The k-th smallest (from 1) of the one column of values, whole numbers of HASH_BITS bits, each once.

    Each round counts the values in 2**ROUND_BITS ranges of equal width and goes on within the one that holds the k-th, so the values
    are neither sorted nor collected.
    """
    name = values.columns[0]
    prefix, shift = 0, HASH_BITS
    while shift:
        within = values.where(F.shiftright(name, shift) == prefix) if shift < HASH_BITS else values
        shift -= ROUND_BITS
        bins = within.groupBy(F.shiftright(name, shift).alias("bin")).agg(F.count("*").alias("n")).collect()
        for row in sorted(bins):
            if k <= row.n:
                prefix = row.bin
                break
            k -= row.n
        else:
            raise ValueError("fewer values than k")
    return prefix


def split_exactly(manifest: DataFrame, key: str, ratio: float = 0.8, seed: int = 0) -> DataFrame:
    """manifest with part: train for int(ratio * keys) of its distinct keys, the smallest by a hash, val for the others.

    Rows of one key stay together; a null key is one of them. The keys are counted in a few ranges at a time, never sorted, and a
    rerun splits alike, whatever the order of rows. Hashes have 60 bits; two keys of one hash stay together.
    """
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    h = F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("long")
    hashes = checkpoint(manifest.select(h.alias("h")).distinct())
    k = int(hashes.count() * ratio)
    return manifest.withColumn("part", F.when(h <= kth_smallest(hashes, k), "train").otherwise("val") if k else F.lit("val"))


def percentile_pick(manifest: DataFrame, by: str, name: str, percentile: float) -> DataFrame:
    """by, name: of each group's names in order, the one at the percentile."""
    p = min(max(percentile, 0.0), 0.999999)
    w = Window.partitionBy(by)
    ranked = manifest.select(by, name).withColumns({"_k": F.row_number().over(w.orderBy(name)) - 1, "_n": F.count("*").over(w)})
    return ranked.where(F.col("_k") == (F.lit(p) * F.col("_n")).cast("int")).select(by, name)


def dataset_names(manifest: DataFrame, subset: str | None = None, ending: str = ".npz", seed: int | None = None) -> DataFrame:
    """Rows of manifest (name, prefix) of the files with an ending, of one subset if it is named; with a seed in an order that its hash
    gives, which sorts by range in all tasks."""
    out = manifest.where(F.endswith("name", F.lit(ending)))
    out = out if subset is None else out.where(F.endswith("prefix", F.lit(subset)))
    return out if seed is None else out.orderBy(F.xxhash64(F.lit(seed), "name"), "name")


def equal_shares(dictionary: dict[str, int]) -> dict[int, float]:
    """The same share for every class but background and unknown, which have none."""
    known = sorted({v for v in dictionary.values() if v > UNKNOWN})
    return {v: (1.0 / len(known) if v > UNKNOWN else 0.0) for v in sorted(set(dictionary.values()))}
