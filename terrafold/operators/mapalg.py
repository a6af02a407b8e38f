"""Map algebra: a new value of each pixel from its own values and, for scaling, the raster's extremes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.model import CAPTURE_HEIGHT


def height_above_ground(surface: DataFrame, terrain: DataFrame, capture: float = CAPTURE_HEIGHT, decimals: int | None = 3) -> DataFrame:
    """y, x, z: surface less terrain, pixel by pixel; 0 below ground and above the capture height."""
    both = surface.select("y", "x", F.col("z").alias("_s")).join(terrain.select("y", "x", F.col("z").alias("_t")), ["y", "x"])
    d = F.col("_s") - F.col("_t")
    z = F.when((d < 0) | (d > capture), F.lit(0.0)).otherwise(d)
    return both.select("y", "x", (z if decimals is None else F.bround(z, decimals)).alias("z"))


def _with_range(df: DataFrame, z: str, by: list[str]) -> DataFrame:
    """df with _lo and _hi of z, from one partial aggregate; a raster's row of extremes is the small side of the join."""
    if by:
        return df.join(df.groupBy(*by).agg(F.min(z).alias("_lo"), F.max(z).alias("_hi")), by)
    return df.crossJoin(F.broadcast(df.agg(F.min(z).alias("_lo"), F.max(z).alias("_hi"))))


def normalize(df: DataFrame, z: str = "z", by: list[str] | None = None) -> DataFrame:
    """z scaled to 0..1 over the raster (or each group of `by`); a constant raster becomes 0."""
    span = F.when(F.col("_hi") == F.col("_lo"), F.lit(1.0)).otherwise(F.col("_hi") - F.col("_lo"))
    return _with_range(df, z, by or []).withColumn(z, (F.col(z) - F.col("_lo")) / span).drop("_lo", "_hi")


def clip_rescale(z: Column, height: float) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), z / height))


def to_uint8(z: Column) -> Column:
    """0..1 as 0..255, truncated; values outside wrap as unsigned bytes do."""
    return F.pmod((z * 255).cast("int"), F.lit(256))


def floor_to(z: Column, step: int) -> Column:
    return (F.floor(z / step) * step).cast("int")


def nodata_mask(df: DataFrame, ratio: float = 0.02, z: str = "z") -> DataFrame:
    """df with masked: the pixel has the least value and more than ratio of all pixels have it."""
    least = df.agg(F.min(z).alias("_lo"), F.count("*").alias("_n"))
    same = df.join(F.broadcast(least), F.col(z) == F.col("_lo")).agg(F.count("*").alias("_same"), F.max("_lo").alias("_lo"), F.max("_n").alias("_n"))
    on = (F.col(z) == F.col("_lo")) & (F.col("_same") > (F.col("_n") * ratio).cast("int"))
    return df.crossJoin(F.broadcast(same)).withColumn("masked", F.coalesce(on, F.lit(False))).drop("_lo", "_n", "_same")


def without_nodata(df: DataFrame, ratio: float = 0.02, z: str = "z") -> DataFrame:
    return nodata_mask(df, ratio, z).withColumn(z, F.when(~F.col("masked"), F.col(z))).drop("masked")


def lifted_floor(df: DataFrame, z: str = "z") -> DataFrame:
    """df with valid (1.0 above the least value, else 0.0), and least values raised to the second smallest."""
    low = df.agg(F.min(z).alias("_lo"))
    second = df.crossJoin(F.broadcast(low)).where(F.col(z) > F.col("_lo")).agg(F.min(z).alias("_second"))
    out = df.crossJoin(F.broadcast(low)).crossJoin(F.broadcast(second))
    at = F.col(z) == F.col("_lo")
    return out.withColumn("valid", F.when(at, 0.0).otherwise(1.0)).withColumn(z, F.when(at, F.coalesce("_second", z)).otherwise(F.col(z))).drop("_lo", "_second")


def one_hot(cls: Column, n: int) -> Column:
    """Class shares of a pixel: the unknown class (1) is spread over the classes from 1 on."""
    share = 1.0 / (n - 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((cls == i) & (i != 1), 1.0).otherwise(0.0) + F.when((cls == 1) & (i != 0), share).otherwise(0.0))


def channels(df: DataFrame, mode: str) -> DataFrame:
    """The bands r, g, b, d of a pixel as one array, in the order that mode spells; `depth` repeats d."""
    order = "ddd" if mode == "depth" else mode
    if not order or set(order) - set("rgbd"):
        raise ValueError(f"unknown channel mode: {mode}")
    return df.withColumn("bands", F.array(*[F.col(c) for c in order]))


def grey(z: Column, reverse: bool = False) -> Column:
    """Three equal channels of one, or of 1 less it."""
    v = 1 - z if reverse else z
    return F.array(v, v, v)
