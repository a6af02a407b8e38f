"""Strings: paths, tile names, links."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def filename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    name = filename(path)
    return F.when(F.instr(name, ".") == 0, "").otherwise(F.substring_index(name, ".", -1))


def without_extension(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext == "", path).otherwise(F.left(path, F.length(path) - F.length(ext) - 1))


def joined(directory: Column, name: Column) -> Column:
    clean = F.regexp_replace(directory, "/$", "")
    return F.when(clean == "", name).otherwise(F.concat(clean, F.lit("/"), name))


def tile_name(size: Column, cx: Column, cy: Column, date: Column, distance: Column) -> Column:
    """`{size}_{x}_{y} ({date}) ({distance}m).tif`; a null date is 0000-00-00."""
    whole = lambda c: c.cast("long").cast("string")
    return F.concat(whole(size), F.lit("_"), whole(cx), F.lit("_"), whole(cy), F.lit(" ("), F.coalesce(date, F.lit("0000-00-00")), F.lit(") ("), F.bround(distance, 0).cast("long").cast("string"), F.lit("m).tif"))


def map_link(cx: Column, cy: Column, epsg: Column, zoom: int = 18, layer: str = "osm") -> Column:
    return F.format_string(f"https://epsg.io/map#srs=%d&x=%.6f&y=%.6f&z={zoom}&layer={layer}", epsg, cx, cy)


def map_link_coord(url: Column) -> Column:
    """cx and cy of a map link, by place behind the hash."""
    parts = F.split(F.element_at(F.split(url, "#"), 2), "&")
    value = lambda i: F.element_at(F.split(F.element_at(parts, i), "="), 2).cast("double")
    return F.struct(value(2).alias("cx"), value(3).alias("cy"))


def contains_any(text: Column, words: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w)) if words else F.lit(False)


def fresh_uuid() -> Column:
    """A random UUID for each row; another on each run."""
    return F.uuid()


def stamp(time: Column | None = None, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """A time, the current one if none is given, as text."""
    return F.date_format(F.current_timestamp() if time is None else time, pattern)
