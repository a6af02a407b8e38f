"""Transverse Mercator projections in closed form, as column expressions, on the GRS 80 ellipsoid.

The series of Krueger to the fourth order in the third flattening: exact to a fraction of a millimetre within a zone.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrafold.model import EPSG_GPS, EPSG_MTM8, Geo, RasterError

# The ellipsoid, and the zones by their codes: central meridian, scale on it, false easting and northing.
AXIS, FLATTENING = 6378137.0, 1 / 298.257222101
#: MTM zones 2 to 10 of NAD83(CSRS), which are 2944 to 2952 and three degrees apart from zone 3 on, and UTM zones of it.
_MTM = {2944: -55.5, 2945: -58.5, 2946: -61.5, 2947: -64.5, 2948: -67.5, 2949: -70.5, 2950: -73.5, 2951: -76.5, 2952: -79.5}
_UTM = {2955: -117.0, 2956: -111.0, 2957: -105.0, 2958: -81.0, 2959: -75.0, 2960: -69.0, 2961: -63.0, 2962: -57.0}


@dataclass(frozen=True)
class Zone:
    lon0: float
    k0: float
    fe: float
    fn: float = 0.0


ZONES = {e: Zone(lon, 0.9999, 304800.0) for e, lon in _MTM.items()} | {e: Zone(lon, 0.9996, 500000.0) for e, lon in _UTM.items()}

N = FLATTENING / (2 - FLATTENING)
E = math.sqrt(FLATTENING * (2 - FLATTENING))
RADIUS = AXIS / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
FORWARD = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180, 13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440, 61 * N**3 / 240 - 103 * N**4 / 140, 49561 * N**4 / 161280)
BACK = (N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360, N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440, 17 * N**3 / 480 - 37 * N**4 / 840, 4397 * N**4 / 161280)


def zone(epsg: int) -> Zone:
    if epsg not in ZONES:
        raise RasterError(f"no projection is known for {epsg}")
    return ZONES[epsg]


def to_plane(lon: Column, lat: Column, z: Zone, m=F) -> tuple[Column, Column]:
    """x and y of degrees. m: where sin, sinh and so on come from, math for plain numbers."""
    phi, lam = lat * (math.pi / 180), (lon - z.lon0) * (math.pi / 180)
    s = m.sin(phi)
    t = m.sinh(m.atanh(s) - m.atanh(s * E) * E)
    xi, eta = m.atan2(t, m.cos(lam)), m.atanh(m.sin(lam) / m.sqrt(t * t + 1))
    y, x = xi, eta
    for j, a in enumerate(FORWARD, 1):
        y = y + m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * a
        x = x + m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * a
    return x * (z.k0 * RADIUS) + z.fe, y * (z.k0 * RADIUS) + z.fn


def to_degrees(x: Column, y: Column, z: Zone, m=F) -> tuple[Column, Column]:
    """lon and lat of a place in the plane; the latitude by a series in the conformal one."""
    xi, eta = (y - z.fn) / (z.k0 * RADIUS), (x - z.fe) / (z.k0 * RADIUS)
    p, q = xi, eta
    for j, b in enumerate(BACK, 1):
        p = p - m.sin(xi * (2 * j)) * m.cosh(eta * (2 * j)) * b
        q = q - m.cos(xi * (2 * j)) * m.sinh(eta * (2 * j)) * b
    conformal = m.asin(m.sin(p) / m.cosh(q))
    return m.atan2(m.sinh(q), m.cos(p)) * (180 / math.pi) + z.lon0, _latitude(conformal, m) * (180 / math.pi)


def _series() -> tuple[float, ...]:
    """Coefficients of the series that leads from the conformal latitude to the geodetic one."""
    return (
        2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45, 7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45, 56 * N**3 / 15 - 136 * N**4 / 35, 4279 * N**4 / 630,
    )


def _latitude(chi: Column, m) -> Column:
    out = chi
    for j, d in enumerate(_series(), 1):
        out = out + m.sin(chi * (2 * j)) * d
    return out


def reproject(df: DataFrame, source: int, target: int, decimals: int | None = 3) -> DataFrame:
    """df with cx and cy (lon and lat for 4326) of the target system in place of the source's; rounded to decimals, but not for
    4326. Null coordinates stay null."""
    cx, cy = F.col("cx"), F.col("cy")
    if source == target:
        return df
    if source != EPSG_GPS:
        cx, cy = to_degrees(cx, cy, zone(source))
    if target == EPSG_GPS:
        return df.withColumns({"cx": cx, "cy": cy})
    # degrees between two planes are computed once a row, not once for each use
    mid = df.withColumns({"cx": cx, "cy": cy})
    x, y = to_plane(F.col("cx"), F.col("cy"), zone(target))
    return mid.withColumns({"cx": x if decimals is None else F.bround(x, decimals), "cy": y if decimals is None else F.bround(y, decimals)})


def _corner(x: float, y: float, source: int, target: int) -> tuple[float, float]:
    if source != EPSG_GPS:
        x, y = to_degrees(x, y, zone(source), math)
    return (x, y) if target == EPSG_GPS else to_plane(x, y, zone(target), math)


def target_grid(geo: Geo, target: int) -> Geo:
    """The raster of about as many pixels that covers geo's outline in the target system."""
    outline = [(geo.ox + geo.w * geo.sx * i / 8, geo.oy + geo.h * geo.sy * j / 8) for i in range(9) for j in range(9) if i in (0, 8) or j in (0, 8)]
    xs, ys = zip(*(_corner(x, y, geo.epsg, target) for x, y in outline), strict=True)
    scale = math.sqrt((max(xs) - min(xs)) * (max(ys) - min(ys)) / (geo.h * geo.w))
    return Geo(math.ceil((max(ys) - min(ys)) / scale), math.ceil((max(xs) - min(xs)) / scale), target, min(xs), max(ys), scale, -scale)


def reproject_raster(df: DataFrame, geo: Geo, target: int = EPSG_MTM8) -> tuple[DataFrame, Geo]:
    """y, x, z of df on the target system's grid, each pixel that of its middle in the source, and that grid; none outside.

    Each target pixel asks for one source pixel, and a join by (y, x) answers.
    """
    to = target_grid(geo, target)
    k = F.col("id")
    at = df.sparkSession.range(to.h * to.w).select(F.floor(k / to.w).cast("int").alias("_ty"), (k % to.w).cast("int").alias("_tx"))
    at = at.withColumns({"cx": to.ox + (F.col("_tx") + 0.5) * to.sx, "cy": to.oy + (F.col("_ty") + 0.5) * to.sy})
    back = reproject(at, target, geo.epsg, None)
    asked = back.select("_ty", "_tx", F.floor((F.col("cy") - geo.oy) / geo.sy).cast("int").alias("y"), F.floor((F.col("cx") - geo.ox) / geo.sx).cast("int").alias("x"))
    inside = asked.where((F.col("y") >= 0) & (F.col("y") < geo.h) & (F.col("x") >= 0) & (F.col("x") < geo.w))
    return inside.join(df.select("y", "x", "z"), ["y", "x"]).select(F.col("_ty").alias("y"), F.col("_tx").alias("x"), "z"), to
