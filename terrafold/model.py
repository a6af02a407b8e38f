"""Schemas, constants and metadata of rasters.

A raster is a DataFrame of pixel rows: raster (optional), y, x and value columns. Axes are always named: y and x are pixel
indices, cx and cy coordinates.
"""

from __future__ import annotations

from dataclasses import dataclass, replace


class RasterError(ValueError):
    """Inputs that do not fit together; raised before a job runs."""


# They are part of the results.
CLIP_HEIGHT = 25.5
PIXEL_TOLERANCE = 24
CIRCLE_TOLERANCE = 0.3
MIN_MASK_SIZE = 1024
REMOVE_CRACKS = 5
MAX_INSTANCES = 10
MIN_GROUND_RATIO = 0.8
MAX_GROUND_HEIGHT = 2.0
CAPTURE_HEIGHT = 120.0
EPSG_GPS = 4326
EPSG_MTM8 = 2950
BACKGROUND, UNKNOWN = 0, 1


@dataclass(frozen=True)
class Geo:
    """Size and georeference of a raster: origin of the top left corner, metres a pixel; sy is negative for north up."""

    h: int
    w: int
    epsg: int = EPSG_MTM8
    ox: float = 290000.0
    oy: float = 5040000.0
    sx: float = 0.02
    sy: float = -0.02

    def require_same_grid(self, other: Geo) -> None:
        if (self.h, self.w) != (other.h, other.w):
            raise RasterError(f"shapes differ: {(self.h, self.w)} and {(other.h, other.w)}")
        if self.epsg != other.epsg:
            raise RasterError(f"coordinate systems differ: {self.epsg} and {other.epsg}")

    def translated(self, tx: float, ty: float) -> Geo:
        if self.epsg == EPSG_GPS:
            raise RasterError("a raster in degrees can't be moved by metres")
        return replace(self, ox=self.ox + tx, oy=self.oy + ty)

    def bbox(self) -> tuple[float, float, float, float]:
        """minx, miny, maxx, maxy."""
        xs, ys = (self.ox, self.ox + self.w * self.sx), (self.oy, self.oy + self.h * self.sy)
        return min(xs), min(ys), max(xs), max(ys)

    def center(self) -> tuple[float, float]:
        """The coordinate of the middle pixel's corner, to the millimetre."""
        return round(self.ox + (self.w // 2) * self.sx, 3), round(self.oy + (self.h // 2) * self.sy, 3)

    def precision(self) -> int:
        """Decimals of the pixel size as it is written; 0 for one written with an exponent."""
        return len(repr(self.sx).partition(".")[2]) if "e" not in repr(self.sx) else 0

    def size(self, rounded: bool = True) -> tuple[float, float]:
        """Width and height in metres."""
        width, height = self.w * abs(self.sx), self.h * abs(self.sy)
        return (round(width, self.precision()), round(height, self.precision())) if rounded else (width, height)

    def ring(self, closed: bool = False) -> list[tuple[float, float]]:
        """The corners, counterclockwise from the lower left one."""
        x0, y0, x1, y1 = self.bbox()
        corners = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
        return corners + corners[:1] if closed else corners
