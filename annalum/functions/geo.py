"""Places: boxes, great-circle distances, grids, clusters by zoom."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM, DEGREE_KM = 6371.0, 111.0


def haversine(lat1, lng1, lat2, lng2) -> Column:
    """Kilometres between two points; arguments are columns or numbers."""
    a, b, c, d = (F.radians(F.lit(x) if not isinstance(x, Column) else x) for x in (lat1, lng1, lat2, lng2))
    h = F.pow(F.sin((c - a) / 2), F.lit(2)) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def in_box(lat: Column, lng: Column, corner_a: tuple[float, float], corner_b: tuple[float, float]) -> Column:
    """Corners in any order."""
    (a, b), (c, d) = corner_a, corner_b
    return lat.between(min(a, c), max(a, c)) & lng.between(min(b, d), max(b, d))


def near_degrees(lat1, lng1, lat2, lng2, degrees: float = 1.0) -> Column:
    return (F.abs(lat1 - lat2) < degrees) & (F.abs(lng1 - lng2) < degrees)


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size)


def zoom_radius_km(altitude: float) -> float:
    """How far apart markers may be to share a cluster; none below an altitude of 0.5."""
    return 0.0 if altitude < 0.5 else min(600.0, max(80.0, altitude * 150.0))


def view_zoom(spread: Column) -> Column:
    """Zoom for a spread in degrees."""
    out = F.lit(4)
    for limit, zoom in ((20, 5), (10, 6), (5, 7), (2, 8)):
        out = F.when(spread < limit, F.lit(zoom)).otherwise(out)
    return out


def wkt_point(text: Column) -> tuple[Column, Column]:
    """(latitude, longitude) of 'Point(lng lat)'; null if it is not one."""
    pattern = r"Point\(([-0-9.]+) ([-0-9.]+)\)"
    return F.regexp_extract(text, pattern, 2).try_cast("double"), F.regexp_extract(text, pattern, 1).try_cast("double")


def hexagon(lat: Column, lng: Column, size: float) -> tuple[Column, Column]:
    """Axial coordinates of the hexagon of a plane grid (side `size` degrees) that a point is in: cube coordinates are
    rounded, and the one that rounding moved most is set from the other two."""
    x, z = (0.5773502691896258 * lng - lat / 3.0) / size, lat * 2.0 / 3.0 / size
    y = -x - z
    rx, ry, rz = (F.floor(v + 0.5) for v in (x, y, z))
    dx, dy, dz = F.abs(rx - x), F.abs(ry - y), F.abs(rz - z)
    q = F.when((dx > dy) & (dx > dz), -ry - rz).otherwise(rx)
    r = F.when((dx > dy) & (dx > dz), rz).when(dy > dz, rz).otherwise(-rx - ry)
    return q.cast("long"), r.cast("long")
