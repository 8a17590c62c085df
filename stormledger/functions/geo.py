"""Distances and boxes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..policy import POLICY


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in metres on a sphere."""
    a1, o1, a2, o2 = (F.radians(col(c)) for c in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    return 2 * POLICY.earth_radius_m * F.atan2(F.sqrt(h), F.sqrt(F.greatest(1 - h, F.lit(0.0))))


HAVERSINE_SQL = (
    "(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(greatest(1 - {h}, 0.0::DOUBLE))))"
)


def haversine_sql(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    h = f"(pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2))"
    return HAVERSINE_SQL.format(h=h)


def inside(lat, lon, west: float, south: float, east: float, north: float, strict: bool = False) -> Column:
    """In the box; ``strict`` leaves out its edges."""
    la, lo = col(lat), col(lon)
    if strict:
        return (lo > west) & (lo < east) & (la > south) & (la < north)
    return lo.between(west, east) & la.between(south, north)


def check_box(box: tuple[float, float, float, float], most_span: float = 10.0) -> tuple[float, float, float, float]:
    """A (west, south, east, north) box, or ValueError: in range, in order, and no wider than allowed."""
    west, south, east, north = map(float, box)
    if not (-180 <= west <= east <= 180 and -90 <= south <= north <= 90):
        raise ValueError(f"not a box: {box}")
    if east - west > most_span or north - south > most_span:
        raise ValueError(f"the box spans more than {most_span} degrees")
    return west, south, east, north


def segment_distance_m(lat, lon, lat1: float, lon1: float, lat2: float, lon2: float) -> Column:
    """Distance to a segment, on the plane that touches the sphere at the segment's mean latitude."""
    import math

    k = math.cos(math.radians((lat1 + lat2) / 2))
    m = math.pi * POLICY.earth_radius_m / 180
    bx, by = (lon2 - lon1) * k * m, (lat2 - lat1) * m
    px, py = (col(lon) - lon1) * F.lit(k * m), (col(lat) - lat1) * F.lit(m)
    along = F.least(F.greatest((px * bx + py * by) / F.lit(max(bx * bx + by * by, 1e-9)), F.lit(0.0)), F.lit(1.0))
    return F.sqrt(F.pow(px - along * bx, 2) + F.pow(py - along * by, 2))
