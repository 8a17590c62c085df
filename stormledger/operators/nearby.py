"""What lies around a point or along a path."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m, inside, segment_distance_m


def within(df: DataFrame, lat: float, lon: float, radius_m: float, limit: int | None = None) -> DataFrame:
    """Rows within the radius with ``distance_m``, nearest first. A box that the scan can use comes before the exact test."""
    dlat = radius_m / 111_000
    dlon = dlat / max(0.01, math.cos(math.radians(lat)))
    boxed = df.where(inside("lat", "lon", lon - dlon, lat - dlat, lon + dlon, lat + dlat))
    out = boxed.withColumn("distance_m", haversine_m(F.lit(lat), F.lit(lon), "lat", "lon")).where(F.col("distance_m") <= radius_m)
    return out.orderBy("distance_m", "id").limit(limit) if limit else out


def trusted() -> Column:
    """What the public may see: verified, or under review and credible."""
    return (F.col("status") == "VERIFIED") | ((F.col("status") == "UNDER_REVIEW") & (F.col("credibility") >= 0.70))


def along(df: DataFrame, path: list[tuple[float, float]], corridor_m: float) -> DataFrame:
    """Rows within the corridor around a path of (lat, lon) points, with ``distance_m`` to it."""
    parts = [segment_distance_m("lat", "lon", *a, *b) for a, b in zip(path, path[1:], strict=False)] or [haversine_m(F.lit(path[0][0]), F.lit(path[0][1]), "lat", "lon")]
    nearest = F.least(*parts) if len(parts) > 1 else parts[0]
    dlat = corridor_m / 100_000
    lats, lons = [p[0] for p in path], [p[1] for p in path]
    dlon = dlat / max(0.01, math.cos(math.radians(max(map(abs, lats)))))
    boxed = df.where(inside("lat", "lon", min(lons) - dlon, min(lats) - dlat, max(lons) + dlon, max(lats) + dlat))
    return boxed.withColumn("distance_m", nearest).where(F.col("distance_m") <= corridor_m)
