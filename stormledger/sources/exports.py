"""Exports of incidents: CSV and GeoJSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rounding import fixed_places


def csv_rows(df: DataFrame, limit: int = 50_000) -> DataFrame:
    """The rows of a CSV export: newest first, numbers with fixed decimals, empty text for nulls."""
    if not 1 <= limit <= 50_000:
        raise ValueError("a CSV export has 1 to 50000 rows")
    text = lambda c: F.coalesce(c, F.lit(""))
    fixed = lambda c, n: text(F.when(F.col(c).isNotNull(), fixed_places(F.col(c), n)))
    top = df.orderBy(F.col("occurred_at").desc(), F.col("id").desc()).limit(limit)
    return top.select(
        F.col("id").cast("string").alias("id"), "tracking_id", "category_code", "severity", "status", fixed("credibility", 2).alias("credibility"), fixed("lat", 6).alias("lat"), fixed("lon", 6).alias("lon"),
        text(F.col("location_name")).alias("location_name"), text(F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss")).alias("occurred_at"), F.initcap(F.col("is_demo").cast("string")).alias("is_demo"),
    )


def write_csv(df: DataFrame, path: str, limit: int = 50_000) -> None:
    csv_rows(df, limit).write.option("header", True).csv(path)


def geojson_features(df: DataFrame) -> DataFrame:
    """(feature): one GeoJSON feature in a line for each incident that has a place."""
    point = F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates"))
    properties = F.struct("id", "category_code", "severity", "status", "credibility")
    feature = F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), properties.alias("properties"))
    return df.where("lat is not null and lon is not null").select(F.to_json(feature).alias("feature"))
