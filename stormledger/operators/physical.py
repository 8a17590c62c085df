"""Physical corroboration: weather readings against what a category claims."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published thresholds of weather services, by category: (variable, test, bound), the first that holds decides.
SUPPORTS = {
    "HEAVY_RAINFALL": (("rain_24h", ">=", 64.5), ("rain_1h", ">=", 15.0)),
    "FLOOD_WATERLOGGING": (("rain_24h", ">=", 64.5), ("level_m", ">", 0.0)),
    "URBAN_FLOOD": (("rain_1h", ">=", 20.0), ("rain_3h", ">=", 40.0)),
    "CYCLONE_STORM": (("wind", ">=", 62.0), ("gust", ">=", 80.0), ("pressure", "<=", 990.0)),
    "STRONG_WIND": (("wind", ">=", 50.0), ("gust", ">=", 60.0)),
    "FOG": (("visibility", "<=", 500.0),),
    "HEATWAVE": (("temp", ">=", 40.0),),
    "LANDSLIDE": (("rain_72h", ">=", 100.0),),
}
THUNDER_CODES, HAIL_CODES = (91, 92, 95, 96, 99), (89, 90, 96, 99)
STATION_KM, MODEL_KM = 25.0, 20.0
SLOW_HOURS, FAST_HOURS = 24.0, 3.0
SLOW = ("HEAVY_RAINFALL", "FLOOD_WATERLOGGING", "URBAN_FLOOD", "LANDSLIDE", "HEATWAVE")
MOST = 0.10


def _holds(variable: str, test: str, bound: float) -> Column:
    v = F.col(variable)
    return F.coalesce({">=": v >= bound, ">": v > bound, "<=": v <= bound}[test], F.lit(False))


def evaluate(rows: DataFrame, allow_model_denials: bool = False) -> DataFrame:
    """Adds ``verdict``, ``status``, ``weight`` and ``contribution``.

    Takes (category_code, source_kind STATION or MODEL, distance_km, gap_hours) and readings (rain_1h, rain_3h,
    rain_24h, rain_72h, level_m, wind, gust, pressure, visibility, humidity, temp, weather_code), all of which may be null.
    What is too far or too old is neutral. A model's denials are suppressed unless allowed.
    """
    c = F.col
    station = c("source_kind") == "STATION"
    reach = F.when(station, STATION_KM).otherwise(MODEL_KM)
    hours = F.when(c("category_code").isin(*SLOW), SLOW_HOURS).otherwise(FAST_HOURS)
    supports = F.lit(False)
    for cat, rules in SUPPORTS.items():
        some = F.lit(False)
        for rule in rules:
            some = some | _holds(*rule)
        supports = supports | ((c("category_code") == cat) & some)
    yes = lambda x: F.coalesce(x, F.lit(False))
    light = lambda most: c("wind").isNull() | (c("wind") <= most)
    supports = supports | (c("category_code") == "DUST_STORM") & yes(c("visibility") < 1000.0) & (c("gust").isNull() | (c("gust") >= 40.0))
    supports = supports | (c("category_code") == "THUNDERSTORM_LIGHTNING") & (yes(c("weather_code").isin(*THUNDER_CODES)) | yes(c("rain_1h") >= 15.0))
    supports = supports | (c("category_code") == "HAILSTORM") & yes(c("weather_code").isin(*HAIL_CODES))
    denies = (
        (c("category_code") == "HEAVY_RAINFALL") & yes(c("rain_24h") <= 0.1)
        | (c("category_code") == "CYCLONE_STORM") & yes(c("gust") <= 20.0) & light(15.0)
        | (c("category_code") == "STRONG_WIND") & yes(c("gust") <= 20.0) & light(10.0)
        | (c("category_code") == "DUST_STORM") & yes(c("visibility") > 6000.0) & (c("gust").isNull() | (c("gust") <= 15.0))
        | (c("category_code") == "FOG") & yes(c("visibility") > 3000.0) & (c("humidity").isNull() | (c("humidity") < 70.0))
        | (c("category_code") == "HEATWAVE") & yes(c("temp") <= 32.0)
    )
    status = F.when(c("distance_km") > reach, "TOO_FAR").when(c("gap_hours") > hours, "STALE_DATA").otherwise("OK")
    suppressed = ~station & F.lit(not allow_model_denials)
    verdict = F.when(c("status") != "OK", "NEUTRAL").when(supports, "SUPPORTS").when(denies & ~suppressed, "CONTRADICTS").otherwise("NEUTRAL")
    weight = F.when(station, 1.0).otherwise(0.6) * F.greatest(1 - c("distance_km") / reach, F.lit(0.2)) * F.greatest(1 - c("gap_hours") / hours, F.lit(0.3))
    gain = F.when(c("verdict") == "SUPPORTS", F.least(MOST * c("weight"), F.lit(MOST))).when(c("verdict") == "CONTRADICTS", -F.least(0.12 * c("weight"), F.lit(MOST))).otherwise(0.0)
    out = rows.withColumn("status", status).withColumn("verdict", verdict)
    return out.withColumn("weight", F.when(c("status") == "OK", F.round(weight, 4)).otherwise(0.0)).withColumn("contribution", F.round(gain, 4))


def cache_key(lat: Column, lon: Column, at: Column) -> Column:
    """Quarter-degree cell and hour: readings are fetched once for each."""
    cell = lambda v: F.format_string("%.2f", F.bround(v / 0.25, 0) * 0.25)
    return F.concat_ws(":", cell(lat), cell(lon), F.date_format(at, "yyyyMMddHH"))
