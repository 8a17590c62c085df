"""Fields of raw feed records in canonical form, as column expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.text import keyword_class, let
from ..plans.domain import CATEGORIES

# Labels of severity.
SEVERITY = {
    "critical": "SEVERE", "extreme": "SEVERE", "severe": "SEVERE", "danger": "SEVERE", "red": "SEVERE", "high": "HIGH", "orange": "HIGH", "warning": "HIGH",
    "moderate": "MODERATE", "medium": "MODERATE", "yellow": "MODERATE", "low": "LOW", "minor": "LOW", "green": "LOW", "advisory": "LOW",
}
# A met office's colours and levels.
MET_SEVERITY = SEVERITY | {
    "amber": "HIGH", "white": "LOW", "very heavy": "SEVERE", "heavy": "HIGH", "moderate to heavy": "HIGH", "alert": "HIGH", "light to moderate": "MODERATE", "watch": "MODERATE",
    "light": "LOW", "very light": "LOW", "no warning": "LOW", "nil": "LOW",
}
# Names of categories in feeds, by category.
NAMES = {
    "THUNDERSTORM_LIGHTNING": ("thunderstorm", "lightning", "thunder", "squall", "bijli", "bijlee", "garaj"),
    "HEAVY_RAINFALL": ("cloudburst", "heavy_rain", "rainfall", "downpour", "deluge", "rain", "baarish", "barish", "barsat", "musladhar"),
    "FLOOD_WATERLOGGING": ("waterlogging", "waterlog", "flooding", "flood", "inundation", "baadh", "badh", "jalbharao", "jalbhorao"),
    "URBAN_FLOOD": ("urban_flood", "urban_flooding", "city_flood", "shahri_baadh"),
    "HAILSTORM": ("hailstorm", "hail", "olavrishti", "ole", "ola"),
    "LANDSLIDE": ("landslide", "mudslide", "rockfall", "bhooskhalan", "bhuskhalan"),
    "CYCLONE_STORM": ("cyclone_gale", "cyclone_storm", "cyclone", "gale", "storm", "chakravat", "samudri_toofan"),
    "HEATWAVE": ("heatwave", "extreme_heat", "heat", "loo", "garmi", "tapman"),
    "DROUGHT": ("drought", "dry_spell", "water_scarcity", "sookha", "sukha", "akaal"),
    "FOG": ("dense_fog", "fog", "mist", "smog", "kohra", "dhund", "kuhra"),
    "DUST_STORM": ("dust_storm", "sandstorm", "dust", "dhool_toofan", "dhool_aandhi", "retila_toofan"),
    "STRONG_WIND": ("strong_wind", "high_wind", "gust", "wind", "tez_hawa", "jhakkad", "aandhi"),
}
# The formats of times, tried in this order.
TIME_FORMATS = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd", "dd-MM-yyyy HH:mm:ss", "dd/MM/yyyy HH:mm:ss", "d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss 'GMT'", "MMM d HH:mm:ss yyyy")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(F.when(F.trim(c) != "", F.trim(c)) for c in columns))


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), c)


def severity(c: Column, default: str = "MODERATE") -> Column:
    return F.coalesce(_lookup(F.lower(F.trim(c)), SEVERITY), F.lit(default))


def met_severity(c: Column) -> Column:
    """The exact label, else the longest one that the text holds."""
    held = sorted(MET_SEVERITY, key=lambda x: (-len(x), x))
    return let(F.lower(F.trim(c)), lambda t: F.coalesce(_lookup(t, MET_SEVERITY), *(F.when(t.contains(x), MET_SEVERITY[x]) for x in held), F.lit("MODERATE")))


def category(raw: Column, title: Column) -> Column:
    """A canonical name, else a known name, else the longest known one inside, else what the title's words say."""
    names = {n: c for c, ns in NAMES.items() for n in ns}
    ordered = sorted(names, key=lambda n: (-len(n), n))
    inside = lambda c: F.coalesce(*(F.when(c.contains(n), names[n]) for n in ordered))
    spelled = lambda c: F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_"))
    coded = lambda c: F.coalesce(_lookup(c, {"CYCLONE_GALE": "CYCLONE_STORM", "EXTREME_HEAT": "HEATWAVE"}), F.when(c.isin(*CATEGORIES), c))
    named = let(spelled(raw), lambda c: F.coalesce(_lookup(c, names), inside(c)))
    told = let(keyword_class(title), lambda x: F.when(x != "OTHER", x))
    return F.coalesce(let(F.upper(F.trim(raw)), coded), named, told, let(spelled(title), inside), F.lit("OTHER"))


def coordinate(c: Column, most: float) -> Column:
    v = F.trim(c.cast("string")).try_cast("double")
    return F.when(v.between(-most, most), v)


def timestamp(c: Column) -> Column:
    """Epoch seconds, ISO times, times in India marked IST, and the listed formats; without a zone UTC."""

    def read(t: Column) -> Column:
        epoch = F.when(t.rlike(r"^\d{9,11}(\.\d+)?$"), F.timestamp_seconds(t.try_cast("double")))
        iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?)?$"), t.try_cast("timestamp"))
        bare = F.regexp_replace(F.regexp_replace(t, r"^(Mon|Tue|Wed|Thu|Fri|Sat|Sun),?\s+", ""), r"\s+", " ")
        local = lambda b: F.try_to_timestamp(F.trim(F.regexp_replace(F.replace(b, F.lit("IST"), F.lit("")), r"\s+", " ")), F.lit("MMM d HH:mm:ss yyyy"))
        listed = lambda b: F.coalesce(F.when(b.contains("IST"), F.to_utc_timestamp(local(b), "Asia/Kolkata")), *(F.try_to_timestamp(b, F.lit(f)) for f in TIME_FORMATS))
        return F.coalesce(epoch, iso, let(bare, listed))

    return let(F.trim(c.cast("string")), read)


def plausible(c: Column, now: Column) -> Column:
    """Null where more than a day in the future or a year in the past."""
    return F.when((c <= now + F.expr("INTERVAL 24 HOURS")) & (c >= now - F.expr("INTERVAL 365 DAYS")), c)


def events(raw: DataFrame, source_code: str, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) from rows (payload: JSON text): aliases of fields are tried in order.

    Rejected rows keep their payload, and their feed and position if they have them, and say why.
    """
    get = lambda *paths: first_filled(*(F.get_json_object("payload", f"$.{p}") for p in paths))
    title = F.coalesce(get("title", "headline", "event_name", "summary"), F.lit(f"Weather event from {source_code}"))
    title = F.when(F.length(title) < 3, F.lit(f"Weather Report ({source_code})")).when(F.length(title) > 255, F.concat(F.substring(title, 1, 252), F.lit("..."))).otherwise(title)
    when = get("occurred_at", "timestamp", "time", "date", "pubDate", "published_at")
    rows = raw.withColumns({"title": title, "__when": when}).withColumns(
        {"lat": coordinate(get("latitude", "lat", "geo_lat", "location.lat"), 90.0), "lon": coordinate(get("longitude", "lon", "long", "geo_lon", "location.lon"), 180.0),
         "occurred_at": F.when(F.col("__when").isNull(), now).otherwise(plausible(timestamp(F.col("__when")), now)), "severity": severity(get("severity", "alert_level", "level")),
         "category_code": category(F.coalesce(get("category", "category_code", "event_type", "type"), F.lit("")), F.col("title")), "description": F.substring(get("description", "body", "details"), 1, 5000),
         "location_name": F.substring(get("location_name", "place", "area"), 1, 255), "external_id": F.substring(get("external_id", "id", "event_id", "guid"), 1, 255), "source_code": F.lit(source_code)}
    )
    why = F.when(F.col("lat").isNull() | F.col("lon").isNull(), "coordinates").when(F.col("occurred_at").isNull(), "occurred_at")
    rows = rows.withColumn("reason", why).drop("__when")
    return rows.where("reason is null").drop("reason"), rows.where("reason is not null").select(*(c for c in ("feed", "position") if c in raw.columns), "payload", "source_code", "reason")
