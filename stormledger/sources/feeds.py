"""Feeds: each reads raw records and returns canonical observations, evidence or events.

A feed is a function from a raw DataFrame; ``FEEDS`` names them, with the trust that their source starts with.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.text import canonical_url, clean_html, let
from ..storage import materialize
from .normalise import category, coordinate, events, first_filled, met_severity, timestamp
from .reader import read_documents


def _slug(c: Column) -> Column:
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z0-9]", "")


def _number(*names: str) -> Column:
    return F.coalesce(*(F.trim(F.col(f"`{n}`").cast("string")).try_cast("double") for n in names))


def _with(raw: DataFrame, *names: str) -> DataFrame:
    """Adds what a feed may leave out."""
    return raw.withColumns({n: F.lit(None).cast("string") for n in names if n not in raw.columns})


def _judged(rows: DataFrame, code: str, rejected: bool, **sound: Column) -> DataFrame:
    """The rows (with ``payload``, their record as JSON) that pass each named test; or, ``rejected``, (source_code, payload, reason) of the others
    with the first test that they fail. A test that is null is failed, so each record is in one of the two."""
    reason = F.coalesce(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in sound.items()))
    if rejected:
        return rows.withColumn("reason", reason).where("reason is not null").select(F.lit(code).alias("source_code"), "payload", "reason")
    return rows.where(reason.isNull()).drop("payload")


def _payload(raw: DataFrame) -> Column:
    return F.to_json(F.struct(*(F.col(f"`{c}`") for c in raw.columns))).alias("payload")


def river_levels(raw: DataFrame, rejected: bool = False) -> DataFrame:
    """Observations from river telemetry; records without station, place or time are ``rejected``."""
    levels = ("River Water Level Telemetry Hourly (meter)", "River Water Level (meter)", "water_level_m", "Water Level (m)")
    r = _with(raw, "Station", "Basin", "River", "District", "State", "Latitude", "Longitude", "Data Acquisition Time", *levels)
    basin = F.coalesce(F.nullif(_slug(F.col("Basin")), F.lit("")), F.lit("GEN"))
    at = F.col("Data Acquisition Time")
    local = F.to_utc_timestamp(F.try_to_timestamp(F.trim(at), F.lit("dd-MM-yyyy HH:mm")), "Asia/Kolkata")
    out = r.select(
        F.concat(F.lit("CWC-"), basin, F.lit("-"), _slug(F.col("Station"))).alias("station_code"), F.trim("Station").alias("station_name"), coordinate(F.col("Latitude"), 90.0).alias("lat"), coordinate(F.col("Longitude"), 180.0).alias("lon"),
        F.coalesce(local, timestamp(at)).alias("observed_at"), _number(*levels).alias("water_level_m"), F.struct(F.col("River").alias("river"), F.col("Basin").alias("basin"), F.col("District").alias("district"), F.col("State").alias("state")).alias("raw_metrics"), _payload(raw),
    )
    placed = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = _judged(out, "CWC", rejected, station=~F.col("station_name").isin("", "-"), coordinates=placed, observed_at=F.col("observed_at").isNotNull())
    return out if rejected else out.withColumn("external_id", F.concat_ws("-", "station_code", F.date_format("observed_at", "yyyyMMddHHmm")))


def _evidence(rows: DataFrame, kind: str, title: Column, url: Column, publisher: Column, language: Column, published: Column, snippet: Column, *more: Column) -> DataFrame:
    link = canonical_url(url)
    return rows.select(
        F.sha2(link, 256).alias("external_id"), F.lit(kind).alias("evidence_type"), title.alias("title"), link.alias("url"), publisher.alias("publisher_domain"), language.alias("language"), published.alias("published_at"), snippet.alias("text_snippet"), *more
    )


def news_articles(raw: DataFrame, rejected: bool = False) -> DataFrame:
    """Evidence from news records with compact times (yyyyMMdd'T'HHmmss'Z'); records without a link are ``rejected``."""
    r = _judged(_with(raw, "url", "title", "domain", "language", "seendate", "excerpt").withColumn("payload", _payload(raw)), "GDELT", rejected, link=F.trim("url") != "")
    if rejected:
        return r
    at = F.try_to_timestamp("seendate", F.lit("yyyyMMdd'T'HHmmss'Z'"))
    return _evidence(r, "NEWS_ARTICLE", clean_html(F.col("title")), F.col("url"), F.lower("domain"), F.col("language"), at, clean_html(F.col("excerpt")))


#: What is kept of a post's media; the media itself isn't.
MEDIA = ("type", "preview_url", "url", "description")


def social_posts(raw: DataFrame, rejected: bool = False) -> DataFrame:
    """Evidence from public posts, others are ``rejected``; the title is the text, cut at 77 characters if it has more than 80.

    ``tags`` are the names in the post's array of that name, ``media`` what its ``media_attachments`` say of themselves; both empty without it.
    """
    r = _judged(_with(raw, "url", "content", "visibility", "created_at", "language").withColumn("payload", _payload(raw)), "MASTODON", rejected, visibility=F.col("visibility") == "public")
    if rejected:
        return r
    text = clean_html(F.col("content"))
    title = F.when(F.length(text) > 80, F.concat(F.substring(text, 1, 77), F.lit("..."))).otherwise(text)
    host = F.regexp_extract(F.lower("url"), r"^[a-z]+://([^/?#]+)", 1)
    tags = F.filter(F.transform("tags", lambda t: t["name"]), lambda n: n != "") if "tags" in raw.columns else None
    media = F.transform("media_attachments", lambda m: F.struct(*(m[f].alias(f) for f in MEDIA))) if "media_attachments" in raw.columns else None
    none = F.from_json(F.lit("[]"), "array<string>"), F.from_json(F.lit("[]"), f"array<struct<{','.join(f'{f}:string' for f in MEDIA)}>>")
    given = [(e if c is None else F.coalesce(c, e)).alias(n) for n, c, e in zip(("tags", "media"), (tags, media), none, strict=True)]
    return _evidence(r, "SOCIAL_POST", title, F.col("url"), host, F.coalesce(F.nullif(F.trim("language"), F.lit("")), F.lit("English")), timestamp(F.col("created_at")), text, *given)


def _record(raw: DataFrame) -> DataFrame:
    """Records of the feed reader with their fields as a map."""
    return raw.withColumn("__f", F.from_json("record", "map<string,string>"))


def _field(*names: str) -> Column:
    return first_filled(*(F.try_element_at("__f", F.lit(n)) for n in names))


def syndicated(raw: DataFrame, most: int = 50, rejected: bool = False) -> DataFrame:
    """Evidence from the records of RSS or Atom documents (see ``reader``), or from whole documents (feed, xml): the first ``most`` items of
    each document, and of items with one link the first by feed and position.

    Items need a title, and a link or an identity that is one. ``rejected`` gives the records that are no evidence, each with its reason.
    """
    items = _record(raw if "record" in raw.columns else read_documents(raw))
    identity = _field("guid", "id")
    link = F.coalesce(_field("link"), F.when(identity.startswith("http"), identity))
    url = canonical_url(link)
    rows = items.select(
        "feed", "position", "record", "reason", F.nullif(clean_html(_field("title")), F.lit("")).alias("title"), F.coalesce(F.nullif(url, F.lit("://")), link).alias("link"),
        clean_html(_field("description", "summary", "content")).alias("body"), timestamp(_field("pubDate", "published", "updated")).alias("at"),
    ).withColumn("key", F.sha2("link", 256))
    sound = F.coalesce("reason", F.when(F.col("title").isNull(), "title").when(F.col("link").isNull(), "link").when(F.col("position") >= most, "beyond the limit"))
    # Read twice below, parsed once.
    rows = materialize(rows.withColumn("reason", sound), "feed-items")
    first = rows.where("reason is null").groupBy("key").agg(F.min(F.struct("feed", "position")).alias("first"))
    told = rows.join(first, "key", "left").withColumn("reason", F.coalesce("reason", F.when(F.struct("feed", "position") != F.col("first"), "duplicate")))
    if rejected:
        return told.where("reason is not null").select(F.lit("RSS").alias("source_code"), "feed", "position", F.col("record").alias("payload"), "reason")
    host = F.regexp_extract(F.lower("link"), r"^[a-z]+://([^/?#]+)", 1)
    return _evidence(told.where("reason is null"), "RSS_ITEM", F.col("title"), F.col("link"), host, F.lit(None).cast("string"), F.col("at"), F.nullif(F.substring("body", 1, 500), F.lit("")))


def polygon_centre(polygon: Column) -> Column:
    """{lat, lon}: the mean of "lat,lon" corners, six decimals."""
    corners = F.filter(F.transform(F.split(F.trim(polygon), r"\s+"), lambda p: F.split(p, ",")), lambda p: F.size(p) == 2)
    mean = lambda c, i: F.round(F.aggregate(c, F.lit(0.0), lambda a, p: a + F.coalesce(F.get(p, F.lit(i)).try_cast("double"), F.lit(0.0))) / F.size(c), 6)
    return let(corners, lambda c: F.when(F.size(c) > 0, F.struct(mean(c, 0).alias("lat"), mean(c, 1).alias("lon"))))


def _pair(c: Column) -> Column:
    """Numbers between commas or blanks."""
    return F.transform(F.split(F.trim(c), r"\s*[,\s]\s*"), lambda x: F.trim(x).try_cast("double"))


def cap_alerts(raw: DataFrame) -> DataFrame:
    """Events from alert records: the place is the first there is of centroid, point, polygon and circle.

    A centroid whose first number exceeds 40 has its longitude first.
    """
    r = _with(raw, "identifier", "event", "areaDesc", "severity", "severity_color", "centroid", "point", "polygon", "circle", "effective_start_time", "effective_end_time")
    pair = _pair
    latlon = lambda p: F.when(F.size(p) >= 2, F.when(p[0] > 40, F.struct(p[1].alias("lat"), p[0].alias("lon"))).otherwise(F.struct(p[0].alias("lat"), p[1].alias("lon"))))
    place = lambda p: let(p, latlon)
    at = F.coalesce(place(pair(F.col("centroid"))), place(pair(F.col("point"))), polygon_centre(F.col("polygon")), place(pair(F.regexp_replace("circle", r"\s+\d+(\.\d+)?$", ""))))
    out = r.withColumn("__at", at).select(
        F.col("identifier").alias("external_id"), F.col("event").alias("title"), F.col("areaDesc").alias("location_name"), met_severity(first_filled(F.col("severity_color"), F.col("severity"))).alias("severity"),
        category(F.col("event"), F.col("event")).alias("category_code"), F.col("__at.lat").alias("lat"), F.col("__at.lon").alias("lon"), timestamp(F.col("effective_start_time")).alias("occurred_at"), timestamp(F.col("effective_end_time")).alias("valid_until"),
    )
    return out.where("lat between -90 and 90 and lon between -180 and 180")


def alerts(raw: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(events, rejected) from the records of RSS, Atom, CAP or JSON documents of alerts (see ``reader``).

    Each record is brought to the payload of an event and goes through the common normaliser, which rejects one without a place or with an
    implausible time; what the reader could not read is rejected with its reason. A record without an identity is named by area, time and hazard.
    """
    code = "NDMA"
    rows = _record(raw)
    hazard = F.coalesce(_field("disaster_type", "event", "category", "hazard"), F.lit("Disaster Alert"))
    area = _field("area_description", "areaDesc", "area", "district")
    location = F.try_element_at("__f", F.lit("location"))
    shape = F.from_json(F.get_json_object(location, "$.coordinates"), "array<double>")
    area = F.coalesce(area, F.when(~location.startswith("{"), first_filled(location)))
    start = _field("effective_start_time", "sent", "effective", "onset", "pubDate", "published", "updated")
    two = lambda p, i, j: F.when(F.size(p) >= 2, F.struct(p[i].alias("lat"), p[j].alias("lon")))
    centroid = let(_pair(F.regexp_replace(_field("centroid"), r"[\[\]]", "")), lambda p: F.when(F.size(p) == 2, F.when(p[0] > 40, two(p, 1, 0)).otherwise(two(p, 0, 1))))
    named = lambda lat, lon: F.when(_field(lat).isNotNull() & _field(lon).isNotNull(), F.struct(_field(lat).try_cast("double").alias("lat"), _field(lon).try_cast("double").alias("lon")))
    at = F.coalesce(centroid, two(shape, 1, 0), let(_pair(_field("point")), lambda p: two(p, 0, 1)), named("lat", "long"), named("latitude", "longitude"), polygon_centre(_field("polygon")), let(_pair(F.regexp_replace(_field("circle"), r"\s.*$", "")), lambda p: two(p, 0, 1)))
    told = F.coalesce(_field("warning_message", "description", "summary", "instruction"), F.concat(F.lit("NDMA SACHET alert for "), F.coalesce(area, F.lit("affected area"))))
    advice = _field("instruction")
    told = F.when(advice.isNotNull() & ~F.contains(told, advice), F.concat(told, F.lit("\n\nInstructions: "), advice)).otherwise(told)
    title = F.coalesce(_field("headline", "title"), F.concat(F.lit("NDMA SACHET: "), hazard, F.lit(" in "), F.coalesce(area, F.lit("Affected Area"))))
    spelled = lambda c: F.regexp_replace(F.regexp_replace(c, "[^A-Za-z0-9]", "_"), "^_+|_+$", "")
    own = F.regexp_replace(F.regexp_replace(_field("identifier", "guid", "id", "alert_id", "link"), r"[^a-zA-Z0-9_\-.]", "_"), "^_+|_+$", "")
    made = F.concat_ws("-", spelled(F.upper(F.coalesce(area, F.lit("NATIONAL")))), spelled(start), spelled(F.upper(F.coalesce(_field("disaster_type", "event", "headline"), F.lit("ALERT")))))
    level = _field("severity_color", "severity", "severity_level", "urgency", "color_code", "alert_level")
    payload = F.to_json(F.struct(
        title.alias("title"), told.alias("description"), at["lat"].alias("latitude"), at["lon"].alias("longitude"), area.alias("location_name"), met_severity(level).alias("severity"),
        category(hazard, told).alias("category_code"), start.alias("occurred_at"), F.concat(F.lit("NDMA-"), F.coalesce(F.nullif(own, F.lit("")), made)).alias("external_id"),
    ))
    # Written once: the normaliser reads some thirty fields of a payload, and would build it for each.
    rows = materialize(rows.select("feed", "position", "reason", F.when(F.col("reason").isNull(), payload).otherwise(F.col("record")).alias("payload")), "alerts")
    unread = rows.where("reason is not null").select("feed", "position", "payload", F.lit(code).alias("source_code"), "reason")
    good, bad = events(rows.where("reason is null").drop("reason"), code, now)
    return good, unread.unionByName(bad, allowMissingColumns=True)


# Event types and alert levels of the global alert feed.
GLOBAL_TYPES = {"FL": "FLOOD_WATERLOGGING", "TC": "CYCLONE_STORM", "DR": "DROUGHT"}
GLOBAL_LEVELS = {"red": "SEVERE", "orange": "HIGH", "green": "LOW", "3": "SEVERE", "2": "HIGH", "1": "LOW"}


def global_alerts(raw: DataFrame, country: str = "india") -> DataFrame:
    """Events of one country from documents (doc: JSON) that hold their records under one of five names, as GeoJSON or plain."""
    record = "struct<eventid:string,id:string,eventtype:string,name:string,alertlevel:string,fromdate:string,country:string,latitude:double,longitude:double,coordinates:array<double>>"
    lists = [F.from_json(F.get_json_object("doc", f"$.{k}"), f"array<struct<properties:{record},geometry:struct<coordinates:array<double>>,{record[7:]}>") for k in ("features", "events", "items", "results", "data")]
    rows = raw.select(F.explode(F.coalesce(*lists)).alias("e"))
    get = lambda f: F.coalesce(F.col(f"e.properties.{f}"), F.col(f"e.{f}"))
    xy = F.coalesce(F.col("e.geometry.coordinates"), get("coordinates"))
    lookup = lambda table, c: F.try_element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), c)
    ident = F.coalesce(get("eventid"), get("id"), F.substring(F.sha2(F.concat_ws(":", get("eventtype"), get("name"), get("fromdate")), 256), 1, 16))
    out = rows.where(F.array_contains(F.split(F.lower(get("country")), r"\s*[,;]\s*"), country)).select(
        F.concat_ws("-", F.lit("GDACS"), F.upper(F.coalesce(get("eventtype"), F.lit("UNKNOWN"))), ident).alias("external_id"), get("name").alias("title"), F.coalesce(lookup(GLOBAL_TYPES, F.upper(get("eventtype"))), F.lit("OTHER")).alias("category_code"),
        F.coalesce(lookup(GLOBAL_LEVELS, F.lower(get("alertlevel"))), F.lit("MODERATE")).alias("severity"), timestamp(get("fromdate")).alias("occurred_at"), F.coalesce(get("latitude"), F.get(xy, F.lit(1))).alias("lat"), F.coalesce(get("longitude"), F.get(xy, F.lit(0))).alias("lon"),
    )
    return out.where("lat between -90 and 90 and lon between -180 and 180")


def met_warnings(raw: DataFrame, rejected: bool = False) -> DataFrame:
    """Events from a met office's district warnings, with an identity made of district, kind and time of issue; those without a place are ``rejected``."""
    r = _with(raw, "district", "warning_type", "color_code", "issue_time", "latitude", "longitude")
    out = r.select(
        F.concat_ws("-", F.lit("IMD"), _slug(F.col("district")), _slug(F.col("warning_type")), F.date_format(timestamp(F.col("issue_time")), "yyyyMMddHHmm")).alias("external_id"), F.concat_ws(" warning for ", "warning_type", "district").alias("title"),
        met_severity(F.col("color_code")).alias("severity"), category(F.col("warning_type"), F.col("warning_type")).alias("category_code"), coordinate(F.col("latitude"), 90.0).alias("lat"), coordinate(F.col("longitude"), 180.0).alias("lon"), timestamp(F.col("issue_time")).alias("occurred_at"), _payload(raw),
    )
    return _judged(out, "IMD", rejected, coordinates=F.col("lat").isNotNull() & F.col("lon").isNotNull())


HOURLY = ("precipitation", "temperature_2m", "relative_humidity_2m", "wind_speed_10m", "wind_direction_10m", "surface_pressure")


def hourly_model(raw: DataFrame, now: Column) -> DataFrame:
    """Observations from parallel hourly arrays (city, lat, lon, hourly): of each city the last hour that isn't after ``now``."""
    # Each record is brought to its own last hour before any hours of a city meet, so nothing is exploded.
    values = F.struct(*(F.get(F.col(f"hourly.{c}"), F.col("i")).cast("double").alias(c) for c in HOURLY))
    times = F.transform("hourly.time", lambda t, i: F.struct(timestamp(t).alias("at"), (-i).alias("i")))
    own = raw.select("city", "lat", "lon", "hourly", F.array_max(F.filter(times, lambda x: x["at"] <= now)).alias("x")).where("x is not null")
    rows = own.select("city", "lat", "lon", F.col("x.at").alias("observed_at"), (-F.col("x.i")).alias("i"), "hourly").select("city", "lat", "lon", "observed_at", values.alias("v")).select("city", "lat", "lon", "observed_at", "v.*")
    last = F.max_by(F.struct("observed_at", "lat", "lon", *HOURLY), "observed_at")
    return rows.groupBy("city").agg(last.alias("x")).select(F.col("city").alias("station_code"), "x.*")


def nearest_slot(series: DataFrame, at: Column, keys: list[str]) -> DataFrame:
    """Per key the hour closest to a moment, the earlier of two."""
    gap = F.abs(F.unix_timestamp("observed_at") - F.unix_timestamp(at))
    return series.groupBy(*keys).agg(F.min_by(F.struct(*series.columns), F.struct(gap.alias("g"), F.col("observed_at"))).alias("x")).select("x.*")


def demo_reports(spark, n: int = 10) -> DataFrame:
    """Made reports, the same each time."""
    k = F.col("id")
    return spark.range(n).select(F.concat(F.lit("DEMO-"), k.cast("string")).alias("external_id"), F.concat(F.lit("[DEMO] report "), k.cast("string")).alias("title"), (18 + k % 10).cast("double").alias("lat"), (73 + k % 7).cast("double").alias("lon"))


#: Feed by source code: (reader, base trust).
FEEDS: dict[str, tuple[Callable[..., DataFrame], float]] = {
    "CWC": (river_levels, 0.92), "GDELT": (news_articles, 0.70), "MASTODON": (social_posts, 0.60), "RSS": (syndicated, 0.70), "NDMA": (cap_alerts, 0.95),
    "GDACS": (global_alerts, 0.88), "IMD": (met_warnings, 0.90), "OPEN_METEO": (hourly_model, 0.80), "DEMO": (demo_reports, 0.75),
}
