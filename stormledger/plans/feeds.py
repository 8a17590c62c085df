"""Queries over feeds: pages as items of RSS documents and as alerts, written to files and read by the feed source, each beside its SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import duplicates as du
from ..operators import evidence as ev
from ..sources import exports as ex
from ..sources import feeds as fe
from ..sources.reader import register
from ..storage import shared_dir
from . import domain as dm
from .catalogue import query
from .domain import table

#: Items of a document; those behind the first thirty are beyond the limit.
_ITEMS, _MOST = 40, 30
_AT = "2024-01-08 00:00:00"
_HAZARDS = ("Heavy rain", "Hailstorm", "Flood warning", "Dense fog", "Unnamed")
_COLOURS = ("red", "orange", "yellow", "green", "")


def _escaped(c):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def _text(*parts):
    return F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts))


def _written(documents: DataFrame, name: str) -> str:
    """(feed, value) as files, one for each feed."""
    path = f"{shared_dir(documents.sparkSession)}/{name}-{uuid.uuid4().hex}"
    documents.select(F.lpad(F.col("feed").cast("string"), 9, "0").alias("feed"), "value").write.partitionBy("feed").text(path)
    register(documents.sparkSession)
    return path


def _syndicated(spark: SparkSession, sf_dir: str) -> str:
    """RSS documents of forty pages each: some items have no link, no title or a link that others have, and every fifth document breaks off."""
    k = F.col("page_id")
    title = F.when(k % 9 == 4, F.lit("")).otherwise(F.regexp_replace(F.regexp_extract("html", r"(?s)<title>(.*?)</title>", 1), r"[\x00-\x1F]", " "))
    link = F.when(k % 7 == 3, F.lit("")).when(k % 11 == 5, _text("http://repeat.example.com/", (k % 6).cast("string"))).otherwise(F.col("url"))
    item = _text("<item><title>", _escaped(title), "</title><link>", _escaped(link), "</link><pubDate>", F.date_format(dm.minutes_after(_AT, k), "yyyy-MM-dd'T'HH:mm:ss'Z'"), "</pubDate></item>")
    items = table(spark, sf_dir, "pages").select(k, F.floor(k / _ITEMS).alias("feed"), item.alias("item"))
    # At most forty items meet in a document.
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "item"))), lambda x: x["item"]), "")
    documents = items.groupBy("feed").agg(body.alias("b")).select("feed", _text('<?xml version="1.0"?><rss><channel>', F.col("b"), F.when(F.col("feed") % 5 == 3, "").otherwise("</channel></rss>")).alias("value"))
    return _written(documents, "rss")


def _entry(c, name: str):
    return _text(f"<{name}>", c, f"</{name}>")


def _alerts(spark: SparkSession, sf_dir: str) -> str:
    """Alerts of pages, fifty to a document: JSON lists and Atom documents by turns. Some have no place, some a time long past; the place is a centroid, a point or a polygon."""
    k = F.col("page_id")
    lat, lon = (F.format_string("%.2f", (base + k * m % n / F.lit(100.0)).cast("double")) for base, m, n in ((10, 37, 2000), (70, 53, 2000)))
    place = F.when(k % 13 == 6, F.create_map(F.lit("note"), F.lit("none"))).when(k % 3 == 0, F.create_map(F.lit("centroid"), _text(lon, ",", lat))).when(k % 3 == 1, F.create_map(F.lit("point"), _text(lat, " ", lon))).otherwise(F.create_map(F.lit("polygon"), _text(lat, ",", lon, " ", lat, ",", lon)))
    sent = F.date_format(F.when(k % 17 == 8, F.lit("2001-01-01 00:00:00").cast("timestamp")).otherwise(dm.minutes_after(_AT, k)), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    fields = F.map_concat(F.create_map(F.lit("identifier"), _text("A:", k.cast("string")), F.lit("event"), dm.pick(_HAZARDS, k), F.lit("severity"), dm.pick(_COLOURS, F.floor(k / 5)), F.lit("sent"), sent), place)
    rows = table(spark, sf_dir, "pages").select(k, F.floor(k / 50).alias("feed"), F.to_json(fields).alias("j"), F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat(F.lit("<"), e["key"], F.lit(">"), e["value"], F.lit("</"), e["key"], F.lit(">"))), "").alias("x"))
    listed = F.array_sort(F.collect_list(F.struct("page_id", "j", "x")))
    pick = lambda name: F.transform(F.col("l"), lambda e: e[name])
    atom = _text('<feed xmlns="http://www.w3.org/2005/Atom">', F.array_join(F.transform(pick("x"), lambda e: F.concat(F.lit("<entry>"), e, F.lit("</entry>"))), ""), "</feed>")
    return _written(rows.groupBy("feed").agg(listed.alias("l")).select("feed", F.when(F.col("feed") % 2 == 0, _text('{"alerts":[', F.array_join(pick("j"), ","), "]}")).otherwise(atom).alias("value")), "alerts")


_RSS = rf"""i AS (SELECT page_id, page_id // {_ITEMS} AS feed, page_id % {_ITEMS} AS position, CASE WHEN page_id % 9 = 4 THEN '' ELSE regexp_replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '[\x00-\x1F]', ' ', 'g') END AS t,
  CASE WHEN page_id % 7 = 3 THEN '' WHEN page_id % 11 = 5 THEN 'http://repeat.example.com/' || (page_id % 6) ELSE url END AS raw FROM pages),
 c AS (SELECT *, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(t, '<[^>]+>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\r\n\f]+', ' ', 'g')) AS title,
  regexp_extract(trim(raw), '^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)', ['s', 'h', 'p', 'q']) AS x FROM i),
 u AS (SELECT *, lower(x.s) || '://' || lower(x.h) || regexp_replace(x.p, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM (SELECT *, array_to_string(list_filter(string_split(x.q, '&'), lambda z: z <> '' AND NOT regexp_matches(z, '^(utm_|fbclid|gclid|ref|mc_)')), '&') AS q FROM c)),
 s AS (SELECT *, CASE WHEN feed % 5 = 3 THEN 'malformed' WHEN title = '' THEN 'title' WHEN raw = '' THEN 'link' WHEN position >= {_MOST} THEN 'beyond the limit' END AS why FROM u),
 j AS (SELECT *, CASE WHEN why IS NOT NULL THEN why WHEN row_number() OVER (PARTITION BY why IS NULL, url ORDER BY page_id) > 1 THEN 'duplicate' ELSE 'accepted' END AS reason FROM s)"""


@query(f"WITH {_RSS} SELECT sha256(url) AS external_id, url, title, TIMESTAMP '{_AT}' + to_minutes(CAST(page_id AS INTEGER)) AS published_at FROM j WHERE reason = 'accepted'")
def feed_items(spark, sf_dir):
    raw = spark.read.format("hazard_feed").load(_syndicated(spark, sf_dir))
    return fe.syndicated(raw, _MOST).select("external_id", "url", "title", "published_at")


@query(f"WITH {_RSS} SELECT reason, count(*) AS n FROM (SELECT reason FROM j WHERE reason <> 'malformed' UNION ALL SELECT reason FROM (SELECT DISTINCT feed, reason FROM j WHERE reason = 'malformed')) GROUP BY 1")
def feed_quarantine(spark, sf_dir):
    """How many records were accepted, and why the others weren't; a document that can't be read is one record."""
    raw = spark.read.format("hazard_feed").load(_syndicated(spark, sf_dir))
    good = fe.syndicated(raw, _MOST).select(F.lit("accepted").alias("reason"))
    return good.unionByName(fe.syndicated(raw, _MOST, rejected=True).select("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(f"""SELECT 'NDMA-A_' || page_id AS external_id, {dm._sql_pick(_HAZARDS, "page_id")} AS hazard, {dm._sql_pick(("HEAVY_RAINFALL", "HAILSTORM", "FLOOD_WATERLOGGING", "FOG", "OTHER"), "page_id")} AS category_code, {dm._sql_pick(("SEVERE", "HIGH", "MODERATE", "LOW", "MODERATE"), "page_id // 5")} AS severity,
 CASE WHEN page_id % 13 <> 6 AND page_id % 17 <> 8 THEN 10 + page_id * 37 % 2000 / 100.0::DOUBLE END AS lat, CASE WHEN page_id % 13 <> 6 AND page_id % 17 <> 8 THEN 70 + page_id * 53 % 2000 / 100.0::DOUBLE END AS lon, CASE WHEN page_id % 13 <> 6 AND page_id % 17 <> 8 THEN TIMESTAMP '{_AT}' + to_minutes(CAST(page_id AS INTEGER)) END AS occurred_at,
 CASE WHEN page_id % 13 = 6 THEN 'coordinates' WHEN page_id % 17 = 8 THEN 'occurred_at' END AS reason FROM pages""")
def alert_feed(spark, sf_dir):
    """Alerts of both kinds of document, accepted and rejected; ``hazard`` is cut from the title that the normaliser made.

    A document is read in the minute of its last alert, so what is plausible doesn't hang on how many pages there are.
    """
    now = dm.minutes_after(_AT, F.regexp_extract("feed", r"feed=0*(\d+)/", 1).cast("long") * 50 + 49)
    good, bad = fe.alerts(spark.read.format("hazard_feed").load(_alerts(spark, sf_dir)), now)
    told = lambda f: F.get_json_object("payload", f"$.{f}")
    columns = [told("external_id").alias("external_id"), F.regexp_extract(told("title"), "^NDMA SACHET: (.*) in Affected Area$", 1).alias("hazard"), told("category_code").alias("category_code"), told("severity").alias("severity")]
    none = [F.lit(None).cast(t).alias(c) for c, t in (("lat", "double"), ("lon", "double"), ("occurred_at", "timestamp"))]
    return good.select(*columns, "lat", "lon", "occurred_at", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(*columns, *none, "reason"))


@query("SELECT page_id // 50 AS feed, CASE WHEN page_id // 50 % 2 = 0 THEN 'json' ELSE 'feed' END AS root, count(*) AS n FROM pages GROUP BY 1, 2")
def feed_stream(spark, sf_dir):
    """The same documents as a stream: records by document, each once."""
    from ..streaming.jobs import run_batches

    path = _alerts(spark, sf_dir)
    run_batches(spark.readStream.format("hazard_feed").load(path), lambda b, i: b.write.mode("overwrite").parquet(f"{path}-out/batch={i}"), f"{path}-checkpoint")
    return spark.read.parquet(f"{path}-out").groupBy(F.regexp_extract("feed", r"feed=0*(\d+)/", 1).cast("long").alias("feed"), "root").agg(F.count("*").alias("n"))


# --- feeds whose records are rows already

_STATIONS = ("Kol-1", " Sangam Bridge ", "-", "Ghat No. 4", "")
_TIMES = ("08-01-2024 05:30", "2024-01-08T00:00:00Z", "soon")




@query(f"""WITH r AS (SELECT event_id, trim({dm._sql_pick(_STATIONS, "event_id")}) AS s, event_id % 3 AS t, value FROM events)
 SELECT event_id % 97 AS slot, CASE WHEN s IN ('', '-') THEN 'station' WHEN event_id % 13 = 0 THEN 'coordinates' WHEN t = 2 THEN 'observed_at' ELSE 'accepted' END AS reason, count(*) AS n,
 max(CASE WHEN s NOT IN ('', '-') AND event_id % 13 <> 0 AND t <> 2 THEN 'CWC-' || CASE WHEN event_id % 4 = 0 THEN 'GEN' ELSE 'KRISHNAR' END || '-' || regexp_replace(upper(s), '[^A-Z0-9]', '', 'g') || '-202401080000' END) AS last_id,
 round(sum(CASE WHEN s NOT IN ('', '-') AND event_id % 13 <> 0 AND t <> 2 AND event_id % 5 <> 0 THEN floor(value) END), 3) AS metres FROM r GROUP BY 1, 2""")
def river_feed(spark, sf_dir):
    """River telemetry: events as its records, accepted and rejected ones by reason, in slots of their ids."""
    k = F.col("event_id")
    raw = table(spark, sf_dir, "events").select(
        k.alias("slot_of"), dm.pick(_STATIONS, k).alias("Station"), F.when(k % 4 == 0, " ").otherwise("Krishna R").alias("Basin"), F.when(k % 13 == 0, "95.0").otherwise("18.5").alias("Latitude"), F.lit("73.8").alias("Longitude"),
        dm.pick(_TIMES, k).alias("Data Acquisition Time"), F.when(k % 5 == 0, "-").otherwise(F.floor("value").cast("string")).alias("River Water Level (meter)"), k.cast("string").alias("State"),
    )
    good = fe.river_levels(raw).select((F.col("raw_metrics.state").cast("long") % 97).alias("slot"), F.lit("accepted").alias("reason"), "external_id", "water_level_m")
    bad = fe.river_levels(raw, rejected=True).select((F.get_json_object("payload", "$.slot_of").cast("long") % 97).alias("slot"), "reason", F.lit(None).cast("string").alias("external_id"), F.lit(None).cast("double").alias("water_level_m"))
    return good.unionByName(bad).groupBy("slot", "reason").agg(F.count("*").alias("n"), F.max("external_id").alias("last_id"), F.round(F.sum("water_level_m"), 3).alias("metres"))


@query(f"""SELECT 'http://news.example.com/a/' || doc_id AS url, sha256('http://news.example.com/a/' || doc_id) AS external_id, 'Doc & ' || doc_id AS title, 'news.example.com' AS publisher_domain, TIMESTAMP '{_AT}' + to_minutes(CAST(doc_id AS INTEGER)) AS published_at,
 CAST(NULL AS VARCHAR) AS reason FROM documents WHERE doc_id % 6 <> 5 UNION ALL SELECT NULL, NULL, 'Doc &amp; <b>' || doc_id || '</b>', NULL, NULL, 'link' FROM documents WHERE doc_id % 6 = 5""")
def news_feed(spark, sf_dir):
    """News records of documents, accepted and rejected."""
    k = F.col("doc_id")
    raw = table(spark, sf_dir, "documents").select(
        F.when(k % 6 == 5, F.lit("  ")).otherwise(_text("HTTP://News.Example.com/a/", k.cast("string"), "/?utm_source=x#top")).alias("url"), _text("Doc &amp; <b>", k.cast("string"), "</b>").alias("title"), F.lit("News.Example.com").alias("domain"),
        F.date_format(dm.minutes_after(_AT, k), "yyyyMMdd'T'HHmmss'Z'").alias("seendate"), F.col("text").alias("excerpt"),
    )
    columns = ("url", "external_id", "title", "publisher_domain", "published_at")
    bad = fe.news_articles(raw, rejected=True).select(*(F.lit(None).cast("string").alias(c) for c in columns[:2]), F.get_json_object("payload", "$.title").alias("title"), F.lit(None).cast("string").alias("publisher_domain"), F.lit(None).cast("timestamp").alias("published_at"), "reason")
    return fe.news_articles(raw).select(*columns, F.lit(None).cast("string").alias("reason")).unionByName(bad)


@query("""SELECT 'https://posts.example.org/@u/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'Short & clear ' || doc_id ELSE repeat('long ', 15) || 'lo...' END AS title, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'English' END AS language,
 CASE WHEN doc_id % 4 = 0 THEN 'flood,ward' || doc_id % 6 ELSE '' END AS tags, CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 0 END AS media FROM documents WHERE doc_id % 7 <> 3""")
def social_feed(spark, sf_dir):
    """Public posts of documents with their tags and media."""
    k = F.col("doc_id")
    named = lambda c: F.struct(c.alias("name"))
    raw = table(spark, sf_dir, "documents").select(
        _text("https://Posts.Example.org/@u/", k.cast("string")).alias("url"), F.when(k % 3 == 0, _text("<p>Short &amp; clear ", k.cast("string"), "</p>")).otherwise(F.lit("<p>" + "long " * 40 + "</p>")).alias("content"),
        F.when(k % 7 == 3, "private").otherwise("public").alias("visibility"), F.lit("2024-01-08T00:00:00Z").alias("created_at"), F.when(k % 2 == 0, F.col("lang")).otherwise(" ").alias("language"),
        F.when(k % 4 == 0, F.array(named(F.lit("flood")), named(F.lit("")), named(_text("ward", (k % 6).cast("string"))))).alias("tags"),
        F.when(k % 5 == 0, F.array(F.struct(F.lit("image").alias("type"), F.lit("p").alias("preview_url"), F.lit("u").alias("url"), F.lit(None).cast("string").alias("description"), F.lit(1).alias("size")))).alias("media_attachments"),
    )
    return fe.social_posts(raw).select("url", "title", "language", F.array_join("tags", ",").alias("tags"), F.size("media").alias("media"))


# --- rules that had no query of their own


@query("""WITH r AS (SELECT n AS cluster_id, id, occurred_at, credibility FROM reports), k AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY occurred_at, credibility DESC, id) AS k, count(*) OVER (PARTITION BY cluster_id) AS members FROM r) SELECT cluster_id, id AS primary_id, members FROM k WHERE k = 1""")
def cluster_primaries(spark, sf_dir):
    reports = dm.reports(spark, sf_dir)
    return du.primary(reports.select("id", F.col("n").alias("cluster_id")), reports)


_KINDS = ("SUPPORTING", "RELATED", "IRRELEVANT")


@query(f"""WITH l AS (SELECT DISTINCT l_orderkey AS id, l_linenumber AS evidence_id FROM lineitem), o AS (SELECT *, {dm._sql_pick(_KINDS, "id")} AS r0, (id % 10) / 10.0::DOUBLE AS s0, id % 7 = 0 AS h0 FROM l WHERE evidence_id <= 3), n AS (SELECT *, {dm._sql_pick(_KINDS, "id + evidence_id")} AS r1, (id % 9) / 9.0::DOUBLE AS s1 FROM l WHERE evidence_id >= 2)
 SELECT id, evidence_id, CASE WHEN r1 IS NULL OR COALESCE(h0, false) THEN r0 ELSE r1 END AS relationship, round(CASE WHEN r1 IS NULL OR COALESCE(h0, false) THEN s0 ELSE s1 END, 4) AS overall, COALESCE(h0, false) AS override FROM o FULL JOIN n USING (id, evidence_id) WHERE r0 IS NOT NULL OR r1 <> 'IRRELEVANT'""")
def link_upserts(spark, sf_dir):
    """New decisions over stored links: a person's override stays, IRRELEVANT updates a link but makes none."""
    k, e = F.col("id"), F.col("evidence_id")
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("evidence_id")).distinct()
    old = links.where(e <= 3).select(k, e, dm.pick(_KINDS, k).alias("relationship"), (k % 10 / F.lit(10.0)).alias("overall"), (k % 7 == 0).alias("override"))
    new = links.where(e >= 2).select(k, e, dm.pick(_KINDS, k + e).alias("relationship"), (k % 9 / F.lit(9.0)).alias("overall"))
    return ev.upsert_links(old, new).withColumn("overall", F.round("overall", 4))


_ERRORS = ("TIMEOUT", "CONNECTION", "RATE_LIMITED", "UNAVAILABLE", "INVALID", "NOT_FOUND")


@query(f"""SELECT {dm._sql_pick(_ERRORS, "l_partkey")} AS error, l_linenumber AS attempt, l_partkey % 6 < 4 AND l_linenumber < 3 AS again, least(2.0::DOUBLE * pow(2, l_linenumber - 1), 60.0::DOUBLE) AS wait_s, count(*) AS n FROM lineitem GROUP BY ALL""")
def retry_schedule(spark, sf_dir):
    from ..streaming.jobs import backoff_seconds, may_retry

    rows = table(spark, sf_dir, "lineitem").select(dm.pick(_ERRORS, F.col("l_partkey")).alias("error"), F.col("l_linenumber").alias("attempt"))
    return rows.groupBy("error", "attempt", may_retry(F.col("error"), F.col("attempt")).alias("again"), backoff_seconds(F.col("attempt")).alias("wait_s")).agg(F.count("*").alias("n"))


@query("""SELECT CAST(id AS VARCHAR) AS id, tracking_id, category_code, severity, status, printf('%.2f', credibility) AS credibility, printf('%.6f', lat) AS lat, printf('%.6f', lon) AS lon, COALESCE(location_name, '') AS location_name, strftime(occurred_at, '%Y-%m-%dT%H:%M:%S') AS occurred_at, CASE WHEN is_demo THEN 'True' ELSE 'False' END AS is_demo
 FROM incidents ORDER BY incidents.occurred_at DESC, incidents.id DESC LIMIT 50000""")
def csv_export(spark, sf_dir):
    """The export has its 50,000 rows at most."""
    return ex.csv_rows(dm.incidents(spark, sf_dir))


_TYPES, _LEVELS = ("FL", "tc", "EQ"), ("Red", "Orange", "Purple")


@query(f"""SELECT 'GDACS-' || upper({dm._sql_pick(_TYPES, "page_id")}) || '-' || page_id AS external_id, 'Event ' || page_id AS title, {dm._sql_pick(("FLOOD_WATERLOGGING", "CYCLONE_STORM", "OTHER"), "page_id")} AS category_code,
 {dm._sql_pick(("SEVERE", "HIGH", "MODERATE"), "page_id // 3")} AS severity, 8 + page_id % 20 / 2.0::DOUBLE AS lat, 70 + page_id % 30 / 2.0::DOUBLE AS lon, TIMESTAMP '{_AT}' + to_minutes(CAST(page_id AS INTEGER)) AS occurred_at FROM pages WHERE page_id % 7 <> 4""")
def global_feed(spark, sf_dir):
    """Global alerts of pages under the five names of lists, as GeoJSON and plain, some of other countries."""
    k = F.col("page_id")
    lat, lon = (8 + k % 20 / F.lit(2.0)), (70 + k % 30 / F.lit(2.0))
    named = [dm.pick(_TYPES, k).alias("eventtype"), _text("Event ", k.cast("string")).alias("name"), dm.pick(_LEVELS, F.floor(k / 3)).alias("alertlevel"), F.when(k % 7 == 4, "Indiana").otherwise("Nepal; India").alias("country"), F.date_format(dm.minutes_after(_AT, k), "yyyy-MM-dd'T'HH:mm:ss").alias("fromdate")]
    feature = F.to_json(F.struct(F.struct(k.cast("string").alias("eventid"), *named).alias("properties"), F.struct(F.array(lon, lat).alias("coordinates")).alias("geometry")))
    plain = F.to_json(F.struct(k.cast("string").alias("id"), *named, lat.alias("latitude"), lon.alias("longitude")))
    doc = _text('{"', dm.pick(("features", "events", "items", "results", "data"), k), '":[', F.when(k % 2 == 0, feature).otherwise(plain), "]}")
    return fe.global_alerts(table(spark, sf_dir, "pages").select(doc.alias("doc"))).select("external_id", "title", "category_code", "severity", "lat", "lon", "occurred_at")


_WARNED = ("Heavy rain", "Hailstorm", "Dense fog")


@query(f"""SELECT 'IMD-PUNE' || page_id || '-' || upper(replace({dm._sql_pick(_WARNED, "page_id")}, ' ', '')) || '-202401080530' AS external_id, {dm._sql_pick(_WARNED, "page_id")} || ' warning for Pune ' || page_id AS title,
 {dm._sql_pick(("HIGH", "SEVERE", "LOW", "MODERATE"), "page_id")} AS severity, {dm._sql_pick(("HEAVY_RAINFALL", "HAILSTORM", "FOG"), "page_id")} AS category_code, TIMESTAMP '2024-01-08 05:30:00' AS occurred_at FROM pages WHERE page_id % 8 <> 5""")
def met_feed(spark, sf_dir):
    """District warnings of pages with colours and phrases, the longest known phrase inside counts; those without a place are left out."""
    k = F.col("page_id")
    raw = table(spark, sf_dir, "pages").select(
        _text("Pune ", k.cast("string")).alias("district"), dm.pick(_WARNED, k).alias("warning_type"), dm.pick(("Amber", "very heavy at places", "Nil", "unheard of"), k).alias("color_code"), F.lit("2024-01-08T05:30:00Z").alias("issue_time"),
        F.when(k % 8 == 5, "n/a").otherwise("18.5").alias("latitude"), F.lit("73.8").alias("longitude"),
    )
    return fe.met_warnings(raw).select("external_id", "title", "severity", "category_code", "occurred_at")


@query("""SELECT 'City ' || c_custkey AS station_code, TIMESTAMP '2024-01-08 12:00:00' AS observed_at, (c_custkey + 12 - c_custkey % 6) % 50 / 10.0::DOUBLE AS precipitation, CAST(12 - c_custkey % 6 AS DOUBLE) AS temperature_2m FROM customer WHERE c_custkey % 8 <> 0""")
def hourly_feed(spark, sf_dir):
    """A day of hours for each customer's city from parallel arrays: the last hour that isn't after half past twelve; some begin later."""
    k = F.col("c_custkey")
    start = F.when(k % 8 == 0, F.lit(13)).otherwise((k % 6).cast("int"))
    hours = F.sequence(F.lit(0), F.lit(23))
    at = F.transform(hours, lambda h: F.date_format(F.timestamp_seconds(F.unix_timestamp(F.lit(_AT).cast("timestamp")) + (start + h) * 3600), "yyyy-MM-dd'T'HH:mm"))
    none = F.transform(hours, lambda h: F.lit(0.0))
    arrays = {c: none for c in fe.HOURLY} | {"precipitation": F.transform(hours, lambda h: (k + h) % 50 / F.lit(10.0)), "temperature_2m": F.transform(hours, lambda h: h.cast("double"))}
    raw = table(spark, sf_dir, "customer").select(_text("City ", k.cast("string")).alias("city"), F.lit(18.5).alias("lat"), F.lit(73.8).alias("lon"), F.struct(at.alias("time"), *(a.alias(c) for c, a in arrays.items())).alias("hourly"))
    return fe.hourly_model(raw, F.lit("2024-01-08 12:30:00").cast("timestamp")).select("station_code", "observed_at", "precipitation", "temperature_2m")
