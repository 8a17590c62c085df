"""The domain's tables as views over the driver's tables, and the same views in SQL.

``incidents`` spreads orders over a subcontinent and years, for the dashboards. ``reports``
puts them into incidents of one week and region, so that they meet in space and time. Observations come
from events, evidence from documents. All of it is integer arithmetic on keys, so any
engine derives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The categories in the order of their codes.
CATEGORIES = (
    "FLOOD_WATERLOGGING", "URBAN_FLOOD", "HEAVY_RAINFALL", "THUNDERSTORM_LIGHTNING", "CYCLONE_STORM", "HAILSTORM", "LANDSLIDE", "HEATWAVE", "DROUGHT",
    "FOG", "DUST_STORM", "STRONG_WIND", "OTHER",
)
#: Places that reports name; an empty one stands for none.
PLACES = ("Andheri East, Mumbai", "Pune", "T. Nagar, Chennai", "Vasai Road", "New Delhi", "Bengaluru", "Kochi", "Guwahati", "Jaipur", "", "Salem", "Kota", "Cuttack", "Noida Sector 5", "Hubli", "Nashik Road", "")
SEVERITY = {"1-URGENT": "SEVERE", "2-HIGH": "HIGH", "3-MEDIUM": "MODERATE", "4-NOT SPECIFIED": "MODERATE", "5-LOW": "LOW"}
SOURCE_TYPES = ("CITIZEN_WEB", "OFFICIAL_AGENCY", "NEWS_MEDIA", "SOCIAL_FEED", "SENSOR_NETWORK")
#: The moments that relative time ranges count from.
NOW, NOW_EVENTS = "2001-08-02 00:00:00", "2024-01-31 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values)).cast("int") + 1)


def utc(c: str | Column) -> Column:
    """A time without a zone, taken as UTC (the session's zone)."""
    return (F.col(c) if isinstance(c, str) else c).cast("timestamp")


def minutes_after(start: str, minutes: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(start).cast("timestamp")) + minutes * 60)


def incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    status = F.when(k % 17 == 0, "REJECTED").when(k % 19 == 0, "DUPLICATE").when(F.col("o_orderstatus") == "P", "PENDING").when(F.col("o_orderstatus") == "O", "UNDER_REVIEW").otherwise("VERIFIED")
    severity = F.coalesce(*(F.when(F.col("o_orderpriority") == p, F.lit(s)) for p, s in SEVERITY.items()), F.lit("MODERATE"))
    return o.select(
        k.alias("id"),
        F.concat(F.lit("TRK-"), k.cast("string")).alias("tracking_id"),
        F.col("o_custkey").alias("user_id"),
        pick(SOURCE_TYPES, k).alias("source_type"),
        pick(CATEGORIES, k).alias("category_code"),
        severity.alias("severity"),
        status.alias("status"),
        F.nullif(pick(PLACES, k), F.lit("")).alias("location_name"),
        (8 + ((k * 7919) % 27000) / F.lit(1000.0)).alias("lat"),
        (69 + ((k * 104729) % 26000) / F.lit(1000.0)).alias("lon"),
        F.timestamp_seconds(F.unix_timestamp(utc("o_orderdate")) + (k % 1440) * 60).alias("occurred_at"),
        ((300 + (k * 37) % 651) / F.lit(1000.0)).alias("credibility"),
        (k % 23 == 0).alias("is_demo"),
    )


# What reports say about their place, by incident; an empty text stands for none.
LOCATIONS = ("Mula River bank, Pune", "Krishna basin, Satara", "Pune district", "Krishna Nagar, Nashik", "Nashik, Maharashtra", "Godavari nadi ghat, Nashik", "Satara market street", "Maharashtra coast", "", "Adyar river road, Chennai")
CITIES = ("Pune", "Satara", "Pune", "Nashik", "Nashik", "Nashik", "Satara", "", "", "Chennai")
DETAILS = ("water enters houses along the Mula river bank", "street drain blocked at the underpass", "river overflowing, danger level breached at Pavana bridge", "trees down and traffic stopped", "")
RIVERS, BASINS, DISTRICTS = ("Mula", "Krishna", "Godavari", "Pavana"), ("Krishna", "Godavari", "Bhima"), ("Pune", "Satara", "Nashik")
# What articles say about the place; an empty text stands for none.
WHERE = ("in Pune", "at Kurla, Mumbai", "in Nashik, Maharashtra", "near Andheri station, Mumbai", "across Maharashtra", "in Rajpur, Chhattisgarh", "in Bilaspur", "in Dhaka", "near Pune district", "in Delhi", "", "around Poona")
TOLD = (" after heavy rain", " as flood and rain go on", ", rumour debunked by police", " while government reviews monsoon preparedness", "", " before a cricket match")


def _headline(n: Column) -> Column:
    return F.concat(F.lower(F.translate(pick(CATEGORIES, (n * 31) % 4), "_", " ")), F.lit(" near block "), ((n * 13) % 20).cast("string"), F.lit(" ward "), ((n * 7) % 6).cast("string"))


def _spot(n: Column, dense: Column, factor: int, near: float, wide: float) -> Column:
    """A degree of latitude or longitude: some lie in one metropolis, the others over a region of five degrees."""
    return F.when(dense, near + (n * factor % 300) / F.lit(1000.0)).otherwise(wide + (n * factor % 5000) / F.lit(1000.0))


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of one week: up to eight of an incident, a kilometre and some hours apart, in one region."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    g, j = F.floor(k / 8), k % 8
    n = g * 2 + F.when((g % 3 == 0) & (j >= 4), 1).otherwise(0)
    rows = o.select(k.alias("id"), n.alias("n"), j.alias("j"))
    k, n, j = F.col("id"), F.col("n"), F.col("j")
    return rows.select(
        "id",
        "n",
        pick(CATEGORIES, F.when(k % 11 == 0, (k * 31) % 13).otherwise((n * 31) % 4)).alias("category_code"),
        F.concat(_headline(n), F.when(j % 2 == 1, F.lit(" roads submerged")).otherwise(F.lit(""))).alias("title"),
        F.nullif(pick(DETAILS, n), F.lit("")).alias("description"),
        F.nullif(pick(LOCATIONS, n), F.lit("")).alias("location_name"),
        F.nullif(pick(CITIES, n), F.lit("")).alias("city"),
        F.when(n % 7 != 0, "Maharashtra").alias("state"),
        (_spot(n, n % 16 == 0, 7919, 18.5, 16.0) + (k * 13 % 9) / F.lit(1000.0)).alias("lat"),
        (_spot(n, n % 16 == 0, 104729, 73.8, 73.0) + (k * 7 % 9) / F.lit(1000.0)).alias("lon"),
        minutes_after("2024-01-08 00:00:00", (n * 7907) % 10080 + (j * 17) % 150).alias("occurred_at"),
        ((40 + (k * 11) % 56) / F.lit(100.0)).alias("trust"),
        pick(SOURCE_TYPES, k).alias("source_type"),
        ((300 + (k * 37) % 651) / F.lit(1000.0)).alias("credibility"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """River levels; each station stands in one place, at a river, and has two sources."""
    e, k, u = table(spark, sf_dir, "events"), F.col("event_id"), F.floor(F.col("user_id") / 4)
    return e.select(
        k.alias("obs_id"),
        pick(("CWC", "STATE"), k).alias("source_id"),
        u.alias("station"),
        utc("ts").alias("observed_at"),
        F.when(k % 29 != 0, F.col("value") / 10).alias("level_m"),
        _spot(u, u % 4 != 0, 379, 18.5, 16.0).alias("lat"),
        _spot(u, u % 4 != 0, 743, 73.8, 73.0).alias("lon"),
        pick(RIVERS, u).alias("river"),
        pick(BASINS, u).alias("basin"),
        pick(DISTRICTS, u).alias("district"),
        F.lit("Maharashtra").alias("state"),
        (8 + u % 7).cast("double").alias("warning_level_m"),
    )


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles about the week's incidents: a headline of their own, and the whole text of a document. Some feeds bring no hash, some no publisher."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    n = k * 3
    dense = k % 8 == 0
    return d.select(
        k.alias("evidence_id"),
        F.when(k % 2 == 0, F.col("source")).alias("publisher"),
        F.col("lang").alias("language"),
        minutes_after("2024-01-08 00:00:00", (k * 613) % 10080).alias("published_at"),
        F.nullif(pick(("Pune", "Nashik", "Satara", "Mumbai", ""), k), F.lit("")).alias("city"),
        F.when(k % 4 != 0, "Maharashtra").alias("state"),
        F.when(k % 5 < 2, F.concat(F.lit("ward "), ((n * 7) % 6).cast("string"))).alias("locality"),
        F.when(k % 3 != 0, _spot(k, dense, 271, 18.5, 16.0)).alias("lat"),
        F.when(k % 3 != 0, _spot(k, dense, 577, 73.8, 73.0)).alias("lon"),
        F.when(k % 3 == 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha256"),
        F.when(k % 5 == 0, F.concat(F.lit("https://news.example/"), (k % 50).cast("string"))).alias("url"),
        F.when(k % 7 == 0, "PTI").alias("wire"),
        (k % 11 == 0).alias("derived"),
        F.concat(_headline(n), pick(TOLD, k)).alias("headline"),
        F.concat(_headline(n), pick(TOLD, k), F.lit(". "), pick(WHERE, k), F.lit(". "), F.coalesce("text", F.lit(""))).alias("text"),
    )


STATES = ("INTELLIGENCE_READY", "INTELLIGENCE_PARTIAL", "INTELLIGENCE_FAILED", "INTELLIGENCE_PENDING")
PROCESSED = ("COMPLETED", "PARTIAL_INTELLIGENCE", "FAILED", "QUEUED")
REPORTED = ("flooding in street", "Heavy_Rainfall", "FOG", "DUST_STORM", "landslide risk", "")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``incidents`` with what the stages wrote: (reported_category, processing_status, payload, explanation, updated_at, created_at)."""
    k = F.col("id")
    stages = F.concat(F.lit('{"orchestration":{"overall_readiness":"'), pick(STATES, k), F.lit('","stages":{"LOCATION":{"status":"SUCCESS","attempt":1},"EVIDENCE":{"status":"'), F.when(k % 3 == 0, "FAILED").otherwise("SUCCESS"), F.lit('","attempt":'), (1 + k % 3).cast("string"), F.lit("}}}}"))
    told = F.concat(
        F.lit('{"positive_drivers":['), F.when(k % 2 == 0, F.lit('"High trust."')).otherwise(F.lit("")), F.lit('],"negative_drivers":['), F.when(k % 3 == 0, F.lit('"Sensor denies."')).otherwise(F.lit("")),
        F.lit('],"uncertainty_flags":['), F.when(k % 5 == 0, F.lit('"No coordinates."')).otherwise(F.lit("")), F.lit('],"explanation":"Assessment\\n line '), (k % 9).cast("string"), F.lit('","source_prior":0.'), (40 + k % 50).cast("string"),
        F.when(k % 7 == 0, F.lit(',"assessed_at":"2001-09-01 00:00:00"')).otherwise(F.lit("")), F.lit("}"),
    )
    return incidents(spark, sf_dir).withColumns(
        {"reported_category": F.nullif(pick(REPORTED, k), F.lit("")), "processing_status": pick(PROCESSED, F.floor(k / 4)), "payload": F.when(k % 5 != 0, stages), "explanation": F.when(k % 4 != 0, told),
         "created_at": F.col("occurred_at"), "updated_at": F.when(k % 2 == 0, F.timestamp_seconds(F.unix_timestamp("occurred_at") + 3600))}
    )


def evidence_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, evidence_id, confidence, relationship): line items as stored links of incidents to articles."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), ((F.col("l_partkey") * 7 + F.col("l_linenumber")) % 200).alias("evidence_id"), (F.floor(F.col("l_quantity")) * 19 % 101 / F.lit(100.0)).alias("confidence"), pick(("SUPPORTING", "RELATED", "CONTEXTUAL"), F.col("l_linenumber")).alias("relationship"))


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return f"([{', '.join(repr(v) for v in values)}])[CAST(({index}) % {len(values)} AS INTEGER) + 1]"


_SEVERITY_SQL = "CASE o_orderpriority " + " ".join(f"WHEN '{p}' THEN '{s}'" for p, s in SEVERITY.items()) + " ELSE 'MODERATE' END"


def _sql_headline(n: str) -> str:
    return f"lower(replace({_sql_pick(CATEGORIES, f'({n} * 31) % 4')}, '_', ' ')) || ' near block ' || (({n} * 13) % 20) || ' ward ' || (({n} * 7) % 6)"


def _sql_spot(n: str, dense: str, factor: int, near: float, wide: float) -> str:
    return f"CASE WHEN {dense} THEN {near}::DOUBLE + ({n} * {factor} % 300) / 1000.0::DOUBLE ELSE {wide}::DOUBLE + ({n} * {factor} % 5000) / 1000.0::DOUBLE END"


VIEWS = {
    "incidents": f"""SELECT o_orderkey AS id, 'TRK-' || o_orderkey AS tracking_id, o_custkey AS user_id, {_sql_pick(SOURCE_TYPES, "o_orderkey")} AS source_type,
 {_sql_pick(CATEGORIES, "o_orderkey")} AS category_code, {_SEVERITY_SQL} AS severity,
 CASE WHEN o_orderkey % 17 = 0 THEN 'REJECTED' WHEN o_orderkey % 19 = 0 THEN 'DUPLICATE' WHEN o_orderstatus = 'P' THEN 'PENDING' WHEN o_orderstatus = 'O' THEN 'UNDER_REVIEW' ELSE 'VERIFIED' END AS status,
 NULLIF({_sql_pick(PLACES, "o_orderkey")}, '') AS location_name, 8 + ((o_orderkey * 7919) % 27000) / 1000.0::DOUBLE AS lat, 69 + ((o_orderkey * 104729) % 26000) / 1000.0::DOUBLE AS lon,
 CAST(o_orderdate AS TIMESTAMP) + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS occurred_at, (300 + (o_orderkey * 37) % 651) / 1000.0::DOUBLE AS credibility, o_orderkey % 23 = 0 AS is_demo FROM orders""",
    "files": f"""SELECT i.*, NULLIF({_sql_pick(REPORTED, "id")}, '') AS reported_category, {_sql_pick(PROCESSED, "id // 4")} AS processing_status,
 CASE WHEN id % 5 <> 0 THEN '{{"orchestration":{{"overall_readiness":"' || {_sql_pick(STATES, "id")} || '","stages":{{"LOCATION":{{"status":"SUCCESS","attempt":1}},"EVIDENCE":{{"status":"' || CASE WHEN id % 3 = 0 THEN 'FAILED' ELSE 'SUCCESS' END || '","attempt":' || (1 + id % 3) || '}}}}}}}}' END AS payload,
 CASE WHEN id % 4 <> 0 THEN '{{"positive_drivers":[' || CASE WHEN id % 2 = 0 THEN '"High trust."' ELSE '' END || '],"negative_drivers":[' || CASE WHEN id % 3 = 0 THEN '"Sensor denies."' ELSE '' END || '],"uncertainty_flags":[' || CASE WHEN id % 5 = 0 THEN '"No coordinates."' ELSE '' END
  || '],"explanation":"Assessment\\n line ' || (id % 9) || '","source_prior":0.' || (40 + id % 50) || CASE WHEN id % 7 = 0 THEN ',"assessed_at":"2001-09-01 00:00:00"' ELSE '' END || '}}' END AS explanation,
 occurred_at AS created_at, CASE WHEN id % 2 = 0 THEN occurred_at + INTERVAL 1 HOUR END AS updated_at FROM incidents i""",
    "evidence_links": f"""SELECT l_orderkey AS id, (l_partkey * 7 + l_linenumber) % 200 AS evidence_id, CAST(floor(l_quantity) AS BIGINT) * 19 % 101 / 100.0::DOUBLE AS confidence, {_sql_pick(("SUPPORTING", "RELATED", "CONTEXTUAL"), "l_linenumber")} AS relationship FROM lineitem""",
    "reports": f"""SELECT id, n, CASE WHEN id % 11 = 0 THEN {_sql_pick(CATEGORIES, "(id * 31) % 13")} ELSE {_sql_pick(CATEGORIES, "(n * 31) % 4")} END AS category_code,
 {_sql_headline("n")} || CASE WHEN j % 2 = 1 THEN ' roads submerged' ELSE '' END AS title, NULLIF({_sql_pick(DETAILS, "n")}, '') AS description, NULLIF({_sql_pick(LOCATIONS, "n")}, '') AS location_name,
 NULLIF({_sql_pick(CITIES, "n")}, '') AS city, CASE WHEN n % 7 <> 0 THEN 'Maharashtra' END AS state,
 {_sql_spot("n", "n % 16 = 0", 7919, 18.5, 16.0)} + (id * 13 % 9) / 1000.0::DOUBLE AS lat, {_sql_spot("n", "n % 16 = 0", 104729, 73.8, 73.0)} + (id * 7 % 9) / 1000.0::DOUBLE AS lon,
 TIMESTAMP '2024-01-08 00:00:00' + to_minutes(CAST((n * 7907) % 10080 + (j * 17) % 150 AS INTEGER)) AS occurred_at, (40 + (id * 11) % 56) / 100.0::DOUBLE AS trust,
 {_sql_pick(SOURCE_TYPES, "id")} AS source_type, (300 + (id * 37) % 651) / 1000.0::DOUBLE AS credibility
 FROM (SELECT o_orderkey AS id, o_orderkey % 8 AS j, (o_orderkey // 8) * 2 + CASE WHEN (o_orderkey // 8) % 3 = 0 AND o_orderkey % 8 >= 4 THEN 1 ELSE 0 END AS n FROM orders)""",
    "observations": f"""SELECT event_id AS obs_id, {_sql_pick(("CWC", "STATE"), "event_id")} AS source_id, u AS station, CAST(ts AS TIMESTAMP) AS observed_at, CASE WHEN event_id % 29 <> 0 THEN value / 10 END AS level_m,
 {_sql_spot("u", "u % 4 <> 0", 379, 18.5, 16.0)} AS lat, {_sql_spot("u", "u % 4 <> 0", 743, 73.8, 73.0)} AS lon, {_sql_pick(RIVERS, "u")} AS river, {_sql_pick(BASINS, "u")} AS basin, {_sql_pick(DISTRICTS, "u")} AS district,
 'Maharashtra' AS state, CAST(8 + u % 7 AS DOUBLE) AS warning_level_m FROM (SELECT *, user_id // 4 AS u FROM events)""",
    "evidence": f"""SELECT doc_id AS evidence_id, CASE WHEN doc_id % 2 = 0 THEN source END AS publisher, lang AS language, TIMESTAMP '2024-01-08 00:00:00' + to_minutes(CAST((doc_id * 613) % 10080 AS INTEGER)) AS published_at,
 NULLIF({_sql_pick(("Pune", "Nashik", "Satara", "Mumbai", ""), "doc_id")}, '') AS city, CASE WHEN doc_id % 4 <> 0 THEN 'Maharashtra' END AS state, CASE WHEN doc_id % 5 < 2 THEN 'ward ' || ((doc_id * 21) % 6) END AS locality,
 CASE WHEN doc_id % 3 <> 0 THEN {_sql_spot("doc_id", "doc_id % 8 = 0", 271, 18.5, 16.0)} END AS lat, CASE WHEN doc_id % 3 <> 0 THEN {_sql_spot("doc_id", "doc_id % 8 = 0", 577, 73.8, 73.0)} END AS lon,
 CASE WHEN doc_id % 3 = 0 THEN sha256(COALESCE(text, '')) END AS sha256, CASE WHEN doc_id % 5 = 0 THEN 'https://news.example/' || (doc_id % 50) END AS url, CASE WHEN doc_id % 7 = 0 THEN 'PTI' END AS wire, doc_id % 11 = 0 AS derived,
 {_sql_headline("(doc_id * 3)")} || {_sql_pick(TOLD, "doc_id")} AS headline, {_sql_headline("(doc_id * 3)")} || {_sql_pick(TOLD, "doc_id")} || '. ' || {_sql_pick(WHERE, "doc_id")} || '. ' || COALESCE(text, '') AS text FROM documents""",
}


def sql(body: str) -> str:
    """A query over the views it names."""
    import re

    used = [v for v in VIEWS if re.search(rf"\b{v}\b", body) or (v == "incidents" and re.search(r"\bfiles\b", body))]
    head = ",\n".join(f"{v} AS ({VIEWS[v]})" for v in used)
    if not head:
        return body
    found = re.match(r"\s*WITH\s+(RECURSIVE\s+)?", body, re.I)
    return f"WITH {found[1] or ''}{head}, {body[found.end() :]}" if found else f"WITH {head}\n{body}"
