"""One incident at length: its display, readiness, explanation, evidence, observations and cluster; advisories, sources, relief centres."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .lifecycle import latest

# The readiness that a processing status stands for where no stage has reported.
READINESS = {"COMPLETED": "INTELLIGENCE_READY", "PARTIAL_INTELLIGENCE": "INTELLIGENCE_PARTIAL", "FAILED": "INTELLIGENCE_FAILED"}
# Labels of a credibility, from the highest.
LABELS = ((0.85, "VERY_HIGH_CREDIBILITY"), (0.70, "HIGH_CREDIBILITY"), (0.45, "MODERATE_CREDIBILITY"))


def search(df: DataFrame, category: str | None = None, box: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Reports whose category is the given one or whose reported category holds it, in any case, strictly inside (west, south, east, north)."""
    if category:
        df = df.where((F.upper("category_code") == category.upper()) | F.ilike("reported_category", F.lit(f"%{category}%")))
    if box:
        w, s, e, n = box
        df = df.where((F.col("lon") > w) & (F.col("lon") < e) & (F.col("lat") > s) & (F.col("lat") < n))
    return df


def readiness(payload: Column, processing_status: Column) -> Column:
    """What the stages say in the payload, else what the processing status stands for."""
    said = F.get_json_object(payload, "$.orchestration.overall_readiness")
    out = F.when(said.isin("INTELLIGENCE_PENDING", *READINESS.values()), said)
    for status, value in READINESS.items():
        out = out.when(processing_status == status, value)
    return out.otherwise("INTELLIGENCE_PENDING")


def category_title(joined: Column, code: Column) -> Column:
    """The joined category's title, else the reported code in title case."""
    return F.coalesce(joined, F.initcap(F.lower(F.translate(F.coalesce(code, F.lit("OTHER")), "_", " "))))


def percent_text(score: Column) -> Column:
    return F.concat(F.bround(score * 100, 0).cast("int").cast("string"), F.lit("%"))


def reason(explanation: Column, score: Column) -> Column:
    """One sentence on a credibility: the first driver for and the first against, else the first doubt, else the text's second
    line, else the score; without an explanation what the score's band says."""
    of = lambda name: F.get_json_object(explanation, f"$.{name}[0]")
    drivers = F.nullif(F.concat_ws(" ", of("positive_drivers"), of("negative_drivers")), F.lit(""))
    lines = F.filter(F.transform(F.split(F.get_json_object(explanation, "$.explanation"), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    line = F.coalesce(F.get(lines, F.lit(1)), F.get(lines, F.lit(0)))
    assigned = F.concat(F.lit("Machine credibility score of "), F.coalesce(percent_text(score), F.lit("0%")), F.lit(" assigned."))
    banded = (
        F.when(score >= 0.80, F.concat(F.lit("High machine credibility ("), percent_text(score), F.lit(") based on authoritative source.")))
        .when(score >= 0.50, F.concat(F.lit("Moderate machine credibility ("), percent_text(score), F.lit(") based on baseline intake.")))
        .when(score > 0, F.concat(F.lit("Low machine credibility ("), percent_text(score), F.lit("); uncorroborated intake report.")))
        .otherwise("Pending machine credibility evaluation.")
    )
    return F.when(explanation.isNull(), banded).otherwise(F.coalesce(drivers, of("uncertainty_flags"), line, assigned))


def credibility_detail(df: DataFrame) -> DataFrame:
    """(id, score, label, base_trust_prior, explanation_text, calculated_at) of rows (id, credibility, explanation, updated_at, created_at)."""
    c = F.col("credibility")
    label = F.lit("LOW_CREDIBILITY")
    for least, name in reversed(LABELS):
        label = F.when(c >= least, name).otherwise(label)
    of = lambda name: F.get_json_object("explanation", f"$.{name}")
    text = F.coalesce(of("explanation_text"), F.concat(F.lit("Machine-assessed credibility score of "), F.format_string("%.4f", c), F.lit(".")))
    when = F.coalesce(F.try_to_timestamp(of("assessed_at")), "updated_at", "created_at")
    return df.select("id", c.alias("score"), label.alias("label"), F.coalesce(of("source_prior").cast("double"), F.lit(0.50)).alias("base_trust_prior"), text.alias("explanation_text"), when.alias("calculated_at"))


def stage_status(df: DataFrame) -> DataFrame:
    """(id, stage, status, attempt): a row for each stage that the payload tells of."""
    stages = F.from_json(F.get_json_object("payload", "$.orchestration.stages"), "map<string,struct<status:string,attempt:int>>")
    return df.select("id", F.explode(stages).alias("stage", "x")).select("id", "stage", "x.status", "x.attempt")


def page_of(rows: DataFrame, key: str, order: list[Column], size: int, page: int = 1) -> DataFrame:
    """The page of each key's rows in an order, for all keys at once."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    return ranked.where(F.col("rank").between((page - 1) * size + 1, page * size))


def paging(n: Column, size: int, page: int) -> list[Column]:
    pages = F.greatest(F.ceil(n / size).cast("long"), F.lit(1))
    return [n.alias("total"), pages.alias("pages"), (F.lit(page) < pages).alias("has_next"), F.lit(page > 1).alias("has_previous")]


def counted(incidents: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Incidents with a count of each child table (frames with an ``id``), counted before the join."""
    for name, rows in children.items():
        incidents = incidents.join(rows.groupBy("id").agg(F.count("*").alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return incidents


def cluster_detail(reports: DataFrame, members: DataFrame) -> DataFrame:
    """(id, cluster_id, total, span_hours, is_representative): each report in its cluster, or in one of its own.

    ``members`` has (id, cluster_id); the representative is the earliest member, then the smallest id.
    """
    rows = members.join(reports.select("id", "occurred_at"), "id")
    seconds = F.unix_micros("occurred_at") / F.lit(1e6)
    span = F.floor((F.max(seconds) - F.min(seconds)) / 3600 * 100 + 0.5) / F.lit(100.0)
    whole = rows.groupBy("cluster_id").agg(F.count("*").alias("total"), span.alias("span_hours"), F.min(F.struct("occurred_at", "id"))["id"].alias("lead"))
    known = members.join(whole, "cluster_id")
    out = reports.select("id").join(known, "id", "left")
    return out.select("id", "cluster_id", F.coalesce("total", F.lit(1)).alias("total"), F.coalesce("span_hours", F.lit(0.0)).alias("span_hours"), F.coalesce(F.col("id") == F.col("lead"), F.lit(True)).alias("is_representative"))


def to_recompute(touched: DataFrame, members: DataFrame) -> DataFrame:
    """(id): the touched reports and all members of their clusters."""
    clusters = touched.join(members, "id").select("cluster_id").distinct()
    return touched.select("id").unionByName(members.join(clusters, "cluster_id", "left_semi").select("id")).distinct()


def advisories(alerts: DataFrame) -> DataFrame:
    """Advisories from alerts (id, source_code, title, hazard, end_text): those with an end in one of the feeds' three formats (Indian time
    with the day's name, or a time with Z or an offset); of alerts of one source, title and end the first id. Without a hazard it is OTHER."""
    text = F.trim("end_text")
    ist = F.to_utc_timestamp(F.try_to_timestamp(F.regexp_extract(text, r"^(?:Mon|Tue|Wed|Thu|Fri|Sat|Sun) (\w{3} \d{1,2} \d{1,2}:\d{1,2}:\d{1,2} IST \d{4})$", 1), F.lit("MMM d H:m:s 'IST' yyyy")), "Asia/Kolkata")
    zoned = F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(F.regexp_replace(text, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    end = F.coalesce(ist, zoned)
    alerts = alerts.withColumn("hazard", F.coalesce("hazard", F.lit("OTHER")))
    rows = alerts.withColumn("valid_until", end).where("valid_until is not null")
    return rows.groupBy("source_code", "title", "valid_until").agg(F.min_by(F.struct("id", "hazard"), "id").alias("x")).select("x.*", "source_code", "title", "valid_until")


def active_advisories(rows: DataFrame, now: str, hazard: str | None = None, most: int = 100) -> DataFrame:
    rows = rows.where(F.col("valid_until") >= F.lit(now).cast("timestamp"))
    if hazard:
        rows = rows.where(F.upper("hazard") == hazard.strip().upper())
    return rows.orderBy(F.col("valid_until").desc(), F.col("id").desc()).limit(most).select(F.concat(F.lit("ADV-"), "source_code", F.lit("-"), F.col("id").cast("string")).alias("tracking_id"), "title", "valid_until")


def with_trust(rows: DataFrame, sources: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows (source_code) with their source's name and trust; the registry's trust wins, a source that is unknown has 0.5."""
    own = sources.select("source_code", "name", F.col("trust").alias("__own"))
    set_ = registry.select("source_code", F.col("trust").alias("__set"))
    met = rows.join(own, "source_code", "left").join(set_, "source_code", "left")
    return met.withColumn("trust", F.coalesce("__set", "__own", F.lit(0.5))).drop("__own", "__set")


def partial_updates(versions: DataFrame, key: str, order: list[str], fields: list[str]) -> DataFrame:
    """The current row of each key from its versions: each field's last value that isn't null."""
    place = F.struct(*order)
    return versions.groupBy(key).agg(*(F.max_by(f, F.when(F.col(f).isNotNull(), place)).alias(f) for f in fields))


def latest_vote(votes: DataFrame, user_id: int | None, client_ip: str | None) -> DataFrame:
    """The latest vote of a user, or of an address, on each report."""
    mine = F.coalesce(F.col("user_id") == F.lit(user_id), F.lit(False)) | F.coalesce(F.col("client_ip") == F.lit(client_ip), F.lit(False))
    return latest(votes.where(mine), ["report_id"], [F.col("created_at").desc(), F.col("vote_id").desc()])


def backfill(reports: DataFrame, categories: DataFrame) -> DataFrame:
    """Reports with the category_id of their reported category where they have none; unknown names get OTHER's."""
    names = categories.select(F.col("id").alias("__id"), F.upper("code").alias("__code"))
    other = names.where("__code = 'OTHER'").select(F.col("__id").alias("__other"))
    met = reports.join(names, F.upper(F.trim("reported_category")) == F.col("__code"), "left").join(F.broadcast(other))  # one row
    return met.withColumn("category_id", F.coalesce("category_id", "__id", "__other")).drop("__id", "__code", "__other")


def fingerprint(rows: DataFrame, names: list[str]) -> Column:
    """SHA-256 of some inputs of a row as JSON, in the order of their names, fractions rounded to four decimals; nulls are kept as such."""
    kinds = dict(rows.dtypes)
    rounded = lambda c: F.round(F.col(c), 4) + F.lit(0.0) if kinds[c] in ("double", "float") or kinds[c].startswith("decimal") else F.col(c)
    return F.sha2(F.to_json(F.struct(*(rounded(c).alias(c) for c in sorted(names))), {"ignoreNullFields": "false"}), 256)


def guarded(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """(id, score, written): scores computed from inputs that haven't changed since are written, stale ones are dropped.

    ``stored`` has (id, score, now) with the fingerprint of the inputs as they are, ``computed`` (id, score, seen).
    """
    met = stored.join(computed.select("id", F.col("score").alias("__new"), "seen"), "id", "left")
    fresh = F.coalesce(F.col("now") == F.col("seen"), F.lit(False))
    return met.select("id", F.when(fresh, F.col("__new")).otherwise(F.col("score")).alias("score"), fresh.alias("written"))
