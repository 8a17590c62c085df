"""Dashboard analytics: filters, counts, distributions and trends of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import inside

# Hours of the relative time ranges; any other range has no lower bound.
RANGE_HOURS = {"24h": 24, "48h": 48, "7d": 168, "30d": 720}
# The regions, tested in this order, first by the words of the place, then by box.
REGION_WORDS = (
    ("MH", "mumbai|pune|nagpur|thane|nashik|maharashtra|kurla|andheri|navi mumbai"),
    ("TN", "chennai|coimbatore|madurai|tamil nadu|trichy|salem"),
    ("DL", "delhi|new delhi|noida|gurgaon|gurugram|faridabad|ghaziabad|ncr"),
    ("KA", "bengaluru|bangalore|mysore|karnataka|hubli|mangalore"),
    ("KL", "kochi|thiruvananthapuram|calicut|kerala|trivandrum|thrissur"),
    ("AS", "guwahati|assam|dibrugarh|silchar|jorhat|dispur"),
    ("RJ", "jaipur|jodhpur|rajasthan|udaipur|kota|bikaner"),
)
REGION_BOXES = (
    ("DL", (76.8, 28.4, 77.4, 28.9)),
    ("MH", (72.6, 15.6, 80.9, 22.0)),
    ("KA", (74.0, 11.5, 78.6, 18.5)),
    ("TN", (76.2, 8.0, 80.3, 13.5)),
    ("KL", (74.8, 8.3, 77.4, 12.8)),
    ("AS", (89.7, 24.1, 96.0, 28.2)),
    ("RJ", (69.5, 23.0, 78.3, 30.2)),
)
SEVERITY_RANK = ("LOW", "MODERATE", "HIGH", "SEVERE")


def matching(
    df: DataFrame, *, category: str | None = None, severity: str | None = None, statuses: list[str] | None = None, least: float | None = None, most: float | None = None, start=None, end=None, box=None, demo: bool | None = None
) -> DataFrame:
    """Incidents that meet all given conditions; "ALL" and None are no condition."""
    checks: list[Column] = []
    for name, value in (("category_code", category), ("severity", severity)):
        if value and value.upper() != "ALL":
            checks.append(F.col(name) == value.upper())
    if statuses and "ALL" not in statuses:
        checks.append(F.col("status").isin([s.strip().upper() for s in statuses]))
    if least is not None:
        checks.append(F.col("credibility") >= least)
    if most is not None:
        checks.append(F.col("credibility") <= most)
    if start is not None:
        checks.append(F.col("occurred_at") >= F.lit(start).cast("timestamp"))
    if end is not None:
        checks.append(F.col("occurred_at") <= F.lit(end).cast("timestamp"))
    if box is not None:
        checks.append(inside("lat", "lon", *box))
    if demo is not None:
        checks.append(F.col("is_demo") == demo)
    for c in checks:
        df = df.where(c)
    return df


def range_start(time_range: str | None, now: str, start: str | None = None) -> Column | None:
    """The lower bound of a relative range; an explicit start wins."""
    if start is not None:
        return F.lit(start).cast("timestamp")
    hours = RANGE_HOURS.get((time_range or "").strip().lower())
    return F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {hours} HOURS") if hours else None


def percent(part: Column, total: Column) -> Column:
    """Whole percent, halves to even; 0 of nothing."""
    return F.when(total > 0, F.bround(part / total * 100, 0).cast("long")).otherwise(F.lit(0).cast("long"))


def summary(df: DataFrame) -> DataFrame:
    """All counters of the dashboard in one pass."""
    n = lambda c: F.count(F.when(c, 1))
    status, severity = F.col("status"), F.col("severity")
    counts = df.agg(
        F.count("*").alias("total"), n(status == "VERIFIED").alias("verified"), n(status == "PENDING").alias("pending"), n(status == "UNDER_REVIEW").alias("under_review"),
        n(status == "REJECTED").alias("rejected"), n(status == "DUPLICATE").alias("duplicates"), n(severity == "SEVERE").alias("severe"), n(severity == "HIGH").alias("high"),
        n(severity == "MODERATE").alias("moderate"), n(severity == "LOW").alias("low"), n(F.col("credibility") >= 0.7).alias("credible"), n(severity.isin("HIGH", "SEVERE") & status.isin("PENDING", "UNDER_REVIEW")).alias("urgent_open"),
    )
    return counts.select("*", percent(F.col("verified"), F.col("total")).alias("verified_pct"), percent(F.col("severe"), F.col("total")).alias("severe_pct"))


def share_by(df: DataFrame, keys: list[Column], names: list[str]) -> DataFrame:
    """Rows per group with their percentage of all."""
    groups = df.groupBy(*(k.alias(n) for k, n in zip(keys, names, strict=True))).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))  # a row for each group
    return groups.select(*names, "n", percent(F.col("n"), total).alias("pct"))


def diurnal(df: DataFrame, hours: int, zone: str = "Asia/Kolkata") -> DataFrame:
    """(bucket, total, verified) for every slice of the local day, empty ones too."""
    spark = df.sparkSession
    slot = F.floor(F.hour(F.from_utc_timestamp("occurred_at", zone)) / hours).cast("int")
    counts = df.groupBy(slot.alias("bucket")).agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "VERIFIED", 1)).alias("verified"))
    every = spark.range(24 // hours).select(F.col("id").cast("int").alias("bucket"))
    return every.join(counts, "bucket", "left").select("bucket", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("verified", F.lit(0)).alias("verified"))


def daily(df: DataFrame, now: str, days: int) -> DataFrame:
    """(day, total, verified) for the last days, empty ones too."""
    spark = df.sparkSession
    counts = df.groupBy(F.to_date("occurred_at").alias("day")).agg(F.count("*").alias("total"), F.count(F.when(F.col("status") == "VERIFIED", 1)).alias("verified"))
    every = spark.range(1).select(F.explode(F.sequence(F.date_sub(F.lit(now).cast("date"), days - 1), F.lit(now).cast("date"))).alias("day"))
    return every.join(counts, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("verified", F.lit(0)).alias("verified"))


def region() -> Column:
    """Region code of an incident: by the words of its place, then by box without edges, else OTHER."""
    place = F.lower("location_name")
    out = F.when(place.rlike(rf"\b({REGION_WORDS[0][1]})\b"), REGION_WORDS[0][0])
    for code, words in REGION_WORDS[1:]:
        out = out.when(place.rlike(rf"\b({words})\b"), code)
    for code, box in REGION_BOXES:
        out = out.when(inside("lat", "lon", *box, strict=True), code)
    return out.otherwise("OTHER")


def credibility_label(c: Column) -> Column:
    return F.when(c >= 0.85, "VERY_HIGH").when(c >= 0.70, "HIGH").when(c >= 0.45, "MODERATE").otherwise("LOW")


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITY_RANK)), c)


def listing(df: DataFrame, size: int, page: int = 1, by: str = "occurred_at") -> DataFrame:
    """A page, newest (or highest) first, ties by id."""
    return df.orderBy(F.col(by).desc(), F.col("id").desc()).offset((page - 1) * size).limit(size)


def triage(df: DataFrame, size: int) -> DataFrame:
    """The most urgent incidents first."""
    return df.orderBy(severity_rank(F.col("severity")).desc(), F.col("credibility").desc(), F.col("occurred_at").desc(), F.col("id").desc()).limit(size)


def top_and_other(groups: DataFrame, name: str, keep: int = 4) -> DataFrame:
    """The largest groups, and the sum of the rest as "Other"."""
    ranked = groups.withColumn("__r", F.row_number().over(Window.orderBy(F.col("n").desc(), name)))
    return ranked.groupBy(F.when(F.col("__r") <= keep, F.col(name)).otherwise("Other").alias(name)).agg(F.sum("n").alias("n"))
