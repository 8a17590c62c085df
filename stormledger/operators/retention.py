"""Retention over stored tables: expired reports and everything that hangs on them go, and only the days that hold some are rewritten."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import materialize

# The tables that hang on a report, and the column of each that names it.
CHILDREN = {"verification_events": "report_id", "duplicate_members": "report_id", "duplicate_clusters": "primary_report_id", "report_media": "report_id", "evidence_links": "report_id", "corroborations": "report_id"}


def store(rows: DataFrame, path: str, day: str) -> None:
    """Writes a table in partitions by day."""
    rows.withColumn("day", F.to_date(day)).repartition("day").write.mode("overwrite").partitionBy("day").parquet(path)


def read(spark: SparkSession, path: str, column: str) -> DataFrame:
    """The rows of a stored table, without the marks of days that lost every row."""
    return spark.read.parquet(path).where(F.col(column).isNotNull())


def _rewrite(spark: SparkSession, path: str, gone: DataFrame, column: str) -> DataFrame:
    """Takes rows of expired reports (gone) out of a stored table; returns the days (day, removed) that it rewrote.

    Days without such a row keep their files. All others are overwritten in one job; a day that loses every row keeps a row of nulls as a mark.
    """
    table = read(spark, path, column)
    hit = table.join(gone, table[column] == gone["__gone"], "left_semi")
    days = materialize(hit.groupBy("day").agg(F.count("*").alias("removed")), "days")
    if days.isEmpty():
        return days
    left = table.join(days.select("day"), "day", "left_semi").join(gone, table[column] == gone["__gone"], "left_anti")
    # Written elsewhere first: a table isn't overwritten while it is read.
    left = materialize(left.select(*table.columns), "kept")
    emptied = days.join(left.select("day").distinct(), "day", "left_anti").select("day")
    rows = left.unionByName(emptied, allowMissingColumns=True)
    rows.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    return days


def cascade(spark: SparkSession, root: str, cutoff: str, children: dict[str, str] = CHILDREN) -> DataFrame:
    """(name, days, removed): deletes the reports of ``root``/reports from before the cutoff, after all rows of the child tables that hang on them.

    Children go first and the reports last, so that a run that fails can be repeated: it finds the same reports again. Reports without a time stay.
    """
    reports = read(spark, f"{root}/reports", "id")
    gone = materialize(reports.where(F.col("occurred_at") < F.lit(cutoff).cast("timestamp")).select(F.col("id").alias("__gone")), "gone")
    out = None
    for name, column in {**children, "reports": "id"}.items():
        days = _rewrite(spark, f"{root}/{name}", gone, column).agg(F.count("*").alias("days"), F.coalesce(F.sum("removed"), F.lit(0)).alias("removed")).select(F.lit(name).alias("name"), "days", "removed")
        out = days if out is None else out.unionByName(days)
    return out
