"""Upserts, status changes, votes, archives and retention, as whole-table transformations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..policy import TRANSITIONS


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The last row of each key: last write wins."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def upsert_reports(old: DataFrame, new: DataFrame) -> DataFrame:
    """Reports after an ingest: known (source_id, external_id) keep all but payload and updated_at; new ones start QUEUED, PENDING, 0.

    Of rows of a batch that share a key the latest by updated_at counts (then the largest payload and title), so a batch that repeats
    itself adds nothing.
    """
    key = ["source_id", "external_id"]
    new = latest(new, key, [F.col("updated_at").desc_nulls_last(), F.col("payload").desc_nulls_last(), F.col("title").desc_nulls_last()])
    fresh = new.join(old.select(*key), key, "left_anti")
    fresh = fresh.withColumns({"processing_status": F.lit("QUEUED"), "status": F.lit("PENDING"), "credibility": F.lit(0.0), "is_demo": F.coalesce(F.col("title").startswith("[DEMO]") | F.col("external_id").startswith("DEMO-"), F.lit(False))})
    seen = new.select(*key, F.col("payload").alias("__p"), F.col("updated_at").alias("__u"))
    kept = old.join(seen, key, "left").withColumns({"payload": F.coalesce("__p", "payload"), "updated_at": F.coalesce("__u", "updated_at")}).drop("__p", "__u")
    return kept.unionByName(fresh.select(*kept.columns))


def upsert_observations(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Last write wins for each (source_id, external_id), or (source_id, station, observed_at) where there is no external id."""
    own = F.when(F.col("external_id").isNotNull(), F.concat(F.lit("x:"), "external_id")).otherwise(F.concat_ws("|", F.lit("s:"), F.col("station").cast("string"), F.col("observed_at").cast("string")))
    return latest(rows.withColumn("__key", own), ["source_id", "__key"], order).drop("__key")


def upsert_evidence(old: DataFrame, new: DataFrame, order: list[Column]) -> DataFrame:
    """Evidence after an ingest: the batch's last row of each (source_id, external_id) replaces the stored one."""
    key = ["source_id", "external_id"]
    last = latest(new, key, order)
    return old.join(last.select(*key), key, "left_anti").unionByName(last.select(*old.columns))


def retained(observations: DataFrame, evidence: DataFrame, cutoff: str) -> dict[str, DataFrame]:
    """What a retention run keeps: observations from the cutoff on, and evidence by its time of publication, else of capture."""
    at = F.lit(cutoff).cast("timestamp")
    return {"observations": observations.where(F.col("observed_at") >= at), "evidence": evidence.where(F.coalesce("published_at", "captured_at") >= at)}


def transition_ok(before: Column, after: Column) -> Column:
    """Whether a status may follow another."""
    out = F.lit(False)
    for status, nexts in TRANSITIONS.items():
        if nexts:
            out = out | ((before == status) & after.isin(*nexts))
    return F.coalesce(out, F.lit(False))


def all_or_nothing(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, batch, before, after, applied): a batch of changes applies only if every one of them may."""
    rows = wanted.join(current.select("id", F.col("status").alias("before")), "id", "left").withColumn("ok", transition_ok(F.col("before"), F.col("after")))
    whole = F.min(F.col("ok").cast("int")).over(Window.partitionBy("batch")) == 1
    return rows.select("id", "batch", "before", "after", whole.alias("applied"))


def votes(feedback: DataFrame) -> DataFrame:
    """(report_id, confirms, disputes): one vote for each voter (user, else address), the latest."""
    voter = F.coalesce(F.concat(F.lit("u"), F.col("user_id").cast("string")), F.concat(F.lit("ip"), F.col("client_ip")))
    one = latest(feedback.withColumn("voter", voter), ["report_id", "voter"], [F.col("created_at").desc(), F.col("vote_id").desc()])
    return one.groupBy("report_id").agg(F.count(F.when(F.col("vote_type") == "CONFIRM", 1)).alias("confirms"), F.count(F.when(F.col("vote_type") == "DISPUTE", 1)).alias("disputes"))


def archive(reports: DataFrame, archived: DataFrame, cutoff: str) -> DataFrame:
    """Verified reports before the cutoff that the archive lacks."""
    old = reports.where((F.col("status") == "VERIFIED") & (F.col("occurred_at") < F.lit(cutoff).cast("timestamp")))
    return old.join(archived.select("id"), "id", "left_anti")


def survivors(reports: DataFrame, children: dict[str, tuple[DataFrame, str]], cutoff: str) -> dict[str, DataFrame]:
    """Reports from the cutoff on, and of each child table (frame, its report column) what belongs to them."""
    gone = reports.where(F.col("occurred_at") < F.lit(cutoff).cast("timestamp")).select(F.col("id").alias("__gone"))
    out = {"reports": reports.where(F.col("occurred_at").isNull() | (F.col("occurred_at") >= F.lit(cutoff).cast("timestamp")))}
    return out | {name: df.join(gone, df[column] == gone["__gone"], "left_anti") for name, (df, column) in children.items()}


def rate_limited(requests: DataFrame, limit: int, seconds: int = 60) -> DataFrame:
    """(client, slot, requests, rejected) in fixed windows."""
    slot = F.window("at", f"{seconds} seconds")["start"]
    return requests.groupBy("client", slot.alias("slot")).agg(F.count("*").alias("requests")).withColumn("rejected", F.greatest(F.col("requests") - limit, F.lit(0)))


def classification_metrics(rows: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1) of rows (truth 0/1, score), in one pass for all thresholds."""
    every = rows.select("truth", "score", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    hit, true = F.col("score") >= F.col("threshold"), F.col("truth") == 1
    n = lambda c: F.count(F.when(c, 1))
    c = every.groupBy("threshold").agg(n(hit & true).alias("tp"), n(hit & ~true).alias("fp"), n(~hit & true).alias("fn"), n(~hit & ~true).alias("tn"))
    ratio = lambda a, b: F.when(b > 0, F.round(a / b, 4)).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select("threshold", "tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def readiness(stages: Column) -> Column:
    """READY, PARTIAL, FAILED or PENDING of a report from the map of its stages' outcomes."""
    values = F.map_values(stages)
    n = lambda kind: F.size(F.filter(values, lambda v: v == kind))
    return F.when(F.size(values) == 0, "PENDING").when(n("SUCCESS") + n("SKIPPED") == F.size(values), "READY").when(n("FAILED") == F.size(values), "FAILED").when(n("SUCCESS") > 0, "PARTIAL").otherwise("PENDING")
