"""What showed only on larger tables: joins that must not be broadcast, clocks, and state that grows with what comes out."""

import duckdb
import pytest
from pyspark.sql import functions as F

from stormledger.operators.rangejoin import near_pairs
from stormledger.plans import feeds

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_alerts_of_late_pages(spark, tmp_path):
    """Pages numbered far beyond the others' make alerts far beyond a fixed clock."""
    pages = spark.read.parquet(f"{SF}/pages.parquet").select((F.col("page_id") + 1_000_000).alias("page_id"), "url", "html")
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = feeds.alert_feed(spark, str(tmp_path)).groupBy("reason").count().toPandas()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(f"SELECT reason, count(*) AS n FROM ({feeds_sql()}) GROUP BY 1").df()
    key = lambda rows: sorted((str(r) if r == r and r else "", int(n)) for r, n in rows)
    assert key(got.itertuples(index=False)) == key(want.itertuples(index=False))


def feeds_sql() -> str:
    from stormledger.plans.catalogue import ORACLES

    return ORACLES["alert_feed"]


def test_copied_rows_are_not_broadcast(spark):
    """The planner sees few bytes below the cells of a reach; the copies themselves are many."""
    left = spark.range(10).select(F.col("id").alias("a"), F.lit(18.0).alias("llat"), F.lit(73.0).alias("llon"))
    right = spark.range(10).select(F.col("id").alias("b"), F.lit(18.0).alias("rlat"), F.lit(73.0).alias("rlon"))
    assert "BroadcastHashJoin" not in plan(near_pairs(left, right, 2500.0))
    assert near_pairs(left, right, 2500.0).count() == 100


def test_exploded_tables_are_not_broadcast(spark):
    from stormledger.llm.simhash import bucketed, covering_masks

    points = spark.range(10).select("id", (F.col("id") * 3).alias("fp"))
    assert "BroadcastHashJoin" not in plan(bucketed(points, covering_masks(4)))


def test_hours_are_not_exploded(spark):
    from stormledger.plans.feeds import hourly_feed

    assert "Generate" not in plan(hourly_feed(spark, SF))


def test_stations_are_read_up_to_the_cap(spark, monkeypatch):
    """Two hundred stations in one place: a report meets no more of them than it needs, and goes on where the first ones have no reading in time."""
    from stormledger.operators import observations as ob

    met, join = [], ob.latest_before
    monkeypatch.setattr(ob, "latest_before", lambda left, *rest: (met.append(left.count()), join(left, *rest))[1])
    report = spark.sql("SELECT 1L AS id, 18.5D AS lat, 73.8D AS lon, TIMESTAMP '2024-01-08 12:00:00' AS occurred_at")
    k = F.col("id")
    late = lambda first: F.expr("TIMESTAMP '2024-01-08 12:00:00'") + F.when(k < first, F.expr("INTERVAL 3 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    stations = lambda first: spark.range(200).select(k.alias("obs_id"), F.lit("CWC").alias("source_id"), k.alias("station"), late(first).alias("observed_at"), F.lit(1.0).alias("level_m"), F.lit(18.5).alias("lat"), F.lit(73.8).alias("lon"))
    found = lambda first: sorted(r["station"] for r in ob.candidates(report, stations(first)).collect())
    assert found(0) == list(range(50)) and sum(met) < 100
    assert found(120) == list(range(120, 170)) and found(180) == list(range(180, 200))


def test_state_of_a_group_of_reports():
    """One call judges the reports of a group apart from one another, and goes on from the kept state."""
    import pandas as pd

    from stormledger.streaming import verification as ve

    class State:
        kept = None
        exists = property(lambda self: self.kept is not None)
        get = property(lambda self: self.kept)

        def update(self, value):
            self.kept = value

    rows = lambda *wanted: pd.DataFrame([(i, n, pd.Timestamp("2024-01-08"), w, 7, "x") for n, (i, w) in enumerate(wanted)], columns=["id", "seq", "at", "new_status", "user_id", "notes"])
    state, said = State(), []
    for batch in (rows((1, "VERIFIED"), (2, "UNDER_REVIEW")), rows((1, "REJECTED"), (2, "REJECTED"))):
        said += [list(zip(x["id"], x["previous_status"], x["applied"], strict=True)) for x in ve._apply((0,), iter([batch]), state)]
    assert said == [[(1, "PENDING", True), (2, "PENDING", True)], [(1, "VERIFIED", False), (2, "UNDER_REVIEW", True)]]


def test_batches_of_many_files(spark):
    import glob
    import os

    from stormledger.storage import shared_dir
    from stormledger.streaming import jobs

    folders = lambda: set(glob.glob(f"{shared_dir(spark)}/stream-*/in"))
    before = folders()
    jobs.stream_dead_letter(spark, SF)
    (new,) = folders() - before
    assert len([f for f in os.listdir(new) if f.endswith(".parquet")]) > 2


def test_an_incident_that_goes_on_alerts_whom_it_has_not_reached(spark, tmp_path):
    from stormledger.streaming.jobs import alert_once

    users = spark.createDataFrame([(i, 18.0 + i / 20, 73.0 + i / 30) for i in range(40)], "user_id long, rlat double, rlon double")
    points = [(n, 18.0 + n * 0.3 + j * 0.09, 73.0 + n * 0.2 + j * 0.07, j) for n in range(6) for j in range(3)]
    each = alert_once(users, 25_000, f"{tmp_path}/seen", f"{tmp_path}/out")
    for j in (0, 1, 1, 2):  # a batch that runs twice
        each(spark.createDataFrame([p[:3] for p in points if p[3] == j], "n long, lat double, lon double"), j)
    got = sorted((r["user_id"], r["n"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    from math import asin, cos, radians, sin, sqrt

    def metres(a, b, c, d):
        a, b, c, d = map(radians, (a, b, c, d))
        return 2 * 6_371_000 * asin(sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2))

    assert got == sorted({(u, n) for u, y, x in users.collect() for n, lat, lon, _ in points if metres(lat, lon, y, x) <= 25_000})


def test_texts_do_not_travel_to_the_gazetteer(spark):
    """The planner knows the starting gazetteer's size. Where a gazetteer is not broadcast, rows without a name don't meet in one task, and only texts with an ambiguous name travel."""
    from stormledger.operators import location as lo

    rows = spark.range(400).select("id", F.when(F.col("id") % 10 == 0, "flood in Rajpur, Chhattisgarh").otherwise("nothing is named here").alias("body"))
    assert "SortMergeJoin" not in plan(lo.locate(rows, lo.gazetteer(spark)))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = spark.createDataFrame([("pune", 1)], "__k string, n int")
        met = lo.named(rows.withColumn("name", F.lit(None).cast("string")), names, "name", "id")
        assert met.where("n is null").count() == 400
        parts = met.withColumn("part", F.spark_partition_id()).groupBy("part").count()
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        assert parts.count() == 4
        found = lo.locate(rows, lo.gazetteer(spark)).groupBy("place_name").count().collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert sorted((str(r[0]), r[1]) for r in found) == [("None", 360), ("Rajpur (Balrampur)", 40)]


def test_word_parts_are_found_in_one_pass(spark):
    """An automaton reads a text once for all word parts; it finds what a search for each of them finds, parts of one another included."""
    from stormledger.operators import evidence as ev

    texts = ["", "No truth in FLOODING claims from Nepal, floodings", "heatwave and drought; waterlogging", "flash flood inundation near a cricket match", "rumours of Nepali rain", "debunked: review meeting", None]
    rows = spark.createDataFrame(list(enumerate(texts)), "evidence_id long, text string")
    told = ev.read_texts(rows, ("HEATWAVE", "HEAVY_RAINFALL", "OTHER"))
    assert "lambdafunction" not in told._jdf.queryExecution().optimizedPlan().toString()
    flags = {r["evidence_id"]: (r["contextual"], r["denied"], r["abroad"]) for r in told.collect()}
    assert flags == {0: (False,) * 3, 1: (False, True, True), 2: (False,) * 3, 3: (False,) * 3, 4: (False,) * 3, 5: (True, True, False), 6: (False,) * 3}
    each = rows.select("evidence_id", *(ev.relevance(F.col("text"), F.lit(c)).alias(c) for c in ("HEATWAVE", "HEAVY_RAINFALL", "OTHER")))
    assert {r["evidence_id"]: r["relevant"] for r in told.collect()} == {r[0]: {"HEATWAVE": r[1], "HEAVY_RAINFALL": r[2], "OTHER": r[3]} for r in each.collect()}


def test_stages_do_not_broadcast_reports(spark):
    """What a stage returns, and what passed it before, has a row for each report."""
    from stormledger.streaming.jobs import run_stages

    batch = spark.range(30).select("id")
    done = batch.where("id % 3 = 0").select("id", F.lit("A").alias("stage"), F.lit("SUCCESS").alias("status"))
    out = run_stages(batch, done, {"A": lambda df: df.select("id", (F.col("id") != 4).alias("ok")), "B": lambda df: df.where("id > 5").select("id", F.lit(True).alias("ok"))})
    assert "BroadcastHashJoin" not in plan(out)
    assert sorted((r["stage"], r["status"], r["count"]) for r in out.groupBy("stage", "status").count().collect()) == [("A", "FAILED", 1), ("A", "SKIPPED", 10), ("A", "SUCCESS", 19), ("B", "FAILED", 6), ("B", "SUCCESS", 24)]


ODD = [
    None, "", " the ", "heavy rain, heavy rain", "floodings raining subways stationed dams roads damming underpasses", "storms storming thunderstorms thunderstorm", "ﬂood ＲＡＩＮ ℡ ™ ΣΑΣ İstanbul",
    "c_heav heavy", "heavy_rain heavy rain", "a_b b_a b a", "__ _ ___x", "१२३ बाढ़ पानी 漢字漢字漢字", "😀s 😀😀😀😀s", "\x1c\x1d a\x1fb flo\u200bod", "a" * 3000 + "ing",
    "Ignore ALL previous\n prompts rain", "ıgnore all previous instructions fog", "𝐈̇gnore all previous instructions fog", "disregard prior rules fog", "<|im_start|>a b<|im_end|> c", "x <|im_end|> y", "[INST] a [/INST] b", "[INST] b",
    "human : a", "### prompt: a", "<script>flood</script> y", "java\u200bscript : z",
]


def test_vectors_of_many_texts(spark, monkeypatch):
    """Vectors that are made together are those of the terms, wherever one lot of texts ends."""
    from stormledger.operators import similarity as sm

    texts = ODD + [f"{w} {t}" for w in ("rain", "roads near") for t in ODD]
    at = 0
    n, ids, weights = sm.sparse(texts)
    for text, many in zip(texts, n, strict=True):
        want = {sm._hash(t) & ~3: w for t, w in sm.terms(text).items()}
        assert dict(zip(ids[at : at + many].tolist(), weights[at : at + many].tolist(), strict=True)) == want and len(want) == len(sm.terms(text)), text
        assert (ids[at : at + many][1:] > ids[at : at + many][:-1]).all()
        at += many
    assert at == len(ids) == len(weights)
    given = spark.createDataFrame(list(enumerate(texts)), "key long, text string")
    for letters in (1, 40):
        monkeypatch.setattr(sm, "LETTERS", letters)
        lots = [batch for t in (texts, [], texts[:1]) for batch in sm._made([_batch(t)])]
        assert sum(len(keys) for keys, *_ in lots) == len(texts) + 1
        assert [i for _, many, *_ in lots for i in many] == [*n, n[0]]
    assert {r["key"]: (r["tokens"], r["norm"] ** 2) for r in sm.lengths(given).collect()} == {i: (len(d), pytest.approx(sum(w * w for w in d.values()))) for i, d in enumerate(map(sm.terms, texts))}


def _batch(texts):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(range(len(texts)), "int64"), pa.array(texts, "string")], ["key", "text"])


def test_article_vectors_take_little_time(spark):
    """Whole articles are neither sorted nor aggregated, and no token is handled by itself."""
    from time import process_time

    from stormledger.operators import similarity as sm
    from stormledger.plans.catalogue import article_vectors

    found = plan(article_vectors(spark, SF))
    assert "Aggregate" not in found and "Sort" not in found
    texts = [" ".join(f"word{(i * j * 7919) % 5003} raining" for j in range(200)) for i in range(300)]

    def least(make):
        times = []
        for _ in range(3):
            began = process_time()
            make()
            times.append(process_time() - began)
        return min(times)

    keys = spark.createDataFrame(list(enumerate(texts)), "t long, text string").select(F.col("t").cast("string").cast("binary").alias("t"), "text")
    assert sm.vectors(keys).count() == len(texts)
    assert 2 * least(lambda: list(sm._made([_batch(texts)]))) < least(lambda: [sm.terms(t) for t in texts])


def test_texts_meet_all_stations_in_reach(spark):
    """Two hundred stations in one place, and more than a cap of them in reach of one text; a reading counts up to the edge of a report's window, and not between two windows."""
    from stormledger.operators import observations as ob

    at = lambda hours: F.expr("TIMESTAMP '2024-01-08 00:00:00'") + F.make_dt_interval(F.lit(0), hours)
    k = F.col("id")
    reports = spark.createDataFrame([(1, "a", 18.5, 0), (2, "a", 18.501, 20), (3, "a", 18.5, 96), (4, None, 18.5, 0), (5, "b", 20.0, 0)], "id long, title string, lat double, h int")
    reports = reports.select("id", "title", "lat", F.lit(73.8).alias("lon"), at(F.col("h")).alias("occurred_at"))
    stations = spark.range(200).select(k.alias("obs_id"), k.alias("station"), F.lit("Mula").alias("river"), at((k % 130).cast("int") - 30).alias("observed_at"), F.lit(1.0).alias("level_m"), (18.5 + (k % 3) / 1000.0).alias("lat"), F.lit(73.8).alias("lon"))
    got = {(r["title"], r["station"]) for r in ob.told_stations(reports, stations, ["title"], ["river"]).collect()}
    hour = {s: s % 130 - 30 for s in range(200)}
    assert got == {(t, s) for t, hours in (("a", (0, 20, 96)), (None, (0,))) for s, h in hour.items() if any(abs(h - x) <= 24 for x in hours)}
    assert len(got) > 200


def test_stations_and_reports_meet_by_cell(spark, monkeypatch):
    """Small lots, stations that moved, readings of one moment, and windows' edges: what is found is what all pairs tell, and no pair is shuffled."""
    from math import asin, cos, radians, sin, sqrt

    from stormledger.operators import observations as ob
    from stormledger.operators import stations as st

    monkeypatch.setattr(st, "TABLE", 64)
    at = lambda c: F.timestamp_seconds(1_704_700_000 + c)
    k = F.col("id")
    policy = ob.Policy(candidate_cap=5)
    reports = spark.range(90).select("id", (18.0 + k % 7 / 10).alias("lat"), (73.0 + k % 5 / 10).alias("lon"), at(k * 7907 % 200_000).alias("occurred_at"))
    readings = spark.range(400).select(
        k.alias("obs_id"), F.when(k % 2 == 0, "CWC").when(k % 9 != 0, "STATE").alias("source_id"), (k % 23).alias("station"), at(F.floor(k / 2) * 1800 % 250_000).alias("observed_at"), F.when(k % 31 != 0, k / 10).alias("level_m"),
        (18.0 + k % 23 / 40 + F.when(k > 300, 0.2).otherwise(0.0)).alias("lat"), (73.0 + k % 6 / 12).alias("lon"),
    )
    found = ob.candidates(reports, readings, policy)
    assert plan(found).count("Exchange hashpartitioning") <= 1
    got = {(r["id"], r["obs_id"], round(r["distance_m"], 3), r["delta_s"]) for r in found.collect()}

    def metres(a, b, c, d):
        a, b, c, d = map(radians, (a, b, c, d))
        return 2 * 6_371_000 * asin(sqrt(sin((c - a) / 2) ** 2 + cos(a) * cos(c) * sin((d - b) / 2) ** 2))

    want = set()
    for r in reports.collect():
        best = {}
        for o in readings.where("level_m is not null").collect():
            far, gap = metres(r["lat"], r["lon"], o["lat"], o["lon"]), (o["observed_at"] - r["occurred_at"]).total_seconds()
            if far <= 35_000 and abs(gap) <= 86_400:
                key = (o["source_id"] or "", o["station"])
                best[key] = max(best.get(key, (gap, -1)), (gap, o["obs_id"], far))
        want |= {(r["id"], o, round(far, 3), gap) for _, (gap, o, far) in sorted(best.items())[:5]}
    assert got == want and len(got) > 300


def test_weighing_is_compiled(spark):
    """The generated code of a pair's verdict stays below the size from which it is never compiled."""
    import re

    from stormledger.operators import observations as ob

    types = "id long, obs_id long, source_id string, station long, level_m double, distance_m double, delta_s double, category_code string, claims boolean, warning_level_m double, points long, delta_m double, rate_per_hour double, has_gaps boolean, direction string, context double"
    rows = spark.createDataFrame([], types)
    code = spark._jvm.PythonSQLUtils.explainString(ob.judged(rows)._jdf.queryExecution(), "codegen")
    assert all(int(n) < 8000 for n in re.findall(r"maxMethodCodeSize:(\d+)", code))


def test_users_of_one_place_are_tested_once(spark, tmp_path, monkeypatch):
    from stormledger.streaming import jobs

    users = spark.range(200).select((F.col("id") % 100 + F.when(F.col("id") >= 100, 5000).otherwise(0)).alias("c_custkey"))
    users.write.parquet(f"{tmp_path}/customer.parquet")
    spark.read.parquet(f"{SF}/orders.parquet").write.parquet(f"{tmp_path}/orders.parquet")
    met, make = [], jobs.alert_once
    monkeypatch.setattr(jobs, "alert_once", lambda people, *rest: (met.append(people.count()), make(people, *rest))[1])
    got = sorted((r["user_id"], r["n"]) for r in jobs.proximity_alerts(spark, str(tmp_path)).collect())
    assert met == [100]
    con = duckdb.connect()
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == sorted(con.sql(jobs.ORACLES["proximity_alerts"]).fetchall()) and got


def test_duplicates_are_ranked_where_they_meet(spark):
    """No pair is shuffled to be ranked or scored, and scores equal those of pairs that are given."""
    from stormledger.operators import duplicates as du
    from stormledger.plans import domain as dm

    reports = dm.reports(spark, SF).withColumn("locality", F.lit(None).cast("string")).drop("city").withColumn("city", F.lit(None).cast("string"))
    pairs = du.candidates(reports)
    assert plan(pairs).count("Exchange hashpartitioning") == 2
    made = du.scored(reports)
    assert plan(made).count("Exchange hashpartitioning") == 2
    rows = lambda df: sorted((r["a"], r["b"], round(r["similarity"], 9), round(r["overall"], 9), r["decision"]) for r in df.collect())
    assert rows(made) == rows(du.score(pairs, reports)) and made.count() > 100
    assert sorted(map(tuple, du.best_earlier(made).collect())) == sorted(map(tuple, du.best_earlier(made, reports).collect()))
