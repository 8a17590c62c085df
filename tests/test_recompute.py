"""Targeted recomputation over the smallest tables."""

import tempfile

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def world(spark):
    from stormledger.operators import location as lo
    from stormledger.plans import catalogue as ca
    from stormledger.plans import domain as dm
    from stormledger.storage import materialize

    reports = materialize(dm.reports(spark, SF), "reports")
    return reports, materialize(ca._inputs(reports), "inputs"), lo.gazetteer(spark), materialize(dm.evidence(spark, SF), "evidence")


def scores(spark, world, members=None):
    from stormledger.plans import domain as dm
    from stormledger.streaming.recompute import Scores

    return Scores(spark, tempfile.mkdtemp(prefix="tests-"), world[0], world[1], world[2], dm.CATEGORIES, members)


def stored(s):
    return {r["id"]: (r["credibility"], r["batch"]) for r in s.scores.rows().collect()}


def test_only_linked_reports_are_touched(spark, world):
    from stormledger.operators import evidence as ev
    from stormledger.plans import domain as dm

    evidence = world[3]
    s = scores(spark, world)
    first, second = evidence.where("evidence_id % 2 = 0"), evidence.where("evidence_id % 2 = 1")
    s.on_evidence(first, 0)
    one = stored(s)
    s.on_evidence(second, 1)
    two = stored(s)
    s.on_evidence(second, 1)  # a batch that runs again changes nothing
    assert stored(s) == two and set(one) <= set(two)
    links = ev.link_candidates(world[0], evidence, world[2], dm.CATEGORIES)
    linked = {r["id"] for r in links.where("relationship != 'IRRELEVANT'").select("id").distinct().collect()}
    candidates = {r["id"] for r in links.select("id").distinct().collect()}
    assert linked == set(two) == {r["id"] for r in s.touched.rows().collect()} and linked < candidates
    again = {r["id"] for r in ev.link_candidates(world[0], second, world[2], dm.CATEGORIES).where("relationship != 'IRRELEVANT'").collect()}
    assert all(two[i] == one[i] for i in set(one) - again) and all(two[i][1] == 1 for i in again)
    whole = scores(spark, world)
    whole.on_evidence(evidence, 0)
    assert {i: v for i, (v, _) in stored(whole).items()} == {i: v for i, (v, _) in two.items()}


def test_stale_results_are_dropped(spark, world):
    s = scores(spark, world)
    row = lambda v: spark.createDataFrame([(7, v, v, v)], "id long, strong_score double, full_score double, credibility double")
    s.scores.merge(row(0.9), 5)
    s.scores.merge(row(0.2), 3)  # computed earlier, written later
    assert stored(s) == {7: (0.9, 5)}


def test_physical_verdicts_and_clusters(spark, world):
    ids = [r["id"] for r in world[0].orderBy("id").select("id").limit(4).collect()]
    members = spark.createDataFrame([(ids[1], 1), (ids[2], 1), (ids[3], 2)], "id long, cluster_id long")
    s = scores(spark, world, members)
    s.on_clusters(spark.createDataFrame([(ids[1],), (ids[3],), (-5,)], "id long"), 0)
    plain = stored(s)
    assert set(plain) == set(ids[1:])
    verdicts = [(ids[1], "a", "1", "STATION", "SUPPORTS", 0.8), (ids[2], "a", "1", "MODEL", "CONTRADICTS", 0.8), (ids[3], "a", "1", "STATION", "CONTRADICTS", 0.0)]
    s.on_physical(spark.createDataFrame(verdicts, "id long, source_id string, station string, source_kind string, verdict string, weight double"), 1)
    after = stored(s)
    assert after[ids[1]][0] > plain[ids[1]][0] and after[ids[2]][0] == plain[ids[2]][0] and after[ids[3]][0] < plain[ids[3]][0]


def test_explanations(spark):
    from stormledger.operators import credibility as cr

    base = {"trust": 0.9, "family": "OFFICIAL", "members": 1, "has_coords": True, "has_time": True, "has_place": True, "has_text": True, "has_category": True, "evidence": 0.0, "evidence_strong": 0.0, "weak_groups": 0, "groups": 0, "strong_heard": 0, "heard": 0,
            "derived": False, "denial": 0.0, "observation": 0.0, "obs_denial": 0.0, "stations": 0, "stations_heard": 0, "place_adjustment": 0.0, "image_adjustment": 0.0, "source_type": "IMD", "stale": False, "fallback": False}
    cases = [
        {}, {"trust": 0.6, "members": 4, "evidence": 0.5, "evidence_strong": 0.5, "groups": 2, "strong_heard": 2, "heard": 2, "observation": 0.4, "stations": 3, "stations_heard": 3, "derived": True},
        {"trust": 0.2, "family": "CITIZEN", "has_coords": False, "has_time": False, "has_place": False, "has_text": False, "denial": 0.3, "stale": True, "fallback": True}, {"family": "CITIZEN"}, {"place_adjustment": -0.5}, {"image_adjustment": 0.2}, {"image_adjustment": -0.05, "place_adjustment": -0.02},
    ]
    rows = [{"id": i, **base, **c} for i, c in enumerate(cases)]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], list(rows[0]))
    got = {r["id"]: r for r in cr.explained(cr.score(df)).collect()}
    assert got[0]["positive"] == ["High institutional source trust (0.90) from IMD."] and got[0]["negative"] == ["Score capped at 0.88 per policy (isolated source or single-provenance boundary)."]
    assert got[0]["explanation"] == "Machine Credibility Score: 0.8800 (Ceiling: 0.9800).\nBase incident anchor: 0.9000 (Prior 0.90, Quality 1.00).\nPolicy upper bound: 0.88."
    assert got[1]["positive"] == [
        "Moderate baseline source trust (0.60) from IMD.", "Crowd volume signal from 4 duplicate incident reports (sub-signal: 0.63).", "Digital evidence corroboration across 2 distinct provenance groups (score: 0.50).",
        "Physical sensor telemetry confirmation across 3 monitoring stations (score: 0.40).", "Multi-source diversity boost (×1.12) from 3 independent families (NEWS, OFFICIAL, SENSOR).",
    ]
    assert got[1]["flags"] == ["Cross-quoted media detected; deduplicated to prevent double-counting."]
    assert len(got[2]["flags"]) == 7 and got[2]["flags"][0] == "Missing structured geographic coordinates." and got[2]["negative"][0].startswith("Diagnostic negative penalty of -0.1500 applied")
    assert "Contradiction penalty: -0.1500." in got[2]["explanation"] and got[3]["credibility"] == 0.65
    assert got[4]["credibility"] == pytest.approx(0.78) and got[5]["credibility"] == pytest.approx(0.93) and got[6]["credibility"] == pytest.approx(0.81)


def test_two_places(spark):
    from stormledger.functions.rounding import two_places

    xs = [i / 1000 for i in range(2001)] + [i / 8 for i in range(20)]
    for r in spark.createDataFrame([(x,) for x in xs], "x double").select("x", two_places(F.col("x")).alias("s")).collect():
        assert r["s"] == f"{r['x']:.2f}"


def test_retention_rewrites_only_what_expired(spark, tmp_path):
    import os

    from stormledger.operators import retention as rt

    day = lambda d: f"2024-01-{d:02d} 05:00:00"
    reports = spark.createDataFrame([(i, day(1 + i % 5)) for i in range(40)] + [(99, None)], "id long, at string").select("id", F.col("at").cast("timestamp").alias("occurred_at"))
    rt.store(reports, f"{tmp_path}/reports", "occurred_at")
    for name, column in rt.CHILDREN.items():  # child rows are of other days than their reports
        rt.store(spark.createDataFrame([(i, day(10 + i % 7)) for i in (*range(0, 40, 3), 200)], f"{column} long, at string"), f"{tmp_path}/{name}", "at")
    files = lambda name: {d: sorted(f for f in os.listdir(f"{tmp_path}/{name}/{d}") if f.endswith("parquet")) for d in os.listdir(f"{tmp_path}/{name}") if d.startswith("day=")}
    before = {name: files(name) for name in (*rt.CHILDREN, "reports")}
    gone = {i for i in range(40) if i % 5 < 2}
    did = {r["name"]: (r["days"], r["removed"]) for r in rt.cascade(spark, str(tmp_path), "2024-01-03").collect()}
    assert did["reports"] == (2, len(gone))
    for name, column in rt.CHILDREN.items():
        kept = sorted(r[0] for r in rt.read(spark, f"{tmp_path}/{name}", column).select(column).collect())
        assert kept == sorted(i for i in (*range(0, 40, 3), 200) if i not in gone)
        touched = {f"day=2024-01-{10 + i % 7:02d}" for i in range(0, 40, 3) if i in gone}
        after = files(name)
        assert did[name] == (len(touched), sum(i in gone for i in range(0, 40, 3))) and all((after[d] == before[name][d]) == (d not in touched) for d in before[name])
    assert {r["id"] for r in rt.read(spark, f"{tmp_path}/reports", "id").collect()} == set(range(40)) - gone | {99}
    assert all(r["removed"] == 0 for r in rt.cascade(spark, str(tmp_path), "2024-01-03").collect())  # nothing is left to do


def test_verification_steps():
    from stormledger.streaming.verification import step

    assert step("PENDING", " under_review ") == ("UNDER_REVIEW", "UNDER_REVIEW", None) and step("UNDER_REVIEW", "VERIFIED")[0] == "VERIFIED"
    assert step("VERIFIED", "REJECTED") == ("VERIFIED", "REJECTED", "Cannot transition report from terminal state 'VERIFIED' to 'REJECTED'. Terminal verification states (VERIFIED, REJECTED, DUPLICATE) cannot be modified.")
    assert step("UNDER_REVIEW", None)[2] == "Cannot transition report from 'UNDER_REVIEW' to ''. Allowed transitions from 'UNDER_REVIEW' are: DUPLICATE, REJECTED, VERIFIED."
