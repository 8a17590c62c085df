"""Values and rules of the operators on small frames."""

import json
import math

import pytest
from pyspark.sql import functions as F


def rows(df):
    return [r.asDict(recursive=True) for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


# --- functions


def test_haversine_and_boxes(spark):
    from stormledger.functions.geo import check_box, haversine_m

    assert one(spark, haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))) == pytest.approx(math.pi * 6_371_000 / 180)
    assert check_box((70, 10, 80, 20)) == (70, 10, 80, 20)
    for bad in ((80, 10, 70, 20), (70, 10, 81, 20), (-200, 0, 0, 1)):
        with pytest.raises(ValueError, match="box"):
            check_box(bad)


def test_near_pairs_equals_theta_join(spark):
    from stormledger.functions.geo import haversine_m
    from stormledger.operators.rangejoin import near_pairs

    k = F.col("id")
    pts = spark.range(400).select(k, (18 + (k * 7919 % 200) / 1000).alias("lat"), (73 + (k * 104729 % 200) / 1000).alias("lon"), F.timestamp_seconds(1_700_000_000 + k * 7907 % 40000).alias("t"))
    left = pts.select(F.col("id").alias("lid"), F.col("lat").alias("llat"), F.col("lon").alias("llon"), F.col("t").alias("lt"))
    right = pts.select(F.col("id").alias("rid"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.col("t").alias("rt"))
    got = {(r["lid"], r["rid"]) for r in near_pairs(left, right, 2500, 3600).collect()}
    want = left.crossJoin(right).where((haversine_m("llat", "llon", "rlat", "rlon") <= 2500) & (F.abs(F.unix_timestamp("lt") - F.unix_timestamp("rt")) <= 3600))
    assert got == {(r["lid"], r["rid"]) for r in want.collect()} and len(got) > 400


def test_near_pairs_at_any_place(spark):
    from stormledger.functions.geo import haversine_m
    from stormledger.operators.rangejoin import near_pairs

    k = F.col("id")
    lon = (k * 104729 % 400) / 400 - 0.5  # around the 180th meridian
    pts = spark.range(300).select(k, F.element_at(F.array(*map(F.lit, (70.0, -70.0, 0.0, 88.9))), (k % 4 + 1).cast("int")) + (k * 7919 % 200) / 400, F.when(lon > 0, lon - 180).otherwise(lon + 180)).toDF("id", "lat", "lon")
    left, right = pts.toDF("lid", "llat", "llon"), pts.toDF("rid", "rlat", "rlon")
    for radius in (500, 20_000):
        got = [(r["lid"], r["rid"]) for r in near_pairs(left, right, radius).collect()]
        want = {(r["lid"], r["rid"]) for r in left.crossJoin(right).where(haversine_m("llat", "llon", "rlat", "rlon") <= radius).collect()}
        assert set(got) == want and len(got) == len(want) >= 300


def test_newest_and_latest(spark):
    from stormledger.operators.rangejoin import latest_before, newest_within

    at = lambda c: F.timestamp_seconds(1_700_000_000 + c)
    k = F.col("id")
    right = spark.range(500).select(k.alias("rid"), (k % 3).alias("key"), at(k * 7907 % 30_000).alias("rt"))
    left = spark.range(60).select(k.alias("lid"), (k % 4).alias("key"), at(k * 600 - 2000).alias("lt"))
    r, q = right.collect(), left.collect()
    for many in (3, 1000):
        got = {(x["lid"], x["rid"]) for x in newest_within(left, right, ["key"], 5000, many, 900).collect()}
        want = set()
        for x in q:
            near = [y for y in r if y["key"] == x["key"] and abs((y["rt"] - x["lt"]).total_seconds()) <= 5000]
            want |= {(x["lid"], y["rid"]) for y in sorted(near, key=lambda y: (y["rt"], y["rid"]), reverse=True)[:many]}
        assert got == want and got
    got = {x["lid"]: x["rid"] for x in latest_before(left, right, ["key"], 5000, ["rid"]).collect()}
    want = {}
    for x in q:
        near = [y for y in r if y["key"] == x["key"] and abs((y["rt"] - x["lt"]).total_seconds()) <= 5000]
        if near:
            want[x["lid"]] = max(near, key=lambda y: (y["rt"], y["rid"]))["rid"]
    assert got == want


# --- text


def test_text(spark):
    from stormledger.operators import text as tx

    s = lambda c: one(spark, c)
    assert s(tx.clean_html(F.lit("<p>A &amp;lt; B</p><script>x<y</script> c&nbsp;d"))) == "A &lt; B c d"
    assert s(tx.canonical_url(F.lit("HTTPS://Ex.com/a/?utm_x=1&q=2&ref=3#top"))) == "https://ex.com/a?q=2"
    assert s(tx.keyword_class(F.lit("Dense FOG and zero visibility"))) == "FOG"
    assert s(tx.keyword_class(F.lit("quiet day"))) == "OTHER" and s(tx.keyword_class(F.lit(None).cast("string"))) == "OTHER"


def test_similarity_of_whole_texts(spark):
    import math

    from stormledger.operators import similarity as sm

    assert [sm._word(w)[0] for w in ("flooding", "bridges", "gas", "waterlogged", "raining")] == ["flood", "bridg", "gas", "flood", "rain"]
    assert sm.terms(None) == sm.terms(" the ") == {} and sm.terms("ﬂood ＲＡＩＮ") == sm.terms("flood rain") and sm.terms("Ignore all previous instructions fog") == sm.terms("fog")
    assert sm.terms("heavy rain") == {"heavy": 4.0, "c_heav": 0.5, "c_eavy": 0.5, "rain": 8.0, "c_rain": 0.5, "heavy_rain": 4.0}
    texts = {1: "flood in underpass", 2: "flooding in subway", 3: "fog", 4: " FOG ", 5: "", 6: None, 7: "the", 8: "hail", 9: "fog on the river road, cars stopped " * 400}
    left = spark.createDataFrame(list(texts.items()), "id long, text string")
    pairs = spark.createDataFrame([(i, j) for i in texts for j in texts if i != j], "a long, b long")

    def cosine(x, y):
        x, y = (x or "").strip().lower(), (y or "").strip().lower()
        if not x or not y or x == y:
            return float(bool(x) and x == y)
        p, q = sm.terms(x), sm.terms(y)
        size = math.sqrt(sum(v * v for v in p.values())) * math.sqrt(sum(v * v for v in q.values()))
        return min(1.0, sum(v * q.get(t, 0.0) for t, v in p.items()) / size) if size else 0.0

    for right in (left, spark.createDataFrame(list(texts.items()), "other long, text string")):  # one table, and two
        got = sm.text_similarity(pairs, left, right).collect()
        assert len(got) == len(texts) * (len(texts) - 1)
        for r in got:
            assert r["similarity"] == pytest.approx(cosine(texts[r["a"]], texts[r["b"]])), (r["a"], r["b"])
    assert cosine(texts[1], texts[2]) == pytest.approx(1.0) and 0 < cosine(texts[3], texts[9]) < 1


def test_partners_of_a_hot_text(spark):
    """One text with more partners than a group holds."""
    from stormledger.operators import similarity as sm

    n = 2 * sm.PARTNERS + 10
    left = spark.range(n).select("id", F.concat(F.lit("flood at bridge "), F.col("id").cast("string")).alias("text"))
    right = spark.createDataFrame([(0, "flood at bridge 77")], "id long, text string")
    got = sm.text_similarity(left.select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b")), left, right).select("a", "similarity").collect()
    assert len(got) == n and {r["a"] for r in got if r["similarity"] == 1.0} == {77} and min(r["similarity"] for r in got) > 0.5


def test_categories(spark):
    from stormledger.operators.categories import compatibility

    s = lambda a, b: one(spark, compatibility(F.lit(a), F.lit(b)))
    assert (s("FOG", "fog "), s("HEATWAVE", "FOG"), s("FOG", "HEATWAVE"), s("CYCLONE", "HEAVY_RAINFALL"), s("CYCLONE_GALE", "STRONG_WIND"), s("", "FOG"), s("FOG", "HAILSTORM"), s("CYCLONE", "CYCLONE_STORM")) == (1.0, 0.0, 0.0, 0.70, 0.85, 0.4, 0.3, 1.0)


# --- duplicates


def test_duplicate_clusters_follow_chains(spark):
    from stormledger.operators.duplicates import clusters

    parents = spark.createDataFrame([(i, i - 1) for i in range(1, 20)] + [(31, 30)], "id long, parent long")
    got = {r["id"]: r["primary_id"] for r in clusters(parents).collect()}
    assert got == {i: 0 for i in range(20)} | {30: 30, 31: 30}


def test_duplicate_gates(spark):
    from stormledger.operators.duplicates import score

    reports = spark.createDataFrame([(1, "FOG", "dense fog", "Pune"), (2, "FOG", "dense fog", "Pune"), (3, "HEATWAVE", "dense fog", "Pune"), (4, "FOG", "dense fog", "Nashik")], "id long, category_code string, title string, city string")
    pairs = spark.createDataFrame([(1, 2, 10.0, 60.0), (1, 3, 10.0, 60.0), (1, 4, 10.0, 60.0), (2, 1, None, None), (2, 3, 2600.0, 1.0)], "a long, b long, distance_m double, delta_s double")
    got = {(r["a"], r["b"]): (r["decision"], r["overall"]) for r in score(pairs, reports).collect()}
    assert got[1, 2][0] == "DUPLICATE" and got[1, 3] == ("DISTINCT", 0.0) and got[1, 4] == ("DISTINCT", 0.0) and got[2, 1] == ("POSSIBLE_MATCH", pytest.approx(1.0)) and got[2, 3] == ("DISTINCT", 0.0)


# --- evidence


def test_evidence_links(spark):
    from stormledger.operators.evidence import link, temporal, upsert_links

    base = dict(text="heavy flood in pune", semantic=0.9, entity=0.8, temporal=1.0, cat=1.0, spatial=0.9, distance_m=100.0, hours=1.0, foreign=False, evi_city="Pune", inc_city="pune", evi_state=None, inc_state=None, evi_placed=True, inc_placed=True)
    cases = {
        "SUPPORTING": {}, "CONTRADICTORY": {"text": "police: fake news about flood"}, "CONTEXTUAL": {"text": "monsoon preparedness in pune"}, "RELATED": {"semantic": 0.3, "entity": 0.6, "temporal": 0.9},
        "IRRELEVANT": {"distance_m": 25_001.0},
    }
    schema = "text string, semantic double, entity double, temporal double, cat double, spatial double, distance_m double, hours double, foreign boolean, evi_city string, inc_city string, evi_state string, inc_state string, evi_placed boolean, inc_placed boolean"
    made = link(spark.createDataFrame([tuple((base | c).values()) for c in cases.values()], schema))
    assert [r["relationship"] for r in made.collect()] == list(cases)
    assert [one(spark, temporal(F.lit(h).cast("double"))) for h in (None, 2, 24, 48, 49)] == pytest.approx([0.5, 1.0, 0.7, 0.3, 0.0])
    old = spark.createDataFrame([(1, 1, "RELATED", 0.5, True), (1, 2, "RELATED", 0.5, False)], "id long, evidence_id long, relationship string, overall double, override boolean")
    new = spark.createDataFrame([(1, 1, "SUPPORTING", 0.9), (1, 2, "IRRELEVANT", 0.1), (1, 3, "IRRELEVANT", 0.1), (1, 4, "SUPPORTING", 0.8)], "id long, evidence_id long, relationship string, overall double")
    assert {r["evidence_id"]: r["relationship"] for r in upsert_links(old, new).collect()} == {1: "RELATED", 2: "IRRELEVANT", 4: "SUPPORTING"}


# --- observations


def test_observation_scores(spark):
    from stormledger.operators import observations as ob

    t = lambda s: one(spark, ob.temporal_score(F.lit(float(s))))
    assert (t(0), t(-4 * 3600), t(-14 * 3600), t(-25 * 3600), t(8 * 3600)) == (1.0, 1.0, 0.5, 0.0, 0.7)
    readings = spark.createDataFrame([("a", i, 1.0 + i, 1.0 + i / 10) for i in range(3)] + [("b", 9, 0.0, 2.0), ("c", 10, 0.0, 1.0), ("c", 11, 9.0, 1.0)], "station string, obs_id long, h double, level_m double")
    readings = readings.withColumn("observed_at", F.timestamp_seconds(1_700_000_000 + F.col("h") * 3600))
    got = {r["station"]: r for r in ob.trend(readings, ["station"]).collect()}
    assert (got["a"]["direction"], got["a"]["delta_m"], got["a"]["rate_per_hour"], got["a"]["has_gaps"]) == ("RISING", 0.2, 0.1, False)
    assert got["b"]["direction"] == "SINGLE_POINT" and (got["c"]["direction"], got["c"]["has_gaps"]) == ("STEADY", True)
    names = ("Mula", "Krishna", "Pune", "Maharashtra")
    ctx = lambda *said: one(spark, ob.station_context(*(F.lit(x).cast("string") for x in (*said, *names))))
    cases = {
        ("the mula rises", None, None): 1.0, ("mula nagar market in pune", None, None): 0.50, ("hotel mula", None, None): 0.10, ("krishna basin", None, None): 0.50, ("godavari river, krishna", None, None): 0.15,
        ("pune street", None, None): 0.20, ("pune", "mula in flood", None): 0.55, (None, "mula rises", None): 0.40, (None, "krishna rises", None): 0.35, ("maharashtra coast", None, None): 0.20,
        (None, None, "near the mula bank"): 0.20, (None, None, None): 0.10,
    }
    assert {k: ctx(*k) for k in cases} == cases


def test_corroboration_gates(spark):
    from stormledger.operators.observations import corroborate

    base = dict(category_code="URBAN_FLOOD", spatial=0.95, temporal=1.0, relevance=1.0, context=1.0, quality="VALID", trend=1.0, direction="RISING", points=6, has_gaps=False, delta_m=0.4, trust=0.9, level_m=3.0, warning_level_m=5.0, title="river breached")
    cases = [
        ({}, "CORROBORATING"), ({"relevance": 0.0}, "IRRELEVANT"), ({"quality": "MISSING"}, "INSUFFICIENT_DATA"), ({"quality": "STALE"}, "IRRELEVANT"), ({"direction": "STEADY", "delta_m": 0.01, "trend": 0.4}, "CONTRADICTORY"),
        ({"category_code": "HEAVY_RAINFALL", "relevance": 0.55}, "CONSISTENT"), ({"context": 0.10}, "WEAK"), ({"spatial": None, "context": 0.1}, "INSUFFICIENT_DATA"),
    ]
    schema = "category_code string, spatial double, temporal double, relevance double, context double, quality string, trend double, direction string, points int, has_gaps boolean, delta_m double, trust double, level_m double, warning_level_m double, title string"
    made = corroborate(spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)).collect()
    assert [r["relationship"] for r in made] == [w for _, w in cases]
    assert made[5]["score"] == 0.69


def test_physical(spark):
    from stormledger.operators.physical import cache_key, evaluate

    names = "category_code source_kind distance_km gap_hours rain_1h rain_3h rain_24h rain_72h level_m wind gust pressure visibility humidity temp weather_code".split()
    base = dict.fromkeys(names) | {"category_code": "FOG", "source_kind": "STATION", "distance_km": 0.0, "gap_hours": 0.0}
    cases = [({"visibility": 400.0}, "SUPPORTS"), ({"visibility": 4000.0}, "CONTRADICTS"), ({"visibility": 4000.0, "source_kind": "MODEL"}, "NEUTRAL"), ({"visibility": 400.0, "distance_km": 26.0}, "NEUTRAL"), ({"category_code": "HAILSTORM", "weather_code": 96.0}, "SUPPORTS"), ({}, "NEUTRAL")]
    schema = ", ".join(f"{n} {'string' if n in ('category_code', 'source_kind') else 'double'}" for n in names)
    made = evaluate(spark.createDataFrame([tuple((base | c).values()) for c, _ in cases], schema)).collect()
    assert [r["verdict"] for r in made] == [w for _, w in cases] and made[0]["contribution"] == 0.10 and made[3]["status"] == "TOO_FAR"
    assert one(spark, cache_key(F.lit(18.6), F.lit(73.1), F.lit("2024-01-01 05:30:00").cast("timestamp"))) == "18.50:73.00:2024010105"


def test_credibility(spark):
    from stormledger.operators import credibility as cr

    fam = lambda s: one(spark, cr.family(F.lit(s)))
    assert [fam(s) for s in ("CITIZEN_WEB", "GOVERNMENT", "RSS_FEED", "MASTODON", "CWC_RIVER", "x", None)] == ["CITIZEN", "OFFICIAL", "NEWS", "SOCIAL", "SENSOR", "OTHER", "OTHER"]
    v = spark.createDataFrame([(0.5,), (0.5,), (0.0,)], "v double")
    assert v.agg(cr.noisy_or(F.col("v")).alias("x")).first()["x"] == pytest.approx(0.75)
    assert v.union(v.select(F.lit(1.0))).agg(cr.noisy_or(F.col("v")).alias("x")).first()["x"] == 1.0
    cap = lambda s, f, w=True: one(spark, cr.weak_capped(F.lit(s), F.lit(f), F.lit(w)))
    assert (cap(0.60, 0.90), cap(0.64, 0.90), cap(0.64, 0.9, False), cap(0.9, 0.99)) == (0.63, 0.6499, 0.9, pytest.approx(0.93))
    base = "id trust family members has_coords has_time has_place has_text has_category evidence evidence_strong weak_groups strong_heard heard denial observation obs_denial stations".split()
    row = dict.fromkeys(base) | {"trust": 0.6, "family": "CITIZEN", "has_coords": True, "has_time": True, "has_place": True, "has_text": True, "has_category": True}
    cases = [{"id": 1}, {"id": 2, "members": 5}, {"id": 3, "evidence": 0.5, "evidence_strong": 0.5, "strong_heard": 1, "heard": 1}, {"id": 4, "denial": 0.5}]
    kinds = {"family": "string"} | {b: "boolean" for b in base if b.startswith("has_")} | {b: "int" for b in ("id", "members", "weak_groups", "strong_heard", "heard", "stations")}
    df = spark.createDataFrame([tuple((row | c).values()) for c in cases], ", ".join(f"{b} {kinds.get(b, 'double')}" for b in base))
    got = {r["id"]: r["credibility"] for r in cr.score(df).collect()}
    assert got[1] == 0.6 and got[1] < got[2] <= 0.82 and got[3] > 0.6 and got[4] == 0.35


# --- places, images, lifecycle


def test_places(spark):
    from stormledger.operators import location as lo

    g = lo.gazetteer(spark)
    texts = [
        (1, "Flood near Andheri Station, Mumbai"), (2, "rain in Rajpur"), (3, "storm over Nepal and Pune"), (4, "newdelhi"), (5, "New  Delhi <b>fog</b>"), (6, None), (7, "Rajpur in Balrampur block"), (8, "Bilaspur, then Pune"),
        (9, "delhi"), (10, "Andheri of Maharashtra"), (11, "Aurangabad, Bihar"), (12, "a" * 5000 + " < pune"), (13, "pune_west Puneri"), (14, "é pune é"),
    ]
    df = spark.createDataFrame(texts, "id long, body string")
    found = {r["id"]: [(x["name"], x["kind"]) for x in r["found"]] for r in lo.mentions(df, g, "body").collect()}
    assert found[1] == [("andheri station", "LOCALITY"), ("mumbai", "CITY")] and found[5] == [("new delhi", "CITY")] and found[4] == found[6] == found[13] == [] and found[12] == found[14] == [("pune", "CITY")] and found[9] == [("delhi", "CITY")]
    got = {r["id"]: (r["status"], r["place_name"], r["confidence"]) for r in lo.locate(df, g).collect()}
    assert got[1] == ("RESOLVED", "Andheri, Mumbai", 0.95) and got[10] == ("RESOLVED", "Andheri, Mumbai", 0.95) and got[3] == ("RESOLVED", "Nepal", 0.0) and got[7] == ("RESOLVED", "Rajpur (Balrampur)", 0.85)
    assert got[8] == ("RESOLVED", "Pune, Maharashtra", 0.90) and got[11] == ("RESOLVED", "Aurangabad (Bihar)", 0.85) and got[2][:2] == ("AMBIGUOUS", "Rajpur")
    assert len(next(r for r in lo.locate(df, g).collect() if r["id"] == 2)["candidates"]) == 3
    pts = spark.createDataFrame([(1, 18.6, 73.8), (2, 0.0, 0.0), (3, 19.1, 72.9)], "id long, lat double, lon double")
    assert sorted((r["id"], r["city"]) for r in lo.first_city(pts, g, "id").collect()) == [(1, "Pune"), (3, "Mumbai")]  # Thane is nearer to the third, Mumbai comes first
    m = lambda d, s, f: one(spark, lo.mismatch(F.lit(d), F.array(*map(F.lit, s)).cast("array<string>"), F.lit(f)))["verdict"]
    assert (m("Kerala", ["kerala"], False), m("Kerala", ["Assam"], False), m("Kerala", [], True), m("Kerala", [], False)) == ("CONSISTENT", "MISMATCH", "MISMATCH", "NEUTRAL")


def test_names_against_brute_force(spark, monkeypatch):
    """Overlapping names over random texts, by one automaton and by several."""
    import random
    import re

    from stormledger.operators import location as lo

    rng = random.Random(5)
    parts = ["a", "b", "c", "d-", "é"]
    names = sorted({" ".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(25)})
    places = spark.createDataFrame([(n, "CITY", 0, *(None,) * 6, 0.0, 0.0) for n in names], lo.GAZETTEER)
    texts = [(i, " ".join(rng.choice([*parts, "x", "<i>", "ab"]) for _ in range(rng.randint(0, 30)))) for i in range(200)]

    def brute(text):
        low = re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text)).strip().lower()
        out, taken = [], set()
        hits = [(-len(n), m.start(), n) for n in names for m in re.finditer(rf"\b{re.escape(n)}\b", low)]
        for size, b, n in sorted(hits):  # longer names first, of equal ones the earlier
            if taken.isdisjoint(range(b, b - size)):
                taken.update(range(b, b - size))
                out.append((b, n))
        return [n for _, n in sorted(out)]

    df = spark.createDataFrame(texts, "id long, body string")
    for most in (lo.NAMES, 7):
        monkeypatch.setattr(lo, "NAMES", most)
        got = {r["id"]: [x["name"] for x in r["found"]] for r in lo.mentions(df, places, "body").collect()}
        assert got == {i: brute(t) for i, t in texts}


def test_location_ladder(spark):
    from stormledger.operators import location as lo

    rows = [
        (1, 18.5, 73.9, None, None, None, None, "Mumbai"), (2, 95.0, 73.9, None, None, "Pune", None, None), (3, None, None, "Andheri", None, None, None, None),
        (4, None, None, None, "a bridge", " PUNE ", None, None), (5, None, None, None, None, None, "Kerala", "Kochi"), (6, None, None, None, None, None, None, "Andheri, Mumbai"),
        (7, None, None, None, None, None, None, "rain in Andheri"), (8, None, None, None, None, None, None, "rain in Rajpur"), (9, None, None, None, None, None, None, "Pune, Maharashtra"),
        (10, None, None, None, None, None, None, "Nepal and Pune"), (11, None, None, None, None, None, None, None), (12, None, None, None, None, None, None, "Rajpur near Pune"),
    ]
    schema = "id long, lat double, lon double, locality string, location_name string, city string, state string, body string"
    got = {r["id"]: (r["status"], r["city"], r["confidence"]) for r in lo.locate(spark.createDataFrame(rows, schema), lo.gazetteer(spark)).collect()}
    assert got == {
        1: ("RESOLVED", None, 1.0), 2: ("UNRESOLVED", None, 0.0), 3: ("RESOLVED", "Mumbai", 0.95), 4: ("RESOLVED", "Pune", 0.90), 5: ("RESOLVED", None, 0.0), 6: ("RESOLVED", "Mumbai", 0.95),
        7: ("RESOLVED", "Mumbai", 0.90), 8: ("AMBIGUOUS", None, 0.0), 9: ("RESOLVED", "Pune", 0.95), 10: ("RESOLVED", None, 0.0), 11: ("UNRESOLVED", None, 0.0), 12: ("RESOLVED", "Pune", 0.90),
    }


def test_images(spark):
    from stormledger.operators import images as im

    pics = spark.createDataFrame([(1, "a", "ffff000000000000"), (2, "b", "fff0000000000001"), (3, "c", "0fff000000000000"), (4, "a", None)], "image_id long, sha256 string, phash string")
    assert {(r["a"], r["b"], r["distance"]) for r in im.lookalikes(pics).collect()} == {(2, 1, 5), (4, 1, 0)}
    assert {(r["a"], r["b"]) for r in im.lookalikes(pics, exact=True).collect()} == {(2, 1), (3, 1), (3, 2), (4, 1)}
    v = lambda *c: one(spark, im.verdict(F.array(*map(F.lit, c))))
    assert (v("SUPPORTS", "SUPPORTS")["adjustment"], v("CONTRADICTS", "SUPPORTS")["adjustment"], v("SUPPORTS", "NEUTRAL")["verdict"]) == (0.03, -0.03, "NEUTRAL")


def test_lifecycle(spark):
    from stormledger.operators import lifecycle as li

    ok = lambda a, b: one(spark, li.transition_ok(F.lit(a), F.lit(b)))
    assert ok("PENDING", "VERIFIED") and ok("UNDER_REVIEW", "DUPLICATE") and not ok("VERIFIED", "PENDING") and not ok("UNDER_REVIEW", "PENDING") and not ok(None, "VERIFIED")
    now = spark.createDataFrame([(1, "PENDING"), (2, "VERIFIED")], "id long, status string")
    wanted = spark.createDataFrame([(1, 7, "VERIFIED"), (2, 7, "REJECTED"), (1, 8, "REJECTED")], "id long, batch long, after string")
    assert {(r["id"], r["batch"]): r["applied"] for r in li.all_or_nothing(now, wanted).collect()} == {(1, 7): False, (2, 7): False, (1, 8): True}
    stages = lambda **k: one(spark, li.readiness(F.create_map(*(F.lit(x) for p in k.items() for x in p))))
    assert (stages(a="SUCCESS", b="SKIPPED"), stages(a="FAILED"), stages(a="SUCCESS", b="FAILED"), stages(a="PENDING")) == ("READY", "FAILED", "PARTIAL", "PENDING")
    old = spark.createDataFrame([("s", "1", "t", "p", "u0", "QUEUED", "VERIFIED", 0.9, False)], "source_id string, external_id string, title string, payload string, updated_at string, processing_status string, status string, credibility double, is_demo boolean")
    new = spark.createDataFrame([("s", "1", "t2", "p2", "u1"), ("s", "DEMO-2", "[DEMO] x", "q", "u1")], "source_id string, external_id string, title string, payload string, updated_at string")
    got = {r["external_id"]: r for r in li.upsert_reports(old, new).collect()}
    assert (got["1"]["title"], got["1"]["payload"], got["1"]["status"]) == ("t", "p2", "VERIFIED") and (got["DEMO-2"]["status"], got["DEMO-2"]["is_demo"]) == ("PENDING", True)


# --- feeds


def test_fields(spark):
    from stormledger.sources import normalise as no

    t = lambda s: str(one(spark, F.date_format(no.timestamp(F.lit(s)), "yyyy-MM-dd HH:mm")))
    assert t("2024-01-02T03:04:05Z") == "2024-01-02 03:04" and t("Tue Jan 02 09:30:00 IST 2024") == "2024-01-02 04:00" and t("1704164640") == "2024-01-02 03:04"
    assert t("Tue, 02 Jan 2024 03:04:05 GMT") == "2024-01-02 03:04" and t("02-01-2024 03:04:05") == "2024-01-02 03:04" and t("soon") == "None"
    assert t("2024-01-02T03:04:05+05:30") == "2024-01-01 21:34"
    sev = lambda s: one(spark, no.met_severity(F.lit(s)))
    assert (sev("Orange"), sev("moderate to heavy rain"), sev("???")) == ("HIGH", "HIGH", "MODERATE")
    cat = lambda r, s="": one(spark, no.category(F.lit(r), F.lit(s)))
    assert (cat("CYCLONE_GALE"), cat("Heavy rain"), cat("flash flood warning"), cat("", "dense fog tonight"), cat("zzz", "zzz"), cat("FOG")) == ("CYCLONE_STORM", "HEAVY_RAINFALL", "FLOOD_WATERLOGGING", "FOG", "OTHER", "FOG")


def test_event_normaliser(spark):
    from stormledger.sources.normalise import events

    raw = [{"headline": "Flood", "lat": "18.5", "lon": 73.8, "severity": "red", "time": "2024-01-02"}, {"title": "x", "latitude": 95, "longitude": 1}, {"title": "old", "lat": 1, "lon": 1, "time": "2001-01-01"}]
    good, bad = events(spark.createDataFrame([(json.dumps(r),) for r in raw], "payload string"), "SRC", F.lit("2024-01-03").cast("timestamp"))
    (g,) = rows(good)
    assert (g["title"], g["lat"], g["severity"], g["category_code"]) == ("Flood", 18.5, "SEVERE", "FLOOD_WATERLOGGING")
    assert {r["reason"] for r in rows(bad)} == {"coordinates", "occurred_at"}


def test_feeds(spark):
    from stormledger.sources import feeds as fe

    names = ["Station", "Basin", "Latitude", "Longitude", "Data Acquisition Time", "River Water Level Telemetry Hourly (meter)"]
    river = spark.createDataFrame([("Kol-1", "Krishna R", "18.5", "73.8", "02-01-2024 05:30", "-"), ("-", "x", "1", "1", "02-01-2024 05:30", "1")], names)
    (r,) = rows(fe.river_levels(river))
    assert (r["station_code"], r["external_id"], r["water_level_m"]) == ("CWC-KRISHNAR-KOL1", "CWC-KRISHNAR-KOL1-202401020000", None)
    news = rows(fe.news_articles(spark.createDataFrame([("http://A.com/x?utm_s=1", "T &amp; U", "A.com", "en", "20240102T030405Z", "")], "url string, title string, domain string, language string, seendate string, excerpt string")))
    assert (news[0]["url"], news[0]["title"], str(news[0]["published_at"])) == ("http://a.com/x", "T & U", "2024-01-02 03:04:05")
    posts = spark.createDataFrame([("https://m.org/1", "<p>" + "a" * 90 + "</p>", "public", "2024-01-02T03:04:05Z"), ("https://m.org/2", "x", "private", None)], "url string, content string, visibility string, created_at string")
    assert [len(x["title"]) for x in rows(fe.social_posts(posts))] == [80]
    xml = "<rss><channel><item><title>A</title><link>http://h/a</link><pubDate>Tue, 02 Jan 2024 03:04:05 GMT</pubDate></item><item><title>B</title><link>http://h/a?utm_x=1</link></item></channel></rss>"
    atom = "<feed><entry><title>C</title><link href='http://h/c'/><updated>2024-01-02T03:04:05Z</updated></entry></feed>"
    assert {(x["title"], x["url"]) for x in rows(fe.syndicated(spark.createDataFrame([("r", xml), ("a", atom)], "feed string, xml string")))} >= {("C", "http://h/c")}
    cap = spark.createDataFrame([("1", "Heavy rain", "orange", "73.8,18.5", None), ("2", "Hail", "red", None, "10,70 12,72"), ("3", "Fog", "red", None, None)], "identifier string, event string, severity_color string, centroid string, polygon string")
    assert {(x["external_id"], x["lat"], x["lon"], x["category_code"]) for x in rows(fe.cap_alerts(cap))} == {("1", 18.5, 73.8, "HEAVY_RAINFALL"), ("2", 11.0, 71.0, "HAILSTORM")}
    docs = [{"features": [{"properties": {"eventid": "7", "eventtype": "FL", "name": "f", "alertlevel": "Red", "country": "Nepal, India", "fromdate": "2024-01-02T00:00:00"}, "geometry": {"coordinates": [80.0, 20.0]}}]}, {"results": [{"id": "8", "eventtype": "TC", "country": "Chile", "latitude": 1.0, "longitude": 2.0}]}]
    (g,) = rows(fe.global_alerts(spark.createDataFrame([(json.dumps(d),) for d in docs], "doc string")))
    assert (g["external_id"], g["lat"], g["severity"], g["category_code"]) == ("GDACS-FL-7", 20.0, "SEVERE", "FLOOD_WATERLOGGING")
    hourly = [("c", 1.0, 2.0, {"time": ["2024-01-01T00:00", "2024-01-01T01:00", "2024-01-01T02:00"], "precipitation": [1.0, 2.0, 3.0], "temperature_2m": [0.0] * 3, "relative_humidity_2m": [0.0] * 3, "wind_speed_10m": [0.0] * 3, "wind_direction_10m": [0.0] * 3, "surface_pressure": [0.0] * 3})]
    h = spark.createDataFrame(hourly, "city string, lat double, lon double, hourly struct<time:array<string>,precipitation:array<double>,temperature_2m:array<double>,relative_humidity_2m:array<double>,wind_speed_10m:array<double>,wind_direction_10m:array<double>,surface_pressure:array<double>>")
    assert rows(fe.hourly_model(h, F.lit("2024-01-01 01:30:00").cast("timestamp")))[0]["precipitation"] == 2.0
    assert set(fe.FEEDS) >= {"CWC", "GDELT", "MASTODON", "RSS", "NDMA", "GDACS", "IMD", "OPEN_METEO"}


def test_exports(spark, tmp_path):
    from stormledger.plans.domain import incidents
    from stormledger.sources import exports

    df = incidents(spark, "/root/testdata/sf0.001")
    exports.write_csv(df, str(tmp_path / "csv"), 100)
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.count() == 100 and back.columns[0] == "id"
    with pytest.raises(ValueError, match="50000"):
        exports.csv_rows(df, 0)
    f = json.loads(exports.geojson_features(df).first()["feature"])
    assert f["geometry"]["type"] == "Point" and len(f["geometry"]["coordinates"]) == 2


def test_fixed_places_print_like_python(spark):
    import random

    from stormledger.functions.rounding import fixed_places

    rng = random.Random(3)
    values = [0.345, 0.415, 0.125, 2.5, 0.5, 1.5, 0.0000005, 0.0000015, -0.345, -1.005, 179.9999995, 0.0] + [rng.randrange(10**7) / 10**7 for _ in range(300)] + [rng.randrange(1000) / 1000 for _ in range(300)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", *(fixed_places(F.col("v"), n).alias(f"p{n}") for n in (0, 2, 6))).collect()
    clean = lambda t: t.lstrip("-") if float(t) == 0 else t  # noqa: E731 (a negative zero)
    for r in got:
        assert [clean(r[f"p{n}"]) for n in (0, 2, 6)] == [clean(f"{r['v']:.{n}f}") for n in (0, 2, 6)], r["v"]


# --- percentiles, vectors, advisories, fingerprints


def test_percentiles_against_numpy(spark):
    import random

    import numpy as np

    from stormledger.operators.percentiles import percentiles

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.5, rng.random() * 100])) for _ in range(500)] + [("one", 7.0), ("none", None)] + [("hot", float(i % 3)) for i in range(3000)]
    got = {r["k"]: (r["lo"], r["p"], r["hi"]) for r in percentiles(spark.createDataFrame(rows, "k string, v double").repartition(3), ["k"], "v", {"lo": 0.0, "p": 0.37, "hi": 1.0}).collect()}
    for key in {k for k, _ in rows}:
        values = [v for k, v in rows if k == key and v is not None]
        assert (key in got) == bool(values)
        if values:
            assert got[key] == pytest.approx(tuple(np.percentile(values, [0, 37, 100])))


def test_nearest_vectors_against_brute_force(spark, monkeypatch):
    import numpy as np

    from stormledger.operators import vectors as ve

    rng = np.random.default_rng(2)
    monkeypatch.setattr(ve, "BLOCK", 16)
    data = {i: rng.integers(-2, 3, 4).astype(float).tolist() for i in range(150)} | {900: [0.0] * 4, 901: None, 902: [1.0, 2.0]}
    rows = spark.createDataFrame(list(data.items()), "id long, vector array<double>").repartition(4)
    got = {}
    for r in ve.nearest(rows.where("id % 20 = 0"), rows, 5).collect():
        got.setdefault(r["a"], []).append((-r["similarity"], r["b"]))
    flat = {i: np.array(v) for i, v in data.items() if v is not None}
    for a in (i for i in flat if i % 20 == 0):
        want = []
        for b, y in flat.items():
            n = np.linalg.norm(flat[a]) * np.linalg.norm(y) if len(y) == len(flat[a]) else 0
            if b != a and n:
                c = float(flat[a] @ y / n)
                want.append((-np.sign(c) * np.floor(abs(c) * 1000 + 0.5) / 1000, b))
        assert sorted(got.get(a, [])) == sorted(want)[:5]


def test_advisories_take_three_formats(spark):
    from stormledger.operators import details as de

    ends = ["Tue Jan 02 05:30:00 IST 2024", "2024-01-02T05:30:00+0530", "2024-01-02T00:00:00Z", "2024-01-02T05:30:00+05:30", "2024", "2024-01-02", "2024-01-02 00:00:00", "Xyz Jan 02 05:30:00 IST 2024", None, ""]
    rows = spark.createDataFrame([(i, "S", f"t{i}", None, e) for i, e in enumerate(ends)], "id long, source_code string, title string, hazard string, end_text string")
    got = {r["id"]: (r["hazard"], str(r["valid_until"])) for r in de.advisories(rows).withColumn("valid_until", F.date_format("valid_until", "yyyy-MM-dd HH:mm")).collect()}
    assert got == {i: ("OTHER", "2024-01-02 00:00") for i in range(4)}


def test_fingerprint_rounds_and_sorts(spark):
    from stormledger.operators import details as de

    rows = spark.createDataFrame([(1, 1.00001, "x"), (2, 1.00002, "x"), (3, 1.001, "x"), (4, None, "x")], "id long, lat double, status string")
    f = {r["id"]: r["f"] for r in rows.select("id", de.fingerprint(rows, ["status", "lat"]).alias("f")).collect()}
    g = {r["id"]: r["f"] for r in rows.select("id", de.fingerprint(rows, ["lat", "status"]).alias("f")).collect()}
    assert f == g and f[1] == f[2] != f[3] and len(set(f.values())) == 3
