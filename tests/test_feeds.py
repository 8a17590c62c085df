"""The feed source: documents of all kinds, batches and streams, and nothing lost between accepted and quarantined records."""

import json

import pytest
from pyspark.sql import functions as F

from stormledger.sources import feeds as fe
from stormledger.sources.reader import _Folder, read_documents, records, register

RSS = '<rss xmlns:x="http://x/"><channel><title>c</title>%s</channel></rss>'


def item(title="T", link="http://h/a", more=""):
    return f"<item><title>{title}</title><link>{link}</link>{more}</item>"


def test_records():
    one = lambda body: list(records("f", body))
    assert one("") == one("  \n") == []
    assert [r[4] for r in one("<rss><channel>")] == ["malformed"]
    assert [r[4] for r in one('<!DOCTYPE a [<!ENTITY b "c">]><rss/>')] == ["document type"]
    assert [r[4] for r in one('[{"a":1}, 2]')] == [None, "malformed"] and one("{bad")[0][4] == "malformed"
    assert one('<?xml version="1.0" encoding="nonsense"?><rss/>')[0][4] == "malformed"
    assert [json.loads(r[3])["title"] for r in one(RSS % (item("A &amp; B") + item("<![CDATA[C <b>d</b>]]>")))] == ["A & B", "C <b>d</b>"]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>E <i>f</i></title><link href="http://h/e"/></entry></feed>'
    assert json.loads(one(atom)[0][3]) == {"title": "E f", "link": "http://h/e"}
    cap = "<alert xmlns='urn:c'><identifier>7</identifier><info><event>Hail</event><area><polygon>1,2 3,4</polygon></area></info><info><event>Fog</event></info></alert>"
    assert json.loads(one(cap)[0][3]) == {"identifier": "7", "event": "Hail", "polygon": "1,2 3,4"}
    assert [json.loads(r[3]) for r in one('{"nowcastDetails":[{"id":1}]}')] == [{"id": 1}] and one("<other/>") == []


def test_batch_and_quarantine(spark, tmp_path):
    (tmp_path / "b").mkdir()
    (tmp_path / "a.xml").write_text(RSS % (item() + item("", "http://h/b") + item("X", "") + item("U", "http://h/c", "<guid>g</guid>") + item("G", "", "<guid>http://h/g</guid>")))
    (tmp_path / "b" / "c.xml").write_text(RSS % (item("Again", "http://H/a?utm_source=1") + item("L", "http://h/l")))
    (tmp_path / "d.xml").write_text("<rss>")
    (tmp_path / "_hidden").write_text("<rss>")
    (tmp_path / "empty.xml").write_text("")
    register(spark)
    raw = spark.read.format("hazard_feed").option("bytesPerPartition", 100).load(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 1
    good, bad = fe.syndicated(raw), fe.syndicated(raw, rejected=True)
    assert {r["title"] for r in good.collect()} == {"T", "U", "G", "L"}
    assert sorted((r["feed"], r["reason"]) for r in bad.collect()) == [("a.xml", "link"), ("a.xml", "title"), ("b/c.xml", "duplicate"), ("d.xml", "malformed")]
    assert good.count() + bad.count() == raw.count() == 8
    assert {r["title"] for r in fe.syndicated(raw, most=1).collect()} == {"T"} and fe.syndicated(raw, most=1, rejected=True).count() == 7
    table = spark.createDataFrame([("a", RSS % item()), ("n", None)], "feed string, xml string")
    assert [r["title"] for r in fe.syndicated(table).collect()] == ["T"] and read_documents(table.limit(0)).count() == 0
    with pytest.raises(ValueError):
        _Folder({})


def test_alerts(spark):
    docs = [
        {"identifier": "a/1", "event": "Heavy rain", "location": {"type": "Point", "coordinates": [73.5, 18.5]}, "sent": "2024-01-02T00:00:00Z", "instruction": "Stay in"},
        {"event": "Hail", "areaDesc": "Pune", "lat": "18", "long": "73", "effective": "2024-01-02T00:00:00Z"},
        {"event": "Fog", "circle": "18.5,73.8 20", "severity_color": "red", "sent": "2024-01-02T00:00:00Z"},
        {"event": "Fog", "centroid": "x,y"},
        {"event": "Fog", "centroid": [18.5, 73.5], "sent": "1999-01-01"},
    ]
    raw = read_documents(spark.createDataFrame([("j", json.dumps({"data": docs})), ("x", "<alert>")], "feed string, xml string"))
    good, bad = fe.alerts(raw, F.lit("2024-01-03").cast("timestamp"))
    got = {r["external_id"]: r for r in good.collect()}
    assert {(k, r["lat"], r["lon"]) for k, r in got.items()} == {("NDMA-a_1", 18.5, 73.5), ("NDMA-PUNE-2024_01_02T00_00_00Z-HAIL", 18.0, 73.0), ("NDMA-NATIONAL-2024_01_02T00_00_00Z-FOG", 18.5, 73.8)}
    assert got["NDMA-a_1"]["description"] == "Stay in" and got["NDMA-NATIONAL-2024_01_02T00_00_00Z-FOG"]["severity"] == "SEVERE"
    assert got["NDMA-PUNE-2024_01_02T00_00_00Z-HAIL"]["title"] == "NDMA SACHET: Hail in Pune"
    assert sorted((r["feed"], r["position"], r["reason"]) for r in bad.collect()) == [("j", 3, "coordinates"), ("j", 4, "occurred_at"), ("x", 0, "malformed")]


def test_stream_resumes(spark, tmp_path):
    from stormledger.streaming.jobs import run_batches

    register(spark)
    seen, at = [], tmp_path / "in"
    at.mkdir()
    go = lambda: run_batches(spark.readStream.format("hazard_feed").load(str(at)), lambda b, i: seen.append(sorted(r["feed"] for r in b.collect())), str(tmp_path / "checkpoint"))
    (at / "z.xml").write_text(RSS % item())
    go()
    (at / "a.xml").write_text(RSS % (item() + item("B")))
    go()
    go()
    assert [s for s in seen if s] == [["z.xml"], ["a.xml", "a.xml"]]


def test_records_of_rows_are_accepted_or_rejected(spark):
    river = spark.createDataFrame([("K", "1", "1", "02-01-2024 05:30"), (None, "1", "1", "02-01-2024 05:30"), ("K", None, "1", "02-01-2024 05:30"), ("K", "1", "1", None)], "Station string, Latitude string, Longitude string, `Data Acquisition Time` string")
    assert fe.river_levels(river).count() == 1
    bad = fe.river_levels(river, rejected=True).collect()
    assert sorted(r["reason"] for r in bad) == ["coordinates", "observed_at", "station"] and {r["source_code"] for r in bad} == {"CWC"}
    assert json.loads(next(r["payload"] for r in bad if r["reason"] == "coordinates")) == {"Station": "K", "Longitude": "1", "Data Acquisition Time": "02-01-2024 05:30"}
    posts = spark.createDataFrame([("http://a/1", "x", "public", [("t",), ("",), (None,)]), ("http://a/2", "x", None, None)], "url string, content string, visibility string, tags array<struct<name:string>>")
    (p,) = fe.social_posts(posts).collect()
    assert (p["tags"], p["media"], p["language"]) == (["t"], [], "English")
    assert [r["reason"] for r in fe.social_posts(posts, rejected=True).collect()] == ["visibility"]
    news = spark.createDataFrame([(None, "t"), ("http://a/3", "t")], "url string, title string")
    assert (fe.news_articles(news).count(), fe.news_articles(news, rejected=True).count()) == (1, 1)
    met = spark.createDataFrame([("d", None), ("e", "18")], "district string, latitude string").withColumn("longitude", F.lit("73"))
    assert (fe.met_warnings(met).count(), fe.met_warnings(met, rejected=True).count()) == (1, 1)
    assert fe.river_levels(river.limit(0)).count() == fe.river_levels(river.limit(0), rejected=True).count() == 0
