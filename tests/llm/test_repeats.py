"""Archives, toxicity and repeated passages against brute-force versions."""

import base64
import gzip
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string"


# --- suffix arrays


def test_suffix_array_is_exact():
    from stormledger.llm.suffix import suffix_array

    rng = random.Random(1)
    for _ in range(1500):
        s = [rng.randrange(1, rng.choice([2, 3, 6]) + 1) for _ in range(rng.randrange(40))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


# --- repeated windows


def brute_ranges(texts, width):
    """texts: {id: sequence}; the units of each that an earlier window covers."""
    first = {}
    covered = {i: [False] * len(t) for i, t in texts.items()}
    for i in sorted(texts):
        for p in range(len(texts[i]) - width + 1):
            w = texts[i][p : p + width]
            w = w if isinstance(w, bytes) else tuple(w)
            if w in first:
                covered[i][p : p + width] = [True] * width
            else:
                first[w] = (i, p)
    return covered


def check_words(docs, width, texts):
    from stormledger.llm import substring

    words = {i: WORD.findall(t or "") for i, t in texts.items()}
    covered = brute_ranges(words, width)
    got = {r["doc_id"]: r for r in substring.drop_repeated_windows(docs, width).collect()}
    assert got.keys() == texts.keys()
    for i, w in words.items():
        kept = " ".join(x for x, c in zip(w, covered[i], strict=True) if not c)
        assert (got[i]["n_words"], got[i]["n_removed"]) == (len(w), sum(covered[i])), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept.encode()).hexdigest() and got[i]["kept"] == kept


def check_bytes(docs, width, texts):
    from stormledger.llm import suffix

    raw = {i: (t or "").encode() for i, t in texts.items()}
    covered = brute_ranges(raw, width)
    got = {r["doc_id"]: r for r in suffix.drop_repeated_bytes(docs, width).collect()}
    assert got.keys() == texts.keys()
    for i, b in raw.items():
        kept = bytes(x for x, c in zip(b, covered[i], strict=True) if not c)
        spans = sum(c and not (k and covered[i][k - 1]) for k, c in enumerate(covered[i]))
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"]) == (len(b), sum(covered[i]), spans), i
        assert got[i]["kept_sha256"] == hashlib.sha256(kept).hexdigest()


def patchwork(rng, n, letters, sep):
    passages = [sep.join(rng.choice(letters) for _ in range(rng.randrange(1, 60))) for _ in range(12)]
    texts = {}
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.6 else sep.join(rng.choice(letters) for _ in range(rng.randrange(0, 50))) for _ in range(rng.randrange(0, 6))]
        texts[3 * i] = sep.join(parts) if rng.random() < 0.9 else None
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_repeats_of_made_texts(spark, seed, monkeypatch):
    from stormledger.llm import repeats

    rng = random.Random(seed)
    words = patchwork(rng, 120, [f"w{k}" for k in range(40)] + ["é", "a"], " ")
    words |= {1000: "loop " * 400, 1001: " \n ", 1002: "", 1003: "loop " * 30 + "end"}
    for name in ("SCAN", "CHUNK", "RESOLVE"):
        monkeypatch.setattr(repeats, name, 3000)
    docs = spark.createDataFrame(list(words.items()), SCHEMA).repartition(5)
    check_words(docs, 20, words)
    check_words(docs, 5, words)
    text = patchwork(rng, 120, list("abcdé "), "")
    text |= {1000: "ab" * 700, 1001: "x" * 500, 1002: ""}
    docs = spark.createDataFrame(list(text.items()), SCHEMA).repartition(5)
    check_bytes(docs, 40, text)


def test_repeats_of_real_texts(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    check_words(docs, 20, texts)
    check_bytes(docs, 100, texts)


def test_repeats_of_odd_rows(spark):
    from stormledger.llm import substring, suffix

    same = " ".join(f"word{k}" for k in range(50))
    docs = spark.createDataFrame([(7, same), (7, same), (9, same), (None, same), (None, None)], SCHEMA)
    got = sorted((r["doc_id"] is None, r["doc_id"], r["n_words"], r["n_removed"]) for r in substring.drop_repeated_windows(docs).collect() if r["n_words"])
    assert got == [(False, 7, 50, 0), (False, 7, 50, 0), (False, 9, 50, 50), (True, None, 50, 50)]
    n = len(same)
    assert sorted(r["n_removed"] for r in suffix.drop_repeated_bytes(docs).collect()) == [0, 0, 0, n, n]
    assert substring.drop_repeated_windows(docs.limit(0)).count() == 0 and suffix.drop_repeated_bytes(docs.limit(0)).count() == 0


# --- archives


def test_warc_round_trip(spark):
    from stormledger.llm import warc

    rows = [(i, f"http://h/{i}", f"<p>{i % 7} é</p>" * (i % 5)) for i in range(60)] + [(60, None, None), (61, "a\r\nb", "WARC/1.1\r\n\r\n\r\n"), (None, "u", "x"), (62, "u", "x" * 300_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    raw = {i: (h or "").encode() for i, _, h in rows}
    top = {}
    for i, h in raw.items():
        if i is not None:
            top[h] = max(top.get(h, -1), i)
    got = {r["page_id"]: r for r in warc.round_trip(pages).collect()}
    assert got.keys() == raw.keys()
    for i, h in raw.items():
        lead = top.get(h)
        revisit = lead is not None and lead != i
        assert (got[i]["payload_bytes"], got[i]["payload_digest"]) == (len(h), base64.b32encode(hashlib.sha1(h).digest()).decode())
        assert (got[i]["record_type"], got[i]["refers_to"]) == (("revisit", lead) if revisit else ("response", None)), i
    assert all(r["record_type"] == "response" for r in warc.round_trip(pages, 1 << 30).collect())
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_normaliser(spark):
    from stormledger.llm import warc

    records = [warc.make_record(i, f"http://h/{i}", b"payload %d " % i * (i * 50), None) for i in range(20)]
    mono = gzip.compress(b"".join(records))
    each = b"".join(gzip.compress(r) for r in records)
    made = spark.createDataFrame([("mono", bytearray(mono)), ("each", bytearray(each)), ("empty", bytearray()), ("null", None)], "archive string, data binary")
    norm = warc.normalise(made)
    for r in norm.collect():
        assert len(r["index"]) == (20 if r["archive"] in ("mono", "each") else 0)
        for x, want in zip(r["index"], records, strict=False):
            assert gzip.decompress(bytes(r["data"][x["offset"] : x["offset"] + x["length"]])) == want
        assert gzip.decompress(bytes(r["data"])) == (b"".join(records) if r["index"] else b"")
    assert warc.sidecar(norm).count() == 40
    assert {bytes(r["payload"]) for r in warc.read_records(norm, warc.sidecar(norm)).collect()} == {b"payload %d " % i * (i * 50) for i in range(20)}
    some = warc.sidecar(norm).where("n = 3")
    assert {bytes(r["payload"]) for r in warc.read_records(norm, some).collect()} == {b"payload 3 " * 150}
    for data in (mono, each, each + b"\0" * 70):
        for chunk in (7, 64, 1 << 18):
            assert b"".join(warc.inflate(data, chunk)) == b"".join(records)
    with pytest.raises(ValueError, match="ends inside"):
        list(warc.split_records(warc.inflate(mono[:-40])))


def test_warc_repeated_pages(spark):
    from stormledger.llm import warc

    rows = [(7, "u", "same"), (7, "u", "same"), (3, "v", "same"), (None, "w", "same"), (9, "x", None), (9, "y", ""), (4, "z", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)).withColumn("payload", F.lit("clash"))
    got = sorted((r["page_id"] or -1, r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect())
    assert got == [(-1, "revisit", 7), (3, "revisit", 7), (4, "response", None), (7, "response", None), (7, "response", None), (9, "response", None), (9, "response", None)]


# --- toxicity


def test_maximal_segments():
    from stormledger.llm.toxicity import maximal_segments

    def brute(s):
        """Ruzzo and Tompa's definition: split off the best segment (shortest, leftmost) and go on beside it."""
        best = None
        for a in range(len(s)):
            for b in range(a, len(s)):
                v = sum(s[a : b + 1])
                if v > 0 and (best is None or v > best[0] or (v == best[0] and b - a < best[2] - best[1])):
                    best = (v, a, b)
        if best is None:
            return []
        v, a, b = best
        return brute(s[:a]) + [(a, b, v)] + [(x + b + 1, y + b + 1, w) for x, y, w in brute(s[b + 1 :])]

    rng = random.Random(3)
    for _ in range(400):
        s = [rng.choice([-1, -1, 2, 3.5, -2.25, 4.75]) for _ in range(rng.randrange(14))]
        got = maximal_segments([(i, x) for i, x in enumerate(s) if x != -1], 1.0)
        assert got == [(a, b, v) for a, b, v in brute(s)], s


def test_toxicity(spark):
    import zlib

    from stormledger.llm import toxicity

    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, labels).collect()}
    assert len(got) == docs.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for i, r in got.items())
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.93
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "\n"), (None, "idiot " * 50_000)], SCHEMA)
    assert all(0 <= r["score"] <= 1 for r in toxicity.score_toxicity(odd, labels).collect())
    assert {r["score"] for r in toxicity.score_toxicity(odd, labels.limit(0)).collect()} == {0.5}
