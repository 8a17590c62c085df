"""Whole operators against brute-force versions, with repeated rows, null ids, empty tables and clashing names."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm.test_corpus import ODD, SCHEMA, WORD, base_spans, brute_fp, brute_groups, frame, rows_of

SF = "/root/testdata/sf0.001"


# --- fingerprints


def test_fingerprints_of_repeated_rows(spark):
    from stormledger.llm import fingerprints

    rng = random.Random(1)
    rows = [(None if i % 9 == 0 else i // 3, f"{rng.choice('abc')} text {i % 4} of words") for i in range(120)] + [(5, "same")] * 7 + [(None, "same")] * 3 + [(77, None), (77, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("r", F.lit("clash")).withColumn("links", F.lit("clash"))
    for per_range in (4, 1024):
        spark.conf.set("spark.sql.shuffle.partitions", "8" if per_range == 4 else "4")
        follows = fingerprints.with_next(docs, per_range).collect()
        got = fingerprints.fingerprint_report(docs, per_range).collect()
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert len(got) == len(rows) == len(follows)
        assert Counter((r["doc_id"], r["text"]) for r in follows) == Counter((i, t or "") for i, t in rows)
        # One cycle through all rows: each row is the next of exactly one, ids falling, null ids last.
        assert Counter((r["doc_id"], r["text"]) for r in follows) == Counter((r["next_id"], r["next_text"]) for r in follows)
        line = sorted(follows, key=lambda r: (r["r"], r["i"]))
        ids = [r["doc_id"] for r in line]
        assert ids == sorted(ids, key=lambda i: (i is None, -(i or 0)))
        assert [(r["next_id"], r["next_text"]) for r in line] == [(r["doc_id"], r["text"]) for r in line[1:] + line[:1]]
    assert fingerprints.fingerprint_report(docs.limit(0)).count() == 0


@pytest.mark.parametrize("small", [2, 64])
def test_links_are_counted(spark, small):
    from stormledger.llm import fingerprints
    from stormledger.llm.simhash import signed

    rng = random.Random(4)
    base = [rng.getrandbits(64) for _ in range(4)]
    fps = []
    for i in range(260):
        x = base[i % 4]
        for _ in range(rng.randrange(5)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps += fps[:20] + [0]
    got = fingerprints.near_fingerprints(spark.createDataFrame([(i, signed(x)) for i, x in enumerate(fps)], "doc_id long, fp long"), small).collect()
    for r in got:
        x = fps[r["doc_id"]]
        assert r["class_id"] == fps.index(x)
        assert r["links"] == sum(y != x and (x ^ y).bit_count() <= 2 for y in set(fps))
    assert len(got) == len(fps)


# --- near duplicates


def test_near_duplicates_of_repeated_rows(spark):
    from stormledger.llm import neardup

    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (3, "x y z"), (None, "a b c d"), (None, "lone"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fp", F.lit("clash"))
    got = Counter((r["doc_id"], r["component_id"]) for r in neardup.near_groups(neardup.text_fingerprints(docs), 2).collect())
    assert got == Counter([(1, 1), (1, 1), (2, 1), (3, 3), (None, 1), (None, None), (4, 4), (5, 4)])
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(docs).collect()) == [0, 0, 1, 1, 3, 4]
    assert neardup.near_groups(neardup.text_fingerprints(docs.limit(0)), 2).count() == 0


# --- personal data


def test_pii_context_decides(spark):
    from stormledger.llm import pii

    token = "0123456789abcdef" * 2
    texts = [f"the token = {token} here", f"the commit {token} here", "call 415-555-0123 now", "part 415-555-0123 now", "part (415) 555-0123 now", "mail a@b.de", "zz a@b.de", None, "", "\U0001f600 " * 3000 + "a@b.de " * 3]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("pii_spans", F.lit("clash"))
    got = {r["doc_id"]: [(s["kind"], s["score"]) for s in r["pii_spans"]] for r in pii.detect(docs).collect()}
    assert got[0] == [("secret", 0.5)] and got[1] == []
    assert got[2] == [("tel", 0.7)] and got[3] == [] and got[4] == [("tel", 0.5)]
    assert got[5] == [("email", 1.0)] and got[6] == [("email", 0.7)] and got[7] == got[8] == [] and len(got[9]) == 3
    twice = docs.unionByName(docs)
    assert pii.detect(twice).count() == 2 * len(texts) and pii.detect(docs.limit(0)).count() == pii.redact(docs.limit(0)).count() == 0
    assert {r["pii_spans"] for r in pii.redact(docs).collect()} == {"clash"}


def test_pii_of_long_texts(spark):
    from stormledger.llm import pii

    rng = random.Random(6)
    text = "".join(rng.choice(["word ", "\U0001f600", "a@b.cd ", "1.2.3.4 ", "999.1.1.1 ", "+49 30 1234567 ", "x" * 700, "4111 1111 1111 1111 ", "\n"]) for _ in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = pii.detect(docs).first()["pii_spans"]
    assert [(s["start"], s["rank"], s["end"], s["kind"]) for s in found if s["kind"] in pii.BASE] == base_spans(text)
    want, at = [], 0
    for s in found:
        if s["start"] >= at:
            want += [text[at : s["start"]], f"[{s['kind'].upper()}]"]
        at = max(at, s["end"])
    assert pii.redact(docs).first()["text"] == "".join([*want, text[at:]])


# --- mixing


def test_mixing_of_repeated_rows(spark):
    from stormledger.llm import mixing

    rows = [(1, "a b c d e", "en", s, 9) for s in ("p", "p", "q", "r", None)] + [(None, " ".join("w" * k), "en", "q", k) for k in (1, 2, 2, 30)] + [(3, t, "en", "p", 0) for t in (None, "", "solo")]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("positions", F.lit("clash")).withColumn("mix_position", F.lit("clash"))
    plan = rows_of(mixing.plan_mix(docs))
    assert len(plan) == len(rows)
    words = defaultdict(int)
    for r in plan:
        words[r["source"]] += r["taken"]
    mixed = rows_of(mixing.mix(docs))
    got = defaultdict(int)
    for r in mixed:
        got[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert got == {s: n for s, n in words.items() if n}
    places = [r["mix_position"] for r in mixed]
    assert places == sorted(places) and all(0 <= p <= sum(len(WORD.findall(r[1] or "")) for r in rows) + 1e-6 for p in places)
    assert mixing.plan_mix(docs.limit(0)).count() == mixing.mix(docs.limit(0)).count() == 0


def test_positions_are_cumulative_demand(spark):
    """A source whose tokens come early, level or late: at its k-th token the tokens of all sources up to then have been asked for."""
    from stormledger.llm import mixing

    docs = frame(spark, ["w"] * 3000, [f"s{i % 3}" for i in range(3000)])
    plan = rows_of(mixing.plan_mix(docs))
    total = sum(r["taken"] for r in plan)
    demand = {r["source"]: r["target"] for r in plan}
    places = sorted((p, r["source"]) for r in plan for p in r["positions"])
    assert len(places) == total
    # The k-th token of the mix stands near position k, as positions count the demand of all sources.
    assert max(abs(p - k) for k, (p, _) in enumerate(places)) < 0.02 * total
    early = {s: sum(x == s for _, x in places[: total // 2]) / demand[s] for s in demand}
    assert early["s0"] > early["s1"] > early["s2"]


# --- quality


def brute_statistics(t):
    t = t or ""
    b = t.encode()
    n, w, lines = max(1, len(t)), b.split(), b.split(b"\n")
    marks = ["#$%&*@^~=<>{}[]\\", "|_/+", "!?", ".,;:", "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    sizes = [math.log1p(n), math.log1p(n / max(1, len(w))), math.log1p(n / len(lines))]
    return sizes + [math.sqrt(sum(t.count(c) for c in m) / n) for m in marks] + [math.sqrt(len(set(w)) / max(1, len(w))), math.sqrt(len(set(lines)) / len(lines))]


def brute_quality(docs, labels):
    """Scores of (doc_id, text) rows by explicit densities with inverted covariances."""
    import zlib

    x = np.array([brute_statistics(t) for _, t in docs])
    held = np.array([zlib.crc32(str("" if i is None else i).encode()) % 4 == 2 for i, _ in docs])
    y = np.array([labels.get(i, -1) for i, _ in docs])
    means, covs, n = [], [], []
    for c in (0, 1):
        rows = x[(y == c) & ~held]
        means.append(rows.mean(0))
        covs.append(np.cov(rows.T, bias=True))
        n.append(len(rows))
    pooled = np.diag(sum(k * c for k, c in zip(n, covs, strict=True)) / sum(n)) + 1e-4
    density = []
    for c in (0, 1):
        s = 0.9 * covs[c] + 0.1 * np.diag(pooled) + 1e-6 * np.eye(x.shape[1])
        z = x - means[c]
        density.append(math.log((n[c] + 1) / (sum(n) + 2)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * np.einsum("ij,jk,ik->i", z, np.linalg.inv(s), z))
    return held, 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def test_quality_against_densities(spark):
    from stormledger.llm import quality

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    odd = [(None, "no id"), (None, None), (10**9, ""), (10**9, ""), (10**9 + 1, "word " * 5000)]
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame(odd, "doc_id long, text string")).withColumn("f_chars", F.lit("clash")).withColumn("score", F.lit("clash"))
    listed = [(r["doc_id"], r["text"]) for r in rows.collect()]
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held, want = brute_quality(listed, truth)
    wanted = Counter((i, bool(h), round(float(s), 4)) for (i, _), h, s in zip(listed, held, want, strict=True))
    got = Counter((r["doc_id"], r["held_out"], round(r["score"], 4)) for r in quality.score_quality(rows, labels).collect())
    assert sum((wanted - got).values()) <= 2  # roundings
    assert quality.score_quality(rows.limit(0), labels).count() == quality.keep_good(docs.limit(0), labels).count() == 0


# --- toxicity


def test_toxicity_against_counts(spark):
    from stormledger.llm import toxicity as tx

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    train = F.crc32(F.col("doc_id").cast("string")) % 5 != 0
    model = tx.fit(docs, labels, "toxic", train)
    rows = docs.join(labels.where("toxic in (0, 1)"), "doc_id").where(train).select("text", "toxic", (F.pmod(F.xxhash64(F.lit(5), "doc_id"), F.lit(5)) == 0).alias("held")).collect()
    n = [Counter(), Counter()]
    for r in rows:
        if not r["held"]:
            n[r["toxic"]].update(set(tx.tokens(r["text"].encode())))
    s = [sum(c.values()) for c in n]
    lexicon = {}
    for w in n[0] | n[1]:
        a = tx.PRIOR_EACH + tx.PRIOR_ROWS * (n[0][w] + n[1][w]) / sum(s)
        y = [n[k][w] + a for k in (0, 1)]
        odds = math.log(y[1] / (s[1] + tx.PRIOR_ROWS - y[1])) - math.log(y[0] / (s[0] + tx.PRIOR_ROWS - y[0]))
        if abs(odds / math.sqrt(1 / y[0] + 1 / y[1])) >= tx.LEAST_Z:
            lexicon[w] = odds
    assert model.lexicon.keys() == lexicon.keys() and all(abs(model.lexicon[w] - x) < 1e-9 for w, x in lexicon.items())
    scored = tx.score_toxicity(docs, labels).collect()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in scored[::7]:
        m, found = tx.segments_of(lexicon, model.gap, (texts[r["doc_id"]] or "").encode())
        strength = [-math.log(max(-math.expm1(-model.k * m * math.exp(-model.lam * x)), 1e-300)) for *_, x in found]
        best, total = max(strength, default=0.0), sum(x for x in strength if x >= -math.log(tx.SIGNIFICANT))
        z = model.weights[0] + model.weights[1] * math.log1p(best) + model.weights[2] * math.log1p(max(best, total))
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
    twice = docs.limit(5).unionByName(docs.limit(5)).withColumn("passages", F.lit("clash"))
    assert tx.score_toxicity(twice, labels).count() == 10 and tx.score_toxicity(docs.limit(0), labels).count() == 0


def test_extreme_values_are_fitted():
    from stormledger.llm.toxicity import K, LAMBDA, fit_extremes

    rng = np.random.default_rng(3)
    m = rng.integers(20, 2000, 4000).astype(float)
    for k, lam in ((0.1, 1.0), (0.02, 0.4)):
        best = (np.log(k * m) - np.log(-np.log(rng.random(4000)))) / lam
        got = fit_extremes(m, np.where(best > 1, best, 0.0))
        assert abs(math.log(got[0] / k)) < 0.25 and abs(got[1] - lam) < 0.1 * lam
    assert fit_extremes(m[:5], m[:5]) == (K, LAMBDA)


# --- decontamination


def brute_leaks(docs, items, threshold=0.6, overlap=0.5):
    """Every passage against every item, without an index."""
    from stormledger.llm.decontaminate import terms

    parts = {}
    for i, text in items:
        w = text.split()
        cut = max(0, len(w) - max(3, math.ceil(len(w) / 4)))
        parts[i] = [terms(" ".join(x).encode()) for x in (w[:cut], w[cut:])]
    words = {i: q + a for i, (q, a) in parts.items() if q + a}
    df = Counter(t for w in words.values() for t in set(w))
    mean, longest = sum(map(len, words.values())) / max(1, len(words)), max(map(len, words.values()), default=1)
    weight = {}
    for i, w in words.items():
        weight[i] = {t: math.log(1 + (len(words) - df[t] + 0.5) / (df[t] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}

    def grams(w, n):
        n = min(n, len(w))
        return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if n else set()

    out = {}
    for d, text in docs:
        w = terms((text or "").encode())
        for s in range(0, len(w), longest):
            passage = w[s : s + 2 * longest]
            if s and len(w) - s <= longest:
                break
            have = set(passage)
            for i, x in weight.items():
                score = sum(v for t, v in x.items() if t in have) / sum(x.values())
                if score >= threshold:
                    share = [len(grams(p, g) & grams(passage, min(g, len(p)))) / len(grams(p, g)) if p else 1.0 for p, g in zip(parts[i], (5, 3), strict=True)]
                    if min(share) >= overlap:
                        out[d, i] = max(out.get((d, i), 0.0), score)
    return out


@pytest.mark.parametrize("blocks", [1, 7])
def test_decontamination_against_every_passage(spark, blocks, monkeypatch):
    from stormledger.llm import decontaminate as d

    docs, items = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    if blocks > 1:
        monkeypatch.setattr(d, "ITEMS_PER_INDEX", items.count() // blocks)
        monkeypatch.setattr(d, "BROADCAST_BYTES", 1 << 14)
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, docs.first()["text"]), (-2, docs.first()["text"])], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra).withColumn("item_id", F.lit("clash")).withColumn("block", F.lit("clash"))
    want = brute_leaks([(r["doc_id"], r["text"]) for r in rows.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    got = {(r["doc_id"], r["item_id"]): r["score"] for r in d.find_leaks(rows, items).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
    assert d.find_leaks(rows.limit(0), items).count() == 0


# --- pipeline


def test_pipeline_against_its_parts(spark, tmp_path):
    """Each stage's rows from brute-force versions of its operator, over documents with odd and repeated rows."""
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = frame(spark, ODD).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "lang", "source", "n_chars")
    nameless = odd.where(f"doc_id < {10**6 + 6}").withColumn("doc_id", F.lit(None).cast("long"))
    every = docs.select(*odd.columns).unionByName(odd).unionByName(odd.where(f"doc_id = {10**6 + 4}")).unionByName(nameless)
    every.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    now = [tuple(r) for r in every.collect()]
    _, score = brute_quality([(r[0], r[1]) for r in now], labels)
    now = [r for r, s in zip(now, score, strict=True) if s >= 0.7]
    fps = [brute_fp(r[1]) for r in now]
    named = brute_groups({x: x for x in set(fps)}, 4)
    lead = {}
    for r, x in zip(now, fps, strict=True):
        if r[0] is not None:
            lead[named[x]] = min(lead.get(named[x], r[0]), r[0])
    now = [r for r, x in zip(now, fps, strict=True) if r[0] is None or r[0] == lead[named[x]]]
    leaks = {d for d, _ in brute_leaks([(r[0], r[1]) for r in now], items)}
    now = [r for r in now if r[0] is None or r[0] not in leaks]
    out = p.run(spark, str(tmp_path))
    got = rows_of(out)
    placed = [r["mix_position"] for r in got]
    assert placed == sorted(placed) and out.columns == [*odd.columns, "mix_position"]
    assert {r["doc_id"] for r in got} <= {r[0] for r in now}
    size = defaultdict(int)
    for r in now:
        size[r[3]] += len(WORD.findall(r[1] or ""))
    taken, copies = defaultdict(int), Counter(r["doc_id"] for r in got)
    for r in got:
        taken[r["source"]] += len(WORD.findall(r["text"]))
        assert not base_spans(r["text"]) or "[" in r["text"]
    assert all(copies[i] <= 3 * sum(r[0] == i for r in now) for i in copies)
    # Redaction may join words of a span; but for that the mixture holds about as many words as came in.
    assert abs(sum(taken.values()) - sum(size.values())) < 0.15 * sum(size.values())
    nothing = every.limit(0)
    for _, stage in p.STAGES:
        nothing = stage(spark, nothing, str(tmp_path))
        assert nothing.count() == 0
