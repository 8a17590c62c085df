"""Each operator against a brute-force version on small tables with odd rows."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["a"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [None, "", " \n\t ", "one", "Two words", "a b c", "a b c", "A B C", "é É ß 😀 x", "x " * 3000, "mail a.b+c@d-e.fr-x+y@z.org now", "+1 (22) 333-44-55, 4111 1111 1111 1111 ip 1.2.3.4.5.6.7.8 999.1.1.1",
       "DE89 3704 0044 0532 0130 00 konto", "7" * 20000, "ab" * 20000, "\x0b\x0c mixed\rlines\r\n"]


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return frame(spark, ODD)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# --- personal data


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(t):
    kinds = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]
    out = []
    for rank, (kind, p) in enumerate(kinds):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else 0, "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


@pytest.mark.parametrize("which", ["odd", "real"])
def test_pii_base_spans(spark, which, request):
    from stormledger.llm import pii

    docs = request.getfixturevalue(which)
    texts = {r["doc_id"]: "7" * 300 + (r["text"] or "")[300:] if len(set(r["text"] or "")) == 1 else r["text"] or "" for r in rows_of(docs)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for r in pii.detect(docs).collect():
        got = [(s["start"], s["rank"], s["end"], s["kind"]) for s in r["pii_spans"] if s["kind"] in pii.BASE]
        assert got == base_spans(texts[r["doc_id"]]), r["doc_id"]


def test_pii_extra_and_redaction(spark, odd):
    from stormledger.llm import pii

    found = {r["doc_id"]: [s["kind"] for s in r["pii_spans"]] for r in pii.detect(odd).collect()}
    assert "iban" in found[12] and found[0] == [] and found[13] == []
    clean = {r["doc_id"]: r for r in pii.redact(odd).collect()}
    assert clean[0]["text"] is None and clean[3]["text"] == "one"
    assert clean[10]["text"] == "mail [EMAIL][EMAIL] now" and clean[10]["n_chars"] == len("mail [EMAIL][EMAIL] now")
    assert "[CARD]" in clean[11]["text"] and "4111" not in clean[11]["text"]
    assert pii.redact(odd).columns == odd.columns


# --- mixing


def test_mixing(spark):
    from stormledger.llm import mixing

    texts = [" ".join(["w"] * (i % 37)) for i in range(400)] + [None, "one two"]
    sources = [("big" if i % 3 else f"s{i % 7}") if i % 50 else None for i in range(402)]
    docs = frame(spark, texts, sources)
    plan = rows_of(mixing.plan_mix(docs, per_bin=16))
    assert len(plan) == 402
    size = defaultdict(int)
    for t, s in zip(texts, sources, strict=True):
        size[s] += len(WORD.findall(t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: 1 + i % 3 for i, s in enumerate(order)}
    want, open_ = dict.fromkeys(order, 0.0), set(order)
    left = sum(size.values())
    while True:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if 3 * size[s] < level * w[s]}
        if not over:
            want |= {s: level * w[s] for s in open_}
            break
        for s in over:
            want[s] = 3 * size[s]
            left -= 3 * size[s]
        open_ -= over
    taken = defaultdict(int)
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == size[r["source"]]
        assert 0 <= r["taken"] <= 3 * r["size"] and all(0 <= p <= sum(size.values()) for p in r["positions"])
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 37 for s in order)
    again = rows_of(mixing.plan_mix(docs.repartition(7), per_bin=16))
    key = lambda r: (r["doc_id"], r["taken"], r["positions"])
    assert sorted(map(key, plan)) == sorted(map(key, again))
    mixed = mixing.mix(docs.withColumn("mix_position", F.lit(1)))
    positions = [r["mix_position"] for r in mixed.collect()]
    assert positions == sorted(positions) and len(positions) == sum(len(r["positions"]) for r in plan)
    assert mixing.mix(docs.limit(0)).count() == 0


# --- SimHash


def brute_fp(t, k=3):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    terms = [" ".join(w[i : i + k]) for i in range(len(w) - k + 1)] if len(w) >= k else [" ".join(w)] if w else []
    ones = Counter(b for x in terms for h in [xxhash.xxh64_intdigest(x.encode(), 42)] for b in range(64) if h >> b & 1)
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(terms))


def brute_groups(fps, radius):
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in fps}


@pytest.mark.parametrize("which", ["odd", "real"])
def test_near_duplicates(which, request):
    from stormledger.llm import neardup

    docs = request.getfixturevalue(which)
    fps = {r["doc_id"]: brute_fp(r["text"]) for r in rows_of(docs)}
    want = brute_groups(fps, 2)
    got = rows_of(neardup.near_groups(neardup.text_fingerprints(docs), 2))
    assert {r["doc_id"]: r["fp"] % 2**64 for r in got} == fps
    assert {r["doc_id"]: r["component_id"] for r in got} == want


@pytest.mark.parametrize("radius", [2, 3])
@pytest.mark.parametrize("small", [2, 64])
def test_links_in_hot_buckets(spark, radius, small):
    import random

    from stormledger.llm import components, simhash

    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(5)]
    fps = {}
    for i in range(300):
        x = base[i % 5]
        for _ in range(rng.randrange(6)):
            x ^= 1 << rng.randrange(64)
        if x not in fps.values():
            fps[i] = x
    points = spark.createDataFrame([(i, simhash.signed(x)) for i, x in fps.items()], "id long, fp long")
    for masks in (simhash.covering_masks(radius), simhash.block_masks(radius)):
        links = simhash.links_within(points, radius, masks, small, middle=2 if masks[0] % 2 else 4096)
        assert all((fps[r["u"]] ^ fps[r["v"]]).bit_count() <= radius for r in links.collect())
        got = {r["node"]: r["component"] for r in components.components(links).collect()}
        assert {i: got.get(i, i) for i in fps} == brute_groups(fps, radius)


def test_covering_masks_cover():
    import itertools

    from stormledger.llm.simhash import block_masks, covering_masks

    for r in (1, 2):
        for masks in (covering_masks(r), block_masks(r)):
            assert all(any(not m & sum(1 << b for b in c) for m in masks) for c in itertools.combinations(range(64), r))


def test_fingerprint_report(spark):
    from stormledger.llm import fingerprints
    from stormledger.llm.simhash import hex16

    for texts in ([f"word{i} and some {'more ' * (i % 5)}text {i * i}" for i in range(40)] + ODD, ["single one"]):
        docs = frame(spark, texts)
        got = {r["doc_id"]: r for r in fingerprints.fingerprint_report(docs).withColumn("hex", hex16(F.col("fp"))).collect()}
        assert len(got) == len(texts)

        def fp(t):
            n, total = Counter(), 0
            for w in WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)):
                h, k = xxhash.xxh64_intdigest(w.encode(), 42), min(16, len(w))
                total += k
                n.update({b: k for b in range(64) if h >> b & 1})
            return sum(1 << b for b in range(64) if 2 * n[b] > total)

        for i, t in enumerate(texts):
            t, after = t or "", texts[i - 1] or ""
            k = len(t) // 3
            edited = t[: len(t) - k] + after[:k]
            assert got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and got[i]["n_chars"] == len(t)
            assert got[i]["fp"] % 2**64 == fp(t) and got[i]["efp"] % 2**64 == fp(edited), i
            assert got[i]["near_next"] == 1 - (fp(t) ^ fp(after)).bit_count() / 64


def test_with_next_over_ranges(spark):
    from stormledger.llm import fingerprints

    docs = spark.range(0, 5000, 7).selectExpr("id as doc_id", "cast(id as string) as text").repartition(5)
    ids = [r["doc_id"] for r in docs.orderBy("doc_id").collect()]
    want = {i: ids[k - 1] for k, i in enumerate(ids)}
    got = fingerprints.with_next(docs, per_range=50).collect()
    assert {r["doc_id"]: r["next_id"] for r in got} == want and all(str(r["next_id"]) == r["next_text"] for r in got)


# --- quality


def test_quality(spark, odd):
    import zlib

    from stormledger.llm import quality

    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for i, r in got.items())
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    held = [i for i in truth if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.93
    kept = {r["doc_id"] for r in quality.keep_good(docs, labels).collect()}
    assert kept == {i for i, r in got.items() if r["predicted"]}
    assert all(0 <= r["score"] <= 1 for r in quality.score_quality(odd, labels).collect())
    assert {r["score"] for r in quality.score_quality(odd, labels.limit(0)).collect()} == {0.5}


# --- decontamination


def test_decontamination(spark, real, odd):
    from stormledger.llm import decontaminate as d

    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    bench = {r["item_id"]: d.terms(r["text"].encode()) for r in items.collect()}
    want = set()
    for r in real.collect():
        t = b" " + b" ".join(d.terms(r["text"].encode())) + b" "
        want |= {(r["doc_id"], i) for i, w in bench.items() if b" " + b" ".join(w) + b" " in t}
    got = {(r["doc_id"], r["item_id"]) for r in d.find_leaks(real, items).collect()}
    assert want and want <= got and len(got - want) <= 2
    assert d.find_leaks(odd, items).count() == 0
    kept = {r["doc_id"] for r in d.drop_leaks(real, items).collect()}
    assert kept == {r["doc_id"] for r in real.collect()} - {i for i, _ in got}
    assert d.find_leaks(real, items.limit(0)).count() == 0


def test_block_max_wand_is_exact():
    import random

    from stormledger.llm import decontaminate as d

    rng = random.Random(2)
    items = [(i, " ".join(f"t{int(rng.paretovariate(0.6)) % 60}" for _ in range(rng.randrange(1, 30))), "") for i in range(300)]
    ix = d.build_index(items, {f"t{i}".encode(): 1 + i % 5 for i in range(60)}, 15.0, block=4)
    for _ in range(60):
        query = rng.sample(range(len(ix.postings)), 12)
        score = defaultdict(float)
        for t in query:
            for i, w in zip(*ix.postings[t], strict=True):
                score[i] += w
        for theta in (0.2, 0.5, 0.8):
            got = dict(d.block_max_wand(ix, query, theta, block=4))
            assert got.keys() == {i for i, s in score.items() if s >= theta - 1e-12}
            assert all(abs(got[i] - score[i]) < 1e-9 for i in got)


# --- pipeline


def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = p.run(spark, SF)
    assert out.count() > 50 and out.columns[:5] == docs.columns
