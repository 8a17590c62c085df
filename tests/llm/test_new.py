"""Operators 11 to 13 against brute-force versions and held-out labels."""

import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


# --- conversation prefix trie


def brute_trie(rows):
    """rows of (conv_id, turn, role, text), turns without ties."""
    turns = defaultdict(list)
    for c, t, r, x in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, r or "", x or ""))
    turns = {c: [(r, x) for _, _, r, x in sorted(v)] for c, v in turns.items()}
    members, ends = defaultdict(set), defaultdict(list)
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(turns.get(c - c % 5, [])[:h] + own[h:])
        for d in range(len(path) + 1):
            members[path[:d]].add(c)
        ends[path].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in children[p]) or 1
        saved[p] = sum(saved[k] for k in children[p]) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    digest = {p: hashlib.sha256(",".join(map(str, sorted(ends.get(p, [])))).encode()).hexdigest() for p in members}
    return sorted((min(m), len(p), min(members[p[:-1]]) if p else -1, len(m), len(children[p]), leaves[p], saved[p], digest[p]) for p, m in members.items())


def trie_rows(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_trie_against_brute_force(spark):
    from stormledger.llm import trie

    rng = random.Random(3)
    rows = [(10, None, None, None), (10, 0, "user", "é"), (11, 5, "user", ""), (None, 1, "user", "x"), (25, 0, "a", "b"), (26, 0, "a", "b")]
    for c in range(40, 100):  # shared and own turns, some ids and firsts of groups absent
        if c % 7:
            rows += [(c, t, rng.choice(["user", "bot"]), rng.choice(["x", "yy", "zzz"])) for t in rng.sample(range(20), rng.randint(1, 10))]
    for c in range(200, 260):  # copies
        rows += [(c, t, "user", f"same {t}") for t in range(9)]
    for c, last in ((300, "p"), (301, "q"), (302, "p"), (310, "p")):  # longer than two blocks, different only at the end
        rows += [(c, t, "user", f"long {t}") for t in range(2 * trie.BLOCK + 30)] + [(c, 10_000, "user", last)]
    rng.shuffle(rows)
    made = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit("clash"), "rank": F.lit(1), "key": F.lit(None).cast("int")})
    got = trie.prefix_trie(made.repartition(5))
    assert trie_rows(got) == brute_trie(rows)
    placed = sorted((r.preorder, r.subtree_end, r.depth) for r in got.collect())
    assert [p for p, *_ in placed] == list(range(len(placed)))
    for p, e, d in placed[:200]:  # a subtree is what follows, as long as it is deeper
        assert all(x[2] > d for x in placed[p + 1 : e + 1]) and (e + 1 == len(placed) or placed[e + 1][2] <= d)


def test_trie_repeated_rows_ties_and_empty(spark):
    from stormledger.llm import trie

    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(spark.createDataFrame([], schema)).collect() == []
    tied = [(5, 1, "a", "x"), (5, 1, "a", "x"), (5, 1, "b", "y")]
    first = trie_rows(trie.prefix_trie(spark.createDataFrame(tied, schema)))
    assert first == trie_rows(trie.prefix_trie(spark.createDataFrame(tied[::-1], schema))) and len(first) == 4


def test_trie_oracle(spark):
    from stormledger.llm import queries

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    want = con.sql(queries.oracle_sql()["op11_trie"]).fetchall()
    got = queries.op11_trie(spark, SF)
    names = [d[0] for d in con.sql(queries.oracle_sql()["op11_trie"]).description]
    assert sorted(map(str, want)) == sorted(str(tuple(r[n] for n in names)) for r in got.collect())


# --- language


def test_segmentations_against_brute_force():
    from stormledger.llm import language

    pieces = tuple(language.read_vocabulary())
    rng = np.random.default_rng(0)
    share = rng.random((len(pieces), 2))
    share /= share.sum(0)
    at = {p: i for i, p in enumerate(pieces)}
    model = language.Languages(pieces, ["a", "b"], np.zeros(2), np.log(share))

    def total(b, k):
        return 1.0 if not b else sum(share[at[b[:i]], k] * total(b[i:], k) for i in range(1, len(b) + 1) if b[:i] in at)

    words = ["the", "über", "a", "information", "ñandú", "日本", "x" * 60]
    got = model.word_likelihoods(words)
    for w, row in zip(words[:-1], got, strict=False):
        for k in (0, 1):
            assert row[k] == pytest.approx(np.log(total(b" " + w.encode(), k)))
    assert np.isfinite(got).all() and np.isfinite(model.word_likelihoods(["ab" * 5000])).all()
    lattice = language.Lattice(language._finder(pieces), words)
    uses = lattice.expected(np.log(share[lattice.piece, 0]), np.full(len(words), 3.0))
    for i, w in enumerate(words):  # each byte is covered once by every segmentation
        covered = np.zeros(len(w.encode()) + 1)
        for b, e, x in zip(lattice.begin, lattice.end, np.where(lattice.word == i, uses, 0), strict=True):
            covered[b:e] += x
        assert covered == pytest.approx(3.0)


def test_language_held_out(spark):
    from stormledger.llm import language

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hidden = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit("xx")).otherwise(F.col("lang")))  # held-out labels must not matter
    made = {r.doc_id: r for r in language.identify(hidden).collect()}
    rows = docs.select("doc_id", "lang").collect()
    assert len(made) == len(rows) and all(0 <= r.score <= 1 for r in made.values())
    held = [made[r.doc_id].lang_pred == r.lang for r in rows if made[r.doc_id].held_out]
    assert len(held) > 100 and np.mean(held) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in made.values())


def test_language_odd_rows(spark):
    from stormledger.llm import language

    schema = "doc_id long, text string, lang string, pieces int, words string, score string"
    rows = [(i, t, k, i, "w", "s") for i, (t, k) in enumerate([("le chat est là", "fr"), ("the cat is there", "en"), ("the dog", "en"), ("le chien", "fr")] * 10)]
    odd = [(None, None), (None, "en"), ("", "en"), ("12 ½ +++ \n", "en"), ("The CAT", None), ("le chien " * 20000, None), ("É" * 9000, None)]
    docs = spark.createDataFrame(rows + [(100 + i, t, k, None, None, None) for i, (t, k) in enumerate(odd)] + [(None, "the dog", None, 1, "", ""), (101, "le chat", None, 1, "", "")], schema)
    got = language.identify(docs)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert len(found) == len(rows) + len(odd) + 2
    assert [k for i, k in found if i in (100, 102, 103)] == ["und"] * 3 and sorted(k for i, k in found if i == 101) == ["fr", "und"]
    assert dict(found)[104] == "en" and dict(found)[105] == "fr" and dict(found)[None] == "en" and dict(found)[106] in ("en", "fr")
    assert {r.lang_pred for r in language.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(docs.limit(0)).collect() == []
    few = language.identify(docs, most_rows=5).collect()  # a bounded sample, whichever rows it takes
    assert len(few) == len(found)


# --- periodic runs


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, 2 * q):
                s = w[i : i + length]
                if q == next(p for p in range(1, length + 1) if s[p:] == s[:-p] or p == length):
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_periodic(doc_id, text):
    w = [x for x in (text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if x]
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    if doc_id is not None and h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *top, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest())


def random_words(rng, n, kinds, longest):
    w = []
    while len(w) < n:
        w += [rng.randrange(kinds) for _ in range(rng.randint(1, longest))] * rng.choice([1, 1, 2, 3, 5])
    return w[:n]


def test_runs_against_brute_force():
    from stormledger.llm import periodic

    rng = random.Random(1)
    for k in range(600):
        w = random_words(rng, rng.choice([0, 1, 11, 12, 13, 30, 80, 200]), rng.choice([1, 2, 3, 10, 1000]), 30)
        x = periodic.numbered([str(i).encode() for i in w])
        assert periodic.runs_of(x) == brute_runs(w), w
        for heavy in (0, 1, 3, 10**6):  # all words by FFT, or all by differences
            counts = periodic.lag_counts(x, heavy)
            assert all(counts[q] == sum(a == b for a, b in zip(w, w[q:], strict=False)) for q in range(1, len(w) // 2 + 1)), k
    for _ in range(12):  # lags above the probing grid
        w = random_words(rng, rng.randint(700, 1500), rng.choice([2, 50]), 500)
        assert periodic.runs_of(periodic.numbered([str(i).encode() for i in w])) == brute_runs(w)


def test_periodic_query(spark):
    from stormledger.llm import periodic

    rng = random.Random(2)
    texts = [None, "", " \n\t", "a", "x " * 5000, "a b " * 7, "é\tß\x0bé ß\r\n" * 9, "7" * 20000, " ".join(["q"] * 12), " ".join(["q"] * 11)]
    texts += [" ".join(map(str, random_words(rng, rng.randint(1, 300), rng.choice([2, 5, 100]), 40))) for _ in range(80)]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(7, "a b c " * 10, "z", 2), (None, "a b c " * 10, "z", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, __text long")
    got = periodic.find_runs(docs, seed=F.crc32(F.col("doc_id").cast("string"))).drop("runs", "collapsed")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(brute_periodic(r[0], r[1])) for r in rows)
    assert periodic.find_runs(docs.limit(0)).collect() == []
    plain = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(r) for r in plain[5].runs] == [(0, 14, 2)] and plain[5].collapsed == "a b" and plain[0].collapsed == ""


def test_periodic_real(spark):
    from stormledger.llm import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    small = {r.doc_id for r in docs if len(r.text) < 4000}
    want = sorted(str(brute_periodic(r.doc_id, r.text)) for r in docs if r.doc_id in small)
    assert sorted(str(tuple(r)) for r in queries.op13_periodic(spark, SF).collect() if r.doc_id in small) == want
