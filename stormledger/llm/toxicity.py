"""Toxicity: maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Tokens get the log-odds of their document frequencies in toxic and other training documents,
under an informative Dirichlet prior. Each whole text is scanned once for all maximal scoring
segments (Ruzzo and Tompa). By chance K m exp(-lambda S) segments of a text of m tokens reach the score S (Karlin
and Altschul); K and lambda are fitted to the best segments of other documents that lent no token counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize

#: Labelled documents that the model is fitted on, at most (the first ones by a hash of their id).
MOST_TRAINING_ROWS = 40_000
#: A token counts if its log-odds are that many standard deviations from zero.
LEAST_Z = 3.0
#: Prior weight, in documents, spread over the vocabulary by frequency, and added to each token.
PRIOR_ROWS, PRIOR_EACH = 500.0, 0.5
#: Chance segments per document below which a segment is significant.
SIGNIFICANT = 0.05
#: K and lambda where too few documents have a segment to fit them (log-odds have a natural scale of 1).
K, LAMBDA, LEAST_FITTED = 0.1, 1.0, 20

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_TOKENS = re.compile(rb"[a-z\x80-\xff]+").findall


def tokens(text: bytes | None) -> list[bytes]:
    return _TOKENS((text or b"").translate(_LOWER))


def maximal_segments(scores: list[tuple[int, float]], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) in linear time.

    ``scores`` lists the tokens (position, score) that don't score ``-gap``. Candidates are kept on a
    stack with the running totals at their ends; each links to the nearest one that started lower.
    """
    stack: list[list[float]] = []  # first, last, total before, total after, link
    total, seen = 0.0, 0
    for at, s in scores:
        total -= gap * (at - seen)
        seen = at + 1
        before, total = total, total + s
        if s <= 0:
            continue
        fresh = [at, at, before, total, -1]
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= fresh[2]:
                j = int(stack[j][4])
            if j < 0 or stack[j][3] >= fresh[3]:
                fresh[4] = j
                stack.append(fresh)
                break
            fresh = [stack[j][0], fresh[1], stack[j][2], fresh[3], -1]
            del stack[j:]
    return [(int(a), int(b), after - before) for a, b, before, after, _ in stack]


def segments_of(lexicon: dict[bytes, float], gap: float, text: bytes | None) -> tuple[int, list[tuple[int, int, float]]]:
    """The number of tokens and all maximal segments of a text."""
    w = tokens(text)
    get = lexicon.get
    scored = [(i, s) for i, x in enumerate(w) if (s := get(x)) is not None]
    return len(w), maximal_segments(scored, gap)


def weighed(m: int, segments: list[tuple[int, int, float]], k: float, lam: float) -> tuple[float, float, list[tuple[int, int, float]]]:
    """(best, sum, passages): -log of the chance of the best segment and the sum over all
    significant ones, which are the passages (first token, last token, score)."""
    found, best, total = [], 0.0, 0.0
    for a, b, s in segments:
        chance = -math.expm1(-k * m * math.exp(-min(lam * s, 700.0)))
        strength = -math.log(max(chance, 1e-300))
        best = max(best, strength)
        if chance <= SIGNIFICANT:
            found.append((a, b, s))
            total += strength
    return best, max(total, best), found


def fit_extremes(lengths: np.ndarray, best: np.ndarray) -> tuple[float, float]:
    """K and lambda of the best scores of texts of these lengths, by maximum likelihood.

    A text without a segment says that its best score is below the least one seen. For a given lambda the best
    K is known in closed form, so the likelihood is searched along lambda alone.
    """
    seen = best > 0
    n = int(seen.sum())
    if n < LEAST_FITTED:
        return K, LAMBDA
    m = np.maximum(lengths, 1).astype(float)
    x = np.where(seen, best, best[seen].min())

    def k_of(lam: float) -> float:
        return n / float((m * np.exp(-lam * x)).sum())

    def likelihood(lam: float) -> float:
        return n * (math.log(lam) + math.log(k_of(lam))) - lam * float(x[seen].sum())

    low, high = 0.01, 10.0
    for _ in range(100):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        if likelihood(a) < likelihood(b):
            low = a
        else:
            high = b
    lam = (low + high) / 2
    return k_of(lam), lam


@dataclass(frozen=True)
class Model:
    lexicon: dict[bytes, float]
    gap: float
    weights: tuple[float, float, float]
    k: float = K
    lam: float = LAMBDA

    def evidence(self, text: bytes | None) -> tuple[float, float, list[tuple[int, int, float]]]:
        return weighed(*segments_of(self.lexicon, self.gap, text), self.k, self.lam)

    def probability(self, best: float, total: float) -> float:
        a, b, c = self.weights
        return 1.0 / (1.0 + math.exp(-max(-500.0, min(500.0, a + b * math.log1p(best) + c * math.log1p(total)))))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Penalised logistic regression by Newton's steps."""
    beta = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        keep = ridge * np.r_[0.01, np.ones(x.shape[1] - 1)]
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (y - p) - keep * beta)
        beta += step
        if np.abs(step).max() < 1e-8:
            break
    return beta


def fit(docs: DataFrame, labels: DataFrame, label: str, train: Column, most_rows: int = MOST_TRAINING_ROWS) -> Model:
    """The model of at most ``most_rows`` labelled training documents.

    Four fifths of them count tokens, the rest fits K and lambda and calibrates the probability, so these aren't judged on
    the texts that the tokens were counted in. Labels other than 0 and 1 don't count; of repeated labels the largest does.
    """
    truth = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("__y"))
    hashed = F.xxhash64(F.lit(5), "doc_id")
    sample = truth.where(train).orderBy(hashed, "doc_id").limit(most_rows)
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "__y", (F.pmod(hashed, F.lit(5)) == 0).alias("held")).where("text is not null")

    def count(batches):
        pair: dict[bytes, list[int]] = {}
        for b in batches:
            for t, y in zip(b.column(0).cast(pa.binary()), b.column(1).to_pylist(), strict=True):
                for w in {*tokens(t.as_py()), b""}:  # the empty token counts the documents
                    pair.setdefault(w, [0, 0])[y] += 1
            if len(pair) > 200_000:
                yield from out(pair)
                pair = {}
        yield from out(pair)

    def out(pair):
        yield pa.RecordBatch.from_arrays([pa.array(list(pair), pa.binary()), pa.array([n for n, _ in pair.values()], "int64"), pa.array([n for _, n in pair.values()], "int64")], ["w", "n0", "n1"])

    counted = rows.where("not held").select("text", "__y").mapInArrow(count, "w binary, n0 long, n1 long").groupBy("w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    counted = materialize(counted, "tokens")
    every = counted.where("length(w) = 0").first()
    if not every or not every["n0"] or not every["n1"]:
        return Model({}, 1.0, (0.0, 0.0, 0.0))
    words = counted.where("length(w) > 0")
    sums = words.agg(F.sum("n0").alias("s0"), F.sum("n1").alias("s1")).first()
    s0, s1 = float(sums["s0"]), float(sums["s1"])
    share = (F.col("n0") + F.col("n1")) / (s0 + s1)
    a = F.lit(PRIOR_EACH) + PRIOR_ROWS * share
    y0, y1 = F.col("n0") + a, F.col("n1") + a
    odds = F.log(y1 / (s1 + PRIOR_ROWS - y1)) - F.log(y0 / (s0 + PRIOR_ROWS - y0))
    z = odds / F.sqrt(1 / y0 + 1 / y1)
    strong = words.select("w", "n0", "n1", odds.alias("odds"), z.alias("z")).where(F.abs("z") >= LEAST_Z).collect()  # as many as the training rows have: their number is bounded
    lexicon = {bytes(r["w"]): float(r["odds"]) for r in strong}
    rest0, rest1 = s0 - sum(r["n0"] for r in strong), s1 - sum(r["n1"] for r in strong)
    gap = max(1e-3, math.log((rest0 + 1) / (s0 + 1)) - math.log((rest1 + 1) / (s1 + 1)))

    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64()), ("s", pa.float64())]))

    def found(batches):
        for b in batches:
            got = [segments_of(lexicon, gap, t.as_py()) for t in b.column(0).cast(pa.binary())]
            lists = pa.array([[{"a": a, "b": e, "s": s} for a, e, s in x] for _, x in got], kind)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([m for m, _ in got], "int64"), lists], ["y", "m", "segments"])

    held = rows.where("held").select("text", "__y").mapInArrow(found, "y int, m long, segments array<struct<a:long,b:long,s:double>>").collect()
    got = [(r["y"], r["m"], [tuple(x) for x in r["segments"]]) for r in held]
    clean = [(m, max((s for *_, s in x), default=0.0)) for y, m, x in got if not y]
    k, lam = fit_extremes(np.array([m for m, _ in clean], float), np.array([s for _, s in clean], float))
    y = np.array([r[0] for r in got], float)
    if not 0 < y.sum() < len(y):
        return Model(lexicon, gap, (math.log(every["n1"] / every["n0"]), 1.0, 1.0), k, lam)
    strength = [weighed(m, x, k, lam)[:2] for _, m, x in got]
    x = np.array([[1.0, math.log1p(a), math.log1p(b)] for a, b in strength])
    return Model(lexicon, gap, tuple(map(float, _logistic(x, y))), k, lam)


def score_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", fold: tuple[int, int] = (5, 0), least: float = 0.5) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_passages, passages) for each row.

    Rows whose id falls in the held-out fold lend no label. Rows that repeat an id are scored each. Passages are the significant segments
    as {first, last, score}, in tokens, both ends included. Null and empty texts get the score of a text without evidence.
    """
    held = bucket_of(F.col("doc_id"), fold[0]) == fold[1]
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, ~held))
    kind = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64()), ("score", pa.float64())]))

    def scan(batches):
        m = model.value
        for b in batches:
            got = [m.evidence(t.as_py()) for t in b.column(2).cast(pa.binary())]
            score = pa.array([m.probability(x[0], x[1]) for x in got], "float64")
            passages = pa.array([[{"first": a, "last": e, "score": s} for a, e, s in x[2]] for x in got], kind)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), score, passages], ["doc_id", "held_out", "score", "passages"])

    rows = docs.select("doc_id", held.alias("held_out"), F.col("text").cast("string").alias("text"))
    kept = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, passages array<struct<first:long,last:long,score:double>>"
    scored = rows.mapInArrow(scan, kept)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= least).cast("int").alias("predicted"), F.size("passages").cast("long").alias("n_passages"), "passages")
