"""Quality classifier: regularised quadratic discriminant over document statistics.

The statistics are counts over the bytes, words and lines of the whole text. The fit is one aggregation of
class sums and cross products, and a score compares the classes' log densities, each from its
cached Cholesky factor.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, materialize

#: Characters counted apart; their shares of a text are features.
MARKS = {"symbols": b"#$%&*@^~=<>{}[]\\", "bars": b"|_/+", "shouts": b"!?", "stops": b".,;:", "digits": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
FEATURES = ["chars", "word_len", "line_len", *MARKS, "variety", "line_variety"]
_CLASSES = np.zeros((256, len(MARKS)))
for _k, _chars in enumerate(MARKS.values()):
    _CLASSES[list(_chars), _k] = 1.0


def statistics(text: bytes | None) -> list[float]:
    """Transformed statistics of a text, in the order of ``FEATURES``: logarithms of sizes, square roots of shares.

    A null text counts as empty, and an empty text has finite values.
    """
    text = text or b""
    counts = np.bincount(np.frombuffer(text, "u1"), minlength=256)
    n = max(1, int(counts.sum() - counts[0x80:0xC0].sum()))  # code points
    words, lines = text.split(), text.split(b"\n")
    n_words = max(1, len(words))
    sizes = [np.log1p(n), np.log1p(n / n_words), np.log1p(n / len(lines))]
    return [*sizes, *np.sqrt(counts @ _CLASSES / n), np.sqrt(len(set(words)) / n_words), np.sqrt(len(set(lines)) / len(lines))]


def featurize(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, f_...) of each row."""

    def count(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(1).cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(x[:, j]) for j in range(x.shape[1]))], ["doc_id", *(f"f_{k}" for k in FEATURES)])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col(text).cast("string").alias("text")).mapInArrow(count, f"doc_id {kind}, " + ", ".join(f"f_{k} double" for k in FEATURES))


@dataclass(frozen=True)
class Quadratic:
    """Per class: log prior, mean, inverse Cholesky factor and log determinant."""

    prior: tuple[float, float]
    mean: tuple[list[float], list[float]]
    whiten: tuple[list[list[float]], list[list[float]]]
    logdet: tuple[float, float]
    slope: float = 1.0

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 of each row: the logistic function of the difference of log densities."""
        density = []
        for c in (0, 1):
            z = (x - np.array(self.mean[c])) @ np.array(self.whiten[c]).T
            density.append(self.prior[c] - 0.5 * self.logdet[c] - 0.5 * (z * z).sum(1))
        return 1.0 / (1.0 + np.exp(-np.clip(self.slope * (density[1] - density[0]), -500.0, 500.0)))


def fit(featured: DataFrame, labels: DataFrame, label: str, train: Column, shrink: float = 0.1, slope: float = 1.0) -> Quadratic:
    """Class means and shrunken covariances from the labelled training rows.

    ``shrink`` mixes each covariance with the pooled diagonal. Rows with a null label or a label
    other than 0 and 1 don't count; of repeated labels the largest counts. A class without rows
    takes the pooled moments, and without any rows every score is one half.
    """
    names = [c for c in featured.columns if c.startswith("f_")]
    d = len(names)
    truth = labels.where(F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("__y"))
    rows = featured.join(truth, "doc_id").where(train)
    sums = [F.sum(c).alias(f"s{i}") for i, c in enumerate(names)]
    cross = [F.sum(F.col(names[i]) * F.col(names[j])).alias(f"c{i}_{j}") for i in range(d) for j in range(i + 1)]
    found = {r["__y"]: r for r in rows.groupBy("__y").agg(F.count("*").alias("n"), *sums, *cross).collect()}  # two rows
    n, mean, cov = {}, {}, {}
    for c in (0, 1):
        r = found.get(c)
        n[c] = r["n"] if r else 0
        mean[c] = np.array([r[f"s{i}"] / n[c] for i in range(d)]) if r else np.zeros(d)
        second = np.zeros((d, d))
        for i in range(d):
            for j in range(i + 1):
                second[i, j] = second[j, i] = r[f"c{i}_{j}"] / n[c] if r else 0.0
        cov[c] = second - np.outer(mean[c], mean[c])
    total = max(1, n[0] + n[1])
    pooled = np.diag(sum(n[c] * cov[c] for c in (0, 1)) / total) + 1e-4
    for c in (0, 1):
        if not n[c]:
            mean[c], cov[c] = mean[1 - c], cov[1 - c]
    factor = [np.linalg.cholesky((1 - shrink) * cov[c] + shrink * np.diag(pooled) + 1e-6 * np.eye(d)) for c in (0, 1)]
    prior = [np.log((n[c] + 1) / (total + 2)) for c in (0, 1)]
    return Quadratic(
        tuple(map(float, prior)), tuple(mean[c].tolist() for c in (0, 1)), tuple(np.linalg.inv(f).tolist() for f in factor), tuple(float(2 * np.log(np.diag(f)).sum()) for f in factor), slope
    )


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (4, 2), least: float = 0.7) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row.

    Rows whose id falls in the held-out fold lend no label. The statistics are computed once,
    written to the shared folder, and used for both the fit and the scores.
    """
    featured = materialize(featurize(docs), "statistics")
    held = bucket_of(F.col("doc_id"), fold[0]) == fold[1]
    model = fit(featured, labels, label, ~held)

    def rate(batches):
        for b in batches:
            x = np.stack([b.column(2 + j).to_numpy(zero_copy_only=False) for j in range(len(FEATURES))], 1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(model.score(x))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = featured.select("doc_id", held.alias("held_out"), *(f"f_{k}" for k in FEATURES))
    return rows.mapInArrow(rate, f"doc_id {kind}, held_out boolean, score double").select("*", (F.col("score") >= least).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, label: str = "quality", fold: tuple[int, int] = (4, 2), least: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts, all columns unchanged.

    The statistics for the fit are one pass over the texts, the decision another, beside the rows
    themselves, so no text is shuffled.
    """
    held = bucket_of(F.col("doc_id"), fold[0]) == fold[1]
    model = fit(featurize(docs), labels, label, ~held)
    at = docs.columns.index("text")

    def keep(batches):
        for b in batches:
            x = np.array([statistics(t.as_py()) for t in b.column(at).cast(pa.binary())]).reshape(-1, len(FEATURES))
            yield b.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(keep, docs.schema)
