"""Near-duplicate groups: SimHash fingerprints under covering locality-sensitive hashing."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import materialize
from .components import components
from .simhash import covering_masks, links_within


def _fold(texts, shingle: int):
    """Signed fingerprints of an iterable of bytes or None."""
    words, lower = re.compile(rb"[^\x20\x09-\x0D]+").findall, bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    for t in texts:
        w = words((t or b"").translate(lower))
        if not w:
            yield 0
            continue
        ones, n = np.zeros(64, "int64"), max(1, len(w) - shingle + 1)
        for at in range(0, n, 65536):  # bounds what a long text needs
            part = w[at : at + 65536 + shingle - 1]
            terms = map(b" ".join, zip(*(part[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else [b" ".join(w)]
            h = np.fromiter((xxh64_intdigest(x, 42) for x in terms), "<u8")
            ones += np.unpackbits(h.view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype="int64")
        yield int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def text_fingerprints(docs: DataFrame, shingle: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): the fingerprint of the word shingles of each whole text, lower-cased in A-Z.

    A bit is set if it is in over half of the shingles' hashes (XXH64, seed 42), repeats
    included. Fewer words than a shingle make one shingle; null and blank texts have fingerprint 0.
    One row for each row of the input.
    """

    def fold(batches):
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_fold((x.as_py() for x in texts), shingle), "int64")], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(fold, "doc_id long, fp long")


def near_groups(fps: DataFrame, radius: int = 2) -> DataFrame:
    """(doc_id, fp, component_id): groups of documents (doc_id, fp) that links of at most
    ``radius`` differing bits connect; component_id is the smallest id of the group.

    Copies are folded into one fingerprint first, so only distinct fingerprints enter the
    tables, and 2^(radius+1) - 1 covering masks make every pair within the radius meet.
    A null id is a node of its own id null. An empty input gives an empty result.
    """
    fps = materialize(fps, "fingerprints")
    points = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("id")).where("id is not null"), "points")
    links = links_within(points, radius, covering_masks(radius))
    joined = components(links)
    named = points.join(joined.withColumnRenamed("node", "id"), "id", "left").select("fp", F.coalesce("component", "id").alias("component_id"))
    return fps.join(named, "fp", "left").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, radius: int = 4) -> DataFrame:
    """The documents without all but the first (smallest id) of each near-duplicate group.

    Of rows that repeat the kept id with equal or different texts all stay; rows with a null id stay.
    """
    groups = near_groups(text_fingerprints(docs, shingle), radius)
    gone = materialize(groups.where("doc_id > component_id").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)
