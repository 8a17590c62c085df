"""Nearest vectors of a stated query set, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize

#: Vectors of a block.
BLOCK = 1024


def _blocks(rows: DataFrame, name: str) -> DataFrame:
    """(ids, dims, data): vectors of (id, vector) packed as they come, ``BLOCK`` to a row; null vectors are left out."""

    def pack(batches):
        for b in batches:
            for at in range(0, b.num_rows, BLOCK):
                part = b.slice(at, BLOCK)
                vectors = part.column(1)
                sizes = np.diff(vectors.offsets.to_numpy())
                data = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
                for d in np.unique(sizes):  # vectors of one length at a time
                    keep = sizes == d
                    chosen = data[np.repeat(keep, sizes)]
                    ids = part.column(0).to_numpy(zero_copy_only=False)[keep].astype("i8")
                    yield pa.RecordBatch.from_arrays([pa.array([ids.tobytes()]), pa.array([int(d)]), pa.array([chosen.tobytes()])], [f"{name}_ids", "dims", f"{name}_data"])

    clean = rows.where("id is not null and vector is not null").select("id", F.col("vector").cast("array<double>").alias("vector"))
    return materialize(clean.mapInArrow(pack, f"{name}_ids binary, dims long, {name}_data binary"), "blocks")


def nearest(queries: DataFrame, rows: DataFrame, k: int, digits: int = 3) -> DataFrame:
    """(a, b, similarity): for each query vector the k others with the highest cosine, rounded, the smaller id of equals.

    Both are (id, vector) with whole ids. Blocks of queries meet blocks of rows of as many dimensions, a matrix product for each such pair, of which
    only the best k of each query go on; so what is paired are blocks of ``BLOCK`` vectors, and what is ranked k rows for each query and block. A vector without
    length has no cosine.
    """
    scale = 10.0**digits

    def compare(batches):
        for batch in batches:
            out_a, out_b, out_s = [], [], []
            for qi, qd, ri, rd, d in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                a, b = np.frombuffer(qi, "i8"), np.frombuffer(ri, "i8")
                x, y = np.frombuffer(qd, "f8").reshape(len(a), d), np.frombuffer(rd, "f8").reshape(len(b), d)
                norms = np.outer(np.sqrt((x * x).sum(1)), np.sqrt((y * y).sum(1)))
                cosine = np.divide(x @ y.T, norms, out=np.full(norms.shape, -np.inf), where=norms > 0)
                with np.errstate(invalid="ignore"):
                    cosine = np.where(np.isfinite(cosine), np.sign(cosine) * np.floor(np.abs(cosine) * scale + 0.5) / scale, -np.inf)
                cosine[a[:, None] == b[None, :]] = -np.inf
                order = np.lexsort((np.broadcast_to(b, cosine.shape), -cosine))[:, :k]
                best = np.take_along_axis(cosine, order, 1)
                keep = np.isfinite(best)
                out_a.append(np.repeat(a, keep.sum(1)))
                out_b.append(b[order][keep])
                out_s.append(best[keep])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x or [np.zeros(0)]).astype(t)) for x, t in ((out_a, "i8"), (out_b, "i8"), (out_s, "f8"))], ["a", "b", "similarity"])

    pairs = _blocks(queries, "q").join(_blocks(rows, "r"), "dims").select("q_ids", "q_data", "r_ids", "r_data", "dims")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pairs.repartition(parts, F.xxhash64("q_ids", "r_ids")).mapInArrow(compare, "a long, b long, similarity double")
    w = Window.partitionBy("a").orderBy(F.col("similarity").desc(), F.col("b"))
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
