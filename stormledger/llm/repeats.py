"""Repeated windows of a corpus, found exactly by super-k-mer partitioning.

A window is ``width`` consecutive units (words or bytes) of one document. The minimiser of a window
is its gram (a shorter run of units) with the smallest hash, so equal windows have equal
minimisers at equal places. Consecutive windows that share a minimiser form a super-k-mer, which travels
as one packed string to the bucket of that minimiser; windows are compared there, unit by unit.

1. Every document names the hashes of its minimisers. Each batch names a hash once, with a mark
   if it has it twice, so a hash that a third of all documents hold costs a row for each
   batch. Buckets answer which hashes occur more than once; no window under another hash
   can repeat.
2. The documents meet their answers and send the super-k-mers under repeated hashes, again
   once for each batch: other copies in the batch are known to start later.
3. Buckets keep the earliest of equal super-k-mers, compare the windows of those that differ, and
   name the ranges that an earlier window covers.
4. The documents meet their ranges.

Hashes only decide what is compared. Both meetings are joins on the id, and share one
shuffle of the texts. No step collects a document's, a bucket's or a group's rows outside a
task, and a bucket's super-k-mers are resolved in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of text whose hashes are scanned at once (so that they stay in a core's cache), and bytes of text that make a batch.
SCAN = 1 << 18
CHUNK = 1 << 20
#: Bytes of super-k-mers whose windows are compared together.
RESOLVE = 1 << 15
#: Buckets for each shuffle partition: so many that partitions get about as many each.
BUCKETS = 8
#: Ids from here on stand for null ids, after all others: one for each text (by its hash).
NULL_IDS = (1 << 63) - 1 - (1 << 40)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    if base not in _POWERS or len(_POWERS[base]) < n:
        x = np.full(max(n, 2 * SCAN), base, "u8")
        x[0] = 1
        _POWERS[base] = np.cumprod(x, dtype="u8")
    return _POWERS[base][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end], equal for equal runs wherever they stand."""
    n = len(data)
    total = np.zeros(n + 1, "u8")
    np.cumsum((data.astype("u8") + np.uint64(1)) * powers(_BASE, n), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(_BACK, n + 1)[starts])


class Units(Protocol):
    width: int
    gram: int

    def cut(self, text: bytes, most: int) -> Iterator[tuple[int, bytes]]:
        """(first unit, piece) of a long text; neighbours overlap by width - 1 units."""

    def units(self, data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(gram hashes, starts, ends, unit edges) of texts that lie between byte edges."""

    def resolve(self, contents: list[bytes], owners: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
        """(content, first, last) runs of windows that also start earlier, among distinct super-k-mers."""


def super_kmers(gram_hash: np.ndarray, edges: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser's hash) of every super-k-mer; places count units over all texts."""
    n = len(gram_hash)
    none = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "u8")
    if n < width:
        return none
    ends = np.repeat(edges[1:], np.diff(edges))
    at = np.arange(n, dtype="i8")
    key = (gram_hash & np.uint64(0xFFFFFFFF00000000)) | at.astype("u8")
    low, span, w = key, 1, width - gram + 1
    while span * 2 <= w:
        low = np.minimum(low[: len(low) - span], low[span:])
        span *= 2
    if span < w:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    low = low[: n - width + 1]
    place = (low & np.uint64(0xFFFFFFFF)).astype("i8")
    valid = at[: len(low)] + width <= ends[: len(low)]
    change = np.ones(len(low) + 1, bool)
    change[1:-1] = (place[1:] != place[:-1]) | (valid[1:] != valid[:-1])
    first = np.flatnonzero(change)
    first, last = first[:-1], first[1:]
    keep = valid[first]
    first, last = first[keep], last[keep]
    return first, last - first, gram_hash[place[first]]


class Chunk:
    """Some pieces of texts side by side, and their super-k-mers."""

    def __init__(self, units: Units, pieces: list[tuple[int, int, bytes]]):
        self.doc = np.array([d for d, _, _ in pieces], "i8")
        self.offset = np.array([o for _, o, _ in pieces], "i8")
        sizes = [len(t) for _, _, t in pieces]
        self.raw = b"".join(t for _, _, t in pieces)
        edges = np.concatenate(([0], np.cumsum(sizes))).astype("i8")
        gram_hash, self.starts, self.ends, unit_edges = units.units(np.frombuffer(self.raw, "u1"), edges)
        self.first, self.windows, self.hash = super_kmers(gram_hash, unit_edges, units.width, units.gram)
        self.piece = np.searchsorted(unit_edges, self.first, "right") - 1
        self.place = self.first - unit_edges[self.piece] + self.offset[self.piece]  # first unit in the document
        self.width = units.width

    def content(self, i: int) -> bytes:
        return self.raw[self.starts[self.first[i]] : self.ends[self.first[i] + self.windows[i] + self.width - 2]]


def chunks(units: Units, rows: Iterator[tuple[int, bytes]]) -> Iterator[Chunk]:
    held, size = [], 0
    for doc, text in rows:
        for offset, piece in units.cut(text, 4 * CHUNK) if len(text) > 4 * CHUNK else [(0, text)]:
            held.append((doc, offset, piece))
            size += len(piece)
            if size >= SCAN:
                yield Chunk(units, held)
                held, size = [], 0
    if held:
        yield Chunk(units, held)


def _texts(batches) -> Iterator[tuple[int, bytes]]:
    for b in batches:
        for doc, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
            yield doc, text.as_py() or b""


def _packed(rows: list[tuple], names: str, kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * len(kinds), kinds, strict=True)], names.split())


def _groups(key: np.ndarray) -> Iterator[tuple[int, slice]]:
    """(value, slice) of the runs of a sorted array."""
    if len(key):
        edges = np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield key[a], slice(a, b)


def _repeated_hashes(texts: DataFrame, units: Units, parts: int) -> DataFrame:
    """(id, hashes): for each document the hashes of its minimisers that occur elsewhere too."""
    buckets = parts * BUCKETS
    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    names = "bucket id hashes marks base docs"
    schema = "bucket long, id long, hashes binary, marks binary, base long, docs binary"

    def asked(h, doc):
        order = np.argsort(h, kind="stable")
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        which = np.cumsum(new) - 1
        twice = np.bincount(which, minlength=int(new.sum())) > 1
        known = twice[which]
        kd, kh = doc[known], h[known]
        by = np.argsort(kd, kind="stable")
        kd, kh = kd[by], kh[by]
        rows = [(int(d) % buckets, int(d), np.unique(kh[s]).tobytes(), None, None, None) for d, s in _groups(kd)]
        h, doc = h[new], doc[new]
        bucket = (h % np.uint64(buckets)).astype("i8")
        by = np.argsort(bucket, kind="stable")
        h, doc, twice = h[by], doc[by], twice[by]
        for k, s in _groups(bucket[by]):
            base = int(doc[s].min())
            away = doc[s] - base
            rows.append((int(k), None, h[s].tobytes(), twice[s].tobytes(), base, away.astype(np.min_scalar_type(int(away.max()))).tobytes()))
        return _packed(rows, names, kinds)

    def ask(batches):
        held, size = [], 0
        for c in chunks(units, _texts(batches)):
            held.append((c.hash, c.doc[c.piece]))
            size += len(c.raw)
            if size >= CHUNK:
                yield asked(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
        if held:
            yield asked(*map(np.concatenate, zip(*held, strict=True)))

    def answer(batches):
        key, held = None, []

        def flush():
            if not held:
                return
            h = np.concatenate([x for x, _, _ in held])
            marks = np.concatenate([x for _, x, _ in held])
            doc = np.concatenate([x for _, _, x in held])
            order = np.argsort(h, kind="stable")
            h, marks, doc = h[order], marks[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = h[1:] != h[:-1]
            which = np.cumsum(new) - 1
            many = (np.bincount(which) > 1)[which] & ~marks  # those marked know already
            h, doc = h[many], doc[many]
            by = np.argsort(doc, kind="stable")
            rows = [(int(d), h[by][s].tobytes()) for d, s in _groups(doc[by])]
            for i in range(0, len(rows), 10_000):
                yield _packed(rows[i : i + 10_000], "id hashes", [pa.int64(), pa.binary()])

        for b in batches:
            replies = []
            for bucket, doc, hashes, marks, base, docs in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                if doc is not None:
                    replies.append((doc, hashes))
                    continue
                if bucket != key:
                    yield from flush()
                    key, held = bucket, []
                h = np.frombuffer(hashes, "u8")
                away = np.frombuffer(docs, f"u{len(docs) // len(h)}")
                held.append((h, np.frombuffer(marks, bool), away.astype("i8") + base))
            if replies:
                yield _packed(replies, "id hashes", [pa.int64(), pa.binary()])
        yield from flush()

    dealt = texts.mapInArrow(ask, schema).repartition(parts, "bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(answer, "id long, hashes binary").groupBy("id").agg(F.collect_list("hashes").alias("hashes"))


def repeated_ranges(texts: DataFrame, units: Units, parts: int) -> DataFrame:
    """(id, start, end): ranges of units, end exclusive, covered by windows that also start earlier.

    ``texts`` has (id, text); earlier means a smaller id, or the same id and a smaller start.
    """
    hits = _repeated_hashes(texts, units, parts).withColumnRenamed("id", "__hit")
    names = "key id start windows content"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    schema = "key long, id long, start long, windows long, content binary"
    met = texts.join(hits, texts["id"] == hits["__hit"]).select("id", "text", "hashes")

    def send(batches):
        first: dict[bytes, tuple[int, int, int, int]] = {}
        size, later = 0, []

        def out():
            rows = [(h, d, p, w, c) for c, (h, d, p, w) in first.items()] + later
            for i in range(0, len(rows), 5_000):
                yield _packed(rows[i : i + 5_000], names, kinds)

        def texts_of(b):
            return zip(b.column(0).to_pylist(), ((t.as_py() or b"") for t in b.column(1).cast(pa.binary())), strict=True)

        for b in batches:
            wanted = dict(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True))
            lists = np.concatenate([np.frombuffer(x, "u8") for v in wanted.values() for x in v] or [np.zeros(0, "u8")])
            any_of = np.unique(lists)
            for c in chunks(units, texts_of(b)):
                # A hash repeated for one document of this batch is repeated for all of them.
                for i in np.flatnonzero(np.isin(c.hash, any_of)):
                    content, mine = c.content(i), (int(c.hash[i].astype("i8")), int(c.doc[c.piece[i]]), int(c.place[i]), int(c.windows[i]))
                    had = first.get(content)
                    if had is None:
                        first[content] = mine
                        size += len(content) + 200
                    elif had[1:3] != mine[1:3]:
                        if mine[1:3] < had[1:3]:
                            first[content], mine = mine, had
                        later.append((None, *mine[1:], None))
                        size += 60
                if size > 16 * CHUNK:
                    yield from out()
                    first, size, later = {}, 0, []
        yield from out()

    def settle(batches):
        """Rows come sorted by key; those without one are ranges already."""
        held: dict[bytes, tuple[int, int]] = {}
        ready: list[list[tuple[bytes, tuple[int, int]]]] = []
        key, size, ranges = None, 0, []

        def close():
            nonlocal held, size
            if len(held) > 1:
                ready.append(list(held.items()))
                size += sum(map(len, held))
            held = {}

        def resolved():
            nonlocal ready, size
            pairs = [x for group in ready for x in group]
            owners = [o for _, o in pairs]
            for i, a, b in units.resolve([c for c, _ in pairs], owners) if pairs else ():
                ranges.append((owners[i][0], owners[i][1] + a, owners[i][1] + b + units.width))
            ready, size = [], 0

        for batch in batches:
            for k, doc, start, windows, content in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
                if k is None:
                    ranges.append((doc, start, start + windows - 1 + units.width))
                    continue
                if k != key:
                    close()
                    key = k
                    if size > RESOLVE:
                        resolved()
                mine, had = (doc, start), held.get(content)
                if had is None:
                    held[content] = mine
                elif had != mine:
                    if mine < had:
                        held[content], mine = mine, had
                    ranges.append((*mine, mine[1] + windows - 1 + units.width))
            if len(ranges) > 10_000:
                yield _packed(ranges, "id start end", kinds[:3])
                ranges = []
        close()
        resolved()
        yield _packed(ranges, "id start end", kinds[:3])

    sent = met.mapInArrow(send, schema)
    dealt = sent.repartition(parts, F.coalesce("key", F.xxhash64("id", "start"))).sortWithinPartitions("key")
    return dealt.mapInArrow(settle, "id long, start long, end long")


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Ranges that overlap or touch, joined."""
    order = np.argsort(starts, kind="stable")
    out: list[list[int]] = []
    for a, b in zip(starts[order].tolist(), ends[order].tolist(), strict=True):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, units: Units, report: Callable[[bytes, list[tuple[int, int]]], tuple], columns: str, names: list[str], kinds: list) -> DataFrame:
    """(doc_id, ...) with a row for each row of ``docs``: ``report`` of each whole text and its removed ranges.

    A null text is empty. Documents with a null id come last. Rows that share an id count as one
    document: a window at the same place under the same id isn't earlier, and what is removed is
    removed from each, as far as it goes.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # The last literal tells the planner that ids are never null, so both joins share one shuffle of the texts.
    texts = texts.select(F.coalesce("id", F.lit(NULL_IDS) + F.pmod(F.xxhash64("text"), F.lit(1 << 40)), F.lit(0)).alias("id"), "text")
    ranges = repeated_ranges(texts, units, parts)
    ranges = ranges.groupBy(F.col("id").alias("__range")).agg(F.collect_list("start").alias("starts"), F.collect_list("end").alias("ends"))

    def finish(batches):
        for b in batches:
            rows = []
            for doc, text, starts, ends in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), b.column(2), b.column(3), strict=True):
                spans = merged(np.array(starts.as_py(), "i8"), np.array(ends.as_py(), "i8")) if starts.is_valid else []
                rows.append((None if doc >= NULL_IDS else doc, *report(text.as_py() or b"", spans)))
            yield _packed(rows, " ".join(["doc_id", *names]), [pa.int64(), *kinds])

    met = texts.join(ranges, texts["id"] == ranges["__range"], "left").select("id", "text", "starts", "ends")
    return met.mapInArrow(finish, f"doc_id long, {columns}")
