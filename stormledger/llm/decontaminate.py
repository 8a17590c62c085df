"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

The items are the collection and every passage of every training document is a query. Scores
are divided by the score an item gets from its own text, so one threshold fits short and long
items: it is the share of the item's BM25 weight that the passage covers.
"""

from __future__ import annotations

import heapq
import pickle
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Items, and bytes of their texts, that make one index; larger sets have several.
ITEMS_PER_INDEX, BYTES_PER_INDEX = 20_000, 8 << 20
#: Bytes of packed indexes that are broadcast together; the documents are read once for each such set.
BROADCAST_BYTES = 128 << 20
#: Share of any item's weight that its most frequent terms may hold to count as common.
COMMON_SHARE = 0.3
#: Items in a block whose largest weights bound it.
ITEM_BLOCK = 4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_WORDS = re.compile(rb"[a-z0-9\x80-\xff]+").findall


def terms(text: bytes | None) -> list[bytes]:
    """Lower-cased runs of letters (A-Z and all beyond ASCII) and digits."""
    return _WORDS((text or b"").translate(_LOWER))


@dataclass
class Index:
    """Postings by term, sorted by item, in blocks with the largest weight of each block."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    postings: list[tuple[list[int], list[float]]] = field(default_factory=list)
    block_last: list[list[int]] = field(default_factory=list)
    block_max: list[list[float]] = field(default_factory=list)
    most: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rare: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))
    # Per rare term the blocks of ITEM_BLOCK items that hold it and its largest weight in each, end to end.
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, "int64"))
    blocks: np.ndarray = field(default_factory=lambda: np.zeros(0, "int64"))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    common: np.ndarray = field(default_factory=lambda: np.zeros(0))  # most that common terms give an item of each block
    items: list[tuple[int, list[bytes], list[bytes], list[bytes]]] = field(default_factory=list)
    longest: int = 1


def build_index(items: list[tuple[int, str | None, str | None]], idf: dict[bytes, float], mean_len: float, k1: float = 1.2, b: float = 0.75, block: int = 32) -> Index:
    """Index of (item_id, question, answer). Items without words match nothing and are left out."""
    ix, found = Index(), {}
    for item_id, question, answer in sorted(items, key=lambda x: x[0]):
        q, a = (terms((t or "").encode()) for t in (question, answer))
        if not (w := q + a):
            continue
        n = len(ix.items)
        ix.items.append((item_id, q, a, w))
        ix.longest = max(ix.longest, len(w))
        tf: dict[bytes, int] = {}
        for t in w:
            tf[t] = tf.get(t, 0) + 1
        weight = {t: idf[t] * c * (k1 + 1) / (c + k1 * (1 - b + b * len(w) / mean_len)) for t, c in tf.items()}
        own = sum(weight.values())
        for t, x in weight.items():
            found.setdefault(t, []).append((n, x / own))
    for t, plist in found.items():
        ix.vocabulary[t] = len(ix.postings)
        ids, weights = [p for p, _ in plist], [w for _, w in plist]
        ix.postings.append((ids, weights))
        ix.block_last.append([ids[min(i + block, len(ids)) - 1] for i in range(0, len(ids), block)])
        ix.block_max.append([max(weights[i : i + block]) for i in range(0, len(ids), block)])
    ix.most = np.array([max(w) for _, w in ix.postings] + [0.0])
    # Terms in many items are common while no item has more than COMMON_SHARE of its weight in them.
    rare, mass, n_items = np.ones(len(ix.postings) + 1, bool), np.zeros(max(1, len(ix.items))), len(ix.items)
    rare[-1] = False  # stands for words of no item
    for t in sorted(range(len(ix.postings)), key=lambda t: -len(ix.postings[t][0])):
        ids, weights = ix.postings[t]
        if (mass[ids] + weights).max() > COMMON_SHARE:
            break
        mass[ids] += weights
        rare[t] = False
    ix.rare = rare
    n_blocks = max(1, -(-n_items // ITEM_BLOCK))
    ix.common = np.pad(mass, (0, n_blocks * ITEM_BLOCK - len(mass))).reshape(n_blocks, ITEM_BLOCK).max(1)
    first, blocks, tops = [0], [], []
    for t, (ids, weights) in enumerate(ix.postings):
        if rare[t]:
            top: dict[int, float] = {}
            for i, w in zip(ids, weights, strict=True):
                top[i // ITEM_BLOCK] = max(top.get(i // ITEM_BLOCK, 0.0), w)
            blocks += top
            tops += top.values()
        first.append(len(blocks))
    ix.first, ix.blocks, ix.weights = np.array(first), np.array(blocks, "int64"), np.array(tops)
    return ix


def passages_to_search(ix: Index, ids: np.ndarray, threshold: float) -> np.ndarray:
    """Numbers of the passages for which the block maxima of some block could add up to the threshold.

    ``ids`` are a text's term numbers. Passage k has the bins k and k + 1 of ``longest`` words. All passages
    and blocks are summed at once, each distinct term once for each bin.
    """
    bins, terms_, n_blocks = -(-len(ids) // ix.longest), len(ix.rare), len(ix.common)
    hit = np.flatnonzero(ix.rare[ids])
    key = np.unique(hit // ix.longest * terms_ + ids[hit])
    b, t = np.divmod(key, terms_)
    n = ix.first[t + 1] - ix.first[t]
    at = np.repeat(ix.first[t] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, "int64")
    total = np.bincount(np.repeat(b, n) * n_blocks + ix.blocks[at], ix.weights[at], (bins + 1) * n_blocks).reshape(bins + 1, n_blocks)
    upper = total[:-1] + total[1:] + ix.common
    could = (upper >= threshold - 1e-9).any(1)
    if bins > 1:
        could[-1] = False  # the last bin lies in the passage before
    return np.flatnonzero(could)


def block_max_wand(ix: Index, query: list[int], threshold: float, block: int = 32) -> list[tuple[int, float]]:
    """Every item whose score from the distinct query terms reaches the threshold.

    Lists are kept in order of their current item. The pivot is the first item that the lists'
    largest weights could lift to the threshold; the largest weights of the blocks around it
    decide whether it is scored, and if not, how far the lists may jump.
    """
    eps = 1e-12
    most, out = ix.most, []
    at = dict.fromkeys(query, 0)
    heap = [(ix.postings[t][0][0], t) for t in at]
    heapq.heapify(heap)

    def advance(t: int, target: int) -> None:
        ids, blocks = ix.postings[t][0], ix.block_last[t]
        i = at[t]
        k = i // block
        while k < len(blocks) and blocks[k] < target:
            k += 1
        i = max(i, k * block)
        while i < len(ids) and ids[i] < target:
            i += 1
        at[t] = i
        if i < len(ids):
            heapq.heappush(heap, (ids[i], t))

    while heap:
        lists, bound = [], 0.0
        while heap and bound < threshold - eps:
            item, t = heapq.heappop(heap)
            lists.append((item, t))
            bound += most[t]
        if bound < threshold - eps:
            break
        pivot = lists[-1][0]
        while heap and heap[0][0] == pivot:
            lists.append(heapq.heappop(heap))
        upper, until = 0.0, heap[0][0] if heap else 1 << 62
        for _, t in lists:
            blocks, k = ix.block_last[t], at[t] // block
            while k < len(blocks) and blocks[k] < pivot:
                k += 1
            if k < len(blocks):
                upper += ix.block_max[t][k]
                until = min(until, blocks[k] + 1)
        if upper < threshold - eps:
            target = max(pivot + 1, until)
            for _, t in lists:
                advance(t, target)
        elif lists[0][0] == pivot:
            score = sum(ix.postings[t][1][at[t]] for _, t in lists)
            if score >= threshold - eps:
                out.append((pivot, score))
            for _, t in lists:
                advance(t, pivot + 1)
        else:
            for _, t in lists:
                advance(t, pivot)
    return out


def _grams(w: list[bytes], n: int) -> set[tuple[bytes, ...]]:
    n = min(n, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def search_text(ix: Index, text: bytes | None, threshold: float, least_overlap: float, gram: int = 5, answer_gram: int = 3) -> list[tuple[int, float, float, float]]:
    """(item_id, score, question_overlap, answer_overlap) of the leaked items of one whole text.

    Passages have twice the longest item's length and overlap by half, so every run as long as
    an item lies inside one. A passage is searched only if the block maxima allow a hit (see
    ``passages_to_search``).
    """
    words = terms(text)
    if not words or not ix.items:
        return []
    none = len(ix.postings)
    get = ix.vocabulary.get
    ids = np.fromiter((get(w, none) for w in words), "int64", len(words))
    best: dict[int, tuple[float, float, float]] = {}
    for k in passages_to_search(ix, ids, threshold).tolist():
        s, e = k * ix.longest, min((k + 2) * ix.longest, len(words))
        query = np.unique(ids[s:e])
        query = query[query < none].tolist()
        for n, score in block_max_wand(ix, query, threshold):
            item_id, q, a, _ = ix.items[n]
            passage = words[s:e]
            grams = {}
            share = []
            for part, g in ((q, gram), (a, answer_gram)):
                g = min(g, len(part))
                if g not in grams:
                    grams[g] = _grams(passage, g) if g else set()
                own = _grams(part, g)
                share.append(len(own & grams[g]) / len(own) if own else 1.0)
            if min(share) >= least_overlap:
                best[item_id] = max(best.get(item_id, (0.0, 0.0, 0.0)), (float(score), *share))
    return [(i, *best[i]) for i in sorted(best)]


def with_parts(items: DataFrame, item_id: str = "item_id", text: str = "text", question: str | None = None, answer: str | None = None) -> DataFrame:
    """(item_id, question, answer): given columns, or the text cut so that its last quarter of words,
    three at least, stands for the answer. Repeated ids keep one text (the smallest)."""
    if question and answer:
        rows = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(question).alias("question"), F.col(answer).alias("answer"))
    else:
        w = F.split(F.trim(F.coalesce(F.col(text), F.lit(""))), r"\s+", -1)
        cut = F.greatest(F.size("__w") - F.greatest(F.lit(3), F.ceil(F.size("__w") / 4).cast("int")), F.lit(0))
        rows = items.select(F.col(item_id).cast("long").alias("item_id"), w.alias("__w")).select("item_id", F.array_join(F.slice("__w", F.lit(1), cut), " ").alias("question"), F.array_join(F.slice("__w", cut + 1, F.size("__w")), " ").alias("answer"))
    return rows.where("item_id is not null").groupBy("item_id").agg(F.min(F.struct("question", "answer")).alias("x")).select("item_id", "x.question", "x.answer")


def item_indexes(parts: DataFrame) -> DataFrame:
    """(block, data): the packed indexes of all items (item_id, question, answer), each built in a task.

    Document frequencies and the mean length are aggregated over all items; an item's weights travel with it.
    """
    spark = parts.sparkSession

    def count(batches):
        """(item_id, term) of the distinct terms of each item, and a row with an empty term for its length."""
        for b in batches:
            ids, found, sizes = [], [], []
            for item_id, q, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                w = terms((q or "").encode()) + terms((a or "").encode())
                for t in {*w, b""}:
                    ids.append(item_id)
                    found.append(t)
                    sizes.append(len(w))
            yield pa.RecordBatch.from_arrays([pa.array(ids, "int64"), pa.array(found, pa.binary()), pa.array(sizes, "int64")], ["item_id", "term", "n"])

    counted = materialize(parts.select("item_id", "question", "answer").mapInArrow(count, "item_id long, term binary, n long"), "terms")
    every = counted.where("length(term) = 0").agg(F.count(F.when(F.col("n") > 0, 1)).alias("items"), F.sum("n").alias("words")).first()
    size = parts.agg(F.count("*").alias("n"), F.sum(F.octet_length("question") + F.octet_length("answer")).alias("bytes")).first()
    n, words = every["items"] or 0, every["words"] or 0
    blocks = max(1, -(-size["n"] // ITEMS_PER_INDEX), -(-(size["bytes"] or 0) // BYTES_PER_INDEX))
    mean = words / max(1, n)
    frequency = counted.where("length(term) > 0").groupBy("term").agg(F.count("*").alias("k"))
    idf = frequency.select("term", F.log(1 + (n - F.col("k") + 0.5) / (F.col("k") + 0.5)).alias("idf"))
    per_item = counted.join(idf, "term").groupBy("item_id").agg(F.collect_list(F.struct("term", "idf")).alias("idfs"))
    rows = parts.join(per_item, "item_id").select("item_id", "question", "answer", "idfs", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).alias("block"))

    def build(key, pdf):
        import pandas as pd

        weights = {bytes(x["term"]): x["idf"] for row in pdf["idfs"] for x in row}
        ix = build_index(list(zip(pdf["item_id"].tolist(), pdf["question"], pdf["answer"], strict=True)), weights, mean)
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(vars(ix))]})

    return materialize(rows.groupBy("block").applyInPandas(build, "block long, data binary"), "index") if n else spark.createDataFrame([], "block long, data binary")


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.6, least_overlap: float = 0.5, **columns) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap) of every leak.

    Every passage of every whole text is searched. An item leaks into a document if a passage
    covers at least ``threshold`` of its BM25 weight and holds at least ``least_overlap`` of the
    5-grams of its question and of the 3-grams of its answer. Document frequencies and the mean
    length are counted over all items. The indexes are built in tasks (see ``item_indexes``) and broadcast in sets of a
    checked size, however large the benchmark is. Null or empty texts and
    items have no leaks, and neither has an empty table; rows that repeat an id are searched each.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = (pa.int64(), pa.int64(), *[pa.float64()] * 3)
    indexes = item_indexes(materialize(with_parts(items, **columns), "items"))
    sets: list[list[int]] = []
    held = BROADCAST_BYTES + 1
    for r in indexes.select("block", F.octet_length("data").alias("n")).orderBy("block").collect():  # a row for each index
        if held + r["n"] > BROADCAST_BYTES:
            sets.append([])
            held = 0
        sets[-1].append(r["block"])
        held += r["n"]
    out = spark.createDataFrame([], schema)
    for blocks in sets:
        shared = spark.sparkContext.broadcast([bytes(r["data"]) for r in indexes.where(F.col("block").isin(blocks)).select("data").collect()])

        def search(batches, shared=shared):
            held = [Index(**pickle.loads(x)) for x in shared.value]
            for b in batches:
                found = []
                for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()), strict=True):
                    found += [(doc_id, *leak) for ix in held for leak in search_text(ix, text.as_py(), threshold, least_overlap)]
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], kind) for k, kind in enumerate(kinds)], names)

        part = texts.mapInArrow(search, schema)
        out = part if blocks is sets[0] else out.unionByName(part)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents into which no item leaked, all columns unchanged. Rows with a null id stay."""
    gone = materialize(find_leaks(docs, items, **options).select(F.col("doc_id").alias("__gone")).where("__gone is not null").distinct(), "leaks")
    return docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti").select(*docs.columns)
