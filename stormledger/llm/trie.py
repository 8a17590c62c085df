"""Conversation prefix trie by preorder intervals.

A conversation is a path from the root, a node for each distinct sequence of first turns. Distinct paths are ranked
lexicographically, by their turns' digests; a node's first path has the smallest rank of its members. Ordered by (rank of the first path,
depth) the nodes stand in preorder, and a node's subtree is the interval that ends with the last node of its last path. So its leaves
and its savings are differences of running sums, which are made by range-sorted partition.

Turns become 16-byte digests before anything is shuffled. Paths travel as packed blocks of ``BLOCK`` turns, so a conversation of any length
is some bounded rows, and blocks are ranked by doubling (which takes no round where every conversation fits into one). Copies of a
conversation are one path with a weight.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import materialize

KEY = 16
BLOCK = 256
#: Conversations share first turns by groups of so many ids; the first of a group lends fewer than LENT turns.
GROUP, LENT = 5, 9
#: Ids that are joined into one string at once.
IDS = 1 << 15
ROOT = bytes(KEY)


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def lent(conv_id: int) -> int:
    """How many turns conversation ``conv_id`` takes from the first of its group."""
    return zlib.crc32(str(conv_id).encode()) % LENT


def running(df: DataFrame, by: list[str], sums: tuple[str, ...], name: str) -> DataFrame:
    """``df`` range-sorted by some columns, with ``position`` (from 0) and for each of ``sums``, whole numbers from 0 up, the running sum ``to_<column>``.

    Each partition sums for itself as it is written to the shared folder; the sums of the partitions before it are added when it is read. Only a
    row for each partition comes to the driver.
    """
    ordered = df.repartitionByRange(_parts(df), *by).sortWithinPartitions(*by).withColumn("__part", F.spark_partition_id())

    def add(batches):
        position, carried = 0, [0] * len(sums)
        for b in batches:
            columns = [pa.array(np.arange(position, position + b.num_rows))]
            position += b.num_rows
            for i, c in enumerate(sums):
                total = np.cumsum(b.column(c).to_numpy(zero_copy_only=False).astype("i8")) + carried[i]
                carried[i] = int(total[-1]) if len(total) else carried[i]
                columns.append(pa.array(total))
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], [*b.schema.names, "position", *(f"to_{c}" for c in sums)])

    added = ["position", *(f"to_{c}" for c in sums)]
    schema = T.StructType([*ordered.schema.fields, *(T.StructField(c, T.LongType()) for c in added)])
    done = materialize(ordered.mapInArrow(add, schema), name)
    ends = {r["__part"]: r for r in done.groupBy("__part").agg((F.max("position") + 1).alias("position"), *(F.max(c).alias(c) for c in added[1:])).collect()}
    before: list[list[int]] = [[] for _ in added]
    total = [0] * len(added)
    for p in range(max(ends, default=-1) + 1):
        for i, c in enumerate(added):
            before[i].append(total[i])
            total[i] += ends[p][c] if p in ends else 0
    return done.select(*df.columns, *((F.col(c) + F.get(F.lit(before[i]), F.col("__part")) if ends else F.col(c)).alias(c) for i, c in enumerate(added)))


def pieces_of(turns: DataFrame) -> DataFrame:
    """(conv, start, n, keys, sizes): each conversation's turns in order, packed at most ``BLOCK`` to a row; ``start`` counts the turns before.

    Turns are range-sorted by conversation, turn (null first) and digest, so one with a third of all turns fills many partitions.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * KEY))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", digest.alias("key"), F.octet_length(text).cast("long").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = materialize(rows, "turns")
    order = ["conv", "turn", "key", "row"]
    ordered = rows.repartitionByRange(_parts(rows), *order).sortWithinPartitions(*order).select("conv", "key", "size", (F.spark_partition_id().cast("long") * (1 << 33)).alias("at"))
    names = ["conv", "at", "n", "keys", "sizes"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]

    def pack(batches):
        seen = 0
        for b in batches:
            conv, size = b.column(0).to_numpy(), b.column(2).to_numpy()
            keys = b.column(1).to_pylist()
            base = int(b.column(3)[0].as_py()) if b.num_rows else 0
            cuts = np.flatnonzero(np.diff(conv, prepend=-1 if not len(conv) else conv[0] - 1))
            out = []
            for a, e in zip(cuts.tolist(), np.append(cuts[1:], len(conv)).tolist(), strict=True):
                for i in range(a, e, BLOCK):
                    j = min(e, i + BLOCK)
                    out.append((int(conv[a]), base + seen, j - i, b"".join(keys[i:j]), size[i:j].tobytes()))
                    seen += 1
            yield _packed(out, names, kinds)

    packed = materialize(ordered.mapInArrow(pack, "conv long, at long, n long, keys binary, sizes binary"), "pieces")
    before = Window.partitionBy("conv").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    return packed.select("conv", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"), "n", "keys", "sizes")


def _packed(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def rebuilt(pieces: DataFrame) -> DataFrame:
    """(conv, block, n, keys, ids, sizes, above, last): the rebuilt conversations in blocks.

    The first ``lent`` turns come from the first conversation of the group (all if fewer, none if it is absent), the others are the own ones after as
    many. A turn's id is the digest of all turns up to it; ``above`` is the id before the block, ``last`` the id of the whole in its last block.
    Every conversation has a block, be it empty.
    """
    heads = pieces.where((F.col("start") < LENT - 1) & (F.col("conv") % GROUP == 0)).select(
        F.col("conv").alias("first"), F.struct("start", F.substring("keys", 1, KEY * LENT).alias("keys"), F.substring("sizes", 1, 8 * LENT).alias("sizes")).alias("head")
    )
    heads = heads.groupBy("first").agg(F.array_sort(F.collect_list("head")).alias("head"))  # at most LENT turns
    # Only the first piece of a conversation meets the lent turns.
    opened = pieces.withColumn("__first", F.when(F.col("start") == 0, F.col("conv") - F.col("conv") % GROUP))
    met = opened.join(heads, opened["__first"] == heads["first"], "left").select("conv", "start", "keys", "sizes", "head")
    ordered = met.repartition(_parts(pieces), "conv").sortWithinPartitions("conv", "start")
    names = ["conv", "block", "n", "keys", "ids", "sizes", "above", "last"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 5]

    def chain(batches):
        conv, take, block, state, above = None, 0, 0, ROOT, ROOT
        keys: list[bytes] = []
        ids: list[bytes] = []
        sizes: list[bytes] = []
        out = []

        def close(last):
            out.append((conv, block, len(keys), b"".join(keys), b"".join(ids), b"".join(sizes), above, last))

        for b in batches:
            for c, start, k, s, head in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if c != conv:
                    if conv is not None:
                        close(state)
                    conv, take, block, state, above = c, lent(c), 0, ROOT, ROOT
                    keys, ids, sizes = [], [], []
                skip = max(0, take - start)
                k = b"".join(h["keys"] for h in head or ())[: KEY * take] + k[KEY * skip :]
                s = b"".join(h["sizes"] for h in head or ())[: 8 * take] + s[8 * skip :]
                for i in range(len(k) // KEY):
                    if len(keys) == BLOCK:
                        close(None)
                        block, above = block + 1, state
                        keys, ids, sizes = [], [], []
                    key = k[KEY * i : KEY * i + KEY]
                    state = hashlib.sha256(state + key).digest()[:KEY]
                    keys.append(key)
                    ids.append(state)
                    sizes.append(s[8 * i : 8 * i + 8])
                if len(out) >= 1024:
                    yield _packed(out, names, kinds)
                    out = []
        if conv is not None:
            close(state)
        yield _packed(out, names, kinds)

    return materialize(ordered.mapInArrow(chain, "conv long, block long, n long, keys binary, ids binary, sizes binary, above binary, last binary"), "rebuilt")


def endings(blocks: DataFrame) -> DataFrame:
    """(last, first, n, ids): the conversations that end in each node, ascending, comma-joined, at most ``IDS`` to a row.

    Sorted by range of node and id, so a conversation with any number of copies is spread over partitions.
    """
    ordered = blocks.where("last is not null").select("last", "conv").repartitionByRange(_parts(blocks), "last", "conv").sortWithinPartitions("last", "conv")

    def join(batches):
        held: list[int] = []
        node, out = None, []

        def close():
            if held:
                out.append((node, held[0], len(held), ",".join(map(str, held))))

        for b in batches:
            for last, conv in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if last != node or len(held) == IDS:
                    close()
                    node, held = last, []
                held.append(conv)
            yield _packed(out, ["last", "first", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])
            out = []
        close()
        yield _packed(out, ["last", "first", "n", "ids"], [pa.binary(), pa.int64(), pa.int64(), pa.string()])

    return materialize(ordered.mapInArrow(join, "last binary, first long, n long, ids string"), "endings")


def digests(ends: DataFrame) -> DataFrame:
    """(last, ends_sha256): SHA-256 of the joined ids of each node. The joined pieces are fed to the hash as they come."""
    ordered = ends.select("last", "first", "ids").repartition(_parts(ends), "last").sortWithinPartitions("last", "first")

    def digest(batches):
        node, state, out = None, None, []
        for b in batches:
            for last, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if last == node:
                    state.update(b",")
                else:
                    if node is not None:
                        out.append((node, state.hexdigest()))
                    node, state = last, hashlib.sha256()
                state.update(ids.encode())
            yield _packed(out, ["last", "ends_sha256"], [pa.binary(), pa.string()])
            out = []
        yield _packed([(node, state.hexdigest())] if node is not None else [], ["last", "ends_sha256"], [pa.binary(), pa.string()])

    return ordered.mapInArrow(digest, "last binary, ends_sha256 string")


def ranks(paths: DataFrame) -> DataFrame:
    """(conv, rank): lexicographic ranks of distinct paths, from their blocks (conv, block, keys).

    Blocks get names that sort as they do; then pairs of neighbouring stretches of blocks get names, each round of twice as many, until
    one name covers the longest path. A missing stretch sorts first, so a path comes before those that go on from it.
    """

    def name(rows: DataFrame, by: list[str]) -> DataFrame:
        return running(rows.select(*by).distinct(), by, (), "names").withColumnRenamed("position", "name")

    named = paths.join(name(paths, ["keys"]), "keys").select("conv", "block", "name")
    most, span = paths.agg(F.max("block")).first()[0] or 0, 1
    while span <= most:
        named = materialize(named, "stretches")
        after = named.select("conv", (F.col("block") - span).alias("block"), F.col("name").alias("next")).where("block >= 0")
        pairs = named.join(after, ["conv", "block"], "left").select("conv", "block", F.col("name").alias("here"), F.coalesce("next", F.lit(-1).cast("long")).alias("next"))
        pairs = materialize(pairs, "stretches")
        named = pairs.join(name(pairs, ["here", "next"]), ["here", "next"]).select("conv", "block", "name")
        span *= 2
    return named.where("block = 0").select("conv", F.col("name").alias("rank"))


def nodes_of(paths: DataFrame) -> DataFrame:
    """(id, parent, conv_id, depth, size, n_convs, lo, hi): the distinct nodes of weighted, ranked paths.

    ``size`` is the bytes of a node's last text, ``lo`` and ``hi`` the ranks of its first and last path.
    """
    names = ["id", "parent", "conv", "depth", "size", "weight", "rank"]
    kinds = [pa.binary(), pa.binary(), *[pa.int64()] * 5]

    def spread(batches) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for conv, block, ids, sizes, above, weight, rank in zip(*(b.column(i).to_pylist() for i in range(7)), strict=True):
                if block == 0:
                    out.append((ROOT, None, conv, 0, 0, weight, rank))
                for i, size in enumerate(np.frombuffer(sizes, "i8").tolist()):
                    node = ids[KEY * i : KEY * i + KEY]
                    out.append((node, above, conv, block * BLOCK + i + 1, size, weight, rank))
                    above = node
                if len(out) >= 10_000:
                    yield _packed(out, names, kinds)
                    out = []
            yield _packed(out, names, kinds)

    rows = paths.select("conv", "block", "ids", "sizes", "above", "weight", "rank").mapInArrow(spread, "id binary, parent binary, conv long, depth long, size long, weight long, rank long")
    # A node's depth, parent and size are the same in all its rows.
    return rows.groupBy("id").agg(
        F.max("parent").alias("parent"), F.min("conv").alias("conv_id"), F.max("depth").alias("depth"), F.max("size").alias("size"), F.sum("weight").alias("n_convs"), F.min("rank").alias("lo"), F.max("rank").alias("hi")
    )


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, preorder, subtree_end) for each node of the
    trie of the rebuilt conversations (see ``rebuilt``).

    ``conv_id`` is the smallest member, n_convs counts members, n_leaves and saved_tokens sum up the subtree: childless nodes, and
    (n_convs - 1) times the bytes of a node's last text. ends_sha256 covers the ids of the conversations that end in the node. ``preorder`` is the place in
    preorder, ``subtree_end`` the last place of the subtree.

    A null role or text counts as empty, a null turn comes first, and turns of equal number are ordered by their digests. Rows without conv_id belong to no
    conversation and are left out. Equal rows are turns of their own. Other columns are not read, whatever their names; an empty table has no nodes.
    """
    blocks = rebuilt(pieces_of(conversations))
    ends = endings(blocks)
    contents = ends.groupBy("last").agg(F.min("first").alias("rep"), F.sum("n").alias("weight"))
    reps = materialize(contents.select("rep", "weight"), "representatives")
    paths = materialize(blocks.join(reps, blocks["conv"] == reps["rep"]).select("conv", "block", "keys", "ids", "sizes", "above", "weight"), "paths")
    ranked = ranks(paths).withColumnRenamed("conv", "__conv")
    nodes = materialize(nodes_of(paths.join(ranked, paths["conv"] == ranked["__conv"])), "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("__of")).agg(F.count("*").alias("n_children"))
    own = (F.col("n_convs") - 1) * F.col("size")
    full = nodes.join(children, nodes["id"] == children["__of"], "left").select(*nodes.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), own.alias("saved"))
    placed = running(full.withColumn("leaf", _flag(F.col("n_children") == 0)), ["lo", "depth"], ("leaf", "saved"), "preorder")
    to = placed.groupBy(F.col("lo").alias("__path")).agg(F.max("position").alias("subtree_end"), F.max("to_leaf").alias("__leaf"), F.max("to_saved").alias("__saved"))
    inside = placed.join(to, placed["hi"] == to["__path"])
    summed = inside.select("id", "parent", "conv_id", "depth", "n_convs", "n_children", (F.col("__leaf") - F.col("to_leaf") + F.col("leaf")).alias("n_leaves"), (F.col("__saved") - F.col("to_saved") + F.col("saved")).alias("saved_tokens"), F.col("position").alias("preorder"), "subtree_end")
    found = digests(ends)
    ended = summed.join(found, summed["id"] == found["last"], "left").drop("last")
    above = nodes.select(F.col("id").alias("__id"), F.col("conv_id").alias("parent_conv_id"))
    full = ended.join(above, ended["parent"] == above["__id"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"), "preorder", "subtree_end")


def _flag(test: Column) -> Column:
    return F.when(test, 1).otherwise(0).cast("long")
