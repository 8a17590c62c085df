"""SimHash fingerprints: signed-bit votes of weighted term hashes, and searches among them.

The main path is DataFrame code throughout. A text's terms are hashed with XXH64 (seed 42, Spark's
``xxhash64``); bit k of the fingerprint is set when the terms with that bit outweigh half of
the total weight. Equal texts have equal fingerprints; a null or blank text has fingerprint 0.
"""

from __future__ import annotations

import itertools
import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, spread

BITS = 64


def votes(weight: str | None = None, h: str = "h") -> list[Column]:
    """Aggregates ``__n`` and ``__c0`` to ``__c31`` over rows of term hashes.

    Each sum carries two counters, for bit k in its lower and for bit k+32 in its upper half.
    Neither can run over: a string has less than 2^31 bytes, and no term weighs more than its
    letters. A null hash stands for a row without terms.
    """
    pair = F.lit(0x100000001).cast("long")
    bits = [F.shiftright(F.col(h), k).bitwiseAND(pair) for k in range(BITS // 2)]
    if weight is None:
        return [F.count(h).alias("__n"), *(F.sum(b).alias(f"__c{k}") for k, b in enumerate(bits))]
    w = F.col(weight)
    return [F.coalesce(F.sum(w), F.lit(0)).alias("__n"), *(F.coalesce(F.sum(b * w), F.lit(0)).alias(f"__c{k}") for k, b in enumerate(bits))]


def decide(n: Column, counters: list[Column]) -> Column:
    """The fingerprint: bits with more than half of the total weight."""
    fp = F.lit(0).cast("long")
    for k, c in enumerate(counters):
        for bit, count in ((k, c.bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))), (k + BITS // 2, F.shiftrightunsigned(c, 32))):
            fp = fp.bitwiseOR(F.when(count * 2 > n, F.lit(signed(1 << bit)).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits, 0 to 1."""
    return (F.lit(BITS) - F.bit_count(a.bitwiseXOR(b))) / F.lit(float(BITS))


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


# --- permuted block tables -------------------------------------------------------------------


def block_masks(radius: int, blocks: int | None = None) -> list[int]:
    """Masks of the permuted block tables for a Hamming radius.

    The 64 bits are cut into ``blocks`` blocks; fingerprints that differ in at most ``radius``
    bits agree on at least ``blocks - radius`` whole blocks, so a table for each choice of that
    many blocks finds every such pair.
    """
    blocks = blocks or radius + 2
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    part = [sum(1 << b for b in range(lo, hi)) for lo, hi in itertools.pairwise(edges)]
    return [signed(sum(c)) for c in itertools.combinations(part, blocks - radius)]


def covering_masks(radius: int, seed: int = 20160) -> list[int]:
    """2^(radius+1) - 1 structured masks: each pair within the radius agrees under at least one.

    Every bit position gets a random vector of radius+1 bits. The mask of a nonzero vector v
    looks at the positions whose inner product with v is 1. At most ``radius`` differing
    positions leave some nonzero v orthogonal to all their vectors, and that table looks at
    none of them, so the pair meets there for certain.
    """
    rng = random.Random(seed)
    vectors = [rng.randrange(1, 1 << (radius + 1)) for _ in range(BITS)]
    return [signed(sum(1 << p for p, x in enumerate(vectors) if (x & v).bit_count() % 2)) for v in range(1, 1 << (radius + 1))]


def bucketed(points: DataFrame, masks: list[int]) -> DataFrame:
    """(id, fp, t, key, n): each point in the bucket of every table, with the bucket's size; lone points are left out."""
    tables = points.select("id", "fp", F.posexplode(F.array(*(F.lit(m).cast("long") for m in masks))).alias("t", "m")).select("id", "fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    count = tables.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    return tables.join(spread(count), ["t", "key"])


def bucket_pairs(members: DataFrame, radius: int, *flags: str) -> DataFrame:
    """(t, u, v, fu, fv), u > v, and the flags of both: the pairs within the radius of each bucket. For buckets of a bounded size only."""
    side = lambda x: members.select("t", "key", F.col("id").alias(x), F.col("fp").alias(f"f{x}"), *(F.col(f).alias(f"{f}_{x}") for f in flags))
    near = F.bit_count(F.col("fu").bitwiseXOR(F.col("fv"))) <= radius
    return side("u").join(spread(side("v")), ["t", "key"]).where((F.col("u") > F.col("v")) & near).drop("key")


def flips(radius: int) -> list[int]:
    """Every mask of at most ``radius`` bits."""
    return [signed(sum(1 << b for b in c)) for r in range(radius + 1) for c in itertools.combinations(range(BITS), r)]


def named_values(points: DataFrame, radius: int) -> DataFrame:
    """(id, value): each point with every value within the radius of its fingerprint."""
    every = F.array(*(F.lit(x).cast("long") for x in flips(radius)))
    return points.select("id", F.explode(F.transform(every, lambda x: x.bitwiseXOR(F.col("fp")))).alias("value"))


def links_within(points: DataFrame, radius: int, masks: list[int], small: int = 64, middle: int = 1 << 16) -> DataFrame:
    """Links (u, v) among distinct fingerprints (id, fp) such that two fingerprints are connected
    by links if and only if they are connected by steps of at most ``radius`` bits.

    Each link returned is itself within the radius, but not every pair within the radius is a link: the links connect what
    the pairs connect. Buckets of up to ``small`` members are compared pair by pair. Beyond, members name the values near
    them: two fingerprints within r bits share a value within r // 2 bits of the one and r - r // 2 of the other, so all
    that name a value are linked to the smallest that names it from within r // 2. That is linear in the members; as a
    radius above 2 takes many values for each member (2,081 for radius 4), buckets of up to ``middle`` members are compared
    in blocks instead (see ``_block_links``), with at most ``middle`` / 1024 copies of a member, which is far less.
    The members are written out once, as each of the three searches would otherwise shuffle every table anew.
    """
    members = materialize(bucketed(points, masks), "members")
    found = bucket_pairs(members.where(F.col("n") <= small), radius).select("u", "v")
    many = members.where(F.col("n") > small)
    if radius > 2:
        found = found.unionByName(_block_links(many.where(F.col("n") <= middle), radius))
        many = many.where(F.col("n") > middle)
    hot = many.select("id", "fp").distinct()
    low = named_values(hot, radius // 2).groupBy("value").agg(F.min("id").alias("v"))
    stars = named_values(hot, radius - radius // 2).join(spread(low), "value").where("id != v").select(F.greatest("id", "v").alias("u"), F.least("id", "v").alias("v"))
    return found.unionByName(stars).distinct()


def near_counts(points: DataFrame, masks: list[int], small: int = 64) -> DataFrame:
    """(id, links): how many other distinct fingerprints (id, fp) lie within two bits of each, exactly; rows without any are left out.

    ``masks`` are tables in which every pair within two bits meets. Pairs of buckets of up to ``small`` members are
    counted in the first table in which they meet. Members of larger buckets name their own value and the 64 at one
    bit: two that are one or two bits apart share exactly two values, so the counts of the values add up to twice the
    links among such members, and 65 for the member itself. No pair of a large bucket is made.
    """
    members = bucketed(points, masks).withColumn("hot", F.max("n").over(Window.partitionBy("id")) > small)
    few = members.where(F.col("n") <= small)
    hot = members.where("hot").select("id", "fp").distinct()
    flagged = bucket_pairs(few, 2, "hot")
    first = F.array_min(F.filter(F.array(*(F.when(F.col("fu").bitwiseXOR(F.col("fv")).bitwiseAND(F.lit(m).cast("long")) == 0, F.lit(k)) for k, m in enumerate(masks))), lambda x: x.isNotNull()))
    pairs = flagged.where(~(F.col("hot_u") & F.col("hot_v")) & (F.col("t") == first)).select(F.explode(F.array("u", "v")).alias("id"))
    named = named_values(hot, 1)
    times = named.groupBy("value").agg(F.count("*").alias("k"))
    hot_counts = named.join(spread(times), "value").groupBy("id").agg(((F.sum("k") - 65) / 2).cast("long").alias("links"))
    cold_counts = pairs.groupBy("id").agg(F.count("*").alias("links"))
    return hot_counts.unionByName(cold_counts).groupBy("id").agg(F.sum("links").alias("links")).where("links > 0")


def _block_links(many: DataFrame, radius: int, block: int = 1024) -> DataFrame:
    """Spanning forests of large buckets, from block against block.

    A bucket of n members is dealt into ceil(n / block) blocks and each pair of blocks is one
    group: a task holds two blocks, never a bucket, and returns fewer links than it has rows.
    Closest links are taken first, so the forest connects what any threshold up to the radius would.
    """
    import numpy as np
    import pandas as pd

    parts = F.ceil(F.col("n") / block).cast("int")
    dealt = many.select("t", "key", "id", "fp", parts.alias("parts")).withColumn("x", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    pairs = dealt.select("t", "key", "id", "fp", "x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y")).select("t", "key", "id", "fp", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q"))

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        ids, fps = pdf["id"].to_numpy(), pdf["fp"].to_numpy().astype(np.uint64)
        dist = np.bitwise_count(fps[:, None] ^ fps[None, :])
        root = list(range(len(ids)))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        out = []
        for d in range(radius + 1):
            for i in range(len(ids)):
                if len(out) == len(ids) - 1:
                    break
                for j in np.flatnonzero(dist[i, i + 1 :] == d) + i + 1:
                    if (x := find(i)) != (y := find(int(j))):
                        root[x] = y
                        out.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return pairs.groupBy("t", "key", "p", "q").applyInPandas(forest, "u long, v long")
