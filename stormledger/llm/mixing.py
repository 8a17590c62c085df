"""Mixing sources to target weights (native): a time-varying curriculum.

Each source has a share of the mix and a weight schedule over training time. The integral of
the schedule says how much of the source's demand has been met by a time. Its inverse gives the time at
which a document is due by its place in the source's token count; the demand of all sources
up to that time is its training position, in tokens. Documents are range-sorted by position.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import materialize, text_or_empty, words_of

#: Repeated in order of the sources.
WEIGHTS = (1, 2, 3)
#: No source, and so no document, is used more often.
MOST_REPEATS = 3
#: Weight of a source at the begin and the end of training, by the same cycle: early, level, late.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """(source, source_size, cycle, target) from rows of (source, size).

    All sizes are shared out by weight; a source stops at ``most`` times its size, and what is
    above goes to the others by weight. In order of size per weight the sources that stop come
    first, so running sums give the level without iterating. There is a row for each source,
    so the only window without a key sees as many rows as there are sources.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    cycle = (place % len(weights)).cast("int")
    ranked = per.select("source", "source_size", cycle.alias("cycle")).withColumn("w", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), F.col("cycle") + 1))
    fill = Window.orderBy(most * F.col("source_size") / F.col("w"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    cap = most * F.col("source_size").cast("double")
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing))
    open_ = ranked.withColumn("cap", cap).withColumn("level", level)
    final = F.max(F.when(F.col("cap") >= F.col("level") * F.col("w"), F.col("level"))).over(every)
    return open_.select("source", "source_size", "cycle", F.coalesce(F.least("cap", F.col("w") * final), F.col("cap")).alias("target"))


def _when(share: Column, begin: Column, end: Column) -> Column:
    """The time at which a linear schedule from begin to end has met this share of its integral."""
    slope = end - begin
    area = share * (begin + end) / 2
    return F.when(F.abs(slope) < 1e-12, share).otherwise((F.sqrt(F.greatest(begin * begin + 2 * slope * area, F.lit(0.0))) - begin) / slope)


def _met(time: Column, begin: float, end: float) -> Column:
    """The share of its integral that a linear schedule from begin to end has met at a time: the inverse of ``_when``."""
    return (begin * time + (end - begin) * time * time / 2) / ((begin + end) / 2)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, schedules=SCHEDULES, per_bin: int = 2048, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, positions) for each row of ``docs``, and the columns to ``keep``.

    Size counts the words of the whole text (null: 0). Within a source the documents are taken
    in the order of a hash of id, text and seed, whole passes first; the last, partial pass takes a
    document if more than half of it fits, so the words taken come within half a document of
    the target. ``positions`` has the training position of each copy, in tokens of the whole mix. An empty
    table gives an empty plan.

    Running sums are made in two steps, over bins of about ``per_bin`` documents and inside a
    bin, so a source with a third of all rows is no single group. Rows that repeat an id (or have none) are
    documents of their own; as the hash includes the text, they fall into many bins.
    """
    text = text_or_empty()
    sized = docs.select("doc_id", "source", *keep, F.size(words_of(text)).cast("long").alias("size"), F.xxhash64(F.lit(seed), "doc_id", text).alias("__h"))
    sized = materialize(sized, "sizes")
    goals = targets(sized, weights, most)
    rows = sized.count()
    bits = max(0, min(30, (rows // per_bin).bit_length()))
    bin_ = F.shiftrightunsigned(F.col("__h"), 64 - bits) if bits else F.lit(0).cast("long")
    # The order of bins must be that of the hash as unsigned.
    binned = sized.withColumn("__b", bin_).withColumn("__o", F.col("__h").bitwiseXOR(F.lit(-(1 << 63)).cast("long")))
    sums = binned.groupBy("source", "__b").agg(F.sum("size").alias("__s"))
    ahead = Window.partitionBy("source").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__s").over(ahead), F.lit(0))).drop("__s")
    every = Window.partitionBy(F.lit(0))  # a row for each source
    kinds = range(len(schedules))
    demand = {f"__d{k}": F.coalesce(F.sum(F.when(F.col("cycle") % len(schedules) == k, F.col("target"))).over(every), F.lit(0.0)) for k in kinds}
    goals = goals.withColumns(demand)
    info = sums.join(goals, sums["source"].eqNullSafe(goals["source"])).select(sums["source"].alias("__source"), F.col("__b").alias("__bin"), "__ahead", "source_size", "cycle", "target", *demand)
    inside = Window.partitionBy("source", "__b").orderBy("__o", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    counted = binned.withColumn("__in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    full = counted.join(info, counted["source"].eqNullSafe(info["__source"]) & (counted["__b"] == info["__bin"]))
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(most))).otherwise(0).cast("int")
    at = F.col("__ahead") + F.col("__in")
    rest = F.col("target") - F.col("__passes") * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("__passes") < most) & (F.col("__at") + F.col("size") / 2 <= F.col("__rest"))
    copies = F.when(F.col("size") > 0, F.col("__passes") + F.when(more, 1).otherwise(0)).otherwise(0)
    pick = lambda k: F.element_at(F.array(*(F.lit(float(s[k])) for s in schedules)), F.col("cycle") % len(schedules) + 1)
    share = lambda i: F.least((i * F.col("source_size") + F.col("__at") + F.col("size") / 2) / F.greatest("target", F.lit(1e-9)), F.lit(1.0))
    made = full.withColumn("__passes", passes).withColumn("__at", at).withColumn("__rest", rest).withColumn("__copies", copies)
    none = F.array().cast("array<double>")
    times = F.when(F.col("__copies") > 0, F.transform(F.sequence(F.lit(0), F.col("__copies") - 1), lambda i: _when(share(i), pick(0), pick(1)))).otherwise(none)
    # One schedule is shared by all sources of a cycle, so the demand of all sources is a sum over the schedules.
    tokens = lambda t: sum((F.col(f"__d{k}") * _met(t, *map(float, schedules[k])) for k in kinds), F.lit(0.0))
    made = made.withColumn("__times", times).withColumn("positions", F.transform("__times", tokens))
    return made.select("doc_id", counted["source"], *keep, "size", "source_size", "target", (F.col("size") * F.col("__copies")).cast("long").alias("taken"), "positions")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: a row for each copy taken, all columns of ``docs`` and ``mix_position`` (one of that name is replaced),
    range-sorted by position (ties by id). Documents without words are not taken.

    The rows are numbered as they are written to the shared folder, and meet their positions by that number, so
    rows that repeat an id, or are equal throughout, are each taken as often as the plan says.
    """
    rows = materialize(docs.drop("mix_position").withColumn("__row", F.monotonically_increasing_id()), "numbered")
    plan = plan_mix(rows, keep=("__row",), **options).where("size(positions) > 0").select("__row", F.explode("positions").alias("mix_position"))
    return rows.join(plan, "__row").drop("__row").select(*(c for c in docs.columns if c != "mix_position"), "mix_position").orderBy("mix_position", "doc_id")
