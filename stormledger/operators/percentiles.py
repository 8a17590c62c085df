"""Exact percentiles without a buffer for each group."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..storage import materialize


def percentiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """(keys, a column for each of ``shares``): exact percentiles, interpolated between the two values around the place.

    The values are range-sorted by key and value, so a key of any size fills many partitions, and each value's place is its place in the partition plus
    what earlier partitions hold of its key. Only the values at the places asked for go on. Null values don't count; a key without values has none.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    some = rows.select(*keys, F.col(value).cast("double").alias("__v"), F.monotonically_increasing_id().alias("__row")).where("__v is not null")
    ordered = some.repartitionByRange(parts, *keys, "__v", "__row").sortWithinPartitions(*keys, "__v", "__row")
    ordered = materialize(ordered.select(*keys, "__v", F.spark_partition_id().alias("__part"), place.alias("__i")), "ordered")
    pieces = ordered.groupBy("__part", *keys).agg(F.min("__i").alias("__first"), F.count("*").alias("__n"))  # a row for each key of a partition
    every = Window.partitionBy(*keys)
    before = every.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select("__part", *keys, (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"), F.sum("__n").over(every).alias("__total"))
    p, q = ordered.alias("p"), pieces.alias("q")
    same = F.col("p.__part") == F.col("q.__part")
    for c in keys:
        same = same & F.col(f"p.{c}").eqNullSafe(F.col(f"q.{c}"))
    placed = p.join(q, same).select(*(F.col(f"p.{c}").alias(c) for c in keys), "__v", (F.col("__i") + F.col("__shift")).alias("__at"), "__total")
    at = {name: F.lit(share) * (F.col("__total") - 1) for name, share in shares.items()}
    wanted = [F.col("__at").isin(F.floor(x), F.ceil(x)) for x in at.values()]
    kept = placed.where(F.array_contains(F.array(*wanted), True))
    out = kept.groupBy(*keys)
    pick = lambda x, end: F.max(F.when(F.col("__at") == end(x), F.col("__v")))
    aggregates = []
    for name, x in at.items():
        low, high, rest = pick(x, F.floor), pick(x, F.ceil), F.max(x - F.floor(x))
        aggregates.append((low + (high - low) * rest).alias(name))
    return out.agg(*aggregates)
