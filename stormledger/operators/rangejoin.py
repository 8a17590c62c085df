"""Joins in space and time, by grid cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.geo import haversine_m
from ..storage import materialize, spread

METRES_PER_DEGREE = 111_190.0
#: Where a row lies in place and time.
CELL = ("__x", "__y", "__z")


def _seconds(c: str) -> Column:
    return F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)


class Grid:
    """Cells as high as a reach, or ``times`` as high; each band of latitude is cut into cells at least as wide as that is at its end nearer to
    the pole, around the whole globe, so neighbours across the 180th meridian and at any latitude meet."""

    keys = ("__x", "__y")

    def __init__(self, radius_m: float, times: int = 1):
        self.reach = radius_m / METRES_PER_DEGREE
        self.times, self.dlat = times, times * self.reach

    def _band(self, lat: Column) -> Column:
        return F.floor(lat / F.lit(self.dlat))

    def _around(self) -> Column:
        """How many cells the row's band (__y) has."""
        edge = F.greatest(F.abs(F.col("__y") * self.dlat), F.abs((F.col("__y") + 1) * self.dlat)) + self.dlat
        wide = 1.01 * self.dlat / F.greatest(F.cos(F.radians(F.least(edge, F.lit(90.0)))), F.lit(1e-9))
        return F.greatest(F.floor(360.0 / wide), F.lit(1))

    @staticmethod
    def _column(lon: Column) -> Column:
        return F.floor((lon + 180.0) * F.col("__n") / 360.0)

    def single(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """Placed rows with the cell they lie in."""
        out = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("__y", self._band(F.col(lat))).withColumn("__n", self._around())
        return out.withColumn("__x", F.pmod(self._column(F.col(lon)), F.col("__n"))).drop("__n")

    def copied(self, rows: DataFrame, lat: str, lon: str) -> DataFrame:
        """Placed rows, once for each cell that their reach touches."""
        out = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull())
        out = out.withColumn("__y", F.explode(F.sequence(self._band(F.col(lat) - self.reach), self._band(F.col(lat) + self.reach)))).withColumn("__n", self._around())
        width = 360.0 / F.col("__n") / self.times
        spread = F.sequence(self._column(F.col(lon) - width), self._column(F.col(lon) + width))
        return out.withColumn("__x", F.explode(F.array_distinct(F.transform(spread, lambda x: F.pmod(x, F.col("__n")))))).drop("__n")


def near_pairs(left: DataFrame, right: DataFrame, radius_m: float, window_s: int | None = None, condition: Column | None = None, few: bool = False, times: int = 1, cells: bool = False) -> DataFrame:
    """Pairs of rows within a radius and, if there is one, a time window.

    ``left`` has (llat, llon, lt) and ``right`` (rlat, rlon, rt), and any other columns; the result
    adds ``distance_m`` and ``delta_s`` (right minus left). Without a window lt and rt aren't read. Rows without place or time have no pairs.

    Both sides get the cell of their place and time; each right row is copied to the cells that its own
    reach touches, so the join is an equi-join that AQE can split where a cell is hot. The exact tests stay. The copies are never broadcast,
    unless ``right`` is known to have ``few`` rows.

    Cells ``times`` as large take fewer copies and test more pairs. A left row lies in one cell (``CELL``), kept with ``cells``: what is asked of each left
    row can be asked of each cell and left row, where its pairs are.
    """
    grid = Grid(radius_m, times)
    a, b = grid.single(left, "llat", "llon"), grid.copied(right, "rlat", "rlon")
    keys = list(grid.keys)
    keep = F.col("distance_m") <= radius_m
    if window_s is not None:
        cell = lambda v: F.floor(v / F.lit(float(times * window_s)))
        a = a.where("lt is not null").withColumn("__ls", _seconds("lt")).withColumn("__z", cell(F.col("__ls")))
        b = b.where("rt is not null").withColumn("__rs", _seconds("rt")).withColumn("__z", F.explode(F.sequence(cell(F.col("__rs") - window_s), cell(F.col("__rs") + window_s))))
        keys.append("__z")
    pairs = a.join(b if few else spread(b), keys).withColumn("distance_m", haversine_m("llat", "llon", "rlat", "rlon"))
    if window_s is not None:
        pairs, keep = pairs.withColumn("delta_s", F.col("__rs") - F.col("__ls")), (F.abs("delta_s") <= window_s) & (F.abs(F.col("rlat") - F.col("llat")) <= 1.01 * grid.reach) & keep
    if condition is not None:
        keep = condition & keep
    return pairs.where(keep).drop(*(() if cells else keys), "__ls", "__rs")


def newest_near(left: DataFrame, right: DataFrame, radius_m: float, window_s: int, k: int, slot_s: int = 3600) -> DataFrame:
    """For each left row (lid, llat, llon, lt) the newest k right rows (rid, rlat, rlon, rt) within a radius and a time window: (lid, rid, rt).

    Right rows are lists by cell, newest first (see ``newest_within`` for how they are counted). A left row knows which part of the list of
    each cell in its reach lies in its window, and reads k rows of each. A cell is done when its part is read, or when what it gave last is older than the
    k-th row found so far; only left rows with other cells read on, twice as many rows in each round. So a metropolis costs a
    left row a few times k rows, and not all that happened there. Of rows at one moment the largest rid counts.
    """
    grid = Grid(radius_m)
    cell = list(grid.keys)
    moment = lambda c: F.floor(c / F.lit(float(slot_s)))
    none = lambda name, of: F.lit(None).cast(of.schema[name].dataType).alias(name)
    r = grid.single(right.where("rt is not null"), "rlat", "rlon").select(*cell, F.lit(1).alias("__is"), "rid", "rlat", "rlon", "rt", none("lid", left), none("llat", left), none("llon", left), _seconds("rt").alias("__s"))
    ask = grid.copied(left.where("lt is not null"), "llat", "llon")
    at = lambda kind, s: ask.select(*cell, F.lit(kind).alias("__is"), none("rid", right), none("rlat", right), none("rlon", right), F.lit(None).cast("timestamp").alias("rt"), "lid", "llat", "llon", s.alias("__s"))
    # In the order of the list the end of a window (0) stands before the rows of its moment (1), its begin (2) behind them.
    both = r.unionByName(at(0, _seconds("lt") + window_s)).unionByName(at(2, _seconds("lt") - window_s)).withColumn("__z", moment(F.col("__s")))
    one = F.when(F.col("__is") == 1, 1).otherwise(0)
    inside = Window.partitionBy(*cell, "__z").orderBy(F.col("__s").desc(), "__is", F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*cell).orderBy(F.col("__z").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy(*cell, "__z").agg(F.sum(one).alias("__n")).withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0))).drop("__n")
    placed = materialize(both.withColumn("__in", F.sum(one).over(inside)).join(spread(slots), [*cell, "__z"]).withColumn("__p", F.col("__later") + F.col("__in")).drop("__in", "__later", "__z"), "lists")
    lists = placed.where("__is = 1").select(*cell, "__p", "rid", "rlat", "rlon", "rt")
    when = lambda kind: F.max(F.when(F.col("__is") == kind, F.col("__p")))
    asks = placed.where("__is != 1").groupBy(*cell, "lid", "llat", "llon").agg(when(0).alias("__from"), when(2).alias("__to")).where("__from < __to")
    newest = Window.partitionBy("lid").orderBy(F.col("rt").desc(), F.col("rid").desc())
    best, step = None, k
    while True:
        asks = materialize(asks, "asks")
        rows = asks.withColumn("__p", F.explode(F.sequence(F.col("__from") + 1, F.least(F.col("__to"), F.col("__from") + step)))).join(spread(lists), [*cell, "__p"])
        rows = materialize(rows.select(*cell, "lid", "rid", "rt", (haversine_m("llat", "llon", "rlat", "rlon") <= radius_m).alias("__near")), "read")
        near = rows.where("__near").select("lid", "rid", "rt")
        every = near if best is None else best.unionByName(near)
        best = materialize(every.withColumn("__r", F.row_number().over(newest)).where(F.col("__r") <= k), "newest").drop("__r")
        kth = best.groupBy("lid").agg(F.count("*").alias("__n"), F.min("rt").alias("__kth")).where(F.col("__n") >= k).select(F.col("lid").alias("__l"), "__kth")
        last = rows.groupBy(*cell, "lid").agg(F.min("rt").alias("__last"))
        rest = asks.where(F.col("__from") + step < F.col("__to")).join(spread(last), [*cell, "lid"])
        asks = rest.join(spread(kth), F.col("lid") == F.col("__l"), "left").where(F.col("__kth").isNull() | (F.col("__last") >= F.col("__kth"))).select(*cell, "lid", "llat", "llon", (F.col("__from") + step).alias("__from"), "__to")
        if asks.isEmpty():
            return best
        step *= 2


def newest_within(left: DataFrame, right: DataFrame, keys: list[str], window_s: int, k: int, slot_s: int = 3600) -> DataFrame:
    """For each left row (lid, keys, lt) the newest k right rows (rid, keys, rt) at most ``window_s`` away in time: (lid, rid, rt).

    Right rows are counted from the newest on: their place in a slot of time, and behind it the later slots of the key.
    A left row's first match is the place of the end of its window, so its matches are the k places that follow. The k rows behind each
    place that is asked for are looked up once, by an equi-join, and are one list for all left rows of that place; so what is shuffled are left rows and
    lists of at most k, and not their pairs. Only the counts of a key's slots meet in one task.
    """
    moment = lambda c: F.floor(c / F.lit(float(slot_s)))
    r = right.where("rt is not null").select(*keys, F.lit(1).alias("__is"), "rid", "rt", F.lit(None).cast(left.schema["lid"].dataType).alias("lid"), _seconds("rt").alias("__s"))
    at = left.where("lt is not null").select(*keys, F.lit(0).alias("__is"), F.lit(None).cast(right.schema["rid"].dataType).alias("rid"), F.lit(None).cast("timestamp").alias("rt"), "lid", (_seconds("lt") + window_s).alias("__s"))
    both = r.unionByName(at).dropna(subset=keys).withColumn("__z", moment(F.col("__s")))
    inside = Window.partitionBy(*keys, "__z").orderBy(F.col("__s").desc(), "__is", F.col("rid").desc()).rowsBetween(Window.unboundedPreceding, 0)
    later = Window.partitionBy(*keys).orderBy(F.col("__z").desc()).rowsBetween(Window.unboundedPreceding, -1)
    slots = both.groupBy(*keys, "__z").agg(F.sum("__is").alias("__n")).withColumn("__later", F.coalesce(F.sum("__n").over(later), F.lit(0))).drop("__n")
    placed = materialize(both.withColumn("__in", F.sum("__is").over(inside)).join(spread(slots), [*keys, "__z"]).withColumn("__p", F.col("__later") + F.col("__in")).drop("__in", "__later", "__z"), "places")
    asked = placed.where("__is = 0").select(*keys, "lid", F.col("__s").alias("__end"), F.col("__p").alias("__from"))
    given = placed.where("__is = 1").select(*keys, "__p", F.struct("rid", "rt", "__s").alias("__x"))
    starts = asked.select(*keys, "__from").distinct().withColumn("__p", F.explode(F.sequence(F.col("__from") + 1, F.col("__from") + k)))
    lists = starts.join(spread(given), [*keys, "__p"]).groupBy(*keys, "__from").agg(F.collect_list("__x").alias("__list"))
    inside_window = F.filter("__list", lambda x: x["__s"] >= F.col("__end") - 2 * window_s)
    return asked.join(spread(lists), [*keys, "__from"]).select("lid", F.explode(inside_window).alias("__x")).select("lid", "__x.rid", "__x.rt")


def latest_before(left: DataFrame, right: DataFrame, keys: list[str], window_s: int, values: list[str]) -> DataFrame:
    """``left`` (keys, lt and any columns) with the ``values`` of the last right row (keys, rt, values) within ``window_s`` of lt, either way;
    left rows without one are dropped. ``values`` are an order too: of right rows at one moment the largest counts.

    An as-of join: both sides are sorted together in slots of the window's length, and each slot also holds the
    last right row of each of the two slots before it, so nothing is paired, and a hot key is split by time.
    """
    slot = lambda c: F.floor(c / F.lit(float(window_s)))
    seen = F.struct(F.col("__s").alias("s"), *values)
    r = right.where("rt is not null").withColumn("__s", _seconds("rt")).select(*keys, "__s", slot(F.col("__s")).alias("__z"), seen.alias("__seen"))
    carried = r.groupBy(*keys, "__z").agg(F.max("__seen").alias("__seen")).select(*keys, F.explode(F.array(F.col("__z") + 1, F.col("__z") + 2)).alias("__z"), F.col("__seen.s").alias("__s"), "__seen")
    rows = left.where("lt is not null").withColumn("__s", _seconds("lt") + window_s).withColumn("__z", slot(F.col("__s"))).withColumn("__q", F.struct(*left.columns))
    every = r.unionByName(carried).unionByName(rows.select(*keys, "__s", "__z", "__q"), allowMissingColumns=True)
    before = Window.partitionBy(*keys, "__z").orderBy("__s", F.col("__q").isNotNull(), "__seen").rowsBetween(Window.unboundedPreceding, 0)
    last = every.withColumn("__last", F.last("__seen", ignorenulls=True).over(before)).where(F.col("__q").isNotNull())
    return last.where(F.col("__last.s") >= F.col("__s") - 2 * window_s).select("__q.*", *(F.col(f"__last.{v}").alias(v) for v in values))


def in_window(left: DataFrame, right: DataFrame, window_s: int, keys: list[str], condition: Column | None = None) -> DataFrame:
    """Pairs with equal keys whose times (lt, rt) are at most ``window_s`` apart, with ``delta_s``."""
    seconds = lambda c: F.unix_micros(F.col(c).cast("timestamp")) / F.lit(1e6)
    a = left.withColumn("__ls", seconds("lt")).withColumn("__z", F.floor(F.col("__ls") / window_s))
    b = right.where("rt is not null").withColumn("__rs", seconds("rt"))
    b = b.withColumn("__z", F.explode(F.sequence(F.floor((F.col("__rs") - window_s) / window_s), F.floor((F.col("__rs") + window_s) / window_s))))
    pairs = a.join(spread(b), [*keys, "__z"]).withColumn("delta_s", F.col("__rs") - F.col("__ls")).where(F.abs("delta_s") <= window_s)
    return (pairs if condition is None else pairs.where(condition)).drop("__z", "__ls", "__rs")


def joined_spans(spans: DataFrame, keys: list[str], begin: str, end: str) -> DataFrame:
    """(keys, begin, end): the spans of each key, those that overlap or touch joined into one."""
    before = Window.partitionBy(*keys).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy(begin, end).rowsBetween(Window.unboundedPreceding, 0)
    new = spans.distinct().withColumn("__new", F.when(F.col(begin) <= F.max(end).over(before), 0).otherwise(1))
    return new.withColumn("__nth", F.sum("__new").over(upto)).groupBy(*keys, "__nth").agg(F.min(begin).alias(begin), F.max(end).alias(end)).drop("__nth")


def top(pairs: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k of each key by a total order, with ``rank`` and ``truncated``: whether there are more.

    One row more than k is kept for the flag, so the sort stops early inside each partition.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k + 1)
    more = F.max("rank").over(Window.partitionBy(*keys)) > k
    return ranked.withColumn("truncated", more).where(F.col("rank") <= k)
