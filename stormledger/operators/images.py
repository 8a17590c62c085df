"""Image forensics on 64-bit hashes and metadata; the pictures themselves are hashed elsewhere."""

from __future__ import annotations

import math
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import haversine_m
from ..policy import POLICY, Policy
from ..storage import materialize, spread


def from_hex(h: Column) -> Column:
    """A 16-digit hex hash as a signed long."""
    return F.conv(h, 16, -10).cast("long")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(from_hex(a).bitwiseXOR(from_hex(b)))


def lookalikes(images: DataFrame, exact: bool = False, policy: Policy = POLICY) -> DataFrame:
    """(a, b, distance) of images (image_id, sha256, phash) with one content or near hashes, a > b.

    Near hashes are looked up by their first three digits, which misses neighbours that differ there; ``exact`` uses
    eleven 5- to 6-bit blocks instead, one of which two hashes within ten bits must share.
    """
    one = images.select("image_id", "sha256", F.lower("phash").alias("phash"))
    keys = F.array(F.concat(F.lit("s"), F.col("sha256")), F.concat(F.lit("p"), F.substring("phash", 1, 3)))
    if exact:
        edges = [64 * i // 11 for i in range(12)]
        block = lambda i: F.shiftrightunsigned(F.shiftleft(from_hex(F.col("phash")), 64 - edges[i + 1]), 64 - edges[i + 1] + edges[i])
        keys = F.array(F.concat(F.lit("s"), F.col("sha256")), *(F.concat(F.lit(f"b{i}:"), block(i).cast("string")) for i in range(11)))
    keyed = one.withColumn("key", F.explode(F.array_compact(keys)))
    a = keyed.select("key", F.col("image_id").alias("a"), F.col("sha256").alias("sa"), F.col("phash").alias("pa"))
    b = keyed.select("key", F.col("image_id").alias("b"), F.col("sha256").alias("sb"), F.col("phash").alias("pb"))
    pairs = a.join(b, "key").where("a > b").select("a", "b", F.when(F.col("sa") == F.col("sb"), 0).otherwise(hamming(F.col("pa"), F.col("pb"))).alias("distance"))
    return pairs.where(F.col("distance") <= policy.image_hamming).distinct()


def reuse(pairs: DataFrame, reports: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(id, verdict) of reports with a lookalike in another report: CONTRADICTS if one is more than two days or 50 km away, else NEUTRAL.

    ``pairs`` has (id, other) report ids, ``reports`` (id, lat, lon, occurred_at).
    """
    side = lambda s: reports.select(F.col("id").alias(s), F.col("lat").alias(f"lat_{s}"), F.col("lon").alias(f"lon_{s}"), F.unix_timestamp("occurred_at").alias(f"t_{s}"))
    both = pairs.where("id != other").join(side("id"), "id").join(side("other"), "other")
    far = (F.abs(F.col("t_id") - F.col("t_other")) > policy.evidence_window_s) | (haversine_m("lat_id", "lon_id", "lat_other", "lon_other") > policy.image_far_m)
    return both.groupBy("id").agg(F.when(F.bool_or(far), "CONTRADICTS").otherwise("NEUTRAL").alias("verdict"))


#: A hash of zeros stands for a picture that could not be read.
NO_HASH = "0" * 16
_AXES = ("x", "y", "z")


def classes(images: DataFrame) -> DataFrame:
    """``images`` (image_id, sha256, phash, ...) with ``class_id``: pictures of one content or one perceptual hash are one class.

    A picture without a readable hash takes that of another with its content, else its content is its class; with neither it has none.
    """
    phash = F.lower(F.when(F.col("phash") != NO_HASH, F.col("phash")))
    known = images.where("sha256 is not null").groupBy("sha256").agg(F.min(phash).alias("__known"))
    return images.join(known, "sha256", "left").withColumn("class_id", F.coalesce(phash, "__known", F.concat(F.lit("s"), "sha256"))).drop("__known")


def near_classes(classed: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(a, b, distance): pairs of classes a < b whose hashes differ in at most ten bits. All of them are found.

    Ten differences over four blocks of 16 bits leave a block with two at most, so the pair shares one of the 17 values within a bit of that block:
    each class is looked up under 68 keys, whatever the number of its pictures. Candidates are about a sixtieth of what all pairs would be.
    """
    if policy.image_hamming > 11:
        raise ValueError("four blocks of one bit each find pairs of at most eleven differences")
    one = classed.where(~F.col("class_id").startswith("s")).select(F.col("class_id").alias("h")).distinct().withColumn("v", from_hex(F.col("h")))
    flips = F.array(F.lit(0), *(F.lit(1 << i) for i in range(16)))
    block = lambda i: F.shiftrightunsigned("v", 16 * i).bitwiseAND(F.lit(0xFFFF))
    beside = lambda i: F.transform(flips, lambda f: F.struct(F.lit(i).alias("i"), block(i).bitwiseXOR(f.cast("long")).alias("k")))
    keys = F.flatten(F.array(*map(beside, range(4))))
    keyed = one.select("h", "v", F.explode(keys).alias("key"))
    a, b = (keyed.select("key", F.col("h").alias(n), F.col("v").alias(f"v{n}")) for n in "ab")
    distance = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    return a.join(spread(b), "key").where((F.col("a") < F.col("b")) & (distance <= policy.image_hamming)).select("a", "b", distance.alias("distance")).distinct()


def _unit(lat: str, lon: str) -> dict[str, Column]:
    a, o = F.radians(lat), F.radians(lon)
    return {"x": F.cos(a) * F.cos(o), "y": F.cos(a) * F.sin(o), "z": F.sin(a)}


def reused(classed: DataFrame, reports: DataFrame, policy: Policy = POLICY) -> DataFrame:
    """(image_id, id, verdict): CONTRADICTS if the picture, or one within ten bits, is in a report more than two days or 50 km away, else NEUTRAL.

    ``classed`` is ``classes`` of images with their report ``id``; ``reports`` has (id, lat, lon, occurred_at), unknown ones null and then
    not compared. No pair of copies is made. Each class keeps the first and last time and the six outermost points of its reports, and takes in
    those of its near classes. A report far from one of them is settled, and so is one whose distance to the corners of their box is small enough;
    only reports in between meet the distinct points of their classes.
    """
    placed = materialize(classed.where("class_id is not null").join(spread(reports.select("id", "lat", "lon", F.unix_timestamp("occurred_at").alias("t"))), "id").select("image_id", "id", "class_id", "lat", "lon", "t"), "images")
    unit = _unit("lat", "lon")
    outer = [f(F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.struct(unit[c].alias("v"), "lat", "lon"))).alias(f"{n}_{c}") for c in _AXES for n, f in (("low", F.min), ("high", F.max))]
    own = materialize(placed.groupBy("class_id").agg(F.min("t").alias("t_low"), F.max("t").alias("t_high"), *outer), "image-classes")
    near = materialize(near_classes(placed, policy).select("a", "b"), "image-links")
    links = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(own.select(F.col("class_id").alias("a"), F.col("class_id").alias("b")))
    edges = [c for c in own.columns if c != "class_id"]
    reach = links.join(spread(own), F.col("b") == F.col("class_id")).groupBy(F.col("a").alias("class_id")).agg(*((F.min if "low" in c else F.max)(c).alias(c) for c in edges))
    far_time = ((F.col("t") - F.col("t_low")) > policy.evidence_window_s) | ((F.col("t_high") - F.col("t")) > policy.evidence_window_s)
    far_place = reduce(or_, (F.coalesce(haversine_m("lat", "lon", f"{n}_{c}.lat", f"{n}_{c}.lon") > policy.image_far_m, F.lit(False)) for c in _AXES for n in ("low", "high")))
    corner = reduce(add, (F.pow(F.greatest(F.abs(unit[c] - F.col(f"low_{c}.v")), F.abs(unit[c] - F.col(f"high_{c}.v"))), 2) for c in _AXES))
    # A hair less than the square of the chord of 50 km, so that rounding settles nothing.
    chord = (2 * math.sin(policy.image_far_m / policy.earth_radius_m / 2)) ** 2 * (1 - 1e-9)
    far = F.coalesce(far_time, F.lit(False)) | far_place
    state = placed.join(spread(reach), "class_id").select("image_id", "id", "class_id", "lat", "lon", far.alias("far"), (~far & F.coalesce(corner > chord, F.lit(False))).alias("open"))
    state = materialize(state, "image-reach")
    points = placed.where("lat is not null and lon is not null").select(F.col("class_id").alias("b"), F.col("lat").alias("lat2"), F.col("lon").alias("lon2")).distinct()
    asked = state.where("open").select(F.col("class_id").alias("a"), "lat", "lon").distinct()
    hit = asked.join(links, "a").join(points, "b").where(haversine_m("lat", "lon", "lat2", "lon2") > policy.image_far_m).select(F.col("a").alias("class_id"), "lat", "lon").distinct().withColumn("hit", F.lit(True))
    return state.join(spread(hit), ["class_id", "lat", "lon"], "left").select("image_id", "id", F.when(F.col("far") | F.coalesce("hit", F.lit(False)), "CONTRADICTS").otherwise("NEUTRAL").alias("verdict"))


def time_check(taken: Column, claimed: Column) -> Column:
    hours = F.abs(F.unix_timestamp(taken) - F.unix_timestamp(claimed)) / 3600
    return F.when(hours.isNull(), "NEUTRAL").when(hours <= 3, "SUPPORTS").when(hours > 24, "CONTRADICTS").otherwise("NEUTRAL")


def place_check(km: Column) -> Column:
    return F.when(km.isNull(), "NEUTRAL").when(km <= 15, "SUPPORTS").when(km > 50, "CONTRADICTS").otherwise("NEUTRAL")


def verdict(checks: Column, cap: float = 0.05) -> Column:
    """{verdict, adjustment} of an image from its checks: any denial counts 0.03 each, two supports 0.015 each."""
    n = lambda kind: F.size(F.filter(checks, lambda x: x == kind))
    against, for_ = n("CONTRADICTS"), n("SUPPORTS")
    kind = F.when(against > 0, "CONTRADICTS").when(for_ >= 2, "SUPPORTS").otherwise("NEUTRAL")
    return F.struct(kind.alias("verdict"), F.when(against > 0, F.greatest(-0.03 * against, F.lit(-cap))).when(for_ >= 2, F.least(0.015 * for_, F.lit(cap))).otherwise(0.0).alias("adjustment"))


def report_adjustment(findings: DataFrame, cap: float = 0.05) -> DataFrame:
    """(id, adjustment): -cap with a denial among a report's images, +cap if all support, else 0."""
    denied, all_for = F.bool_or(F.col("verdict") == "CONTRADICTS"), F.bool_and(F.col("verdict") == "SUPPORTS")
    return findings.groupBy("id").agg(F.when(denied, -cap).when(all_for, cap).otherwise(0.0).alias("adjustment"))
