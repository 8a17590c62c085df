"""Document fingerprints (native): SimHash of weighted words, and searches in block tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import ascii_lower, materialize, text_or_empty, words_of
from .simhash import block_masks, decide, likeness, near_counts, votes


def _weight(word: str):
    """Letters of a word, up to 16: short function words count for little, repeats vote again."""
    return F.when(F.length(word) > 16, F.lit(16)).otherwise(F.length(word)).cast("long")


def fingerprint(texts: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys..., fp) of a text column; null and blank texts have fingerprint 0.

    Rows with equal keys pool their votes, so the keys should name a row.
    """
    words = texts.select(*keys, F.explode_outer(words_of(ascii_lower(text_or_empty(text)))).alias("__x"))
    rows = words.select(*keys, F.when(F.col("__x").isNotNull(), F.xxhash64("__x")).alias("h"), _weight("__x").alias("w"))
    return rows.groupBy(*keys).agg(*votes("w")).select(*keys, decide(F.col("__n"), [F.col(f"__c{k}") for k in range(32)]).alias("fp"))


def ranges(docs: DataFrame, per_range: int = 1024) -> Column:
    """The number of the range of ids that a row (doc_id, h) belongs to; numbers rise as ids fall, and null ids come last.

    Cuts are quantiles of the ids, at most eight ranges for each shuffle partition, and are looked up by halving.
    An id that fills several ranges (a hot id, or null) is spread over that many by ``h``, a hash of the text.
    """
    spark = docs.sparkSession
    parts = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    stats = docs.agg(F.count("doc_id").alias("n"), F.count("*").alias("rows")).first()
    parts = max(1, min(parts, stats["rows"] // per_range))
    found = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts).alias("c")).first()["c"] if parts > 1 and stats["n"] else []
    cuts = sorted(set(found))
    times = {c: found.count(c) for c in cuts if found.count(c) > 1}
    spread = F.lit(max(1, parts * (stats["rows"] - stats["n"]) // max(1, stats["rows"])))  # for null ids
    below = F.lit(0)
    if cuts:
        ids, most = F.array(*(F.lit(c).cast("long") for c in cuts)), len(cuts)
        steps = [1 << k for k in reversed(range(most.bit_length()))]
        below = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda at, s: F.when((at + s <= most) & (F.get(ids, at + s - 1) < F.col("doc_id")), at + s).otherwise(at))
        of = F.lit(1)
        for c, k in times.items():
            of = F.when(F.col("doc_id") == c, k).otherwise(of)
        spread = F.when(F.col("doc_id").isNull(), spread).otherwise(of)
    # A hot id is a range of its own, before the other ids of its range as it is the largest of them.
    first = F.when(F.col("doc_id").isin(*times), -2 * below - 1).otherwise(-2 * below) if times else -2 * below
    place = F.when(F.col("doc_id").isNull(), F.lit(1)).otherwise(first).cast("long")
    share = F.pmod(F.shiftrightunsigned("h", 33), spread.cast("long"))
    return place * (1 << 24) + share


def with_next(docs: DataFrame, per_range: int = 1024) -> DataFrame:
    """(r, i, after, doc_id, text, next_id, next_text): each row with the one of next smaller id; after
    the smallest comes the largest. A single row is its own next.

    (r, i) is a key of the row; the next row has the key (r, i + 1), or (after, 1) where ``after`` is not null. Null
    ids sort last; rows that share an id are ordered by range, then by their text. No global window: ``lead`` runs
    inside each range of ids, and the last row of a range takes the head of the next range that has one. Only
    the numbers of the ranges meet in one task, not their texts.
    """
    body = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    body = body.withColumn("h", F.xxhash64("text"))
    ranged = body.withColumn("r", ranges(body, per_range)).drop("h")
    w = Window.partitionBy("r").orderBy(F.col("doc_id").desc_nulls_last(), F.col("text"))
    led = ranged.select("*", F.row_number().over(w).alias("i"), F.lead("doc_id").over(w).alias("__id"), F.lead("text").over(w).alias("__text"))
    heads = led.where("i = 1").select(F.col("r").alias("after"), F.col("doc_id").alias("__hid"), F.col("text").alias("__htext"))
    line = Window.orderBy("r")
    every = line.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = ranged.select("r").distinct().select("r", F.coalesce(F.lead("r").over(line), F.first("r").over(every)).alias("after"))
    turn = order.join(heads, "after").withColumnRenamed("r", "__r")
    last = F.col("__text").isNull()
    both = led.join(turn, led["r"] == turn["__r"], "left")
    return both.select("r", "i", F.when(last, F.col("after")).alias("after"), "doc_id", "text", F.when(last, F.col("__hid")).otherwise(F.col("__id")).alias("next_id"), F.when(last, F.col("__htext")).otherwise(F.col("__text")).alias("next_text"))


def fingerprint_report(docs: DataFrame, per_range: int = 1024) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fp, efp, near_edited, near_next, class_id, links), a row for each row of ``docs``:
    fingerprints of each text and of its edited text, their likeness to each other and to the next row's fingerprint, and the
    search among all fingerprints (see ``near_fingerprints``).

    The edited text drops the last floor(n/3) code points and appends as many first ones of the
    next row (all of it, if it is shorter). See ``with_next`` for null and repeated ids.
    """
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    head = F.substring(F.col("text"), F.lit(1), n - third)
    tail = F.substring(F.col("next_text"), F.lit(1), third)
    both = with_next(docs, per_range).select("r", "i", "after", "doc_id", n.cast("long").alias("n_chars"), F.col("text").alias("__own"), head.alias("__head"), F.concat(head, tail).alias("__edited"))
    keys = ["r", "i", "after", "doc_id", "n_chars", "edited_sha256"]
    words = both.select(
        *keys[:-1], F.sha2(F.col("__edited"), 256).alias("edited_sha256"), words_of(ascii_lower(F.col("__own"))).alias("__w"), words_of(ascii_lower(F.col("__edited"))).alias("__v"),
        F.greatest(F.size(words_of(F.col("__head"))) - 1, F.lit(0)).alias("__c"),
    )
    # Both texts share the words before the cut, but for the last, which may go on: those vote once, as part 0.
    c, w, v = F.col("__c"), F.col("__w"), F.col("__v")
    piece = lambda k, a: F.struct(F.lit(k).alias("part"), a.alias("words"))
    pieces = F.array(piece(0, F.slice(w, F.lit(1), c)), piece(1, F.slice(w, c + 1, F.size(w))), piece(2, F.slice(v, c + 1, F.size(v))))
    terms = words.select(*keys, F.explode(pieces).alias("__p")).select(*keys, "__p.part", F.explode_outer("__p.words").alias("__x"))
    rows = terms.select(*keys, "part", F.when(F.col("__x").isNotNull(), F.xxhash64("__x")).alias("h"), _weight("__x").alias("w"))
    sums = rows.groupBy(*keys, "part").agg(*votes("w"))
    names = ["__n", *(f"__c{k}" for k in range(32))]
    of = lambda x, part: F.sum(F.when(F.col("part").isin(0, part), F.col(x)))
    summed = sums.groupBy(*keys).agg(*(of(x, 1).alias(f"{x}_own") for x in names), *(of(x, 2).alias(f"{x}_edited") for x in names))
    made = [decide(F.col(f"__n_{k}"), [F.col(f"__c{i}_{k}") for i in range(32)]) for k in ("own", "edited")]
    pair = materialize(summed.select(*keys, made[0].alias("fp"), made[1].alias("efp")), "fingerprints")
    after = pair.select(F.col("r").alias("__nr"), F.col("i").alias("__ni"), F.col("fp").alias("__nfp"))
    nr, ni = F.coalesce("after", "r"), F.when(F.col("after").isNull(), F.col("i") + 1).otherwise(F.lit(1))
    met = pair.join(after, (nr == F.col("__nr")) & (ni == F.col("__ni")), "left")
    report = met.select("doc_id", "n_chars", "edited_sha256", "fp", "efp", likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.coalesce("__nfp", "fp")).alias("near_next"))
    return near_fingerprints(report)


def near_fingerprints(fps: DataFrame, small: int = 64) -> DataFrame:
    """``fps`` (fp and any columns, doc_id among them) with ``class_id``, the smallest id of the fingerprint's class of copies (null if
    none of them has an id), and ``links``, how many other fingerprints lie within two bits of it.

    Copies are one class; classes meet in permuted block tables, in which every pair within two bits shares two of
    four blocks (see ``near_counts``), so no link is lost and no group of copies or near copies is paired out.
    """
    classes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("class_id")).select("fp", "class_id", F.col("fp").alias("id")), "classes")
    counts = near_counts(classes.select("id", "fp"), block_masks(2), small)
    known = classes.select("fp", "class_id").join(counts.select(F.col("id").alias("fp"), "links"), "fp", "left")
    return fps.join(known, "fp", "left").select(*fps.columns, "class_id", F.coalesce("links", F.lit(0)).alias("links"))
