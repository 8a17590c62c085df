"""The query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, language, mixing, neardup, periodic, pii, quality, substring, suffix, toxicity, trie, warc
from .common import table
from .simhash import hex16


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))
    spans = F.col("pii_spans")
    base = F.filter(spans, lambda s: s["kind"].isin(*pii.BASE))

    def count(kind: str):
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = {k: count(k) for k in pii.PATTERNS}
    extra = [counts[k] for k in pii.PATTERNS if k not in pii.BASE]
    best = F.array_max(F.transform(spans, lambda s: s["score"])).alias("best_score")
    return found.select("doc_id", *(counts[k] for k in pii.BASE), F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(spans).alias("spans"), *extra, best)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.round_trip(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    made = plan.select("doc_id", "size", "source_size", "target", "taken", F.get("positions", F.lit(0)).alias("first_position"))
    return made.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.drop_repeated_bytes(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", "predicted", "n_passages")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.drop_repeated_windows(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.fingerprint_report(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", hex16(F.col("fp")).alias("fingerprint"), hex16(F.col("efp")).alias("edited_fingerprint"), "near_edited", "near_next", "class_id", "links")


def op10_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = neardup.near_groups(neardup.text_fingerprints(table(spark, sf_dir, "documents")), radius=2)
    return groups.select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(table(spark, sf_dir, "documents"), seed=F.crc32(F.col("doc_id").cast("string"))).drop("runs", "collapsed")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_warc, op3_mixing, op4_suffix, op5_toxicity, op6_substring, op7_quality, op8_decontamination, op9_simhash, op10_neardup, op11_trie, op12_language, op13_periodic)}


_OP2 = """WITH p AS (SELECT page_id, COALESCE(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x FROM p),
 g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS lead_ FROM d),
 c AS (SELECT *, list_transform(range(8), lambda k: ('0x' || substr(x, CAST(1 + 5 * k AS INTEGER), 5))::UBIGINT) AS v FROM g)
 SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda n: array_to_string(list_transform([15, 10, 5, 0], lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((n // (1 << s)) % 32 AS INTEGER) + 1, 1)), '')), '') AS payload_digest,
 CASE WHEN page_id = lead_ THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> lead_ THEN lead_ END AS refers_to FROM c"""

# Windows that start in an earlier place again; a unit is removed if the last such window that starts at or before it reaches it.
_OP4 = """WITH t AS (SELECT doc_id, hex(encode(COALESCE(text, ''))) AS h FROM documents), b AS (SELECT doc_id, h, length(h) // 2 AS n FROM t),
 piece AS (SELECT doc_id, 500 * k AS o, substr(h, CAST(1000 * k + 1 AS INTEGER), 1198) AS p FROM (SELECT doc_id, h, unnest(range(0, n // 500 + 1)) AS k FROM b WHERE n >= 100)),
 w AS (SELECT doc_id, o + i AS i, md5_number(substr(p, CAST(2 * i + 1 AS INTEGER), 200)) AS s FROM (SELECT *, unnest(range(0, greatest(0, length(p) // 2 - 99))) AS i FROM piece)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
 marks AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS fresh FROM later),
 runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marks) GROUP BY doc_id, k),
 gaps AS (SELECT doc_id, a, z, COALESCE(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before_ FROM runs),
 kept AS (SELECT g.doc_id, string_agg(substr(h, CAST(2 * before_ + 1 AS INTEGER), CAST(2 * (a - before_) AS INTEGER)), '' ORDER BY a) || substr(any_value(h), CAST(2 * max(z) + 1 AS INTEGER)) AS h, sum(z - a) AS removed, count(*) AS spans FROM gaps g JOIN b ON b.doc_id = g.doc_id GROUP BY 1)
 SELECT b.doc_id, n AS n_bytes, CAST(COALESCE(removed, 0) AS BIGINT) AS n_removed, COALESCE(spans, 0) AS n_spans, sha256(unhex(COALESCE(k.h, b.h))) AS kept_sha256 FROM b LEFT JOIN kept k ON k.doc_id = b.doc_id"""

_OP6 = r"""WITH t AS (SELECT doc_id, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
 s AS (SELECT doc_id, i, array_to_string(w[i : i + 19], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM t WHERE len(w) >= 20)),
 later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM s) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS i FROM later),
 words AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM t),
 kept AS (SELECT words.doc_id, string_agg(x, ' ' ORDER BY words.i) FILTER (gone.i IS NULL) AS k, count(gone.i) AS n FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.i = words.i GROUP BY 1)
 SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, COALESCE(n, 0) AS n_removed, sha256(COALESCE(k, '')) AS kept_sha256 FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id"""


# The h of a conversation is crc32 of its decimal id, made bit by bit: each code point is a step, then eight shifts.
_OP11 = """WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k, COALESCE(role, '') AS r, COALESCE(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
 c AS (SELECT conv_id, xor(list_reduce(flatten(list_transform(range(1, length(CAST(conv_id AS VARCHAR)) + 1), lambda i: list_concat([CAST(ord(substr(CAST(conv_id AS VARCHAR), CAST(i AS INTEGER), 1)) AS BIGINT)], list_transform(range(8), lambda z: -1)))),
   lambda a, v: CASE WHEN v >= 0 THEN xor(a, v) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295), 4294967295) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
 m AS (SELECT c.conv_id, k, r, x FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k <= h UNION ALL SELECT c.conv_id, k, r, x FROM c JOIN t ON t.conv_id = c.conv_id AND k > h),
 s AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, md5(length(r) || ':' || r || x) AS y, octet_length(encode(x)) AS b FROM m),
 p AS (SELECT conv_id, d, b, md5(string_agg(y, '') OVER (PARTITION BY conv_id ORDER BY d)) AS id FROM s UNION ALL SELECT conv_id, 0, 0, 'root' FROM c),
 q AS (SELECT *, lag(id) OVER (PARTITION BY conv_id ORDER BY d) AS up, d = max(d) OVER (PARTITION BY conv_id) AS over_ FROM p),
 n AS (SELECT id, min(conv_id) AS conv_id, max(d) AS depth, max(up) AS up, count(*) AS n_convs, max(b) AS b, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (over_) AS ends FROM q GROUP BY id),
 k AS (SELECT up, count(*) AS n_children FROM n GROUP BY up),
 f AS (SELECT n.*, COALESCE(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.up = n.id),
 sub AS (SELECT q.id, count(*) FILTER (f.n_children = 0) AS n_leaves, sum((f.n_convs - 1) * f.b) AS saved FROM f JOIN q ON q.conv_id = f.conv_id AND q.d <= f.depth GROUP BY q.id),
 o AS (SELECT f.id, row_number() OVER (ORDER BY path) - 1 AS preorder FROM f JOIN (SELECT conv_id, d, COALESCE(string_agg(z, '') OVER (PARTITION BY conv_id ORDER BY d), '') AS path FROM (SELECT conv_id, d, substr(sha256(octet_length(encode(r)) || ':' || r || x), 1, 32) AS z FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) AS d, r, x FROM m) UNION ALL SELECT conv_id, 0, '' FROM c)) w ON w.conv_id = f.conv_id AND w.d = f.depth),
 size AS (SELECT q.id, count(*) AS within_ FROM f JOIN q ON q.conv_id = f.conv_id AND q.d <= f.depth GROUP BY q.id)
 SELECT f.conv_id, CAST(f.depth AS BIGINT) AS depth, parent.conv_id AS parent_conv_id, f.n_convs, f.n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(COALESCE(f.ends, '')) AS ends_sha256, preorder, preorder + within_ - 1 AS subtree_end
 FROM f JOIN sub ON sub.id = f.id JOIN o ON o.id = f.id JOIN size ON size.id = f.id LEFT JOIN f AS parent ON parent.id = f.up"""


def oracle_sql() -> dict[str, str]:
    """SQL with the same rows, where SQL has the operations: XXH64 and fitted models it has not."""
    return {"op2_warc": _OP2, "op4_suffix": _OP4, "op6_substring": _OP6, "op11_trie": _OP11}
