"""Personal data (native): patterns propose spans, checksums confirm them, context scores them.

Everything is a column expression. Positions come from cutting a text at the matches of a
pattern: the lengths of the pieces between matches and of the matches add up to offsets.
Patterns use possessive repeats and anchored starts, so they run in linear time and
constant stack on any text; what they match is what the plain patterns of the contract match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

#: Kind, pattern, a cheap test that a text can hold a match. The order is the order of kinds.
_LOCAL = r"[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": (rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", lambda t: t.contains("@")),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", lambda t: t.rlike(r"[0-9]\.[0-9]")),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]")),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda t: t.contains("+")),
    "iban": (r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", lambda t: t.rlike("[A-Z]{2}[0-9]{2}")),
    "tel": (r"(?<![0-9A-Za-z+().-])(?<![0-9+)][\x20.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9A-Za-z-])", lambda t: t.rlike("[0-9]{3}[.-][0-9]{4}")),
    "secret": (r"(?<![0-9A-Za-z])[0-9a-f]{32,128}+(?![0-9A-Za-z])", lambda t: t.rlike("[0-9a-f]{32}")),
}
BASE = ("email", "ip", "card", "phone")
#: Words that make a kind likelier when they stand nearby.
CONTEXT = {
    "email": r"(?i)mail|contact|write|schreib|écri|correo",
    "ip": r"(?i)\bip\b|address|host|server|adresse",
    "card": r"(?i)card|visa|credit|karte|carte|tarjeta",
    "phone": r"(?i)phone|call|\btel|mobile|anruf|appel",
    "iban": r"(?i)iban|bank|account|konto|compte|cuenta",
    "tel": r"(?i)phone|call|\btel|mobile|fax|anruf|appel|llama",
    "secret": r"(?i)token|secret|passw|credential|api.?key|private.?key",
}
#: How likely a confirmed match is before its context is read, and what the context adds or takes.
#: At the usual threshold of 0.5 an account number stands alone (its checksum holds by chance once in 97), while a bare
#: national number or a string of hexadecimal digits (it may be any hash) counts only beside a word that speaks for it.
PRIOR = {"email": 0.8, "ip": 0.6, "card": 0.7, "phone": 0.6, "iban": 0.7, "tel": 0.5, "secret": 0.3}
WITH_CONTEXT, WITHOUT_CONTEXT = 0.2, -0.1
#: A national number with its area in brackets is likelier one.
BRACKETED = 0.1
#: Code points on either side in which a context word counts, as far as the neighbouring matches of the same kind.
NEARBY = 40
#: Elements that a running fold handles at once, and code points in a block of text.
RUN, BLOCK = 256, 4096


def luhn(digits: Column) -> Column:
    """The Luhn checksum of a string of digits holds."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(F.when(d.cast("int") > 4, d.cast("int") * 2 - 9).otherwise(d.cast("int") * 2)))
    return F.aggregate(places, F.lit(0), lambda a, x: a + x) % 10 == 0


def mod97(iban: Column) -> Column:
    """The mod-97 checksum of an account number without blanks holds."""
    moved = F.concat(F.substring(iban, 5, 40), F.substring(iban, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("string")).otherwise((F.ascii(c) - 55).cast("string"))
    digits = F.split(F.array_join(F.transform(F.split(moved, ""), value), ""), "")
    return F.aggregate(digits, F.lit(0), lambda a, d: (a * 10 + d.cast("int")) % 97) == 1


def confirmed(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        # more than three significant digits exceed 255 and may not fit an int
        return F.forall(F.split(match, r"\."), lambda p: ~p.rlike("[1-9][0-9]{3}") & (F.coalesce(F.substring(p, -3, 3).cast("int"), F.lit(0)) <= 255))
    if kind == "card":
        return F.when(F.length(digits).between(12, 19), luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "iban":
        bare = F.replace(match, F.lit(" "), F.lit(""))
        return F.when(F.length(bare).between(15, 34), mod97(bare)).otherwise(F.lit(False))
    return F.lit(True)


SPAN = "struct<start:int,rank:int,end:int,kind:string,score:double>"


def running(df: DataFrame, columns: dict[str, str], kind: str, value, combine) -> DataFrame:
    """``df`` with array<struct<before:int,x:kind>> columns: each element of an array column with the fold of the values of
    all before it. ``columns`` names the new column of each array column.

    An array that grows by one element is copied each time, so the fold grows arrays of ``RUN`` elements
    and one array of runs: time grows in proportion to the elements up to some millions. Every step is a
    column of its own, as what a lambda names is computed again for each element.
    """
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))
    places = {f"__k{c}": F.when(F.size(c) > 0, F.sequence(F.lit(0), F.floor((F.size(c) - 1) / RUN).cast("int"))).otherwise(F.array().cast("array<int>")) for c in columns}
    cut = lambda c: F.transform(f"__k{c}", lambda k: F.slice(c, k * RUN + 1, F.lit(RUN)))
    runs = {f"__u{c}": cut(c) for c in columns}
    totals = {f"__t{c}": F.transform(f"__u{c}", lambda r: F.aggregate(r, F.lit(0), lambda a, x: combine(a, value(x)))) for c in columns}
    none = F.array().cast("array<int>")
    starts = {f"__b{c}": F.aggregate(f"__t{c}", state(F.lit(0), none), lambda a, t: state(combine(a["at"], t), F.concat(a["out"], F.array(a["at"]))), lambda a: a["out"]) for c in columns}
    empty = F.array().cast(f"array<struct<before:int,x:{kind}>>")
    grow = lambda a, x: state(combine(a["at"], value(x)), F.concat(a["out"], F.array(F.struct(a["at"].alias("before"), x.alias("x")))))
    done = {new: F.flatten(F.zip_with(f"__u{c}", f"__b{c}", lambda r, s: F.aggregate(r, state(s, empty), grow, lambda a: a["out"]))) for c, new in columns.items()}
    for step in (places, runs, totals, starts, done):
        df = df.withColumns(step)
    return df.drop(*places, *runs, *totals, *starts)


def score(kind: str, match: Column, context: Column) -> Column:
    out = F.lit(PRIOR[kind]) + F.when(context.rlike(CONTEXT[kind]), WITH_CONTEXT).otherwise(WITHOUT_CONTEXT)
    return F.round(out + F.when(match.startswith("("), BRACKETED).otherwise(0.0), 2) if kind == "tel" else F.round(out, 2)


ROW = "struct<g:int,n:int,m:string,l:string,r:string>"


def rows_of(matches: Column, gaps: Column) -> Column:
    """Per match the lengths of the gap before it and of itself, itself, and its context on either side.

    ``gaps`` are the pieces between the matches: their lengths give the offsets, and their ends the context, so the
    text is never searched again from its start.
    """
    n = F.size(matches)
    left = F.zip_with(F.slice(gaps, F.lit(1), n), matches, lambda g, m: F.struct(F.length(g).alias("g"), F.length(m).alias("n"), m.alias("m"), F.right(g, F.lit(NEARBY)).alias("l")))
    every = F.zip_with(left, F.slice(gaps, F.lit(2), n), lambda x, g: F.struct(x["g"].alias("g"), x["n"].alias("n"), x["m"].alias("m"), x["l"].alias("l"), F.left(g, F.lit(NEARBY)).alias("r")))
    return F.when(n > 0, every).otherwise(F.array().cast(f"array<{ROW}>"))


def spans_of(kind: str, rank: int, placed: Column) -> Column:
    """Confirmed spans of one kind as array<struct<start, rank, end, kind, score>>."""
    kept = F.filter(placed, lambda p: confirmed(kind, p["x"]["m"]))
    start = lambda p: p["before"] + p["x"]["g"]
    made = F.transform(kept, lambda p: F.struct(start(p).alias("start"), F.lit(rank).alias("rank"), (start(p) + p["x"]["n"]).alias("end"), F.lit(kind).alias("kind"), score(kind, p["x"]["m"], F.concat(p["x"]["l"], F.lit(" "), p["x"]["r"])).alias("score")))
    return F.when(F.size(placed) > 0, made).otherwise(F.array().cast(f"array<{SPAN}>"))


def detect(docs: DataFrame, text: str = "text", least: float = 0.5) -> DataFrame:
    """``docs`` with ``pii_spans``: the spans by start, then kind, of each whole text.

    A span is {start, rank, end, kind, score}: code points, end exclusive. Base kinds (email, ip, card, phone) are kept
    whatever their score; account numbers, national phone numbers and secrets must also score ``least``, and may overlap
    spans of other kinds. The score is the kind's prior, raised by a context word nearby and lowered without one.
    A null or empty text has no spans. All other columns and rows stay as they are, repeated rows too, but for a
    column that is named ``pii_spans`` already: it is replaced.
    """
    named = docs.withColumn("__t", text_or_empty(text))
    t = F.col("__t")
    found = {f"__m_{k}": F.when(may(t), F.regexp_extract_all(t, F.lit(p), F.lit(0))).otherwise(F.array().cast("array<string>")) for k, (p, may) in PATTERNS.items()}
    gaps = {f"__g_{k}": F.when(F.size(f"__m_{k}") > 0, F.split(t, p, -1)).otherwise(F.array().cast("array<string>")) for k, (p, _) in PATTERNS.items()}
    named = named.withColumns(found).withColumns(gaps)
    named = named.withColumns({f"__r_{k}": rows_of(F.col(f"__m_{k}"), F.col(f"__g_{k}")) for k in PATTERNS})
    named = running(named, {f"__r_{k}": f"__p_{k}" for k in PATTERNS}, ROW, lambda x: x["g"] + x["n"], lambda a, b: a + b)
    named = named.withColumns({f"__s_{k}": spans_of(k, i, F.col(f"__p_{k}")) for i, k in enumerate(PATTERNS)})
    extra = (F.filter(F.col(f"__s_{k}"), lambda s: s["score"] >= least) for k in PATTERNS if k not in BASE)
    named = named.withColumn("__every", F.concat(*(F.col(f"__s_{k}") for k in BASE), *extra))
    every = F.col("__every")
    return named.withColumn("pii_spans", F.when(F.size(every) > 1, F.array_sort(every)).otherwise(every)).drop("__t", "__every", *(f"__{x}_{k}" for k in PATTERNS for x in "mgrps"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def piece(blocks: Column, begin: Column, end: Column) -> Column:
    """The code points from begin to end of a text that is cut into blocks."""
    first, last = F.floor(begin / BLOCK).cast("int"), F.floor(end / BLOCK).cast("int")
    head = lambda n: F.coalesce(F.substring(F.get(blocks, first), begin % BLOCK + 1, n), F.lit(""))
    tail = F.coalesce(F.substring(F.get(blocks, last), F.lit(1), end % BLOCK), F.lit(""))
    return F.when(first == last, head(end - begin)).otherwise(F.concat(head(F.lit(BLOCK)), F.array_join(F.slice(blocks, first + 2, last - first - 1), ""), tail))


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each span replaced by its kind in brackets; overlapping spans become one.

    The columns stay as they are, one named ``pii_spans`` too; ``length`` (if there is such a column) is brought up to
    date where the text changed. Null texts stay null.
    """
    found = detect(docs.withColumnRenamed("pii_spans", "__had_spans") if "pii_spans" in docs.columns else docs, text)
    t, hit = F.col(text), F.size("pii_spans") > 0
    found = found.withColumn("__blocks", F.when(hit, F.regexp_extract_all(t, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))))
    found = running(found, {"pii_spans": "__spans"}, SPAN, lambda s: s["end"], F.greatest)
    blocks, spans = F.col("__blocks"), F.col("__spans")
    fresh = lambda p: F.concat(piece(blocks, p["before"], p["x"]["start"]), F.lit("["), F.upper(p["x"]["kind"]), F.lit("]"))
    parts = F.transform(spans, lambda p: F.when(p["x"]["start"] < p["before"], F.lit("")).otherwise(fresh(p)))
    rest = piece(blocks, F.array_max(F.transform(spans, lambda p: p["x"]["end"])), F.length(t))
    out = found.withColumn("__clean", F.when(hit, F.concat(F.array_join(parts, ""), rest)).otherwise(t))
    if length and length in docs.columns:
        out = out.withColumn(length, F.when(hit, F.length("__clean").cast(docs.schema[length].dataType)).otherwise(F.col(length)))
    out = out.withColumn(text, F.col("__clean")).drop("pii_spans")
    if "__had_spans" in out.columns:
        out = out.withColumnRenamed("__had_spans", "pii_spans")
    return out.select(*docs.columns)
