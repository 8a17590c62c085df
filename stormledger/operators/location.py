"""Places in free text, resolved against a gazetteer table."""

from __future__ import annotations

import re
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import spread
from .rangejoin import near_pairs

GAZETTEER = "key string, kind string, nth int, place_name string, locality string, city string, district string, state string, country string, lat double, lon double"
# Fixed values from here to FOREIGN: a starting gazetteer; a deployment brings its own table of the same schema.
STATES = (
    "Maharashtra", "Karnataka", "Tamil Nadu", "Delhi", "Kerala", "Assam", "West Bengal", "Gujarat", "Odisha", "Uttar Pradesh", "Telangana", "Andhra Pradesh", "Bihar", "Rajasthan",
    "Madhya Pradesh", "Punjab", "Haryana", "Himachal Pradesh", "Uttarakhand", "Jammu and Kashmir", "Goa", "Jharkhand", "Chhattisgarh", "Tripura", "Meghalaya", "Manipur", "Nagaland",
    "Sikkim", "Arunachal Pradesh", "Mizoram", "Puducherry", "Chandigarh", "Ladakh",
)
#: Names, city, district, state, latitude, longitude.
CITIES = (
    (("mumbai", "bombay"), "Mumbai", "Mumbai", "Maharashtra", 19.0760, 72.8777),
    (("bengaluru", "bangalore"), "Bengaluru", "Bengaluru Urban", "Karnataka", 12.9716, 77.5946),
    (("delhi",), "Delhi", "New Delhi", "Delhi", 28.6139, 77.2090),
    (("new delhi",), "New Delhi", "New Delhi", "Delhi", 28.6139, 77.2090),
    (("chennai", "madras"), "Chennai", "Chennai", "Tamil Nadu", 13.0827, 80.2707),
    (("kolkata", "calcutta"), "Kolkata", "Kolkata", "West Bengal", 22.5726, 88.3639),
    (("hyderabad",), "Hyderabad", "Hyderabad", "Telangana", 17.3850, 78.4867),
    (("pune", "poona"), "Pune", "Pune", "Maharashtra", 18.5204, 73.8567),
    (("ahmedabad",), "Ahmedabad", "Ahmedabad", "Gujarat", 23.0225, 72.5714),
    (("jaipur",), "Jaipur", "Jaipur", "Rajasthan", 26.9124, 75.7873),
    (("puri",), "Puri", "Puri", "Odisha", 19.8135, 85.8312),
    (("shimoga", "shivamogga"), "Shimoga", "Shimoga", "Karnataka", 13.9299, 75.5681),
    (("lucknow",), "Lucknow", "Lucknow", "Uttar Pradesh", 26.8467, 80.9462),
    (("patna",), "Patna", "Patna", "Bihar", 25.5941, 85.1376),
    (("guwahati", "gauhati"), "Guwahati", "Kamrup Metropolitan", "Assam", 26.1445, 91.7362),
    (("surat",), "Surat", "Surat", "Gujarat", 21.1702, 72.8311),
    (("kochi", "cochin"), "Kochi", "Ernakulam", "Kerala", 9.9312, 76.2673),
    (("bhubaneswar",), "Bhubaneswar", "Khurda", "Odisha", 20.2961, 85.8245),
    (("cuttack",), "Cuttack", "Cuttack", "Odisha", 20.4625, 85.8830),
    (("yadgir",), "Yadgir", "Yadgir", "Karnataka", 16.7375, 77.1253),
    (("wayanad",), "Kalpetta", "Wayanad", "Kerala", 11.6854, 76.1320),
    (("srinagar",), "Srinagar", "Srinagar", "Jammu and Kashmir", 34.0837, 74.7973),
    (("shimla",), "Shimla", "Shimla", "Himachal Pradesh", 31.1048, 77.1734),
    (("dehradun",), "Dehradun", "Dehradun", "Uttarakhand", 30.3165, 78.0322),
    (("thane",), "Thane", "Thane", "Maharashtra", 19.2183, 72.9781),
    (("visakhapatnam", "vizag"), "Visakhapatnam", "Visakhapatnam", "Andhra Pradesh", 17.6868, 83.2185),
    (("puducherry", "pondicherry"), "Puducherry", "Puducherry", "Puducherry", 11.9416, 79.8083),
    (("thiruvananthapuram", "trivandrum"), "Thiruvananthapuram", "Thiruvananthapuram", "Kerala", 8.5241, 76.9366),
    (("vadodara", "baroda"), "Vadodara", "Vadodara", "Gujarat", 22.3072, 73.1812),
    (("prayagraj", "allahabad"), "Prayagraj", "Prayagraj", "Uttar Pradesh", 25.4358, 81.8463),
    (("varanasi", "banaras", "kashi"), "Varanasi", "Varanasi", "Uttar Pradesh", 25.3176, 82.9739),
    (("gurugram", "gurgaon"), "Gurugram", "Gurugram", "Haryana", 28.4595, 77.0266),
)
#: Names, locality, city, district, state, latitude, longitude.
LOCALITIES = (
    (("andheri", "andheri station"), "Andheri", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.1197, 72.8468),
    (("kurla",), "Kurla", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.0726, 72.8845),
    (("sion",), "Sion", "Mumbai", "Mumbai City", "Maharashtra", 19.0390, 72.8619),
    (("bandra",), "Bandra", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.0596, 72.8295),
    (("dadar",), "Dadar", "Mumbai", "Mumbai City", "Maharashtra", 19.0178, 72.8478),
    (("borivali",), "Borivali", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.2307, 72.8567),
    (("juhu",), "Juhu", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.1075, 72.8263),
    (("worli",), "Worli", "Mumbai", "Mumbai City", "Maharashtra", 19.0166, 72.8166),
    (("chembur",), "Chembur", "Mumbai", "Mumbai Suburban", "Maharashtra", 19.0522, 72.8995),
    (("indiranagar",), "Indiranagar", "Bengaluru", "Bengaluru Urban", "Karnataka", 12.9784, 77.6408),
    (("koramangala",), "Koramangala", "Bengaluru", "Bengaluru Urban", "Karnataka", 12.9352, 77.6245),
    (("whitefield",), "Whitefield", "Bengaluru", "Bengaluru Urban", "Karnataka", 12.9698, 77.7500),
    (("jayanagar",), "Jayanagar", "Bengaluru", "Bengaluru Urban", "Karnataka", 12.9308, 77.5838),
    (("hebbal",), "Hebbal", "Bengaluru", "Bengaluru Urban", "Karnataka", 13.0358, 77.5970),
    (("connaught place",), "Connaught Place", "New Delhi", "New Delhi", "Delhi", 28.6315, 77.2167),
    (("rohini",), "Rohini", "Delhi", "North West Delhi", "Delhi", 28.7495, 77.0565),
    (("lajpat nagar",), "Lajpat Nagar", "New Delhi", "South Delhi", "Delhi", 28.5677, 77.2433),
    (("dwarka",), "Dwarka", "Delhi", "South West Delhi", "Delhi", 28.5921, 77.0460),
    (("t nagar",), "T. Nagar", "Chennai", "Chennai", "Tamil Nadu", 13.0418, 80.2341),
    (("velachery",), "Velachery", "Chennai", "Chennai", "Tamil Nadu", 12.9815, 80.2180),
    (("adyar",), "Adyar", "Chennai", "Chennai", "Tamil Nadu", 13.0012, 80.2565),
)
#: Name, place, locality, city, district, state, latitude, longitude of each candidate, in the order in which they are tried.
AMBIGUOUS = (
    ("rajpur", "Rajpur (Dehradun)", "Rajpur", None, "Dehradun", "Uttarakhand", 30.3833, 78.0833),
    ("rajpur", "Rajpur (Barwani)", None, "Rajpur", "Barwani", "Madhya Pradesh", 21.9333, 75.1333),
    ("rajpur", "Rajpur (Balrampur)", None, "Rajpur", "Balrampur", "Chhattisgarh", 23.5333, 83.3333),
    ("bilaspur", "Bilaspur (Chhattisgarh)", None, "Bilaspur", "Bilaspur", "Chhattisgarh", 22.0797, 82.1391),
    ("bilaspur", "Bilaspur (Himachal Pradesh)", None, "Bilaspur", "Bilaspur", "Himachal Pradesh", 31.3326, 76.7606),
    ("rampur", "Rampur (Uttar Pradesh)", None, "Rampur", "Rampur", "Uttar Pradesh", 28.8154, 79.0257),
    ("rampur", "Rampur (Shimla)", None, "Rampur", "Shimla", "Himachal Pradesh", 31.4484, 77.6321),
    ("aurangabad", "Chhatrapati Sambhaji Nagar (Aurangabad)", None, "Chhatrapati Sambhaji Nagar", "Chhatrapati Sambhaji Nagar", "Maharashtra", 19.8762, 75.3433),
    ("aurangabad", "Aurangabad (Bihar)", None, "Aurangabad", "Aurangabad", "Bihar", 24.7500, 84.3700),
)
#: Name, city, district, country, latitude, longitude; countries have no point.
FOREIGN = (
    ("Nepal", None, None, "Nepal", None, None), ("Bangladesh", None, None, "Bangladesh", None, None), ("Sri Lanka", None, None, "Sri Lanka", None, None), ("Germany", None, None, "Germany", None, None),
    ("Kathmandu", "Kathmandu", None, "Nepal", 27.7172, 85.3240), ("Pokhara", "Pokhara", None, "Nepal", 28.2096, 83.9856), ("Rasuwa", None, "Rasuwa", "Nepal", 28.1458, 85.2974),
    ("Dhaka", "Dhaka", None, "Bangladesh", 23.8103, 90.4125), ("Colombo", "Colombo", None, "Sri Lanka", 6.9271, 79.8612), ("Berlin", "Berlin", None, "Germany", 52.5200, 13.4050),
)
# Cities that a place's name may hold, in this order, and how far the centre of a city may lie.
NAMED_CITIES = ("mumbai", "delhi", "bengaluru", "chennai", "kolkata", "hyderabad", "pune", "kochi", "guwahati", "patna", "shimla", "dehradun", "amritsar", "thane", "puri")
CITY_RADIUS_M = 50_000.0
#: Names of one automaton, about 100 MB in each worker; a larger gazetteer takes several, and the texts are read by each in turn.
NAMES = 500_000
_PLACE = ("place_name", "locality", "city", "district", "state", "country", "lat", "lon")
_TYPES = ("string",) * 6 + ("double",) * 2
_FOUND = "array<struct<name:string,begin:int,end:int,kind:string,foreign:boolean,ambiguous:boolean>>"


def gazetteer_rows() -> list[tuple]:
    """The starting gazetteer's rows; ``nth`` orders the candidates of an ambiguous name, and cities by how soon they are tried."""
    rows = [(s.lower(), "STATE", 0, s, None, None, None, s, "India", None, None) for s in STATES]
    rows += [(k, "CITY", i, f"{c}, {s}", None, c, d, s, "India", y, x) for i, (keys, c, d, s, y, x) in enumerate(CITIES) for k in keys]
    rows += [(k, "LOCALITY", 0, f"{n}, {c}", n, c, d, s, "India", y, x) for keys, n, c, d, s, y, x in LOCALITIES for k in keys]
    rows += [(k, "AMBIGUOUS", i, p, n, c, d, s, "India", y, x) for i, (k, p, n, c, d, s, y, x) in enumerate(AMBIGUOUS)]
    rows += [(p.lower(), "FOREIGN", 0, p, None, c, d, None, land, y, x) for p, c, d, land, y, x in FOREIGN]
    return rows


def gazetteer(spark) -> DataFrame:
    """The starting gazetteer, as a local table: the planner knows its size, where it takes a table of Python rows for endless and sorts the texts to meet it."""
    columns = zip(*gazetteer_rows(), strict=True)
    kinds = {"string": pa.string(), "int": pa.int32(), "double": pa.float64()}
    fields = [pa.field(name, kinds[kind]) for name, kind in (f.split() for f in GAZETTEER.split(", "))]
    return spark.createDataFrame(pa.table([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], pa.schema(fields)), GAZETTEER)


def named(rows: DataFrame, names: DataFrame, column: str, key: str) -> DataFrame:
    """``rows`` with what ``names`` (__k, ...) say of a column's name, null for an unknown one.

    Small ``names`` are broadcast. Else rows without a name, often most of them, are dealt out by ``key`` and don't meet in one task.
    """
    dealt = F.coalesce(column, F.concat(F.lit("\0"), F.pmod(F.xxhash64(key), F.lit(1 << 20)).cast("string")))
    return rows.withColumn("__dealt", dealt).join(names, (F.col("__dealt") == F.col("__k")) & F.col(column).isNotNull(), "left").drop("__dealt", "__k")


def _clean(text: str | None) -> str:
    """A text without tags, blanks collapsed, in lower case. What follows the last > holds no tag, so it isn't searched for one."""
    text = text or ""
    last = text.rfind(">") + 1
    return re.sub(r"\s+", " ", re.sub(r"<[^>]+>", " ", text[:last]) + text[last:]).strip().lower()


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def settle(found: list[tuple[int, int, str, object]]) -> list[tuple[int, int, str, object]]:
    """The names (begin, end, name, any) that stay, in order of appearance: longer ones claim their characters first, then earlier ones."""
    kept, taken = [], set()
    for x in sorted(found, key=lambda x: (x[0] - x[1], x[0])):
        span = range(x[0], x[1])
        if taken.isdisjoint(span):
            taken.update(span)
            kept.append(x)
    return sorted(kept, key=lambda x: x[0])


def mentions(rows: DataFrame, places: DataFrame, text: str) -> DataFrame:
    """``rows`` with ``found``: the gazetteer's names in a text, {name, begin, end, kind, foreign, ambiguous}, in order of appearance.

    Names count as whole words of the cleaned text; a name's own hits don't overlap, and of overlapping names the longest stays. ``kind`` is the first of LOCALITY, CITY, STATE,
    FOREIGN, AMBIGUOUS that lists the name. An automaton reads each text once for all its names; there are as many automata as
    the gazetteer needs, each sent to the workers by itself.
    """
    spark, order = rows.sparkSession, ("LOCALITY", "CITY", "STATE", "FOREIGN", "AMBIGUOUS")
    names = places.groupBy("key").agg(F.collect_set("kind").alias("kinds")).where("key != ''")
    sets = max(1, -(-names.count() // NAMES))
    out = rows
    for i in range(sets):
        part = names if sets == 1 else names.where(F.pmod(F.xxhash64("key"), F.lit(sets)) == i)
        listed = spark.sparkContext.broadcast([(r["key"], next(k for k in order if k in r["kinds"]), "FOREIGN" in r["kinds"], "AMBIGUOUS" in r["kinds"]) for r in part.collect()])
        out = out.mapInArrow(_reader(listed, out.columns.index(text), out.columns.index("found") if i else None, i == sets - 1), T.StructType([*rows.schema.fields, T.StructField("found", T._parse_datatype_string(_FOUND))]))
    return out


def _reader(listed, at: int, before: int | None, last: bool):
    """A pass over batches that adds the names of one automaton to those found before, and settles them if it is the last."""

    def read(batches):
        finder = ahocorasick.Automaton()
        for row in listed.value:
            finder.add_word(row[0], row)
        finder.make_automaton()
        for b in batches:
            earlier = b.column(before).to_pylist() if before is not None else [None] * b.num_rows
            column = []
            for text, had in zip(b.column(at).to_pylist(), earlier, strict=True):
                low = _clean(text)
                hits, done = [(x["begin"], x["end"], x["name"], x) for x in had or ()], {}
                for end, (name, kind, foreign, ambiguous) in finder.iter(low) if listed.value else ():
                    begin, end = end + 1 - len(name), end + 1
                    left, right = begin > 0 and _word(low[begin - 1]), end < len(low) and _word(low[end])
                    if left == _word(low[begin]) or right == _word(low[end - 1]) or begin < done.get(name, 0):
                        continue
                    done[name] = end
                    hits.append((begin, end, name, {"name": name, "begin": begin, "end": end, "kind": kind, "foreign": foreign, "ambiguous": ambiguous}))
                column.append([x for *_, x in (settle(hits) if last else hits)])
            kind = pa.list_(pa.struct([("name", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("foreign", pa.bool_()), ("ambiguous", pa.bool_())]))
            kept = [c for i, c in enumerate(b.columns) if i != before]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(column, kind)], [*(n for i, n in enumerate(b.schema.names) if i != before), "found"])

    return read


def locate(reports: DataFrame, places: DataFrame, key: str = "id", text: str = "body") -> DataFrame:
    """(key, method, status, place_name, locality, city, district, state, country, lat, lon, confidence, candidates) for each row of ``reports``.

    ``reports`` bring a text and any of (lat, lon, locality, location_name, city, state). Given coordinates come first (1.0, without names of places but the
    given ones; out of bounds: unresolved), then a given locality or place name (0.95), a city (0.90), a state (0.0, no point). Else names in the
    place's name and the text decide: a foreign one (0.90 with a point, else 0.0); a locality (0.95 beside its own city or state, else
    0.90); an ambiguous name by the first candidate whose state, district or city the text holds (0.85), and without one and without a
    city AMBIGUOUS, with all ``candidates`` and no point; a city (0.95 beside its state, else 0.90); a state (0.0). The gazetteer's rows of a name are
    one dimension row, joined by kind and name.
    """
    have = reports.columns
    given = {c: (F.col(c) if c in have else F.lit(None)).cast(t) for c, t in (("lat", "double"), ("lon", "double"), ("locality", "string"), ("location_name", "string"), ("city", "string"), ("state", "string"))}
    blank = lambda c: F.nullif(c.cast("string"), F.lit(""))
    base = reports.select(F.col(key).alias("__id"), *(v.alias(f"g_{c}") for c, v in given.items()), F.concat_ws(" ", blank(given["location_name"]), blank(F.col(text))).alias("__text"))
    read = mentions(base, places, "__text")
    first = lambda test: F.get(F.filter("found", test), F.lit(0))["name"]
    of = lambda k: lambda x: x["kind"] == k
    names = lambda k: F.transform(F.filter("found", of(k)), lambda x: x["name"])
    kinds = {k: first(of(k)) for k in ("LOCALITY", "CITY", "STATE")}
    read = read.select(
        "__id", "__text", *(f"g_{c}" for c in given), *(v.alias(f"t_{k}") for k, v in kinds.items()), first(lambda x: x["foreign"]).alias("t_FOREIGN"), first(lambda x: x["ambiguous"]).alias("t_AMBIGUOUS"),
        names("CITY").alias("cities"), names("STATE").alias("states"), F.lower(F.trim(F.coalesce("g_locality", "g_location_name"))).alias("d_LOCALITY"), F.lower(F.trim("g_city")).alias("d_CITY"), F.lower(F.trim("g_state")).alias("d_STATE"),
    )
    rows = places.groupBy("kind", "key").agg(F.array_sort(F.collect_list(F.struct("nth", *_PLACE))).alias("rows"))
    of_kind = lambda column: rows.where(F.col("kind") == column[2:]).select(F.col("key").alias("__k"), F.col("rows").alias(f"r_{column}"))
    row = lambda c: F.get(F.col(f"r_{c}"), F.lit(0))
    # only the texts that settle an ambiguous name go on, and no further than to its candidates
    read = named(read.withColumn("__text", F.when(F.col("t_AMBIGUOUS").isNotNull(), F.col("__text"))), of_kind("t_AMBIGUOUS"), "t_AMBIGUOUS", "__id")
    whole = F.lower("__text")
    held = lambda x: F.coalesce((F.lower(x) != F.col("t_AMBIGUOUS")) & F.contains(whole, F.lower(x)) & (x != ""), F.lit(False))
    read = read.withColumn("matched", F.get(F.filter("r_t_AMBIGUOUS", lambda c: held(c["state"]) | held(c["district"]) | held(c["city"])), F.lit(0))).drop("__text")
    matched = F.col("matched")
    for column in ("d_LOCALITY", "d_CITY", "d_STATE", "t_FOREIGN", "t_LOCALITY", "t_CITY", "t_STATE"):
        read = named(read, of_kind(column), column, "__id")
    near = lambda seen, c, name: F.coalesce(F.array_contains(seen, F.lower(row(c)[name])), F.lit(False))
    sure = lambda *tests: F.when(reduce(lambda a, b: a | b, tests), 0.95).otherwise(0.90)
    none = {c: F.lit(None).cast(t) for c, t in zip(_PLACE, _TYPES, strict=True)}
    candidate = F.col("r_t_AMBIGUOUS").isNotNull()

    def result(method, status, place, confidence, candidates=None):
        kept = F.lit(None).cast("array<string>") if candidates is None else F.transform(candidates, lambda c: c["place_name"])
        return F.struct(F.lit(method).alias("method"), F.lit(status).alias("status"), *(place[c].alias(c) for c in _PLACE), confidence.cast("double").alias("confidence"), kept.alias("candidates"))

    coordinates = F.concat(F.lit("Coord("), F.format_string("%.4f", "g_lat"), F.lit(", "), F.format_string("%.4f", "g_lon"), F.lit(")"))
    point = none | {"place_name": F.coalesce("g_location_name", "g_locality", "g_city", coordinates), "locality": F.col("g_locality"), "city": F.col("g_city"), "state": F.col("g_state"), "country": F.lit("India"), "lat": F.col("g_lat"), "lon": F.col("g_lon")}
    placed = F.col("g_lat").isNotNull() & F.col("g_lon").isNotNull()
    nlp = "NLP_ENTITY_RESOLUTION"
    steps = [
        (placed & F.col("g_lat").between(-90, 90) & F.col("g_lon").between(-180, 180), result("STRUCTURED_COORDINATES", "RESOLVED", point, F.lit(1.0))),
        (placed, result("STRUCTURED_COORDINATES", "UNRESOLVED", none, F.lit(0.0))),
        (row("d_LOCALITY").isNotNull(), result("PLACE_DICTIONARY", "RESOLVED", row("d_LOCALITY"), F.lit(0.95))),
        (row("d_CITY").isNotNull(), result("EXACT_ADMIN_MATCH", "RESOLVED", row("d_CITY"), F.lit(0.90))),
        (row("d_STATE").isNotNull(), result("EXACT_ADMIN_MATCH", "RESOLVED", row("d_STATE"), F.lit(0.0))),
        (row("t_FOREIGN").isNotNull(), result(nlp, "RESOLVED", row("t_FOREIGN"), F.when(row("t_FOREIGN")["lat"].isNotNull(), 0.90).otherwise(0.0))),
        (row("t_LOCALITY").isNotNull(), result("PLACE_DICTIONARY", "RESOLVED", row("t_LOCALITY"), sure(near("cities", "t_LOCALITY", "city"), near("states", "t_LOCALITY", "state")))),
        (candidate & matched.isNotNull(), result(nlp, "RESOLVED", matched, F.lit(0.85))),
        (candidate & row("t_CITY").isNull(), result(nlp, "AMBIGUOUS", none | {"place_name": F.initcap("t_AMBIGUOUS")}, F.lit(0.0), F.col("r_t_AMBIGUOUS"))),
        (row("t_CITY").isNotNull(), result("EXACT_ADMIN_MATCH", "RESOLVED", row("t_CITY"), sure(near("states", "t_CITY", "state")))),
        (row("t_STATE").isNotNull(), result("EXACT_ADMIN_MATCH", "RESOLVED", row("t_STATE"), F.lit(0.0))),
    ]
    out = F.coalesce(*(F.when(test, value) for test, value in steps), result(nlp, "UNRESOLVED", none, F.lit(0.0)))
    return read.select(F.col("__id").alias(key), out.alias("__x")).select(key, "__x.*")


def first_city(points: DataFrame, places: DataFrame, key: str, radius_m: float = CITY_RADIUS_M) -> DataFrame:
    """(key, city, state): the first city of the gazetteer's order whose centre lies within the radius of a point (key, lat, lon), by grid cell."""
    cities = places.where("kind = 'CITY'").select("nth", "city", "state", F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))
    left = points.select(F.col(key).alias("__id"), F.col("lat").alias("llat"), F.col("lon").alias("llon"))
    best = F.min_by(F.struct("city", "state"), F.struct("nth", "city")).alias("x")
    return near_pairs(left, cities, radius_m, few=True).groupBy("__id").agg(best).select(F.col("__id").alias(key), "x.city", "x.state")


def incident_places(reports: DataFrame, places: DataFrame, text: str) -> DataFrame:
    """(id, city, state, locality, place_name, placed) of reports (id, lat, lon, location_name, text): what is known of where each lies.

    Names in the text count first, then the first city near the coordinates, then a city that the place's name holds; a city brings its state.
    The names of a report with coordinates come from its text alone.
    """
    declared = locate(reports.select("id", "lat", "lon", "location_name", F.col(text).alias("body")), places)
    told = locate(reports.select("id", F.col(text).alias("body")), places).select("id", F.col("city").alias("t_city"), F.col("state").alias("t_state"))
    near = first_city(reports.where("lat is not null and lon is not null").select("id", "lat", "lon"), places, "id").select("id", F.col("city").alias("n_city"), F.col("state").alias("n_state"))
    both = declared.join(spread(told), "id").join(spread(near), "id", "left").join(spread(reports.select("id", "location_name", (F.col("lat").isNotNull() & F.col("lon").isNotNull()).alias("placed"))), "id")
    low = F.lower("location_name")
    held = F.coalesce(*(F.when(F.contains(low, F.lit(c)), F.lit(c.capitalize())) for c in NAMED_CITIES))
    city = F.coalesce("city", "t_city", "n_city", held)
    known = places.where("kind = 'CITY'").select(F.col("key").alias("__k"), F.col("state").alias("k_state"))
    full = both.select("id", city.alias("city"), F.coalesce("state", "t_state", "n_state").alias("state"), "locality", "place_name", "placed").withColumn("__city", F.lower("city"))
    return named(full, known, "__city", "id").select("id", "city", F.coalesce("state", "k_state").alias("state"), "locality", "place_name", "placed")


def conflicts(reports: DataFrame, places: DataFrame, text: str = "body", penalty: float = 0.10, cap: float = 0.10) -> DataFrame:
    """(id, verdict, adjustment) of reports (id, city, state, text): whether a text tells of another place than the declared one.

    The state of every name in the text counts. CONSISTENT: the declared state (or, if the gazetteer doesn't know it, that of the declared city) is
    among them. MISMATCH: else the text names a place abroad, or the first state that it names is another. NEUTRAL: no declared state, or nothing to judge by.
    """
    found = mentions(reports.select("id", text), places, text).select("id", F.explode("found").alias("x")).select("id", "x.*")
    known = places.where(F.col("kind").isin("LOCALITY", "CITY", "STATE")).select(F.col("kind").alias("__kind"), F.col("key").alias("__key"), F.lower("state").alias("__state"))
    met = found.join(known, (F.col("kind") == F.col("__kind")) & (F.col("name") == F.col("__key")), "left")
    home = F.when(~F.col("foreign"), F.col("__state"))
    told = met.groupBy("id").agg(F.collect_set(home).alias("states"), F.min_by(home, F.when(home.isNotNull(), F.col("begin"))).alias("first_"), F.bool_or("foreign").alias("abroad"))
    states = places.where("kind = 'STATE'").select(F.col("key").alias("__k"), F.lower("state").alias("s_state"))
    cities = places.where("kind = 'CITY'").select(F.col("key").alias("__k"), F.lower("state").alias("c_state"))
    rows = reports.select("id", F.lower(F.trim("state")).alias("d_state"), F.lower(F.trim("city")).alias("d_city"))
    rows = named(named(rows, states, "d_state", "id"), cities, "d_city", "id").join(spread(told), "id", "left")
    canon = F.coalesce("s_state", "c_state")
    yes = lambda c: F.coalesce(c, F.lit(False))
    blank = F.coalesce(F.col("d_state") == "", F.lit(True))
    verdict = F.when(blank | F.col("states").isNull(), "NEUTRAL").when(yes(F.array_contains("states", canon)), "CONSISTENT").when(yes(F.col("abroad")) | yes(F.col("first_") != canon), "MISMATCH").otherwise("NEUTRAL")
    return rows.select("id", verdict.alias("verdict"), F.when(verdict == "MISMATCH", -min(penalty, cap)).otherwise(0.0).alias("adjustment"))


def mismatch(declared: Column, states: Column, foreign: Column, penalty: float = 0.10, cap: float = 0.15) -> Column:
    """{verdict, adjustment} of a declared state against the states that a text names."""
    named = F.size(states) > 0
    agrees = F.array_contains(F.transform(states, F.lower), F.lower(declared))
    verdict = F.when(declared.isNull() | (~named & ~foreign), "NEUTRAL").when(agrees, "CONSISTENT").otherwise("MISMATCH")
    return F.struct(verdict.alias("verdict"), F.when(verdict == "MISMATCH", -min(penalty, cap)).otherwise(0.0).alias("adjustment"))
