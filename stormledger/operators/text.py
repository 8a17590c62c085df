"""Text of reports: clean-up, weighted token vectors, cosine similarity, keyword classes."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Words that stand for one another.
SYNONYMS = {
    "subway": "underpass", "underpass": "underpass", "waterlogging": "flood", "waterlogged": "flood", "flooding": "flood", "floods": "flood", "flooded": "flood",
    "water": "flood", "inundated": "flood", "inundation": "flood", "downpour": "rain", "showers": "rain", "rainfall": "rain", "rains": "rain", "raining": "rain", "storm": "thunderstorm",
}
# Words that weigh double, wherever they stand inside a word.
BOOSTED = (
    "flood", "rain", "thunderstorm", "cyclone", "lightning", "landslide", "heatwave", "coldwave", "drought", "station", "underpass", "bridge", "river", "dam", "road",
    "highway", "traffic", "submerged", "evacuation", "alert",
)
# Words that don't count.
STOP_WORDS = (
    "a", "an", "the", "and", "or", "in", "on", "at", "to", "for", "with", "by", "from", "of", "is", "are", "was", "were", "be", "been", "has", "have", "had", "it", "its",
    "this", "that", "near", "outside", "inside", "around",
)
# Endings that are cut off, in this order, from words that keep over three letters.
ENDINGS = ("ing", "ed", "es", "s")
WORD_WEIGHT, BOOSTED_WEIGHT, PAIR_WEIGHT, PART_WEIGHT = 4.0, 8.0, 4.0, 0.5
# Keywords of the hazard classes, in the order in which ties are settled.
KEYWORDS = {
    "FLOOD_WATERLOGGING": (
        "flood", "flooding", "waterlog", "waterlogging", "submerged", "inundation", "overflow", "drainage", "water accumulation", "underpass", "danger mark",
        "baadh", "badh", "paani bhara", "jalbharao", "jalbhorao", "sadak par paani", "बाढ़", "जलभराव", "पानी भरा", "डूब गया",
    ),
    "URBAN_FLOOD": ("urban flood", "urban flooding", "city inundation", "street flooding", "underpass drowned", "traffic flooded", "city waterlogging", "shahri baadh", "शहरी बाढ़"),
    "HEAVY_RAINFALL": (
        "heavy rain", "rainfall", "downpour", "monsoon", "shower", "cloudburst", "precipitation", "deluge", "torrential", "baarish", "barish",
        "bhaari barish", "barsat", "musladhar", "pani baras", "भारी बारिश", "बारिश", "बरसात", "मूसलाधार", "बादल फटा",
    ),
    "THUNDERSTORM_LIGHTNING": ("thunderstorm", "lightning", "thunder", "squall", "bijli", "bijlee", "aakashvani", "garaj", "badal garajna", "बिजली गिरी", "गरज", "तड़ित"),
    "CYCLONE_STORM": ("cyclone", "cyclonic storm", "storm surge", "depression", "coastal storm", "chakravat", "samudri toofan", "चक्रवात", "समुद्री तूफान"),
    "HAILSTORM": ("hailstorm", "hail", "hailstones", "ice pellets", "olavrishti", "ole padna", "ola", "ole", "patthar barsat", "ओलावृष्टि", "ओले"),
    "LANDSLIDE": ("landslide", "mudslide", "rockfall", "debris", "mud flow", "bhooskhalan", "bhuskhalan", "pahad girna", "mitti dhasna", "ghat road blocked", "भूस्खलन", "पहाड़ खिसकना"),
    "HEATWAVE": ("heatwave", "heat wave", "extreme heat", "extreme temperature", "loo", "scorching", "garmi", "loo lagna", "tapman", "badi garmi", "teekhi dhoop", "भीषण गर्मी", "लू", "तापमान"),
    "DROUGHT": ("drought", "dry spell", "water scarcity", "famine", "crop failure", "sookha", "sukha", "akaal", "akal", "pani ki kami", "सूखा", "अकाल"),
    "FOG": (
        "fog", "dense fog", "mist", "smog", "zero visibility", "low visibility", "kohra", "kuhra", "dhund", "dhundh", "dhoondh", "dhoond", "foggy", "pea soup",
        "visibility dropped", "blinding fog", "kuhasa", "kuasa", "ghana kohra", "कोहरा", "घना कोहरा", "धुंध", "कुहासा", "शून्य दृश्यता", "कम दृश्यता", "कोहरे",
    ),
    "DUST_STORM": (
        "dust storm", "sandstorm", "sand storm", "haboob", "duststorm", "flying sand", "dust plume", "wall of dust", "blinding dust",
        "dhool bhari aandhi", "dhool toofan", "retila toofan", "mitti ki aandhi", "dhool aandhi", "ret ud", "andhi toofan", "dhool bhari hawa", "mitti ka toofan", "dhool",
        "धूल भरी आंधी", "रेतीला तूफान", "धूल का तूफान", "धूल भरी हवा", "रेत का तूफान", "धूल अंधड़", "अंधड़", "धूल",
    ),
    "STRONG_WIND": (
        "strong wind", "high wind", "high velocity winds", "wind gusts", "gale", "gust", "gusts", "gusty wind", "squall", "windstorm", "winds", "wind", "howling wind", "buffeting wind",
        "destructive winds", "severe gusts", "tez hawa", "tez hawayen", "tez hawaen", "jhakkad", "tez aandhi", "hawaon", "hawa ka jhonka", "jhonka", "tez jhonka", "badi tez hawa",
        "tez pawan", "hawa chal rahi", "hawa", "तेज हवा", "तेज हवाएं", "झक्कड़", "भीषण हवाएं", "प्रचंड हवाएं", "तूफानी हवाएं", "हवा के झोंके", "हवाएं", "पवन",
    ),
    "OTHER": ("weather", "incident", "hazard", "disaster", "mausam"),
}
# Text that reviews or announces, and text that denies.
CONTEXTUAL = ("preparedness", "review meeting", "monsoon preparedness", "advisory issued", "government reviews", "monitoring situation", "precautionary measure", "briefed authorities", "contingency plan")
DENYING = ("fake news", "rumour", "denies reports", "no waterlogging", "traffic completely normal", "no truth", "debunked", "claims rejected")
# What the sanitiser takes out of a text before it is compared: orders to a language model, its marks, scripts.
INJECTIONS = (
    r"(?i)\bignore\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|prompts)\b",
    r"(?i)\bdisregard\s+(?:all\s+)?(?:previous|prior)\s+(?:instructions|rules)\b",
    r"(?is)<\|im_start\|>.*?<\|im_end\|>",
    r"(?is)\[INST\].*?\[/INST\]",
    r"(?i)<\|im_start\|>|<\|im_end\|>|\[INST\]|\[/INST\]",
    r"(?i)\b(?:system|assistant|human)\s*:",
    r"(?i)###\s*(?:instruction|system|human|prompt):?",
    r"(?is)<\s*script[^>]*>.*?<\s*/\s*script\s*>",
    r"(?i)javascript\s*:",
)
#: Entities that clean-up resolves; the ampersand comes last, so nothing is resolved twice.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def clean_html(c: Column) -> Column:
    """Text of a page: no scripts, styles or tags, entities resolved, blanks collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    out = F.regexp_replace(out, r"<[^>]+>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, r"[ \t\r\n\f]+", " "))


@F.pandas_udf(StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Unicode's compatibility form, which no built-in function has."""
    return texts.str.normalize("NFKC")


def sanitised(c: Column) -> Column:
    """A text in compatibility form without invisible characters, orders to a language model and scripts; blanks collapsed,
    leading marks dropped. A null text is empty. Plain ASCII is in that form already and skips the round through Python."""
    text = F.coalesce(c, F.lit(""))
    out = F.regexp_replace(F.when(F.octet_length(text) == F.length(text), text).otherwise(nfkc(text)), r"[\u200B-\u200D\uFEFF\u0000-\u0008\u000B\u000C\u000E-\u001F]", "")
    for pattern in INJECTIONS:
        out = F.regexp_replace(out, pattern, " ")
    return F.trim(F.regexp_replace(F.trim(F.regexp_replace(out, r"(?U)\s+", " ")), r"(?U)^[^\w\s]+", ""))


def canonical_url(c: Column) -> Column:
    """Scheme and host in lower case, tracking parameters, fragment and final slash dropped."""
    part = lambda i: F.regexp_extract(c, r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)\??([^#]*)", i)
    kept = F.array_join(F.filter(F.split(part(4), "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_|fbclid|gclid|ref|mc_)")), "&")
    out = F.concat(F.lower(part(1)), F.lit("://"), F.lower(part(2)), F.regexp_replace(part(3), "/+$", ""))
    return F.concat(out, let(kept, lambda k: F.when(k != "", F.concat(F.lit("?"), k)).otherwise("")))


def keyword_class(c: Column, keywords: dict[str, tuple[str, ...]] | None = None) -> Column:
    """The class whose keywords score highest: phrases 3, whole words 1; the first of equals, OTHER without a hit."""

    def best(text: Column) -> Column:
        scores = []
        for n, (name, words_) in enumerate((keywords or KEYWORDS).items()):
            hit = lambda w: text.contains(w) if " " in w else text.rlike(rf"(?U)(\b|^){w}(\b|$)")
            total = reduce(lambda a, b: a + b, (F.when(hit(w), 3.0 if " " in w else 1.0).otherwise(0.0) for w in words_))
            scores.append(F.struct(total.alias("score"), F.lit(-n).alias("order"), F.lit(name).alias("name")))
        return F.array_max(F.array(*scores))

    found = let(F.lower(F.coalesce(c, F.lit(""))), best)
    return let(found, lambda x: F.when(x["score"] > 0, x["name"]).otherwise("OTHER"))


def mentions(c: Column, phrases: tuple[str, ...]) -> Column:
    return F.lower(c).rlike(r"\b(" + "|".join(phrases) + r")\b")
