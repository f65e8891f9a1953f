"""Text operators over the whole documents, with a Latin pattern pack where SQL must follow."""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries import tables as T
from driver_queries.registry import WITH_L, query
from plotyard import fixed_values as fv
from plotyard.functions import labels, text
from plotyard.operators import prepare, profile

PACK = {"f_the": r"the|que", "f_digits": r"[0-9]{3,}", "f_mail": r"@", "f_code": r"http|license|key"}
# Placeholder words of the park rule, in a Latin vocabulary.
NEAR_LATIN = r"(?:of|de)\s+\S*\s*(?:the|la)\S*"


def _documents(spark, sf):
    T.load(spark, sf, "documents")
    return spark.table("documents")


def _sql_normal(column: str) -> str:
    """Latin-text equivalent of the flag normalisation without its repeat collapse."""
    symbols = r"[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}\x{200D}]"
    invisible = r"[\x{200B}-\x{200F}\x{202A}-\x{202E}]"
    return (
        f"trim(regexp_replace(regexp_replace(regexp_replace({column}, '{symbols}', ' ', 'g'), '{invisible}', ' ', 'g'), "
        r"'[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"
    )


@query("H1_normalize_flags")
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", text.normalize_flags(F.col("text")).alias("norm"))


_CONTENT_SQL = (
    r"regexp_replace(regexp_replace(regexp_replace(text, 'https?://[^\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}"
    r"\x{202F}\x{205F}\x{3000}\x{0B}]+', ' ', 'g'), '(00966|\+?966)?0?5[0-9]{8}', ' ', 'g'), "
    r"'[\x{1F300}-\x{1FAFF}\x{2190}-\x{21FF}\x{2300}-\x{27BF}\x{2B00}-\x{2BFF}\x{FE0F}]', ' ', 'g')"
)


@query(
    "H2_normalize_content",
    f"SELECT doc_id, md5({_sql_normal('c')}) AS digest, length({_sql_normal('c')}) AS chars FROM "
    f"(SELECT doc_id, {_CONTENT_SQL} AS c FROM documents)",
)
def _(spark, sf):
    clean = text.normalize_content(F.col("text"))
    return _documents(spark, sf).select(
        "doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("long").alias("chars")
    )


@query(
    "H3_collapse_whitespace",
    "SELECT doc_id, md5(trim(regexp_replace(text, "
    r"'[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))) "
    "AS digest FROM documents",
)
def _(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", F.md5(text.collapse_whitespace(F.col("text"))).alias("digest")
    )


_NEG = r"(?:not|sin|pas|kein)\s+\S+\s*\S*"


@query(
    "H4_strip_negations",
    f"SELECT doc_id, md5(regexp_replace(lower(text), '{_NEG}', ' ', 'g')) AS digest FROM documents",
)
def _(spark, sf):
    stripped = F.regexp_replace(F.lower("text"), _NEG, " ")
    return _documents(spark, sf).select("doc_id", F.md5(stripped).alias("digest"))


@query(
    "H5_keyword_flags",
    "SELECT doc_id, " + ", ".join(
        f"CAST(regexp_matches(text, '{p}') AS TINYINT) AS {n}" for n, p in PACK.items()
    ) + " FROM documents",
)
def _(spark, sf):
    return _documents(spark, sf).select("doc_id", *text.keyword_flags(F.col("text"), PACK))


@query(
    "H6_near_park_flags",
    f"SELECT doc_id, CAST(regexp_matches(text, '{NEAR_LATIN}') AS TINYINT) AS f_near_park, "
    f"CAST(regexp_matches(regexp_replace(text, '{NEAR_LATIN}', ' ', 'g'), 'the') AS TINYINT) AS f_garden, "
    f"CAST(regexp_matches(regexp_replace(text, '{NEAR_LATIN}', ' ', 'g'), 'la') AS TINYINT) AS f_yard FROM documents",
)
def _(spark, sf):
    return _documents(spark, sf).select(
        "doc_id", *text.park_flags(F.col("text"), NEAR_LATIN, "the", "la")
    )


@query("H5_arabic_flag_pack")
def _(spark, sf):
    named = _documents(spark, sf).select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    return prepare.with_text_flags(named).drop("title", "content")


# Stand-in ads: three phrases chosen by a document's id and length; some are denied, some name a park nearby.
_PHRASES = (
    "شقه واسعه", "مسبح كبير", "بدون مسبح", "مكيفات سبليت", "لا يوجد مصعد", "مصعد حديث", "غرفه سائق", "غرفه خادمه", "قريب من حديقه عامه",
    "حديقه خاصه", "حوش كبير", "بدون حوش خلفي", "مدخلين", "زاويه", "مطبخ راكب", "غير مفروشه بالكامل", "مفروشه", "جديد", "دخل شهري", "قابل للتفاوض",
    "فرصه", "قبو", "موقف سياره", "امام المسجد", "مقابل منتزه", "سطح", "مافيه قبو", "للبيع",
)


def _phrase_sql(place: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in _PHRASES) + f"][1 + ({place}) % {len(_PHRASES)}]"


_PLACES = ("doc_id * 7 + length(text)", "doc_id * 5 + length(text) * 3 + 11", "length(text) * 11 + doc_id")
_RAISED = ", ".join(f"CAST(regexp_matches(t, '{p}') AS TINYINT) AS {n}" for n, p in fv.FLAG_PATTERNS.items() if n not in ("f_garden", "f_yard", "f_near_park"))


@query(
    "H5_arabic_ads",
    f"WITH a AS (SELECT doc_id, {_phrase_sql(_PLACES[0])} || ' ' || {_phrase_sql(_PLACES[1])} || ' ' || {_phrase_sql(_PLACES[2])} AS ad FROM documents), "
    f"s AS (SELECT doc_id, regexp_replace(translate(ad, '{fv.FLAG_LETTERS_FROM}', '{fv.FLAG_LETTERS_TO}'), '{fv.NEGATION_PATTERN}', ' ', 'g') AS t FROM a), "
    f"r AS (SELECT *, regexp_replace(t, '{fv.NEAR_PARK_PATTERN}', ' ', 'g') AS rest FROM s) SELECT doc_id, {_RAISED}, "
    f"CAST(regexp_matches(t, '{fv.NEAR_PARK_PATTERN}') AS TINYINT) AS f_near_park, CAST(regexp_matches(rest, '{fv.GARDEN_PATTERN}') AS TINYINT) AS f_garden, "
    f"CAST(regexp_matches(rest, '{fv.YARD_PATTERN}') AS TINYINT) AS f_yard FROM r",
)
def _(spark, sf):
    phrase = lambda place: f"element_at(array({', '.join(repr(x) for x in _PHRASES)}), cast(1 + ({place}) % {len(_PHRASES)} as int))"
    ads = _documents(spark, sf).selectExpr("doc_id", f"{phrase(_PLACES[0])} AS title", f"concat({phrase(_PLACES[1])}, ' ', {phrase(_PLACES[2])}) AS content")
    return prepare.with_text_flags(ads).drop("title", "content")


@query(
    "H7_fill_ac",
    f"{WITH_L} SELECT id, CASE WHEN ac IS NULL AND estate_benefit = 'rental' AND estate_type IN ('apartment', 'chalet', "
    "'furnished_apartment', 'esterahah', 'house', 'floor') THEN CAST(regexp_matches(title || ' ' || content, 'URGENT|HIGH') "
    "AS DOUBLE) ELSE CAST(ac AS DOUBLE) END AS ac FROM l",
)
def _(spark, sf):
    filled = text.fill_ac(F.col("ac"), "URGENT|HIGH")
    return T.listings(spark, sf).select("id", filled.alias("ac"))


@query(
    "H8_text_shape",
    r"SELECT doc_id, length(text) AS len_chars, length(text) - length(replace(text, ' ', '')) AS len_words, "
    r"len(regexp_extract_all(text, '[\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}]')) AS n_emoji, "
    r"length(text) - length(replace(text, chr(10), '')) AS n_newlines, "
    r"CAST(regexp_matches(text, '(?:05|٠٥|\+9665)[0-9]{6,}') AS TINYINT) AS has_phone, "
    r"CAST(regexp_matches(text, 'http|www\.|wa\.me|t\.me|snapchat|instagram') AS TINYINT) AS has_url, "
    r"CAST(regexp_matches(text, '[A-Za-z]{3,}') AS TINYINT) AS has_latin, "
    r"len(regexp_extract_all(text, '[★☆✅✔️❤🔥●•▪]')) AS caps_symbols FROM documents",
)
def _(spark, sf):
    shape = _documents(spark, sf).select("doc_id", *text.text_shape(F.col("text")))
    counts = ("len_chars", "len_words", "n_emoji", "n_newlines", "caps_symbols")
    return shape.withColumns({c: F.col(c).cast("long") for c in counts})


@query(
    "H9_search_fold",
    f"{WITH_L} SELECT city, district, count(*) AS n FROM l WHERE contains(lower(concat_ws(' ', district, city)), 'd3 nation_1') "
    "GROUP BY 1, 2",
)
def _(spark, sf):
    hits = T.listings(spark, sf).filter(text.matches_search("D3 nation_1"))
    return hits.groupBy("city", "district").agg(F.count(F.lit(1)).alias("n"))


@query(
    "H11_distance_label",
    f"{WITH_L} SELECT id, CASE WHEN street_width IS NULL THEN '—' WHEN street_width * 37 < 1000 THEN "
    "CAST(CAST(floor(street_width * 37 + 0.5) AS BIGINT) AS VARCHAR) || ' m' ELSE printf('%.1f', street_width * 37 / 1000) "
    "|| ' km' END AS label FROM l",
)
def _(spark, sf):
    return T.listings(spark, sf).select(
        "id", labels.distance_label(F.col("street_width") * 37).alias("label")
    )


# The colon template is written out from each order's figures, in the pattern's own words.
TEMPLATE = (
    "SELECT id, concat(CASE WHEN f_yard = 1 THEN 'غرفة خادمة ' WHEN f_pool = 1 THEN 'غرفة خادمة ( لا ) ' WHEN f_urgent = 1 "
    "THEN 'ماستر ' ELSE '' END, 'عدد المجالس : ', CAST(wc AS VARCHAR(3)), ' عدد الصالات : ', CAST(livings AS VARCHAR(3)), "
    "' عدد غرف النوم : ', CAST(beds AS VARCHAR(3))) AS clean, beds, livings, wc, f_yard, f_pool, f_urgent"
)


@query(
    "H13_template_rooms",
    f"{WITH_L}, t AS ({TEMPLATE} FROM l) SELECT id, CAST(beds + livings + wc + CASE WHEN f_yard = 1 THEN 1 ELSE 0 END "
    "AS BIGINT) AS rooms_true FROM t WHERE clean IS NOT NULL AND beds IS NOT NULL AND livings IS NOT NULL AND wc IS NOT NULL "
    "AND NOT (f_urgent = 1 AND f_yard = 0 AND f_pool = 0) AND beds + livings + wc + CASE WHEN f_yard = 1 THEN 1 ELSE 0 END > 0",
)
def _(spark, sf):
    T.listings(spark, sf).createOrReplaceTempView("listings_view")
    filled = spark.sql(f"{TEMPLATE} FROM listings_view").filter(
        F.col("beds").isNotNull() & F.col("livings").isNotNull() & F.col("wc").isNotNull()
    )
    rooms = filled.select("id", text.template_rooms(F.col("clean")).alias("rooms_true"))
    return rooms.filter(F.col("rooms_true").isNotNull())


@query(
    "D14_pattern_rates",
    "SELECT flag, round_even(rate * 10000, 0) / 100 AS rate_pct FROM (" + " UNION ALL ".join(
        f"SELECT '{n}' AS flag, avg(CAST(regexp_matches(text, '{p}') AS DOUBLE)) AS rate FROM documents"
        for n, p in PACK.items()
    ) + ")",
)
def _(spark, sf):
    flags = {n: F.col("text").rlike(p).cast("int") for n, p in PACK.items()}
    return profile.rates(_documents(spark, sf), flags)


_SCALED = "regexp_replace(printf('%.1f', {0} / 1e6), '\\.0$', '')"
_LOW, _TOP = _SCALED.format("low"), _SCALED.format("top")


@query(
    "D31_band_labels",
    f"{WITH_L}, b AS (SELECT estate_type, max(price) AS top, min(price) AS low FROM l GROUP BY 1) SELECT estate_type, "
    f"'< ' || {_LOW} || '|' || {_LOW} || '–' || {_TOP} || '|' || {_TOP} || '+' AS labels FROM b",
)
def _(spark, sf):
    ends = T.listings(spark, sf).groupBy("estate_type").agg(
        F.array(F.min("price"), F.max("price")).alias("breaks")
    )
    return ends.select(
        "estate_type", F.array_join(labels.band_labels(F.col("breaks")), "|").alias("labels")
    )
