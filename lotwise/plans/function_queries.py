"""Queries of the scalar functions over whole tables, each with its DuckDB oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import text as X
from lotwise.functions import urls as U
from lotwise.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a function as query ``name``, with its oracle where SQL can say the same."""

    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _in(column: str, parts: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{p}')" for p in parts) + ")"


_HOST = r"regexp_replace(regexp_extract(lower(trim({u})), '^(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@]*@)?([^/?#]*)', 1), '^www\.', '')"
_PATH = r"regexp_extract(trim({u}), '^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://)?[^/?#]*([^?#]*)', 1)"
_QUERY = r"regexp_extract(trim({u}), '^[^?#]*\?([^#]*)', 1)"


@query("fn_u01_content_hash", "SELECT listing_id, sha256(lower(trim(coalesce(make,''))) || chr(31) || lower(trim(coalesce(model,''))) || chr(31) || lower(trim(coalesce(title,''))) || chr(31)) AS h FROM listings")
def fn_u01(s, d):
    return table(s, d, "listings").select("listing_id", U.content_hash(F.col("make"), F.col("model"), F.col("title")).alias("h"))


@query("fn_u02_stable_id", "SELECT listing_id, substr(sha256(lower(trim(coalesce(listing_url,''))) || chr(31)), 1, 20) AS h FROM listings")
def fn_u02(s, d):
    return table(s, d, "listings").select("listing_id", U.stable_id(F.col("listing_url")).alias("h"))


_DECODED = rf"list_transform(list_filter(string_split({_QUERY}, '&'), lambda x: regexp_matches(x, '^[^=]+=.+')), lambda x: [url_decode(replace(regexp_extract(x, '^([^=]*)', 1), '+', ' ')), url_decode(replace(regexp_extract(x, '^[^=]*=(.*)$', 1), '+', ' '))])"
_KEPT = rf"list_sort(list_filter({_DECODED}, lambda x: NOT regexp_matches(lower(x[1]), '{U.TRACKING}')))"
_NORM = rf"""CASE WHEN trim({{u}}) = '' THEN {{u}} ELSE coalesce(nullif(lower(regexp_extract(trim({{u}}), '^([A-Za-z][A-Za-z0-9+.\-]*)://', 1)), ''), 'https') || '://' || {_HOST}
 || CASE WHEN regexp_replace({_PATH}, '/+$', '') = '' THEN '/' ELSE regexp_replace({_PATH}, '/+$', '') END
 || CASE WHEN len({_KEPT}) > 0 THEN '?' || array_to_string(list_transform({_KEPT}, lambda x: replace(url_encode(x[1]), '%20', '+') || '=' || replace(url_encode(x[2]), '%20', '+')), '&') ELSE '' END END"""


@query("fn_u03_normalize_url", f"SELECT hit_id, {_NORM.format(u='exact_url')} AS url FROM search_hits")
def fn_u03(s, d):
    return table(s, d, "search_hits").select("hit_id", U.normalize(F.col("exact_url")).alias("url"))


@query("fn_u04_domain", f"SELECT raw_id, regexp_replace({_HOST.format(u='url')}, ':\\d*$', '') AS domain FROM raw_listings")
def fn_u04(s, d):
    return table(s, d, "raw_listings").select("raw_id", U.domain(F.col("url")).alias("domain"))


@query("fn_u05_is_specific", f"SELECT listing_id, coalesce(replace({_PATH.format(u='listing_url')}, '/', '') <> '' OR {_QUERY.format(u='listing_url')} <> '', false) AS specific FROM listings")
def fn_u05(s, d):
    return table(s, d, "listings").select("listing_id", U.is_specific(F.col("listing_url")).alias("specific"))


_SPEC = f"coalesce(replace({_PATH.format(u='x')}, '/', '') <> '' OR {_QUERY.format(u='x')} <> '', false)"
_DOM = f"regexp_replace({_HOST.format(u='x')}, ':\\d*$', '')"


@query(
    "fn_u06_pick_canonical",
    f"""WITH a AS (SELECT listing_id, dealer_domain, list_filter([canonical_listing_url, original_listing_url, listing_url], lambda x: x IS NOT NULL AND x <> '') AS urls FROM listings)
SELECT listing_id, coalesce(list_filter(urls, lambda x: {_SPEC} AND {_DOM} = dealer_domain)[1], list_filter(urls, lambda x: {_SPEC} AND NOT contains({_DOM}, 'markt'))[1], list_filter(urls, lambda x: {_SPEC})[1], urls[1]) AS url FROM a""",
)
def fn_u06(s, d):
    urls = F.array("canonical_listing_url", "original_listing_url", "listing_url")
    return table(s, d, "listings").select("listing_id", U.pick_canonical(urls, F.col("dealer_domain"), ("markt",)).alias("url"))


_P = f"regexp_replace({_PATH}, '/+$', '')"
_LOW = f"('/' || regexp_replace(lower({_P}), '^/+|/+$', '', 'g'))"
_KEYS = f"list_transform(list_filter(string_split(lower({_QUERY}), '&'), lambda x: regexp_matches(x, '^[^=]+=.+')), lambda x: regexp_extract(x, '^([^=]*)', 1))"
_SEGS = f"list_filter(string_split({_P}, '/'), lambda x: x <> '')"
_QUALITY = f"""CASE WHEN {{u}} IS NULL OR trim({{u}}) = '' THEN 'UNKNOWN' WHEN {_P} = '' AND {_QUERY} = '' THEN 'HOMEPAGE'
 WHEN list_has_any({_KEYS}, {list(U.SEARCH_KEYS)}) OR contains(lower({{u}}), '#q:') OR {_LOW} IN {U.STOCK_PATHS} OR {_in(f"({_LOW} || '/')", U.SEARCH_PARTS)} THEN 'SEARCH_PAGE'
 WHEN {_in(f"({_LOW} || '/')", U.DETAIL_PARTS)} THEN CASE WHEN regexp_matches({_LOW} || '/', '/(fahrzeuge|gebrauchtwagen|auto)/$') THEN 'SEARCH_PAGE' ELSE 'EXACT_DETAIL' END
 WHEN regexp_matches({_P}, '\\d{{{{5,}}}}') THEN 'EXACT_DETAIL'
 WHEN (len({_SEGS}) >= 2 AND (contains({_SEGS}[-1], '-') OR length({_SEGS}[-1]) > 12)) OR len({_SEGS}) >= 3 THEN 'LIKELY_DETAIL' ELSE 'UNKNOWN' END"""


@query("fn_u07_url_quality", f"SELECT listing_id, {_QUALITY.format(u='listing_url')} AS quality FROM listings")
def fn_u07(s, d):
    return table(s, d, "listings").select("listing_id", U.quality(F.col("listing_url")).alias("quality"))


@query("fn_u08_is_detail", f"SELECT hit_id, {_QUALITY.format(u='exact_url')} IN ('EXACT_DETAIL', 'LIKELY_DETAIL') AS detail FROM search_hits")
def fn_u08(s, d):
    return table(s, d, "search_hits").select("hit_id", U.is_detail(F.col("exact_url")).alias("detail"))


@query(
    "fn_u10_best_external",
    f"""SELECT listing_id, coalesce(CASE WHEN {_QUALITY.format(u='canonical_listing_url')} IN ('EXACT_DETAIL','LIKELY_DETAIL') THEN canonical_listing_url END,
 CASE WHEN {_QUALITY.format(u='original_listing_url')} IN ('EXACT_DETAIL','LIKELY_DETAIL') THEN original_listing_url END, CASE WHEN {_QUALITY.format(u='listing_url')} IN ('EXACT_DETAIL','LIKELY_DETAIL') THEN listing_url END) AS url FROM listings""",
)
def fn_u10(s, d):
    return table(s, d, "listings").select("listing_id", U.best_external(F.col("canonical_listing_url"), F.col("original_listing_url"), F.col("listing_url")).alias("url"))


@query("fn_s01_collapse", r"SELECT doc_id, coalesce(trim(regexp_replace(text, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+', ' ', 'g')), '') AS text FROM documents")
def fn_s01(s, d):
    return table(s, d, "documents").select("doc_id", X.collapse(F.col("text")).alias("text"))


@query("fn_s02_word_match", r"SELECT raw_id, regexp_matches(lower(title), '(^|[^a-z0-9])gt([^a-z0-9]|$)') AS gt, regexp_matches(lower(title), '(^|[^a-z0-9])tow[\s-]?bar([^a-z0-9]|$)') AS bar FROM raw_listings")
def fn_s02(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.word_match(F.col("title"), "gt").alias("gt"), X.word_match(F.col("title"), "tow bar").alias("bar"))


TERMS = ("style", "club", "cross", "plus", "comfort")


@query("fn_s03_first_match", "SELECT raw_id, CASE " + " ".join(rf"WHEN regexp_matches(lower(title), '(^|[^a-z0-9]){t}([^a-z0-9]|$)') THEN '{t}'" for t in TERMS) + " END AS term FROM raw_listings")
def fn_s03(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.first_match(F.col("title"), TERMS).alias("term"))


@query("fn_s04_all_hits", f"SELECT doc_id, array_to_string(list_filter({list(TERMS)}, lambda t: contains(lower(text), t)), ',') AS hits FROM documents")
def fn_s04(s, d):
    return table(s, d, "documents").select("doc_id", F.array_join(X.all_hits(F.col("text"), TERMS), ",").alias("hits"))


def _guess_sql(column: str) -> str:
    t = f"(' ' || lower({column}) || ' ')"
    scores = [f"({' + '.join(f'''(length({t}) - length(replace({t}, '{h}', ''))) // {len(h)}''' for h in hints)})" for hints in X.LANGUAGE_HINTS.values()]
    langs = list(X.LANGUAGE_HINTS)
    best = "greatest(" + ", ".join(scores) + ")"
    return f"CASE WHEN {column} IS NULL OR {best} = 0 THEN NULL " + " ".join(f"WHEN {s} = {best} THEN '{x}'" for s, x in zip(scores, langs, strict=True)) + " END"


@query("fn_s05_language_guess", f"SELECT doc_id, {_guess_sql('text')} AS lang FROM documents")
def fn_s05(s, d):
    return table(s, d, "documents").select("doc_id", X.language_guess(F.col("text")).alias("lang"))


@query("fn_s06_phone9", r"SELECT listing_id, nullif(right(regexp_replace(seller_phone_public, '\D', '', 'g'), 9), '') AS phone FROM listings")
def fn_s06(s, d):
    return table(s, d, "listings").select("listing_id", X.phone9(F.col("seller_phone_public")).alias("phone"))


@query("fn_s07_vin", "SELECT listing_id, nullif(upper(trim(vin_public)), '') AS vin FROM listings")
def fn_s07(s, d):
    return table(s, d, "listings").select("listing_id", X.vin(F.col("vin_public")).alias("vin"))


def hashes(s: SparkSession, d: str) -> DataFrame:
    """64-bit hashes of the vectors' signs, with a copy in which the lowest vec_id % 12 bits are flipped."""
    bits = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, "1").otherwise("0")), "")
    rows = table(s, d, "embeddings").select("vec_id", F.lpad(F.lower(F.conv(bits, 2, 16)), 16, "0").alias("hash"))
    flip = F.expr("shiftleft(1L, cast(vec_id % 12 AS int)) - 1L")
    return rows.withColumn("copy", F.lpad(F.lower(F.hex(F.conv("hash", 16, -10).cast("long").bitwiseXOR(flip))), 16, "0"))


@query("fn_s08_hamming", "SELECT vec_id, CAST(vec_id % 12 AS BIGINT) AS distance FROM embeddings")
def fn_s08(s, d):
    return hashes(s, d).select("vec_id", X.hamming(F.col("hash"), F.col("copy")).cast("long").alias("distance"))


@query("fn_s09_similar_hashes", "SELECT vec_id, vec_id % 12 <= 8 AS similar FROM embeddings")
def fn_s09(s, d):
    return hashes(s, d).select("vec_id", X.similar_hashes(F.array("hash"), F.array("copy")).alias("similar"))


@query("fn_s10_first_url", r"SELECT fetch_id, nullif(regexp_extract(text, 'https?://([a-z0-9.-]+\.[a-z]{2,})', 1), '') AS host FROM fetch_results")
def fn_s10(s, d):
    return table(s, d, "fetch_results").select("fetch_id", F.nullif(F.regexp_extract("text", r"https?://([a-z0-9.-]+\.[a-z]{2,})", 1), F.lit("")).alias("host"))


@query("fn_s11_combined", "SELECT raw_id, concat_ws(' ', nullif(title, ''), nullif(description, ''), nullif(raw_text, '')) AS text FROM raw_listings")
def fn_s11(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.combined(F.col("title"), F.col("description"), F.col("raw_text")).alias("text"))


_D = r"regexp_replace(regexp_replace({c}, '[^\d.,]', '', 'g'), '^[.,]+|[.,]+$', '', 'g')"


def _number_sql(c: str) -> str:
    x = _D.format(c=c)
    return rf"""try_cast(CASE WHEN contains({x}, ',') AND contains({x}, '.') THEN CASE WHEN strpos(reverse({x}), ',') < strpos(reverse({x}), '.') THEN replace(replace({x}, '.', ''), ',', '.') ELSE replace({x}, ',', '') END
 WHEN contains({x}, ',') THEN CASE WHEN regexp_matches({x}, '^\d+,\d{{1,2}}$') THEN replace({x}, ',', '.') ELSE replace({x}, ',', '') END
 WHEN contains({x}, '.') THEN CASE WHEN regexp_matches({x}, '^\d+\.\d{{1,2}}$') THEN {x} ELSE replace({x}, '.', '') END ELSE {x} END AS DOUBLE)"""


@query("fn_n01_to_number", rf"WITH a AS (SELECT raw_id, regexp_extract(description, '(\d[\d.,]*\d)\s?(?:€|EUR|Euro)', 1) AS t FROM raw_listings) SELECT raw_id, {_number_sql('t')} AS n FROM a")
def fn_n01(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.to_number(F.regexp_extract("description", r"(\d[\d.,]*\d)\s?(?:€|EUR|Euro)", 1)).alias("n"))


@query("fn_n02_detect_currency", "SELECT raw_id, CASE " + " ".join(f"WHEN contains(lower(description), '{k}') THEN '{v}'" for k, v in X.CURRENCY_SIGNS) + " END AS code FROM raw_listings")
def fn_n02(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.detect_currency(F.col("description")).alias("code"))


_RATES = "CASE upper(coalesce(currency, 'EUR')) " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.EUR_RATES.items()) + " END"


@query("fn_n05_to_eur", f"SELECT listing_id, CAST(round_even(CAST(price_original AS DECIMAL(18,4)) * CAST({_RATES} AS DECIMAL(10,4)), 2) AS DOUBLE) AS eur FROM listings")
def fn_n05(s, d):
    return table(s, d, "listings").select("listing_id", X.to_eur(F.col("price_original"), F.col("currency")).alias("eur"))


_LOWD = "lower(description)"
_MILE = r"'(\d[\d.,\s]{1,9}\d|\d{2,7})\s*(km|tkm|miles|mi\b|000\s*km)'"


@query(
    "fn_n06_parse_mileage",
    rf"""WITH a AS (SELECT raw_id, regexp_extract({_LOWD}, {_MILE}, 1) AS n, regexp_extract({_LOWD}, {_MILE}, 2) AS u FROM raw_listings),
b AS (SELECT raw_id, {_number_sql('n')} * CASE WHEN u = 'tkm' THEN 1000 WHEN starts_with(u, 'mi') THEN 1.60934 ELSE 1 END AS km FROM a) SELECT raw_id, CASE WHEN km BETWEEN 0 AND 1000000 THEN CAST(round_even(km, 0) AS INTEGER) END AS km FROM b""",
)
def fn_n06(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.parse_mileage(F.col("description")).alias("km"))


@query(
    "fn_n07_parse_power",
    rf"""WITH a AS (SELECT raw_id, try_cast(regexp_extract({_LOWD}, '(\d{{2,3}})\s*kw', 1) AS INTEGER) AS kw, try_cast(regexp_extract({_LOWD}, '(\d{{2,3}})\s*(?:ps|hp|cv|ch|pk|bhp)\b', 1) AS INTEGER) AS hp FROM raw_listings)
SELECT raw_id, coalesce(kw, CAST(round_even(hp / 1.35962::DOUBLE, 0) AS INTEGER)) AS kw, coalesce(hp, CAST(round_even(kw * 1.35962::DOUBLE, 0) AS INTEGER)) AS hp FROM a""",
)
def fn_n07(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.parse_power(F.col("description")).alias("p")).select("raw_id", "p.kw", "p.hp")


@query("fn_n08_parse_year", r"SELECT raw_id, list_min(list_filter(list_transform(regexp_extract_all(description, '((?:19|20)\d{2})', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2026)) AS year FROM raw_listings")
def fn_n08(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.parse_year(F.col("description"), 2025).alias("year"))


@query(
    "fn_n09_parse_displacement",
    r"""WITH a AS (SELECT raw_id, try_cast(regexp_extract(lower(title), '(\d{3,4})\s*(?:cc|ccm|cm3|cm³)', 1) AS INTEGER) AS cc, try_cast(replace(regexp_extract(lower(title), '\b(\d[.,]\d)\s*l?\b', 1), ',', '.') AS DECIMAL(4,1)) AS l FROM raw_listings)
SELECT raw_id, coalesce(CASE WHEN cc BETWEEN 500 AND 8000 THEN cc END, CASE WHEN l BETWEEN 0.5 AND 8.0 THEN CAST(l * 1000 AS INTEGER) END) AS cc FROM a""",
)
def fn_n09(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.parse_displacement(F.col("title")).alias("cc"))


@query(
    "fn_n11_enrich",
    rf"""WITH a AS (SELECT raw_id, year, list_min(list_filter(list_transform(regexp_extract_all(concat_ws(' ', nullif(title,''), nullif(description,'')), '((?:19|20)\d{{2}})', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1990 AND 2026)) AS t FROM raw_listings)
SELECT raw_id, coalesce(year, t) AS year FROM a""",
)
def fn_n11(s, d):
    return table(s, d, "raw_listings").select("raw_id", F.coalesce("year", X.parse_year(X.combined(F.col("title"), F.col("description")), 2025)).alias("year"))


@query("fn_n12_band", "SELECT listing_id, CAST(round_even(CAST(price_eur AS DECIMAL(18,4)) / 300, 0) AS BIGINT) AS price_band, CAST(round_even(CAST(mileage_km AS DECIMAL(18,4)) / 5000, 0) AS BIGINT) AS km_band FROM listings")
def fn_n12(s, d):
    return table(s, d, "listings").select("listing_id", X.band(F.col("price_eur"), 300).alias("price_band"), X.band(F.col("mileage_km"), 5000).alias("km_band"))


def _cues(cues: tuple[str, ...]) -> str:
    return _in("lower(coalesce(description, ''))", cues)


_KNOWN = "(country IS NOT NULL AND country <> '')"


@query(
    "fn_n13_steering",
    f"""SELECT raw_id, CASE WHEN {_cues(X.RIGHT_CUES)} THEN 'RHD' WHEN {_cues(X.LEFT_CUES)} THEN 'LHD' WHEN {_KNOWN} AND upper(country) IN {X.LEFT_DRIVING} THEN 'RHD' WHEN {_KNOWN} THEN 'LHD' ELSE 'UNKNOWN' END AS side,
CASE WHEN {_cues(X.RIGHT_CUES)} OR {_cues(X.LEFT_CUES)} THEN 90 WHEN {_KNOWN} THEN 55 ELSE 0 END AS confidence FROM raw_listings""",
)
def fn_n13(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.steering(F.col("description"), F.col("country")).alias("s")).select("raw_id", "s.side", "s.confidence")


@query("fn_n14_phone_country", "SELECT listing_id, CASE " + " ".join(f"WHEN contains(seller_phone_public, '{k}') THEN '{v}'" for k, v in X.PHONE_CODES.items()) + " END AS country FROM listings")
def fn_n14(s, d):
    return table(s, d, "listings").select("listing_id", X.phone_country(F.col("seller_phone_public")).alias("country"))


@query("fn_n15_within", "SELECT listing_id, production_year IS NULL OR production_year BETWEEN 2004 AND 2011 AS plausible FROM listings")
def fn_n15(s, d):
    return table(s, d, "listings").select("listing_id", X.within(F.col("production_year"), 2005, 2010, 1).alias("plausible"))


@query("fn_d02_month", "SELECT hit_id, date_trunc('month', discovered_at)::TIMESTAMP AS month FROM search_hits")
def fn_d02(s, d):
    return table(s, d, "search_hits").select("hit_id", F.date_trunc("month", "discovered_at").cast("timestamp_ntz").alias("month"))


@query("fn_d03_whole_days", "SELECT listing_id, CAST(floor((epoch_us(last_seen_at) - epoch_us(first_seen_at)) / 86400000000) AS BIGINT) AS days FROM listings WHERE first_seen_at >= TIMESTAMP '2025-01-01'")
def fn_d03(s, d):
    return table(s, d, "listings").where(F.col("first_seen_at") >= F.to_timestamp_ntz(F.lit("2025-01-01 00:00:00"))).select("listing_id", X.whole_days(F.col("first_seen_at"), F.col("last_seen_at")).alias("days"))
