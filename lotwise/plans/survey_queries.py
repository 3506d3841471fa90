"""Queries of the read side, crawling, discovery and the ledger, each with its DuckDB oracle.

What the tables lack is worked out from their ids by the same rule on both sides:
confidence, score and class of a listing, the runs of a query, the scans of a source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.functions import reference_values as V
from lotwise.functions import text as X
from lotwise.functions import urls as U
from lotwise.operators import crawl, discovery, ledger, readside
from lotwise.plans.function_queries import _DOM, _HOST, _NORM, _QUALITY, _SPEC, _number_sql, query
from lotwise.sources.tables import table

NOW = "2025-07-20 00:00:00"


def _now():
    return F.to_timestamp_ntz(F.lit(NOW))


def listings(s: SparkSession, d: str) -> DataFrame:
    i = F.col("listing_id")
    return table(s, d, "listings").withColumns({
        "confidence": (i * 37 % 101).cast("int"), "score": F.when(i % 7 != 0, i * 53 % 101).cast("int"), "class": F.when(i % 11 == 0, "OTHER").when(i % 5 != 0, "MATCH"),
    })


_L = "(SELECT *, CAST(listing_id * 37 % 101 AS INTEGER) AS confidence, CASE WHEN listing_id % 7 <> 0 THEN CAST(listing_id * 53 % 101 AS INTEGER) END AS score, CASE WHEN listing_id % 11 = 0 THEN 'OTHER' WHEN listing_id % 5 <> 0 THEN 'MATCH' END AS class FROM listings)"
_OK = "(class IS NULL OR class <> 'OTHER') AND (listing_url_quality IS NULL OR listing_url_quality NOT IN ('SEARCH_PAGE','HOMEPAGE'))"
_ACTIVE = _OK + " AND listing_status IN ('ACTIVE','MAYBE_ACTIVE')"


@query("cl16_valid_candidates", f"SELECT listing_id, coalesce({_ACTIVE}, false) AS valid, coalesce({_OK}, false) AS any_status FROM {_L}")
def cl16(s, d):
    return listings(s, d).select("listing_id", readside.valid("OTHER").alias("valid"), readside.valid("OTHER", None).alias("any_status"))


@query("cl17_filtered", f"SELECT listing_id, confidence, score FROM {_L} WHERE {_ACTIVE} AND confidence >= 20 AND confidence <= 90 AND country = 'DE' AND price_eur <= 12000 AND price_eur >= 2000 AND mileage_km <= 200000 AND production_year >= 2004 ORDER BY score DESC NULLS LAST, confidence DESC, listing_id LIMIT 200")
def cl17(s, d):
    return readside.filtered(listings(s, d), rejected="OTHER", min_confidence=20, max_confidence=90, country="de", max_price=12000, min_price=2000, max_mileage=200000, min_year=2004, seller_type="").select("listing_id", "confidence", "score")


@query("cl24_active_hits", f"SELECT listing_id FROM {_L} WHERE {_ACTIVE} AND confidence >= 60 ORDER BY score DESC NULLS LAST, confidence DESC, listing_id LIMIT 200")
def cl24(s, d):
    return readside.active_hits(listings(s, d), "OTHER").select("listing_id")


@query("so01_by_score", f"SELECT listing_id, score, confidence FROM {_L} WHERE {_ACTIVE} ORDER BY score DESC NULLS LAST, confidence DESC, listing_id LIMIT 400")
def so01(s, d):
    return readside.filtered(listings(s, d), "score", 400, "OTHER").select("listing_id", "score", "confidence")


@query("so03_by_confidence_and_price", f"(SELECT 'confidence' AS by, listing_id FROM {_L} WHERE {_ACTIVE} ORDER BY confidence DESC, listing_id LIMIT 100) UNION ALL (SELECT 'price', listing_id FROM {_L} WHERE {_ACTIVE} ORDER BY price_eur NULLS LAST, listing_id LIMIT 100)")
def so03(s, d):
    both = [readside.filtered(listings(s, d), o, 100, "OTHER").select(F.lit(o).alias("by"), "listing_id") for o in ("confidence", "price")]
    return both[0].union(both[1])


@query("so04_sold_newest", f"SELECT listing_id FROM {_L} WHERE {_OK} AND listing_status = 'SOLD' ORDER BY first_seen_at DESC NULLS LAST, listing_id DESC LIMIT 25")
def so04(s, d):
    return readside.filtered(listings(s, d), "newest", 25, "OTHER", status="SOLD").select("listing_id")


@query("ag01_home", f"""SELECT * FROM (SELECT count_if({_ACTIVE} AND confidence >= 60 AND first_seen_at BETWEEN TIMESTAMP '{NOW}' - INTERVAL 24 HOURS AND TIMESTAMP '{NOW}') AS new_today, count_if({_ACTIVE} AND confidence >= 60) AS total_active,
 count_if({_ACTIVE} AND confidence >= 40 AND confidence < 60) AS uncertain, count_if(listing_status IN ('EXPIRED','REMOVED')) AS disappeared FROM {_L}),
 (SELECT count_if(health = 'failed') AS failed_sources, count_if(health = 'degraded') AS degraded_sources, count(*) AS sources_total, count_if(active) AS sources_active FROM sources)""")
def ag01(s, d):
    return readside.home(listings(s, d), table(s, d, "sources"), _now(), "OTHER")


_METRICS = f"""SELECT * FROM (SELECT count(*) AS known_sources, count_if(active) AS active_sources, count_if(discovery_value >= 65) AS long_tail_sources, count_if(first_discovered_at BETWEEN TIMESTAMP '2025-01-07' - INTERVAL 7 DAYS AND TIMESTAMP '2025-01-07') AS new_sources_week FROM sources),
 (SELECT (SELECT count(*) FROM (SELECT DISTINCT country FROM listings)) AS countries_covered, count(*) AS seen, count_if(confidence >= 95) AS confirmed, count(original_listing_url) AS first_on_dealer FROM {_L})"""


@query("ag02_metrics", _METRICS)
def ag02(s, d):
    return readside.metrics(listings(s, d), table(s, d, "sources"), F.to_timestamp_ntz(F.lit("2025-01-07 00:00:00")))


@query("ag04_health", "SELECT count_if(health = 'healthy') AS healthy, count_if(health = 'degraded') AS degraded, count_if(health = 'failed') AS failed, count_if(health = 'unknown') AS unknown FROM sources")
def ag04(s, d):
    return readside.health(table(s, d, "sources"))


TYPES = ["dealer", "classifieds", "major_marketplace", "local_marketplace", "aggregator", "garage", "auction"]
_COUNTRIES = "(VALUES " + ", ".join(f"('{c[0]}', '{c[1]}', '{c[4]}')" for c in V.COUNTRIES) + ") AS c(code, name, tld)"


@query("ag03_country_types", f"SELECT code AS country, name, count(source_id) AS sources, count_if(coalesce(health = 'healthy', false)) AS healthy, count_if(coalesce(health = 'failed', false)) AS failed, {', '.join(f'''count_if(coalesce(source_type = '{t}', false)) AS n_{t}''' for t in TYPES)} FROM {_COUNTRIES} LEFT JOIN (SELECT source_id, country, health, source_type FROM sources) s ON s.country = c.code GROUP BY 1, 2")
def ag03(s, d):
    return readside.coverage_by_type(V.countries(s), table(s, d, "sources"), TYPES)


@query("sc16_source_groups", """SELECT country, count_if(source_type IN ('dealer','garage')) AS dealers, count_if(source_type IN ('major_marketplace','classifieds')) AS markets FROM sources WHERE country IS NOT NULL GROUP BY 1""")
def sc16(s, d):
    c = table(s, d, "sources").where("country IS NOT NULL").groupBy("country")
    return c.agg(F.count_if(F.col("source_type").isin("dealer", "garage")).alias("dealers"), F.count_if(F.col("source_type").isin("major_marketplace", "classifieds")).alias("markets"))


@query("ag09_country_audit", f"""WITH s AS (SELECT * FROM sources WHERE country IS NOT NULL AND source_type IS NOT NULL), t AS (SELECT country, source_type, count(*) AS n FROM s GROUP BY 1, 2),
a AS (SELECT country, string_agg(source_type || '=' || n, ',' ORDER BY source_type) AS by_type, list(source_type) AS have FROM t GROUP BY 1), w AS (SELECT country, count(*) AS total, count_if(live_status = 'WORKING') AS working FROM s GROUP BY 1)
SELECT code AS country, coalesce(total, 0) AS total, coalesce(working, 0) AS working, coalesce(by_type, '') AS by_type, array_to_string(list_filter({list(V.EXPECTED_TYPES)}, lambda k: NOT list_contains(coalesce(have, []), k)), ',') AS missing FROM {_COUNTRIES} LEFT JOIN a ON a.country = code LEFT JOIN w ON w.country = code""")
def ag09(s, d):
    out = readside.audit(V.countries(s), table(s, d, "sources"), list(V.EXPECTED_TYPES))
    kinds = F.array_join(F.transform(F.map_entries("by_type"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return out.select("country", "total", "working", F.coalesce(kinds, F.lit("")).alias("by_type"), F.array_join("missing", ",").alias("missing"))


def _counter_sql(section: str, source: str, tests: dict[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{k}' AS name, {c if c.startswith('count') else f'count_if({c})'} AS value FROM {source}" for k, c in tests.items())


_REPORT = " UNION ALL ".join([
    _counter_sql("sources", "sources", {"sources_total": "true", "working": "live_status = 'WORKING'", "blocked": "live_status IN ('BLOCKED','ROBOTS_DISALLOWED','LOGIN_REQUIRED')", "failed": "live_status IN ('DEAD','PARSER_BROKEN')", "active_sources": "active", "sources_attempted": "last_checked_at IS NOT NULL", "countries_attempted": "count(DISTINCT coalesce(country, '-')) FILTER (last_checked_at IS NOT NULL)"}),
    _counter_sql("listings", _L, {"confirmed": "confidence >= 95", "likely": "confidence >= 80 AND confidence < 95", "low": "confidence < 40", "archived": "listing_status IN ('EXPIRED','ARCHIVED','REMOVED')", "valid": _ACTIVE}),
    _counter_sql("hits", "search_hits", {"hits": "true"} | {f"hits_{x.lower()}": f"processing_status = '{x}'" for x in ("INGESTED", "SOURCE_REGISTERED", "SKIPPED", "BLOCKED", "ERROR", "PENDING")} | {"queries": "count(DISTINCT query)"}),
])


@query("ag05_report", _REPORT)
def ag05(s, d):
    return readside.report(listings(s, d), table(s, d, "sources"), table(s, d, "search_hits"), "OTHER")


@query("ag15_attempted", "SELECT value, name FROM (" + _REPORT + ") WHERE name IN ('countries_attempted','sources_attempted')")
def ag15(s, d):
    return readside.report(listings(s, d), table(s, d, "sources"), table(s, d, "search_hits"), "OTHER").where("name LIKE '%attempted'").select("value", "name")


@query("snk08_report_lines", "SELECT section, row_number() OVER (PARTITION BY section ORDER BY name) AS line_no, rpad(name, 24, ' ') || lpad(CAST(value AS VARCHAR), 10, ' ') AS line FROM (" + _REPORT + ")")
def snk08(s, d):
    return readside.as_lines(readside.report(listings(s, d), table(s, d, "sources"), table(s, d, "search_hits"), "OTHER"))


@query("ag08_confidence_bands", f"SELECT count_if(confidence >= 95) AS top, count_if(confidence >= 80 AND confidence < 95) AS high, count_if(confidence < 40) AS low FROM {_L}")
def ag08(s, d):
    c = F.col("confidence")
    return listings(s, d).agg(F.count_if(c >= 95).alias("top"), F.count_if((c >= 80) & (c < 95)).alias("high"), F.count_if(c < 40).alias("low"))


@query("ag21_first_report", f"""SELECT * FROM (SELECT 'active' AS section, listing_id AS id FROM {_L} WHERE {_ACTIVE} AND confidence >= 60 ORDER BY score DESC NULLS LAST, confidence DESC, listing_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'uncertain', listing_id FROM {_L} WHERE {_ACTIVE} AND confidence BETWEEN 40 AND 59 ORDER BY score DESC NULLS LAST, confidence DESC, listing_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'archived', listing_id FROM listings WHERE listing_status IN ('EXPIRED','ARCHIVED','REMOVED') ORDER BY last_seen_at DESC NULLS LAST, listing_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'dealers', source_id FROM sources WHERE source_type IN ('dealer','garage') ORDER BY discovery_value DESC NULLS LAST, source_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'newest_sources', source_id FROM sources ORDER BY first_discovered_at DESC NULLS LAST, source_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'failed', source_id FROM sources WHERE health = 'failed' ORDER BY failure_count DESC NULLS LAST, source_id LIMIT 50)
UNION ALL SELECT * FROM (SELECT 'inactive', source_id FROM sources WHERE NOT active ORDER BY priority DESC NULLS LAST, source_id LIMIT 50)""")
def ag21(s, d):
    parts = readside.first_report(listings(s, d), table(s, d, "sources"), "OTHER")
    rows = [df.select(F.lit(k).alias("section"), F.col("listing_id" if "listing_id" in df.columns else "source_id").alias("id")) for k, df in parts.items()]
    return discovery.bag(*rows)


@query("so07_failures", "SELECT source_id FROM sources WHERE health = 'failed' ORDER BY failure_count DESC NULLS LAST, source_id LIMIT 50")
def so07(s, d):
    return readside.first_report(listings(s, d), table(s, d, "sources"))["failed"].select("source_id")


@query("ag22_statistics", f"""SELECT h.total_active, m.seen, x.failed FROM (SELECT count_if({_ACTIVE} AND confidence >= 60) AS total_active FROM {_L}) h, (SELECT count(*) AS seen FROM listings) m, (SELECT count_if(health = 'failed') AS failed FROM sources) x""")
def ag22(s, d):
    j = readside.statistics(listings(s, d), table(s, d, "sources"), _now(), "OTHER")
    read = lambda c, k: F.get_json_object(c, f"$.{k}").cast("long").alias(k)
    return j.select(read("home", "total_active"), read("metrics", "seen"), read("health", "failed"))


@query("ag16_best_candidate", "SELECT country, first(listing_id ORDER BY confidence DESC, listing_id) AS listing_id FROM " + _L + " WHERE country IS NOT NULL GROUP BY 1")
def ag16(s, d):
    rows = listings(s, d).where("country IS NOT NULL").select("country", "listing_id", "confidence")
    return readside.best_of_each(rows, "country", "confidence", "listing_id").select("country", "listing_id")


@query("ag10_outcome_funnel", "SELECT source_domain, count(*) AS total, count_if(page_type = 'INDIVIDUAL_LISTING') AS individual_listing, count_if(page_type = 'SEARCH_RESULTS') AS search_results FROM raw_listings GROUP BY 1")
def ag10(s, d):
    return readside.funnel(table(s, d, "raw_listings"), "source_domain", "page_type", ["INDIVIDUAL_LISTING", "SEARCH_RESULTS"])


@query("so06_coverage_order", f"SELECT code AS country, row_number() OVER (ORDER BY n DESC, code) AS place FROM (SELECT code, count(source_id) AS n FROM {_COUNTRIES} LEFT JOIN (SELECT source_id, country FROM sources) s ON s.country = code GROUP BY 1)")
def so06(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(1)).orderBy(F.desc("sources"), "country")  # 28 rows
    return readside.coverage_by_type(V.countries(s), table(s, d, "sources"), []).select("country", F.row_number().over(w).alias("place"))


@query("snk06_alert_text", r"""SELECT listing_id, replace(coalesce(title, '?') || chr(10) || 'Price: ' || coalesce(format('{:,}', CAST(round_even(price_eur, 0) AS BIGINT)), '?') || ' EUR' || chr(10) || 'Mileage: ' || coalesce(format('{:,}', CAST(mileage_km AS BIGINT)), '?') || ' km' || chr(10) || 'Country: ' || coalesce(country, '?') || chr(10) || coalesce(listing_url, '?'), chr(10), ' / ') AS alert FROM listings""")
def snk06(s, d):
    t = readside.alert(F.col("title"), F.col("price_eur"), F.col("mileage_km"), F.col("country"), F.col("listing_url"))
    return table(s, d, "listings").select("listing_id", F.replace(t, F.lit("\n"), F.lit(" / ")).alias("alert"))


@query("snk07_json_rows", "SELECT listing_id, to_json({'listing_id': listing_id, 'make': make, 'mileage_km': mileage_km}) AS j FROM listings WHERE make IS NOT NULL AND mileage_km IS NOT NULL")
def snk07(s, d):
    return table(s, d, "listings").where("make IS NOT NULL AND mileage_km IS NOT NULL").select("listing_id", F.to_json(F.struct("listing_id", "make", "mileage_km")).alias("j"))


# crawling
def _in(column: str, marks: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{m}')" for m in marks) + ")"


_PLATFORM = f"({_in('domain', V.PLATFORMS)} OR domain IN {V.BIG_DOMAINS})"


@query("cl07_platforms", f"SELECT hit_id, coalesce({_PLATFORM}, false) AS platform FROM search_hits")
def cl07(s, d):
    return table(s, d, "search_hits").select("hit_id", crawl.is_platform(F.col("domain")).alias("platform"))


_BLOB = "lower(' ' || coalesce(domain, '') || ' ' || coalesce(title, '') || ' ')"
_MARKET, _OTHER = _in("b", V.MARKET_TERMS), _in("b", V.DISCOVERY_TERMS)


@query("cl06_site_category", f"""WITH a AS (SELECT hit_id, {_BLOB} AS b FROM search_hits WHERE domain IS NOT NULL) SELECT hit_id, CASE WHEN {_MARKET} THEN 'MONITORABLE_VEHICLE_SOURCE' ELSE 'DISCOVERY_ONLY_SOURCE' END AS category,
CASE WHEN {_MARKET} AND NOT {_OTHER} THEN 70 WHEN {_MARKET} THEN 55 WHEN {_OTHER} THEN 30 ELSE 40 END AS relevance, {_MARKET} AS monitorable,
array_to_string(list_filter(CASE WHEN {_MARKET} THEN {list(V.MARKET_TERMS)} ELSE {list(V.DISCOVERY_TERMS)} END, lambda t: contains(b, t))[1:4], ',') AS signals FROM a""")
def cl06(s, d):
    c = crawl.site_category(F.col("domain"), F.col("title"))
    return table(s, d, "search_hits").where("domain IS NOT NULL").select("hit_id", c.alias("c")).select("hit_id", "c.category", "c.relevance", "c.monitorable", F.array_join("c.signals", ",").alias("signals"))


_HIT = "CASE page_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in V.HIT_TYPES.items()) + " ELSE 'IRRELEVANT' END"


@query("cl08_hit_type", f"""WITH a AS (SELECT raw_id, source_domain, {_HIT} AS t, lower(' ' || source_domain || ' ' || coalesce(title, '') || ' ') AS b FROM raw_listings)
SELECT raw_id, CASE WHEN t IN ('IRRELEVANT','HOMEPAGE') AND NOT {_MARKET} AND {_in('source_domain', V.PARTS_DOMAINS)} THEN 'PARTS_PAGE' ELSE t END AS hit_type FROM a""")
def cl08(s, d):
    return table(s, d, "raw_listings").select("raw_id", crawl.hit_type(F.col("page_type"), F.col("source_domain"), F.col("title")).alias("hit_type"))


_FT = "lower(coalesce(text, ''))"


@query("cl09_crawl_outcome", f"""WITH n AS (SELECT source_domain, count(*) AS n FROM raw_listings WHERE year = 2012 GROUP BY 1)
SELECT fetch_id, CASE WHEN url IS NULL THEN 'NO_TARGET' WHEN blocked_by_robots THEN 'ROBOTS' WHEN from_cache THEN CASE WHEN n > 0 THEN 'ACCESSIBLE' ELSE 'UNCHANGED' END WHEN ok THEN CASE WHEN n > 0 THEN 'ACCESSIBLE' WHEN {_in(_FT, V.CRAWL_SCRIPT_MARKS)} THEN 'JS_REQUIRED' ELSE 'EMPTY' END
 WHEN status_code IN (403, 429, 404) THEN 'HTTP_' || status_code ELSE 'ERROR' END AS outcome FROM fetch_results LEFT JOIN n USING (source_domain)""")
def cl09(s, d):
    n = table(s, d, "raw_listings").where("year = 2012").groupBy("source_domain").agg(F.count(F.lit(1)).alias("n"))
    rows = table(s, d, "fetch_results").join(n, "source_domain", "left")
    return rows.select("fetch_id", crawl.crawl_outcome({c: F.col(c) for c in ("url", "blocked_by_robots", "from_cache", "ok", "status_code", "text")}, F.col("n")).alias("outcome"))


_ACCESS = f"""CASE WHEN blocked_by_robots THEN 'ROBOTS_DISALLOWED' WHEN status_code = 429 THEN 'RATE_LIMITED' WHEN status_code = 401 THEN 'LOGIN_REQUIRED' WHEN status_code = 403 THEN 'BLOCKED'
 WHEN status_code BETWEEN 200 AND 299 THEN CASE WHEN {_in(_FT, V.CAPTCHA_MARKS)} THEN 'BLOCKED' WHEN {_in(_FT, V.LOGIN_MARKS)} THEN 'LOGIN_REQUIRED' WHEN length({_FT}) < 1500 AND {_in(_FT, V.SCRIPT_MARKS)} THEN 'JS_REQUIRED' ELSE 'ACCESSIBLE' END ELSE 'ERROR' END"""


@query("cl10_access", f"SELECT fetch_id, {_ACCESS} AS access FROM fetch_results")
def cl10(s, d):
    return table(s, d, "fetch_results").select("fetch_id", crawl.access(F.col("blocked_by_robots"), F.col("status_code"), F.col("text")).alias("access"))


@query("cl11_live_status", f"""WITH n AS (SELECT source_domain, count(*) AS n FROM raw_listings WHERE year = 2012 GROUP BY 1), p AS (SELECT fetch_id, {_ACCESS} AS a, n, fetch_id % 5 AS typical, fetch_id % 3 > 0 AS r FROM fetch_results LEFT JOIN n USING (source_domain))
SELECT fetch_id, CASE WHEN a = 'ACCESSIBLE' THEN CASE WHEN n > 0 THEN 'WORKING' WHEN typical >= 3 THEN 'PARSER_BROKEN' ELSE 'PARTIALLY_WORKING' END WHEN a = 'ERROR' AND NOT r THEN 'DEAD' WHEN a IN ('BLOCKED','RATE_LIMITED','ROBOTS_DISALLOWED','JS_REQUIRED','LOGIN_REQUIRED') THEN a ELSE 'UNKNOWN' END AS live FROM p""")
def cl11(s, d):
    n = table(s, d, "raw_listings").where("year = 2012").groupBy("source_domain").agg(F.count(F.lit(1)).alias("n"))
    probe = crawl.access(F.col("blocked_by_robots"), F.col("status_code"), F.col("text"))
    return table(s, d, "fetch_results").join(n, "source_domain", "left").select("fetch_id", crawl.live_status(probe, F.col("n"), F.col("fetch_id") % 5, F.col("fetch_id") % 3 > 0).alias("live"))


_SITE = " ".join(f"WHEN {_in('b', w)} THEN '{k}'" for k, w in V.SITE_WORDS.items())


@query("cl12_site_type", f"""WITH a AS (SELECT hit_id, domain, lower(coalesce(domain, '') || ' ' || coalesce(title, '')) AS b FROM search_hits), k AS (SELECT *, CASE {_SITE} ELSE 'other' END AS t FROM a)
SELECT hit_id, t AS source_type, t IN ('youngtimer_dealer','dealer','classifieds') OR regexp_matches(b, '(^|[^\\pL\\pN_])(km|kw|ps|€|eur)([^\\pL\\pN_]|$)') AS sells, CASE WHEN coalesce({_PLATFORM}, false) THEN 25 WHEN t IN ('youngtimer_dealer','dealer') THEN 75 ELSE 55 END AS discovery_value FROM k""")
def cl12(s, d):
    return table(s, d, "search_hits").select("hit_id", crawl.site_type(F.col("domain"), F.col("title")).alias("t")).select("hit_id", "t.*")


@query("cl13_conditions", "WITH a AS (SELECT raw_id, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS b FROM raw_listings) SELECT raw_id, " + ", ".join(f"{_in('b', w)} AS {k}" for k, w in V.CONDITION_WORDS.items()) + " FROM a")
def cl13(s, d):
    return table(s, d, "raw_listings").select("raw_id", crawl.conditions(F.col("title"), F.col("description")).alias("c")).select("raw_id", "c.*")


@query("cl14_diagnosis", f"""SELECT fetch_id, CASE WHEN coalesce(status_code IN (401, 403, 429), false) OR {_in(_FT, V.BLOCK_MARKS)} THEN 'access_block_or_rate_limit' WHEN {_in(_FT, V.EMPTY_MARKS)} THEN 'empty_inventory' WHEN fetch_id % 4 = 0 AND fetch_id % 3 > 0 THEN 'possible_structure_change' ELSE 'unknown' END AS cause FROM fetch_results""")
def cl14(s, d):
    return table(s, d, "fetch_results").select("fetch_id", crawl.diagnosis(F.col("status_code"), F.col("text"), F.col("fetch_id") % 3, F.col("fetch_id") % 4).alias("cause"))


_DUE = "(SELECT *, CASE WHEN source_id % 6 > 0 THEN last_checked_at + to_hours(6) END AS next_check_at FROM sources)"


def _due(s, d):
    return table(s, d, "sources").withColumn("next_check_at", F.when(F.col("source_id") % 6 > 0, X.next_check(F.lit("6h"), F.col("last_checked_at"))))


@query("cl18_due_sources", f"SELECT source_id FROM {_DUE} WHERE active AND (next_check_at IS NULL OR next_check_at <= TIMESTAMP '{NOW}') ORDER BY priority DESC NULLS LAST, source_id LIMIT 60")
def cl18(s, d):
    return crawl.due(_due(s, d), _now(), limit=60).select("source_id")


@query("cl25_priority_sweep", "SELECT source_id FROM sources WHERE active AND priority >= 70")
def cl25(s, d):
    return crawl.sweep(table(s, d, "sources")).select("source_id")


_LONG = f"coalesce(NOT {_PLATFORM} AND (source_type IN {V.LONG_TAIL_TYPES} OR coalesce(discovery_value, 0) >= 60), false)"


@query("cl19_long_tail", f"SELECT source_id, {_LONG} AS long_tail FROM sources")
def cl19(s, d):
    return table(s, d, "sources").select("source_id", crawl.is_long_tail(F.col("domain"), F.col("source_type"), F.col("discovery_value")).alias("long_tail"))


@query("cl20_price_drops", """WITH k AS (SELECT listing_id, captured_at AS changed_at, snapshot_id, round(price_eur - lag(price_eur) OVER (PARTITION BY listing_id ORDER BY captured_at, snapshot_id), 2) AS delta FROM listing_snapshots WHERE price_eur IS NOT NULL)
SELECT listing_id, delta FROM k WHERE delta <= -1 ORDER BY changed_at DESC NULLS LAST, listing_id LIMIT 25""")
def cl20(s, d):
    obs = table(s, d, "listing_snapshots").select("listing_id", "captured_at", "snapshot_id", F.col("price_eur").alias("price_original"), F.lit("EUR").alias("currency"), "price_eur")
    return readside.price_drops(ledger.original_price_changes(obs, "listing_id", "captured_at", "snapshot_id")).select("listing_id", "delta")


@query("cl21_listing_hint", f"SELECT hit_id, coalesce({_in('lower(exact_url)', V.LISTING_HINTS)}, false) AS hint FROM search_hits")
def cl21(s, d):
    return table(s, d, "search_hits").select("hit_id", crawl.listing_hint(F.col("exact_url")).alias("hint"))


@query("cl22_hit_route", f"""SELECT hit_id, CASE WHEN coalesce({_PLATFORM}, false) AND NOT coalesce({_in('lower(exact_url)', V.LISTING_HINTS)}, false) THEN 'SKIPPED' WHEN hit_id % 50 = 0 OR http_status IN (401, 403, 429) THEN 'BLOCKED' WHEN http_status IS NULL OR http_status NOT BETWEEN 200 AND 299 THEN 'ERROR'
 WHEN hit_type = 'LISTING' THEN 'INGESTED' WHEN hit_type IN ('DEALER_INVENTORY','HOMEPAGE') THEN 'REGISTERED' ELSE 'SKIPPED' END AS route FROM search_hits""")
def cl22(s, d):
    return table(s, d, "search_hits").select("hit_id", crawl.hit_route(F.col("exact_url"), F.col("domain"), F.col("hit_id") % 50 == 0, F.col("http_status"), F.col("hit_type")).alias("route"))


@query("sc13_provenance", f"""SELECT listing_id, coalesce(s.domain, 'seed') AS discovery_source, CASE WHEN source_type = 'aggregator' THEN s.domain END AS aggregator, CASE WHEN source_type IN {V.MARKETPLACE_TYPES} THEN s.domain END AS marketplace, {_LONG} AS long_tail FROM listings l LEFT JOIN (SELECT source_id, domain, source_type, discovery_value FROM sources) s USING (source_id)""")
def sc13(s, d):
    return crawl.provenance(table(s, d, "listings").select("listing_id", "source_id"), table(s, d, "sources"))


@query("src07_strategy", "SELECT source_id, CASE WHEN source_id % 4 = 0 AND source_id % 5 > 0 THEN 'FEED' WHEN source_type IN ('dealer','garage') AND source_id % 5 < 3 AND source_id % 7 > 1 THEN 'PAGE+SITEMAP' ELSE 'PAGE' END AS strategy FROM sources")
def src07(s, d):
    i = F.col("source_id")
    return table(s, d, "sources").select("source_id", crawl.strategy(F.col("source_type"), i % 4 == 0, i % 5, i % 7).alias("strategy"))


@query("sc15_notes", "WITH a AS (SELECT raw_id, lower(coalesce(title, '') || ' ' || coalesce(description, '')) AS b FROM raw_listings) SELECT raw_id, nullif(concat_ws('; ', " + ", ".join(f"CASE WHEN {_in('b', V.CONDITION_WORDS[k])} THEN '{k}' END" for k in ("rust", "accident", "engine", "gearbox")) + "), '') AS notes FROM a")
def sc15(s, d):
    return table(s, d, "raw_listings").select("raw_id", crawl.notes(crawl.conditions(F.col("title"), F.col("description"))).alias("notes"))


@query("sc14_final_links", f"""WITH a AS (SELECT listing_id, original_listing_url AS o, dealer_domain AS dd, list_concat([original_listing_url, listing_url], coalesce(alternate_urls, [])) AS u FROM listings), b AS (SELECT *, list_filter(u, lambda x: x IS NOT NULL AND x <> '') AS us FROM a)
SELECT listing_id, coalesce(list_filter(us, lambda x: {_SPEC} AND {_DOM} = dd)[1], list_filter(us, lambda x: {_SPEC} AND NOT {' AND NOT '.join(f"contains({_DOM}, '{p}')" for p in V.PLATFORMS)})[1], list_filter(us, lambda x: {_SPEC})[1], us[1]) AS canonical, coalesce(list_filter(us, lambda x: {_SPEC} AND {_DOM} = dd)[1], o) AS original FROM b""")
def sc14(s, d):
    t = crawl.final_links(F.col("original_listing_url"), F.col("listing_url"), F.col("alternate_urls"), F.col("dealer_domain"))
    return table(s, d, "listings").select("listing_id", t.alias("t")).select("listing_id", "t.*")


@query("dm06_recategorised", f"""WITH a AS (SELECT *, lower(' ' || domain || ' ' || coalesce(name, '') || ' ') AS b FROM sources), k AS (SELECT *, {_MARKET} AND NOT {_PLATFORM} AS watch FROM a)
SELECT source_id, CASE WHEN {_MARKET} THEN 'MONITORABLE_VEHICLE_SOURCE' ELSE 'DISCOVERY_ONLY_SOURCE' END AS source_category, active AND watch AS active, CASE WHEN watch THEN discovery_value ELSE least(discovery_value, 25) END AS discovery_value FROM k""")
def dm06(s, d):
    return crawl.recategorised(table(s, d, "sources")).select("source_id", "source_category", "active", "discovery_value")


_SCANS = "(SELECT source_domain AS domain, fetched_at AS scanned_at, CAST(fetch_id % 7 AS INTEGER) AS n_found, NOT ok AS failed, CASE fetch_id % 3 WHEN 0 THEN '1h' WHEN 1 THEN 'daily' END AS frequency, CAST(date_part('day', fetched_at) AS INTEGER) AS run_id, CASE WHEN ok THEN 'ACCESSIBLE' ELSE 'ERROR' END AS outcome, fetch_id FROM fetch_results)"


def _scans(s, d):
    i = F.col("fetch_id")
    return table(s, d, "fetch_results").select(
        F.col("source_domain").alias("domain"), F.col("fetched_at").alias("scanned_at"), (i % 7).cast("int").alias("n_found"), (~F.col("ok")).alias("failed"), F.when(i % 3 == 0, "1h").when(i % 3 == 1, "daily").alias("frequency"),
        F.dayofmonth("fetched_at").alias("run_id"), F.when(F.col("ok"), "ACCESSIBLE").otherwise("ERROR").alias("outcome"), "fetch_id",
    )


@query("dm04_finalised_sources", f"""WITH l AS (SELECT domain, unnest(arg_max(s, scanned_at)) FROM (SELECT domain, scanned_at, {{'scanned_at': scanned_at, 'n_found': n_found, 'failed': failed, 'frequency': frequency}} AS s FROM {_SCANS}) GROUP BY 1)
SELECT source_id, CASE WHEN l.scanned_at IS NULL THEN health WHEN failed THEN 'failed' WHEN n_found > 0 THEN 'healthy' ELSE coalesce(health, 'unknown') END AS health, CAST(CASE WHEN l.scanned_at IS NULL THEN failure_count WHEN failed THEN coalesce(failure_count, 0) + 1 ELSE 0 END AS INTEGER) AS failure_count,
l.scanned_at + to_hours(CASE frequency WHEN '1h' THEN 1 WHEN 'daily' THEN 24 ELSE 6 END) AS next_check_at FROM sources LEFT JOIN l USING (domain)""")
def dm04(s, d):
    return crawl.finalised(table(s, d, "sources"), _scans(s, d)).select("source_id", "health", "failure_count", "next_check_at")


@query("dm15_scan_rows", f"SELECT run_id, min(scanned_at) AS started, max(scanned_at) AS ended, count(*) AS n_sources, CAST(sum(n_found) AS BIGINT) AS n_found, count_if(failed) AS n_failed, count_if(outcome = 'ERROR') AS errors FROM {_SCANS} GROUP BY 1")
def dm15(s, d):
    return crawl.scan_row(_scans(s, d)).select("run_id", "started", "ended", "n_sources", "n_found", "n_failed", F.coalesce(F.try_element_at("outcomes", F.lit("ERROR")), F.lit(0)).alias("errors"))


@query("dm09_live_status", f"""WITH p AS (SELECT source_domain AS domain, arg_max({{'a': {_ACCESS}, 'n': fetch_id % 3, 'r': fetch_id % 5 > 0}}, fetched_at) AS p FROM fetch_results GROUP BY 1)
SELECT source_id, CASE WHEN p IS NULL THEN live_status WHEN p.a = 'ACCESSIBLE' THEN CASE WHEN p.n > 0 THEN 'WORKING' ELSE 'PARTIALLY_WORKING' END WHEN p.a = 'ERROR' AND NOT p.r THEN 'DEAD' WHEN p.a IN ('BLOCKED','RATE_LIMITED','ROBOTS_DISALLOWED','JS_REQUIRED','LOGIN_REQUIRED') THEN p.a ELSE 'UNKNOWN' END AS live_status,
coalesce(p.a = 'JS_REQUIRED', false) AS requires_browser FROM sources LEFT JOIN p USING (domain)""")
def dm09(s, d):
    i = F.col("fetch_id")
    probes = table(s, d, "fetch_results").select(F.col("source_domain").alias("domain"), crawl.access(F.col("blocked_by_robots"), F.col("status_code"), F.col("text")).alias("probe"), (i % 3).alias("n_found"), (i % 5 > 0).alias("resolves"), F.col("fetched_at").alias("probed_at"))
    return crawl.with_live_status(table(s, d, "sources"), probes).select("source_id", "live_status", "requires_browser")


@query("dm03_seller_sources", f"""WITH n AS (SELECT DISTINCT domain, country FROM (SELECT domain, min(country) AS country FROM (SELECT regexp_replace(dealer_domain, '^www\\.', '') AS domain, country FROM listings WHERE dealer_domain <> '') GROUP BY 1))
SELECT domain, country, discovery_value, priority FROM sources UNION ALL SELECT domain || '.new', country, 70, 65 FROM n WHERE NOT coalesce({_PLATFORM}, false)""")
def dm03(s, d):
    ls = table(s, d, "listings").where("dealer_domain <> ''")
    found = ls.select(crawl.own_site(F.concat(F.lit("https://"), F.col("dealer_domain")), F.lit(None).cast("string"), F.lit(None).cast("string"), F.col("title")).alias("domain"), "country").where("domain IS NOT NULL")
    return crawl.seller_sources(table(s, d, "sources"), found.withColumn("domain", F.concat("domain", F.lit(".new"))), _now()).select("domain", "country", "discovery_value", "priority")


@query("jn06_get_or_create", "SELECT domain, country, discovery_value FROM sources UNION ALL SELECT domain, min(country), 70 FROM (SELECT regexp_replace(domain, 'example', 'test') AS domain, country FROM search_hits WHERE domain IS NOT NULL) WHERE domain NOT IN (SELECT domain FROM sources) GROUP BY 1")
def jn06(s, d):
    found = table(s, d, "search_hits").where("domain IS NOT NULL").select(F.regexp_replace("domain", "example", "test").alias("domain"), "country")
    return crawl.seller_sources(table(s, d, "sources"), found, _now()).select("domain", "country", "discovery_value")


# discovery
WORDS = {"subject": ["Brankel Wald", "Brankel Wald 1.4"], "short": ["Wald 1.4", "Brankel 1,4"], "code": ["BW14"], "power": ["55 kW", "75 PS"], "word": ["stock", "garage"], "file": ["pdf", "rss"], "without": ["-autoscout24 -mobile"]}


@query("gn01_generated_queries", "WITH c(code, language, sale, used, dealer) AS (VALUES " + ", ".join("('{}','{}','{}','{}','{}')".format(c[0], c[2], c[5][0], c[6][0].replace("'", "''"), c[7][0]) for c in V.COUNTRIES) + "), t(family, n, q) AS (VALUES " + ", ".join(
    f"('{f}', {i}, '{q}')" for i, (f, q) in enumerate((f, q) for f, ts in discovery.FAMILIES.items() for t in ts for q in __import__("functools").reduce(lambda xs, kv: [x.replace('{' + kv[0] + '}', v) for x in xs for v in kv[1]] if any('{' + kv[0] + '}' in x for x in xs) else xs, WORDS.items(), [t]))
) + """), f AS (SELECT replace(replace(replace(q, '{sale}', sale), '{used}', used), '{dealer}', dealer) AS query, code AS country, language, family FROM c, t)
SELECT lower(query) AS query, country, any_value(language) AS language, min(family) AS family, min(family) IN ('A','B','E') AS high_value FROM f GROUP BY lower(query), country""")
def gn01(s, d):
    return discovery.generated(V.countries(s), WORDS).select(F.lower("query").alias("query"), "country", "language", "family", "high_value")


@query("gn02_countries", f"SELECT code, name, tld FROM {_COUNTRIES}")
def gn02(s, d):
    return V.countries(s).select("code", "name", "tld")


_RUNS = "(SELECT query, country, hit_id AS run_id, discovered_at AS run_at, CAST(rank AS INTEGER) AS result_count, CAST(hit_id % 4 AS INTEGER) AS new_domains FROM search_hits WHERE query IS NOT NULL AND country IS NOT NULL)"
_HISTORY = f"(SELECT query, country, count(*) AS run_count, CAST(sum(new_domains) AS BIGINT) AS new_domains_found, max(run_at) AS last_run_at FROM {_RUNS} WHERE run_id % 3 = 0 GROUP BY 1, 2)"
_PLAN = f"(SELECT query, country, min(language) AS language, CASE WHEN count(*) % 2 = 0 THEN 'B' ELSE 'C' END AS family, count(*) % 3 = 0 AS high_value, count(*) % 5 = 0 AS experimental FROM search_hits WHERE query IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2)"
_SCORED = f"""(SELECT p.query, p.country, p.family, round(CASE WHEN high_value THEN 3.0 ELSE 0 END + CASE WHEN family = 'B' THEN 2.0 ELSE 0 END + CASE WHEN experimental THEN 0.5 ELSE 0 END + CASE WHEN run_count IS NULL THEN 4.0 ELSE
 least(5.0, CAST(new_domains_found AS DOUBLE) / greatest(1, run_count) * 2) + least(3.0, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_run_at)) / 3.6e9 / 24) - CASE WHEN run_count >= 5 AND new_domains_found = 0 THEN 3.0 ELSE 0 END END, 6) AS score,
 coalesce((epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_run_at)) / 3.6e9 < 20, false) AS recent FROM {_PLAN} p LEFT JOIN {_HISTORY} h ON h.query = p.query AND h.country = p.country)"""


def _runs(s, d):
    return table(s, d, "search_hits").where("query IS NOT NULL AND country IS NOT NULL").select("query", "country", F.col("hit_id").alias("run_id"), F.col("discovered_at").alias("run_at"), F.col("rank").cast("int").alias("result_count"), (F.col("hit_id") % 4).cast("int").alias("new_domains"))


def _scored(s, d):
    n = F.count(F.lit(1))
    plan = table(s, d, "search_hits").where("query IS NOT NULL AND country IS NOT NULL").groupBy("query", "country").agg(F.min("language").alias("language"), F.when(n % 2 == 0, "B").otherwise("C").alias("family"), (n % 3 == 0).alias("high_value"), (n % 5 == 0).alias("experimental"))
    history = _runs(s, d).where("run_id % 3 = 0").groupBy("query", "country").agg(n.alias("run_count"), F.sum("new_domains").alias("new_domains_found"), F.max("run_at").alias("last_run_at"))
    return discovery.scored(plan, history, _now())


@query("sc08_query_scores", f"SELECT query, country, score, recent FROM {_SCORED}")
def sc08(s, d):
    return _scored(s, d).select("query", "country", "score", "recent")


@query("wn10_chosen_queries", f"SELECT query, country FROM {_SCORED} ORDER BY recent, score DESC, country, family, query LIMIT 40")
def wn10(s, d):
    return discovery.chosen(_scored(s, d)).select("query", "country")


@query("jn04_queries_with_history", f"SELECT p.query, p.country, run_count FROM {_PLAN} p LEFT JOIN {_HISTORY} h ON h.query = p.query AND h.country = p.country")
def jn04(s, d):
    return _scored(s, d).select("query", "country", "run_count")


@query("wn09_capped_pass", """WITH f AS (SELECT normalized_url, query, rank, hit_id FROM search_hits QUALIFY row_number() OVER (PARTITION BY normalized_url ORDER BY query NULLS FIRST, rank NULLS FIRST, hit_id) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank NULLS FIRST, hit_id) AS place FROM f QUALIFY place <= 12) SELECT hit_id, place FROM p ORDER BY query NULLS FIRST, place LIMIT 150""")
def wn09_pass(s, d):
    return discovery.capped_pass(table(s, d, "search_hits")).select("hit_id", "place")


@query("wn11_overall_rank", "SELECT hit_id, (coalesce(page, 1) - 1) * 20 + rank AS overall FROM search_hits")
def wn11(s, d):
    return table(s, d, "search_hits").select("hit_id", discovery.overall_rank(F.col("page"), F.col("rank")).alias("overall"))


_EVENTS = "(SELECT user_id AS source, event_id AS scan_id, ts AS scanned_at, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(floor(value) AS INTEGER) END AS n_found, event_type = 'error' AS failed FROM events)"


def _event_scans(s, d):
    e = table(s, d, "events")
    bad = F.col("event_type") == "error"
    return e.select(F.col("user_id").alias("source"), F.col("event_id").alias("scan_id"), F.col("ts").alias("scanned_at"), F.when(bad, 0).otherwise(F.floor("value")).cast("int").alias("n_found"), bad.alias("failed"))


@query("wn12_parser_failures", f"SELECT source, scan_id, typical FROM (SELECT *, CAST(round_even(avg(n_found) OVER (PARTITION BY source ORDER BY scanned_at, scan_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INTEGER) AS typical FROM {_EVENTS}) WHERE n_found = 0 AND typical >= 3")
def wn12(s, d):
    return discovery.parser_failures(_event_scans(s, d)).select("source", "scan_id", "typical")


@query("wn05_typical_count", "SELECT user_id, list_reduce(list_prepend(0.0::DOUBLE, list(floor(value)::DOUBLE ORDER BY ts, event_id)), lambda a, x: CAST(round_even(CAST(a * 0.7 + x * (1 - 0.7::DOUBLE) AS DECIMAL(18,6)), 0) AS DOUBLE)) AS average, count(*) AS n FROM events WHERE value IS NOT NULL AND event_type <> 'error' GROUP BY 1")
def wn05_typical(s, d):
    from lotwise.operators import history

    return history.smoothed(table(s, d, "events").where("event_type <> 'error'").withColumn("value", F.floor("value")), "user_id", "ts", "event_id", "value", digits=0)


BUDGETS = {"gridsearch": 300, "serpline": 100_000, "brightfind": 0, "idle": 10}
_BUDGET = "WITH b(provider, budget) AS (VALUES " + ", ".join(f"('{k}', CAST({v} AS BIGINT))" for k, v in BUDGETS.items()) + """), u AS (SELECT provider, count(*) AS used FROM search_hits WHERE http_status = 200 AND date_trunc('month', discovered_at) = DATE '2025-06-01' GROUP BY 1)
SELECT provider, coalesce(used, 0) AS used, budget, CASE WHEN budget > 0 THEN greatest(0, budget - coalesce(used, 0)) END AS remaining, budget <= 0 OR coalesce(used, 0) < budget AS ok, budget > 0 AND coalesce(used, 0) / budget >= 0.8 AS warn, CASE WHEN budget > 0 THEN round(coalesce(used, 0) / budget, 3) ELSE 0 END AS pct FROM b LEFT JOIN u USING (provider)"""


@query("sc17_budgets", _BUDGET)
def sc17(s, d):
    usage = table(s, d, "search_hits").select("provider", F.col("discovered_at").alias("created_at"), F.coalesce(F.col("http_status") == 200, F.lit(False)).alias("ok"))
    return discovery.budget(usage, BUDGETS, F.to_timestamp_ntz(F.lit("2025-06-01 00:00:00")))


@query("ag20_budget_states", "SELECT provider, used, ok FROM (" + _BUDGET + ")")
def ag20(s, d):
    return sc17(s, d).select("provider", "used", "ok")


@query("ag13_monthly_spend", "SELECT CAST(round(sum(CAST(coalesce(value / 1000, 0) AS DECIMAL(18,6))), 4) AS DOUBLE) AS spent FROM events WHERE date_trunc('month', ts) = DATE '2024-01-01'")
def ag13(s, d):
    return discovery.spend(table(s, d, "events").select(F.col("ts").alias("created_at"), (F.col("value") / 1000).alias("cost")), F.to_timestamp_ntz(F.lit("2024-01-01 00:00:00")))


@query("dm07_upserted_queries", f"""WITH k AS (SELECT *, 0.5::DOUBLE AS e FROM {_HISTORY}), n AS (SELECT query, country, count(*) AS more, CAST(sum(new_domains) AS BIGINT) AS found, max(run_at) AS run_at, list(new_domains::DOUBLE ORDER BY run_at, run_id) AS vs FROM {_RUNS} WHERE run_id % 3 > 0 GROUP BY 1, 2)
SELECT coalesce(k.query, n.query) AS query, coalesce(k.country, n.country) AS country, coalesce(run_count, 0) + coalesce(more, 0) AS run_count, coalesce(new_domains_found, 0) + coalesce(found, 0) AS new_domains_found, coalesce(run_at, last_run_at) AS last_run_at,
list_reduce(list_prepend(coalesce(e, 0), coalesce(vs, [])), lambda a, x: CAST(round_even(CAST(a * 0.7 + x * 0.3 AS DECIMAL(18,6)), 3) AS DOUBLE)) AS effectiveness FROM k FULL JOIN n ON k.query = n.query AND k.country = n.country""")
def dm07(s, d):
    runs = _runs(s, d)
    known = runs.where("run_id % 3 = 0").groupBy("query", "country").agg(F.count(F.lit(1)).alias("run_count"), F.sum("new_domains").alias("new_domains_found"), F.max("run_at").alias("last_run_at")).withColumns({"result_count": F.lit(None).cast("int"), "effectiveness": F.lit(0.5)})
    return discovery.upserted_queries(known, runs.where("run_id % 3 > 0")).drop("result_count")


@query("dm08_settled_hits", "SELECT hit_id, CASE WHEN hit_id % 3 > 0 THEN hit_type ELSE 'UNKNOWN' END AS hit_type, CASE WHEN hit_id % 3 > 0 THEN processing_status ELSE 'PENDING' END AS processing_status FROM search_hits")
def dm08(s, d):
    hits = table(s, d, "search_hits")
    old = hits.select("hit_id", F.lit("X").alias("hit_type"), F.lit("OLD").alias("processing_status"), "http_status", F.lit(0).alias("seq"))
    outcomes = hits.select("hit_id", "hit_type", "processing_status", "http_status", F.lit(1).alias("seq")).union(old).where("hit_id % 3 > 0")
    return discovery.settled_hits(hits, outcomes).select("hit_id", "hit_type", "processing_status")


@query("dm17_usage_log", "SELECT hit_id, substr(query, 1, 5) AS query, CASE WHEN hit_id % 2 = 0 THEN http_status = 200 END AS ok FROM search_hits")
def dm17(s, d):
    hits = table(s, d, "search_hits")
    old = hits.where("hit_id % 2 = 1").select("hit_id", F.substring("query", 1, 5).alias("query"))
    return discovery.logged(old, hits.where("hit_id % 2 = 0").select("hit_id", "query", (F.col("http_status") == 200).alias("ok")), most=5)


@query("ag17_source_counters", "SELECT source_id, coalesce(priority, 0) + count(listing_id) FILTER (mileage_km > 100000) AS priority, coalesce(count(listing_id) FILTER (price_eur < 5000), 0) AS cheap FROM sources LEFT JOIN (SELECT source_id, listing_id, mileage_km, price_eur FROM listings) l USING (source_id) GROUP BY source_id, priority")
def ag17(s, d):
    new = table(s, d, "listings").select("source_id", (F.col("mileage_km") > 100000).alias("priority"), (F.col("price_eur") < 5000).alias("cheap"))
    return discovery.counted(table(s, d, "sources"), new, ["priority", "cheap"]).select("source_id", "priority", "cheap")


@query("jn03_cached_answers", "SELECT snapshot_id, CASE WHEN content_hash = h THEN a END AS answer FROM listing_snapshots LEFT JOIN (SELECT listing_id, arg_min(content_hash, snapshot_id) AS h, 'A' || listing_id AS a FROM listing_snapshots WHERE content_hash IS NOT NULL GROUP BY listing_id) USING (listing_id)")
def jn03(s, d):
    snaps = table(s, d, "listing_snapshots")
    cache = snaps.where("content_hash IS NOT NULL").groupBy("listing_id").agg(F.min_by("content_hash", "snapshot_id").alias("content_hash")).withColumn("answer", F.concat(F.lit("A"), F.col("listing_id").cast("string")))
    return discovery.cached(snaps, cache, "listing_id", "content_hash").select("snapshot_id", "answer")


@query("st06_bag_of_candidates", "SELECT raw_id, title, 'feed' AS reader FROM raw_listings WHERE extraction_method = 'feed' UNION ALL SELECT raw_id, title, 'page' FROM raw_listings WHERE extraction_method <> 'feed'")
def st06(s, d):
    raw = table(s, d, "raw_listings")
    part = lambda c, k: raw.where(c).select("raw_id", "title", F.lit(k).alias("reader"))
    return discovery.bag(part("extraction_method = 'feed'", "feed"), part("extraction_method <> 'feed'", "page"))


# ledger
_ADVERTS = f"(SELECT {_NORM.format(u='url')} AS internal_id, raw_id AS seq, crawled_at AS seen_at, price AS price_original, currency, CAST(price AS DOUBLE) * CASE WHEN raw_id % 2 = 0 THEN 1.1 ELSE 1.0 END AS price_eur, mileage_km, title FROM raw_listings WHERE url IS NOT NULL AND crawled_at IS NOT NULL)"


def _adverts(s, d):
    raw = table(s, d, "raw_listings").where("url IS NOT NULL AND crawled_at IS NOT NULL")
    return raw.select(U.normalize(F.col("url")).alias("internal_id"), F.col("raw_id").alias("seq"), F.col("crawled_at").alias("seen_at"), F.col("price").alias("price_original"), "currency", (F.col("price") * F.when(F.col("raw_id") % 2 == 0, 1.1).otherwise(1.0)).alias("price_eur"), "mileage_km", "title")


# the snapshots' prices taken as originals, one in nine as pounds
@query("wn01_original_currency", """WITH o AS (SELECT *, CASE WHEN snapshot_id % 9 = 0 THEN 'GBP' ELSE 'EUR' END AS currency FROM listing_snapshots WHERE price_eur IS NOT NULL), k AS (SELECT *, lag(price_eur) OVER w AS p, lag(currency) OVER w AS c FROM o WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at, snapshot_id))
SELECT listing_id, snapshot_id, p AS old_price, price_eur AS new_price, currency FROM k WHERE p IS NOT NULL AND (currency <> c OR abs(price_eur - p) >= 1)""")
def wn01_original(s, d):
    obs = table(s, d, "listing_snapshots").select("listing_id", "captured_at", "snapshot_id", F.col("price_eur").alias("price_original"), F.when(F.col("snapshot_id") % 9 == 0, "GBP").otherwise("EUR").alias("currency"), F.col("price_eur"))
    return ledger.original_price_changes(obs, "listing_id", "captured_at", "snapshot_id").select("listing_id", "snapshot_id", "old_price", "new_price", "currency")


@query("wn03_misses", """WITH s AS (SELECT user_id, event_id, ts, event_type <> 'error' AS seen FROM events), i AS (SELECT *, sum(CAST(seen AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts) AS island FROM s), n AS (SELECT *, sum(CAST(NOT seen AS INTEGER)) OVER (PARTITION BY user_id, island ORDER BY ts) AS misses FROM i)
SELECT user_id, ts, CAST(misses AS BIGINT) AS misses, CASE WHEN misses = 0 THEN 'ACTIVE' WHEN misses >= 3 THEN 'EXPIRED' ELSE 'MAYBE_ACTIVE' END AS status FROM n""")
def wn03(s, d):
    return ledger.misses(table(s, d, "events").select("user_id", "ts", (F.col("event_type") != "error").alias("seen")), "user_id", "ts")


@query("ss02_gone_stale", """SELECT listing_id, CASE WHEN NOT late THEN listing_status WHEN m >= 3 THEN 'EXPIRED' WHEN m = 1 THEN 'MAYBE_ACTIVE' ELSE listing_status END AS listing_status, CAST(CASE WHEN late THEN m ELSE m - 1 END AS INTEGER) AS consecutive_misses FROM
(SELECT *, coalesce(consecutive_misses, 0) + 1 AS m, coalesce(listing_status IN ('ACTIVE','MAYBE_ACTIVE') AND (last_seen_at IS NULL OR last_seen_at < TIMESTAMP '2025-07-01' - INTERVAL 20 HOURS), false) AS late FROM listings)""")
def ss02(s, d):
    return ledger.gone_stale(table(s, d, "listings"), F.to_timestamp_ntz(F.lit("2025-07-01 00:00:00"))).select("listing_id", "listing_status", F.col("consecutive_misses").cast("int").alias("consecutive_misses"))


def _ledger(s, d):
    """State after the adverts of odd ids, and the observations of even ids."""
    obs = _adverts(s, d)
    empty = s.createDataFrame([], "internal_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, listing_status string, consecutive_misses int, price_original double, currency string, price_eur double, mileage_km int, title string")
    first = ledger.merged_state(empty, obs.where("seq % 2 = 1"), ["mileage_km", "title"])
    return first, obs.where("seq % 2 = 0")


@query("dm01_merged_state", f"""WITH o AS (SELECT * FROM {_ADVERTS}) SELECT internal_id, min(seen_at) AS first_seen_at, max(seen_at) AS last_seen_at, 'ACTIVE' AS listing_status,
coalesce(arg_min(mileage_km, (seen_at, seq)) FILTER (seq % 2 = 1 AND mileage_km IS NOT NULL), arg_min(mileage_km, (seen_at, seq)) FILTER (seq % 2 = 0 AND mileage_km IS NOT NULL)) AS mileage_km FROM o GROUP BY 1""")
def dm01(s, d):
    state, more = _ledger(s, d)
    return ledger.merged_state(state, more, ["mileage_km", "title"]).select("internal_id", "first_seen_at", "last_seen_at", "listing_status", "mileage_km")


@query("dm02_latest_price", f"""WITH a AS (SELECT internal_id, max(seen_at) AS s1, arg_max(price_original, (seen_at, seq)) FILTER (price_original IS NOT NULL) AS p1 FROM {_ADVERTS} WHERE seq % 2 = 1 GROUP BY 1),
b AS (SELECT internal_id, max(seen_at) FILTER (price_original IS NOT NULL) AS t2, arg_max(price_original, (seen_at, seq)) FILTER (price_original IS NOT NULL) AS p2 FROM {_ADVERTS} WHERE seq % 2 = 0 GROUP BY 1)
SELECT internal_id, CASE WHEN p2 IS NOT NULL AND (s1 IS NULL OR t2 >= s1 OR p1 IS NULL) THEN p2 ELSE p1 END AS price_original FROM a FULL JOIN b USING (internal_id)""")
def dm02_price(s, d):
    state, more = _ledger(s, d)
    return ledger.merged_state(state, more, ["mileage_km", "title"]).select("internal_id", "price_original")


@query("dm14_status_rows", f"SELECT internal_id, NULL::VARCHAR AS old_status, 'ACTIVE' AS new_status FROM {_ADVERTS} GROUP BY 1 HAVING count_if(seq % 2 = 1) = 0")
def dm14(s, d):
    state, more = _ledger(s, d)
    after = ledger.merged_state(state, more, ["mileage_km", "title"])
    return ledger.status_rows(state, after, _now()).select("internal_id", "old_status", "new_status")


_BEST = "coalesce(" + ", ".join(f"CASE WHEN {_QUALITY.format(u=u)} IN ('EXACT_DETAIL','LIKELY_DETAIL') THEN {u} END" for u in ("canonical_listing_url", "original_listing_url", "listing_url")) + ")"


@query("dm05_reviewed", f"""WITH a AS (SELECT *, {_BEST} AS best FROM listings), b AS (SELECT *, coalesce(best, listing_url) AS q FROM a)
SELECT listing_id, {_QUALITY.format(u='q')} AS listing_url_quality, CASE WHEN listing_status = 'UNRESOLVED' AND best IS NOT NULL THEN 'ACTIVE' WHEN listing_status = 'ACTIVE' AND best IS NULL THEN 'UNRESOLVED' ELSE listing_status END AS listing_status FROM b""")
def dm05(s, d):
    return ledger.reviewed(table(s, d, "listings")).select("listing_id", "listing_url_quality", "listing_status")


@query("ag18_change_counts", f"""WITH a AS (SELECT *, {_BEST} AS best FROM listings), b AS (SELECT *, coalesce(best, listing_url) AS q FROM a)
SELECT count(*) AS total, count_if({_QUALITY.format(u='q')} IS DISTINCT FROM listing_url_quality) AS changed_listing_url_quality, count_if(listing_status = 'UNRESOLVED' AND best IS NOT NULL OR listing_status = 'ACTIVE' AND best IS NULL) AS changed_listing_status FROM b""")
def ag18(s, d):
    before = table(s, d, "listings")
    return discovery.change_counts(before, ledger.reviewed(before), "listing_id", ["listing_url_quality", "listing_status"])


@query("sc11_candidate_rows", f"""SELECT substr(sha256(lower(trim({_NORM.format(u='url')})) || chr(31)), 1, 20) AS internal_id, raw_id, coalesce(discovery_value, 50) AS source_confidence, coalesce(r.listing_url_quality, {_QUALITY.format(u='r.url')}) AS listing_url_quality FROM raw_listings r LEFT JOIN (SELECT domain, discovery_value FROM sources) s ON s.domain = r.source_domain WHERE url IS NOT NULL""")
def sc11(s, d):
    return ledger.candidate_rows(table(s, d, "raw_listings").where("url IS NOT NULL"), table(s, d, "sources")).select("internal_id", "raw_id", "source_confidence", "listing_url_quality")


@query("dm12_job_states", "SELECT user_id AS job_id, arg_max(event_type, event_id) AS status, max(value) AS progress FROM events GROUP BY 1")
def dm12(s, d):
    e = table(s, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("status"), F.col("value").alias("progress"), F.lit(None).cast("string").alias("message"))
    return ledger.job_states(e).select("job_id", "status", "progress")


@query("ss06_monthly_usage", "SELECT date_trunc('month', discovered_at)::TIMESTAMP AS month, provider, count(*) AS used FROM search_hits WHERE http_status = 200 GROUP BY 1, 2")
def ss06(s, d):
    from lotwise.streaming.states import monthly_usage

    return monthly_usage(table(s, d, "search_hits").select("provider", F.col("discovered_at").alias("created_at"), (F.col("http_status") == 200).alias("ok"))).withColumn("month", F.col("month").cast("timestamp_ntz"))


# functions
_UNIT = rf"regexp_replace(description, '\d[\d.,\s\x{{a0}}]*\s*(?:{X.OTHER_UNITS})\b', ' ', 'gi')"
_NUMS = r"\d[\d.,\s\x{a0}]*\d|\d"


_SIGN_FIRST, _SIGN_LAST, _LONG_NUMBER = rf"(?:{X.PRICE_SIGNS})\s*({_NUMS})", rf"({_NUMS})\s*(?:{X.PRICE_SIGNS})", r"(\d[\d.,\s\x{a0}]{2,}\d|\d{3,})"


def _read_all(pattern: str) -> str:
    return f"list_filter(list_transform(regexp_extract_all(t, '{pattern}', 1, 'i'), lambda n: {_number_sql('n')}), lambda v: v IS NOT NULL)"


@query("fn_n03_parse_price", rf"""WITH a AS (SELECT raw_id, description, {_UNIT} AS t FROM raw_listings), b AS (SELECT *, list_concat({_read_all(_SIGN_FIRST)}, {_read_all(_SIGN_LAST)}) AS n1, {_read_all(_LONG_NUMBER)} AS n2 FROM a)
SELECT raw_id, list_max(list_filter(CASE WHEN len(n1) > 0 THEN n1 ELSE n2 END, lambda v: v BETWEEN 100 AND 500000)) AS amount, CASE {' '.join(f"WHEN contains(lower(description), '{k}') THEN '{v}'" for k, v in X.CURRENCY_SIGNS)} END AS currency FROM b""")
def fn_n03(s, d):
    return table(s, d, "raw_listings").select("raw_id", X.parse_price(F.col("description")).alias("p")).select("raw_id", "p.amount", "p.currency")


@query("fn_n10_coerce_km", r"SELECT raw_id, CASE WHEN raw_id % 2 = 0 THEN mileage_km ELSE CASE WHEN mileage_km <= 1000000 THEN mileage_km END END AS km FROM raw_listings WHERE mileage_km >= 0 AND mileage_km <= 1000000")
def fn_n10(s, d):
    raw = table(s, d, "raw_listings").where("mileage_km BETWEEN 0 AND 1000000")
    t = F.when((F.col("raw_id") % 2 == 0) & (F.col("mileage_km") >= 10), F.concat(F.col("mileage_km").cast("string"), F.lit(" km"))).otherwise(F.concat(F.lit("odo "), F.col("mileage_km").cast("string")))
    return raw.select("raw_id", X.coerce_km(t).alias("km"))


_ADDR = " ".join(f"WHEN {_in('t', w)} THEN '{k}'" for k, w in V.ADDRESS_WORDS.items())
_CC = "CASE regexp_extract(" + f"regexp_replace({_HOST.format(u='url')}, ':\\d*$', '')" + r", '\.([^.]+)$', 1) " + " ".join(f"WHEN '{c[4]}' THEN '{c[0]}'" for c in V.COUNTRIES) + " END"
_PHONE = "CASE " + " ".join(f"WHEN contains(x, '{k}') THEN '{v}'" for k, v in X.PHONE_CODES.items()) + " END"


@query("fn_n14_country", f"""WITH r AS (SELECT raw_id, coalesce(description, '') || CASE raw_id % 7 WHEN 0 THEN ' Tel. +31 20 1234' WHEN 1 THEN ' Wien, Austria' ELSE '' END AS x, CASE WHEN raw_id % 3 = 0 THEN 'https://www.auto-' || raw_id || '.pl/x' ELSE url END AS url FROM raw_listings),
a AS (SELECT raw_id, {_PHONE} AS p, CASE {_ADDR} END AS ad, {_CC} AS cc FROM (SELECT *, lower(x) AS t FROM r)) SELECT raw_id, coalesce(p, ad, cc) AS country, CASE WHEN p IS NOT NULL THEN 80 WHEN ad IS NOT NULL THEN 70 WHEN cc IS NOT NULL THEN 45 ELSE 0 END AS confidence FROM a""")
def fn_n14(s, d):
    i = F.col("raw_id")
    text = F.concat(F.coalesce("description", F.lit("")), F.when(i % 7 == 0, " Tel. +31 20 1234").when(i % 7 == 1, " Wien, Austria").otherwise(""))
    url = F.when(i % 3 == 0, F.concat(F.lit("https://www.auto-"), i.cast("string"), F.lit(".pl/x"))).otherwise(F.col("url"))
    return table(s, d, "raw_listings").select("raw_id", X.country_of(url, text).alias("c")).select("raw_id", "c.country", "c.confidence")


PRICES = {"grid": (2.0, 6.0), "serp": (1.0, 3.0)}


@query("fn_n16_call_cost", "SELECT hit_id, round(coalesce(length(title), 0) / 1e6 * a + coalesce(length(snippet), 0) / 1e6 * b, 6) AS cost FROM (SELECT *, CASE WHEN contains(provider, 'grid') THEN 2.0 WHEN contains(provider, 'serp') THEN 1.0 END::DOUBLE AS a, CASE WHEN contains(provider, 'grid') THEN 6.0 WHEN contains(provider, 'serp') THEN 3.0 END::DOUBLE AS b FROM search_hits)")
def fn_n16(s, d):
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    return table(s, d, "search_hits").select("hit_id", X.call_cost(F.col("provider"), n("title"), n("snippet"), PRICES).alias("cost"))


@query("fn_d01_next_check", "SELECT source_id, last_checked_at + to_hours(CASE source_id % 5 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 12 WHEN 3 THEN 24 ELSE 6 END) AS next_check_at FROM sources")
def fn_d01(s, d):
    i = F.col("source_id") % 5
    f = F.when(i == 0, "1h").when(i == 1, "3h").when(i == 2, "12h").when(i == 3, "daily")
    return table(s, d, "sources").select("source_id", X.next_check(f, F.col("last_checked_at")).alias("next_check_at"))


@query("fn_u09_resolve", r"SELECT raw_id, rtrim(regexp_extract(url, '^[^/]+//[^/?#]+', 0), '/') || '/x/' || raw_id || '?a=1' AS from_root, regexp_replace(url, '#.*$', '') || '#top' AS fragment FROM raw_listings WHERE url LIKE 'http%//%/%'")
def fn_u09(s, d):
    raw = table(s, d, "raw_listings").where("url LIKE 'http%//%/%'")
    href = F.concat(F.lit("/y/../x/./"), F.col("raw_id").cast("string"), F.lit("?a=1"))
    return raw.select("raw_id", U.resolve(F.col("url"), href).alias("from_root"), U.resolve(F.col("url"), F.lit("#top")).alias("fragment"))


# pages made of the adverts, so that what stands on them is known row by row
_PRICED = "price BETWEEN 1000 AND 400000 AND mileage_km BETWEEN 10000 AND 900000"


@query("tf02_cards", f"""SELECT raw_id // 20 AS page_id, 'https://d.example/angebot/' || (10000 + raw_id) AS url, 'Car ' || raw_id || 'x' AS title, CAST(floor(price) AS DOUBLE) AS price, 'EUR' AS currency, mileage_km, 'https://d.example/i/' || raw_id || '.jpg' AS image,
CASE WHEN count(*) OVER (PARTITION BY raw_id // 20) > 0 THEN 'SEARCH_RESULTS' END AS page_type, 'card' AS extraction_method, 'EXACT_DETAIL' AS listing_url_quality FROM raw_listings WHERE {_PRICED}""")
def tf02(s, d):
    from lotwise.operators.candidates import candidates

    i = F.col("raw_id").cast("string")
    card = F.concat(F.lit('<li><a href="/angebot/'), (10000 + F.col("raw_id")).cast("string"), F.lit('?utm_source=x">Car '), i, F.lit("x</a><p>Price <b>"), F.floor("price").cast("string"), F.lit("</b> EUR, <i>"), F.col("mileage_km").cast("string"), F.lit('</i> km</p><img data-src="/i/'), i, F.lit('.jpg"></li>'))
    pages = table(s, d, "raw_listings").where(_PRICED).groupBy(F.expr("raw_id div 20").alias("page_id")).agg(F.concat(F.lit("<html><body><ul>"), F.array_join(F.array_sort(F.collect_list(card)), ""), F.lit('</ul><a href="/suche?page=2">next</a></body></html>')).alias("text"))
    out = candidates(pages.withColumn("url", F.lit("https://d.example/suche?q=car")))
    return out.select("page_id", F.regexp_replace("url", r"\?.*$", "").alias("url"), "title", "price", "currency", "mileage_km", F.get("images", F.lit(0)).alias("image"), "page_type", "extraction_method", "listing_url_quality")


@query("tf06_described", f"""SELECT raw_id AS page_id, 'Car ' || raw_id AS title, floor(price) + 0.5 AS price, 'GBP' AS currency, mileage_km, CAST(1990 + raw_id % 30 AS INTEGER) AS year, CAST(50 + raw_id % 100 AS INTEGER) AS power_kw, 'V' || raw_id AS vin, 'Wald' AS brand, 'individual' AS extraction_method, 'INDIVIDUAL_LISTING' AS page_type,
'https://d.example/angebot/' || (10000 + raw_id) AS url, 'https://d.example/p/' || raw_id || '.jpg' AS image FROM raw_listings WHERE {_PRICED}""")
def tf06(s, d):
    from lotwise.operators.candidates import candidates

    i = F.col("raw_id")
    data = F.to_json(F.struct(F.array(F.struct(
        F.array(F.lit("Vehicle")).alias("@type"), F.concat(F.lit("Car "), i.cast("string")).alias("name"), F.struct(F.lit("Wald").alias("name")).alias("brand"),
        F.array(F.struct(F.concat(F.floor("price").cast("string"), F.lit(",5")).alias("price"), F.lit("GBP").alias("priceCurrency"))).alias("offers"),
        F.struct(F.col("mileage_km").alias("value"), F.lit("KMT").alias("unitCode")).alias("mileageFromOdometer"), (1990 + i % 30).cast("string").alias("vehicleModelDate"), F.concat(F.lit("V"), i.cast("string")).alias("vehicleIdentificationNumber"),
        F.struct(F.struct(F.concat((50 + i % 100).cast("string"), F.lit(" kW")).alias("value")).alias("enginePower")).alias("vehicleEngine"), F.array(F.struct(F.concat(F.lit("/p/"), i.cast("string"), F.lit(".jpg")).alias("url"))).alias("image"),
    )).alias("@graph")))
    text = F.concat(F.lit('<html><head><link rel="canonical" href="/angebot/'), (10000 + i).cast("string"), F.lit('"><script type="application/ld+json">'), data, F.lit("</script></head><body><h1>other</h1></body></html>"))
    pages = table(s, d, "raw_listings").where(_PRICED).select(i.alias("page_id"), F.lit("https://d.example/x?utm_source=1").alias("url"), text.alias("text"))
    return candidates(pages).select("page_id", "title", "price", "currency", "mileage_km", "year", "power_kw", "vin", "brand", "extraction_method", "page_type", "url", F.get("images", F.lit(0)).alias("image"))


@query("tf09_adapter", "SELECT raw_id // 20 AS page_id, 'https://www.marktplaats.example/v/' || raw_id AS url, 'Heading ' || raw_id AS title, 'adapter' AS extraction_method FROM raw_listings")
def tf09(s, d):
    from lotwise.operators.candidates import candidates

    i = F.col("raw_id").cast("string")
    card = F.concat(F.lit('<li><a href="/v/'), i, F.lit('"><h3>Heading '), i, F.lit('</h3></a><a href="/other/'), i, F.lit('">no item</a></li>'))
    pages = table(s, d, "raw_listings").groupBy(F.expr("raw_id div 20").alias("page_id")).agg(F.concat(F.lit("<ul>"), F.array_join(F.array_sort(F.collect_list(card)), ""), F.lit("</ul>")).alias("text"))
    return candidates(pages.withColumn("url", F.lit("https://www.marktplaats.example/l/auto/"))).select("page_id", "url", "title", "extraction_method")


@query("tf01_page_types", """SELECT fetch_id AS page_id, kind AS page_type FROM (SELECT fetch_id, unnest(['HOMEPAGE', 'SEARCH_RESULTS', 'OTHER']) AS kind, unnest([0, 1, 2]) AS k FROM fetch_results) WHERE fetch_id % 3 = k""")
def tf01_types(s, d):
    from lotwise.operators.candidates import candidates

    i = F.col("fetch_id")
    url = F.when(i % 3 == 0, "https://d.example/").when(i % 3 == 1, "https://d.example/suche?q=x").otherwise("https://d.example/impressum")
    return candidates(table(s, d, "fetch_results").select(i.alias("page_id"), url.alias("url"), F.lit("<html><p>nothing here</p></html>").alias("text"))).select("page_id", "page_type")
