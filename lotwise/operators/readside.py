"""What readers of the listings ask for: valid candidates, filters, orders, counters, reports (CL16 .. CL24, SO*, AG01 .. AG22, SS08, SNK06 .. SNK08).

Tables of listings have the columns of TESTDATA's listings, and confidence, score
and class where a caller's own rules have set them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE = ("ACTIVE", "MAYBE_ACTIVE")
GONE = ("EXPIRED", "REMOVED")
NOT_A_PAGE = ("SEARCH_PAGE", "HOMEPAGE")
TIERS = (60, 40, 95)  #: confidence of hits, of uncertain ones, of confirmed ones


def valid(rejected: str | None = None, statuses: tuple[str, ...] | None = ACTIVE) -> Column:
    """CL16: not of the rejected class, not a search or home page, and of one of ``statuses``; an unknown class or quality is valid, an unknown status isn't."""
    out = F.col("listing_url_quality").isNull() | ~F.col("listing_url_quality").isin(*NOT_A_PAGE)
    if rejected is not None:
        out = out & (F.col("class").isNull() | (F.col("class") != rejected))
    return out & F.coalesce(F.col("listing_status").isin(*statuses), F.lit(False)) if statuses else out


ORDERS = {
    "score": lambda: [F.desc_nulls_last("score"), F.desc_nulls_last("confidence"), F.asc("listing_id")],  # SO01
    "newest": lambda: [F.desc_nulls_last("first_seen_at"), F.desc("listing_id")],  # SO02
    "confidence": lambda: [F.desc_nulls_last("confidence"), F.asc("listing_id")],  # SO03
    "price": lambda: [F.asc_nulls_last("price_eur"), F.asc("listing_id")],
}


def filtered(listings: DataFrame, order: str = "score", limit: int = 200, rejected: str | None = None, **wanted) -> DataFrame:
    """CL17, SO01 .. SO04: valid candidates that meet all of ``wanted``, in one of ORDERS, at most ``limit``.

    wanted: min_confidence (0 and up), max_confidence, country, min_price,
    max_price, max_mileage, min_year, seller_type, status. None, 0 and '' ask for
    nothing, but a max_confidence of 0 does. NULL never meets a condition. A status asked for
    replaces the active ones. Ties go to the smaller listing_id, so the result is
    the same every time.
    """
    status = wanted.get("status")
    tests = [valid(rejected, (status,) if status else ACTIVE), F.col("confidence") >= (wanted.get("min_confidence") or 0)]
    if wanted.get("max_confidence") is not None:
        tests.append(F.col("confidence") <= wanted["max_confidence"])
    simple = {
        "country": lambda v: F.col("country") == v.upper(), "max_price": lambda v: F.col("price_eur") <= v, "min_price": lambda v: F.col("price_eur") >= v, "max_mileage": lambda v: F.col("mileage_km") <= v,
        "min_year": lambda v: F.col("production_year") >= v, "seller_type": lambda v: F.col("seller_type") == v,
    }
    tests += [test(wanted[k]) for k, test in simple.items() if wanted.get(k)]
    return listings.where(reduce(lambda a, b: a & b, tests)).orderBy(*ORDERS[order]()).limit(limit)


def active_hits(listings: DataFrame, rejected: str | None = None, limit: int = 200) -> DataFrame:
    """CL24."""
    return filtered(listings, min_confidence=TIERS[0], rejected=rejected, limit=limit)


def price_drops(changes: DataFrame, limit: int = 25) -> DataFrame:
    """CL20: the newest changes to a lower price."""
    return changes.where("delta < 0").orderBy(F.desc_nulls_last("changed_at"), F.asc("listing_id")).limit(limit)


def _n(condition: Column) -> Column:
    return F.count_if(F.coalesce(condition, F.lit(False)))


def home(listings: DataFrame, sources: DataFrame, as_of: Column, rejected: str | None = None) -> DataFrame:
    """AG01, SS08: one row of headline figures; one pass over each table. New are first seen in the 24 hours up to ``as_of``."""
    hit, some = F.col("confidence") >= TIERS[0], (F.col("confidence") >= TIERS[1]) & (F.col("confidence") < TIERS[0])
    new = (F.col("first_seen_at") >= as_of - F.expr("INTERVAL 24 HOURS")) & (F.col("first_seen_at") <= as_of)
    one = listings.agg(_n(valid(rejected) & hit & new).alias("new_today"), _n(valid(rejected) & hit).alias("total_active"), _n(valid(rejected) & some).alias("uncertain"), _n(F.col("listing_status").isin(*GONE)).alias("disappeared"))
    two = sources.agg(_n(F.col("health") == "failed").alias("failed_sources"), _n(F.col("health") == "degraded").alias("degraded_sources"), F.count(F.lit(1)).alias("sources_total"), _n(F.col("active")).alias("sources_active"))
    return _beside(one, two)


def _beside(*rows: DataFrame) -> DataFrame:
    """One-row tables side by side."""
    keyed = [r.withColumn("__one", F.lit(1)) for r in rows]
    return reduce(lambda a, b: a.join(b, "__one"), keyed).drop("__one")


def metrics(listings: DataFrame, sources: DataFrame, as_of: Column) -> DataFrame:
    """AG02: one row of further counters; an unknown country counts as one country, as in a list of distinct values."""
    week = (F.col("first_discovered_at") >= as_of - F.expr("INTERVAL 7 DAYS")) & (F.col("first_discovered_at") <= as_of)
    one = sources.agg(F.count(F.lit(1)).alias("known_sources"), _n(F.col("active")).alias("active_sources"), _n(F.col("discovery_value") >= 65).alias("long_tail_sources"), _n(week).alias("new_sources_week"))
    two = listings.agg(
        (F.count_distinct("country") + F.coalesce(F.max(F.col("country").isNull().cast("long")), F.lit(0))).alias("countries_covered"), F.count(F.lit(1)).alias("seen"), _n(F.col("confidence") >= TIERS[2]).alias("confirmed"),
        _n(F.col("original_listing_url").isNotNull()).alias("first_on_dealer"),
    )
    return _beside(one, two)


def health(sources: DataFrame) -> DataFrame:
    """AG04."""
    return sources.agg(*[_n(F.col("health") == h).alias(h) for h in ("healthy", "degraded", "failed", "unknown")])


def coverage_by_type(countries: DataFrame, sources: DataFrame, types: list[str]) -> DataFrame:
    """AG03, JN08, SC16: every country with its sources, healthy and failed ones, and how many there are of each of ``types``; most sources first, zeros where there are none."""
    counts = sources.groupBy("country").agg(
        F.count(F.lit(1)).alias("sources"), _n(F.col("health") == "healthy").alias("healthy"), _n(F.col("health") == "failed").alias("failed"), *[_n(F.col("source_type") == t).alias(f"n_{t}") for t in types]
    )
    out = countries.select(F.col("code").alias("country"), "name").join(counts, "country", "left").fillna(0)
    return out.orderBy(F.desc("sources"), "country")


def audit(countries: DataFrame, sources: DataFrame, expected: list[str]) -> DataFrame:
    """AG09, JN09, SO06: per country all and working sources, the kinds present with their numbers, and the expected kinds it lacks; the most lacking first, then those of fewest sources."""
    by = sources.where("country IS NOT NULL AND source_type IS NOT NULL").groupBy("country", "source_type").agg(F.count(F.lit(1)).alias("n"), _n(F.col("live_status") == "WORKING").alias("w"))
    agg = by.groupBy("country").agg(F.sum("n").alias("total"), F.sum("w").alias("working"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("by_type"))
    out = countries.select(F.col("code").alias("country"), "name").join(agg, "country", "left").fillna(0, ["total", "working"])
    have = F.coalesce(F.map_keys("by_type"), F.array().cast("array<string>"))
    out = out.withColumn("missing", F.array_except(F.array(*[F.lit(x) for x in expected]), have))
    return out.orderBy(F.desc(F.size("missing")), F.asc("total"), F.asc("country"))


def report(listings: DataFrame, sources: DataFrame, hits: DataFrame, rejected: str | None = None) -> DataFrame:
    """AG05, AG08, AG15: (section, name, value): every counter of the report; three passes, one a table."""
    conf = F.col("confidence")
    s = {
        "sources_total": F.lit(True), "working": F.col("live_status") == "WORKING", "blocked": F.col("live_status").isin("BLOCKED", "ROBOTS_DISALLOWED", "LOGIN_REQUIRED"), "failed": F.col("live_status").isin("DEAD", "PARSER_BROKEN"),
        "active_sources": F.col("active"), "sources_attempted": F.col("last_checked_at").isNotNull(),
    }
    v = {"confirmed": conf >= 95, "likely": (conf >= 80) & (conf < 95), "low": conf < 40, "archived": F.col("listing_status").isin("EXPIRED", "ARCHIVED", "REMOVED"), "valid": valid(rejected)}
    h = {"hits": F.lit(True)} | {f"hits_{x.lower()}": F.col("processing_status") == x for x in ("INGESTED", "SOURCE_REGISTERED", "SKIPPED", "BLOCKED", "ERROR", "PENDING")}
    tried = F.when(F.col("last_checked_at").isNotNull(), F.struct("country"))
    parts = []
    for section, df, tests, more in (("sources", sources, s, {"countries_attempted": F.count_distinct(tried)}), ("listings", listings, v, {}), ("hits", hits, h, {"queries": F.count_distinct("query")})):
        row = df.agg(*[_n(c).alias(k) for k, c in tests.items()], *[c.alias(k) for k, c in more.items()])
        names = [*tests, *more]
        parts.append(row.select(F.lit(section).alias("section"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("long").alias("value")) for k in names])).alias("x")).select("section", "x.name", "x.value"))
    return reduce(DataFrame.union, parts)


def first_report(listings: DataFrame, sources: DataFrame, rejected: str | None = None, limit: int = 50) -> dict[str, DataFrame]:
    """AG21, SO05, SO07: the sections of the report on a first discovery, each with an explicit order and at most ``limit`` rows."""
    top = lambda df, *order: df.orderBy(*order, F.asc("source_id")).limit(limit)
    return {
        "active": filtered(listings, min_confidence=TIERS[0], rejected=rejected, limit=limit),
        "uncertain": filtered(listings, min_confidence=TIERS[1], max_confidence=TIERS[0] - 1, rejected=rejected, limit=limit),
        "archived": listings.where(F.col("listing_status").isin("EXPIRED", "ARCHIVED", "REMOVED")).orderBy(F.desc_nulls_last("last_seen_at"), "listing_id").limit(limit),
        "dealers": top(sources.where(F.col("source_type").isin("dealer", "garage")), F.desc_nulls_last("discovery_value")),
        "newest_sources": top(sources, F.desc_nulls_last("first_discovered_at")),
        "failed": top(sources.where("health = 'failed'"), F.desc_nulls_last("failure_count")),
        "inactive": top(sources.where("NOT active"), F.desc_nulls_last("priority")),
    }


def statistics(listings: DataFrame, sources: DataFrame, as_of: Column, rejected: str | None = None) -> DataFrame:
    """AG22, SNK07: home figures, further metrics and health as one row of three JSON texts."""
    rows = {"home": home(listings, sources, as_of, rejected), "metrics": metrics(listings, sources, as_of), "health": health(sources)}
    return _beside(*[df.select(F.to_json(F.struct(*df.columns)).alias(k)) for k, df in rows.items()])


def best_of_each(candidates: DataFrame, group: str, by: str, position: str) -> DataFrame:
    """AG16: per group the candidate with the largest ``by``; of equal ones the first by position. Candidates without a value come last."""
    best = F.max_by(F.struct(*candidates.columns), F.struct(F.coalesce(F.col(by), F.lit(-1)), -F.col(position)))
    return candidates.groupBy(group).agg(best.alias("b")).select("b.*")


def funnel(rows: DataFrame, group: str, bucket: str, buckets: list[str]) -> DataFrame:
    """AG10: how many rows of each group are in each of ``buckets``; others count in total only."""
    return rows.groupBy(group).agg(F.count(F.lit(1)).alias("total"), *[_n(F.col(bucket) == b).alias(b.lower()) for b in buckets])


def alert(title: Column, price: Column, mileage: Column, country: Column, url: Column) -> Column:
    """SNK06: an alert as text, one fact a line, ? for what isn't known."""
    shown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    return F.concat_ws("\n", shown(title), F.concat(F.lit("Price: "), F.coalesce(F.format_number(price, 0), F.lit("?")), F.lit(" EUR")), F.concat(F.lit("Mileage: "), F.coalesce(F.format_number(mileage, 0), F.lit("?")), F.lit(" km")), F.concat(F.lit("Country: "), shown(country)), shown(url))


def as_lines(counters: DataFrame, width: int = 24) -> DataFrame:
    """SNK08: (section, line_no, line): counters of ``report`` as fixed-width lines, sections and names in alphabetical order."""
    w = Window.partitionBy("section").orderBy("name")  # a section has a fixed number of counters
    return counters.select("section", F.row_number().over(w).alias("line_no"), F.concat(F.rpad("name", width, " "), F.lpad(F.col("value").cast("string"), 10, " ")).alias("line"))
