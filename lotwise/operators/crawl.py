"""Sources and the outcome of visiting them (CL06 .. CL15, CL18, CL19, CL21, CL22, CL25, SC13 .. SC16, SRC07, DM04, DM06, DM09)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions import reference_values as V
from lotwise.functions.text import next_check
from lotwise.functions.urls import domain, is_specific, pick_canonical
from lotwise.operators.readside import _n


def _says(text: Column, marks: tuple[str, ...]) -> Column:
    return F.exists(F.array(*[F.lit(m) for m in marks]), lambda m: F.contains(text, m))


def _once(value: Column, f) -> Column:
    """f(value), with ``value`` worked out once a row however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def is_platform(dom: Column) -> Column:
    """CL07: a big platform by a part of its name or by its whole domain; NULL isn't one."""
    return F.coalesce(_says(dom, V.PLATFORMS) | dom.isin(*V.BIG_DOMAINS), F.lit(False))


def site_category(dom: Column, text: Column) -> Column:
    """CL06: struct(category, relevance, monitorable, signals): terms of markets make a site worth watching, also beside terms of other trades (55 instead of 70); else it only serves discovery (30 with such terms, 40 without any). signals are the first four terms found."""
    blob = F.lower(F.concat(F.lit(" "), F.coalesce(F.nullif(domain(dom), F.lit("")), dom), F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")))
    found = lambda b, terms: F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(b, t))

    def judged(h: Column) -> Column:
        sells, else_ = F.size(h["market"]) > 0, F.size(h["other"]) > 0
        return F.struct(
            F.when(sells, "MONITORABLE_VEHICLE_SOURCE").otherwise("DISCOVERY_ONLY_SOURCE").alias("category"),
            F.when(sells & ~else_, 70).when(sells, 55).when(else_, 30).otherwise(40).alias("relevance"),
            sells.alias("monitorable"),
            F.slice(F.when(sells, h["market"]).otherwise(h["other"]), 1, 4).alias("signals"),
        )

    return _once(blob, lambda b: _once(F.struct(found(b, V.DISCOVERY_TERMS).alias("other"), found(b, V.MARKET_TERMS).alias("market")), judged))


def hit_type(page_type: Column, dom: Column, text: Column) -> Column:
    """CL08: type of a hit from its page's type; pages of no or any content on domains of parts dealers are PARTS_PAGE. Unknown page types are IRRELEVANT."""
    kind = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in V.HIT_TYPES.items() for x in kv]), page_type), F.lit("IRRELEVANT"))
    parts = kind.isin("IRRELEVANT", "HOMEPAGE") & ~site_category(dom, F.lower(text))["monitorable"] & _says(dom, V.PARTS_DOMAINS)
    return F.when(F.coalesce(parts, F.lit(False)), "PARTS_PAGE").otherwise(kind)


def crawl_outcome(fetch: dict[str, Column], n_found: Column) -> Column:
    """CL09: ROBOTS, UNCHANGED, ACCESSIBLE, JS_REQUIRED, EMPTY, HTTP_403, HTTP_429, HTTP_404, ERROR, or NO_TARGET without a URL; found candidates turn EMPTY and UNCHANGED into ACCESSIBLE. ``fetch`` names the columns url, blocked_by_robots, from_cache, ok, status_code and text."""
    code, low = fetch["status_code"], F.lower(F.coalesce(fetch["text"], F.lit("")))
    some = F.coalesce(n_found, F.lit(0)) > 0
    return (
        F.when(fetch["url"].isNull(), "NO_TARGET").when(fetch["blocked_by_robots"], "ROBOTS").when(fetch["from_cache"], F.when(some, "ACCESSIBLE").otherwise("UNCHANGED"))
        .when(fetch["ok"], F.when(some, "ACCESSIBLE").when(_says(low, V.CRAWL_SCRIPT_MARKS), "JS_REQUIRED").otherwise("EMPTY"))
        .when(code.isin(403, 429, 404), F.concat(F.lit("HTTP_"), code.cast("string"))).otherwise("ERROR")
    )


def access(robots: Column, code: Column, text: Column, short: int = 1500) -> Column:
    """CL10: what a probe of a site shows; a page asks for scripts only where it has fewer than ``short`` characters."""
    low = F.lower(F.coalesce(text, F.lit("")))
    good = F.when(_says(low, V.CAPTCHA_MARKS), "BLOCKED").when(_says(low, V.LOGIN_MARKS), "LOGIN_REQUIRED").when((F.length(low) < short) & _says(low, V.SCRIPT_MARKS), "JS_REQUIRED").otherwise("ACCESSIBLE")
    return F.when(robots, "ROBOTS_DISALLOWED").when(code == 429, "RATE_LIMITED").when(code == 401, "LOGIN_REQUIRED").when(code == 403, "BLOCKED").when(code.between(200, 299), good).otherwise("ERROR")


def live_status(probe: Column, n_found: Column, typical: Column, resolves: Column) -> Column:
    """CL11: state of a source from its probe: an accessible one works if candidates were found, is broken if there usually are three or more, else works in part; an error without an address in the network is dead."""
    some = F.when(F.coalesce(n_found, F.lit(0)) > 0, "WORKING").when(F.coalesce(typical, F.lit(0)) >= 3, "PARSER_BROKEN").otherwise("PARTIALLY_WORKING")
    return F.when(probe == "ACCESSIBLE", some).when((probe == "ERROR") & ~resolves, "DEAD").when(probe.isin("BLOCKED", "RATE_LIMITED", "ROBOTS_DISALLOWED", "JS_REQUIRED", "LOGIN_REQUIRED"), probe).otherwise("UNKNOWN")


def site_type(dom: Column, text: Column, brand: str | None = None) -> Column:
    """CL12: struct(source_type, sells, discovery_value): the first kind of site whose words stand in domain or text, 'other' without any."""
    blob = F.lower(F.concat(F.coalesce(dom, F.lit("")), F.lit(" "), F.coalesce(text, F.lit(""))))
    words = ({f"{brand}_dealer": (brand,)} if brand else {}) | V.SITE_WORDS
    kind = F.coalesce(*[F.when(_says(blob, w), k) for k, w in words.items()], F.lit("other"))
    dealers = [k for k in words if k.endswith("dealer")]
    sells = kind.isin(*dealers, "classifieds") | blob.rlike(r"(?<!\w)(km|kw|ps|€|eur)(?!\w)")
    return F.struct(kind.alias("source_type"), sells.alias("sells"), F.when(is_platform(dom), 25).when(kind.isin(*dealers), 75).otherwise(55).alias("discovery_value"))


def conditions(title: Column, description: Column) -> Column:
    """CL13: struct of seven flags: which conditions of a car its title or description names."""
    blob = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    return F.struct(*[_says(blob, words).alias(k) for k, words in V.CONDITION_WORDS.items()])


def diagnosis(code: Column, text: Column, typical: Column, now: Column) -> Column:
    """CL14: why a source yields nothing: blocked, nothing there, its pages changed, or unknown."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return (
        F.when(F.coalesce(code.isin(401, 403, 429), F.lit(False)) | _says(low, V.BLOCK_MARKS), "access_block_or_rate_limit").when(_says(low, V.EMPTY_MARKS), "empty_inventory")
        .when((now == 0) & (typical > 0), "possible_structure_change").otherwise("unknown")
    )


def due(sources: DataFrame, now: Column, force: bool = False, limit: int | None = None) -> DataFrame:
    """CL18: active sources that are due (never planned ones are), most important first."""
    rows = sources.where(F.col("active") & (F.lit(force) | F.col("next_check_at").isNull() | (F.col("next_check_at") <= now))).orderBy(F.desc_nulls_last("priority"), F.asc("source_id"))
    return rows.limit(limit) if limit else rows


def sweep(sources: DataFrame, least: int = 70) -> DataFrame:
    """CL25: the active sources of at least this priority, all of them."""
    return sources.where(F.col("active") & (F.col("priority") >= least)).orderBy(F.desc("priority"), F.asc("source_id"))


def is_long_tail(dom: Column, source_type: Column, value: Column) -> Column:
    """CL19: outside the big platforms, of a small kind or of a discovery value of 60 and more; false where there is no source."""
    return F.coalesce(dom.isNotNull() & ~is_platform(dom) & (source_type.isin(*V.LONG_TAIL_TYPES) | (F.coalesce(value, F.lit(0)) >= 60)), F.lit(False))


def listing_hint(url: Column, hints: tuple[str, ...] = V.LISTING_HINTS) -> Column:
    """CL21: the address looks like that of a listing."""
    return F.coalesce(_says(F.lower(url), hints), F.lit(False))


def hit_route(url: Column, dom: Column, robots: Column, code: Column, kind: Column) -> Column:
    """CL22: what becomes of a hit: platforms' other pages are SKIPPED unfetched, refused ones BLOCKED, failed ones ERROR; listings are INGESTED, stock lists and home pages make a source REGISTERED, the rest is SKIPPED."""
    return (
        F.when(is_platform(dom) & ~listing_hint(url), "SKIPPED").when(robots | code.isin(401, 403, 429), "BLOCKED").when(code.isNull() | ~code.between(200, 299), "ERROR")
        .when(kind == "LISTING", "INGESTED").when(kind.isin("DEALER_INVENTORY", "HOMEPAGE"), "REGISTERED").otherwise("SKIPPED")
    )


def cards_of_hits(cards: DataFrame, term: str, most: int = 20) -> DataFrame:
    """CL22: of each hit's cards the first ``most`` whose title names the term."""
    from pyspark.sql import Window

    named = cards.where(F.contains(F.lower("title"), F.lit(term.lower())))
    return named.withColumn("place", F.row_number().over(Window.partitionBy("hit_id").orderBy("card_no"))).where(F.col("place") <= most)


def provenance(listings: DataFrame, sources: DataFrame) -> DataFrame:
    """SC13, JN01: where each listing comes from: its source, 'seed' without one; aggregator, marketplace and long-tail flags."""
    s = sources.select("source_id", F.col("domain").alias("s_domain"), F.col("source_type").alias("s_type"), "discovery_value")
    rows = listings.join(s, "source_id", "left")
    return rows.select(
        "listing_id", F.coalesce("s_domain", F.lit("seed")).alias("discovery_source"), F.when(F.col("s_type") == "aggregator", F.col("s_domain")).alias("aggregator"),
        F.when(F.col("s_type").isin(*V.MARKETPLACE_TYPES), F.col("s_domain")).alias("marketplace"), is_long_tail(F.col("s_domain"), F.col("s_type"), F.col("discovery_value")).alias("long_tail"),
    )


def final_links(original: Column, listing: Column, alternates: Column, dealer: Column) -> Column:
    """SC14: struct(canonical, original): the canonical URL of all that are known, and a page on the dealer's own domain as the original."""
    every = F.concat(F.array(original, listing), F.coalesce(alternates, F.array().cast("array<string>")))
    own = F.get(F.filter(every, lambda u: u.isNotNull() & is_specific(u) & (domain(u) == dealer)), F.lit(0))
    return F.struct(pick_canonical(every, dealer, V.PLATFORMS).alias("canonical"), F.coalesce(own, original).alias("original"))


def notes(flags: Column) -> Column:
    """SC15: what is known of a car's damages, joined by '; '; NULL where nothing is."""
    return F.nullif(F.concat_ws("; ", *[F.when(flags[k], k) for k in ("rust", "accident", "engine", "gearbox")]), F.lit(""))


def own_site(website: Column, source_domain: Column, source_type: Column, *texts: Column) -> Column:
    """DM03, FN-S10: a seller's own domain: the stated website, else that of a small source, else the first address in ``texts`` that is neither a platform's nor a social network's."""
    stated = F.nullif(domain(website), F.lit(""))
    named = F.array_compact(F.concat(*[F.coalesce(F.transform(F.regexp_extract_all(F.lower(t), F.lit(r"https?://([a-z0-9.-]+\.[a-z]{2,})"), F.lit(1)), lambda d: F.regexp_replace(d, r"^www\.", "")), F.array().cast("array<string>")) for t in texts]))
    free = F.filter(named, lambda d: ~is_platform(d) & ~_says(d, V.SOCIAL))
    return F.coalesce(F.when(~is_platform(stated), stated), F.when(source_type.isin(*V.LONG_TAIL_TYPES) & ~is_platform(source_domain), source_domain), F.get(free, F.lit(0)))


def seller_sources(sources: DataFrame, found: DataFrame, as_of: Column) -> DataFrame:
    """DM03, JN06: the sources and, for each new domain of ``found`` (domain, country), one derived from sellers (value 70, priority 65); doing it twice changes nothing."""
    new = found.where("domain IS NOT NULL").groupBy("domain").agg(F.min("country").alias("country")).join(sources.select("domain"), "domain", "left_anti")
    added = new.select("domain", "country", F.lit("dealer").alias("source_type"), F.lit(70).alias("discovery_value"), F.lit(65).alias("priority"), F.lit(True).alias("active"), F.lit("unknown").alias("health"), as_of.alias("first_discovered_at"))
    return sources.unionByName(added, allowMissingColumns=True)


def strategy(source_type: Column, has_feed: Column, n_found: Column, pages_left: Column) -> Column:
    """SRC07: how a source is read next: its feed, else its page, and its sitemap too where it is a small dealer with fewer than three candidates and pages left."""
    deep = source_type.isin(*V.DEEP_TYPES) & (F.coalesce(n_found, F.lit(0)) < 3) & (pages_left > 1)
    return F.when(has_feed & (F.coalesce(n_found, F.lit(0)) > 0), "FEED").when(F.coalesce(deep, F.lit(False)), "PAGE+SITEMAP").otherwise("PAGE")


def recategorised(sources: DataFrame, seeds: tuple[str, ...] = ()) -> DataFrame:
    """DM06: every source with its category; sources that aren't worth watching and aren't seeds are switched off and valued at most 25. A platform stays as it is."""
    c = site_category(F.col("domain"), F.col("name"))
    keep = F.col("domain").isin(*seeds) if seeds else F.lit(False)
    watch = keep | (c["monitorable"] & ~is_platform(F.col("domain")))
    return sources.withColumns({
        "source_category": F.when(keep | c["monitorable"], "MONITORABLE_VEHICLE_SOURCE").otherwise("DISCOVERY_ONLY_SOURCE"),
        "active": F.col("active") & watch, "discovery_value": F.when(watch, F.col("discovery_value")).otherwise(F.least(F.col("discovery_value"), F.lit(25))),
    })


def with_live_status(sources: DataFrame, probes: DataFrame) -> DataFrame:
    """DM09: sources with the state of their latest probe (domain, probe, n_found, resolves, probed_at); sources without one keep theirs, and the need of a browser is never unset."""
    last = probes.groupBy("domain").agg(F.max_by(F.struct("probe", "n_found", "resolves"), "probed_at").alias("p"))
    rows = sources.join(last, "domain", "left")
    typical = F.col("typical_result_count") if "typical_result_count" in sources.columns else F.lit(0)
    state = F.when(F.col("p").isNotNull(), live_status(F.col("p.probe"), F.col("p.n_found"), typical, F.col("p.resolves")))
    browser = F.coalesce(F.col("requires_browser"), F.lit(False)) if "requires_browser" in sources.columns else F.lit(False)
    return rows.withColumns({"live_status": F.coalesce(state, F.col("live_status")), "requires_browser": browser | F.coalesce(F.col("p.probe") == "JS_REQUIRED", F.lit(False))}).drop("p")


def finalised(sources: DataFrame, scans: DataFrame) -> DataFrame:
    """DM04, SS04 as a batch: sources after their latest scan (domain, scanned_at, n_found, failed, frequency): counters, health and the next check; sources without a scan stay as they are."""
    last = scans.groupBy("domain").agg(F.max_by(F.struct("scanned_at", "n_found", "failed", "frequency"), "scanned_at").alias("s"))
    rows = sources.join(last, "domain", "left")
    seen, failed = F.col("s").isNotNull(), F.col("s.failed")
    health = F.when(failed, "failed").when(F.col("s.n_found") > 0, "healthy").otherwise(F.coalesce("health", F.lit("unknown")))
    return rows.withColumns({
        "last_checked_at": F.coalesce("s.scanned_at", "last_checked_at"), "health": F.when(seen, health).otherwise(F.col("health")),
        "failure_count": F.when(seen & failed, F.coalesce("failure_count", F.lit(0)) + 1).when(seen, 0).otherwise(F.col("failure_count")),
        "next_check_at": F.when(seen, next_check(F.col("s.frequency"), F.col("s.scanned_at"))),
    }).drop("s")


def scan_row(scans: DataFrame) -> DataFrame:
    """AG10, DM15, DM16: one row a run: when it ran, sources, candidates and failures, the tally of outcomes, and the first 200 errors."""
    tally = scans.groupBy("run_id", "outcome").agg(F.count(F.lit(1)).alias("n")).groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("outcome", "n")))).alias("outcomes"))
    row = scans.groupBy("run_id").agg(F.min("scanned_at").alias("started"), F.max("scanned_at").alias("ended"), F.count(F.lit(1)).alias("n_sources"), F.sum("n_found").alias("n_found"), _n(F.col("failed")).alias("n_failed"))
    return row.join(tally, "run_id")
