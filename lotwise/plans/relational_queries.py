"""Queries over hits, sources, observations and listings, each with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotwise.operators import dedup, history, hits
from lotwise.plans.function_queries import _HOST, _NORM, hashes, query
from lotwise.sources.tables import table

KINDS = ["dealer", "classifieds", "local_marketplace", "garage", "auction"]
STATUSES = ["NEW", "INGESTED", "SKIPPED", "BLOCKED", "ERROR", "REGISTERED"]


@query(
    "src09_merge_providers",
    """SELECT normalized_url, array_to_string(list_sort(list_distinct(list(provider))), '+') AS providers, count(*) AS n_hits, arg_min(hit_id, (provider, coalesce(rank, 2147483647), hit_id)) AS hit_id,
 arg_min(coalesce(title, '~none~'), (provider, coalesce(rank, 2147483647), hit_id)) AS title FROM search_hits GROUP BY 1""",
)
def src09(s, d):
    return hits.merge_providers(table(s, d, "search_hits")).withColumn("title", F.coalesce("title", F.lit("~none~")))


@query("wn08_first_occurrence", "SELECT min(hit_id) AS hit_id FROM search_hits GROUP BY lower(query), country")
def wn08(s, d):
    return hits.first_occurrence(table(s, d, "search_hits"), [F.lower("query"), F.col("country")], "hit_id").select("hit_id")


@query("wn09_capped_hits", "SELECT query, hit_id, row_number() OVER (PARTITION BY query ORDER BY rank NULLS FIRST, hit_id) AS place FROM search_hits QUALIFY place <= 12")
def wn09(s, d):
    return hits.capped(table(s, d, "search_hits")).select("query", "hit_id", "place")


@query(
    "ag07_provider_overlap",
    """WITH p AS (SELECT DISTINCT domain, provider FROM search_hits WHERE domain IS NOT NULL AND provider IS NOT NULL), n AS (SELECT domain, count(*) AS n FROM p GROUP BY 1)
SELECT provider, count(*) AS domains, CAST(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) AS BIGINT) AS only_here FROM p JOIN n USING (domain) GROUP BY 1""",
)
def ag07(s, d):
    return hits.provider_overlap(table(s, d, "search_hits"))


@query("ag06_hits_by_status", "SELECT provider, " + ", ".join(f"CAST(count_if(processing_status = '{x}') AS BIGINT) AS {x.lower()}" for x in STATUSES) + " FROM search_hits GROUP BY 1")
def ag06(s, d):
    return hits.by_status(table(s, d, "search_hits"), STATUSES)


@query(
    "jn08_country_coverage",
    """WITH c AS (SELECT DISTINCT country FROM raw_listings WHERE country IS NOT NULL), a AS (SELECT country, count(*) AS n, count_if(health = 'healthy') AS healthy, count(DISTINCT source_type) AS kinds FROM sources GROUP BY 1)
SELECT c.country, coalesce(n, 0) AS n, coalesce(healthy, 0) AS healthy, coalesce(kinds, 0) AS kinds FROM c LEFT JOIN a USING (country)""",
)
def jn08(s, d):
    return hits.coverage(table(s, d, "raw_listings").where("country IS NOT NULL").select("country").distinct(), table(s, d, "sources"))


@query(
    "jn09_source_gaps",
    f"""WITH h AS (SELECT country, list(DISTINCT source_type) AS have, count(*) AS n FROM sources WHERE country IS NOT NULL GROUP BY 1)
SELECT country, n, array_to_string(list_sort(list_filter({KINDS}, lambda k: NOT list_contains(have, k))), ',') AS missing FROM h""",
)
def jn09(s, d):
    return hits.gaps(table(s, d, "sources"), KINDS)


@query("jn05_unknown_domains", "SELECT domain, count(*) AS n FROM search_hits WHERE domain IS NOT NULL AND domain NOT IN (SELECT domain FROM sources WHERE active) GROUP BY 1")
def jn05(s, d):
    return hits.unknown_domains(table(s, d, "search_hits"), table(s, d, "sources").where("active"))


@query(
    "jn01_candidates_with_source",
    f"""WITH r AS (SELECT raw_id, regexp_replace({_HOST.format(u='url')}, ':\\d*$', '') AS domain FROM raw_listings) SELECT raw_id, source_type, priority FROM r LEFT JOIN sources s ON r.domain = s.domain""",
)
def jn01(s, d):
    from lotwise.functions.urls import domain

    return table(s, d, "raw_listings").select("raw_id", domain(F.col("url")).alias("domain")).join(table(s, d, "sources").select("domain", "source_type", "priority"), "domain", "left").select("raw_id", "source_type", "priority")


@query("ag01_source_health", "SELECT count(*) AS sources, count_if(active) AS active, count_if(health = 'failed') AS failed, count_if(health = 'degraded') AS degraded, count(DISTINCT country) AS countries, count_if(is_aggregator) AS aggregators FROM sources")
def ag01(s, d):
    one = lambda c: F.count_if(c)
    return table(s, d, "sources").agg(
        F.count(F.lit(1)).alias("sources"), one(F.col("active")).alias("active"), one(F.col("health") == "failed").alias("failed"), one(F.col("health") == "degraded").alias("degraded"),
        F.count_distinct("country").alias("countries"), one(F.col("is_aggregator")).alias("aggregators"),
    )


@query("ag19_live_status", "SELECT coalesce(live_status, 'none') AS live_status, count(*) AS n FROM sources GROUP BY 1")
def ag19(s, d):
    return table(s, d, "sources").groupBy(F.coalesce("live_status", F.lit("none")).alias("live_status")).agg(F.count(F.lit(1)).alias("n"))


@query("ag11_discovery_counters", "SELECT provider, count(*) AS hits, count(DISTINCT query) AS queries, count(DISTINCT domain) AS domains, count(DISTINCT normalized_url) AS urls FROM search_hits GROUP BY 1")
def ag11(s, d):
    return table(s, d, "search_hits").groupBy("provider").agg(
        F.count(F.lit(1)).alias("hits"), F.count_distinct("query").alias("queries"), F.count_distinct("domain").alias("domains"), F.count_distinct("normalized_url").alias("urls")
    )


@query("ag12_monthly_counts", "SELECT date_trunc('month', discovered_at)::TIMESTAMP AS month, provider, count(*) AS n FROM search_hits WHERE http_status = 200 GROUP BY 1, 2")
def ag12(s, d):
    return history.monthly_counts(table(s, d, "search_hits"), "discovered_at", "provider", F.col("http_status") == 200)


_SNAP = "FROM listing_snapshots"


@query(
    "wn01_price_changes",
    f"""WITH k AS (SELECT *, lag(price_eur) OVER (PARTITION BY listing_id ORDER BY captured_at, snapshot_id) AS old_value {_SNAP} WHERE price_eur IS NOT NULL)
SELECT listing_id, snapshot_id, old_value, price_eur AS new_value, round(price_eur - old_value, 2) AS delta FROM k WHERE abs(price_eur - old_value) >= 1""",
)
def wn01(s, d):
    return history.value_changes(table(s, d, "listing_snapshots"), "listing_id", "captured_at", "snapshot_id", "price_eur")


@query(
    "wn02_carry_forward",
    f"""SELECT listing_id, snapshot_id, last_value(price_eur IGNORE NULLS) OVER w AS price_eur, last_value(mileage_km IGNORE NULLS) OVER w AS mileage_km {_SNAP}
WINDOW w AS (PARTITION BY listing_id ORDER BY captured_at NULLS FIRST, snapshot_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
)
def wn02(s, d):
    return history.carry_forward(table(s, d, "listing_snapshots"), "listing_id", "captured_at", "snapshot_id", ["price_eur", "mileage_km"])


@query(
    "wn04_status_changes",
    f"""WITH k AS (SELECT *, lag(status) OVER (PARTITION BY listing_id ORDER BY captured_at NULLS FIRST, snapshot_id) AS old_state {_SNAP} WHERE status IS NOT NULL)
SELECT listing_id, snapshot_id, old_state, status AS new_state FROM k WHERE old_state IS DISTINCT FROM status""",
)
def wn04(s, d):
    return history.transitions(table(s, d, "listing_snapshots"), "listing_id", "captured_at", "snapshot_id", "status")


@query("wn07_seen_span", f"SELECT listing_id, min(captured_at) AS first_seen, max(captured_at) AS last_seen, count(*) AS n {_SNAP} GROUP BY 1")
def wn07(s, d):
    return history.seen_span(table(s, d, "listing_snapshots"), "listing_id", "captured_at")


@query("dm02_latest_state", f"SELECT listing_id, captured_at, status, mileage_km {_SNAP} QUALIFY row_number() OVER (PARTITION BY listing_id ORDER BY captured_at DESC NULLS LAST, snapshot_id DESC) = 1")
def dm02(s, d):
    return history.latest(table(s, d, "listing_snapshots"), "listing_id", "captured_at", "snapshot_id", ["status", "mileage_km"])


@query(
    "wn06_failure_runs",
    """WITH a AS (SELECT *, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS f FROM events), b AS (SELECT *, sum(1 - f) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM a)
SELECT user_id, event_id, CAST(sum(f) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM b""",
)
def wn06(s, d):
    return history.run_lengths(table(s, d, "events"), "user_id", "ts", "event_id", F.col("event_type") == "error")


@query(
    "wn05_smoothed",
    """SELECT user_id, list_reduce(list_prepend(0.0::DOUBLE, list(value::DOUBLE ORDER BY ts, event_id)), lambda a, x: CAST(round_even(CAST(a * 0.7 + x * (1 - 0.7::DOUBLE) AS DECIMAL(18,6)), 3) AS DOUBLE)) AS average, count(*) AS n
FROM events WHERE value IS NOT NULL GROUP BY 1""",
)
def wn05(s, d):
    return history.smoothed(table(s, d, "events"), "user_id", "ts", "event_id", "value")


_SIGNALS = rf"""WITH s AS (
 SELECT listing_id, 'vin:' || upper(trim(vin_public)) AS signal FROM listings WHERE trim(vin_public) <> ''
 UNION ALL SELECT listing_id, 'url:' || {_NORM.format(u='listing_url')} FROM listings WHERE listing_url <> ''
 UNION ALL SELECT listing_id, 'phone:' || right(regexp_replace(seller_phone_public, '\D', '', 'g'), 9) || '|' || coalesce(CAST(CAST(round_even(CAST(price_eur AS DECIMAL(18,4)) / 300, 0) AS BIGINT) AS VARCHAR), '?') || '|'
  || coalesce(CAST(CAST(round_even(CAST(mileage_km AS DECIMAL(18,4)) / 5000, 0) AS BIGINT) AS VARCHAR), '?') FROM listings WHERE regexp_replace(seller_phone_public, '\D', '', 'g') <> ''
)"""


@query("st02_signals", _SIGNALS + " SELECT listing_id, signal FROM s")
def st02(s, d):
    return dedup.signals(table(s, d, "listings"))


@query(
    "jn02_duplicate_clusters",
    _SIGNALS.replace("WITH s", "WITH RECURSIVE s")
    + """, e AS (SELECT DISTINCT a.listing_id AS x, b.listing_id AS y FROM s a JOIN s b USING (signal) WHERE a.listing_id <> b.listing_id),
r AS (SELECT listing_id AS x, listing_id AS y FROM listings UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT x AS listing_id, min(y) AS cluster FROM r GROUP BY 1""",
)
def jn02(s, d):
    return dedup.duplicate_clusters(table(s, d, "listings"))


@query(
    "st01_merged",
    """WITH r AS (SELECT l.*, g.dup_group_id FROM listings l JOIN listing_groups g USING (listing_id))
SELECT dup_group_id, count(*) AS n, arg_min(listing_url, listing_id) FILTER (listing_url <> '') AS listing_url, arg_min(make, listing_id) FILTER (make <> '') AS make, arg_min(model, listing_id) FILTER (model <> '') AS model,
 arg_min(city, listing_id) FILTER (city <> '') AS city, arg_min(mileage_km, listing_id) FILTER (mileage_km IS NOT NULL) AS mileage_km, arg_min(price_eur, listing_id) FILTER (price_eur IS NOT NULL) AS price_eur,
 coalesce(array_to_string(list_sort(list_filter(list_distinct(list(listing_url) FILTER (listing_url <> '')), lambda u: u <> arg)), ' '), '') AS alternate_urls
FROM (SELECT r.*, first_value(listing_url IGNORE NULLS) OVER (PARTITION BY dup_group_id ORDER BY CASE WHEN listing_url <> '' THEN 0 ELSE 1 END, listing_id) AS arg FROM r) GROUP BY dup_group_id, arg""",
)
def st01(s, d):
    return dedup.merged(table(s, d, "listings"), table(s, d, "listing_groups"), "dup_group_id").withColumn("alternate_urls", F.array_join("alternate_urls", " "))


@query("jn12_near_hashes", "SELECT vec_id AS a, vec_id + 1000000 AS b, CAST(vec_id % 12 AS BIGINT) AS distance FROM embeddings WHERE vec_id % 12 BETWEEN 1 AND 8")
def jn12(s, d):
    h = hashes(s, d)
    return dedup.near_hashes(h.select("vec_id", "hash").union(h.where("vec_id % 12 > 0").select(F.col("vec_id") + 1_000_000, "copy")), "vec_id", "hash")


# a third of the rows share the hash of vec_id 0: copies under new ids
@query(
    "jn12_hash_members",
    """SELECT vec_id, vec_id AS representative FROM embeddings UNION ALL SELECT vec_id + 2000000, (SELECT min(vec_id) FROM embeddings) FROM embeddings WHERE vec_id % 2 = 0""",
)
def jn12_members(s, d):
    h = hashes(s, d).select("vec_id", "hash")
    first = h.orderBy("vec_id").limit(1).collect()
    copies = h.where("vec_id % 2 = 0").select(F.col("vec_id") + 2_000_000, F.lit(first[0]["hash"] if first else None).alias("hash"))
    return dedup.hash_members(h.union(copies), "vec_id", "hash")


@query("so02_newest_listings", "SELECT listing_id, first_seen_at FROM listings ORDER BY first_seen_at DESC, listing_id DESC LIMIT 200")
def so02(s, d):
    return table(s, d, "listings").orderBy(F.desc_nulls_last("first_seen_at"), F.desc("listing_id")).limit(200).select("listing_id", "first_seen_at")


@query("so05_sources_by_priority", "SELECT source_id, domain, priority FROM sources WHERE active ORDER BY priority DESC NULLS LAST, source_id LIMIT 50")
def so05(s, d):
    return table(s, d, "sources").where("active").orderBy(F.desc_nulls_last("priority"), "source_id").limit(50).select("source_id", "domain", "priority")


@query("ag16_best_source", "SELECT country, arg_max(source_id, (discovery_value, -source_id)) AS source_id FROM sources WHERE country IS NOT NULL AND discovery_value IS NOT NULL GROUP BY 1")
def ag16(s, d):
    best = F.max_by("source_id", F.struct("discovery_value", -F.col("source_id")))
    return table(s, d, "sources").where("country IS NOT NULL AND discovery_value IS NOT NULL").groupBy("country").agg(best.alias("source_id"))


@query("ag08_price_bands", "SELECT least(CAST(floor(price_eur / 2500) AS BIGINT), 10) AS band, count(*) AS n FROM listings WHERE price_eur IS NOT NULL GROUP BY 1")
def ag08(s, d):
    return table(s, d, "listings").where("price_eur IS NOT NULL").groupBy(F.least(F.floor(F.col("price_eur") / 2500).cast("long"), F.lit(10)).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("jn07_listing_history", f"SELECT l.listing_id, s.domain, count(h.snapshot_id) AS n_snapshots, max(h.captured_at) AS last_captured FROM listings l LEFT JOIN listing_snapshots h USING (listing_id) LEFT JOIN sources s ON l.source_id = s.source_id GROUP BY 1, 2")
def jn07(s, d):
    snaps = table(s, d, "listing_snapshots").groupBy("listing_id").agg(F.count("snapshot_id").alias("n_snapshots"), F.max("captured_at").alias("last_captured"))
    rows = table(s, d, "listings").select("listing_id", "source_id").join(snaps, "listing_id", "left").join(table(s, d, "sources").select("source_id", "domain"), "source_id", "left")
    return rows.select("listing_id", "domain", F.coalesce("n_snapshots", F.lit(0)).alias("n_snapshots"), "last_captured")


@query("src02_unchanged", "SELECT snapshot_id, coalesce(content_hash = lag(content_hash) OVER (PARTITION BY listing_id ORDER BY captured_at NULLS FIRST, snapshot_id), false) AS unchanged FROM listing_snapshots")
def src02(s, d):
    from pyspark.sql import Window

    w = Window.partitionBy("listing_id").orderBy("captured_at", "snapshot_id")
    return table(s, d, "listing_snapshots").select("snapshot_id", F.coalesce(F.col("content_hash") == F.lag("content_hash").over(w), F.lit(False)).alias("unchanged"))


@query("cl09_fetch_outcome", "SELECT CASE WHEN blocked_by_robots THEN 'ROBOTS' WHEN from_cache THEN 'UNCHANGED' WHEN status_code BETWEEN 200 AND 299 THEN 'ACCESSIBLE' WHEN status_code IS NULL THEN 'ERROR' ELSE 'HTTP_' || status_code END AS outcome, count(*) AS n FROM fetch_results GROUP BY 1")
def cl09(s, d):
    code = F.col("status_code")
    outcome = F.when(F.col("blocked_by_robots"), "ROBOTS").when(F.col("from_cache"), "UNCHANGED").when(code.between(200, 299), "ACCESSIBLE").when(code.isNull(), "ERROR").otherwise(F.concat(F.lit("HTTP_"), code.cast("string")))
    return table(s, d, "fetch_results").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("tf01_candidates")
def tf01(s, d):
    from lotwise.operators.candidates import candidates

    return candidates(table(s, d, "fetch_results").select(F.col("fetch_id").alias("page_id"), "url", "text"))
