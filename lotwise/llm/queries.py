"""Queries and DuckDB oracles of the operators in this subpackage, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm import abuse, characters, language, leaks, mixing, pages, products, survivors
from lotwise.sources.tables import table


def _fields(spark: SparkSession, d: str) -> DataFrame:
    hits, raw = table(spark, d, "search_hits"), table(spark, d, "raw_listings")
    return (
        hits.select(F.lit("hit_title").alias("field"), F.col("hit_id").alias("id"), F.col("title").alias("text"))
        .union(hits.select(F.lit("hit_snippet"), "hit_id", "snippet"))
        .union(raw.select(F.lit("raw_title"), "raw_id", "title"))
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return characters.lookalike_pairs(_fields(spark, d))


def p1_classes(spark: SparkSession, d: str) -> DataFrame:
    return characters.lookalike_classes(_fields(spark, d))


def p1_canonical(spark: SparkSession, d: str) -> DataFrame:
    return characters.with_canonical(_fields(spark, d), "text", "canonical").select("field", "id", "canonical")


_P1_ROWS = f"""
WITH t(field, id, text) AS (
  SELECT 'hit_title', hit_id, title FROM search_hits UNION ALL SELECT 'hit_snippet', hit_id, snippet FROM search_hits UNION ALL SELECT 'raw_title', raw_id, title FROM raw_listings
), c AS (SELECT field, id, text, {characters.canonical_sql('text')} AS canonical FROM t)
"""
P1_FOUND_SQL = _P1_ROWS + "SELECT DISTINCT a.field, a.id AS id_a, b.id AS id_b FROM c a JOIN c b ON a.field = b.field AND a.canonical = b.canonical AND a.id < b.id WHERE a.text <> b.text AND a.canonical <> ''"
P1_CLASSES_SQL = _P1_ROWS + """SELECT field, id, min(id) OVER (PARTITION BY field, canonical) AS group_id, min(id) OVER (PARTITION BY field, text) AS text_id FROM c WHERE text IS NOT NULL AND canonical <> ''"""
P1_CANONICAL_SQL = _P1_ROWS + "SELECT field, id, canonical FROM c"


def _survivors(spark: SparkSession, d: str) -> DataFrame:
    return survivors.survivors(table(spark, d, "listings"), table(spark, d, "listing_groups"), table(spark, d, "sources"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return survivors.surviving_rows(_survivors(spark, d))


def p2_survivors(spark: SparkSession, d: str) -> DataFrame:
    return _survivors(spark, d)


MERGED = ["title", "make", "model", "production_year", "mileage_km", "power_kw", "price_eur", "country", "city", "seller_type", "seller_name", "vin_public", "image_count"]


def p2_merged(spark: SparkSession, d: str) -> DataFrame:
    return survivors.merged_records(table(spark, d, "listings"), table(spark, d, "listing_groups"), MERGED)


_P2 = r"""
WITH m AS (SELECT DISTINCT listing_id, dup_group_id FROM listing_groups WHERE listing_id IS NOT NULL AND dup_group_id IS NOT NULL),
r AS (SELECT l.*, m.dup_group_id,
  nullif(regexp_extract(lower(trim(canonical_listing_url)), '^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)', 1), '') AS c_host,
  nullif(regexp_replace(trim(lower(dealer_domain)), '^www\.', ''), '') AS dealer FROM listings l JOIN m USING (listing_id)),
k AS (SELECT r.*, CASE WHEN EXISTS (SELECT 1 FROM r q WHERE q.dup_group_id = r.dup_group_id AND q.dealer = r.c_host) THEN 2
   WHEN EXISTS (SELECT 1 FROM sources s WHERE s.is_aggregator AND regexp_replace(lower(s.domain), '^www\.', '') = r.c_host) THEN 0 ELSE 1 END AS c_rank FROM r),
q AS (SELECT *, {page_u} AS u_ok, {page_c} AS c_ok, first_seen_at IS NOT NULL AND first_seen_at >= TIMESTAMP '2025-01-01' AND (last_seen_at IS NULL OR first_seen_at <= last_seen_at) AS f_ok FROM k),
c AS (SELECT dup_group_id, listing_id, canonical_listing_url FROM q WHERE c_ok QUALIFY row_number() OVER (PARTITION BY dup_group_id ORDER BY c_rank DESC, last_seen_at DESC NULLS LAST, listing_id) = 1),
u AS (SELECT dup_group_id, listing_id, listing_url FROM q WHERE u_ok QUALIFY row_number() OVER (PARTITION BY dup_group_id ORDER BY last_seen_at DESC NULLS LAST, listing_id) = 1),
f AS (SELECT dup_group_id, listing_id, first_seen_at FROM q WHERE f_ok QUALIFY row_number() OVER (PARTITION BY dup_group_id ORDER BY first_seen_at, listing_id) = 1),
g AS (SELECT dup_group_id, count(DISTINCT listing_id) AS n_members FROM q GROUP BY 1)
"""


def _page_sql(column: str) -> str:
    words = ", ".join(f"'{w}'" for w in survivors.INVENTORY_WORDS)
    path = rf"regexp_extract(lower(trim({column})), '^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]+(/[^?#]*)', 1)"
    return rf"coalesce(regexp_matches({path}, '\d{{5,}}') AND regexp_extract({path}, '^/+([^/]*)', 1) NOT IN ({words}), false)"


_P2 = _P2.replace("{page_u}", _page_sql("listing_url")).replace("{page_c}", _page_sql("canonical_listing_url"))
P2_SURVIVORS_SQL = (
    _P2
    + """SELECT g.dup_group_id, g.n_members, c.canonical_listing_url, c.listing_id AS canonical_listing_url_from, u.listing_url, u.listing_id AS listing_url_from, f.first_seen_at, f.listing_id AS first_seen_at_from
FROM g LEFT JOIN c USING (dup_group_id) LEFT JOIN u USING (dup_group_id) LEFT JOIN f USING (dup_group_id)"""
)
P2_FOUND_SQL = (
    _P2
    + """SELECT g.dup_group_id, x.field, x.listing_id FROM g JOIN (SELECT dup_group_id, 'canonical_listing_url' AS field, listing_id FROM c UNION ALL SELECT dup_group_id, 'listing_url', listing_id FROM u
UNION ALL SELECT dup_group_id, 'first_seen_at', listing_id FROM f) x USING (dup_group_id) WHERE g.n_members >= 2"""
)


_TEXTS = ("title", "make", "model", "country", "city", "seller_type", "seller_name", "vin_public")
_KNOWN = {f: f"{f} IS NOT NULL" + (f" AND trim({f}) <> ''" if f in _TEXTS else "") for f in MERGED}
P2_MERGED_SQL = (
    "WITH r AS (SELECT l.*, m.dup_group_id FROM listings l JOIN (SELECT DISTINCT listing_id, dup_group_id FROM listing_groups WHERE dup_group_id IS NOT NULL) m USING (listing_id)) SELECT dup_group_id, count(*) AS n_members, "
    + " + ".join(f"CAST(count_if({c}) > 0 AS INTEGER)" for c in _KNOWN.values())
    + " AS n_known, "
    + ", ".join(f"first({f} ORDER BY last_seen_at DESC NULLS LAST, listing_id) FILTER ({c}) AS {f}" for f, c in _KNOWN.items())
    + " FROM r GROUP BY 1"
)


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return pages.labelled_pages(table(spark, d, "fetch_results"), table(spark, d, "raw_listings"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.furniture_lines(_pages(spark, d))


def p3_main_text(spark: SparkSession, d: str) -> DataFrame:
    return pages.main_text(_pages(spark, d), table(spark, d, "fetch_results"), table(spark, d, "raw_listings"))


def p3_templates(spark: SparkSession, d: str) -> DataFrame:
    return pages.host_templates(table(spark, d, "fetch_results"), table(spark, d, "raw_listings"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return pages.residue_records(_pages(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return products.same_item_pairs(p5_groups(spark, d))


def p5_groups(spark: SparkSession, d: str) -> DataFrame:
    return products.same_item_groups(table(spark, d, "raw_listings"), table(spark, d, "exchange_rates"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return language.wrong_labels(table(spark, d, "search_hits"), table(spark, d, "raw_listings"), table(spark, d, "documents"))


def p6_segments(spark: SparkSession, d: str) -> DataFrame:
    return language.text_segments(table(spark, d, "search_hits"), table(spark, d, "raw_listings"), language.learned(table(spark, d, "documents")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id").distinct()


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.shares(mixing.mixture(table(spark, d, "documents"), targets), targets)


def _abuse(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_scores(table(spark, d, "documents"), table(spark, d, "doc_labels"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d).where("flagged").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return _abuse(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return abuse.abuse_rates(_abuse(spark, d))


_NAMES = (
    p1_found, p1_classes, p1_canonical, p2_found, p2_survivors, p2_merged, p3_found, p3_main_text, p3_templates, p4_found, p5_found, p5_groups,
    p6_found, p6_segments, p8_found, p9_mixture, p9_shares, p10_found, p10_scores, p10_rates,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _NAMES}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": P1_FOUND_SQL, "p1_classes": P1_CLASSES_SQL, "p1_canonical": P1_CANONICAL_SQL, "p2_found": P2_FOUND_SQL, "p2_survivors": P2_SURVIVORS_SQL, "p2_merged": P2_MERGED_SQL}
