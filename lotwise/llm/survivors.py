"""P2: the best representative of each duplicate group, field by field.

Every attribute is decided by one maximum over a composite struct
(qualifies, rank of the source, time, tie break, value), all attributes in one
aggregation with partial (map-side) maxima. No group is ever gathered.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# First path words under which sites keep searches and stock lists, not the page of one car.
INVENTORY_WORDS = ("suche", "search", "recherche", "buscar", "stock", "gebrauchtwagen", "results", "inventory", "fahrzeuge", "ricerca", "zoeken", "szukaj")


def host_of(url: Column) -> Column:
    """Lower-case host without a leading ``www.`` and port; NULL where there is none."""
    host = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//(?:[^/?#@]*@)?(?:www\.)?([^/?#:]+)", 1)
    return F.nullif(host, F.lit(""))


def is_item_page(url: Column) -> Column:
    """Whether the URL's own shape is that of the page of one car: an id of five or more digits in its path, and no stock or search folder. NULL and empty give false; the quality label isn't trusted."""
    path = F.regexp_extract(F.lower(F.trim(url)), r"^(?:[a-z][a-z0-9+.\-]*:)?//[^/?#]+(/[^?#]*)", 1)
    first = F.regexp_extract(path, r"^/+([^/]*)", 1)
    return F.coalesce(path.rlike(r"\d{5,}") & ~first.isin(*INVENTORY_WORDS), F.lit(False))


def _best(qualifies: Column, keys: list[Column], value: Column, row_id: Column) -> Column:
    """max(struct(...)): rows that don't qualify give NULL, which a maximum ignores; the smallest id wins ties."""
    fields = [k.alias(f"k{i}") for i, k in enumerate(keys)] + [(-row_id).alias("tie"), value.alias("value")]
    return F.max(F.when(qualifies, F.struct(*fields)))


def _grouped(listings: DataFrame, groups: DataFrame, sources: DataFrame) -> DataFrame:
    """Listings with their group and, for canonical_listing_url, the rank of its host (2 dealer, 1 other, 0 aggregator)."""
    member = groups.select(F.col("listing_id"), F.col("dup_group_id")).where("listing_id IS NOT NULL AND dup_group_id IS NOT NULL").distinct()
    columns = ["listing_id", "canonical_listing_url", "listing_url", "first_seen_at", "last_seen_at", F.nullif(F.trim(F.lower("dealer_domain")), F.lit("")).alias("dealer")]
    rows = listings.select(*columns).join(member, "listing_id").withColumn("c_host", host_of(F.col("canonical_listing_url")))
    # the hosts that each group states: distinct pairs, so a hot group shrinks before the join
    stated = rows.where("dealer IS NOT NULL").select("dup_group_id", F.regexp_replace("dealer", r"^www\.", "").alias("c_host")).distinct().withColumn("is_dealer", F.lit(True))
    aggregators = sources.where("is_aggregator").select(F.regexp_replace(F.lower("domain"), r"^www\.", "").alias("c_host")).where("c_host IS NOT NULL").distinct().withColumn("is_agg", F.lit(True))
    ranked = rows.join(stated, ["dup_group_id", "c_host"], "left").join(aggregators, "c_host", "left")
    return ranked.withColumn("c_rank", F.when(F.col("is_dealer"), 2).when(F.col("is_agg"), 0).otherwise(1))


def survivors(listings: DataFrame, groups: DataFrame, sources: DataFrame, collection_start: str = "2025-01-01 00:00:00") -> DataFrame:
    """One row per group: for each of the three fields the surviving value and the listing it comes from.

    first_seen_at: the earliest that is neither before the start of collection
    nor after the row's own last_seen_at (an unknown last_seen_at can't
    contradict). listing_url: pages of one car only, the latest last_seen_at.
    canonical_listing_url: the same pages, the group's dealer before other hosts
    before aggregators, then the latest. An unknown last_seen_at ranks last, ties
    go to the smallest listing_id; where nothing qualifies value and id are NULL.
    Listings without a group and groups without a listing give no row.
    """
    rows = _grouped(listings, groups, sources)
    seen, last, rid = F.col("first_seen_at"), F.col("last_seen_at"), F.col("listing_id")
    start = F.to_timestamp_ntz(F.lit(collection_start))
    believable = seen.isNotNull() & (seen >= start) & (last.isNull() | (seen <= last))
    age = F.unix_micros(seen.cast("timestamp"))
    best = rows.groupBy("dup_group_id").agg(
        F.count_distinct("listing_id").alias("n_members"),
        _best(believable, [-age], seen, rid).alias("f"),
        _best(is_item_page(F.col("listing_url")), [last], F.col("listing_url"), rid).alias("u"),
        _best(is_item_page(F.col("canonical_listing_url")), [F.col("c_rank"), last], F.col("canonical_listing_url"), rid).alias("c"),
    )
    pick = lambda s, name: [F.col(f"{s}.value").alias(name), (-F.col(f"{s}.tie")).alias(f"{name}_from")]
    return best.select("dup_group_id", "n_members", *pick("c", "canonical_listing_url"), *pick("u", "listing_url"), *pick("f", "first_seen_at"))


def surviving_rows(survivor: DataFrame) -> DataFrame:
    """(dup_group_id, field, listing_id) of the groups with two or more listings."""
    fields = ("canonical_listing_url", "listing_url", "first_seen_at")
    pairs = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_from").alias("listing_id")) for f in fields))).alias("p")
    return survivor.where("n_members >= 2").select("dup_group_id", pairs).select("dup_group_id", "p.field", "p.listing_id").where("listing_id IS NOT NULL")


def merged_records(listings: DataFrame, groups: DataFrame, fields: list[str], newest: str = "last_seen_at", row_id: str = "listing_id") -> DataFrame:
    """One row per group with, for each of ``fields``, the newest known value (empty strings count as unknown).

    General field-by-field survivorship by the same single aggregation; unknown
    everywhere stays NULL.
    """
    member = groups.select(row_id, "dup_group_id").where("dup_group_id IS NOT NULL").distinct()
    rows = listings.select(row_id, newest, *[f for f in fields if f not in (row_id, newest)]).join(member, row_id)
    types = dict(listings.dtypes)
    known = {f: F.col(f).isNotNull() & ((F.trim(f) != "") if types[f] == "string" else F.lit(True)) for f in fields}
    bests = [_best(known[f], [F.col(newest)], F.col(f), F.col(row_id)).alias(f"b{i}") for i, f in enumerate(fields)]
    out = rows.groupBy("dup_group_id").agg(F.count(F.lit(1)).alias("n_members"), *bests)
    filled = reduce(lambda a, b: a + b, [F.col(f"b{i}").isNotNull().cast("int") for i in range(len(fields))])
    return out.select("dup_group_id", "n_members", filled.alias("n_known"), *[F.col(f"b{i}.value").alias(f) for i, f in enumerate(fields)])
