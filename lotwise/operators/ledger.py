"""State of the listings from batches of observations, set-wise: upserts, histories, staleness (DM01, DM02, DM05, DM12 .. DM14, WN01, WN03, SC11).

The state has one row a listing; a batch may hold any number of observations of
it, late ones too. A merge is one full outer join of the state with the batch's
folded observations, and returns the new state beside the history rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.functions.urls import best_external, normalize, pick_canonical, quality, stable_id

STATE = ("internal_id", "first_seen_at", "last_seen_at", "listing_status", "consecutive_misses", "price_original", "currency", "price_eur")


def original_price_changes(obs: DataFrame, key: str = "internal_id", at: str = "seen_at", tie: str = "seq", least: float = 1.0) -> DataFrame:
    """WN01: observations whose price differs from their listing's previous known one: by ``least`` or more in the same currency, or in the currency itself. What only the exchange rate has moved is no change. NULL currencies are one currency."""
    w = Window.partitionBy(key).orderBy(at, tie)
    known = obs.where("price_original IS NOT NULL").withColumn("prev", F.lag(F.struct("price_original", "currency", "price_eur")).over(w))
    same = F.col("currency").eqNullSafe(F.col("prev.currency"))
    changed = F.col("prev").isNotNull() & (~same | (F.abs(F.col("price_original") - F.col("prev.price_original")) >= least))
    return known.where(changed).select(key, tie, F.col(at).alias("changed_at"), F.col("prev.price_original").alias("old_price"), F.col("price_original").alias("new_price"), "currency", F.round(F.col("price_eur") - F.col("prev.price_eur"), 2).alias("delta"))


def misses(scans: DataFrame, key: str = "internal_id", at: str = "scanned_at", limit: int = 3) -> DataFrame:
    """WN03: (key, at, misses, status) after each scan (key, at, seen): consecutive scans that missed the listing; ACTIVE when seen, MAYBE_ACTIVE after a miss, EXPIRED from ``limit`` on. A listing that is seen again is ACTIVE with no misses."""
    w = Window.partitionBy(key).orderBy(at)
    rows = scans.withColumn("island", F.sum(F.col("seen").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.sum((~F.col("seen")).cast("int")).over(Window.partitionBy(key, "island").orderBy(at).rowsBetween(Window.unboundedPreceding, 0))
    return rows.select(key, at, n.alias("misses")).withColumn("status", F.when(F.col("misses") == 0, "ACTIVE").when(F.col("misses") >= limit, "EXPIRED").otherwise("MAYBE_ACTIVE"))


def gone_stale(state: DataFrame, now: Column, hours: int = 20, limit: int = 3) -> DataFrame:
    """SS02, WN03 as one step: active listings not seen for ``hours`` have missed one more time; MAYBE_ACTIVE after the first miss, EXPIRED from ``limit`` on. Other listings, and those just seen, stay as they are."""
    late = F.col("listing_status").isin("ACTIVE", "MAYBE_ACTIVE") & (F.col("last_seen_at").isNull() | (F.col("last_seen_at") < now - F.make_interval(hours=F.lit(hours))))
    n = F.coalesce("consecutive_misses", F.lit(0)) + F.when(F.coalesce(late, F.lit(False)), 1).otherwise(0)
    status = F.when(~F.coalesce(late, F.lit(False)), F.col("listing_status")).when(n >= limit, "EXPIRED").when(n == 1, "MAYBE_ACTIVE").otherwise(F.col("listing_status"))
    return state.withColumns({"listing_status": status, "consecutive_misses": n})


def candidate_rows(raw: DataFrame, sources: DataFrame) -> DataFrame:
    """SC11: candidates as rows of the listings' table: id from the normalized URL, quality worked out where it isn't known, the source's attributes; texts keep their whole length."""
    s = sources.select(F.col("domain").alias("source_domain"), "source_id", F.coalesce("discovery_value", F.lit(50)).alias("source_confidence"))
    rows = raw.join(s, "source_domain", "left")
    return rows.select(
        stable_id(normalize(F.col("url"))).alias("internal_id"), "raw_id", "title", "url", "price", "currency", "mileage_km", F.col("year").alias("production_year"), "power_kw", "country", "source_id",
        F.coalesce("source_confidence", F.lit(50)).alias("source_confidence"), F.coalesce("listing_url_quality", quality(F.col("url"))).alias("listing_url_quality"), F.col("crawled_at").alias("seen_at"),
    )


def folded(obs: DataFrame, facts: list[str]) -> DataFrame:
    """The observations of a batch, one row a listing: first and last time, the latest known price with its currency, and each fact's earliest known value. One aggregation; nothing is gathered."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct("seen_at", "seq", c)))[c].alias(c)
    price = F.max(F.when(F.col("price_original").isNotNull(), F.struct("seen_at", "seq", "price_original", "currency", "price_eur"))).alias("p")
    return obs.groupBy("internal_id").agg(F.min("seen_at").alias("from_"), F.max("seen_at").alias("to_"), price, *[first(c) for c in facts])


def merged_state(state: DataFrame, obs: DataFrame, facts: list[str]) -> DataFrame:
    """DM01, DM02, WN02, WN07: the state after a batch: new listings are added as ACTIVE, seen ones are ACTIVE again without misses, the price is the latest known, facts that are known stay and gaps are filled. Listings that the batch doesn't name stay as they are; a batch without rows changes nothing, and the same batch twice changes nothing more. A NULL id is no listing."""
    new = folded(obs.where("internal_id IS NOT NULL"), facts).select("internal_id", "from_", "to_", "p", *[F.col(c).alias(f"n_{c}") for c in facts])
    both = state.join(new, "internal_id", "full_outer")
    seen = F.col("to_").isNotNull()
    later = seen & F.col("p").isNotNull() & (F.col("last_seen_at").isNull() | (F.col("p.seen_at") >= F.col("last_seen_at")) | F.col("price_original").isNull())
    return both.select(
        "internal_id", F.least("first_seen_at", "from_").alias("first_seen_at"), F.greatest("last_seen_at", "to_").alias("last_seen_at"), F.when(seen, "ACTIVE").otherwise(F.col("listing_status")).alias("listing_status"),
        F.when(seen, 0).otherwise(F.col("consecutive_misses")).alias("consecutive_misses"), *[F.when(later, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in ("price_original", "currency", "price_eur")],
        *[F.coalesce(F.col(c), F.col(f"n_{c}")).alias(c) for c in facts],
    )


def status_rows(before: DataFrame, after: DataFrame, at: Column) -> DataFrame:
    """DM14, WN04: a history row for each listing whose status has changed or that is new (no old status)."""
    both = after.select("internal_id", F.col("listing_status").alias("new_status")).join(before.select("internal_id", F.col("listing_status").alias("old_status")), "internal_id", "left")
    return both.where(~F.col("new_status").eqNullSafe(F.col("old_status"))).select("internal_id", "old_status", "new_status", at.alias("changed_at"))


def reviewed(listings: DataFrame, platforms: tuple[str, ...] = ()) -> DataFrame:
    """DM05, DM13, SC14: every listing with the quality of its best URL worked out anew, its canonical URL chosen anew, and UNRESOLVED and ACTIVE exchanged where it now has or lacks the page of one item. A projection: no shuffle, any number of rows."""
    urls = F.array("canonical_listing_url", "original_listing_url", "listing_url")
    # columns of their own, so that what is used more than once is worked out once
    rows = listings.withColumn("__best", best_external(F.col("canonical_listing_url"), F.col("original_listing_url"), F.col("listing_url")))
    rows = rows.withColumn("__url", F.coalesce("__best", "listing_url"))
    best = F.col("__best")
    status = F.when((F.col("listing_status") == "UNRESOLVED") & best.isNotNull(), "ACTIVE").when((F.col("listing_status") == "ACTIVE") & best.isNull(), "UNRESOLVED").otherwise(F.col("listing_status"))
    out = rows.withColumns({"listing_url_quality": quality(F.col("__url")), "canonical_listing_url": pick_canonical(urls, F.col("dealer_domain"), platforms), "listing_status": status})
    return out.drop("__best", "__url")


def job_states(events: DataFrame) -> DataFrame:
    """DM12: the latest state of each job (job_id, seq, status, progress, message): progress never falls."""
    return events.groupBy("job_id").agg(F.max_by("status", "seq").alias("status"), F.max("progress").alias("progress"), F.max_by("message", F.when(F.col("message").isNotNull(), F.col("seq"))).alias("message"))
