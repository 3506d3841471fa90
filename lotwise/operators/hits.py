"""Search hits and sources: merging providers, caps, overlaps, coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def merge_providers(hits: DataFrame) -> DataFrame:
    """SRC09, ST05, WN08: one row per normalized_url with the first provider's hit (provider name, then rank with unknown ones last, then id), all providers joined by '+', and the number of hits. NULL urls form one group."""
    first = F.min(F.struct("provider", F.coalesce("rank", F.lit(2**31 - 1)), "hit_id", "title")).alias("f")
    out = hits.groupBy("normalized_url").agg(first, F.array_join(F.array_sort(F.collect_set("provider")), "+").alias("providers"), F.count(F.lit(1)).alias("n_hits"))
    return out.select("normalized_url", "providers", "n_hits", F.col("f.hit_id").alias("hit_id"), F.col("f.title").alias("title"))


def first_occurrence(df: DataFrame, keys: list[Column], order: str) -> DataFrame:
    """WN08: the rows that come first of their key; equal to row_number() = 1, without sorting whole groups."""
    named = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    firsts = df.select(*named, F.col(order).alias("__o")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min("__o").alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def capped(hits: DataFrame, per_query: int = 12) -> DataFrame:
    """WN09: the best ``per_query`` hits of each query by rank and id. Spark keeps only as many rows per task and query before the shuffle (window group limit)."""
    w = Window.partitionBy("query").orderBy("rank", "hit_id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= per_query)


def provider_overlap(hits: DataFrame) -> DataFrame:
    """AG07, AG14, JN10: per provider the domains it finds, and those no other provider finds; two aggregations, no self join."""
    by_domain = hits.where("domain IS NOT NULL AND provider IS NOT NULL").groupBy("domain").agg(F.collect_set("provider").alias("p"))
    rows = by_domain.select("domain", F.size("p").alias("n"), F.explode("p").alias("provider"))
    return rows.groupBy("provider").agg(F.count(F.lit(1)).alias("domains"), F.sum((F.col("n") == 1).cast("long")).alias("only_here"))


def by_status(hits: DataFrame, statuses: list[str]) -> DataFrame:
    """AG06: hits per provider and status as one column each, missing ones 0."""
    return hits.groupBy("provider").agg(*[F.sum(F.coalesce((F.col("processing_status") == x).cast("long"), F.lit(0))).alias(x.lower()) for x in statuses])


def coverage(countries: DataFrame, sources: DataFrame) -> DataFrame:
    """JN08, AG03: every country once with its sources, healthy ones and kinds; countries without sources have zeros."""
    agg = sources.groupBy("country").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("health") == "healthy").alias("healthy"), F.count_distinct("source_type").alias("kinds"))
    return countries.join(agg, "country", "left").fillna(0, ["n", "healthy", "kinds"])


def gaps(sources: DataFrame, kinds: list[str]) -> DataFrame:
    """JN09, AG09: per country the expected kinds of source it lacks, sorted and joined by a comma; from one aggregation, without pairing countries and kinds."""
    have = sources.where("country IS NOT NULL").groupBy("country").agg(F.collect_set("source_type").alias("have"), F.count(F.lit(1)).alias("n"))
    return have.select("country", "n", F.array_join(F.array_sort(F.array_except(F.array(*[F.lit(k) for k in kinds]), "have")), ",").alias("missing"))


def unknown_domains(hits: DataFrame, sources: DataFrame) -> DataFrame:
    """JN05, JN06, JN11, SRC10: domains of hits that aren't sources yet (anti join), with their hits."""
    return hits.where("domain IS NOT NULL").groupBy("domain").agg(F.count(F.lit(1)).alias("n")).join(sources.select("domain"), "domain", "left_anti")
