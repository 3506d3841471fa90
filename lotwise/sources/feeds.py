"""Feeds, sitemaps and evolving tables (SRC05, SRC06, TF11, SRC10, SNK03)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.functions.text import enriched

ITEM = "title string, link string, description string, pubDate string, guid string"
ENTRY = "title string, link array<struct<_href:string,_rel:string>>, summary string, content string, updated string, id string"


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    """SRC05: items of stored RSS files and entries of stored Atom files: title, link, description, pubDate, guid. An entry's link is its alternate one, else its first; a title may be marked up."""
    items = spark.read.format("xml").option("rowTag", "item").schema(ITEM).load(path)
    entries = spark.read.format("xml").option("rowTag", "entry").schema(ENTRY).load(path)
    own = F.get(F.filter("link", lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    rows = entries.select("title", F.coalesce(own, F.get("link", F.lit(0))["_href"]).alias("link"), F.coalesce("summary", "content").alias("description"), F.col("updated").alias("pubDate"), F.col("id").alias("guid"))
    return items.unionByName(rows)


def feed_candidates(items: DataFrame, as_of_year: int = 2025) -> DataFrame:
    """SRC05: feed items as candidates, with the numbers that their own texts state; items without a link are none."""
    rows = items.where("link IS NOT NULL AND trim(link) <> ''").select(
        "title", F.trim("link").alias("url"), F.trim(F.regexp_replace("description", r"<[^<>]*>", " ")).alias("description"), F.lit(None).cast("string").alias("raw_text"),
        *[F.lit(None).cast(t).alias(c) for c, t in (("price", "double"), ("currency", "string"), ("mileage_km", "int"), ("year", "int"), ("power_kw", "int"), ("power_hp", "int"), ("displacement_cc", "int"))],
        F.lit("feed").alias("extraction_method"),
    )
    return enriched(rows, as_of_year)


def robots_sitemaps(lines: DataFrame) -> DataFrame:
    """SRC06: (domain, line) of stored robots files -> (domain, loc): the sitemaps they name, each once, and every domain's usual one."""
    named = lines.select("domain", F.trim(F.regexp_extract("line", r"(?i)^\s*sitemap:\s*(\S+)", 1)).alias("loc")).where("loc <> ''")
    return named.union(lines.select("domain", F.concat(F.lit("https://"), "domain", F.lit("/sitemap.xml")))).distinct()


def sitemap_children(spark: SparkSession, path: str, most: int = 10) -> DataFrame:
    """SRC06: the sitemaps that stored index files name: of each file the first ``most`` in the file's order, as a crawl follows no more."""
    rows = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string, lastmod string").load(path).where("loc IS NOT NULL")
    placed = rows.select(F.trim("loc").alias("loc"), "lastmod", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("n"))
    return placed.withColumn("place", F.row_number().over(Window.partitionBy("file").orderBy("n"))).where(F.col("place") <= most).select("file", "place", "loc", "lastmod")


def sitemap_urls(spark: SparkSession, path: str, interesting: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC06, TF11: locations of stored sitemap files, each once with its latest change; where any matches ``interesting`` only those that do, at most ``limit`` by address."""
    urls = spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path).where("loc IS NOT NULL").groupBy(F.trim("loc").alias("loc")).agg(F.max("lastmod").alias("lastmod"))
    if interesting is not None:
        hit = F.col("loc").rlike(interesting)
        some = urls.agg(F.bool_or(hit).alias("some"), F.lit(1).alias("one"))
        urls = urls.withColumn("one", F.lit(1)).join(F.broadcast(some), "one").where(hit | ~F.col("some")).drop("one", "some")
    return urls.orderBy("loc").limit(limit) if limit else urls


def insert_absent(table: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The table plus the new rows whose key it doesn't have; doing it twice changes nothing."""
    return table.unionByName(new.join(table.select(key), key, "left_anti").dropDuplicates([key]), allowMissingColumns=True)


def evolved(df: DataFrame, schema: T.StructType, defaults: dict | None = None) -> DataFrame:
    """``df`` with the columns of ``schema`` that it lacks, filled with their defaults; nothing is dropped or retyped."""
    missing = [f for f in schema.fields if f.name not in df.columns]
    return df.withColumns({f.name: F.lit((defaults or {}).get(f.name)).cast(f.dataType) for f in missing}) if missing else df
