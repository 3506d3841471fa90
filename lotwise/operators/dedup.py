"""Duplicate records by any of several signals, set-wise (JN02, ST01 .. ST06).

Records that agree on one signal are linked to that signal's smallest record, so
a group of n equal signals makes n - 1 links, never n squared; links of all
signals together are clustered by min-label steps.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.text import band, hamming, phone9, vin
from lotwise.functions.urls import normalize
from lotwise.session import cut


def signals(listings: DataFrame) -> DataFrame:
    """ST02: (listing_id, signal): VIN, normalized URL, and telephone with price and mileage band (unknown bands agree with unknown ones)."""
    url = F.when(F.col("listing_url") != "", normalize(F.col("listing_url")))
    unknown = lambda c: F.coalesce(c.cast("string"), F.lit("?"))
    phone = phone9(F.col("seller_phone_public"))
    banded = F.concat_ws("|", phone, unknown(band(F.col("price_eur"), 300)), unknown(band(F.col("mileage_km"), 5000)))
    named = lambda name, c: F.when(c.isNotNull(), F.concat(F.lit(f"{name}:"), c))
    all_ = F.array(named("vin", vin(F.col("vin_public"))), named("url", url), F.when(phone.isNotNull(), F.concat(F.lit("phone:"), banded)))
    return listings.select("listing_id", F.explode(F.array_compact(all_)).alias("signal"))


def star_links(pairs: DataFrame, node: str, key: str) -> DataFrame:
    """(a, b): each record of a key linked to the key's smallest one."""
    hub = pairs.groupBy(key).agg(F.min(node).alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return pairs.join(hub, key).where(F.col(node) != F.col("a")).select("a", F.col(node).alias("b")).distinct()


def clusters(links: DataFrame, most_rounds: int = 200) -> DataFrame:
    """(node, cluster): smallest node reachable; min-label propagation with pointer jumping, each round written to the checkpoint folder.

    Labels reach over twice the distance each round, so a chain of n nodes takes
    about log n rounds. Labels that still change after ``most_rounds`` are an
    error, never returned. No links give no rows.
    """
    both = cut(links.select(F.col("a").alias("s"), F.col("b").alias("t")).union(links.select("b", "a")).where("s <> t").distinct())
    labels = cut(both.groupBy("s").agg(F.min("t").alias("m")).select(F.col("s").alias("node"), F.least("s", "m").alias("label")))
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("node", "t"), "t").groupBy("s").agg(F.min("label").alias("near"))
        step = labels.join(near.withColumnRenamed("s", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = cut(step.join(jump, "label", "left").select("node", "old", F.coalesce(F.least("label", "further"), "label").alias("label")))
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels.select("node", F.col("label").alias("cluster"))
    raise RuntimeError(f"clusters still change after {most_rounds} rounds")


def duplicate_clusters(listings: DataFrame) -> DataFrame:
    """JN02: every listing with its cluster, the smallest listing_id connected through any signal; a listing without a partner is its own cluster."""
    found = clusters(star_links(signals(listings), "listing_id", "signal"))
    return listings.select("listing_id").join(found.withColumnRenamed("node", "listing_id"), "listing_id", "left").select("listing_id", F.coalesce("cluster", "listing_id").alias("cluster"))


def merged(listings: DataFrame, groups: DataFrame, group: str) -> DataFrame:
    """ST01, ST03, ST04: one row per group: the earliest known value of each field (gaps are filled, known values stay), and all other URLs, sorted."""
    rows = listings.join(groups, "listing_id")
    earliest = lambda c, known: F.min(F.when(known, F.struct("listing_id", F.col(c).alias("v"))))["v"].alias(c)
    text = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    url = F.min(F.when(text("listing_url"), F.struct("listing_id", "listing_url")))["listing_url"]
    out = rows.groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), url.alias("listing_url"), F.collect_set(F.when(text("listing_url"), F.col("listing_url"))).alias("urls"),
        earliest("make", text("make")), earliest("model", text("model")), earliest("city", text("city")), earliest("mileage_km", F.col("mileage_km").isNotNull()), earliest("price_eur", F.col("price_eur").isNotNull()),
    )
    return out.withColumn("alternate_urls", F.array_sort(F.array_except("urls", F.array("listing_url")))).drop("urls")


def _flips(width: int, most: int) -> list[int]:
    """Every pattern of at most ``most`` set bits among ``width``."""
    return [sum(1 << i for i in bits) for n in range(most + 1) for bits in combinations(range(width), n)]


def near_hashes(rows: DataFrame, key: str, hash_column: str, most: int = 8, widths: tuple[int, ...] = (21, 21, 22)) -> DataFrame:
    """FN-S08/09 as a join: pairs (a, b) of 64-bit hexadecimal hashes within ``most`` bits.

    Hashes that differ in at most ``most`` bits differ in at most most // 3 of one
    of the three chunks. One side is sent to its own chunks, the other to all
    chunks within that many bits, so only hashes that agree in 21 bits meet: n
    hashes make about n * n / 3000 comparisons, and a block holds n / 2^21 of
    them. Equal hashes are folded first and stand for each other:
    ``hash_members`` says for whom. NULL and malformed hashes give no pair.
    """
    good = rows.where(F.col(hash_column).rlike("^[0-9a-fA-F]{1,16}$"))
    one = good.groupBy(F.conv(hash_column, 16, -10).cast("long").alias("v")).agg(F.min(key).alias(key))
    starts = [sum(widths[:i]) for i in range(len(widths))]
    chunk = [F.shiftrightunsigned("v", starts[i]).bitwiseAND((1 << w) - 1) for i, w in enumerate(widths)]
    flipped = lambda i, w: F.transform(F.array(*[F.lit(f).cast("long") for f in _flips(w, most // len(widths))]), lambda f: F.struct(F.lit(i).alias("i"), chunk[i].bitwiseXOR(f).alias("c")))
    near = [flipped(i, w) for i, w in enumerate(widths)]
    own = F.array(*[F.struct(F.lit(i).alias("i"), c.alias("c")) for i, c in enumerate(chunk)])
    x = one.select(F.col(key).alias("a"), F.col("v").alias("va"), F.explode(own).alias("p")).select("a", "va", "p.i", "p.c")
    y = one.select(F.col(key).alias("b"), F.col("v").alias("vb"), F.explode(F.concat(*near)).alias("p")).select("b", "vb", "p.i", "p.c")
    distance: Column = F.bit_count(F.col("va").bitwiseXOR(F.col("vb")))
    return x.join(y, ["i", "c"]).where((F.col("a") < F.col("b")) & (distance <= most)).select("a", "b", distance.cast("long").alias("distance")).distinct()


def hash_members(rows: DataFrame, key: str, hash_column: str) -> DataFrame:
    """(key, representative): every row with a hash and the smallest key of equal hashes, which stands for it in ``near_hashes``; members of one representative are at distance 0."""
    good = rows.where(F.col(hash_column).rlike("^[0-9a-fA-F]{1,16}$")).withColumn("__v", F.conv(hash_column, 16, -10).cast("long"))
    one = good.groupBy("__v").agg(F.min(key).alias("representative"))
    return good.join(one, "__v").select(key, "representative").distinct()


def diverse(urls: Column, hashes: Column, most: int = 5, apart: int = 6) -> Column:
    """JN12: of a gallery at most ``most`` images of different looks: each one that differs in more than ``apart`` bits from all kept before it. Without one hash per image, images at even steps. NULL and empty URLs are skipped, NULL galleries give an empty array."""
    shown = F.coalesce(F.filter(urls, lambda u: u.isNotNull() & (u != "")), F.array().cast("array<string>"))
    rows = F.arrays_zip(shown.alias("u"), hashes.alias("h"))
    start = F.array().cast("array<struct<u:string,h:string>>")
    keep = lambda kept, x: F.when((F.size(kept) < most) & ~F.exists(kept, lambda k: hamming(k["h"], x["h"]) <= apart), F.concat(kept, F.array(F.struct(x["u"].alias("u"), x["h"].alias("h"))))).otherwise(kept)
    by_look = F.transform(F.aggregate(rows, start, keep), lambda x: x["u"])
    step = F.greatest(F.lit(1), F.floor(F.size(shown) / most).cast("int"))
    spread = F.slice(F.filter(shown, lambda u, i: i % step == 0), 1, most)
    return F.when((F.size(shown) > 0) & (F.size(hashes) == F.size(shown)), by_look).when(F.size(shown) <= most, shown).otherwise(spread)
