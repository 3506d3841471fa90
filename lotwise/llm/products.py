"""P5: listings that describe the same physical item.

Attributes and units are parsed to one form, rows are folded to adverts and to
distinct attribute signatures, signatures are compared within selective blocks,
match weights are fitted by expectation-maximisation on the counts of comparison
patterns, and links above the threshold are clustered.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.facts import advert_key, currency_code, litres, model_slug, with_facts
from lotwise.llm.characters import with_canonical
from lotwise.operators.dedup import clusters
from lotwise.session import cut

#: Levels of each compared field, best first; "unknown" carries no weight.
FIELDS = {
    "km": ("exact", "near", "rough", "other"),
    "place": ("same", "other", "unknown"),
    "year": ("same", "other", "unknown"),
    "price": ("near", "similar", "far", "unknown"),
    "vin": ("same", "other", "unknown"),
    "site": ("same", "other"),
}
SIGNATURE = ["model", "size", "km", "place", "year", "eur", "vin"]


def _models(rows: DataFrame) -> DataFrame:
    """Fills ``model`` of rows whose URL has none, from the adjacent words of the title that other rows' URLs know as a make and model."""
    catalogue = rows.where("model IS NOT NULL").groupBy("model").agg(F.count(F.lit(1)).alias("n")).where("n >= 2").withColumnRenamed("model", "bigram")
    without = with_canonical(rows.where("model IS NULL").select("raw_id", "title"), "title", "canon")
    words = F.filter(F.split(F.lower("canon"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pairs = without.select("raw_id", words.alias("w")).where(F.size("w") >= 2)
    pairs = pairs.select("raw_id", F.explode(F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit("-"), F.get("w", i + 1)))).alias("bigram"))
    named = pairs.join(catalogue, "bigram").groupBy("raw_id").agg(F.max(F.struct("n", "bigram")).alias("m")).select("raw_id", F.col("m.bigram").alias("title_model"))
    return rows.join(named, "raw_id", "left").withColumn("model", F.coalesce("model", "title_model")).drop("title_model")


def attributes(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """raw_id with its advert key and canonical attributes: model, size (tenths of a litre), year, km, place, eur, vin."""
    columns = ["raw_id", "title", "url", "year", "mileage_km", "displacement_cc", "price", "currency", "vin"]
    facts = with_facts(raw.select(*columns, "description", "raw_text"), F.col("description"), F.col("raw_text")).drop("description", "raw_text")
    rate = rates.where("currency IS NOT NULL").groupBy("currency").agg(F.max("eur_per_unit").alias("rate"))
    facts = facts.withColumn("code", F.coalesce("fact_currency", currency_code(F.col("currency")), F.lit("EUR"))).withColumn("amount", F.coalesce("fact_amount", "price"))
    rows = facts.join(rate.withColumnRenamed("currency", "code"), "code", "left").select(
        "raw_id", "title", F.coalesce(advert_key(F.col("url")), F.concat(F.lit("row#"), F.col("raw_id").cast("string"))).alias("advert"), model_slug(F.col("url")).alias("model"),
        F.coalesce(litres(F.col("title")), F.round(F.col("displacement_cc") / 100).cast("int")).alias("size"), F.coalesce("year", "fact_year").alias("year"),
        F.coalesce("fact_km", F.col("mileage_km").cast("double"), "fact_rough_km").alias("km"), F.col("fact_place").alias("place"),
        F.when(F.col("amount") * F.col("rate") >= 10, F.round(F.col("amount") * F.col("rate"), -1)).alias("eur"), F.upper(F.nullif(F.trim("vin"), F.lit(""))).alias("vin"),
    )
    # miles come back a kilometre or so beside the rounded figure they were made from
    km = F.col("km")
    for digits in (-3, -2):
        km = F.when(F.abs(km - F.round(km, digits)) < 1.7, F.round(km, digits)).otherwise(km)
    return _models(cut(rows.withColumn("km", F.round(km)))).drop("title")


def _blocks(sig: DataFrame) -> DataFrame:
    """(block, signature): two overlapping mileage grids of 1000 km within model and engine, the place and year, the VIN."""
    base = F.concat_ws("|", "model", F.col("size").cast("string"))
    has = F.col("model").isNotNull() & F.col("size").isNotNull()
    by_km = has & F.col("km").isNotNull()
    keys = [
        F.when(by_km, F.concat_ws("|", F.lit("a"), base, F.floor(F.col("km") / 1000).cast("string"))),
        F.when(by_km, F.concat_ws("|", F.lit("b"), base, F.floor((F.col("km") + 500) / 1000).cast("string"))),
        F.when(has & F.col("place").isNotNull() & F.col("year").isNotNull(), F.concat_ws("|", F.lit("p"), base, "place", F.col("year").cast("string"))),
        F.when(F.col("vin").isNotNull(), F.concat_ws("|", F.lit("v"), "vin")),
    ]
    return sig.select("sid", *SIGNATURE, "host", F.explode(F.array_compact(F.array(*keys))).alias("block"))


def _compare() -> dict[str, Column]:
    """Level of each field for a pair with columns x_ and y_."""
    both = lambda c: F.col(f"x_{c}").isNotNull() & F.col(f"y_{c}").isNotNull()
    same = lambda c: F.when(~both(c), "unknown").when(F.col(f"x_{c}") == F.col(f"y_{c}"), "same").otherwise("other")
    gap = F.abs(F.col("x_km") - F.col("y_km"))
    whole = (F.col("x_km") % 100 == 0) | (F.col("y_km") % 100 == 0)
    thousands = (F.col("x_km") % 1000 == 0) | (F.col("y_km") % 1000 == 0)
    km = F.when((gap <= 2) & ~whole, "exact").when((gap <= 100) & ~thousands, "near").when((gap <= 2) | (thousands & (gap <= 1000)), "rough").when(gap.isNull(), "rough").otherwise("other")
    ratio = F.abs(F.ln(F.try_divide(F.col("x_eur"), F.col("y_eur"))))
    price = F.when(~both("eur"), "unknown").when(ratio <= 0.08, "near").when(ratio <= 0.3, "similar").otherwise("far")
    return {"km": km, "place": same("place"), "year": same("year"), "price": price, "vin": same("vin"), "site": F.when(F.col("x_host") == F.col("y_host"), "same").otherwise("other")}


def fit_weights(patterns: list[dict], rounds: int = 200) -> tuple[dict[str, dict[str, float]], float]:
    """Match weights (natural logarithm of m/u) by field and level, and the log prior odds, from pattern counts.

    A two-class mixture with independent fields, fitted by expectation-maximisation;
    patterns is the full table of distinct comparison patterns with their counts n,
    whose size is bounded by the product of the level counts, whatever the input.
    """
    names = list(FIELDS)
    n = np.array([float(p["n"]) for p in patterns])
    level = {f: np.array([FIELDS[f].index(p[f]) for p in patterns]) for f in names}
    m = {f: np.array([0.9 if i == 0 else 0.1 / max(1, len(FIELDS[f]) - 1) for i in range(len(FIELDS[f]))]) for f in names}
    m["site"] = np.array([0.2, 0.8])
    u = {f: np.array([0.1 if i == 0 else 0.9 / max(1, len(FIELDS[f]) - 1) for i in range(len(FIELDS[f]))]) for f in names}
    start = {id(m): {f: 5 * v for f, v in m.items()}, id(u): {f: 5 * v for f, v in u.items()}}  # counts that keep small inputs sane
    prior = 0.1
    for _ in range(rounds):
        lm, lu = np.log(prior) * np.ones(len(n)), np.log(1 - prior) * np.ones(len(n))
        for f in names:
            known = np.array([x != "unknown" for x in FIELDS[f]])[level[f]]
            lm += np.where(known, np.log(m[f][level[f]]), 0)
            lu += np.where(known, np.log(u[f][level[f]]), 0)
        g = 1 / (1 + np.exp(np.clip(lu - lm, -500, 500)))
        before, prior = prior, float(np.clip((g * n).sum() / n.sum(), 1e-6, 1 - 1e-6))
        for f in names:
            known = np.array([x != "unknown" for x in FIELDS[f]])
            for table, w in ((m, g * n), (u, (1 - g) * n)):
                c = (np.bincount(level[f], weights=w, minlength=len(known)) + start[id(table)][f]) * known
                table[f] = np.where(known, c / c.sum(), 1.0)
        if abs(prior - before) < 1e-9:
            break
    return {f: {x: (0.0 if x == "unknown" else float(np.log(m[f][i] / u[f][i]))) for i, x in enumerate(FIELDS[f])} for f in names}, math.log(prior / (1 - prior))


def same_item_groups(raw: DataFrame, rates: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(raw_id, item_id): every row of ``raw`` once; item_id is the smallest raw_id of its group.

    Crawls of one advert and rows of one attribute signature are one by
    construction and are folded before any comparison, so copies never meet in
    pairs. Signatures are compared within blocks that agree on model and engine
    and on mileage (two overlapping grids), or on place and year, or on the VIN.
    A pair is linked when its fitted match probability reaches ``threshold`` and
    neither mileage nor VIN contradicts it. Rows without a model, engine or
    mileage are linked by advert or VIN only; NULL fields carry no weight.
    """
    rows = cut(attributes(raw, rates))
    first = lambda c: F.max(F.struct(F.col(c).isNotNull(), F.col(c)))[c].alias(c)
    fine_km = F.max(F.when(F.col("km").isNotNull(), F.struct((F.col("km") % 100 != 0).alias("fine"), F.col("km").alias("km"))))["km"].alias("km")
    adverts = rows.groupBy("advert").agg(F.min("raw_id").alias("first_id"), fine_km, *[first(c) for c in SIGNATURE if c != "km"])
    adverts = adverts.withColumn("host", F.split("advert", "#")[0])
    # one id per signature; a signature without model, size or km is its advert's own
    whole = F.col("model").isNotNull() & F.col("size").isNotNull() & F.col("km").isNotNull() & F.col("place").isNotNull() & F.col("year").isNotNull()
    # 128 bits: a signature's hash is its identity
    key = lambda seed: F.when(whole, F.xxhash64(F.lit(seed), *SIGNATURE)).otherwise(F.xxhash64(F.lit(seed), F.lit("advert"), F.col("advert")))
    adverts = cut(adverts.withColumns({"sig": key(1), "sig2": key(2)}))
    sig = adverts.groupBy("sig", "sig2").agg(F.min("first_id").alias("sid"), F.min("host").alias("host"), *[F.max(c).alias(c) for c in SIGNATURE])
    blocks = _blocks(sig)
    x = blocks.select(*[F.col(c).alias(f"x_{c}") for c in ("sid", "host", *SIGNATURE)], "block")
    y = blocks.select(*[F.col(c).alias(f"y_{c}") for c in ("sid", "host", *SIGNATURE)], "block")
    pairs = x.join(y, "block").where("x_sid < y_sid").select(F.col("x_sid").alias("a"), F.col("y_sid").alias("b"), *[c.alias(f) for f, c in _compare().items()])
    pairs = cut(pairs.dropDuplicates(["a", "b"]))
    patterns = [r.asDict() for r in pairs.groupBy(*FIELDS).agg(F.count(F.lit(1)).alias("n")).collect()]  # at most the product of the level counts
    if patterns:
        weights, odds = fit_weights(patterns)
        score = F.lit(odds)
        for f, levels in weights.items():
            score = score + F.element_at(F.create_map(*[F.lit(z) for kv in levels.items() for z in kv]), F.col(f))
        contradicted = ((F.col("km") == "other") & (F.col("vin") != "same")) | (F.col("vin") == "other")
        links = pairs.where((score >= math.log(threshold / (1 - threshold))) & ~contradicted).select("a", "b")
    else:
        links = pairs.select("a", "b")
    groups = clusters(links).withColumnRenamed("cluster", "component")
    sid = adverts.join(sig.select("sig", "sig2", "sid"), ["sig", "sig2"]).join(groups.select(F.col("node").alias("sid"), "component"), "sid", "left")
    named = sid.select("advert", F.coalesce("component", "sid").alias("item_id"))
    return rows.select("raw_id", "advert").join(named, "advert").select("raw_id", "item_id")


def same_item_pairs(groups: DataFrame) -> DataFrame:
    """(raw_id_a, raw_id_b) of every two rows of one group, the smaller id first. The form TESTDATA.md asks for; elsewhere use the membership table."""
    a, b = groups.select(F.col("raw_id").alias("raw_id_a"), "item_id"), groups.select(F.col("raw_id").alias("raw_id_b"), "item_id")
    return a.join(b, "item_id").where("raw_id_a < raw_id_b").select("raw_id_a", "raw_id_b").distinct()
