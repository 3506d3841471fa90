"""Discovery: generating search queries, choosing them, caps on hits, budgets, upserts (GN01, SC08, SC09, SC17, WN09 .. WN12, JN03, JN04, JN06, DM07, DM08, DM10, DM17, DM18, AG13, AG17, AG20)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a query template may name, as {subject}, {code} and so on: ``subjects`` are phrases for the wanted item, ``codes`` its codes, ``powers`` ways to state its power.
#: family -> templates; {sale}, {used} and {dealer} are a country's first words.
FAMILIES = {
    "A": ("{subject} {sale}", "{subject} {used}", "{subject} for sale"), "B": ("{short} {used}", "{short} {power} {used}", "{short} {power}"), "C": ("{subject} {dealer}", "{subject} {word}"),
    "D": ('"{subject}" {without}', "{short} {used} {without}"), "E": ("{code} {sale}", "{code} {used}", "{code} sale", "{code}"), "F": ("{subject} {file}", "{subject} filetype:pdf"), "G": ("{subject} forum", "{subject} club", "{subject} {dealer} forum"),
}
HIGH_VALUE, EXPLORING = ("A", "B", "E"), ("B", "D", "F", "G")


def generated(countries: DataFrame, words: dict[str, list[str]], families: str = "ABCDEFG", experimental: float = 0.2, seed: int = 0) -> DataFrame:
    """GN01: (query, country, language, family, high_value, experimental, position): all templates of the families, filled with each country's words and all of ``words`` (subject, short, code, power, word, file, without), each query once a country whatever its case.

    Of a family that explores, at least one and a fifth of its queries are
    experimental, chosen by seeded hash; families come in their order. Words that
    are missing leave their templates out.
    """
    rows = []
    for i, f in enumerate(families):
        for t in FAMILIES.get(f, ()):
            filled = [t]
            for k, values in words.items():
                filled = [x.replace("{" + k + "}", v) for x in filled for v in values] if "{" + k + "}" in t else filled
            rows += [(i, f, x) for x in filled if not any("{" + k + "}" in x for k in ("subject", "short", "code", "power", "word", "file", "without"))]
    templates = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(f).alias("family"), F.lit(x).alias("template")) for i, f, x in rows]).cast("array<struct<place:int,family:string,template:string>>")
    fill = lambda c, k, v: F.replace(c, F.lit("{" + k + "}"), v)
    q = F.col("template")
    for k, column in (("sale", "for_sale"), ("used", "used"), ("dealer", "dealer")):
        q = fill(q, k, F.get(column, F.lit(0)))
    each = countries.withColumn("t", F.explode(templates)).select("code", "language", "for_sale", "used", "dealer", "t.*")
    both = each.select(q.alias("query"), F.col("code").alias("country"), "language", "family", "place")
    once = both.groupBy(F.lower("query").alias("k"), "country").agg(F.min(F.struct("place", "family", "query", "language")).alias("m")).select("country", "m.*")
    w = Window.partitionBy("country", "family")
    chance = F.xxhash64(F.lit(seed), F.lower("query"), "country")
    out = once.withColumn("n", F.count(F.lit(1)).over(w)).withColumn("position", F.row_number().over(w.orderBy(chance, "query")))
    few = F.greatest(F.lit(1), F.floor(F.col("n") * experimental).cast("int"))
    return out.select("query", "country", "language", "family", F.col("family").isin(*HIGH_VALUE).alias("high_value"), (F.col("family").isin(*EXPLORING) & (F.col("position") <= few)).alias("experimental"), "position")


def scored(queries: DataFrame, history: DataFrame, now: Column, recent_hours: float = 20) -> DataFrame:
    """SC08, JN04: the queries with what is known of them (query, country, run_count, new_domains_found, last_run_at) and their score: 3 for a high value, 2 for families B and E, 4 if new; else the yield of a run, twice, at most 5, a point for each day of rest, at most 3, and 3 less after five runs without a find; half a point if experimental."""
    rows = queries.join(history.select("query", "country", "run_count", "new_domains_found", "last_run_at"), ["query", "country"], "left")
    hours = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_run_at").cast("timestamp"))) / F.lit(3.6e9)
    known = F.least(F.lit(5.0), F.col("new_domains_found") / F.greatest(F.lit(1), F.col("run_count")) * 2.0) + F.coalesce(F.least(F.lit(3.0), hours / 24), F.lit(0.0)) - F.when((F.col("run_count") >= 5) & (F.col("new_domains_found") == 0), 3.0).otherwise(0.0)
    score = F.when(F.col("high_value"), 3.0).otherwise(0.0) + F.when(F.col("family").isin("B", "E"), 2.0).otherwise(0.0) + F.when(F.col("run_count").isNull(), 4.0).otherwise(known) + F.when(F.col("experimental"), 0.5).otherwise(0.0)
    return rows.withColumns({"score": F.round(score, 6), "recent": F.coalesce(hours < recent_hours, F.lit(False))})


def chosen(queries: DataFrame, most: int = 40) -> DataFrame:
    """WN10: the ``most`` best queries, those run recently only where the others don't suffice; ties in order of country, family and text. A top-k, so Spark keeps ``most`` rows a task."""
    return queries.orderBy("recent", F.desc("score"), "country", "family", "query").limit(most)


def capped_pass(hits: DataFrame, per_query: int = 12, per_pass: int = 150) -> DataFrame:
    """WN09: the hits of one pass that are looked at: of each query the first ``per_query`` by rank and id, of all queries in order the first ``per_pass``; an address counts once, where it first comes up."""
    first = hits.groupBy("normalized_url").agg(F.min(F.struct("query", "rank", "hit_id")).alias("m")).select("normalized_url", "m.query", "m.rank", "m.hit_id")
    place = F.row_number().over(Window.partitionBy("query").orderBy("rank", "hit_id"))
    return first.withColumn("place", place).where(F.col("place") <= per_query).orderBy("query", "place").limit(per_pass)


def overall_rank(page: Column, position: Column, size: int = 20) -> Column:
    """WN11: rank of a hit over all pages of its query."""
    return (F.coalesce(page, F.lit(1)) - 1) * size + position


def parser_failures(scans: DataFrame, least: int = 3) -> DataFrame:
    """WN12: (source, scanned_at, n_found, typical): scans that found nothing though a source's scans before them usually found ``least`` or more (mean of all earlier ones)."""
    before = Window.partitionBy("source").orderBy("scanned_at", "scan_id").rowsBetween(Window.unboundedPreceding, -1)
    return scans.withColumn("typical", F.bround(F.avg("n_found").over(before)).cast("int")).where((F.col("n_found") == 0) & (F.col("typical") >= least))


def budget(usage: DataFrame, budgets: dict[str, int], month: Column) -> DataFrame:
    """SC17, AG12, AG20, SS06: per provider what ``month`` (its first moment) has used of its budget: used, budget, remaining, ok, warn from 80 %, pct. Only requests that succeeded count; a budget of 0 or less has no limit. Every provider of ``budgets`` has a row."""
    plan = usage.sparkSession.createDataFrame(list(budgets.items()), "provider string, budget long")
    used = usage.where(F.col("ok") & (F.date_trunc("month", "created_at") == F.date_trunc("month", month))).groupBy("provider").agg(F.count(F.lit(1)).alias("used"))
    out = plan.join(used, "provider", "left").fillna(0, ["used"])
    limited = F.col("budget") > 0
    share = F.try_divide(F.col("used"), F.col("budget"))
    return out.select(
        "provider", "used", "budget", F.when(limited, F.greatest(F.lit(0), F.col("budget") - F.col("used"))).alias("remaining"), (~limited | (F.col("used") < F.col("budget"))).alias("ok"),
        F.coalesce(limited & (share >= 0.8), F.lit(False)).alias("warn"), F.when(limited, F.round(share, 3)).otherwise(0.0).alias("pct"),
    )


def spend(calls: DataFrame, month: Column) -> DataFrame:
    """AG13: what the calls of a month cost; a missing cost is none."""
    return calls.where(F.date_trunc("month", "created_at") == F.date_trunc("month", month)).agg(F.round(F.sum(F.coalesce("cost", F.lit(0.0)).cast("decimal(18,6)")), 4).cast("double").alias("spent"))


def upserted_queries(known: DataFrame, runs: DataFrame) -> DataFrame:
    """DM07, DM10, SC09, SS05 as a batch: the known queries (query, country, run_count, new_domains_found, last_run_at, result_count, effectiveness) after ``runs`` (query, country, run_id, run_at, result_count, new_domains): counts added, the latest run's result, effectiveness folded with 0.7 and 0.3, three decimals each step, in order of time."""
    key = ["query", "country"]
    # a query runs a few times a day: its runs of one batch are few
    steps = runs.groupBy(*key).agg(F.count(F.lit(1)).alias("more"), F.sum("new_domains").alias("found"), F.max(F.struct("run_at", "run_id", "result_count")).alias("last"), F.array_sort(F.collect_list(F.struct("run_at", "run_id", F.col("new_domains").cast("double").alias("v")))).alias("s"))
    both = known.join(steps, key, "full_outer")
    zero = lambda c: F.coalesce(c, F.lit(0))
    fold = F.aggregate(F.coalesce("s", F.array().cast("array<struct<run_at:timestamp_ntz,run_id:bigint,v:double>>")), F.coalesce("effectiveness", F.lit(0.0)), lambda a, x: F.bround((a * 0.7 + x["v"] * 0.3).cast("decimal(18,6)"), 3).cast("double"))
    return both.select(
        *key, (zero(F.col("run_count")) + zero(F.col("more"))).alias("run_count"), (zero(F.col("new_domains_found")) + zero(F.col("found"))).alias("new_domains_found"),
        F.coalesce("last.run_at", "last_run_at").alias("last_run_at"), F.coalesce("last.result_count", "result_count").alias("result_count"), fold.alias("effectiveness"),
    )


def settled_hits(hits: DataFrame, outcomes: DataFrame) -> DataFrame:
    """DM08: hits with their outcome (hit_id, hit_type, processing_status, http_status), once: the latest by seq; hits without one stay PENDING."""
    last = outcomes.groupBy("hit_id").agg(F.max_by(F.struct("hit_type", "processing_status", "http_status"), "seq").alias("o"))
    kept = hits.drop("hit_type", "processing_status", "http_status")
    return kept.join(last, "hit_id", "left").select(*kept.columns, F.coalesce("o.hit_type", F.lit("UNKNOWN")).alias("hit_type"), F.coalesce("o.processing_status", F.lit("PENDING")).alias("processing_status"), F.col("o.http_status").alias("http_status"))


def logged(log: DataFrame, new: DataFrame, text: str = "query", most: int = 2000) -> DataFrame:
    """DM11, DM16 .. DM18, DM14: an append-only log with new rows; ``text`` keeps its first ``most`` characters, as the log's column is that wide, columns the log lacks are NULL in older rows."""
    cut_ = new.withColumn(text, F.substring(text, 1, most)) if text in new.columns else new
    return log.unionByName(cut_, allowMissingColumns=True)


def counted(sources: DataFrame, new_listings: DataFrame, flags: list[str]) -> DataFrame:
    """AG17: sources with the counters of ``flags`` raised by their new listings for which they hold; one aggregation, no row is visited twice."""
    plus = new_listings.where("source_id IS NOT NULL").groupBy("source_id").agg(*[F.count_if(F.coalesce(F.col(f), F.lit(False))).alias(f"__{f}") for f in flags])
    out = sources.join(plus, "source_id", "left")
    return out.select(*[c for c in sources.columns if c not in flags], *[(F.coalesce(F.col(f) if f in sources.columns else F.lit(0), F.lit(0)) + F.coalesce(f"__{f}", F.lit(0))).alias(f) for f in flags])


def cached(requests: DataFrame, cache: DataFrame, key: str, payload: str) -> DataFrame:
    """JN03, SS07: requests with the answer that the cache has for the same key and the same content hash, NULL where it has none or the content has changed."""
    c = cache.select(key, F.col(payload).alias("__p"), "answer")
    rows = requests.join(c, key, "left")
    return rows.withColumn("answer", F.when(F.col(payload) == F.col("__p"), F.col("answer"))).drop("__p")


def change_counts(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """AG18: how many rows there are and how many changed in each of ``columns``, between two states of a table."""
    both = before.select(key, *[F.col(c).alias(f"b_{c}") for c in columns]).join(after.select(key, *columns), key)
    return both.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(~F.col(c).eqNullSafe(F.col(f"b_{c}"))).alias(f"changed_{c}") for c in columns])


def bag(*parts: DataFrame) -> DataFrame:
    """ST06: candidates of several readers under one another; nothing is removed."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
