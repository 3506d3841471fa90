"""P7: quantities recorded in different units, scales and currencies.

Every number is an observation of an entity (its row, its advert, its car) by a
channel: the number field of a site in one unit, or the texts, whose units are
explicit. Channels that observe the same entities are linked, each pair gets a
robust scale and offset, scales are snapped to known conversions and propagated
through the graph of channels from the texts. A number's unit is that of its
channel: which of its site's channels it belongs to is told by its ratio to the
texts of its entity; numbers that no text reaches belong to a channel of their own,
which other sites' numbers of the same cars tie to the graph.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from lotwise.functions.facts import BHP_TO_HP, HP_PER_KW, advert_key, currency_code, litres, model_slug, with_facts
from lotwise.session import cut

#: Known conversions: name -> factor by which a number in that unit exceeds the number in the field's own unit.
POWER_KW_UNITS = {"kW": 1.0, "metric hp": HP_PER_KW, "bhp": HP_PER_KW / BHP_TO_HP, "W": 1000.0, "MW": 0.001}
POWER_HP_UNITS = {"metric hp": 1.0, "kW": 1 / HP_PER_KW, "bhp": 1 / BHP_TO_HP, "W": 1000 / HP_PER_KW}
PRICE_SCALES = {"plain": 1.0, "cents": 100.0, "thousands": 0.001, "hundreds": 0.01, "tenths": 10.0}
TEXT_CHANNEL = "text"


def snap(log_ratio: Column, known: dict[str, float], tolerance: float) -> Column:
    """Natural logarithm of the known factor nearest to ``log_ratio`` within ``tolerance`` (in log units), else NULL; NULL stays NULL."""
    near = [F.struct(F.abs(log_ratio - F.lit(math.log(f))).alias("d"), F.lit(math.log(f)).alias("v")) for f in known.values()]
    best = F.least(*near)
    return F.when(log_ratio.isNotNull() & (best.d <= tolerance), best.v)


def _snapped(d: Column, known: dict[str, tuple[dict[str, float], float]]) -> Column:
    """``d`` at the known conversion of its field near to it, else as it is."""
    by_field = F.coalesce(*[F.when(F.col("field") == f, snap(d, units, tolerance)) for f, (units, tolerance) in known.items()])
    return F.coalesce(by_field, d)


def channel_scales(observations: DataFrame, known: dict, anchor: str = TEXT_CHANNEL, tolerance: float = 0.02, min_links: int = 3, most_edges: int = 1_000_000) -> DataFrame:
    """(entity, channel, value) -> (channel, log_scale, offset, n_links, spread): how each channel's numbers relate to the anchor's unit: exp(log_scale) * value + offset.

    Each entity's channels are paired with one hub channel of that entity (the
    anchor where it is present), so an entity of n channels makes n - 1 pairs,
    never n squared. Pairs are reduced to medians; scales that are near a known
    conversion are snapped to it, others are kept as measured; an offset counts
    where both quartiles of what the scale leaves are on its side of zero. The
    graph is walked outward from the anchor over any number of hops; spread is the
    widest range between quartiles of the log ratio on the way. Channels without a
    path to the anchor, or with fewer than ``min_links`` shared entities, are left
    out. Values that are NULL or not positive and NULL entities are ignored.

    Observations of several fields carry a column field, which then comes first in
    the result, and ``known`` is field -> (conversions, tolerance). Edges, of which
    there are at most as many as linked pairs of channels, are walked on the driver
    up to ``most_edges`` and by Spark beyond, with the same result.
    """
    several = "field" in observations.columns
    rules = known if several else {"": (known, tolerance)}
    good = (observations if several else observations.withColumn("field", F.lit(""))).where("entity IS NOT NULL AND channel IS NOT NULL AND value > 0")
    per = good.groupBy("field", "entity", "channel").agg(F.percentile_approx("value", 0.5, 1000).alias("value"))
    hub = per.groupBy("field", "entity").agg(F.min(F.struct((F.col("channel") != anchor).alias("later"), F.col("channel"), F.col("value"))).alias("h"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hub = hub.select("field", "entity", F.col("h.channel").alias("a"), F.col("h.value").alias("va"))
    pairs = per.join(hub, ["field", "entity"]).where("channel <> a").select("field", "a", F.col("channel").alias("b"), "va", F.col("value").alias("vb"), F.ln(F.try_divide(F.col("value"), F.col("va"))).alias("d"))
    pairs = cut(pairs)
    scale = pairs.groupBy("field", "a", "b").agg(F.percentile_approx("d", [0.25, 0.5, 0.75], 1000).alias("q"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_links)
    scale = scale.select("field", "a", "b", _snapped(F.col("q")[1], rules).alias("d"), (F.col("q")[2] - F.col("q")[0]).alias("spread"), "n")
    offset = pairs.drop("d").join(scale, ["field", "a", "b"]).groupBy("field", "a", "b", "d", "spread", "n").agg(F.percentile_approx(F.col("vb") - F.exp("d") * F.col("va"), [0.25, 0.5, 0.75], 1000).alias("q"))
    offset = offset.withColumn("offset", F.when((F.col("q")[0] > 0) | (F.col("q")[2] < 0), F.col("q")[1]).otherwise(0.0))
    edges = cut(offset.select("field", "a", "b", "d", "offset", "spread", "n").union(offset.select("field", "b", "a", -F.col("d"), -F.col("offset") * F.exp(-F.col("d")), "spread", "n")))
    rows = edges.limit(most_edges + 1).collect()
    reached = _walk(edges.sparkSession, rows, rules, anchor) if len(rows) <= most_edges else _walk_far(edges, rules, anchor)
    out = reached.where(F.col("channel") != anchor)
    return out if several else out.drop("field")


_REACHED = "field string, channel string, log_scale double, offset double, n_links long, spread double"


def _walk(spark: SparkSession, edges: list[Row], fields: dict, anchor: str) -> DataFrame:
    out: dict[str, list] = {}
    for e in edges:
        out.setdefault((e["field"], e["a"]), []).append(e)
    done = {(f, anchor): (0.0, 0.0, 0, 0.0) for f in fields}
    edge_of_known = list(done)
    while edge_of_known:
        best: dict = {}
        for f, a in edge_of_known:
            s, before, _, widest = done[f, a]
            for e in out.get((f, a), ()):
                if (f, e["b"]) not in done:
                    step = (e["n"], a, s + e["d"], math.exp(e["d"]) * before + e["offset"], max(e["spread"], widest))
                    best[f, e["b"]] = max(step, best.get((f, e["b"]), step))
        done |= {k: (s, offset, n, spread) for k, (n, _, s, offset, spread) in best.items()}
        edge_of_known = list(best)
    return spark.createDataFrame([(f, c, *x) for (f, c), x in done.items()], _REACHED)


def _walk_far(edges: DataFrame, fields: dict, anchor: str) -> DataFrame:
    """``_walk`` as Spark jobs, one for each hop, until no channel is new."""
    known = edges.sparkSession.createDataFrame([(f, anchor, 0.0, 0.0, 0, 0.0) for f in fields], _REACHED)
    newest = known
    while True:
        step = edges.join(newest.select("field", F.col("channel").alias("a"), "log_scale", F.col("offset").alias("before"), F.col("spread").alias("widest")), ["field", "a"])
        step = step.join(known.select("field", F.col("channel").alias("b")), ["field", "b"], "left_anti")
        found = step.groupBy("field", "b").agg(F.max(F.struct("n", "a", (F.col("log_scale") + F.col("d")).alias("s"), (F.exp("d") * F.col("before") + F.col("offset")).alias("offset"), F.greatest("spread", "widest").alias("spread"))).alias("m"))
        newest = cut(found.select("field", F.col("b").alias("channel"), F.col("m.s").alias("log_scale"), F.col("m.offset"), F.col("m.n").alias("n_links"), F.col("m.spread")))
        if newest.isEmpty():
            return known
        known = cut(known.union(newest))


def currency_factors(rates: DataFrame, most: int = 400) -> dict[str, float]:
    """Factors by which a field is off that holds another currency than it says, one of both being the euro.

    The rates are a dimension of a few rows; more than ``most`` is an error, not a cut.
    """
    rows = rates.where("currency IS NOT NULL AND currency <> 'EUR' AND eur_per_unit > 0").groupBy("currency").agg(F.max("eur_per_unit").alias("rate")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} exchange rates")
    return {f"{r[0]} as EUR": 1 / r[1] for r in rows} | {f"EUR as {r[0]}": r[1] for r in rows}


def _medians(rows: DataFrame, keys: list[str], least: int = 1, **values: str) -> DataFrame:
    """Median of each of ``values`` (new name = column) by ``keys``, where at least ``least`` rows state it; rows without a key have none."""
    known = rows
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    both = [x for out, c in values.items() for x in (F.percentile_approx(c, 0.5, 1000).alias(out), F.count(c).alias(f"n_{out}"))]
    return known.groupBy(*keys).agg(*both).select(*keys, *[F.when(F.col(f"n_{out}") >= least, F.col(out)).alias(out) for out in values])


def _unit_rows(raw: DataFrame, rates: DataFrame) -> DataFrame:
    columns = ["raw_id", "title", "url", "vin", "year", "mileage_km", "displacement_cc", "power_kw", "power_hp", "price", "currency"]
    facts = with_facts(raw.select(*columns, "description", "raw_text"), F.col("description"), F.col("raw_text")).drop("description", "raw_text")
    km = F.coalesce("fact_km", F.col("mileage_km").cast("double"), "fact_rough_km")
    rows = facts.select(
        "raw_id",
        advert_key(F.col("url")).alias("advert"),
        F.split(advert_key(F.col("url")), "#")[0].alias("channel"),
        model_slug(F.col("url")).alias("model"),
        F.coalesce(litres(F.col("title")), F.round(F.col("displacement_cc") / 100).cast("int")).alias("size"),
        F.coalesce("year", "fact_year").alias("year"),
        F.floor(km / 1000).alias("tkm"),
        F.col("power_kw").cast("double"), F.col("power_hp").cast("double"), F.col("price"), F.coalesce(currency_code(F.col("currency")), F.lit("EUR")).alias("code"),
        "fact_kw", "fact_amount", "fact_currency",
    )
    rate = rates.where("currency IS NOT NULL").groupBy("currency").agg(F.max("eur_per_unit").alias("rate"))
    rows = rows.join(rate.withColumnRenamed("currency", "code"), "code", "left").join(rate.select(F.col("currency").alias("fact_currency"), F.col("rate").alias("fact_rate")), "fact_currency", "left")
    entity = F.when(F.col("model").isNotNull() & F.col("size").isNotNull() & F.col("year").isNotNull() & F.col("tkm").isNotNull(), F.concat_ws("|", "model", "size", "year", "tkm"))
    return rows.withColumns({"entity": entity, "fact_hp": F.col("fact_kw") * HP_PER_KW, "field_eur": F.col("price") * F.col("rate"), "fact_eur": F.col("fact_amount") * F.col("fact_rate")})


#: Tolerances in logarithms: of a number against its own row's text, of one against the texts of its car, of scales, and the widest spread of a usable channel.
OWN, SCALE = 0.02, {"power_kw": 0.02, "power_hp": 0.02, "price": 0.08}
NEAR, WIDEST = {"power_kw": 0.1, "power_hp": 0.1, "price": 0.55}, {"power_kw": 0.25, "power_hp": 0.25, "price": 0.6}
#: Units closer to each other than NEAR are told apart within this of their factor only, and where a fifth of the site's own texts show them.
CLOSE = 0.03


def _unit_of(d: Column, units: dict[str, float], tolerance: float) -> Column:
    """Name of the unit whose factor is nearest to exp(``d``), within ``tolerance``; NULL beyond."""
    near = [F.struct(F.abs(d - math.log(f)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("name")) for i, (name, f) in enumerate(units.items())]
    best = F.least(*near) if len(near) > 1 else near[0]
    return F.when(d.isNotNull() & (best["d"] <= tolerance), best["name"])


def converted(raw: DataFrame, rates: DataFrame) -> DataFrame:
    """Every row of ``raw`` once with kW, metric hp and euro, and how far each number field was off.

    Columns raw_id, power_kw, power_hp, price_eur and, for each field that holds
    a number, its ``_factor`` (1.0 when the number is what the field says). A number
    whose row, advert or car has a text with its unit belongs to the channel (site,
    field, unit) that its ratio to the text names, any other to the site's channel
    without texts; the factor is the scale that the graph of channels gives to
    that channel. Numbers beside no known unit of their row's text keep the
    measured ratio. In channels without texts the median of the same model and
    engine (power) or year and engine (price) overrules a scale that it contradicts
    by more than it scatters; a channel's offset is taken off first. Where the graph
    doesn't reach such a channel, it is expected in the unit of three quarters of its
    site's other numbers, else believed. Unknown stays NULL. Unknown currencies give a
    NULL euro price. Repeated ids are treated row by row; NULL or empty texts state
    nothing.
    """
    rows = cut(_unit_rows(raw, rates))
    by_car = _medians(rows, ["entity"], car_kw="fact_kw", car_eur="fact_eur")
    by_advert = _medians(rows, ["advert"], ad_kw="fact_kw", ad_eur="fact_eur")
    by_engine = _medians(rows, ["model", "size"], 3, engine_kw="fact_kw")
    by_age = _medians(rows, ["size", "year"], 5, age_eur="fact_eur")
    rows = rows.join(by_car, "entity", "left").join(by_advert, "advert", "left").join(by_engine, ["model", "size"], "left").join(by_age, ["size", "year"], "left")

    units = {"power_kw": POWER_KW_UNITS, "power_hp": POWER_HP_UNITS, "price": PRICE_SCALES | currency_factors(rates)}
    shared_kw, shared_eur = F.coalesce("ad_kw", "car_kw"), F.coalesce("ad_eur", "car_eur")
    fields = {  # field -> number, what the row's text states, what its advert or car states, its kind's median, rounding
        "power_kw": (F.col("power_kw"), F.col("fact_kw"), shared_kw, F.col("engine_kw"), 1.0),
        "power_hp": (F.col("power_hp"), F.col("fact_hp"), shared_kw * HP_PER_KW, F.col("engine_kw") * HP_PER_KW, 0.5 + HP_PER_KW / 2),
        "price": (F.col("field_eur"), F.col("fact_eur"), shared_eur, F.col("age_eur"), 0.0),
    }
    parts = []
    for f, (value, own, shared, kind, rounding) in fields.items():
        plain = next(iter(units[f]))
        far = {u: x for u, x in units[f].items() if u == plain or abs(math.log(x)) > NEAR[f] * 1.6}
        close = {u: x for u, x in units[f].items() if u == plain or (u not in far and abs(math.log(x)) > 2 * CLOSE)}
        by_own, by_shared = F.ln(F.try_divide(value, own)), F.ln(F.try_divide(value, shared))
        told = F.when(F.abs(value - own) <= rounding, F.lit(plain)).otherwise(F.coalesce(_unit_of(by_own, units[f], OWN), F.when(own.isNotNull(), F.lit("other"))))
        parts.append(
            F.struct(
                F.lit(f).alias("field"), value.cast("double").alias("value"), own.cast("double").alias("own"), shared.cast("double").alias("shared"), kind.cast("double").alias("kind"), told.alias("told"),
                F.coalesce(_unit_of(by_shared, far, NEAR[f]), F.lit("?")).alias("seen"), F.nullif(_unit_of(by_shared, close, CLOSE), F.lit(plain)).alias("close"),
            )
        )
    kept = rows.select("raw_id", "entity", "advert", "channel", *[p.alias(f"f_{i}") for i, p in enumerate(parts)], "fact_kw", "car_kw", "ad_kw", "engine_kw", "fact_eur")
    kept = cut(kept.withColumn("row", F.monotonically_increasing_id()))
    numbers = cut(kept.select("row", "raw_id", "entity", "advert", "channel", F.explode(F.array(*[f"f_{i}" for i in range(3)])).alias("x")).select("row", "raw_id", "entity", "advert", "channel", "x.*").where("value > 0"))
    # a close unit counts for a shared text only where a fifth of the site's numbers beside a text of their own are in it
    told = numbers.where("told IS NOT NULL").groupBy("channel", "field", F.col("told").alias("close")).agg(F.count(F.lit(1)).alias("n"))
    every = told.groupBy("channel", "field").agg(F.sum("n").alias("every"))
    shown = told.join(every, ["channel", "field"]).where("n >= 3 AND n * 5 >= every").select("channel", "field", "close", F.lit(True).alias("shown"))
    numbers = numbers.join(shown, ["channel", "field", "close"], "left")
    unit = F.coalesce("told", F.when(F.col("shown"), F.col("close")), F.when(F.col("shared").isNotNull(), F.col("seen")), F.lit("?"))
    numbers = cut(numbers.withColumn("unit", unit).withColumn("node", F.concat_ws("|", "channel", "unit")).drop("shown"))
    scales = channel_scales(_observations(numbers), {f: (units[f], SCALE[f]) for f in fields}, min_links=1)
    loose = F.substring_index("channel", "|", -1) == "?"
    widest = F.element_at(F.create_map(*[F.lit(x) for kv in WIDEST.items() for x in kv]), F.col("field"))
    # a channel that no text reaches, and units closer together than rounding, need many links
    near_one = (F.abs("log_scale") < 0.02) & loose & (F.col("n_links") < 20)
    usable = (F.col("spread") <= widest) & (~loose | (F.col("n_links") >= 3))
    named = F.coalesce(*[F.when((F.col("field") == f) & (F.substring_index("channel", "|", -1) == u), math.log(x)) for f in fields for u, x in units[f].items()])
    # a named channel of one or two numbers can't tell another scale than its name's
    far_off = F.coalesce(*[F.when(F.col("field") == f, snap(F.col("log_scale"), {u: x for u, x in units[f].items() if x == 1.0 or abs(math.log(x)) > NEAR[f] * 1.6 or f != "price"}, OWN)) for f in fields], F.lit(0.0))
    scale = F.when(near_one, 0.0).when(loose, far_off).when((F.col("n_links") < 3) & named.isNotNull(), named).otherwise(F.col("log_scale"))
    scales = cut(scales.where(usable).select("field", F.col("channel").alias("node"), scale.alias("scale"), "offset"))
    # numbers that nothing else reaches are expected in the unit that most of their site's other numbers have
    counts = numbers.where("unit NOT IN ('?', 'other')").groupBy("field", "channel", "unit").agg(F.count(F.lit(1)).alias("n"))
    most = counts.groupBy("field", "channel").agg(F.max(F.struct("n", "unit")).alias("m"), F.sum("n").alias("n")).where("m.n >= 3 AND m.n * 4 >= n * 3")
    usual = most.select("field", "channel", F.concat_ws("|", "channel", "m.unit").alias("node"), F.col("m.n").alias("n")).join(scales.drop("offset"), ["field", "node"])
    usual = usual.select("field", "channel", F.when((F.abs("scale") < 0.02) & (F.col("n") < 20), 0.0).otherwise(F.col("scale")).alias("usual"))
    numbers = numbers.join(scales, ["field", "node"], "left").join(usual, ["field", "channel"], "left").withColumn("scale", F.coalesce("scale", F.when(F.col("unit") == "?", F.col("usual"))))
    level = F.col("value") - F.coalesce("offset", F.lit(0.0))
    by_kind = F.ln(F.try_divide(F.when(level > 0, level), F.col("kind")))
    expected = F.coalesce("scale", F.lit(0.0))
    overruled = F.coalesce(*[F.when((F.col("field") == f) & (F.abs(by_kind - expected) > NEAR[f]), snap(by_kind, {u: x for u, x in units[f].items() if x == 1.0 or abs(math.log(x)) > NEAR[f] * 1.6}, NEAR[f])) for f in fields])
    log_factor = F.when(F.col("unit") == "other", F.ln(F.try_divide(F.col("value"), F.col("own")))).when(F.col("unit") == "?", F.coalesce(overruled, expected)).otherwise(expected)
    factors = numbers.groupBy("row").agg(*[F.max(F.when(F.col("field") == f, F.exp(log_factor))).alias(f"{f}_factor") for f in fields])
    out = kept.select("row", "raw_id", *[F.col(f"f_{i}.value").alias(f"v_{i}") for i in range(3)], F.coalesce("fact_kw", "ad_kw", "car_kw", "engine_kw").alias("kw_ref"), "fact_eur").join(factors, "row", "left")
    std_kw = F.coalesce(F.try_divide(F.col("v_0"), F.col("power_kw_factor")), F.col("kw_ref"), F.try_divide(F.col("v_1"), F.col("power_hp_factor")) / HP_PER_KW)
    return out.select(
        "raw_id",
        F.round(std_kw, 1).alias("power_kw"),
        F.round(F.coalesce(F.try_divide(F.col("v_1"), F.col("power_hp_factor")), std_kw * HP_PER_KW), 1).alias("power_hp"),
        F.round(F.coalesce(F.try_divide(F.col("v_2"), F.col("price_factor")), F.col("fact_eur")), 2).alias("price_eur"),
        *(F.round(f"{f}_factor", 4).alias(f"{f}_factor") for f in fields),
    )


def _observations(numbers: DataFrame) -> DataFrame:
    """(field, entity, channel, value): each number by its channel, and what the texts state as the anchor's, for its row (own text) or its advert and its car (shared texts, and numbers that no text reaches)."""
    own = numbers.where("told IS NOT NULL AND unit <> 'other'")
    rest = numbers.where("told IS NULL")
    parts = [own.select("field", F.concat(F.lit("row "), F.col("row").cast("string")).alias("entity"), F.lit(TEXT_CHANNEL).alias("channel"), F.col("own").alias("value"))]
    parts.append(own.select("field", F.concat(F.lit("row "), F.col("row").cast("string")), "node", "value"))
    for key in ("entity", "advert"):
        parts += [rest.select("field", key, "node", "value"), rest.select("field", key, F.lit(TEXT_CHANNEL), "shared"), own.select("field", key, "node", "value"), own.select("field", key, F.lit(TEXT_CHANNEL), "own")]
    return reduce(DataFrame.union, parts)


def wrong_units(conversions: DataFrame) -> DataFrame:
    """(raw_id, field): the numbers whose unit isn't their field's, however close; each unit has its own factor."""
    fields = ("power_kw", "power_hp", "price")
    off = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_factor").alias("factor")) for f in fields))).alias("c")
    return conversions.select("raw_id", off).where(F.col("c.factor") != 1.0).select("raw_id", "c.field").distinct()
