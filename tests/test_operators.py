import pytest
from pyspark.sql import functions as F

from lotwise.operators import dedup, history, hits, units

RAW = "raw_id long, title string, url string, vin string, year int, mileage_km int, displacement_cc int, power_kw int, power_hp int, price double, currency string, description string, raw_text string, code string"


def raw(spark, rows):
    base = dict.fromkeys(("title", "url", "vin", "year", "mileage_km", "displacement_cc", "power_kw", "power_hp", "price", "currency", "description", "raw_text"))
    return spark.createDataFrame([tuple((base | {"raw_id": i} | r).get(c.split()[0]) for c in RAW.split(", ")) for i, r in enumerate(rows)], RAW)


def rates(spark):
    return spark.createDataFrame([("EUR", 1.0), ("GBP", 1.16), ("SEK", 0.0885)], "currency string, eur_per_unit double")


def test_units_from_texts(spark):
    df = raw(
        spark,
        [
            {"power_kw": 75, "description": "Leistung 55 kW (75 PS)."},  # horsepower in the kW field
            {"power_kw": 96000, "description": "96 kW engine"},  # watts
            {"power_hp": 66, "description": "puissance 66 kW (90 ch)"},  # kilowatts in the hp field
            {"price": 12.4, "currency": "EUR", "description": "Festpreis: 12400,- €."},  # thousands
            {"price": 8110.0, "currency": None, "description": "8,110 £ VB."},  # NULL means euro
            {"price": 5000.0, "currency": "£", "power_kw": 55, "power_hp": 75, "description": "price 5,000 GBP. 55 kW"},  # all right
            {"price": None, "description": None},
            {"price": 0.0, "power_kw": 0, "description": ""},
        ],
    )
    out = units.converted(df, rates(spark))
    assert out.count() == 8
    found = {tuple(r) for r in units.wrong_units(out).collect()}
    assert found == {(0, "power_kw"), (1, "power_kw"), (2, "power_hp"), (3, "price"), (4, "price")}
    by_id = {r["raw_id"]: r for r in out.collect()}
    assert by_id[0]["power_kw"] == 55.2 and by_id[1]["power_kw"] == 96.0 and by_id[2]["power_hp"] == pytest.approx(89.7, abs=0.1)
    assert by_id[3]["price_eur"] == 12400.0 and by_id[4]["price_eur"] == pytest.approx(9407.6)
    assert by_id[6]["power_kw"] is None and by_id[6]["price_eur"] is None


def test_units_empty(spark):
    assert units.wrong_units(units.converted(raw(spark, []), rates(spark))).count() == 0


def test_units_of_a_whole_site(spark):
    rows = [{"url": f"https://kw.example/auto/mk-m{i}/20-{1000000 + i}.html", "power_hp": 60 + i, "description": f"Leistung {60 + i} kW."} for i in range(6)]
    rows += [{"url": f"https://kw.example/auto/mk-x{i}/20-{2000000 + i}.html", "power_hp": 91 + i, "description": None} for i in range(3)]
    rows += [{"url": "https://ok.example/auto/mk-x9/20-3000000.html", "power_hp": 91, "description": None}]
    rows += [{"power_hp": 200, "description": "power 200 bhp"}, {"power_hp": 203, "description": "power 200 bhp"}]  # British horsepower in a field of metric ones
    out = units.converted(raw(spark, rows), rates(spark))
    assert {tuple(r) for r in units.wrong_units(out).collect()} == {(i, "power_hp") for i in (*range(9), 10)}
    assert {r["raw_id"]: r["power_hp"] for r in out.collect()}[6] == pytest.approx(91 * 1.35962, abs=0.1)


def test_channel_offsets_add_up(spark):
    rows = []
    for e in range(9):
        v = 100.0 + 10 * e
        rows += [(f"a{e}", "text", v), (f"a{e}", "site1", v * 1000 + 7000), (f"b{e}", "site1", v * 1000 + 7000), (f"b{e}", "site2", v)]
    out = {r["channel"]: r for r in units.channel_scales(spark.createDataFrame(rows, "entity string, channel string, value double"), units.POWER_KW_UNITS, tolerance=0.06).collect()}
    assert out["site1"]["offset"] == pytest.approx(7000) and out["site2"]["offset"] == pytest.approx(0.0, abs=1e-6)


def test_channel_scales_walk_the_graph(spark):
    rows = []
    for e in range(6):
        rows += [(f"a{e}", "text", 100.0 + e), (f"a{e}", "site1", (100.0 + e) * 1000), (f"b{e}", "site1", 5000.0 + e), (f"b{e}", "site2", (5000.0 + e) / 1000 * 1.35962)]
    rows += [(None, "site1", 1.0), ("z", "site9", None), ("y", "site8", -1.0)]
    out = {r["channel"]: r for r in units.channel_scales(spark.createDataFrame(rows, "entity string, channel string, value double"), units.POWER_KW_UNITS).collect()}
    assert set(out) == {"site1", "site2"}
    assert out["site1"]["log_scale"] == pytest.approx(6.9078, abs=1e-3) and out["site2"]["log_scale"] == pytest.approx(0.3072, abs=0.01)


def test_duplicate_clusters_are_transitive(spark):
    rows = [
        (1, "v1", "https://a.example/1", None, None, None), (2, "V1 ", "https://b.example/2?utm_source=x", None, None, None), (3, None, "https://www.b.example/2", "+49 171 1234567", 4950.0, 10000),
        (4, None, "", "0171 1234567", 4900.0, 10100), (5, None, None, None, None, None), (6, None, None, "12", None, None), (7, None, None, "12", None, None),
    ]
    df = spark.createDataFrame(rows, "listing_id long, vin_public string, listing_url string, seller_phone_public string, price_eur double, mileage_km int")
    assert {r["listing_id"]: r["cluster"] for r in dedup.duplicate_clusters(df).collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 6, 7: 6}


def test_near_hashes_equal_brute_force(spark):
    import random

    r = random.Random(3)
    base = [r.getrandbits(64) for _ in range(30)]
    values = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + [b ^ ((1 << 9) - 1) for b in base]
    df = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(values)], "id long, h string")
    got = {(x["a"], x["b"]) for x in dedup.near_hashes(df, "id", "h").collect()}
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if 0 < bin(values[i] ^ values[j]).count("1") <= 8}
    assert got == want


def obs(spark):
    rows = [(1, 1, "2025-01-01", 100.0, "A"), (1, 2, "2025-01-03", None, None), (1, 3, "2025-01-02", 100.5, "A"), (1, 4, "2025-01-04", 90.0, "B"), (2, 5, "2025-01-01", None, None)]
    return spark.createDataFrame(rows, "k long, id long, at string, v double, s string")


def test_history(spark):
    o = obs(spark)
    assert [(r["id"], r["delta"]) for r in history.value_changes(o, "k", "at", "id", "v").collect()] == [(4, -10.5)]
    assert {r["id"]: r["v"] for r in history.carry_forward(o, "k", "at", "id", ["v"]).collect()} == {1: 100.0, 3: 100.5, 2: 100.5, 4: 90.0, 5: None}
    assert sorted((r["id"], r["old_state"], r["new_state"]) for r in history.transitions(o, "k", "at", "id", "s").collect()) == [(1, None, "A"), (4, "A", "B")]
    runs = history.run_lengths(o, "k", "at", "id", F.col("v").isNull())
    assert {r["id"]: r["failures"] for r in runs.collect()} == {1: 0, 3: 0, 2: 1, 4: 0, 5: 1}


def test_hits(spark):
    rows = [(1, "u", "b", 1, "t1", "d", "q"), (2, "u", "a", 9, "t2", "d", "q"), (3, None, "a", None, None, None, "q"), (4, "w", "a", 2, "t", "e", None)]
    df = spark.createDataFrame(rows, "hit_id long, normalized_url string, provider string, rank int, title string, domain string, query string")
    assert {r["normalized_url"]: (r["providers"], r["hit_id"]) for r in hits.merge_providers(df).collect()} == {"u": ("a+b", 2), None: ("a", 3), "w": ("a", 4)}
    assert {r["provider"]: (r["domains"], r["only_here"]) for r in hits.provider_overlap(df).collect()} == {"a": (2, 1), "b": (1, 0)}
    assert hits.capped(df, 1).count() == 2


def test_core_needs_no_training_text_package():
    import subprocess
    import sys

    code = "import sys; sys.modules['lotwise.llm'] = None; import __spark_entry__ as e; assert 'p7_found' in e.queries() and 'p1_found' not in e.queries()"
    assert subprocess.run([sys.executable, "-c", code], cwd=str(__import__("pathlib").Path(__file__).resolve().parents[1])).returncode == 0


def test_near_hashes_with_members_equal_brute_force(spark):
    numbers = [0x0F0F] * 7 + [0x0F0E, 0x0F0E, 0xFFFF_FFFF_FFFF_0F0F, 0x0FFF] + [(0x9E3779B97F4A7C15 * k) % 2**63 for k in range(1, 10)]
    rows = spark.createDataFrame([(i, f"{v:016x}") for i, v in enumerate(numbers)], "id long, hash string")
    members = {}
    for r in dedup.hash_members(rows, "id", "hash").collect():
        members.setdefault(r["representative"], []).append(r["id"])
    assert sorted(x for m in members.values() for x in m) == list(range(len(numbers)))
    got = {(a, b, 0) for m in members.values() for a in m for b in m if a < b}
    for r in dedup.near_hashes(rows, "id", "hash").collect():
        got |= {(min(a, b), max(a, b), r["distance"]) for a in members[r["a"]] for b in members[r["b"]]}
    want = {(a, b, (x ^ y).bit_count()) for a, x in enumerate(numbers) for b, y in enumerate(numbers) if a < b and (x ^ y).bit_count() <= 8}
    assert got == want


def test_units_come_through_the_graph(spark, monkeypatch):
    df = raw(spark, [{"url": "https://s.example/auto/mk-m/20-1000001.html", "power_kw": 75, "description": "Leistung 55 kW (75 PS)."}])
    assert units.wrong_units(units.converted(df, rates(spark))).count() == 1
    scales = units.channel_scales
    monkeypatch.setattr(units, "channel_scales", lambda *a, **k: scales(*a, **k).where("false"))
    assert units.wrong_units(units.converted(df, rates(spark))).count() == 0


def test_channels_are_reached_over_many_hops(spark):
    rows = [(f"e0 {k}", c, v) for k in range(3) for c, v in (("text", 100.0 + k), ("s0", 100.0 + k))]
    for i in range(11):
        rows += [(f"e{i + 1} {k}", f"s{j}", (100.0 + k) * f) for k in range(3) for j, f in ((i, 1.0), (i + 1, 1000.0 if i == 10 else 1.0))]
    df = spark.createDataFrame(rows, "entity string, channel string, value double")
    near, far = units.channel_scales(df, units.POWER_KW_UNITS), units.channel_scales(df, units.POWER_KW_UNITS, most_edges=1)
    got = {r["channel"]: r["log_scale"] for r in near.collect()}
    assert len(got) == 12 and got["s11"] == pytest.approx(6.9078, abs=1e-3) and got["s10"] == pytest.approx(0.0, abs=1e-9)
    assert sorted(map(tuple, near.collect())) == sorted(map(tuple, far.collect()))


def test_near_currency_of_a_car_without_a_price_of_its_own(spark):
    car = lambda site, i, **k: {"url": f"https://{site}.example/auto/mk-m{chr(97 + i)}/20-{1000000 + 7 * i + len(site)}.html", "title": f"M {1 + i % 5},4", "year": 2010, "mileage_km": 50000 + 2100 * i, "currency": "EUR"} | k
    rows = []
    for i in range(6):
        rows += [car("gb", i, price=5000.0 + 100 * i, description=f"asking {5000 + 100 * i} GBP"), car("de", i, price=float(round((5000 + 100 * i) * 1.16)), description=f"Preis {round((5000 + 100 * i) * 1.16)} EUR")]
    rows += [car("de", 9, price=5800.0, description="Preis 5800 EUR"), car("gb", 9, price=5000.0), car("fr", 9, price=5000.0)]
    found = {tuple(r) for r in units.wrong_units(units.converted(raw(spark, rows), rates(spark))).collect()}
    # the British site is known for it, the French one isn't
    assert found == {(i, "price") for i in (0, 2, 4, 6, 8, 10, 13)}


def test_clusters_that_do_not_settle_are_an_error(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r["cluster"] for r in dedup.clusters(chain).collect()} == {0}
    with pytest.raises(RuntimeError):
        dedup.clusters(chain, most_rounds=2)


def test_smoothed_equals_a_fold(spark):
    import random

    r = random.Random(1)
    rows = [(k, i, r.choice([None, r.random() * 10])) for k in range(7) for i in range(r.randrange(30))] + [(None, 1, 5.0), (99, 1, None)]
    df = spark.createDataFrame(rows, "k long, i long, v double").withColumn("extra", F.lit(1))
    want = {}
    for k, i, v in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        if v is not None:
            a, n = want.get(k, (0.0, 0))
            want[k] = (round(round(a * 0.7 + v * (1 - 0.7), 6), 3), n + 1)
    got = {x["k"]: (x["average"], x["n"]) for x in history.smoothed(df, "k", "i", "i", "v").collect()}
    assert got.keys() == want.keys() and all(got[k] == (pytest.approx(want[k][0], abs=2e-3), want[k][1]) for k in want)
    assert history.smoothed(df.limit(0), "k", "i", "i", "v").count() == 0


def test_diverse_images(spark):
    rows = [(["a", "b", "c"], ["0" * 16, "0" * 15 + "7", "f" * 16]), (list("abcdefghijk"), None), (["a", "", None, "b"], ["00"]), (None, None), (list("abcdefg"), [f"{(0xFFFF << 8 * i) & (2**64 - 1):016x}" for i in range(7)])]
    df = spark.createDataFrame(rows, "u array<string>, h array<string>")
    got = [x[0] for x in df.select(dedup.diverse(F.col("u"), F.col("h"))).collect()]
    assert got == [["a", "c"], ["a", "c", "e", "g", "i"], ["a", "b"], [], ["a", "b", "c", "d", "e"]]
