import re
from datetime import datetime as D
from urllib.parse import parse_qsl, urlencode, urljoin, urlsplit

import pytest
from pyspark.sql import functions as F

from lotwise.functions import reference_values as V
from lotwise.functions import text as X
from lotwise.functions import urls as U
from lotwise.operators import crawl, discovery, ledger, readside
from lotwise.operators.candidates import candidates, read_candidates, tree
from lotwise.sources import feeds
from lotwise.streaming import states

URLS = [
    None, "", " ", "https://a.example", "https://a.example/", "https://a.example/?x=1", "https://a.example/suche?q=x", "https://a.example/autos", "https://a.example/autos/", "https://a.example/x#q:y", "a.example/auto/", "https://a.example/auto/5",
    "https://a.example/p/12345", "https://a.example/one/two-three", "https://a.example/one/averylongsegment", "https://a.example/one/short", "https://a.example/a1/b/c", "https://a.example/listing/x?k=", "http://A.example/Fahrzeuge/",
]


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[1] for r in sorted(df.select("i", f(F.col("x"))).collect())]


def test_kinds_of_pages_agree_in_both_forms(spark):
    assert column(spark, URLS, U.quality) == [U.kind_of(u) for u in URLS]
    assert {U.kind_of(u) for u in URLS} == {"UNKNOWN", "HOMEPAGE", "SEARCH_PAGE", "EXACT_DETAIL", "LIKELY_DETAIL"}


def test_resolve_equals_the_standard(spark):
    bases = ["https://a.example/x/y.html?q=1#f", "https://a.example", "https://a.example/x/"]
    hrefs = ["/z", "z", "../z", "./z?k=1", "?k=1", "#top", "//b.example/z", "mailto:x@y", "https://c.example/", "", "../../../z", "..", "a/../b/./c"]
    df = spark.createDataFrame([(b, h) for b in bases for h in hrefs], "b string, h string")
    for r in df.select("b", "h", U.resolve(F.col("b"), F.col("h")).alias("u")).collect():
        assert r["u"].rstrip("/") == urljoin(r["b"], r["h"]).rstrip("/"), (r["b"], r["h"])


def test_normalized_queries_are_encoded_as_forms(spark):
    urls = ["https://a.example/x?b=2&a=%C3%A4+%26&utm_source=q&c=", "https://a.example/x?z=~*&a=1%2B1", "https://a.example/x?q=a%20b", "https://a.example/x?q=100%"]
    for u, got in zip(urls, column(spark, urls, U.normalize), strict=True):
        pairs = sorted((k, v) for k, v in parse_qsl(urlsplit(u).query) if not re.match(U.TRACKING, k))
        assert got == "https://a.example/x?" + urlencode(pairs)


def test_prices(spark):
    texts = ["VB 4.750 €, 120.000 km", "CHF 5'900", "12 500 zł, 90 kW", "Preis 8900", "Euro 3.999,- statt 4.500 €", "99 €", "", None, "km 120000", "110000 km 66 kw"]
    got = [(p["amount"], p["currency"]) for p in column(spark, texts, X.parse_price)]
    assert got == [(4750.0, "EUR"), (None, "CHF"), (12500.0, "PLN"), (8900.0, None), (4500.0, "EUR"), (None, "EUR"), (None, None), (None, None), (120000.0, None), (None, None)]


def test_text_keeps_the_order_of_the_document():
    assert tree("<p>Price <b>5000</b> EUR, <i>120 000</i> km</p>").text() == "Price 5000 EUR, 120 000 km"


def test_long_cards_are_kept_whole():
    words = " ".join(f"word{i}" for i in range(2000))
    _, found = read_candidates(f'<ul><li><a href="/angebot/10001">{words}</a></li><li><a href="/angebot/10002">b</a></li></ul>', "https://d.example/suche?q=x")
    assert found[0]["title"] == words and found[0]["text"] == words


def test_candidates_of_odd_pages(spark):
    page = '<script type="application/ld+json">{"@type":["Car"],"name":"A","url":"/angebot/12345","offers":[[],{"price":{"value":7}}],"image":"x.jpg"}</script><script type="application/ld+json">{broken</script>'
    rows = [(1, "https://d.example/", page), (2, "https://d.example/", "<a href='https://[bad'>x</a>"), (3, None, "x")]
    got = {r["page_id"]: r for r in candidates(spark.createDataFrame(rows, "page_id long, url string, text string").withColumn("title", F.lit("clash"))).collect()}
    assert got[1]["url"] == "https://d.example/angebot/12345" and got[1]["price"] == 7.0 and got[1]["images"] == ["https://d.example/x.jpg"] and got[2]["error"] and set(got) == {1, 2, 3}


def test_atom_feeds_and_sitemap_indexes(spark, tmp_path):
    (tmp_path / "a.xml").write_text('<feed><entry><title>Car 66 kW</title><link rel="self" href="s"/><link href="https://a.example/auto/1"/><summary>4.750 EUR &lt;b&gt;120.000 km&lt;/b&gt;</summary><id>1</id></entry></feed>')
    items = feeds.feed_items(spark, str(tmp_path / "a.xml"))
    row = feeds.feed_candidates(items).first()
    assert (row["url"], row["price"], row["mileage_km"], row["power_kw"]) == ("https://a.example/auto/1", 4750.0, 120000, 66)
    (tmp_path / "i.xml").write_text("<sitemapindex>" + "".join(f"<sitemap><loc>https://a.example/{i}.xml</loc></sitemap>" for i in range(12)) + "</sitemapindex>")
    assert [r["loc"] for r in feeds.sitemap_children(spark, str(tmp_path / "i.xml")).orderBy("place").collect()] == [f"https://a.example/{i}.xml" for i in range(10)]
    robots = spark.createDataFrame([("a.example", "User-agent: *"), ("a.example", "sitemap: https://a.example/s.xml"), ("b.example", "")], "domain string, line string")
    assert {r["loc"] for r in feeds.robots_sitemaps(robots).collect()} == {"https://a.example/s.xml", "https://a.example/sitemap.xml", "https://b.example/sitemap.xml"}


def test_merging_twice_changes_nothing(spark):
    empty = spark.createDataFrame([], "internal_id string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, listing_status string, consecutive_misses int, price_original double, currency string, price_eur double, km int")
    obs = [("a", 1, D(2025, 1, 1), 100.0, "EUR", 100.0, None), ("a", 2, D(2025, 1, 3), None, None, None, 5), ("b", 3, D(2025, 1, 2), 50.0, None, 50.0, 7), (None, 4, D(2025, 1, 2), 1.0, None, 1.0, 1), ("b", 3, D(2025, 1, 2), 50.0, None, 50.0, 7)]
    o = spark.createDataFrame(obs, "internal_id string, seq long, seen_at timestamp_ntz, price_original double, currency string, price_eur double, km int")
    once = ledger.merged_state(empty, o, ["km"])
    twice = ledger.merged_state(once, o, ["km"])
    assert sorted(once.collect()) == sorted(twice.collect()) and {(r["internal_id"], r["price_original"], r["km"]) for r in once.collect()} == {("a", 100.0, 5), ("b", 50.0, 7)}
    late = spark.createDataFrame([("a", 9, D(2024, 12, 1), 80.0, "EUR", 80.0, 1)], o.schema)
    r = {x["internal_id"]: x for x in ledger.merged_state(once, late, ["km"]).collect()}["a"]
    assert r["price_original"] == 100.0 and r["km"] == 5 and r["first_seen_at"] == D(2024, 12, 1)
    stale = {x["internal_id"]: (x["listing_status"], x["consecutive_misses"]) for x in ledger.gone_stale(once, F.lit(D(2025, 1, 3, 12)).cast("timestamp_ntz")).collect()}
    assert stale == {"a": ("ACTIVE", 0), "b": ("MAYBE_ACTIVE", 1)}
    assert ledger.status_rows(empty, once, F.lit(D(2025, 1, 3)).cast("timestamp_ntz")).count() == 2


def test_currency_drift_is_no_change(spark):
    rows = [("a", 1, D(2025, 1, 1), 100.0, "GBP", 116.0), ("a", 2, D(2025, 1, 2), 100.0, "GBP", 120.0), ("a", 3, D(2025, 1, 3), 100.0, "EUR", 100.0), ("a", 4, D(2025, 1, 4), 100.5, "EUR", 100.5), ("a", 5, D(2025, 1, 5), None, "EUR", None), ("a", 6, D(2025, 1, 6), 90.0, "EUR", 90.0)]
    o = spark.createDataFrame(rows, "internal_id string, seq long, seen_at timestamp_ntz, price_original double, currency string, price_eur double")
    assert [(r["seq"], r["delta"]) for r in ledger.original_price_changes(o).orderBy("seq").collect()] == [(3, -20.0), (6, -10.5)]


def test_generated_queries(spark):
    words = {"subject": ["Brankel Wald"], "short": ["Wald"], "power": ["55 kW"], "code": ["BW1"], "word": ["stock"], "file": ["pdf"], "without": ["-x"]}
    q = discovery.generated(V.countries(spark), words, seed=3)
    rows = q.collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, discovery.generated(V.countries(spark), words, seed=3).collect()))
    assert len({(r["query"].lower(), r["country"]) for r in rows}) == len(rows) and not any("{" in r["query"] for r in rows)
    per = q.where("experimental").groupBy("country", "family").count().collect()
    assert all(r["count"] >= 1 and r["family"] in discovery.EXPLORING for r in per) and len(per) >= 28 * 3
    assert discovery.generated(V.countries(spark), {}, "A").count() == 0


def test_filters_treat_nothing_as_no_wish(spark):
    rows = [(1, None, "ACTIVE", None, 0, None, "DE", 100.0, 5, 2010, "dealer", None), (2, "HOMEPAGE", "ACTIVE", "M", 90, 1, "DE", 1.0, 1, 2010, "dealer", None), (3, "UNKNOWN", None, "M", 90, 1, "DE", 1.0, 1, 2010, "dealer", None), (4, "UNKNOWN", "SOLD", "M", 50, 1, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "listing_id long, listing_url_quality string, listing_status string, class string, confidence int, score int, country string, price_eur double, mileage_km int, production_year int, seller_type string, first_seen_at timestamp_ntz")
    ids = lambda **k: [r["listing_id"] for r in readside.filtered(df, **k).collect()]
    assert ids(max_price=0, country="", min_year=None) == [1] and ids(max_confidence=0) == [1] and ids(status="SOLD") == [4] and ids(status="SOLD", max_price=10) == [] and ids(rejected="M", status="SOLD") == []


def test_own_sites(spark):
    rows = [("https://www.dealer.example/x", None, None, ""), (None, "shop.example", "dealer", ""), (None, "mobile.de", "dealer", "see https://facebook.com/x and http://www.own.example/car"), (None, None, None, None)]
    df = spark.createDataFrame(rows, "w string, d string, t string, x string")
    assert [r[0] for r in df.select(crawl.own_site(F.col("w"), F.col("d"), F.col("t"), F.col("x"))).collect()] == ["dealer.example", "shop.example", "own.example", None]


def ran(spark, out, name, mode="append"):
    q = out.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_states_of_listings_in_a_stream(spark, tmp_path):
    schema = "internal_id string, seen_at timestamp, price_eur double"
    parts = [[("a", D(2025, 1, 1), 100.0), ("b", D(2025, 1, 1), None)], [("c", D(2025, 1, 6), 1.0)], [("a", D(2025, 1, 6, 1), 90.0), ("c", D(2025, 1, 12), 1.0)]]
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = ran(spark, states.listing_states(stream, late="1 hour"), "listing_states").collect()
    b = [(r["status"], r["misses"]) for r in got if r["internal_id"] == "b"]
    assert b[0] == ("ACTIVE", 0) and ("MAYBE_ACTIVE", 1) in b and b[-1] == ("EXPIRED", 3) and len(b) == 3
    assert {r["price"] for r in got if r["internal_id"] == "a"} >= {100.0, 90.0}


def test_states_of_sources_and_queries(spark, tmp_path):
    spark.createDataFrame([("s", D(2025, 1, i + 1), n, bad) for i, (n, bad) in enumerate([(10, False), (10, False), (0, True), (0, True)])], "source string, scanned_at timestamp, n_found int, failed boolean").coalesce(1).write.parquet(str(tmp_path / "s"))
    out = ran(spark, states.source_states(spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s"))), "source_states").collect()
    assert [(r["typical"], r["failures"], r["health"]) for r in out] == [(5, 2, "failed")]
    spark.createDataFrame([("q", D(2025, 1, i + 1), n) for i, n in enumerate([4, 0, 1])], "query string, run_at timestamp, new_domains int").coalesce(1).write.parquet(str(tmp_path / "q"))
    out = ran(spark, states.query_states(spark.readStream.schema(spark.read.parquet(str(tmp_path / "q")).schema).parquet(str(tmp_path / "q"))), "query_states").collect()
    assert [(r["runs"], r["found"], r["effectiveness"]) for r in out] == [(3, 5, pytest.approx(0.888))]
