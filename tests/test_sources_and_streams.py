from pyspark.sql import types as T

from lotwise.operators.candidates import candidates, read_candidates
from lotwise.sources import feeds
from lotwise.streaming import observations

CARDS = """<html><body><ul>
<li><a href="/angebot/10001">Red car</a><p>4.750 &euro;, 120.000 km</p><img data-src="/i/1.jpg"></li>
<li><a href="/angebot/10002" title="Blue car"><img src="b.png"></a><p>5.000 &euro;</p></li>
<li><a href="/angebot/10001#photos">again</a></li><li><a href="/suche?q=x">next</a></li></ul></body></html>"""
DETAIL = """<html><head><link rel="canonical" href="/angebot/777777"><script type="application/ld+json">{"@graph":[{"@type":"Car","name":"Green car","offers":[{"price":"9500","priceCurrency":"EUR"}]}]}</script></head><body><h1>other</h1></body></html>"""


def test_cards_and_detail_pages():
    kind, found = read_candidates(CARDS, "https://d.example/suche?q=car")
    assert kind == "SEARCH_RESULTS" and [c["url"] for c in found] == ["https://d.example/angebot/10001", "https://d.example/angebot/10002"]
    assert found[0]["title"] == "Red car" and "4.750 €" in found[0]["text"] and "5.000" not in found[0]["text"] and found[1]["title"] == "Blue car" and found[0]["image"] == "https://d.example/i/1.jpg"
    kind, found = read_candidates(DETAIL, "https://d.example/x?utm_source=1")
    assert kind == "INDIVIDUAL_LISTING" and found[0]["title"] == "Green car" and found[0]["price"] == "9500" and found[0]["url"] == "https://d.example/angebot/777777"
    assert read_candidates("<html></html>", "https://d.example/") == ("HOMEPAGE", []) and read_candidates("<p>no results", "https://d.example/suche?q=y") == ("SEARCH_RESULTS", [])


def test_candidate_rows(spark):
    df = spark.createDataFrame([(1, "https://d.example/suche?q=car", CARDS), (2, None, "<a href='"), (3, "u", None), (4, "u", "")], "page_id long, url string, text string")
    rows = candidates(df).collect()
    assert sorted((r["page_id"], r["candidate_no"]) for r in rows if r["page_id"] == 1) == [(1, 0), (1, 1)] and {r["page_id"] for r in rows} == {1, 2}


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>l</link></item><item><title>B</title></item></channel></rss>")
    (tmp_path / "s.xml").write_text("<urlset><url><loc>https://a.example/auto/1</loc></url><url><loc>https://a.example/auto/1</loc></url><url><loc>https://a.example/x</loc></url></urlset>")
    assert sorted(r["title"] for r in feeds.feed_items(spark, str(tmp_path / "f.xml")).collect()) == ["A", "B"]
    assert feeds.sitemap_urls(spark, str(tmp_path / "s.xml"), "auto").count() == 1 and feeds.sitemap_urls(spark, str(tmp_path / "s.xml"), "none").count() == 2


def test_insert_and_evolve(spark):
    t = spark.createDataFrame([("a", 1)], "domain string, n int")
    n = spark.createDataFrame([("a", "x"), ("b", "y"), ("b", "z")], "domain string, kind string")
    once = feeds.insert_absent(t, n, "domain")
    assert once.count() == 2 and feeds.insert_absent(once, n, "domain").count() == 2
    out = feeds.evolved(t, T.StructType([T.StructField("n", T.IntegerType()), T.StructField("flag", T.BooleanType())]), {"flag": True})
    assert out.columns == ["domain", "n", "flag"] and out.first()["flag"] is True


def test_stream_equals_batch(spark, tmp_path):
    rows = [(1, "2025-01-01 00:00:00", 100.0), (1, "2025-01-02 00:00:00", 100.5), (1, "2025-01-03 00:00:00", 90.0), (2, "2025-01-01 00:00:00", None), (2, "2025-01-02 00:00:00", 5.0), (1, "2025-01-03 00:00:00", 90.0)]
    df = spark.createDataFrame(rows, "k long, at string, v double").selectExpr("k", "CAST(at AS timestamp) AS at", "v")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))

    def ran(s, name):
        q = s.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.table(name)

    assert [(r["old_value"], r["new_value"]) for r in ran(observations.value_changes(stream, "k", "at", "v"), "changes").collect()] == [(100.5, 90.0)]
    assert ran(observations.without_repeats(stream, "at", ["k", "at"]), "once").count() == 5
    assert ran(observations.counts_by_window(stream, "at", "k", late="0 seconds"), "windows").count() >= 2
