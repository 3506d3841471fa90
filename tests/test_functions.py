import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lotwise.functions import facts, text, urls


def col(spark, values, expression, kind="string"):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(expression).collect()]


def test_normalize_url(spark):
    given_ = ["http://www.A.example/x/?b=2&a=1&utm_source=m#top", "https://a.example", "a.example/p/", None, "", "https://a.example/?q="]
    assert col(spark, given_, urls.normalize(F.col("x"))) == ["http://a.example/x?a=1&b=2", "https://a.example/", "https://a.example/p", None, "", "https://a.example/"]


def test_normalize_url_is_idempotent(spark):
    rows = ["https://www.x.example/a//?z=1&y=2&ref=h", "HTTP://X.example:80/q;jsession=1?b=&c=3"]
    once = col(spark, rows, urls.normalize(F.col("x")))
    assert col(spark, once, urls.normalize(F.col("x"))) == once


@pytest.mark.parametrize(
    ("url", "kind"),
    [
        (None, "UNKNOWN"), ("https://a.example/", "HOMEPAGE"), ("https://a.example/suche?q=x", "SEARCH_PAGE"), ("https://a.example/stock", "SEARCH_PAGE"), ("https://a.example/fahrzeuge/", "SEARCH_PAGE"),
        ("https://a.example/inserat/12", "EXACT_DETAIL"), ("https://a.example/x/1234567", "EXACT_DETAIL"), ("https://a.example/x/red-car", "LIKELY_DETAIL"), ("https://a.example/about", "UNKNOWN"),
    ],
)
def test_url_quality(spark, url, kind):
    assert col(spark, [url], urls.quality(F.col("x"))) == [kind]


def test_numbers(spark):
    assert col(spark, ["4.750", "4,750", "1.234,56", "1,234.56", "12,5", "abc", None, ""], text.to_number(F.col("x"))) == [4750.0, 4750.0, 1234.56, 1234.56, 12.5, None, None, None]


def test_bands_round_half_to_even(spark):
    assert col(spark, [4950.0, 118000.0, None], text.band(F.col("x"), 300), "double") == [16, 393, None]


def test_mileage_power_year(spark):
    assert col(spark, ["85.000 km", "nothing", None, "100 tkm"], text.parse_mileage(F.col("x"))) == [85000, None, None, 100000]
    assert [tuple(p) for p in col(spark, ["80 kW", "109 PS"], text.parse_power(F.col("x")))] == [(80, 109), (80, 109)]
    assert col(spark, ["EZ 2004, inserted 2025", "1950"], text.parse_year(F.col("x"), 2025)) == [2004, None]


def test_hamming(spark):
    df = spark.createDataFrame([("ffffffffffffffff", "0"), ("f", "e"), (None, "1"), ("zz", "1")], "a string, b string")
    assert [r[0] for r in df.select(text.hamming(F.col("a"), F.col("b"))).collect()] == [64, 1, 999, 999]


def test_facts_of_a_text():
    kw, km, rough, amount, currency, year, place = facts.read_facts("Leistung 55kW / 75PS; Preis 10.900,- eur; erst 151 tkm auf der Uhr; EZ 04/2004; Standort Dunrigrad. Ich würde nicht mehr als 7000 Euro für so eins geben.")
    assert (kw, km, rough, amount, currency, year, place) == (55.0, 151000.0, None, 10900.0, "EUR", 2004, "dunrigrad")


def test_facts_units_and_nothing():
    assert facts.read_facts("power 74 bhp")[0] == pytest.approx(55.2, abs=0.1)
    assert facts.read_facts("odometer reads 1,000 mi. asking 6.8 tys. £")[1:5] == (pytest.approx(1609.3, abs=0.1), None, 6800.0, "GBP")
    assert facts.read_facts(None) == facts.read_facts("") == (None,) * 7


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=200))
def test_facts_never_fail(t):
    facts.read_facts(t)
    facts.read_facts(None, t)
