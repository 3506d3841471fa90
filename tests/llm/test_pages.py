import pytest
from pyspark.sql import functions as F
from test_text_operators import page_tables

from lotwise.llm import pages


def labels(df):
    return sorted((r["record_type"], r["record_id"], tuple(r["furniture"]), r["reason"]) for r in df.collect())


@pytest.fixture(scope="module")
def read(spark):
    fetched, raws = page_tables(spark)
    slots = [(200 + i, "a.example", f"Car s{i}", f"Car s{i}\n{p}\nThe car number1 runs quietly.", 0) for i, p in enumerate([f"asking {7000 + 311 * i} EUR" for i in range(8)] + ["asking EUR"])]
    raws = raws.union(spark.createDataFrame(slots, raws.schema))
    return pages.read_pages(pages.page_records(fetched, raws)).cache()


def test_joined_tables_give_the_same_labels(read):
    evidence = pages.token_evidence(read).cache()
    sent = labels(pages.label(read.where("kind <> ''"), evidence))
    assert sent == labels(pages.label(read.where("kind <> ''"), evidence, most_sent=0))
    reasons = {(k, i): r for k, i, _, r in sent}
    assert reasons["raw", 208] == pages.BLANK and reasons["raw", 200] is None and reasons["raw", 102] is not None


def test_classes_decide(read):
    evidence = pages.token_evidence(read).cache()
    with_classes = labels(pages.label(read.where("kind <> ''"), evidence))
    blind = evidence.withColumns({f"c{i}": F.lit(0).cast("long") for i in range(len(pages.CELLS))})
    without = labels(pages.label(read.where("kind <> ''"), blind))
    assert sum(len(x[2]) for x in without) < sum(len(x[2]) for x in with_classes) and {x[:2] for x in without if x[3]} != {x[:2] for x in with_classes if x[3]}


def test_fingerprints_of_a_huge_host(spark):
    empty = {c: F.array().cast(t) for c, t in (("place", "array<byte>"), ("flag", "array<byte>"), ("slot", "array<long>"), ("fill", "array<byte>"), ("slot_at", "array<int>"), ("near", "array<long>"))}
    page = spark.range(400_000).select(
        F.lit("raw").alias("kind"), "id", F.lit("hot.example").alias("host"), "id", F.lit(None).cast("long").alias("url"), F.lit(1).cast("byte").alias("heading"), F.lit(2).cast("byte").alias("layout"),
        F.array(F.lit(0)).alias("no"), *[v.alias(k) for k, v in empty.items() if k != "place"], F.array(F.lit(1).cast("byte")).alias("place"), F.array(F.lit(7).cast("long"), F.lit(8).cast("long")).alias("tok"), F.array(F.lit(0), F.lit(0)).alias("at"), F.lit(None).cast("array<string>").alias("texts"),
    )
    names = [x.split(" ")[0] for x in pages._PAGES.split(", ")]
    page = page.toDF(*[c if i != 3 else "again" for i, c in enumerate(page.columns)]).select(*names)
    a, b = pages.token_evidence(page).orderBy("token").collect()
    # the mean hash is 2^63 in size: a sum of two would not fit into 64 bits
    assert a["n"] == b["n"] == 400_000 and (a["f1"], a["f2"]) == (b["f1"], b["f2"]) and a["f1"] != 0 and a["f1"] != a["f2"]
    assert pages.equivalence_classes(pages.token_evidence(page)).first()["size"] == 2


def test_templates_nest_by_containment(spark):
    fetched, raws = page_tables(spark)
    rows = pages.host_templates(fetched, raws).collect()
    by = {(r["host"], r["class_id"]): r for r in rows}
    assert any(r["role"] == "furniture" for r in rows) and any(r["role"] == "content" for r in rows)
    for r in rows:
        if r["parent"]:
            assert by[r["host"], r["parent"]]["n_pages"] >= r["n_pages"]


def test_long_lines_keep_their_shape():
    line = "Tarn white, 105.000 km, " + "very " * 40 + "cheap, 6 000 EUR"
    assert pages.tokens_of(line) == pages.tokens_of(line.replace("105.000", "99.000").replace("Tarn white", "Cigo black"))
    assert pages.slot_of("asking 9,440 GBP")[0] == pages.slot_of("asking GBP")[0] and pages.slot_of("It costs 5 EUR.") is None
