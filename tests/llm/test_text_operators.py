import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotwise.llm import abuse, characters, language, leaks, mixing, pages, products, survivors
from lotwise.llm.recurrent import WindowClassifier


# P1
def test_canonical_forms(spark):
    same = ["Audi Ａ４ 1.8", "Аudi A4 1.8", "Au​di A4 1.8", " Audi  A4 1.8 "]
    rows = [(i, t, "x") for i, t in enumerate([*same, "audi a4 1.8", "Ａudi A4 1.9", "cafe", "café", "café", "m²", "m2", None, "", "​", "ﬁn…", "fin..."])]
    df = spark.createDataFrame(rows, "id long, text string, canon string")
    got = [r["canon"] for r in characters.with_canonical(df, "text", "canon").orderBy("id").collect()]
    assert got[:4] == ["Audi A4 1.8"] * 4 and got[4] == "audi a4 1.8" and got[6] == "cafe" and got[7] == got[8] == "café" and got[9] != got[10]
    assert got[11] is None and got[12] == got[13] == "" and got[14] == got[15] == "fin..."


def test_lookalike_pairs_equal_brute_force(spark):
    texts = ["Tarn 1.8", "Tаrn 1.8", "Tarn 1.8", "Tarn 1.8", "other", None, "", "⁠"]
    df = spark.createDataFrame([("f", i, t) for i, t in enumerate(texts)] + [("g", 0, "Tаrn 1.8")], "field string, id long, text string")
    got = {tuple(r) for r in characters.lookalike_pairs(df).collect()}
    assert got == {("f", 0, 1), ("f", 1, 2), ("f", 0, 3), ("f", 1, 3), ("f", 2, 3)}
    assert characters.lookalike_pairs(df.limit(0)).count() == 0


# P2
def test_survivors(spark):
    listing = "listing_id long, canonical_listing_url string, listing_url string, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, dealer_domain string, is_dealer string"
    from datetime import datetime as D

    rows = [
        (1, "https://agg.example/inserat/12345", "https://a.example/inserat/11111", D(1901, 1, 1), D(2025, 3, 1), None, "x"),
        (2, "https://www.dealer.example/auto/22222", "https://a.example/suche?q=1", D(2025, 2, 2), D(2025, 2, 3), "dealer.example", "x"),
        (3, "https://o.example/item/33333", "https://a.example/inserat/33333", D(2025, 2, 1), D(2025, 1, 1), "", None),
        (4, "", None, D(2025, 2, 2), None, None, None),
        (5, None, None, None, None, None, None),
        (9, "https://o.example/item/99999", None, D(2025, 2, 2), D(2025, 3, 2), None, None),
    ]
    groups = spark.createDataFrame([(1, 7), (2, 7), (3, 7), (4, 7), (5, 8), (9, 8), (1, 7), (None, 7)], "listing_id long, dup_group_id long")
    sources = spark.createDataFrame([("agg.example", True), ("o.example", False)], "domain string, is_aggregator boolean")
    out = survivors.survivors(spark.createDataFrame(rows, listing), groups, sources)
    got = {(r["dup_group_id"], r["field"]): r["listing_id"] for r in survivors.surviving_rows(out).collect()}
    assert got == {(7, "canonical_listing_url"): 2, (7, "listing_url"): 1, (7, "first_seen_at"): 2, (8, "canonical_listing_url"): 9, (8, "first_seen_at"): 9}
    assert survivors.survivors(spark.createDataFrame([], listing), groups, sources).count() == 0


# P3 and P4
def page_tables(spark):
    raws, fetched = [], []
    nav, foot = "Start / Contact / Help", "Imprint\n© 2020 a.example"
    for i in range(12):
        body = f"Car number{i} for sale\nmanual\nbuilt 20{i:02d}\nThe car number{i} runs quietly and pulls cleanly on every trip."
        raws.append((i, "a.example", f"Car number{i} for sale", f"{nav}\n\n{body}\n{foot}" if i % 3 else body))
        html = f"<html>\n<nav>\n<a>Start</a>\n<a>Help</a>\n</nav>\n<article>\n<h1>Car number{i}</h1>\n<p>manual</p>\n<p>The car number{i} runs quietly and pulls cleanly on every trip.</p>\n</article>\n<footer>\n<p>Imprint</p>\n<p>© 2020 a.example</p>\n</footer>\n</html>"
        fetched.append((i, "a.example", html))
    raws += [
        (100, "a.example", "Car x", f"{nav}\nThe page could not be found.\n{foot}"), (101, "a.example", "Car y", f"{nav}\nThe page could not be found.\n{foot}"), (102, "a.example", "Car z", "Car z\nprice {{ price }} EUR\nmanual"),
        (103, "a.example", "Car w", "undefined undefined\nNaN km | undefined"), (104, None, None, ""), (105, "a.example", "Car v", None), (106, "a.example", "Car u", "Car u\n%% Wald %%\nmanual\nThe car number1 runs quietly and pulls cleanly on every trip."),
        (107, "a.example", "Car t", "Test test test test."), (108, "b.example", "Long", "Long\n" + "The car number1 runs quietly. " * 4000),
    ]
    r = spark.createDataFrame([(*x, 0) for x in raws], "raw_id long, source_domain string, title string, raw_text string, host int")
    return spark.createDataFrame(fetched, "fetch_id long, source_domain string, text string"), r


def test_pages(spark):
    fetched, raws = page_tables(spark)
    out = pages.labelled_pages(fetched, raws).cache()
    residue = {tuple(r) for r in pages.residue_records(out).collect()}
    assert residue == {("raw", 100), ("raw", 101), ("raw", 102), ("raw", 103), ("raw", 107)}
    lines = {}
    for r in pages.furniture_lines(out).collect():
        lines.setdefault((r["record_type"], r["record_id"]), set()).add(r["line_no"])
    assert lines["raw", 1] == {0, 6, 7} and ("raw", 0) not in lines and lines["fetch", 3] == {2, 3, 11, 12} and ("raw", 106) not in lines
    assert pages.labelled_pages(fetched.limit(0), raws.limit(0)).count() == 0


def test_placeholders_and_ornaments():
    yes = ["{{ price }}", "x ${TITLE} y", "<%= vehicle.make %>", "[[modell]]", "%%CITY%%", "__item.mileage__", "{km}", "{% year %}", "@@km@@", "#{power}"]
    no = ["[[ Umbro 2018 ]]", "%% Wald %%", "*** Falter ***", "{ 2018 }", "__ 2018 __", "[Alufelgen] [Klimaanlage]", "### Kos ###", "$$ Tarn $$", "100 %"]
    assert all(pages.has_placeholder(x) for x in yes) and not any(pages.has_placeholder(x) for x in no)


def test_slots_left_by_the_template(spark):
    body = "The car runs quietly and pulls cleanly on every trip."
    price = {i: f"Preis: {7000 + 311 * i} EUR" for i in range(8)} | {20: "Preis:", 21: "Preis: EUR", 22: "Preis: 0 EUR", 23: "Preis: ((preis))", 24: "Preis: auf Anfrage", 25: "{{vehicleTitle}}"}
    rows = [(i, "a.example", f"Car n{i}", f"Car n{i}\n{p}\nVorbesitzer: {i % 3}\nExtras:\nradio\n{body}") for i, p in price.items()]
    rows += [(40, "new.example", "Car o", f"Car o\nPreis:\n{body}")]
    raws = spark.createDataFrame(rows, "raw_id long, source_domain string, title string, raw_text string")
    none = spark.createDataFrame([], "fetch_id long, source_domain string, text string")
    got = {r["record_id"]: r["reason"] for r in pages.labelled_pages(none, raws).where("residue").collect()}
    assert got == {20: "blank slot", 21: "blank slot", 22: "default in slot", 23: "name in slot", 25: "placeholder", 40: "blank slot"}


# P5
def test_same_items(spark):
    schema = "raw_id long, title string, url string, year int, mileage_km int, displacement_cc int, price double, currency string, vin string, description string, raw_text string, eur string"
    rows = []
    for i in range(30):
        km = 40000 + 3517 * i
        base = f"https://s{{}}.example/auto/make{chr(97 + i % 5)}-model/20-{{}}.html"
        rows.append((3 * i, "M 1.8", base.format(1, 1000000 + i), 2010, km, None, 9000.0 + i, "EUR", None, f"Standort Town{chr(97 + i % 26)}{chr(97 + i // 26)}. EZ 2010.", None, "x"))
        rows.append((3 * i + 1, "M 1,8", base.format(2, 2000000 + i), None, None, None, 9100.0 + i, "EUR", None, f"located in Town{chr(97 + i % 26)}{chr(97 + i // 26)}. mileage {km} km. built 2010.", None, None))
        rows.append((3 * i + 2, "M 1.8", base.format(1, 1000000 + i) + "?ref=x", 2010, km, None, 9000.0 + i, "EUR", None, None, None, None))
    rows += [(900, None, None, None, None, None, None, None, None, None, None, None), (901, "", "", None, 0, 0, 0.0, "", "", "", "", "")]
    rates = spark.createDataFrame([("EUR", 1.0)], "currency string, eur_per_unit double")
    groups = {r["raw_id"]: r["item_id"] for r in products.same_item_groups(spark.createDataFrame(rows, schema), rates).collect()}
    assert len(groups) == 92 and all(groups[3 * i] == groups[3 * i + 1] == groups[3 * i + 2] == 3 * i for i in range(30)) and groups[900] == 900
    assert products.same_item_groups(spark.createDataFrame([], schema), rates).count() == 0


def test_weights_separate_matches():
    good = {"km": "exact", "place": "same", "year": "same", "price": "near", "vin": "unknown", "site": "other"}
    bad = {"km": "other", "place": "other", "year": "other", "price": "far", "vin": "unknown", "site": "other"}
    w, _ = products.fit_weights([good | {"n": 300}, bad | {"n": 900}, good | {"place": "unknown", "n": 50}])
    assert w["km"]["exact"] > 0 > w["km"]["other"] and w["place"]["unknown"] == 0


# P6
SENTENCES = {
    "de": ["Der Wagen braucht bald einen neuen Auspuff.", "Das Auto steht in einer trockenen Halle.", "Wir haben die Bremsen und die Kupplung erneuert."],
    "en": ["The car will soon need a new exhaust.", "This one was kept in a dry barn for years.", "We replaced the brakes and the clutch last winter."],
    "fr": ["La voiture aura bientôt besoin d'un échappement.", "Elle est restée longtemps dans un hangar sec.", "Nous avons remplacé les freins et l'embrayage."],
}


def test_languages(spark):
    docs = [(t + " " + u, x) for x, ss in SENTENCES.items() for t in ss for u in ss]
    c = language.learned(spark.createDataFrame([*docs, (None, "de"), ("", None)], "text string, lang string"))
    texts = spark.createDataFrame([("k", 1, SENTENCES["de"][0] + " " + SENTENCES["fr"][1]), ("k", 2, SENTENCES["en"][2]), ("k", 3, "12 345"), ("k", 4, ""), ("k", 5, None), ("k", 6, SENTENCES["de"][1] * 3000)], "kind string, id long, text string")
    got = {r["id"]: r["langs"] for r in language.segment_languages(texts, c).collect()}
    assert got == {1: ["de", "fr"], 2: ["en"], 3: [], 4: [], 6: ["de"]}
    assert language.segment_languages(texts, language.Classifier({})).where("size(langs) > 0").count() == 0


def test_segments_of_snippets_and_descriptions(spark):
    docs = [(t + " " + u, x) for x, ss in SENTENCES.items() for t in ss for u in ss]
    c = language.learned(spark.createDataFrame(docs, "text string, lang string"))
    hits = spark.createDataFrame([(1, SENTENCES["en"][2]), (2, None)], "hit_id long, snippet string")
    listings = spark.createDataFrame([(1, SENTENCES["de"][0] + " " + SENTENCES["fr"][1]), (3, None)], "raw_id long, description string")
    got = language.text_segments(hits, listings, c).collect()
    assert {(r["record_type"], r["record_id"], r["segment_no"], r["lang"]) for r in got} == {("hit", 1, 0, "en"), ("raw", 1, 0, "de"), ("raw", 1, 1, "fr")}
    assert all(0 < r["confidence"] <= 1 for r in got)


def test_label_codes(spark):
    df = spark.createDataFrame([(x,) for x in ("de", "DE", "de_AT", "en-GB", "fra", "und", "", None, " NL ")], "x string")
    assert [r[0] for r in df.select(language.label_code(F.col("x"))).collect()] == ["de", "de", "de", "en", "fr", None, None, None, "nl"]


# P8
def brute(docs, items, share=0.4, stretch=8):
    out = set()
    for d, t in docs:
        w = leaks.words_of(t)
        for i, s in items:
            v = leaks.words_of(s)
            hit = set()
            for a in range(len(w) - stretch + 1):
                for b in range(len(v) - stretch + 1):
                    if w[a : a + stretch] == v[b : b + stretch]:
                        hit |= set(range(b, b + stretch))
            if v and len(hit) >= share * len(v):
                out.add((d, i))
    return out


def test_leaks_equal_brute_force(spark):
    r = random.Random(5)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}x{i}" for i in range(60)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.randrange(20, 60)))) for i in range(12)] + [(50, "short item"), (51, ""), (52, None)]
    docs = []
    for d in range(60):
        t = [r.choice(words) for _ in range(40)]
        src = leaks.words_of(items[r.randrange(12)][1])
        for _ in range(r.randrange(3)):
            a = r.randrange(len(src))
            k = r.randrange(len(t))
            t[k:k] = src[a : a + r.randrange(6, 30)]
        docs.append((d, " ".join(t).upper() if d % 3 else ",​ ".join(t)))
    docs += [(90, None), (91, ""), (92, items[3][1]), (93, items[3][1])]
    got = leaks.leaked_items(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most_chars=500)
    clean = [(d, t.replace("​", "") if t else t) for d, t in docs]
    assert {(x["doc_id"], x["item_id"]) for x in got.collect()} == brute(clean, items)


def test_leaks_in_pieces_of_long_documents():
    index = leaks.ItemIndex([1], ["a1 b1 c1 d1 e1 f1 g1 h1 i1 j1 k1 l1 m1 n1 o1 p1 q1 r1 s1 t1"], 0.4, 8)
    ws = ["z"] * 500 + index.words[0][:9] + ["z"] * 500
    assert index.leaks(ws) == index.leaks(ws, piece=100) == [(1, 9)]


# P9
def test_mixture(spark):
    docs = [(i, f"text number {i} " + "word " * (i % 7), "big") for i in range(200)] + [(1000 + i, f"small {i} words here", "small") for i in range(10)] + [(2000, "text number 3 word word word ", "small"), (3000, None, "big"), (3001, "x", None), (3002, "", "big")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("big", 0.6, 1), ("small", 0.4, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    mix = mixing.mixture(df, targets)
    assert mix.groupBy("source").agg(F.max("repeats").alias("m")).where("source = 'small' AND m > 3 OR source = 'big' AND m > 1").count() == 0
    got = {r["source"]: r["actual_share"] for r in mixing.shares(mix, targets).collect()}
    assert got["big"] == pytest.approx(0.6, abs=0.05) and got["small"] == pytest.approx(0.4, abs=0.05)
    assert sorted(mix.collect()) == sorted(mixing.mixture(df, targets).collect())
    assert mixing.mixture(df.limit(0), targets).count() == 0


def test_flow_prefers_first_uses():
    flows = mixing.plan({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": (0.5, 2), "b": (0.5, 4)}, budget=120)
    assert sum(f for (p, s), f in flows.items() if s == "a") == 60 and sum(f for (p, s), f in flows.items() if s == "b") == 60
    assert flows[("a", "b"), "b"] == 50 and flows[("b",), "b"] == 10


# P10
def test_gradients():
    rng = np.random.default_rng(0)
    m = WindowClassifier(["aa", "bb", "cc"], "abc", word_dim=3, char_dim=2, char_hidden=2, hidden=3)
    windows, y, w = [["aa", "bb"], ["cc", "zz", "aa"]], np.array([1.0, 0.0], np.float32), np.array([1.0, 2.0], np.float32)
    _, g = m.loss_and_gradient(windows, y, w)
    for name, p in m.parameters().items():
        for _ in range(4):
            at = tuple(rng.integers(0, n) for n in p.shape)
            if name == "words" and at[0] == 0:
                continue
            old = p[at]
            p[at] = old + 1e-2
            up = m.loss_and_gradient(windows, y, w)[0]
            p[at] = old - 1e-2
            down = m.loss_and_gradient(windows, y, w)[0]
            p[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-2, abs=3e-3), name


def abusive_corpus(n, seed):
    r = random.Random(seed)
    benign = ["the car will soon need a new exhaust", "this one was kept in a dry barn for years", "we replaced the brakes last winter", "it runs quietly and pulls cleanly"]
    insults, ends = ["moron", "idiot", "imbecile", "loser"], ["learn to read", "nobody asked you", "get lost now"]
    texts, labels = [], []
    for i in range(n):
        lines = [r.choice(benign) for _ in range(4)]
        bad = i % 5 == 0
        if bad:
            lines[r.randrange(4)] = f"you {r.choice(insults)} {r.choice(ends)}"
        elif i % 5 == 1:
            lines[r.randrange(4)] = "moderators delete posts with strong words"
        texts.append(". ".join(lines))
        labels.append(int(bad) if i % 37 else 0)
    return texts, labels


def test_abuse_on_held_out_documents():
    texts, labels = abusive_corpus(300, 1)
    common = {w for t in texts for w in t.replace(".", "").split() if sum(w in x for x in texts) > 60}
    model, threshold = abuse.train(texts, labels, common, epochs=12)
    held, truth = abusive_corpus(100, 2)
    best = [max(model.score([list(w) for w in abuse.windows_of(t)])) >= threshold for t in held]
    want = [i % 5 == 0 for i in range(100)]
    assert sum(a == b for a, b in zip(best, want, strict=True)) >= 95


def test_frequent_abuse_is_learned(spark):
    texts, labels = abusive_corpus(300, 1)
    every = {w for t in texts for d in abuse.windows_of(t) for w in d}
    model, threshold = abuse.train(texts, labels, every, epochs=12)
    held, truth = abusive_corpus(100, 2)
    best = [max(model.score([list(w) for w in abuse.windows_of(t)])) >= threshold for t in held]
    assert sum(a == (i % 5 == 0) for i, a in enumerate(best)) >= 95
    copies = spark.createDataFrame([(f"the car number{i} runs",) for i in range(50)] + [("you blockhead",)] * 25, "text string")
    assert "blockhead" not in abuse.common_words(copies) and "car" in abuse.common_words(copies)


def test_spelling_tricks():
    assert abuse.plain_words("d.i.e.v.e.n b@$ur@ Schwwwwachkopf i****t 66kW") == ["dieven", "basura", "schwachkopf", "i****t", "0"]
    assert abuse.windows_of(None) == abuse.windows_of("") == []
    assert len(abuse.windows_of("word " * 50_000)) == 4999


def test_abuse_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, "s", "x"), (2, "", None, "x"), (3, "a car", "s", None), (3, "a car", "s", None)], "doc_id long, text string, source string, score string")
    none = spark.createDataFrame([], "doc_id long, toxic int, labelled_by string")
    out = abuse.abuse_scores(docs, none)
    assert out.count() == 4 and out.where("flagged").count() == 0
    assert {r["source"]: r["n_docs"] for r in abuse.abuse_rates(out).collect()} == {"s": 3, None: 1}
