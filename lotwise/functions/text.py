"""Text and number extraction from free text (FN-S*, FN-N*, FN-D*), as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lotwise.functions.reference_values import ADDRESS_WORDS, CHECK_HOURS, COUNTRIES, DEFAULT_HOURS
from lotwise.functions.urls import domain

# Words that hint at a language.
LANGUAGE_HINTS = {
    "de": (" und ", " der ", " mit ", "gebraucht", "verkauf"), "fr": (" et ", " avec ", " occasion", " vendre", " voiture"), "it": (" e ", " con ", " usata", " vendita", " auto "),
    "es": (" y ", " con ", " venta", " segunda mano", " coche"), "nl": (" en ", " met ", " te koop", " tweedehands"), "pl": (" i ", " sprzedam", " używany", " samochód"),
    "en": (" and ", " with ", " for sale", " used ", " car "),
}
# Currency signs in the order in which they are looked for.
CURRENCY_SIGNS = (
    ("€", "EUR"), ("eur", "EUR"), ("euro", "EUR"), ("chf", "CHF"), ("fr.", "CHF"), ("£", "GBP"), ("gbp", "GBP"), ("zł", "PLN"), ("zl", "PLN"), ("pln", "PLN"), ("kč", "CZK"), ("kc", "CZK"), ("czk", "CZK"),
    ("ft", "HUF"), ("huf", "HUF"), ("lei", "RON"), ("ron", "RON"), ("лв", "BGN"), ("bgn", "BGN"), ("kr", "SEK"), ("sek", "SEK"), ("dkk", "DKK"), ("nok", "NOK"), ("$", "EUR"),
)
# Euros per unit.
EUR_RATES = {"EUR": 1.0, "CHF": 1.05, "GBP": 1.17, "PLN": 0.23, "CZK": 0.040, "HUF": 0.0025, "RON": 0.20, "BGN": 0.51, "DKK": 0.134, "SEK": 0.088, "NOK": 0.086}
# Steering side cues and countries that drive on the left.
RIGHT_CUES = ("rhd", "right hand drive", "right-hand drive", "rechtslenker", "conduite à droite", "guida a destra", "volante a la derecha")
LEFT_CUES = ("lhd", "left hand drive", "left-hand drive", "linkslenker", "conduite à gauche", "guida a sinistra", "volante a la izquierda")
LEFT_DRIVING = ("GB", "IE", "CY", "MT")
# Telephone codes by country, in the order in which they are looked for.
PHONE_CODES = {
    "+49": "DE", "+43": "AT", "+41": "CH", "+33": "FR", "+32": "BE", "+31": "NL", "+352": "LU", "+39": "IT", "+34": "ES", "+351": "PT", "+48": "PL", "+420": "CZ", "+421": "SK", "+36": "HU", "+386": "SI",
    "+385": "HR", "+40": "RO", "+359": "BG", "+30": "GR", "+45": "DK", "+46": "SE", "+47": "NO", "+358": "FI", "+372": "EE", "+371": "LV", "+370": "LT", "+353": "IE", "+44": "GB",
}


def collapse(c: Column) -> Column:
    """FN-S01: white space of any kind as one space, none at the ends; NULL gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)[\s\x{a0}]+", " ")), F.lit(""))


def word_match(c: Column, term: str) -> Column:
    """FN-S02: the term as a whole word; a space in it matches a space, a hyphen or nothing."""
    pattern = "".join(r"[\s-]?" if ch == " " else ch if ch.isalnum() else f"\\{ch}" for ch in term)
    return F.lower(c).rlike(f"(?<![a-z0-9]){pattern}(?![a-z0-9])")


def first_match(c: Column, terms: tuple[str, ...]) -> Column:
    """FN-S03: the first of the terms that matches as a word."""
    return F.coalesce(*[F.when(word_match(c, t), t) for t in terms])


def all_hits(c: Column, terms: tuple[str, ...]) -> Column:
    """FN-S04: the terms contained anywhere, in their own order."""
    return F.array_compact(F.array(*[F.when(F.lower(c).contains(t), t) for t in terms]))


def language_guess(c: Column) -> Column:
    """FN-S05: the language with the most hint occurrences; ties go to the earlier one, none gives NULL."""
    t = F.concat(F.lit(" "), F.lower(c), F.lit(" "))
    scores = []
    for i, (lang, hints) in enumerate(LANGUAGE_HINTS.items()):
        n = sum((F.length(t) - F.length(F.replace(t, F.lit(h)))) / len(h) for h in hints)
        scores.append(F.struct(n.cast("int").alias("n"), F.lit(-i).alias("order"), F.lit(lang).alias("lang")))
    best = F.array_max(F.array(*scores))
    return F.when(best["n"] > 0, best["lang"])


def phone9(c: Column) -> Column:
    """FN-S06: the last nine digits, or all if there are fewer; NULL without digits."""
    d = F.regexp_replace(c, r"\D", "")
    return F.nullif(F.when(F.length(d) >= 9, F.right(d, F.lit(9))).otherwise(d), F.lit(""))


def vin(c: Column) -> Column:
    """FN-S07."""
    return F.nullif(F.upper(F.trim(c)), F.lit(""))


def hamming(a: Column, b: Column) -> Column:
    """FN-S08: differing bits of two 64-bit hashes in hexadecimal; 999 where one isn't a hash."""
    good = lambda c: c.rlike(r"^[0-9a-fA-F]{1,16}$")
    bits = lambda c: F.conv(c, 16, -10).cast("long")
    return F.when(good(a) & good(b), F.bit_count(bits(a).bitwiseXOR(bits(b)))).otherwise(999)


def similar_hashes(a: Column, b: Column, threshold: int = 8) -> Column:
    """FN-S09: whether any two hashes of two arrays differ in at most ``threshold`` bits."""
    return F.coalesce(F.exists(a, lambda x: F.exists(b, lambda y: hamming(x, y) <= threshold)), F.lit(False))


def combined(*parts: Column) -> Column:
    """FN-S11: the non-empty parts, joined by a space."""
    return F.concat_ws(" ", *[F.nullif(p, F.lit("")) for p in parts])


def to_number(c: Column) -> Column:
    """FN-N01: number in European or English notation; of two kinds of separator the rightmost is the decimal mark, a single one only before one or two digits."""
    d = F.regexp_replace(F.regexp_replace(c, r"[^\d.,]", ""), r"^[.,]+|[.,]+$", "")
    comma, dot = d.contains(","), d.contains(".")
    last_comma = F.length(d) - F.locate(",", F.reverse(d))
    last_dot = F.length(d) - F.locate(".", F.reverse(d))
    both = F.when(last_comma > last_dot, F.replace(F.replace(d, F.lit(".")), F.lit(","), F.lit("."))).otherwise(F.replace(d, F.lit(",")))
    one = lambda sep, rx: F.when(d.rlike(rf"^\d+{rx}\d{{1,2}}$"), F.replace(d, F.lit(sep), F.lit("."))).otherwise(F.replace(d, F.lit(sep)))
    return F.when(comma & dot, both).when(comma, one(",", ",")).when(dot, one(".", r"\.")).otherwise(d).try_cast("double")


def detect_currency(c: Column) -> Column:
    """FN-N02: code of the first sign, in their fixed order, that the text contains."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(s), code) for s, code in CURRENCY_SIGNS])


def to_eur(amount: Column, currency: Column) -> Column:
    """FN-N05: euros at the fixed rates, to the cent; NULL currency counts as euro, an unknown one gives NULL."""
    rate = F.try_element_at(F.create_map(*[F.lit(x) for kv in EUR_RATES.items() for x in kv]), F.upper(F.coalesce(currency, F.lit("EUR"))))
    return F.bround((amount.cast("decimal(18,4)") * rate.cast("decimal(10,4)")), 2).cast("double")


# The units of mileage, power and displacement, and the digits they may follow, that FN-N06 .. FN-N09 must read alike.
MILEAGE_PATTERN = r"(\d[\d.,\s]{1,9}\d|\d{2,7})\s*(km|tkm|miles|mi\b|000\s*km)"
KW_PATTERN, HP_PATTERN = r"(\d{2,3})\s*kw", r"(\d{2,3})\s*(?:ps|hp|cv|ch|pk|bhp)\b"
YEAR_PATTERN = r"((?:19|20)\d{2})"
CC_PATTERN, LITRE_PATTERN = r"(\d{3,4})\s*(?:cc|ccm|cm3|cm³)", r"\b(\d[.,]\d)\s*l?\b"


def parse_mileage(c: Column) -> Column:
    """FN-N06: the first number with a distance unit, as kilometres."""
    low = F.replace(F.lower(c), F.lit(" "), F.lit(" "))
    n, unit = to_number(F.regexp_extract(low, MILEAGE_PATTERN, 1)), F.regexp_extract(low, MILEAGE_PATTERN, 2)
    km = n * F.when(unit == "tkm", 1000.0).when(unit.startswith("mi"), 1.60934).otherwise(1.0)
    return F.when(km.between(0, 1_000_000), F.bround(km).cast("int"))


def parse_power(c: Column) -> Column:
    """FN-N07: struct(kw, hp); a missing one is converted from the other."""
    low = F.replace(F.lower(c), F.lit(" "), F.lit(" "))
    kw = F.regexp_extract(low, KW_PATTERN, 1).try_cast("int")
    hp = F.regexp_extract(low, HP_PATTERN, 1).try_cast("int")
    kw2 = F.coalesce(kw, F.bround(hp / 1.35962).cast("int"))
    return F.struct(kw2.alias("kw"), F.coalesce(hp, F.bround(kw * 1.35962).cast("int")).alias("hp"))


def parse_year(c: Column, as_of_year: int) -> Column:
    """FN-N08: the earliest plausible year, 1990 to the year after ``as_of_year``."""
    years = F.transform(F.regexp_extract_all(c, F.lit(YEAR_PATTERN), F.lit(1)), lambda y: y.cast("int"))
    return F.array_min(F.filter(years, lambda y: y.between(1990, as_of_year + 1)))


def parse_displacement(c: Column) -> Column:
    """FN-N09: cubic centimetres from "1490 ccm" or "1.5 l"."""
    low = F.replace(F.lower(c), F.lit(" "), F.lit(" "))
    cc = F.regexp_extract(low, CC_PATTERN, 1).try_cast("int")
    litre = F.regexp_replace(F.regexp_extract(low, LITRE_PATTERN, 1), ",", ".").try_cast("decimal(4,1)")
    return F.coalesce(F.when(cc.between(500, 8000), cc), F.when(litre.between(0.5, 8.0), (litre * 1000).cast("int")))


# Signs and words beside which a number is a price, and units beside which it isn't.
PRICE_SIGNS = r"€|eur\b|euro|chf|£|gbp|zł|zl\b|pln|kč|czk|ft\b|huf|lei|ron|лв|bgn|kr\b|sek|dkk|nok"
OTHER_UNITS = r"km|tkm|miles|mi|kw|ps|hp|cv|ccm|cc"
LEAST_PRICE, MOST_PRICE = 100, 500_000
_SPACED = r"\d[\d.,\s\x{a0}]*"
_AMOUNT = _SPACED + r"\d|\d"


def parse_price(c: Column, default_currency: Column | None = None) -> Column:
    """FN-N03: struct(amount, currency): the largest plausible number beside a currency sign, or where no number stands beside one the largest of three digits or more; numbers with a unit of distance, power or volume don't count. The currency is the first sign's, else the default. NULL and '' give NULLs."""
    t = F.regexp_replace(c, rf"(?i){_SPACED}\s*(?:{OTHER_UNITS})\b", " ")
    read = lambda pattern, group: F.filter(F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(group)), lambda x: to_number(x)), lambda v: v.isNotNull())
    beside = F.concat(read(rf"(?i)(?:{PRICE_SIGNS})\s*({_AMOUNT})", 1), read(rf"(?i)({_AMOUNT})\s*(?:{PRICE_SIGNS})", 1))
    found = F.when(F.size(beside) > 0, beside).otherwise(read(r"(\d[\d.,\s\x{a0}]{2,}\d|\d{3,})", 1))
    amount = F.array_max(F.filter(found, lambda v: v.between(LEAST_PRICE, MOST_PRICE)))
    known = c.isNotNull() & (c != "")
    currency = F.coalesce(detect_currency(c), default_currency if default_currency is not None else F.lit(None).cast("string"))
    return F.struct(F.when(known, amount).alias("amount"), F.when(known, currency).alias("currency"))


def coerce_km(c: Column) -> Column:
    """FN-N10: a mileage with its unit, else all digits of the text as kilometres up to a million."""
    digits = F.regexp_replace(c, r"\D", "").try_cast("long")
    return F.coalesce(parse_mileage(c), F.when(digits <= 1_000_000, digits).cast("int"))


def enriched(df, as_of_year: int):
    """FN-N11: candidates with price, currency, mileage, year, power and displacement filled from their own text where they are NULL; known values stay."""
    t = combined(F.col("title"), F.col("description"), F.col("raw_text"))
    price, power = parse_price(t), parse_power(t)
    read = {"price": price["amount"], "currency": price["currency"], "mileage_km": parse_mileage(t), "year": parse_year(t, as_of_year), "power_kw": power["kw"], "power_hp": power["hp"], "displacement_cc": parse_displacement(t)}
    return df.withColumns({k: F.coalesce(F.col(k), v) for k, v in read.items()})


def country_of(url: Column, text: Column) -> Column:
    """FN-N14: struct(country, confidence) from a telephone code in the text (80), a country's name in it (70), the top-level domain (45), else NULL and 0; within a step the first in the fixed order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    phone = phone_country(F.coalesce(text, F.lit("")))
    address = F.coalesce(*[F.when(F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))) > 0, code) for code, words in ADDRESS_WORDS.items()])
    tld = F.regexp_extract(domain(url), r"\.([^.]+)$", 1)
    by_tld = F.try_element_at(F.create_map(*[F.lit(x) for c in COUNTRIES for x in (c[4], c[0])]), tld)
    found = F.coalesce(phone, address, by_tld)
    return F.struct(found.alias("country"), F.when(phone.isNotNull(), 80).when(address.isNotNull(), 70).when(by_tld.isNotNull(), 45).otherwise(0).alias("confidence"))


def next_check(frequency: Column, now: Column) -> Column:
    """FN-D01: when a source is due again; an unknown or missing frequency is every six hours."""
    hours = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in CHECK_HOURS.items() for x in kv]), frequency), F.lit(DEFAULT_HOURS))
    return now + F.make_interval(hours=hours)


def call_cost(model: Column, tokens_in: Column, tokens_out: Column, prices: dict[str, tuple[float, float]]) -> Column:
    """FN-N16: cost of a model call at prices a million tokens; the first price whose name the model's contains, NULL for unknown models."""
    price = F.coalesce(*[F.when(F.contains(model, F.lit(k)), F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b"))) for k, (a, b) in prices.items()])
    return F.round(tokens_in / 1e6 * price["a"] + tokens_out / 1e6 * price["b"], 6)


def band(c: Column, size: int) -> Column:
    """FN-N12: number of the band of ``size``, halves to even."""
    return F.bround(c.cast("decimal(18,4)") / size).cast("long")


def steering(text: Column, country: Column) -> Column:
    """FN-N13: struct(side, confidence) from cues in the text, else from the country."""
    low = F.lower(F.coalesce(text, F.lit("")))
    has = lambda cues: F.size(F.filter(F.array(*[F.lit(x) for x in cues]), lambda t: F.contains(low, t))) > 0
    known = country.isNotNull() & (country != "")
    side = F.when(has(RIGHT_CUES), "RHD").when(has(LEFT_CUES), "LHD").when(known & F.upper(country).isin(*LEFT_DRIVING), "RHD").when(known, "LHD").otherwise("UNKNOWN")
    sure = F.when(has(RIGHT_CUES) | has(LEFT_CUES), 90).when(known, 55).otherwise(0)
    return F.struct(side.alias("side"), sure.alias("confidence"))


def phone_country(text: Column) -> Column:
    """First step of FN-N14: country of the first telephone code, in their fixed order, that the text contains."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(k)), v) for k, v in PHONE_CODES.items()])


def within(c: Column, low: float, high: float, tolerance: float = 0) -> Column:
    """FN-N15: plausible with tolerance; unknown is plausible."""
    return c.isNull() | c.between(low - tolerance, high + tolerance)


def whole_days(since: Column, as_of: Column) -> Column:
    """FN-D03: full 24-hour days between two timestamps."""
    return F.floor((F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(since.cast("timestamp"))) / F.lit(86_400_000_000)).cast("long")
