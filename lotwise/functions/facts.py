"""Facts stated in free advert text, and keys of adverts.

A fact is a short segment between separators (full stop, comma, semicolon, bar,
line end): "Kilometerstand 224 000km", "asking 9,440 GBP". Numbers inside whole
sentences ("not more than 7000 Euro for one like that") aren't facts and are not
taken: around its number and unit a price or mileage has a lead and a tail of the
few words that the patterns allow (24 and 18 characters), a power may stand
anywhere. Segments and texts may be of any length. All functions give NULL for NULL
or empty text and for text without the fact. Phrases of places and the like are
those of eight languages; facts phrased otherwise aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

HP_PER_KW = 1.35962
BHP_TO_HP = 1.01387
KM_PER_MILE = 1.609344

# Spellings of the currencies.
CURRENCY_CODES = {
    "€": "EUR", "eur": "EUR", "euro": "EUR", "euros": "EUR", "teur": "EUR", "£": "GBP", "gbp": "GBP", "zł": "PLN", "pln": "PLN",
    "chf": "CHF", "sfr.": "CHF", "fr.": "CHF", "sfr": "CHF", "fr": "CHF", "kč": "CZK", "czk": "CZK", "sek": "SEK", "kr": "SEK", "kr.": "SEK",
}
# Words before the place of the car.
PLACE_PHRASES = (
    "zu besichtigen in", "Standort", "située à", "situé à", "visible à", "viewing in", "located in", "visibile a", "si trova a", "stoi w",
    "do obejrzenia w", "staat in", "te zien in", "pode ver-se em", "se puede ver en", "está em", "está en",
)

_NUMBER = r"(?:\d{1,3}(?:[.,' ]\d{3})+|\d+(?:[.,]\d{1,2})?)"
_CURRENCY = r"(?:€|EUR|[Ee]uros?|eur|£|GBP|zł|PLN|CHF|s?Fr\.|Kč|CZK|SEK|kr)"
_SEPARATOR = re.compile(r"\s*\|\s*|;\s+|\n\s*|,\s+|(?<!tys)(?<!Tsd)(?<!Fr)[.!?]\s+|[.!?]$")
_LINE_SEPARATOR = re.compile(r"\s*\|\s*|\s*\n\s*")
_PRICE = re.compile(
    rf"[^\d€£]{{0,24}}?(?:(?P<c1>{_CURRENCY})\s?(?P<n1>{_NUMBER})(?:,-)?|(?P<n2>{_NUMBER})(?:,-)?\s?(?P<k>k|T|Tsd\.?|tys\.?|mil)?\s?(?P<c2>{_CURRENCY}))(?![^\W\d_])[^\d]{{0,18}}"
)
_THOUSANDS = re.compile(rf"\D{{0,24}}?({_NUMBER})\s?TEUR\D{{0,18}}")
_POWER = re.compile(r"(?<![\d.,'])(?<!\d )(\d{2,6})\s?(kW|KW|W|PS|bhp|hp|CV|cv|ch|pk|KM)\b")
_POWER_UNIT = re.compile(r"W\b|PS|hp|CV|cv|ch\b|pk|KM")
_MONEY = re.compile(r"[€£]|[EeP][uULl][rRNn]|GBP|zł|CHF|Fr|K[čc]|CZK|SEK|kr")
_DIGIT = re.compile(r"\d")
_MILEAGE = re.compile(rf"\D{{0,18}}?({_NUMBER})\s?(tkm|km|Km|miles|mi)\b(?: \D{{2,14}})?")
_ROUGH = re.compile(rf"\b(?:etwa|environ|circa|about|około|ongeveer|unos|uns|mit|avec|con|with|przebiegiem|met|com)\s({_NUMBER})\s?km\b")
_ROUGHLY = re.compile(r"\b(?:etwa|environ|circa|about|około|ongeveer|unos|uns) \d")
_COMPARING = re.compile(r"rapport|compar|vergleich|vergel|porówn|rispetto", re.I)
_YEAR = re.compile(r"\D{1,32}?(?:\d{1,2}/)?((?:19|20)\d{2})")
_PLACE = re.compile(rf"(?:{'|'.join(PLACE_PHRASES)}) ([^\W\d_][\w'\-]+(?: [A-Z][\w'\-]+)*)")


def read_number(text: str) -> float | None:
    """A European or English number: separators before exactly three digits are thousands, one before one or two digits is the decimal mark."""
    text = text.replace("'", "").replace(" ", "")
    if re.fullmatch(r"\d{1,3}(?:[.,]\d{3})+", text):
        text = re.sub("[.,]", "", text)
    try:
        return float(text.replace(",", "."))
    except ValueError:
        return None


def read_facts(text: str | None, page: str | None = None) -> tuple:
    """(kW, km, rough km, price amount, price currency, year, place) of one text; the first fact of each kind counts.

    Where ``text`` is empty the lines of ``page`` are read, each as a whole: a
    line of several figures is a teaser for another car, not a fact.
    """
    kw = hp = km = rough = amount = currency = year = place = None
    for seg in _SEPARATOR.split(text) if text and text.strip() else _LINE_SEPARATOR.split((page or "").strip()):
        seg = seg.strip()
        if not _DIGIT.search(seg):
            if place is None and (m := _PLACE.fullmatch(seg)):
                place = m[1].lower()
            continue
        if (kw is None or hp is None) and _POWER_UNIT.search(seg):
            for m in _POWER.finditer(seg):
                n, unit = float(m[1]), m[2]
                if unit in ("kW", "KW"):
                    kw = kw or n
                elif unit == "W":
                    kw = kw or (n / 1000 if n >= 1000 else None)
                elif n < 1000:
                    hp = hp or n * (BHP_TO_HP if unit == "bhp" else 1)
        money = amount is None and _MONEY.search(seg)
        if money and (m := _PRICE.fullmatch(seg)):
            amount = read_number(m["n1"] or m["n2"])
            currency = CURRENCY_CODES.get((m["c1"] or m["c2"]).lower())
            if amount is not None and m["k"]:
                amount *= 1000
            continue
        if money and "TEUR" in seg and (m := _THOUSANDS.fullmatch(seg)):
            amount, currency = (read_number(m[1]) or 0) * 1000, "EUR"
            continue
        if km is None and (m := _MILEAGE.fullmatch(seg)) and not _ROUGHLY.search(seg):
            n = read_number(m[1])
            km = n and n * (1000 if m[2] == "tkm" else KM_PER_MILE if m[2][:2] == "mi" else 1)
            continue
        if rough is None and (m := _ROUGH.search(seg)):
            rough = read_number(m[1])
        if year is None and (m := _YEAR.fullmatch(seg)) and not _COMPARING.search(seg):
            year = int(m[1])
    return kw or (hp and hp / HP_PER_KW), km, rough, amount, currency, year, place


FACTS = T.StructType(
    [
        T.StructField("fact_kw", T.DoubleType()), T.StructField("fact_km", T.DoubleType()), T.StructField("fact_rough_km", T.DoubleType()), T.StructField("fact_amount", T.DoubleType()),
        T.StructField("fact_currency", T.StringType()), T.StructField("fact_year", T.IntegerType()), T.StructField("fact_place", T.StringType()),
    ]
)


def with_facts(df: DataFrame, text: Column, page: Column | None = None) -> DataFrame:
    """``df`` plus the fact_ columns read from ``text``, or where that is empty from the lines of ``page``; columns of those names are replaced.

    Splitting each text once into segments and matching only short ones is what
    whole-text regular expressions can't do cheaply, hence one Arrow-batched
    narrow map (no shuffle) instead of a dozen scans of each text. Whole texts
    are read.
    """
    keep = [c for c in df.columns if c not in FACTS.fieldNames()]
    schema = T.StructType([df.schema[c] for c in keep] + FACTS.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [read_facts(t, p) for t, p in zip(batch.column(len(keep)).to_pylist(), batch.column(len(keep) + 1).to_pylist(), strict=True)]
            columns = list(zip(*rows)) if rows else [()] * len(FACTS)
            kinds = (pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.string(), pa.int32(), pa.string())
            facts = [pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *facts], names=schema.fieldNames())

    return df.select(*(F.col(f"`{c}`") for c in keep), text.alias("__text"), (F.lit(None).cast("string") if page is None else page).alias("__page")).mapInArrow(run, schema)


def currency_code(c: Column) -> Column:
    """ISO code of a currency code, word or symbol; NULL for NULL, the upper-cased text for an unknown one."""
    key = F.lower(F.trim(c))
    known = F.create_map(*[F.lit(x) for pair in CURRENCY_CODES.items() for x in pair])
    return F.when(key != "", F.coalesce(F.try_element_at(known, key), F.upper(key)))


def litres(title: Column) -> Column:
    """Engine size in tenths of a litre from a title such as "Brankel Wald 1,4 Edition"; full-width digits and invisible characters are read too."""
    plain = F.regexp_replace(F.translate(title, "０１２３４５６７８９．，", "0123456789.,"), r"\p{Cf}", "")
    tenth = F.regexp_extract(plain, r"(?<![\d.,])([1-6])[.,](\d)(?![\d.,])", 0)
    return F.regexp_replace(tenth, "[.,]", "").try_cast("int")


def model_slug(url: Column) -> Column:
    """make-model from the path of an item page ("/listing/1010425-brankel-wald", "/auto/brankel-wald/2007-1.html"); NULL where the path has none."""
    path = F.lower(F.regexp_extract(url, r"//[^/?#]+(/[^?#]*)", 1))
    slug = F.coalesce(*(F.nullif(F.regexp_extract(path, p, 1), F.lit("")) for p in (r"/\d{5,}-([a-z]+-[a-z]+)(?:/|$)", r"/([a-z]+-[a-z]+)-(?:id)?\d{5,}", r"/([a-z]+-[a-z]+)/[\d\-]*\d{5,}")))
    return slug


def advert_key(url: Column) -> Column:
    """Host without www. plus the item id of the path: the same for all crawls of an advert. URLs without an id keep their whole path."""
    host = F.regexp_extract(F.lower(url), r"//(?:www\.)?([^/?#:]+)", 1)
    path = F.regexp_extract(url, r"//[^/?#]+(/[^?#]*)", 1)
    item = F.regexp_extract(path, r"(\d{5,})(?!.*\d{5,})", 1)
    return F.when(host != "", F.concat(host, F.lit("#"), F.when(item != "", item).otherwise(path)))
