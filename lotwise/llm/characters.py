"""P1: text that looks the same but is written with different characters.

``canonical_sql`` builds one DuckDB expression (``translate``, regular
expressions, ``nfc_normalize``); ``with_canonical`` runs it inside Arrow
partitions, and the oracle runs the very same text.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotwise.session import cut

# Letters of other scripts whose usual glyph is that of a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T",
    "У": "Y", "Х": "X", "Ѕ": "S", "І": "I", "Ј": "J", "Ԛ": "Q", "Ԝ": "W", "Ү": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "ѕ": "s", "і": "i", "ј": "j",
    "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ү": "y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "ο": "o", "ν": "v",
    "µ": "μ", "‐": "-", "‑": "-", "﹣": "-", "⁃": "-",
}

#: Decompositions after which the glyph stays the same; superscripts, fractions, circled and styled letters look different.
SAME_GLYPH = ("<wide>", "<narrow>", "<noBreak>")
#: Compatibility characters (tag <compat>) that are only another way to store the same glyphs.
SAME_GLYPH_COMPAT = (*range(0xFB00, 0xFB07), *range(0x2002, 0x200B), 0x205F, 0x2024, 0x2025, 0x2026, 0x132, 0x133, *range(0x1C4, 0x1CD), *range(0x1F1, 0x1F4), *range(0x2160, 0x2180))
#: Format characters that are drawn.
DRAWN_FORMAT = (*range(0x600, 0x606), 0x6DD, 0x70F, 0x890, 0x891, 0x8E2, 0x110BD, 0x110CD)
#: Characters without a glyph that aren't of category Cf.
BLANK = (0x34F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180F), 0x3164, 0xFFA0, *range(0xFE00, 0xFE10))


@lru_cache(1)
def tables() -> tuple[dict[str, str], dict[str, str], str]:
    """(one to one, one to several, dropped characters), built by rule from the Unicode database."""
    one, several, dropped = dict(LOOKALIKES), {}, []
    for cp in (*range(0x80, 0xD800), *range(0xE000, 0x20000), *range(0xE0000, 0xE0200)):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cf" and cp not in DRAWN_FORMAT or cp in BLANK:
            dropped.append(ch)
        elif kind in ("Zs", "Zl", "Zp"):
            one[ch] = " "
        elif ch not in one:
            tag = unicodedata.decomposition(ch).split(" ")[0]
            if tag in SAME_GLYPH or (tag == "<compat>" and cp in SAME_GLYPH_COMPAT):
                to = unicodedata.normalize("NFKC", ch)
                (one if len(to) == 1 else several)[ch] = to
            elif tag and not tag.startswith("<"):
                # a letter with accents on a look-alike base, as in Cyrillic IO
                parts = unicodedata.normalize("NFD", ch)
                to = unicodedata.normalize("NFC", "".join(LOOKALIKES.get(c, c) for c in parts))
                if parts[0] in LOOKALIKES and len(to) == 1:
                    one[ch] = to
    dropped += [chr(c) for c in (*range(1, 9), *range(14, 32), *range(0x7F, 0xA0)) if c != 0x85]
    one["\x85"] = " "
    return one, several, "".join(dropped)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def canonical_sql(column: str) -> str:
    """DuckDB expression of the canonical form of ``column``.

    NULL stays NULL, an empty or invisible-only text becomes ''. White space of
    any kind is one space, at the ends none. Letter case, accents, wording and
    visible punctuation are kept. Look-alike letters are mapped whatever script
    their word is in, so that a Cyrillic word and its imitation become equal: the
    form serves comparisons, it isn't a spelling of words in those scripts.
    """
    one, several, dropped = tables()
    inner = column
    for ch, to in several.items():
        inner = f"replace({inner}, {_quoted(ch)}, {_quoted(to)})"
    inner = f"CASE WHEN regexp_matches({column}, {_quoted('[' + ''.join(several) + ']')}) THEN {inner} ELSE {column} END"
    source, target = "".join(one), "".join(one.values())
    inner = f"translate({inner}, {_quoted(source + dropped)}, {_quoted(target)})"
    return f"trim(regexp_replace(nfc_normalize({inner}), '\\s+', ' ', 'g'))"


def with_canonical(df: DataFrame, column: str, out: str) -> DataFrame:
    """``df`` with the canonical form of ``column`` as ``out``; all other columns pass through.

    DuckDB runs inside each Arrow partition, with one thread and a memory bound,
    so the operator is a narrow map: no shuffle, any input size. ``out`` replaces
    a column of that name. NULL texts stay NULL, empty partitions give no rows.
    """
    keep = [c for c in df.columns if c != out]
    source = [*keep, "__source"]  # the text again, so that ``out`` may replace ``column``
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(out, T.StringType())])
    expression = canonical_sql("t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(":memory:", config={"threads": "1", "memory_limit": "400MB"})
        for batch in batches:
            if not batch.num_rows:
                continue
            part = pa.table({"i": pa.array(range(batch.num_rows), pa.int64()), "t": batch.column(len(keep)).cast(pa.string())})
            con.register("part", part)
            done = con.sql(f"SELECT {expression} AS c FROM part ORDER BY i").to_arrow_table()
            con.unregister("part")
            texts = pa.array(done.column(0).to_pylist(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], texts], names=[*keep, out])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(column).alias(source[-1])).mapInArrow(run, schema)


def _key(c: Column) -> list[Column]:
    return [F.xxhash64(c), F.xxhash64(F.lit("second"), c)]


def _hashed(texts: DataFrame) -> DataFrame:
    rows = with_canonical(texts.select("field", "id", "text").where(F.col("text").isNotNull()), "text", "canon")
    k1, k2 = _key(F.col("canon"))
    t1, t2 = _key(F.col("text"))
    return rows.where("canon <> ''").select("field", "id", k1.alias("k1"), k2.alias("k2"), t1.alias("t1"), t2.alias("t2"))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """(field, id, group_id, text_id): every row with visible text once: group_id is the smallest id of the rows that look the same, text_id the smallest of those that also are the same string. Rows of one group and different text_id are look-alikes. NULL and invisible texts give no row."""
    rows = cut(_hashed(texts))
    same = rows.groupBy("field", "k1", "k2", "t1", "t2").agg(F.min("id").alias("text_id"))
    group = same.groupBy("field", "k1", "k2").agg(F.min("text_id").alias("group_id"))
    named = same.join(group, ["field", "k1", "k2"]).select("field", "t1", "t2", "text_id", "group_id")
    return rows.join(named, ["field", "t1", "t2"]).select("field", "id", "group_id", "text_id")


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """(field, id, text) -> (field, id_a, id_b): rows of one field that look the same but aren't the same string.

    Texts travel as 128-bit hashes of their canonical form and of themselves.
    Rows are folded to classes of one string, classes of one canonical form are
    paired, and only pairs of different classes are expanded to rows, so rows of
    one string never meet, however many they are. NULL texts and texts without
    visible characters give no pair; repeated ids count once.
    """
    rows = cut(_hashed(texts))
    look, string = ["field", "k1", "k2"], ["t1", "t2"]
    several = rows.groupBy(*look).agg(F.min(F.struct(*string)).alias("lo"), F.max(F.struct(*string)).alias("hi")).where("lo <> hi").select(*look)
    some = cut(rows.join(several, look, "left_semi"))
    classes = some.select(*look, *string).distinct()
    pairs = classes.select(*look, F.struct(*string).alias("x")).join(classes.select(*look, F.struct(*string).alias("y")), look).where("x < y")
    left = some.select(*look, F.struct(*string).alias("x"), F.col("id").alias("a")).join(pairs, [*look, "x"])
    both = left.join(some.select(*look, F.struct(*string).alias("y"), F.col("id").alias("b")), [*look, "y"])
    return both.where("a <> b").select("field", F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()
