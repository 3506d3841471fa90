import unicodedata

import duckdb
from hypothesis import given, settings
from hypothesis import strategies as st

from lotwise.llm.characters import canonical_sql

# written out again, independently of the tables under test
LETTERS = {"А": "A", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "Ο": "O", "ν": "v", "і": "i"}
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "…": "..."}
ALPHABET = [*"aBz 1.é", "é", " ", "　", "​", "­", "﻿", "Ａ", "ｂ", "１", "．", "²", "½", *LETTERS, *LIGATURES, "ё", "\t", "\n"]


def expected(text):
    out = ""
    for c in text:
        if c in LETTERS or c in LIGATURES:
            out += LETTERS.get(c) or LIGATURES[c]
        elif c == "ё":
            out += "ë"
        elif unicodedata.category(c) == "Cf":
            continue
        elif 0xFF01 <= ord(c) <= 0xFF5E:
            out += chr(ord(c) - 0xFEE0)
        else:
            out += " " if c.isspace() else c
    return " ".join(unicodedata.normalize("NFC", out).split())


CON = duckdb.connect()
SQL = f"SELECT {canonical_sql('t')} FROM (SELECT ? AS t)"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=12))
def test_canonical_form_against_the_unicode_database(parts):
    text = "".join(parts)
    assert CON.execute(SQL, [text]).fetchone()[0] == expected(text)


def test_visible_differences_stay():
    forms = {CON.execute(SQL, [t]).fetchone()[0] for t in ("m2", "m²", "cafe", "café", "CAFE", "1/2", "½", "a-b", "a–b", "a—b")}
    assert len(forms) == 10
