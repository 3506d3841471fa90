"""P3 and P4: page furniture around main content, and pages that hold no content.

A page is a sequence of lines, a line a sequence of items (navigation bars put
several on one line). Items are the template's tokens. The root class of every
host's template are the structural tokens that any of its pages has: start, heading
or article landmark, end. Between them lie its gaps. A token's occurrence vector is
taken over the host's pages: exactly, page by page (compared by XOR fingerprints of
128 bits, so no vector is ever gathered), and, because furniture is drawn anew for
each page, pooled over the pages of one layout, gap by gap. Tokens of one host with
equal vectors form a class; a class that keeps to the gaps outside the content is
furniture and nests there, one that keeps to the content isn't; classes that no gap
decides take the role that their tokens' classes have on other hosts. What the
furniture leaves open are the slots.

A page whose content slot is filled by nothing but unset values, filler, notices or
the lines of repeated whole-page error templates is residue (P4). So is one in
which a slot keeps a variable's name, a default or nothing: slots are induced from
lines that agree in all but a value; a name between delimiters is aligned by the
template words beside it, and counts by its delimiters where there are none.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotwise.functions.urls import normalize
from lotwise.llm.characters import with_canonical
from lotwise.session import cut

_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|<![^<>]*>")
_SCRIPT = re.compile(r"<(script|style)\b.*?</\1>", re.I | re.S)
_SPLIT = re.compile(r" \| | / | > | · | - | {3,}")
_NUMBER = re.compile(r"\d+(?:[.,'’ ]\d+)*")
_HOST = re.compile(r"\b[\w\-]+(?:\.[\w\-]+)*\.[a-z]{2,}\b")
_TRAIL = re.compile(r"\s*(?:\[\d+\]|\((?:Ref|ID|Nr|#)?\.?\s?[A-Z0-9]{4,}\))$")
_DIGIT = re.compile(r"\d")
_ALNUM = re.compile(r"[^\W_]")
_WORD = re.compile(r"[^\W\d_]{2,}")
_AFTER_NUMBER = re.compile(r"(?<=0 )[^\W\d_]+|(?<=0)[^\W\d_]+|[^\W\d_]+")
_LANDMARK = re.compile(r"<(/?)(article|main|nav|aside|footer|header)\b", re.I)
_HEADING = re.compile(r"<(h1|b|strong)\b", re.I)

# What templates print for a value that isn't set.
UNSET = ("undefined", "null", "nan", "none", "nil", "n/a", "[object object]", "(null)")
# The delimiters of common template languages, opening and closing.
DELIMITERS = (("{{", "}}"), ("{%", "%}"), ("${", "}"), ("#{", "}"), ("<%=", "%>"), ("<%", "%>"), ("[[", "]]"), ("%%", "%%"), ("__", "__"), ("@@", "@@"), ("[%", "%]"), ("{$", "}"), ("{", "}"))
#: An unfilled slot keeps a variable's name between delimiters: lower or upper case throughout, parts joined by dots or underscores, or camelCase. Real words in ornaments start with a capital or are numbers.
_NAME = r"(?:[a-z][a-z0-9]*(?:[._][a-z0-9]+)*|[a-z][a-z0-9]*(?:[._]?[A-Z][a-z0-9]*)+|[A-Z][A-Z0-9]*(?:[._][A-Z0-9]+)+|[A-Z]{2,}[A-Z0-9]*)"
_PLACEHOLDER = re.compile("|".join(rf"{re.escape(a)}\s*{_NAME}\s*{re.escape(b)}" for a, b in DELIMITERS))
_DELIMITED = re.compile(r"[{<%\[_@#$]")
#: In an induced slot whatever signs stand around a lone name are delimiters.
_SLOT_NAME = re.compile(rf"[^\w\s]{{1,3}}\s*{_NAME}\s*[^\w\s]{{1,3}}")
_LABEL = re.compile(r"([^\d:=]{2,}?)\s*[:=](?:\s+(.*)|$)")
# Units that a template prints beside a number, set or not.
UNITS = frozenset("€ $ £ eur euro usd gbp chf pln zł sek km mi kw ps hp cv ch pk km/h bhp ccm cm³ cc l".split())
SLOTS = "="  #: stands before the host in the evidence of slots
BLANK, DEFAULT, NAME = "blank slot", "default in slot", "name in slot"


#: Cells of an occurrence vector: a gap of the root class on pages of one layout. OUTSIDE and INSIDE are those that prove a role.
CELLS = ("outside landmark", "inside landmark", "above marked heading", "below marked heading", "above title", "below title", "no heading", "heading")
OUTSIDE, INSIDE = (0, 2, 4), (1, 7)
_PLACEHOLDER_FLAG, _UNSET_FLAG, _FILLER_FLAG = 1, 2, 4
_VALUE, _SMALL_VALUE, _TEXT_VALUE, _BLANK, _BARE_UNIT, _DEFAULT, _NAMED = range(7)  # what stands in a slot
#: fault -> (its name, what the slot must be known to hold: 1 any value, 2 a number, 3 a number that never comes near zero)
_FAULTS = {_BLANK: (BLANK, 1), _BARE_UNIT: (BLANK, 2), _DEFAULT: (DEFAULT, 3), _NAMED: (NAME, 2)}


def visible(line: str) -> str:
    """Text of a line as a reader sees it; '' for blank, markup-only and script-only lines."""
    if "<" in line:
        line = _TAG.sub("", _SCRIPT.sub("", line))
    if "&" in line:
        line = html.unescape(line)
    return line.strip()


def key_of(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def _token(item: str) -> int:
    """64-bit token of an item: lower case, numbers as 0, hosts as @; items of several numbers keep only their shape."""
    item = item.lower()
    if _DIGIT.search(item):
        if "." in item:
            item = _HOST.sub("@", item)
        masked, n = _NUMBER.subn("0", item)
        if n >= 2:
            masked = _AFTER_NUMBER.sub(lambda m: m[0] if m.start() and masked[m.start() - 1] in "0" or (m.start() > 1 and masked[m.start() - 2 : m.start()] == "0 ") else "w", masked)
        item = masked
    return key_of(item)


def tokens_of(line: str) -> tuple[int, ...]:
    """Tokens of the items of a visible line; separators alone give none."""
    line = _TRAIL.sub("", line)
    if " | " in line or " / " in line or " > " in line or " · " in line or " - " in line or "   " in line:
        return tuple(_token(x.strip()) for x in _SPLIT.split(line) if x.strip(" |/>·-"))
    return (_token(line),)


def is_unset(line: str) -> bool:
    """A line in which a template printed unset values: nothing is left beside them but units, numbers and punctuation."""
    low = line.lower()
    hits = 0
    for u in UNSET:
        if u in low:
            hits += len(re.findall(rf"(?<![^\W_]){re.escape(u)}(?![^\W_])", low))
            low = re.sub(rf"(?<![^\W_]){re.escape(u)}(?![^\W_])", " ", low)
    return hits > 0 and not re.search(r"[^\W\d_]{4,}", low)


def repeats_itself(line: str) -> bool:
    """Filler that needs no dictionary: one word over and over, or signs only."""
    if not _ALNUM.search(line):
        return bool(line)
    parts = line.lower().split()
    if len(parts) < 3 or len(set(parts)) > 2:  # a repeated word, and the same with its full stop
        return False
    words = _WORD.findall(line.lower())
    return len(words) >= 3 and len(set(words)) == 1


def has_placeholder(line: str) -> bool:
    return bool(_DELIMITED.search(line)) and bool(_PLACEHOLDER.search(line))


def neighbours(line: str) -> list[int]:
    """Keys of the words beside each delimited name, none where it stands at an edge."""
    out = []
    for m in _PLACEHOLDER.finditer(line):
        before, after = _WORD.findall(line[: m.start()]), _WORD.findall(line[m.end() :])
        out += [key_of(before[-1].lower())] if before else []
        out += [key_of(after[0].lower())] if after else []
    return out


def slot_of(line: str) -> tuple[int, int] | None:
    """(key of the slot, what stands in it) of a line that can be aligned with others: a label, a colon or equals sign and a value; or a number beside its unit, whose slot is known by the rest of the line. None for other lines and sentences."""
    label = value = None
    if ":" in line or "=" in line:
        m = _LABEL.match(line)
        if m and any(c.isalpha() for c in m[1]):
            label, value = m[1].strip().lower(), (m[2] or "").strip()
    if label is None and not line.endswith((".", "!", "?", "…")):
        numbers = _NUMBER.findall(line)
        words = _NUMBER.sub(" ", line).lower().split() if len(numbers) <= 1 else ()
        if words and any(w.strip(".,-") in UNITS for w in words) and any(w.strip(".,-") not in UNITS and any(c.isalpha() for c in w) for w in words):
            label, value = "\x1f" + " ".join(w for w in words if any(c.isalpha() for c in w) or w in UNITS), numbers[0] if numbers else ""
            if not numbers:
                return key_of(label), _BARE_UNIT
    return None if label is None else (key_of(label), _filling(value))


def _filling(value: str) -> int:
    if any(c.isdigit() for c in value):
        if all(c in "0" for c in value if c.isdigit()):
            return _DEFAULT
        first = _NUMBER.search(value)
        return _SMALL_VALUE if first is not None and len(first[0]) == 1 else _VALUE
    if not value:
        return _BLANK
    if all(w in UNITS or not any(c.isalnum() for c in w) for w in value.lower().split()):
        return _BARE_UNIT
    return _NAMED if _SLOT_NAME.fullmatch(value) else _TEXT_VALUE


def page_records(fetched: DataFrame, listings: DataFrame) -> DataFrame:
    """(kind, id, host, title, text, url) of both tables; titles in canonical lower case, empty and NULL texts left out. url is a hash of the normalized address, NULL where there is none."""
    address = lambda df: F.xxhash64(normalize(F.col("url"))) if "url" in df.columns else F.lit(None).cast("long")
    raw = listings.where("raw_text IS NOT NULL AND raw_text <> ''").select("raw_id", "source_domain", "title", "raw_text", address(listings).alias("u"))
    raw = with_canonical(raw, "title", "title")
    raw = raw.select(F.lit("raw").alias("kind"), F.col("raw_id").cast("long").alias("id"), F.coalesce("source_domain", F.lit("?")).alias("host"), F.lower("title").alias("title"), F.col("raw_text").alias("text"), F.col("u").alias("url"))
    fetch = fetched.where("text IS NOT NULL AND text <> ''").select(F.lit("fetch"), F.col("fetch_id").cast("long"), F.coalesce("source_domain", F.lit("?")), F.lit(None).cast("string"), "text", address(fetched))
    return raw.union(fetch)


_PAGES = (
    "kind string, id long, host string, url long, heading byte, layout byte, no array<int>, place array<byte>, flag array<byte>, tok array<long>, at array<int>, "
    "slot array<long>, fill array<byte>, slot_at array<int>, near array<long>, texts array<string>"
)


class _Lines:
    """What each distinct line holds, worked out once per task: (visible text, tokens, flags, slot, heading markup, landmark switches, counted)."""

    def __init__(self, most: int = 200_000):
        self.known: dict[str, list] = {}
        self.most = most  # entries kept; a full cache starts anew, which costs time only

    def __getitem__(self, raw: str) -> list:
        found = self.known.get(raw)
        if found is None:
            if len(self.known) >= self.most:
                self.known.clear()
            found = self.known[raw] = self._read(raw)
        return found

    def _read(self, raw: str) -> list:
        marks = [m[2].lower() in ("article", "main") and (0 if m[1] else 1) for m in _LANDMARK.finditer(raw) if m[2].lower() in ("article", "main")] if "<" in raw else []
        v = visible(raw)
        if not v:
            return ["", (), 0, None, False, marks, False]
        flags = (_PLACEHOLDER_FLAG if has_placeholder(v) else 0) | (_UNSET_FLAG if is_unset(v) else 0) | (_FILLER_FLAG if repeats_itself(v) else 0)
        return [v, tokens_of(v), flags, slot_of(v), "<" in raw and _HEADING.search(raw) is not None, marks, False]


def read_pages(records: DataFrame) -> DataFrame:
    """Every record as arrays over its visible lines (number, place, flags), items (token, line) and slots: the one pass over the texts.

    place is 1 outside and -1 inside the content, 0 unknown. In a page with an
    article landmark it is known for every line; else what stands above the
    heading (heading markup, or the line equal to the known title) is outside.
    heading is 1 if the page shows its known title, 0 if it shows neither that nor
    heading markup, -1 if that can't be told. Lines' texts are kept for pages
    without a shown title only. Rows of kind '' hold the words of titled pages
    (tok) and in how many distinct lines of a task they stand (at).
    """
    schema = [(c.split(" ")[0], c.split(" ")[1]) for c in _PAGES.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "byte": pa.int8(), "array<int>": pa.list_(pa.int32()), "array<byte>": pa.list_(pa.int8()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[t]) for c, (_, t) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = _Lines()
        words: Counter = Counter()
        for big in batches:
            for start in range(0, big.num_rows, 2000):
                batch = big.slice(start, 2000)
                rows = []
                for kind, rid, host, title, text, url in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                    marked = "</" in text
                    landmarks = marked and ("<article" in text or "<main" in text)
                    inside, heading = 0, -1
                    no, place, found = [], [], []
                    for k, raw in enumerate(text.split("\n")):
                        x = line[raw]
                        within = inside
                        if landmarks and x[5]:
                            inside = x[5][-1]
                            within = within or 1 in x[5]
                        if not x[0]:
                            continue
                        if heading < 0 and (x[4] if marked else title and x[0].lower() == title):
                            heading = len(no)
                        no.append(k)
                        place.append((-1 if within else 1) if landmarks else 0)
                        found.append(x)
                    if heading >= 0:
                        if not landmarks:
                            place[:heading] = [1] * heading
                        place[heading] = -1
                    layout = 0 if landmarks else 3 if heading < 0 else 1 if marked else 2
                    # error pages have heading markup too: only a known title proves content
                    shown = 1 if heading >= 0 and title else 0 if heading < 0 and (marked or title) else -1
                    tok, at, slot, fill, slot_at, near, flag = [], [], [], [], [], [], []
                    for j, x in enumerate(found):
                        tok += x[1]
                        at += [j] * len(x[1])
                        flag.append(x[2])
                        if x[3] is not None and place[j] <= 0:
                            slot.append(x[3][0]), fill.append(x[3][1]), slot_at.append(j)
                        if x[2] & _PLACEHOLDER_FLAG:
                            near += neighbours(x[0])
                        if shown == 1 and place[j] <= 0 and not x[6]:
                            x[6] = True
                            words.update(set(_WORD.findall(x[0].lower())))
                    rows.append((kind, rid, host, url, shown, layout, no, place, flag, tok, at, slot, fill, slot_at, near, None if shown == 1 else [x[0] for x in found]))
                yield packed(rows)
            if len(words) > 50_000:
                yield packed([("", 0, "", None, 0, 0, [], [], [], [key_of(w) for w in words], list(words.values()), [], [], [], [], None)])
                words.clear()
        if words:
            yield packed([("", 0, "", None, 0, 0, [], [], [], [key_of(w) for w in words], list(words.values()), [], [], [], [], None)])

    return records.select("kind", "id", "host", "title", "text", "url").mapInArrow(run, _PAGES)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixing function (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(values, page of each value) of a list column."""
    c = batch.column(name)
    size = np.diff(c.offsets.to_numpy()) if len(c) else np.zeros(0, int)
    return c.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(c)), size)


def _starts(batch: pa.RecordBatch) -> np.ndarray:
    """Number of the first visible line of each page among those of the batch."""
    size = np.diff(batch.column("no").offsets.to_numpy())
    return np.concatenate(([0], np.cumsum(size)[:-1])) if len(size) else np.zeros(0, int)


def _codes(batch: pa.RecordBatch) -> tuple[np.ndarray, list[str]]:
    host = batch.column("host").dictionary_encode()
    return host.indices.to_numpy(), host.dictionary.to_pylist()


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts of the groups of equal keys) for the keys, most significant first."""
    order = np.lexsort(keys[::-1])
    if not len(order):
        return order, order
    new = np.zeros(len(order), bool)
    new[0] = True
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    return order, np.flatnonzero(new)


_COUNTS = [f"c{i}" for i in range(len(CELLS))]


def token_evidence(pages: DataFrame) -> DataFrame:
    """Occurrences by host and token, reduced inside each Arrow batch before they are shuffled.

    Columns host, token, n (pages), f1 and f2 (XOR of the hashes of page and
    count: 128 bits that are equal for equal occurrence vectors, at any number of
    pages), c0 .. c7 (pages on which it stands in each of CELLS), bare and headed
    (pages that lack or show their title on which it stands in place of content),
    lo and hi (of the hashed addresses of those that don't show it). A host after SLOTS
    carries the slots: n filled lines, c0 with a number, c1 blank, c2 one-digit
    numbers, c3 defaults and names. Host '' carries the words of titled pages.
    """
    names = ["host", "token", "n", "f1", "f2", *_COUNTS, "bare", "headed", "lo", "hi"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kind = np.array(batch.column("kind").to_pylist(), object) if batch.num_rows else np.zeros(0, object)
            code, hosts = _codes(batch)
            tok, page = _flat(batch, "tok")
            at, _ = _flat(batch, "at")
            out = []
            word = kind[page] == "" if len(page) else np.zeros(0, bool)
            if word.any():
                order, first = _runs(tok[word])
                out.append([np.full(len(first), "", object), tok[word][order][first], np.add.reduceat(at[word][order], first)])
            tok, at, page = tok[~word], at[~word], page[~word]
            if len(tok):
                place, _ = _flat(batch, "place")
                layout, heading = batch.column("layout").to_numpy(), batch.column("heading").to_numpy()
                p = place[at + _starts(batch)[page]]
                la = layout[page]
                cell = np.where(la == 0, np.where(p > 0, 0, 1), np.where(la == 3, 6, np.where(p < 0, 7, 2 * la + (p == 0))))
                rid = batch.column("id").to_numpy().astype(np.uint64) * np.uint64(2) + (kind == "raw").astype(np.uint64)
                order, first = _runs(code[page], tok, page)
                bits = np.bitwise_or.reduceat(1 << cell[order], first)
                count = np.diff(np.append(first, len(order))).astype(np.uint64)
                tok, page = tok[order][first], page[order][first]
                h = [_mixed(rid[page] * np.uint64(2 * s + 1) + count * np.uint64(0x9E3779B97F4A7C15) + np.uint64(s)) for s in (0, 1)]
                content = (bits & (1 << 0 | 1 << 2 | 1 << 4)) == 0
                bare, headed = content & (heading[page] == 0), content & (heading[page] == 1)
                url = np.where(batch.column("url").is_valid().to_numpy(zero_copy_only=False), batch.column("url").fill_null(0).to_numpy(), rid.view(np.int64))
                untold = content & (heading[page] < 1)
                lo, hi = np.where(untold, url[page], np.iinfo(np.int64).max), np.where(untold, url[page], np.iinfo(np.int64).min)
                order, first = _runs(code[page], tok)
                sums = lambda x: np.add.reduceat(x[order].astype(np.int64), first)
                columns = [np.array(hosts, object)[code[page][order][first]], tok[order][first], np.diff(np.append(first, len(order)))]
                columns += [np.bitwise_xor.reduceat(x[order], first).view(np.int64) for x in h]
                columns += [sums(bits >> i & 1) for i in range(len(CELLS))] + [sums(bare), sums(headed), np.minimum.reduceat(lo[order], first), np.maximum.reduceat(hi[order], first)]
                out.append(columns)
            slot, page = _flat(batch, "slot")
            if len(slot):
                fill, _ = _flat(batch, "fill")
                order, first = _runs(code[page], slot)
                sums = lambda x: np.add.reduceat(x[order].astype(np.int64), first)
                columns = [np.array([SLOTS + x for x in hosts], object)[code[page][order][first]], slot[order][first], sums((fill <= _TEXT_VALUE)), *[np.zeros(len(first), np.int64)] * 2]
                out.append([*columns, sums(fill <= _SMALL_VALUE), sums((fill == _BLANK) | (fill == _BARE_UNIT)), sums(fill == _SMALL_VALUE), sums(fill >= _DEFAULT)])
            for columns in out:
                n = len(columns[0])
                arrays = [pa.array(columns[0], pa.string())] + [pa.array(c, pa.int64()) for c in columns[1:]]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(np.zeros(n, np.int64))] * (len(names) - len(arrays)), names=names)

    found = pages.mapInArrow(run, "host string, " + ", ".join(f"{c} long" for c in names[1:]))
    added = [F.sum(c).alias(c) for c in ("n", *_COUNTS, "bare", "headed")]
    return found.groupBy("host", "token").agg(*added, *[F.bit_xor(c).alias(c) for c in ("f1", "f2")], F.min("lo").alias("lo"), F.max("hi").alias("hi"))


def _of_hosts(evidence: DataFrame) -> DataFrame:
    return evidence.where(f"host <> '' AND NOT startswith(host, '{SLOTS}')")


def _total(cells: tuple[int, ...], prefix: str = "c") -> Column:
    out = F.lit(0)
    for i in cells:
        out = out + F.col(f"{prefix}{i}")
    return out


def equivalence_classes(evidence: DataFrame, least_pages: int = 2, least_size: int = 2) -> DataFrame:
    """(host, f1, f2, n, size, x0 .. x7): sets of tokens of one host that occur equally often on exactly the same pages, with the cells of their members summed. Valid are those that don't lie on both sides of the content's border; the others (whole repeated pages) are left out."""
    exact = _of_hosts(evidence).where(f"n >= {least_pages}").groupBy("host", "f1", "f2", "n").agg(F.count(F.lit(1)).alias("size"), *[F.sum(f"c{i}").alias(f"x{i}") for i in range(len(CELLS))])
    return exact.where((F.col("size") >= least_size) & ((_total(OUTSIDE, "x") == 0) | (_total(INSIDE, "x") == 0)))


def token_classes(evidence: DataFrame, least_share: float = 0.2) -> DataFrame:
    """(host, token, n, vector): the class of every token. vector has one bit per cell in which the token, or its exact class, stands on at least ``least_share`` of its pages of that layout."""
    exact = equivalence_classes(evidence).drop("size")
    t = _of_hosts(evidence).join(exact, ["host", "f1", "f2", "n"], "left").withColumns({f"c{i}": F.coalesce(f"x{i}", f"c{i}") for i in range(len(CELLS))})
    vector = F.lit(0)
    for layout in ((0, 1), (2, 3), (4, 5), (6,), (7,)):
        whole = _total(layout)
        for i in layout:
            vector = vector + F.when((F.col(f"c{i}") > 0) & (F.col(f"c{i}") >= least_share * whole), 1 << i).otherwise(0)
    return t.select("host", "token", "n", vector.alias("vector"), _total(OUTSIDE).alias("outside"), _total(INSIDE).alias("inside"), "bare", "headed", "lo", "hi")


def class_roles(tokens: DataFrame) -> DataFrame:
    """(host, vector, size, outside, inside, role): the classes of each host's tokens. role is 1 (furniture) where its gaps lie outside the content, -1 where they lie inside, the more frequent of the two where they do both, 0 where they prove nothing."""
    c = tokens.groupBy("host", "vector").agg(F.count(F.lit(1)).alias("size"), F.sum("outside").alias("outside"), F.sum("inside").alias("inside"))
    out, inn = (F.col("vector").bitwiseAND(sum(1 << i for i in cells)) != 0 for cells in (OUTSIDE, INSIDE))
    role = F.when(out & ~inn, 1).when(inn & ~out, -1).when(out & inn, F.signum(F.col("outside") - F.col("inside")).cast("int")).otherwise(0)
    return c.withColumn("role", role)


def template_tokens(evidence: DataFrame) -> DataFrame:
    """(host, token, n, vector, outside, role, from_host, contentless): the role that each token of several pages takes from its class, on its own host or, where that is open, from the majority of its classes on others.

    contentless: lines in place of content that recur at several addresses and
    mostly on pages which don't show their title.
    """
    tokens = cut(token_classes(evidence))
    # tokens of a single page prove nothing about others; their classes have counted them
    every = tokens.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "bare", "headed")], F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("n > 1").drop("n")
    t = tokens.select("host", "token", "n", "vector", "outside").join(every, "token").join(class_roles(tokens).select("host", "vector", "role"), ["host", "vector"])
    t = cut(t)
    vote = t.groupBy("token").agg(F.signum(F.sum(F.col("role") * F.least("n", F.lit(9)))).cast("int").alias("elsewhere"))
    t = t.join(vote, "token")
    contentless = (F.col("lo") < F.col("hi")) & (F.col("bare") >= F.col("headed")) & (F.col("bare") > 0)
    return t.select("host", "token", "n", "vector", "outside", F.when(F.col("role") != 0, F.col("role")).otherwise(F.col("elsewhere")).alias("role"), (F.col("role") != 0).alias("from_host"), contentless.alias("contentless"))


def induced_slots(evidence: DataFrame, least: int = 3, least_everywhere: int = 8) -> DataFrame:
    """(host, label, holds): the slots that a host's pages fill, of those that are found unfilled anywhere: 1 with any value, 2 with a number, 3 with a number that never comes near zero.

    A host with fewer than ``least`` lines of a slot takes what all hosts
    together show (host ''), if those are ``least_everywhere``. A label that often
    stands alone has its values in the next line and is no slot.
    """
    lines = evidence.where(f"startswith(host, '{SLOTS}')").select(F.expr(f"substr(host, {len(SLOTS) + 1})").alias("host"), "token", "n", "c0", "c1", "c2", "c3")
    every = lines.groupBy("token").agg(*[F.sum(c).alias(c) for c in ("n", "c0", "c1", "c2", "c3")])
    faulty = every.where("c1 + c3 > 0").select("token")
    both = lines.where(F.col("n") + F.col("c1") >= least).union(every.where(F.col("n") + F.col("c1") >= least_everywhere).select(F.lit("").alias("host"), "token", "n", "c0", "c1", "c2", "c3"))
    number = (F.col("c0") * 4 >= F.col("n") * 3) & (F.col("c3") * 3 <= F.col("n"))
    holds = F.when((F.col("n") < least) | (F.col("c1") * 3 > F.col("n")), 0).when(~number, 1).when(F.col("c2") * 20 > F.col("c0"), 2).otherwise(3)
    return both.join(faulty, "token", "left_semi").select("host", F.col("token").alias("label"), holds.alias("holds"))


def _host_key(hosts: list[str], code: np.ndarray, token: np.ndarray) -> np.ndarray:
    h = np.array([key_of(x) for x in hosts], np.int64).view(np.uint64)
    return _mixed((h[code] if len(hosts) else np.zeros(0, np.uint64)) * np.uint64(3) + token.view(np.uint64))


class _Table:
    """A sorted array of 64-bit keys with a value each, as NumPy arrays: a broadcast of nine bytes an entry."""

    def __init__(self, keys: np.ndarray, values: np.ndarray | None = None):
        order = np.argsort(keys, kind="stable")
        self.keys, self.values = keys[order], (np.ones(len(keys), np.int8) if values is None else values.astype(np.int8))[order]

    def get(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.int8)
        i = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[i] == keys, self.values[i], 0).astype(np.int8)


def _collected(df: DataFrame, most: int) -> pa.Table | None:
    """The rows as an Arrow table, or None where they are more than ``most``."""
    found = df.limit(most + 1).toArrow()
    return found if found.num_rows <= most else None


def _with_roles(pages: DataFrame, roles: DataFrame, most: int) -> tuple[DataFrame, tuple[_Table, _Table, _Table] | None]:
    """Roles for the items of ``pages``: as tables to send where they have at most ``most`` entries, else joined as columns (role, lost) beside ``tok``."""
    wanted = roles.where("(role = 1 AND (n > 1 OR NOT from_host)) OR (role = -1 AND outside > 0)")
    spread = roles.where("role <> 0").groupBy("token").agg(F.min("role").alias("least"), F.max("role").alias("role")).where("least = role")
    same = wanted.select("token").distinct().join(spread.select("token", "role"), "token")
    apart = wanted.join(spread, "token", "left_anti").select("host", "token", "role")
    lost = roles.where("contentless").select("token").distinct()
    parts = [_collected(df, most) for df in (same, apart, lost)]
    if all(p is not None for p in parts):
        a, b, c = parts
        number = lambda t, n: t.column(n).to_numpy()
        hosts = b.column("host").combine_chunks().dictionary_encode() if b.num_rows else None
        keys = _host_key(hosts.dictionary.to_pylist(), hosts.indices.to_numpy(), number(b, "token")) if hosts is not None else np.zeros(0, np.uint64)
        return pages, (_Table(number(a, "token"), number(a, "role")), _Table(keys, number(b, "role")), _Table(number(c, "token")))
    items = pages.select("kind", "id", "host", F.posexplode("tok").alias("pos", "token"))
    items = items.join(roles.where("role <> 0").select("host", "token", "role"), ["host", "token"], "left").join(lost.withColumn("lost", F.lit(1)), "token", "left")
    by_page = items.groupBy("kind", "id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("role", F.lit(0)).cast("byte").alias("role"), F.coalesce("lost", F.lit(0)).cast("byte").alias("lost")))).alias("x"))
    empty = F.array().cast("array<byte>")
    return pages.join(by_page, ["kind", "id"], "left").withColumns({"role": F.coalesce("x.role", empty), "lost": F.coalesce("x.lost", empty)}).drop("x"), None


def _words_of_pages(pages: DataFrame) -> DataFrame:
    """(kind, id, token): the words of pages that don't show their title, and those beside placeholders."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, ids, words = [], [], []
            for kind, rid, texts, near in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                mine = {key_of(w) for t in texts or () for w in _WORD.findall(t.lower())} | set(near)
                kinds += [kind] * len(mine)
                ids += [rid] * len(mine)
                words += mine
            yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.string()), pa.array(ids, pa.int64()), pa.array(words, pa.int64())], names=["kind", "id", "token"])

    return pages.select("kind", "id", "texts", "near").where("texts IS NOT NULL OR size(near) > 0").mapInArrow(run, "kind string, id long, token long")


def _with_words(pages: DataFrame, words: DataFrame, most: int) -> tuple[DataFrame, _Table | None]:
    """Which words titled pages use: as a table to send where they are at most ``most``, else as a column (known) of the page's own ones."""
    sent = _collected(words, most)
    if sent is not None:
        return pages, _Table(sent.column("token").to_numpy())
    mine = _words_of_pages(pages).join(words, "token", "left_semi").groupBy("kind", "id").agg(F.collect_set("token").alias("known"))
    return pages.join(mine, ["kind", "id"], "left"), None


def _with_slots(pages: DataFrame, slots: DataFrame, most: int) -> tuple[DataFrame, dict | None]:
    """What the slots hold that some line leaves unfilled: as a table to send where they are at most ``most``, else as a column (held) beside the page's own faulty ones."""
    sent = _collected(slots, most)
    if sent is not None:
        return pages, {(h, k): v for h, k, v in zip(*(sent.column(c).to_pylist() for c in ("host", "label", "holds")), strict=True)}
    faulty = pages.select("kind", "id", "host", F.explode(F.arrays_zip("slot", "fill")).alias("s")).where(f"s.fill >= {_BLANK}").select("kind", "id", "host", F.col("s.slot").alias("label")).distinct()
    every = slots.where("host = ''").select("label", F.col("holds").alias("every"))
    found = faulty.join(slots, ["host", "label"], "left").join(every, "label", "left").withColumn("holds", F.coalesce("holds", "every")).where("holds IS NOT NULL")
    mine = found.groupBy("kind", "id").agg(F.map_from_entries(F.collect_list(F.struct("label", "holds"))).alias("held"))
    return pages.join(mine, ["kind", "id"], "left"), None


def labelled_pages(fetched: DataFrame, listings: DataFrame, most_sent: int = 2_000_000) -> DataFrame:
    """(record_type, record_id, furniture array<long>, residue boolean, reason): every record with text once.

    The texts are read once; what follows works on arrays of tokens: one
    pre-aggregated shuffle of token counts, classes and their roles by host, and a
    narrow map that labels lines and pages. Roles, words and slots are broadcast
    as 9-byte entries where they are at most ``most_sent`` each, and joined
    beyond that, with the same result. Whole texts are read; NULL and empty texts give no
    row, ties between furniture and content leave a line in the content, repeated
    rows are each labelled.
    """
    read = cut(read_pages(page_records(fetched, listings)))
    evidence = cut(token_evidence(read))
    return label(read.where("kind <> ''"), evidence, most_sent)


def label(pages: DataFrame, evidence: DataFrame, most_sent: int = 2_000_000) -> DataFrame:
    """Second half of ``labelled_pages``: from pages as read and their evidence."""
    pages, sent_roles = _with_roles(pages, cut(template_tokens(evidence)), most_sent)
    pages, sent_words = _with_words(pages, evidence.where("host = '' AND n >= 2").select("token"), most_sent)
    pages, holds = _with_slots(pages, induced_slots(evidence).where("holds > 0"), most_sent)
    shared = pages.sparkSession.sparkContext.broadcast((sent_roles, sent_words, holds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roles, words, holds = shared.value
        for batch in batches:
            yield _labelled(batch, roles, words, holds)

    return pages.mapInArrow(run, "record_type string, record_id long, furniture array<long>, residue boolean, reason string")


def _labelled(batch: pa.RecordBatch, roles: tuple | None, words: _Table | None, holds: dict | None) -> pa.RecordBatch:
    code, hosts = _codes(batch)
    no, page = _flat(batch, "no")
    place, _ = _flat(batch, "place")
    flag, _ = _flat(batch, "flag")
    tok, of = _flat(batch, "tok")
    at, _ = _flat(batch, "at")
    starts = _starts(batch)
    line = at + starts[of] if len(at) else np.zeros(0, int)
    if roles is None:
        role, lost = _flat(batch, "role")[0], _flat(batch, "lost")[0] > 0
    else:
        same, apart, gone = roles
        role, lost = same.get(tok), gone.get(tok) > 0
        role = np.where(role != 0, role, apart.get(_host_key(hosts, code[of], tok)))
    n = len(no)
    count = lambda keep: np.bincount(line[keep], minlength=n)
    items = np.bincount(line, minlength=n)
    template = (items > 0) & (count(role == 1) == items)
    furniture = (place >= 0) & template | (place > 0) & (count(role == -1) == 0)
    empty = furniture | template | (flag & (_UNSET_FLAG | _FILLER_FLAG) > 0) | (count(lost) == items)
    heading = batch.column("heading").to_numpy()
    open_lines = np.flatnonzero(~empty & (heading[page] < 1))
    texts, known = batch.column("texts"), batch.column("known") if words is None else None
    content = np.bincount(page[~empty & (heading[page] == 1)], minlength=batch.num_rows) > 0
    for i in open_lines:
        p = page[i]
        if not content[p]:
            found = [key_of(w.lower()) for w in _WORD.findall(texts[p][i - starts[p]].as_py())]
            content[p] = not found or int(_known(found, words, known, p).sum()) > 0.4 * len(found)
    reason = np.full(batch.num_rows, None, object)
    bad = np.bincount(page[~furniture & ~template & empty], minlength=batch.num_rows) > 0
    some = np.diff(batch.column("no").offsets.to_numpy()) > 0
    reason[~content & some] = "notice only"
    reason[~content & bad] = "no content"
    reason[np.unique(page[(flag & _UNSET_FLAG > 0) & ~furniture])] = "unset"
    slot, of_slot = _flat(batch, "slot")
    fill, _ = _flat(batch, "fill")
    slot_at, _ = _flat(batch, "slot_at")
    for j in np.flatnonzero(fill >= _BLANK):
        p = of_slot[j]
        name, least = _FAULTS[int(fill[j])]
        k = int(slot[j])
        held = holds.get((hosts[code[p]], k), holds.get(("", k), 0)) if holds is not None else dict(batch.column("held")[int(p)].as_py() or ()).get(k, 0)
        if not furniture[slot_at[j] + starts[p]] and reason[p] is None and held >= least:
            reason[p] = name
    for p in np.unique(page[flag & _PLACEHOLDER_FLAG > 0]):
        near = batch.column("near")[p].as_py()
        reason[p] = NAME if near and _known(near, words, known, p).all() else "placeholder"
    chosen = np.flatnonzero(furniture)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(page[chosen], minlength=batch.num_rows)))).astype(np.int32)
    lines = pa.ListArray.from_arrays(pa.array(offsets), pa.array(no[chosen], pa.int64()))
    return pa.RecordBatch.from_arrays(
        [batch.column("kind"), batch.column("id"), lines, pa.array([r is not None for r in reason], pa.bool_()), pa.array(list(reason), pa.string())], names=["record_type", "record_id", "furniture", "residue", "reason"]
    )


def _known(keys: list[int], words: _Table | None, own: pa.Array | None, page: int) -> np.ndarray:
    if words is not None:
        return words.get(np.array(keys, np.int64)) > 0
    mine = set(own[page].as_py() or ())
    return np.array([k in mine for k in keys])


def furniture_lines(pages: DataFrame) -> DataFrame:
    """(record_type, record_id, line_no) of the lines outside the main body; residue records are left out."""
    return pages.where("NOT residue").select("record_type", "record_id", F.explode("furniture").alias("line_no"))


def residue_records(pages: DataFrame) -> DataFrame:
    """(record_type, record_id) of the records that hold placeholders, unset values, filler or messages in place of content."""
    return pages.where("residue").select("record_type", "record_id").distinct()


def main_text(pages: DataFrame, fetched: DataFrame, listings: DataFrame) -> DataFrame:
    """(record_type, record_id, text): the visible lines of the main body, in order; residue records have NULL."""
    texts = listings.select(F.lit("raw").alias("record_type"), F.col("raw_id").cast("long").alias("record_id"), F.col("raw_text").alias("text"))
    texts = texts.union(fetched.select(F.lit("fetch"), F.col("fetch_id").cast("long"), "text"))
    joined = pages.join(texts, ["record_type", "record_id"])
    lines = F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("furniture", i.cast("long")))
    bare = F.transform(lines, lambda x: F.trim(F.regexp_replace(x, r"(?s)<script.*?</script>|</?[a-zA-Z][^<>]*>|<![^<>]*>", "")))
    return joined.select("record_type", "record_id", F.when(~F.col("residue"), F.array_join(F.filter(bare, lambda x: x != ""), "\n")).alias("text"))


def host_templates(fetched: DataFrame, listings: DataFrame) -> DataFrame:
    """(host, class_id, gaps, role, size, n_pages, parent): each host's template. gaps names the cells of the class, parent the smallest class into which it nests.

    A class nests into another if every page that has it has the other too
    (containment, counted page by page) and in at least nine of ten of them lies
    within the other's first and last line (position). Classes are at most one a
    bit pattern of CELLS, so the pairs of one page are bounded; they are summed by
    host before they meet.
    """
    read = cut(read_pages(page_records(fetched, listings)))
    evidence = cut(token_evidence(read))
    tokens = token_classes(evidence)
    roles = cut(class_roles(tokens))
    items = read.where("kind <> ''").select("kind", "id", "host", F.posexplode("tok").alias("pos", "token"), "at").withColumn("line", F.get("at", F.col("pos")))
    spans = items.join(tokens.select("host", "token", "vector"), ["host", "token"]).groupBy("kind", "id", "host", "vector").agg(F.min("line").alias("first"), F.max("line").alias("last"))
    page = spans.groupBy("kind", "id", "host").agg(F.collect_list(F.struct("vector", "first", "last")).alias("v"))
    pair = page.select("host", F.explode("v").alias("a"), "v").select("host", "a", F.explode("v").alias("b"))
    inside = (F.col("a.first") >= F.col("b.first")) & (F.col("a.last") <= F.col("b.last"))
    both = pair.groupBy("host", F.col("a.vector").alias("vector"), F.col("b.vector").alias("outer")).agg(F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("within"))
    n = both.where("vector = outer").select("host", "vector", F.col("n").alias("n_pages"))
    nested = both.where("vector <> outer").join(n, ["host", "vector"]).where("n = n_pages AND within * 10 >= n * 9")
    nested = nested.join(n.select("host", F.col("vector").alias("outer"), F.col("n_pages").alias("outer_pages")), ["host", "outer"])
    # of classes on the very same pages the one with the smaller pattern is the outer one
    parent = nested.where("outer_pages > n_pages OR outer < vector").groupBy("host", "vector").agg(F.min(F.struct("outer_pages", "outer")).alias("m")).select("host", "vector", F.col("m.outer").alias("parent"))
    name = lambda c: F.concat(F.lit("g"), F.col(c).cast("string"))
    gaps = F.array_join(F.filter(F.array(*[F.when(F.col("vector").bitwiseAND(1 << i) != 0, c) for i, c in enumerate(CELLS)]), lambda x: x.isNotNull()), ", ")
    out = roles.join(n, ["host", "vector"]).join(parent, ["host", "vector"], "left")
    return out.select("host", name("vector").alias("class_id"), gaps.alias("gaps"), F.when(F.col("role") > 0, "furniture").when(F.col("role") < 0, "content").otherwise("open").alias("role"), "size", "n_pages", name("parent").alias("parent"))
