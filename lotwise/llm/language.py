"""P6: the language or languages of each text and of its segments.

Compression classification: a segment belongs to the language whose zstandard
raw-content dictionary lets it be written in the fewest bytes; a narrow margin
over the second-best language is a rejection.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lotwise.llm.characters import with_canonical

# Three-letter codes (639-2, both forms, and 639-3) of the languages told apart.
THREE_LETTERS = {"deu": "de", "ger": "de", "eng": "en", "fra": "fr", "fre": "fr", "ita": "it", "spa": "es", "nld": "nl", "dut": "nl", "pol": "pl", "por": "pt"}
UNDETERMINED = ("", "und", "unk", "mul", "zxx", "mis", "xx", "unknown", "none", "null", "?", "-")

_SENTENCE = re.compile(r"(?<=[.!?…])[\"'»)]*\s+|\n+")
_LETTERS = re.compile(r"[^\W\d_]{2,}")
_DIGITS = re.compile(r"\d[\d.,'’  ]*")
_CODE = re.compile(r"(?:\b(?:Ref|ID|Nr|No)\b\.?|[#(])\s*[A-Z0-9]{3,6}\)?|\b(?=[A-Z]*\d)(?=\d*[A-Z])[A-Z0-9]{4,6}\b")
_DIGIT = re.compile(r"\d")
_MARKED = re.compile(r"[\d#]|\b(?:Ref|ID|Nr|No)\b")
LEVEL = 1
SURE = 0.4  #: confidence from which a segment alone establishes a language of its text
SECOND = 0.65  #: the same for a further language beside a surer one, if the segment has numbers or fewer than six words: lists of facts share words across languages


def label_code(label: Column) -> Column:
    """Two-letter code of a language label in any spelling (region, case, separator, three letters); NULL for missing or undetermined ones. Unknown labels keep their primary subtag."""
    main = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z?\-]*?)(?:[_\-].*)?$", 1)
    mapped = F.create_map(*[F.lit(x) for kv in THREE_LETTERS.items() for x in kv])
    return F.when(label.isNotNull() & ~main.isin(*UNDETERMINED), F.coalesce(F.try_element_at(mapped, main), main))


def segments_of(text: str | None) -> list[str]:
    """Sentences of a text; neighbouring fragments of fewer than five words (lists of facts) form one segment."""
    out: list[str] = []
    loose = False
    for part in _SENTENCE.split(text or ""):
        part = part.strip()
        if not part:
            continue
        short = len(part) < 70 and len(_LETTERS.findall(part)) < 5
        if short and loose:
            out[-1] += " " + part
        else:
            out.append(part)
        loose = short
    return out


def plain(segment: str) -> str:
    """What is compressed: lower case, item codes dropped, numbers as 0, single spaces."""
    if _MARKED.search(segment):
        segment = _DIGITS.sub("0 ", _CODE.sub(" ", segment))
    return " ".join(segment.lower().split())


class Classifier:
    """Smallest compressed size over one raw-content dictionary per language.

    Segments of fewer than ``least_words`` words or a margin under ``least_margin``
    are rejected; a segment of fewer than ``sentence_words`` is a fragment (a name,
    a list entry): it has a language of its own, but doesn't establish one of its text.
    """

    def __init__(self, dictionaries: dict[str, bytes], least_words: int = 3, least_margin: float = 0.05, sentence_words: int = 4):
        import zstandard

        self.dictionaries = dictionaries
        self.least_words, self.least_margin, self.sentence_words = least_words, least_margin, sentence_words
        self.by: list[tuple[str, object]] = []
        for lang in sorted(dictionaries):
            d = zstandard.ZstdCompressionDict(dictionaries[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append((lang, zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False, write_checksum=False)))

    def classify(self, segment: str) -> tuple[str | None, float]:
        """(language or None, confidence): confidence is one minus the ratio of the smallest to the second-smallest size without the frame, scaled to 0..1."""
        key = plain(segment)
        if len(_LETTERS.findall(key)) < self.least_words or len(self.by) < 2:
            return None, 0.0
        data = key.encode()
        sizes = sorted((len(c.compress(data)) - 9, lang) for lang, c in self.by)
        best, second = max(1, sizes[0][0]), max(1, sizes[1][0])
        margin = (second - best) / second
        if margin < self.least_margin or second - best < 2:
            return None, round(margin, 4)
        return sizes[0][1], round(min(1.0, margin * 2), 4)


def dictionaries(texts: list[str], langs: list[str], size: int = 100_000) -> dict[str, bytes]:
    """One dictionary of at most ``size`` bytes per language from labelled texts.

    Labels are per document and documents may quote other languages, so a
    sentence is kept only where its own words, counted over the labels, agree
    with its document's label. Sentences are kept once, the most frequent ones first of all.
    """
    per: dict[str, list[str]] = defaultdict(list)
    words: dict[str, Counter] = defaultdict(Counter)
    for t, lang in zip(texts, langs, strict=True):
        lines = [plain(re.sub(r"^[>*\-\s]*(?:\w+_\w+:)?[>*\-\s]*", "", s)) for s in _SENTENCE.split(t)]
        per[lang] += lines
        words[lang].update({w for s in lines for w in _LETTERS.findall(s)})
    n_docs = Counter(langs)
    out = {}
    for lang, lines in per.items():
        kept = []
        often = Counter(lines)
        for s in sorted(often, key=lambda x: (often[x], hash_of(x), x)):  # the most frequent last: nearest to the text and never cut off
            ws = _LETTERS.findall(s)
            if len(ws) < 2:
                continue
            score = {k: sum(math.log((c[w] + 0.2) / (n_docs[k] + 1)) for w in ws) for k, c in words.items()}
            if max(score, key=score.__getitem__) == lang:
                kept.append(s)
        data = "\n".join(kept).encode()[-size:]
        if len(data) >= 64:
            out[lang] = data
    return out


def hash_of(text: str) -> int:
    """A stable hash, the same in every process."""
    import xxhash

    return xxhash.xxh64_intdigest(text)


def learned(documents: DataFrame, languages: tuple[str, ...] = ("de", "en", "es", "fr", "it", "nl", "pl", "pt"), most_docs: int = 500) -> Classifier:
    """A classifier from at most ``most_docs`` labelled documents per language, chosen by hash of the doc_id (of the text where there is none) in one pass over ids and one over texts."""
    # ids first, without their texts; Spark keeps no more than most_docs of a language in a task before the shuffle (window group limit)
    key = F.xxhash64("doc_id" if "doc_id" in documents.columns else "text").alias("key")
    ids = documents.where("text IS NOT NULL").select(key, label_code(F.col("lang")).alias("lang")).where(F.col("lang").isin(*languages))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = ids.withColumn("place", place).where(F.col("place") <= most_docs).groupBy("key").agg(F.min("lang").alias("label"))
    # at most most_docs times the number of languages
    sample = documents.where("text IS NOT NULL").select(key, "text").join(F.broadcast(chosen), "key").select("text", F.col("label").alias("lang"))
    rows = sorted(with_canonical_keep_lines(sample).collect())
    return Classifier(dictionaries([r["text"] for r in rows], [r["lang"] for r in rows]))


def with_canonical_keep_lines(df: DataFrame) -> DataFrame:
    """Canonical characters of ``text`` with its line breaks kept."""
    marked = df.withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ¶ "))
    return with_canonical(marked, "text", "text").withColumn("text", F.replace("text", F.lit(" ¶ "), F.lit("\n")))


def segment_languages(texts: DataFrame, classifier: Classifier | dict[str, bytes]) -> DataFrame:
    """(kind, id, text) -> (kind, id, langs, segments): the languages of each text and, per segment, language and confidence.

    A narrow Arrow map over all rows and whole texts; segments that recur within a
    task are compressed once. Texts without a decided segment have an empty list;
    NULL texts give no row.
    """
    settings = classifier if isinstance(classifier, dict) else classifier.dictionaries
    shared = texts.sparkSession.sparkContext.broadcast(settings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Classifier(shared.value)
        seen: dict[str, tuple[str | None, float]] = {}
        for batch in batches:
            langs, segs = [], []
            if len(seen) > 300_000:
                seen.clear()
            for text in batch.column(2).to_pylist():
                found: dict[str, float] = {}
                further: set[str] = set()
                rows = []
                for s in segments_of(text):
                    if s not in seen:
                        key = plain(s)
                        if key not in seen:
                            seen[key] = net.classify(key)
                        seen[s] = seen[key]
                    lang, sure = seen[s]
                    rows.append({"segment": s, "lang": lang, "confidence": sure})
                    if lang and s.count(" ") + 1 >= net.sentence_words:
                        found[lang] = max(sure, found.get(lang, 0.0))
                        if sure >= SECOND or (sure >= SURE and not _DIGIT.search(s) and len(_LETTERS.findall(s)) >= 6):
                            further.add(lang)
                # a language needs one sure segment, or to be the likeliest of a text that has none
                first = sorted(found, key=lambda x: (-found[x], x))[:1]
                decided = first + [x for x in further if x not in first]
                langs.append(sorted(decided))
                segs.append(rows)
            kind = pa.list_(pa.struct([("segment", pa.string()), ("lang", pa.string()), ("confidence", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.list_(pa.string())), pa.array(segs, kind)], names=["kind", "id", "langs", "segments"])

    schema = "kind string, id long, langs array<string>, segments array<struct<segment:string,lang:string,confidence:double>>"
    return texts.where("text IS NOT NULL").select("kind", F.col("id").cast("long"), "text").mapInArrow(run, schema)


def wrong_labels(hits: DataFrame, listings: DataFrame, documents: DataFrame) -> DataFrame:
    """(record_type, record_id, lang): the languages of snippets whose label is missing, undetermined, another language or only one of several, and of all unlabelled descriptions.

    Texts without a decided language give no row; repeated rows are each judged.
    """
    snippets = hits.where("snippet IS NOT NULL").select(F.lit("hit").alias("kind"), F.col("hit_id").alias("id"), "snippet", label_code(F.col("language")).alias("label"))
    texts = snippets.select(F.concat_ws("|", "kind", F.coalesce("label", F.lit(""))).alias("kind"), "id", F.col("snippet").alias("text"))
    texts = texts.union(listings.where("description IS NOT NULL").select(F.lit("raw|"), "raw_id", "description"))
    found = segment_languages(with_canonical_keep_lines(texts), learned(documents)).select("kind", "id", "langs")
    label = F.split("kind", r"\|")[1]
    right = (F.split("kind", r"\|")[0] == "hit") & (F.size("langs") == 1) & F.array_contains("langs", label)
    return found.where(~right).select(F.split("kind", r"\|")[0].alias("record_type"), F.col("id").alias("record_id"), F.explode("langs").alias("lang")).distinct()


def text_segments(hits: DataFrame, listings: DataFrame, classifier: Classifier | dict[str, bytes]) -> DataFrame:
    """(record_type, record_id, segment_no, lang, confidence): every segment of every snippet and description; an undecided segment has NULL and its confidence."""
    texts = hits.select(F.lit("hit").alias("kind"), F.col("hit_id").alias("id"), F.col("snippet").alias("text"))
    texts = texts.union(listings.select(F.lit("raw"), "raw_id", "description"))
    found = segment_languages(with_canonical_keep_lines(texts), classifier)
    rows = found.select(F.col("kind").alias("record_type"), F.col("id").alias("record_id"), F.posexplode("segments").alias("segment_no", "s"))
    return rows.select("record_type", "record_id", "segment_no", "s.lang", "s.confidence")
