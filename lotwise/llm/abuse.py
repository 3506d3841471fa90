"""P10: abusive, hateful and sexual content.

A window classifier (recurrent.py) is trained on the labelled documents, whose
labels say only that some passage is abusive and are partly wrong: in each
labelled positive the most suspicious window is the positive example, chosen
anew as the network learns. All overlapping windows of every document are scored.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotwise.llm.characters import with_canonical
from lotwise.llm.recurrent import WindowClassifier
from lotwise.session import cut

WINDOW, STRIDE = 20, 10  #: words of a window, and between the starts of two
WORD_CHARS = 16  #: letters of a word that the network reads at once
SHORT = 3  #: words up to which a sentence is read together with the one before it
_BREAK = re.compile(r"(?<=[.!?…])[\"'»)]*\s+|\n+")
_TOKEN = re.compile(r"(?:[@$](?=[^\W\d_]))?[^\W_](?:[^\W_]|[*@$'’#](?=[\w*@$#]))*[*@$]?")
_SPACED = re.compile(r"(?<!\w)[^\W\d_](?:([.\-_*· ])[^\W\d_])(?:\1[^\W\d_]){2,}(?!\w)")
_REPEATED = re.compile(r"([^\W\d_])\1{2,}")
_LEET = str.maketrans({"@": "a", "$": "s", "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t"})
_SPEAKER = re.compile(r"^\s*[\w\-]+_\w+:\s*")


def plain_words(text: str) -> list[str]:
    """Words of one passage, lower case, with spelling tricks undone: spaced-out letters, drawn-out letters, digits and signs for letters. Masked letters (*) stay. Numbers, with or without a unit, become 0."""
    text = _SPACED.sub(lambda m: re.sub(r"[.\-_*· ]", "", m[0]), text)
    out = []
    for w in _TOKEN.findall(text.lower()):
        if w[0].isdigit():
            out.append("0")
            continue
        if any(c in w for c in "@$013457") and sum(c.isalpha() for c in w) >= 2:
            w = w.translate(_LEET)
        w = _REPEATED.sub(r"\1", w)
        # long compounds are read in overlapping pieces
        out += [w] if len(w) <= WORD_CHARS else [w[k : k + WORD_CHARS] for k in range(0, len(w) - WORD_CHARS // 2, WORD_CHARS // 2)]
    return out


def windows_of(text: str | None) -> list[tuple[str, ...]]:
    """All windows of a canonical text: its sentences, those longer than a window as overlapping windows, and each short sentence without numbers once more together with the end of the one before it on its line."""
    out: list[tuple[str, ...]] = []
    for block in (text or "").split("\n"):
        before: list[str] = []
        for line in _BREAK.split(block):
            words = plain_words(_SPEAKER.sub("", line))
            if not words:
                continue
            if len(words) <= WINDOW:
                out.append(tuple(words))
            else:
                out += [tuple(words[k : k + WINDOW]) for k in range(0, max(1, len(words) - WINDOW + STRIDE), STRIDE)]
            if before and len(words) <= SHORT and "0" not in words:
                out.append(tuple((before + words)[-WINDOW:]))
            before = words
    return out


def _lift(docs: list[list[tuple[str, ...]]], labels: np.ndarray) -> dict[str, float]:
    """Smoothed log odds of a word's documents being positive, minus the prior's."""
    pos, all_ = Counter(), Counter()
    for ws, y in zip(docs, labels, strict=True):
        seen = {x for w in ws for x in w}
        all_.update(seen)
        if y:
            pos.update(seen)
    prior = max(labels.mean(), 1e-3)
    return {w: math.log((pos[w] + 3 * prior) / (n - pos[w] + 3 * (1 - prior))) - math.log(prior / (1 - prior)) for w, n in all_.items()}


def _masked(rng: np.random.Generator, window: tuple[str, ...], suspicious: dict[str, float]) -> tuple[str, ...]:
    """The window with the letters of its most suspicious word masked, as writers do to get past word lists."""
    i = max(range(len(window)), key=lambda k: suspicious.get(window[k], 0.0) if len(window[k]) > 3 else -9.0)
    w = window[i]
    if len(w) < 4:
        return window
    hidden = w[0] + "*" * (len(w) - 2) + w[-1] if rng.random() < 0.5 else w[:1] + "*" + w[2:]
    return (*window[:i], hidden, *window[i + 1 :])


def rarity(window: tuple[str, ...], common: frozenset[str] | set[str]) -> float:
    """Share of the window's words that few documents of the corpus use."""
    return sum(w not in common for w in window) / max(3, len(window))


def train(texts: list[str], labels: list[int], common: set[str] | frozenset[str] = frozenset(), epochs: int = 24, negatives: int = 3500, batch: int = 256, rate: float = 0.006, seed: int = 7, most_words: int = 20_000, most_letters: int = 120, pool: int = 8000, most_hard: int = 800) -> tuple[WindowClassifier, float]:
    """A classifier of windows from canonical texts with document labels, and the score from which a document counts as abusive.

    Only some window of a positive document is the positive one: at first the one
    with the rarest words (``common`` holds the words of the corpus' everyday
    sentences) and most telling ones, later the one the network finds. Every
    epoch sees at most ``negatives`` windows of negative documents, most of them of rare words. Words that
    the labels show to stand in abuse are no everyday words, however frequent.
    Positives of nothing but everyday sentences wait until the network finds
    them, or take part at once where there are no others. Positives whose
    best window stays unlikely, and near-certain windows of negatives, are taken
    as labelling mistakes and left out. Without both labels a classifier that
    finds nothing is returned.

    Bounds of the fit, which scoring doesn't have: words beyond the ``most_words``
    most frequent are known by their letters only, letters beyond ``most_letters``
    are one letter; negatives still taken for positives are looked for among the
    ``pool`` most frequent everyday windows and all unusual ones, and at most
    ``most_hard`` of each are added to an epoch.
    """
    rng = np.random.default_rng(seed)
    docs = [windows_of(t) for t in texts]
    y = np.array([bool(v) and bool(d) for v, d in zip(labels, docs, strict=True)], bool)
    spread = Counter(x for d in docs for x in {z for w in d for z in w})
    vocabulary = [w for w, n in spread.most_common(most_words) if n >= 2]
    alphabet = "".join(c for c, _ in Counter(c for w in spread for c in w).most_common(most_letters))
    model = WindowClassifier(vocabulary, alphabet, seed)
    if not y.any() or y.all():
        return model, 2.0
    lift = _lift(docs, y)
    held = Counter(x for ws in {t: d for t, d, v in zip(texts, docs, y, strict=True) if v}.values() for x in {z for w in ws for z in w})
    common = {w for w in common if held[w] < 5 or lift[w] < math.log(4)}
    benign = Counter(w for d, v in zip(docs, y, strict=True) if not v for w in set(d))
    unusual = sorted(w for w in benign if rarity(w, common) >= 0.2)
    everyday = sorted((w for w in benign if rarity(w, common) < 0.2), key=lambda w: (-benign[w], w))
    hard: list[tuple[str, ...]] = []  # negatives that the network still takes for positives
    positive_docs = [d for d, v in zip(docs, y, strict=True) if v]
    prior = [[2 * rarity(w, common) + sum(sorted((lift.get(x, 0.0) for x in w), reverse=True)[:3]) / 9 - 0.5 * min(3, benign[w]) for w in d] for d in positive_docs]
    plain = np.array([all(rarity(w, common) < 0.25 for w in d) for d in positive_docs])
    least = np.where(plain & ~plain.all(), 0.6, 0.3)  # the score from which a positive is believed
    rank, trust, doubtful, state = prior, (least < 0.6).astype(float), set(), {}
    for epoch in range(epochs):
        chosen = [d[int(np.argmax(r))] for d, r in zip(positive_docs, rank, strict=True)]
        pos = [w for w, t in zip(chosen, trust, strict=True) if t > 0]
        pos += [_masked(rng, w, lift) for w in pos if rng.random() < 0.3]
        kept = [w for w in unusual if w not in doubtful]
        sample = lambda of, k: [of[i] for i in rng.choice(len(of), size=min(k, len(of)), replace=False)]
        neg = sample(kept, negatives * 5 // 7) + sample(everyday, negatives * 2 // 7) + hard
        weight = max(1, len(neg)) / max(1, len(pos)) / 3  # positives weigh a third of the negatives, however many there are
        rows = sorted([(w, 1.0, weight) for w in pos] + [(w, 0.0, 1.0) for w in neg], key=lambda r: (len(r[0]), rng.random()))
        size = min(batch, max(16, len(rows) // 8))
        blocks = [rows[k : k + size] for k in range(0, len(rows), size)]
        for b in rng.permutation(len(blocks)):
            ws, ys, ts = zip(*blocks[b], strict=True)
            _, g = model.loss_and_gradient([list(w) for w in ws], np.array(ys, np.float32), np.array(ts, np.float32))
            model.adam(g, state, rate * min(1.0, 2.2 - 2 * epoch / epochs))
        if epoch >= 4 and epoch % 4 == 0:
            ends = np.cumsum([len(d) for d in positive_docs])[:-1]
            scores = np.split(model.score([list(w) for d in positive_docs for w in d]), ends)
            rank = [[float(s) + 0.3 * q for s, q in zip(sc, qs, strict=True)] for sc, qs in zip(scores, prior, strict=True)]
            mined = everyday[:pool]
            hard = [w for w, sc in zip(mined, model.score([list(w) for w in mined]), strict=True) if sc > 0.2][:most_hard]
            if epoch >= 8:
                trust = np.array([1.0 if sc.max() > z else 0.0 for sc, z in zip(scores, least, strict=True)])
                worst = model.score([list(w) for w in unusual])
                doubtful = {w for w, sc in zip(unusual, worst, strict=True) if sc > 0.8 and benign[w] <= 2}
                hard += [w for w, sc in zip(unusual, worst, strict=True) if sc > 0.2 and w not in doubtful][:most_hard]
    return model, _threshold(model, docs, y)


def _threshold(model: WindowClassifier, docs: list[list[tuple[str, ...]]], y: np.ndarray) -> float:
    """The score with the best balance of precision and recall on the labelled documents, in the middle of its gap."""
    best = np.array([model.score([list(w) for w in d]).max() if d else 0.0 for d in docs])
    order = np.argsort(-best)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    k = int(np.argmax(f1))
    above, below = float(best[order[k]]), float(best[order[k + 1]]) if k + 1 < len(order) else 0.0
    return float(np.clip((above + below) / 2, 0.3, 0.8))


class Committee:
    """Networks that differ in their first weights only, and the score from which a document counts as abusive: what a single one takes from chance the others don't share."""

    def __init__(self, models: list[WindowClassifier], threshold: float, sure: float = 0.2):
        self.models, self.threshold, self.sure = models, threshold, sure

    def score(self, windows: list[list[str]]) -> np.ndarray:
        """Mean of the networks' probabilities. A window that the first network holds under ``sure`` has that network's share only; no mean of it could reach a threshold of 2/3 or more by much."""
        first = self.models[0].score(windows)
        open_ = np.flatnonzero(first >= self.sure)
        out = first / len(self.models)
        if len(open_):
            chosen = [windows[i] for i in open_]
            out[open_] = np.mean([first[open_], *(m.score(chosen) for m in self.models[1:])], axis=0)
        return out


def _best(model: WindowClassifier, texts: list[str]) -> np.ndarray:
    """Score of the worst window of each text."""
    docs = [windows_of(t) for t in texts]
    scores = iter(model.score([list(w) for d in docs for w in d]).tolist())
    return np.array([max((next(scores) for _ in d), default=0.0) for d in docs])


def fitted(spark: SparkSession, texts: list[str], labels: list[int], common: set[str], networks: int = 3, believed: float = 0.5, denied: float = 0.9, least_share: float = 0.6) -> Committee:
    """A committee of ``networks`` classifiers on one labelled sample, each trained in a task of its own.

    Labels are partly wrong, and a network learns a wrong one by heart. So each
    label is first judged by a network that hasn't seen it: positives that score
    under ``believed`` and negatives that score over ``denied`` there are left out
    of the final fit. Judges that believe less than ``least_share`` of the positives
    know too little of the language of abuse to judge; then all labels are taken.
    """
    order = np.random.default_rng(3).permutation(len(texts))
    fold = np.empty(len(texts), np.int64)
    fold[order] = np.arange(len(texts)) % networks
    shared = spark.sparkContext.broadcast((texts, labels, common, fold))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, common, fold = shared.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                inside, outside = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
                model, _ = train([texts[i] for i in inside], [labels[i] for i in inside], common, seed=7 + k)
                yield pa.RecordBatch.from_arrays([pa.array(outside), pa.array(_best(model, [texts[i] for i in outside]), pa.float64())], names=["i", "score"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, labels, common, _ = shared.value
        chosen = kept.value
        for batch in batches:
            for k in batch.column(0).to_pylist():
                model, threshold = train([texts[i] for i in chosen], [labels[i] for i in chosen], common, seed=7 + k)
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([pickle.dumps(model)], pa.binary()), pa.array([threshold])], names=["k", "model", "threshold"])

    seeds = spark.range(0, networks, numPartitions=networks)
    judged = {r["i"]: r["score"] for r in seeds.mapInArrow(judge, "i long, score double").collect()}
    sound = [i for i, y in enumerate(labels) if (judged[i] >= believed if y else judged[i] < denied)]
    able = sum(labels[i] for i in sound) >= max(1, least_share * sum(labels))
    kept = spark.sparkContext.broadcast(sound if able else list(range(len(labels))))
    done = seeds.mapInArrow(fit, "k long, model binary, threshold double").orderBy("k").collect()
    return Committee([pickle.loads(bytes(r["model"])) for r in done], float(np.mean([r["threshold"] for r in done])))


def labelled_sample(documents: DataFrame, labels: DataFrame, most: int = 5000) -> tuple[list[str], list[int]]:
    """Texts and labels to fit on: at most ``most`` labelled documents, chosen by hash of the id. Several judgements of one document count as their majority."""
    judged = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.avg("toxic").alias("toxic"))
    known = documents.where("text IS NOT NULL").select("doc_id").join(judged, "doc_id")
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # ids and labels only
    rows = documents.where("text IS NOT NULL").select("doc_id", "text").join(chosen.dropDuplicates(["doc_id"]), "doc_id")
    found = sorted(with_canonical_lines(rows).select("doc_id", "text", "toxic").collect())
    return [r["text"] for r in found], [int(r["toxic"] > 0.5) for r in found]


def with_canonical_lines(df: DataFrame) -> DataFrame:
    """Canonical characters with the line breaks kept: breaks are carried through as a mark that no canonical form changes."""
    return with_canonical(df.withColumn("text", F.regexp_replace("text", r"[\r\n]+", " ¶ ")), "text", "text").withColumn("text", F.replace("text", F.lit(" ¶ "), F.lit("\n")))


def common_words(documents: DataFrame, least_share: float = 0.003) -> set[str]:
    """Words that at least ``least_share`` of all distinct texts use. There can be no more of them than the mean number of distinct words a document divided by that share, whatever the corpus."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = Counter(x for t in batch.column(0).to_pylist() for x in {z for w in windows_of(t) for z in w})
            yield pa.RecordBatch.from_arrays([pa.array(["", *n], pa.string()), pa.array([batch.num_rows, *n.values()], pa.int64())], names=["word", "n"])

    counts = with_canonical_lines(documents.select("text").distinct()).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    total = counts.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    return {r["word"] for r in counts.where((F.col("word") != "") & (F.col("n") >= max(2, least_share * total))).select("word").collect()}


def abuse_scores(documents: DataFrame, labels: DataFrame, most_labels: int = 5000) -> DataFrame:
    """(doc_id, source, score, flagged, n_windows, passage): every document once per row of the input, with the score of its worst window.

    The networks are fitted on at most ``most_labels`` labelled documents; all
    windows of all documents are scored, whole texts, in one narrow Arrow map.
    Equal windows are scored once in a task, as far as
    its memory of them goes. NULL and empty texts score 0.
    """
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(fitted(spark, *labelled_sample(documents, labels, most_labels), common_words(documents)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        least = net.threshold
        score: dict[tuple[str, ...], float] = {}
        for big in batches:
            for k in range(0, big.num_rows, 2000):
                batch = big.slice(k, 2000)
                docs = [windows_of(t) for t in batch.column(2).to_pylist()]
                if len(score) > 200_000:
                    score.clear()
                new = list({w: None for d in docs for w in d if w not in score})
                score |= zip(new, net.score([list(w) for w in new]).tolist(), strict=True)
                worst = [max(d, key=score.__getitem__) if d else () for d in docs]
                s = [score[w] if w else 0.0 for w in worst]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([x >= least for x in s], pa.bool_()), pa.array([len(d) for d in docs], pa.int32()), pa.array([" ".join(w) for w in worst], pa.string())],
                    names=["doc_id", "source", "score", "flagged", "n_windows", "passage"],
                )

    docs = with_canonical_lines(documents.select("doc_id", "source", "text")).select("doc_id", "source", "text")
    return docs.mapInArrow(run, "doc_id long, source string, score double, flagged boolean, n_windows int, passage string")


def abuse_rates(scores: DataFrame) -> DataFrame:
    """(source, n_docs, n_flagged, rate, mean_score): rates per source; documents without a source form the group NULL."""
    return scores.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("flagged").cast("long")).alias("n_flagged"), F.avg(F.col("flagged").cast("double")).alias("rate"), F.avg("score").alias("mean_score")
    )
