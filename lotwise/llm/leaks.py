"""P8: evaluation passages inside a training corpus.

Documents stream once past a q-gram index of the (bounded) evaluation set. Shared
character q-grams are counted in overlapping bands of diagonals; a band stays only
where it reaches the count that the q-gram lemma demands of a stretch within the edit
budget; surviving bands are verified by a banded alignment (word by word without
edits, else letter by letter), and the words in long enough stretches are counted.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotwise.llm.characters import with_canonical
from lotwise.session import cut

Q = 10  #: length of the q-grams in characters
LONG = 20_000  #: words from which a document is read in pieces
BAND = 32  #: width of a band of diagonals in characters; bands overlap by half
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Words of a canonical text: runs of letters and digits, lower case."""
    return _WORD.findall((text or "").lower())


def _qgrams(codes: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of every q-gram of an array of code points."""
    n = len(codes) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for j in range(Q):
        h = h * _BASE + codes[j : j + n]
    return h ^ (h >> np.uint64(29))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


def _occurs(piece: str, text: str, edits: int) -> bool:
    """Whether some part of ``text`` is within ``edits`` edited letters of ``piece`` (Myers' bit-parallel columns, one per letter of the text)."""
    here: dict[str, int] = {}
    for k, c in enumerate(piece):
        here[c] = here.get(c, 0) | 1 << k
    mask, last = (1 << len(piece)) - 1, 1 << (len(piece) - 1)
    up, down, distance = mask, 0, len(piece)
    for c in text:
        eq = here.get(c, 0)
        xv = eq | down
        xh = (((eq & up) + up) ^ up) | eq
        right, left = down | (mask & ~(xh | up)), up & xh
        distance += bool(right & last) - bool(left & last)
        if distance <= edits:
            return True
        right, left = right << 1 & mask, left << 1 & mask
        up, down = left | (mask & ~(xv | right)), right & xv
    return distance <= edits


class ItemIndex:
    """q-gram index of the evaluation items, with each item's bounds from the q-gram lemma.

    least_region[i]: q-grams that any stretch of ``stretch`` consecutive words of
    item i shares with its copy of at most k edited letters, n + 1 - q - k q for the
    shortest such stretch of n characters (at least one q-gram is looked for, so k
    may be at most (n - q) / q to lose nothing). least_total[i]: the same summed over stretches that together hold
    the share of words; any stretch can be cut into pieces of one to two times the
    least length, so the poorest such piece per word bounds the sum.
    """

    def __init__(self, ids: list[int], texts: list[str], share: float, stretch: int, edits: int = 0):
        self.ids, self.share, self.stretch, self.edits = np.array(ids, np.int64), share, stretch, edits
        lost = Q * (1 + edits) - 1  # q-grams that a stretch of n characters may lack
        self.words = [words_of(t) for t in texts]
        vocabulary: dict[str, int] = {}
        self.coded = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in ws], np.int64) for ws in self.words]
        self.vocabulary = vocabulary
        hashes, item, pos = [], [], []
        self.least_region = np.zeros(len(ids), np.int64)
        self.least_words = np.zeros(len(ids), np.int64)
        self.least_total = np.ones(len(ids), np.int64)
        for i, ws in enumerate(self.words):
            h = _qgrams(_codes(" ".join(ws)))
            hashes.append(h)
            item.append(np.full(len(h), i, np.int32))
            pos.append(np.arange(len(h), dtype=np.int32))
            ends = np.cumsum([len(w) + 1 for w in ws]) if ws else np.zeros(0, int)
            starts = ends - np.array([len(w) + 1 for w in ws]) if ws else ends
            shortest = int((ends[stretch - 1 :] - 1 - starts[: len(ws) - stretch + 1]).min()) if len(ws) >= stretch else 0
            self.least_region[i] = max(1, shortest - lost)
            self.least_words[i] = int(np.ceil(share * len(ws) - 1e-9))
            rates = [max(0, int((ends[k - 1 :] - 1 - starts[: len(ws) - k + 1]).min()) - lost) / k for k in range(stretch, min(2 * stretch, len(ws) + 1))]
            self.least_total[i] = max(1, int(min(rates) * self.least_words[i])) if rates else 1
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(h, kind="stable")
        self.item = (np.concatenate(item) if item else np.zeros(0, np.int32))[order]
        self.pos = (np.concatenate(pos) if pos else np.zeros(0, np.int32))[order]
        self.keys, first = np.unique(h[order], return_index=True)
        self.first = np.append(first, len(h)).astype(np.int64)

    def _bits(self) -> np.ndarray:
        """Which of 2^22 buckets any q-gram of the items falls into: most q-grams of a corpus are told apart without a search."""
        if "bits" not in self.__dict__:
            self.bits = np.zeros(1 << 22, bool)
            self.bits[(self.keys & np.uint64((1 << 22) - 1)).astype(np.int64)] = True
        return self.bits

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "bits"}

    def likely(self, docs: list[list[str]]) -> list[int]:
        """Which of some documents share as many q-grams with all items together as the easiest item demands; the others can't leak. All are hashed in one go."""
        if not len(self.keys):
            return []
        texts = [" ".join(ws) for ws in docs]
        codes = _codes("\n".join(texts))
        h = _qgrams(codes)
        near = np.flatnonzero(self._bits()[(h & np.uint64((1 << 22) - 1)).astype(np.int64)])
        at = np.searchsorted(self.keys, h[near])
        at[at == len(self.keys)] = 0
        hit = near[self.keys[at] == h[near]]
        ends = np.cumsum([len(t) + 1 for t in texts])
        count = np.bincount(np.searchsorted(ends, hit, side="right"), minlength=len(docs))
        return np.flatnonzero(count >= self.least_total.min()).tolist()

    def leaks(self, words: list[str], piece: int = LONG) -> list[tuple[int, int]]:
        """(item id, words of the item reproduced in long stretches) of one document.

        Texts of more than ``piece`` words are read in pieces that overlap by more
        than the longest item, so memory stays bounded; what the pieces cover of an
        item is united.
        """
        covered = self._covered(words, True) if len(words) <= piece else {}
        if len(words) > piece:
            overlap = 2 * max((len(w) for w in self.words), default=0)
            for start in range(0, len(words), piece):
                for i, c in self._covered(words[start : start + piece + overlap], False).items():
                    covered[i] = covered[i] | c if i in covered else c
        return [(int(self.ids[i]), int(c.sum())) for i, c in covered.items() if c.sum() >= max(1, self.least_words[i])]

    def _covered(self, words: list[str], whole: bool) -> dict[int, np.ndarray]:
        """By item, which of its words stand in long stretches of ``words``; where those are a whole document, items that can't reach their share are left out early."""
        if len(words) < self.stretch or not len(self.keys):
            return {}
        h = _qgrams(_codes(" ".join(words)))
        at = np.searchsorted(self.keys, h)
        at[at == len(self.keys)] = 0
        hit = np.flatnonzero(self.keys[at] == h)
        if len(hit) < (self.least_total if whole else self.least_region).min():
            return {}
        slot = at[hit]
        n = self.first[slot + 1] - self.first[slot]
        where = np.repeat(self.first[slot] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        item, diagonal = self.item[where], np.repeat(hit, n) - self.pos[where]
        # an item whose shared q-grams can't add up anywhere is out before any band is looked at
        least_total = self.least_total if whole else self.least_region
        able = (np.bincount(item, minlength=len(self.ids)) >= least_total)[item]
        item, diagonal = item[able], diagonal[able]
        if not len(item):
            return {}
        # overlapping bands: each diagonal falls into two
        half = np.floor_divide(diagonal, BAND // 2)
        bands = np.concatenate([half, half - 1])
        item2, diagonal2 = np.concatenate([item, item]), np.concatenate([diagonal, diagonal])
        key = item2.astype(np.int64) << 32 | (bands + (1 << 30))
        kept, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
        good = count >= self.least_region[kept >> 32]
        if not good.any():
            return {}
        chosen = good[inverse]
        in_bands = chosen[: len(item)] | chosen[len(item) :]
        able = np.bincount(item[in_bands], minlength=len(self.ids)) >= least_total
        chosen &= able[item2]
        coded = np.array([self.vocabulary.get(w, -1) for w in words], np.int64)
        word_at = np.cumsum([0] + [len(w) + 1 for w in words])
        if self.edits:
            text = " ".join(words)
            return {int(i): self._edited(text, int(i), diagonal2[chosen & (item2 == i)]) for i in np.unique(item2[chosen])}
        return {int(i): self._aligned(coded, word_at, int(i), diagonal2[chosen & (item2 == i)]) for i in np.unique(item2[chosen])}

    def _edited(self, text: str, i: int, diagonals: np.ndarray) -> np.ndarray:
        """Which words of item i stand in stretches that occur in ``text`` with at most ``edits`` edited letters, each aligned within the bands around ``diagonals`` only."""
        words = self.words[i]
        at = np.cumsum([0] + [len(w) + 1 for w in words])
        covered = np.zeros(len(words), bool)
        d = np.unique(diagonals)
        bands = [(b[0] - BAND // 2, b[-1] + BAND // 2) for b in np.split(d, np.flatnonzero(np.diff(d) > BAND) + 1)]
        for k in range(len(words) - self.stretch + 1):
            piece = " ".join(words[k : k + self.stretch])
            if any(_occurs(piece, text[max(0, at[k] + low) : max(0, at[k] + len(piece) + high + self.edits)], self.edits) for low, high in bands):
                covered[k : k + self.stretch] = True
        return covered

    def _aligned(self, doc: np.ndarray, word_at: np.ndarray, i: int, diagonals: np.ndarray) -> np.ndarray:
        """Which words of item i stand in stretches of equal consecutive words, aligned only within the bands around ``diagonals`` (character offsets)."""
        item = self.coded[i]
        n, m = len(doc), len(item)
        item_at = np.cumsum([0] + [len(w) + 1 for w in self.words[i]])
        covered = np.zeros(m, bool)
        low, high = diagonals.min() - BAND, diagonals.max() + BAND
        wanted = np.zeros(high - low + 1, bool)
        for d in np.unique(diagonals):
            wanted[d - low - BAND // 2 : d - low + BAND // 2 + 1] = True
        # cells of the band: word pairs whose character diagonal is wanted
        offsets = [np.unique(np.subtract.outer(np.arange(k, min(n, k + 4096)), np.arange(m))[self._cells(word_at[k : min(n, k + 4096)], item_at[:m], low, wanted)]) for k in range(0, n, 4096)]
        for j in np.unique(np.concatenate(offsets)):
            a, b = (j, 0) if j >= 0 else (0, -j)
            length = min(n - a, m - b)
            if length < self.stretch:
                continue
            same = np.concatenate(([0], (doc[a : a + length] == item[b : b + length]).astype(np.int8), [0]))
            edge = np.diff(same)
            for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
                if e - s >= self.stretch:
                    covered[b + s : b + e] = True
        return covered

    @staticmethod
    def _cells(word_at: np.ndarray, item_at: np.ndarray, low: int, wanted: np.ndarray) -> np.ndarray:
        d = np.subtract.outer(word_at, item_at) - low
        inside = (d >= 0) & (d < len(wanted))
        return inside & wanted[np.clip(d, 0, len(wanted) - 1)]


def leaked_items(documents: DataFrame, items: DataFrame, share: float = 0.4, stretch: int = 8, most_chars: int = 4_000_000, edits: int = 0) -> DataFrame:
    """(doc_id, item_id, covered_words): every document that reproduces at least ``share`` of an item's words in stretches of ``stretch`` or more consecutive words, each with at most ``edits`` inserted, deleted or changed letters.

    The evaluation set is the query set: it is read to the driver in blocks of at
    most ``most_chars`` characters, one pass over the corpus per block, so its
    broadcast is bounded and no item is left out. The corpus itself is only
    mapped, never shuffled; whole texts are read. NULL and empty texts leak
    nothing; items shorter than one stretch can't be found; repeated documents
    and items are each reported.
    """
    rows = with_canonical(items.select("item_id", "text").where("item_id IS NOT NULL AND text IS NOT NULL"), "text", "text").orderBy("item_id").toLocalIterator()
    blocks, block, size = [], [], 0
    for r in rows:
        if size + len(r["text"]) > most_chars and block:
            blocks.append(block)
            block, size = [], 0
        block.append((r["item_id"], r["text"]))
        size += len(r["text"])
    blocks.append(block)
    docs = with_canonical(documents.select("doc_id", "text"), "text", "text")
    if len(blocks) > 1:
        docs = cut(docs)
    out = None
    for block in blocks:
        found = _scan(docs, ItemIndex([i for i, _ in block], [t for _, t in block], share, stretch, edits))
        out = found if out is None else out.union(found)
    return out


def _scan(docs: DataFrame, index: ItemIndex) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            ids: list[int] = []
            docs: list[list[str]] = []
            size = 0

            def flush() -> None:
                found.extend((ids[k], i, c) for k in index.likely(docs) for i, c in index.leaks(docs[k]))
                ids.clear(), docs.clear()

            for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not t:
                    continue
                ws = words_of(t)
                if len(ws) > LONG:  # read in pieces
                    found.extend((d, i, c) for i, c in index.leaks(ws, LONG))
                    continue
                ids.append(d), docs.append(ws)
                size += len(t)
                if size > 1_000_000:
                    flush()
                    size = 0
            flush()
            cols = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["doc_id", "item_id", "covered_words"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, covered_words long")
