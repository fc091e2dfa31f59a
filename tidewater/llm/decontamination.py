"""Benchmark decontamination: rare n-gram seeds, then Smith-Waterman alignment of words.

Texts are lower-case words (runs of letters and digits; in scripts that don't part words by spaces each letter is one). A
text is aligned with an item (match 2, others -1); the best local score divided by that of a full match is the
similarity, and ``LEAK`` or more is a leak.

An alignment of similarity t with an item of m words has at most 2 (1 - t) m words that don't match, so it shares at
least (2 t - 1) m - 1 of the item's pairs of neighbouring words (for the shortest items: t m single words) within a
stretch of m + 2 (1 - t) m words. These are the seeds, and no leak is without that many. All texts are read once: what has that
many seeds of an item in such a stretch is held, and of every seed the texts that have it are counted. If an item has s
seeds and a leak holds k of them, it holds one of the s - k + 1 rarest: alignments begin around those only. Nothing
is left out for being common.

The items go to the tasks in blocks of at most ``BLOCK`` words, each block against all texts.

Cases: null and empty texts and items match nothing; repeated documents each get their rows, repeated items
(by item_id) are items of their own; empty tables give an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, read, strings, table

LEAK = 0.6
BLOCK = 2_000_000

#: The ranges of scripts written without spaces (Thai to Tibetan, Burmese, Khmer, kana, Han).
_BARE = "\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_WORD = re.compile(r"[^\W_]+")
_IN_BARE = re.compile(f"[{_BARE}]")
_LETTER_OR_WORD = re.compile(f"[{_BARE}]|[^\\W_{_BARE}]+")
#: By byte of Latin-1: the small letter or digit, else a space.
_SMALL = bytes(ord(chr(c).lower()) if _WORD.match(chr(c)) else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, as UTF-8 (Latin-1 where all of the text is; no word is both)."""
    if not text:
        return []
    try:
        return text.encode("latin-1").translate(_SMALL).split()
    except UnicodeEncodeError:
        low = text.lower()
        return [_bytes(w) for w in (_LETTER_OR_WORD if _IN_BARE.search(low) else _WORD).findall(low)]


def _bytes(word: str) -> bytes:
    try:
        return word.encode("latin-1")
    except UnicodeEncodeError:
        return b"\x00" + word.encode("utf-8", "surrogatepass")  # no Latin-1 word has this byte


def align(item: np.ndarray, text: np.ndarray) -> tuple[float, int, int]:
    """Smith-Waterman: best score over that of a full match, and the aligned words [start, end) of the text."""
    n = len(text)
    step = np.arange(n + 1)
    h, origin = np.zeros(n + 1, dtype=np.int64), step.copy()
    best, where = 0, (0, 0)
    for w in item:
        diagonal = h[:-1] + np.where(text == w, 2, -1)
        up = h[1:] - 1
        t, o = np.zeros(n + 1, dtype=np.int64), step.copy()
        t[1:] = np.maximum(0, np.maximum(diagonal, up))
        o[1:] = np.where(t[1:] == 0, step[1:], np.where(diagonal >= up, origin[:-1], origin[1:]))
        run = np.maximum.accumulate((t + step) * (n + 1) + step)  # of gaps to the left, by the place they end at
        frm = run % (n + 1)
        left = run // (n + 1) - step
        new = left > t
        h, origin = np.where(new, left, t), np.where(new, o[frm], o)
        k = int(h.argmax())
        if h[k] > best:
            best, where = int(h[k]), (int(origin[k]), k)
    return best / (2 * len(item)) if len(item) else 0.0, *where


def best_score(item: np.ndarray, text: np.ndarray) -> int:
    """The best local score alone."""
    n = len(text)
    step = np.arange(n + 1)
    h, t, best = np.zeros(n + 1, dtype=np.int64), np.zeros(n + 1, dtype=np.int64), 0
    for w in item:
        np.maximum(h[:-1] + np.where(text == w, 2, -1), h[1:] - 1, out=t[1:])
        np.maximum(t, 0, out=t)
        t += step
        h = np.maximum.accumulate(t) - step
        best = max(best, int(h.max()))
        t[0] = 0
    return best


class Index:
    """A block of items: words as numbers, seeds as sorted hashes, and for each seed the items (with places) that have it."""

    def __init__(self, items: list[tuple[int | None, str | None]], least: float = LEAK):
        self.least = least
        self.number: dict[bytes, int] = {}
        self.ids, self.words = [], []
        for item_id, text in items:
            if ws := words_of(text):
                self.ids.append(item_id)
                self.words.append(np.array([self.number.setdefault(w, len(self.number)) for w in ws], dtype=np.int64))
        m = np.array([len(w) for w in self.words], dtype=np.int64)
        pairs = np.ceil((2 * least - 1) * m - 1 - 1e-9)
        self.width = np.where(pairs >= 1, 2, 1)
        self.need = np.where(pairs >= 1, pairs, np.maximum(1, np.ceil(least * m - 1e-9))).astype(np.int64)
        self.extra = np.floor(2 * (1 - least) * m + 1e-9).astype(np.int64)
        self.span = m + self.extra
        codes = [self.codes(w, n) for w, n in zip(self.words, self.width.tolist(), strict=True)]
        item = np.repeat(np.arange(len(codes)), [len(c) for c in codes])
        at = np.concatenate([np.empty(0, dtype=np.int64), *(np.arange(len(c)) for c in codes)])
        self.seeds, of = np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *codes]), return_inverse=True)
        order = np.argsort(of, kind="stable")
        self.item, self.at = item[order], at[order]
        self.begin = np.searchsorted(of[order], np.arange(len(self.seeds) + 1))

    @staticmethod
    def codes(w: np.ndarray, n: int) -> np.ndarray:
        """A hash of each run of ``n`` words (equal runs have equal hashes; alignment tells false ones)."""
        x = (w.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        out = np.full(max(0, len(w) - n + 1), n, dtype=np.uint64)
        for k in range(n):
            out = out * np.uint64(0xBF58476D1CE4E5B9) + x[k : k + len(out)]
        return out

    def text(self, text: str | None) -> np.ndarray:
        ws, get = words_of(text), self.number.get
        return np.fromiter((get(w, -1) for w in ws), dtype=np.int64, count=len(ws))

    def hits(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in the text (ascending for each width), and numbers of the seeds found there."""
        places, seeds = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
        for n in (1, 2):
            if not (self.width == n).any():
                continue
            at = np.flatnonzero(w >= 0 if n == 1 else (w[:-1] >= 0) & (w[1:] >= 0))
            code = self.codes(w, n)[at]
            k = np.minimum(np.searchsorted(self.seeds, code), len(self.seeds) - 1)
            ok = self.seeds[k] == code
            places.append(at[ok])
            seeds.append(k[ok])
        return np.concatenate(places), np.concatenate(seeds)

    def joined(self, places: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Item, place in the text, place in the item and seed of each hit of an item, by item and place in the text."""
        n = self.begin[seeds + 1] - self.begin[seeds]
        k = np.repeat(self.begin[seeds] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        item, place = self.item[k], np.repeat(places, n)
        order = np.lexsort((place, item))
        return item[order], place[order], self.at[k][order], np.repeat(seeds, n)[order]

    def near(self, item: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Items of which enough seeds stand near each other."""
        other = np.arange(len(item)) + self.need[item] - 1
        inside = other < len(item)
        other = np.minimum(other, len(item) - 1)
        return np.unique(item[inside & (item[other] == item) & (place[other] - place <= self.span[item])])

    def set_rare(self, df: np.ndarray) -> None:
        """Marks each item's rarest seeds, by the texts that have them: as many as a leak cannot be without."""
        seed = np.repeat(np.arange(len(self.seeds)), np.diff(self.begin))
        order = np.lexsort((self.at, df[seed], self.item))
        item = self.item[order]
        first = np.searchsorted(item, np.arange(len(self.words)))
        size = np.bincount(self.item, minlength=len(self.words))
        self.rare = np.zeros(len(self.item), dtype=bool)
        self.rare[order] = np.arange(len(item)) - first[item] < (size - self.need + 1)[item]
        self.rare_at = set(zip(self.item[self.rare].tolist(), self.at[self.rare].tolist(), strict=True))

    def leaks(self, w: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, start, end) of the best alignment near rare seeds, of each item that is ``least`` similar to the text."""
        item, place, at, _ = self.joined(*self.hits(w))
        out = []
        for k in self.near(item, place).tolist() if len(item) else ():
            mine = slice(*np.searchsorted(item, [k, k + 1]).tolist())
            m, x = len(self.words[k]), int(self.extra[k])
            spans = sorted((p - a - x, p - a + m + x) for p, a in zip(place[mine].tolist(), at[mine].tolist(), strict=True) if (k, a) in self.rare_at)
            best = (0.0, 0, 0)
            a, b = spans[0] if spans else (0, 0)
            for c, d in [*spans[1:], (1 << 60, 0)]:
                if c <= b and d - a <= 8 * m:
                    b = max(b, d)
                    continue
                a = max(a, 0)
                part = w[a : max(b, a)]
                if best_score(self.words[k], part) >= 2 * m * max(self.least, best[0]):
                    got = align(self.words[k], part)
                    if got[0] > best[0]:
                        best = (got[0], got[1] + a, got[2] + a)
                a, b = c, d
            if best[0] >= self.least:
                out.append((k, *best))
        return out


def _blocks(docs: DataFrame, items: DataFrame, least: float) -> DataFrame:
    size = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-size // (5 * BLOCK)) or 1
    out = None
    for k in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).select("item_id", "text")
        got = _leaks(docs, Index([(r["item_id"], r["text"]) for r in block.toLocalIterator()], least), least)  # about BLOCK words
        out = got if out is None else out.unionByName(got)
    return out


def leaks(docs: DataFrame, items: DataFrame, least: float = LEAK) -> DataFrame:
    """doc_id, item_id, similarity, and the aligned words [start_word, end_word) of each text that holds an item."""
    return _blocks(docs, items, least).drop("text_hash")


def _leaks(docs: DataFrame, index: Index, least: float) -> DataFrame:
    def candidates(batches):
        df = np.zeros(len(index.seeds), dtype=np.int64)
        for b in batches:
            rows = []
            for k, t in enumerate(strings(b.column(1))):
                if not t or not len(df):
                    continue
                places, seeds = index.hits(index.text(t))
                if len(seeds):
                    df[np.unique(seeds)] += 1
                    if len(index.near(*index.joined(places, seeds)[:2])):
                        rows.append(k)
            kept = b.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.int64())], names=["doc_id", "text", "text_hash", "seed", "n"])
        at = np.flatnonzero(df)
        for k in range(0, len(at), 100_000):
            some = at[k : k + 100_000]
            none = [pa.nulls(len(some), x) for x in (pa.int64(), pa.string(), pa.int64())]
            yield pa.RecordBatch.from_arrays([*none, pa.array(some.astype(np.int32)), pa.array(df[some])], names=["doc_id", "text", "text_hash", "seed", "n"])

    read_ = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_hash"))
    held = table(map_arrow(read_, candidates, "doc_id long, text string, text_hash long, seed int, n long"), "candidates")
    df = np.zeros(len(index.seeds), dtype=np.int64)
    counted = held.where("seed is not null").groupBy("seed").agg(F.sum("n").alias("n")).toArrow()  # at most a row for each seed of the block
    df[counted.column("seed").to_numpy()] = counted.column("n").to_numpy()
    index.set_rare(df)

    def score(batches):
        for b in batches:
            out = []
            for doc, t, h in zip(b.column(0).to_pylist(), strings(b.column(1)), b.column(2).to_pylist(), strict=True):
                out += [(doc, index.ids[i], s, x, y, h) for i, s, x, y in index.leaks(index.text(t))]
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(cols, kinds, strict=True)], names=["doc_id", "item_id", "similarity", "start_word", "end_word", "text_hash"])

    rows = held.where("seed is null").select("doc_id", "text", "text_hash")
    return map_arrow(rows, score, "doc_id long, item_id long, similarity double, start_word long, end_word long, text_hash long")


def without_leaks(docs: DataFrame, items: DataFrame, least: float = LEAK) -> DataFrame:
    """The rows of ``docs`` in which no item is found (rows are told apart by doc_id and text, null doc_ids too)."""
    found = _blocks(docs, items, least).select(F.col("doc_id").alias("_tidewater_id"), F.col("text_hash").alias("_tidewater_hash")).distinct()
    found = table(found, "leaks")
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_tidewater_id")) & (F.xxhash64(docs["text"]) == F.col("_tidewater_hash"))
    return docs.join(found, same, "left_anti")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
