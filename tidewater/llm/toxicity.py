"""Toxicity: a noisy-channel restoration of disguised words, then a score of the restored text.

Restoration: a chunk that mixes letters with figures or marks, repeats a letter three times or more, or is
spelt out with single letters becomes a lattice (each figure or mark may stand for letters, marks and spaces
between letters may be dropped or part words, runs may shrink to one or two letters), and Viterbi search under a
character trigram model finds the likeliest words, which stand in the text in its place. The model's counts are
four-letter windows of the whole corpus.

Score: a logistic regression on the rates of words and of words' beginnings and ends. It is fitted on a bounded
sample: about ``SAMPLE`` training rows of each label, each different text once. Features that ``MIN_SHARE`` of
the sample's toxic texts have are counted (the ``MOST`` most frequent), and the ``KEPT`` that tell the labels
apart best are fitted.

Cases: null and empty texts get the score of a text without features; label rows that are null, or of no
document, teach nothing, of repeated labels the largest counts; repeated documents each get their row; if the
training rows don't have both labels all scores are about 0; extra columns are ignored. A chunk of any length is restored
in time proportional to it.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, read, strings, table

#: What figures and marks may stand for.
STANDS_FOR = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e"}
MARKS = set(".-_*~'`^/\\,:;=# ")
LETTERS = 28  # 0 is a word's edge, 27 any letter that has no base among a-z
MIN_SHARE = 0.002
MOST = 1 << 16
KEPT = 4096
#: Training rows of each label that the classifier is fitted on (about; fewer if there are fewer).
SAMPLE = 20_000
THRESHOLD = 0.7


def is_train(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 != 1, F.lit(True))


_FOLD: dict[str, np.ndarray] = {}


def _fold() -> np.ndarray:
    """By code point: the letter's number in the model's alphabet."""
    if not _FOLD:
        out = np.zeros(0x110000, dtype=np.uint8)
        for k in range(0x110000):
            if (c := chr(k)).isalpha():
                base = unicodedata.normalize("NFD", c)[0].lower()[:1]
                out[k] = ord(base) - 96 if "a" <= base <= "z" else 27
        _FOLD["of"] = out
    return _FOLD["of"]


def letter_counts(docs: DataFrame) -> np.ndarray:
    """Counts of all four-letter windows of all texts (edges as letter 0), as an array of 28^3 trigram counts for the model."""

    def count(batches):
        for b in batches:
            text = " ".join(["", *(t for t in strings(b.column(0)) if t), ""])  # windows that touch two texts have an edge between them
            x = _fold()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
            x = x[np.r_[True, (x[1:] != 0) | (x[:-1] != 0)]].astype(np.int32)
            total = np.bincount(((x[:-3] * LETTERS + x[1:-2]) * LETTERS + x[2:-1]) * LETTERS + x[3:]) if len(x) > 3 else np.zeros(1, dtype=np.int64)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["gram", "n"])

    grams = map_arrow(docs.select("text"), count, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    out = np.zeros(LETTERS**3)
    for r in grams.groupBy((F.col("gram") % LETTERS**3).alias("g")).agg(F.sum("n").alias("n")).collect():  # at most 28^3 rows
        out[r["g"]] = r["n"]
    return out


def log_model(trigrams: np.ndarray) -> np.ndarray:
    """log P(letter | two letters before), smoothed by the bigram and unigram shares."""
    t = trigrams.reshape(LETTERS, LETTERS, LETTERS)
    bi, uni = t.sum(axis=0), t.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + LETTERS)
    p2 = (bi + 10 * p1) / (bi.sum(axis=1, keepdims=True) + 10)
    return np.log((t + 10 * p2[None]) / (t.sum(axis=2, keepdims=True) + 10))


class Restorer:
    """Viterbi search over the lattice of a disguised chunk."""

    def __init__(self, model: np.ndarray):
        self.p = model.tolist()

    @staticmethod
    def options(chunk: str) -> list[list[tuple[str, float]]]:
        """For each place: what it may stand for, with its channel's log probability ("" for nothing)."""
        out: list[list[tuple[str, float]]] = []
        k = 0
        while k < len(chunk):
            c, n = chunk[k], 1
            while k + n < len(chunk) and chunk[k + n] == c:
                n += 1
            k += n
            if c.isalpha():
                out.append([(c, 0.0)] if n == 1 else [(c + c, 0.0), (c, -2.5)] if n == 2 else [(c, -0.5), (c + c, -1.0)])
            elif c in STANDS_FOR:
                out.append([(x, -1.0) for x in STANDS_FOR[c]] + [("", -8.0)] + [(x + x, -2.0) for x in STANDS_FOR[c] if n > 1])
            else:
                out.append([("", -0.3), (" ", -0.7)])
        return out

    def restore(self, chunk: str) -> str:
        fold, p = _fold(), self.p
        done: list[str] = []  # what all ways to go on have in common
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the way back: (text, the way before)
        for place in self.options(chunk):
            new: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, way) in best.items():
                for text, cost in place:
                    x, y, s = a, b, score + cost
                    for c in text:
                        z = int(fold[ord(c)])
                        s += p[x][y][z]
                        x, y = (0, 0) if z == 0 else (y, z)
                    if (x, y) not in new or new[x, y][0] < s:
                        new[x, y] = (s, (text, way) if text else way)
            best = new
            if len(best) == 1:
                ((state, (score, way)),) = best.items()
                done += _back(way)
                best = {state: (score, None)}
        way = max(((s + p[a][b][0], k) for k, ((a, b), (s, _)) in enumerate(best.items())), default=(0.0, -1))[1]
        return "".join(done + (_back(list(best.values())[way][1]) if best else []))


def _back(way: tuple | None) -> list[str]:
    out = []
    while way:
        out.append(way[0])
        way = way[1]
    return out[::-1]


_WORD = re.compile(r"[^\W\d_]+")
_RUN = re.compile(r"(.)\1\1")
_SPELT = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def disguised(chunk: str) -> bool:
    """Whether a chunk without spaces may hide a word: figures or marks between letters, or a run of three."""
    inner = chunk.strip(".,:;!?()[]{}\"'*#%&$|<>-_ ")
    if len(inner) < 3 or inner.isalpha() and not _RUN.search(inner):
        return len(chunk) > 3 and chunk[0] in STANDS_FOR and inner.isalpha()
    return any(c.isalpha() for c in inner) and (any(c in STANDS_FOR or c in MARKS for c in inner) or bool(_RUN.search(inner)))


def spelt_out(text: str) -> list[str]:
    """Runs of three or more single characters with single spaces between them."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    sp = raw <= 32
    if len(sp) < 5 or not (~sp[:-4] & sp[1:-3] & ~sp[2:-2] & sp[3:-1] & ~sp[4:]).any():
        return []
    return [x.group() for x in _SPELT.finditer(text)]


def features(word: str) -> list[bytes]:
    """A word, its beginnings of three to six letters and its ends of four and five (shorter than itself)."""
    out = [b"=" + word.encode()]
    n = len(word)
    out += [b"<" + word[:k].encode() for k in (3, 4, 5, 6) if k < n]
    out += [b">" + word[-k:].encode() for k in (4, 5) if k < n]
    return out


def chunk_words(chunk: str, restorer: Restorer) -> list[str]:
    """The words of a lower-case chunk, those of its restored form if it looks disguised."""
    if chunk.isalpha() and not _RUN.search(chunk):
        return [chunk]
    return _WORD.findall(restorer.restore(chunk) if disguised(chunk) else chunk)


def chunks(text: str | None) -> Iterator[str]:
    low = (text or "").lower()
    yield from low.split()
    yield from spelt_out(low)


class _Found(dict):
    """Chunk -> numbers of the kept features it has (one for each word that has it)."""

    def __init__(self, codes: np.ndarray, letters: np.ndarray, most: int = 150_000):
        self.number = {c: k for k, c in enumerate(codes.view(np.uint64).tolist())}
        self.restorer, self.most = Restorer(letters), most

    def __missing__(self, chunk: str) -> tuple[int, ...]:
        got = tuple([k for w in chunk_words(chunk, self.restorer) for f in features(w) if (k := self.number.get(xxhash.xxh64_intdigest(f))) is not None])
        if len(self) < self.most:
            self[chunk] = got
        return got

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        """Numbers of the features of a text, how often each occurs, and the text's chunks."""
        parts = list(chunks(text))
        at, n = np.unique(np.fromiter(chain.from_iterable(map(self.__getitem__, parts)), dtype=np.int32), return_counts=True)
        return at, n, len(parts)


def toxic_codes(texts: DataFrame, letters: np.ndarray) -> DataFrame:
    """code, n: in how many of the texts each feature occurs."""

    def count(batches):
        restorer = Restorer(letters)
        for b in batches:
            codes = [np.empty(0, dtype=np.uint64)]
            for t in strings(b.column(0)):
                words = {w for c in set(chunks(t)) for w in chunk_words(c, restorer)}
                codes.append(np.unique(np.array([xxhash.xxh64_intdigest(f) for w in words for f in features(w)], dtype=np.uint64)))
            at, n = np.unique(np.concatenate(codes), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(n.astype(np.int64))], names=["code", "n"])

    return map_arrow(texts, count, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def found(rows: DataFrame, codes: np.ndarray, letters: np.ndarray) -> DataFrame:
    """toxic, size (chunks), has and times (numbers of the features and how often) of each row (toxic, text)."""

    def find(batches):
        of = _Found(codes, letters)
        for b in batches:
            got = [of.of(t) for t in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[2] for x in got], pa.int64()), pa.array([x[0] for x in got], pa.list_(pa.int32())), pa.array([x[1].astype(np.int32) for x in got], pa.list_(pa.int32()))], names=["toxic", "size", "has", "times"])

    return map_arrow(rows.select(F.col("toxic").cast("int"), "text"), find, "toxic int, size long, has array<int>, times array<int>")


def documents_with(texts: DataFrame, codes: np.ndarray, letters: np.ndarray) -> DataFrame:
    """k, n: in how many of the texts (text) each of these features occurs."""

    def count(batches):
        of = _Found(codes, letters)
        for b in batches:
            n = np.zeros(len(codes), dtype=np.int64)
            for t in strings(b.column(0)):
                n[of.of(t)[0]] += 1
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], names=["k", "n"])

    return map_arrow(texts, count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))


def strength(times: np.ndarray, size: np.ndarray | int) -> np.ndarray:
    """A feature's value: its rate in the text, on a log scale."""
    return np.log1p(300.0 * times / (np.asarray(size) + 100.0))


def fit(row: np.ndarray, col: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, penalty: float = 0.02, steps: int = 400) -> np.ndarray:
    """Logistic regression with a quadratic penalty, by Adam on all rows; the intercept is the last weight."""
    w, m, v = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1)
    w[n] = -3.0
    for t in range(1, steps + 1):
        z = np.bincount(row, w[col] * x, minlength=len(y)) + w[n]
        e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight
        g = np.r_[np.bincount(col, e[row] * x, minlength=n) + penalty * w[:n], e.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
    return w


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, weight, text: about ``SAMPLE`` training rows of each label, by a hash of doc_id, each different text once."""
    taught = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_train(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in taught.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    part = {k: min(1.0, SAMPLE / n[k]) for k in n}
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, part.get(1, 0) * 1e6).otherwise(part.get(0, 0) * 1e6)
    rows = docs.select("doc_id", "text").join(F.broadcast(taught.where(drawn)), "doc_id")  # about 2 * SAMPLE ids at most
    return table(rows.groupBy(F.xxhash64("text", F.length("text"))).agg(F.max("toxic").alias("toxic"), F.min_by("text", "doc_id").alias("text")).select("toxic", "text"), "toxic-sample")


def train(docs: DataFrame, labels: DataFrame, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the kept features, and their weights with the intercept."""
    rows = sample(docs, labels)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    if not n.get(1) or not n.get(0):
        return np.empty(0, dtype=np.int64), np.array([-30.0])
    least = max(3, MIN_SHARE * n[1])
    top = toxic_codes(rows.where("toxic = 1").select("text"), letters).where(F.col("n") >= least).orderBy(F.desc("n"), "code").limit(MOST).toPandas()  # at most MOST rows
    codes = top["code"].to_numpy(np.int64)
    neg = np.zeros(len(codes))
    for r in documents_with(rows.where("toxic = 0").select("text"), codes, letters).collect():  # at most MOST rows
        neg[r["k"]] = r["n"]
    a, b = top["n"].to_numpy(float), neg
    lift = np.log((a + 0.5) / (n[1] + 1)) - np.log((b + 0.5) / (n[0] + 1))
    best = np.argsort(-np.where(lift > np.log(2), a * lift, 0), kind="stable")[:KEPT]
    best = np.sort(best[lift[best] > np.log(2)])
    codes = codes[best]
    got = found(rows, codes, letters).toPandas()  # rows of the sample, kept features
    each = got["has"].map(len).to_numpy(np.int64)
    row = np.repeat(np.arange(len(got)), each)
    col, times = (np.concatenate([np.empty(0, dtype=np.int64), *got[c]]) for c in ("has", "times"))
    y = got["toxic"].to_numpy(float)
    return codes, fit(row, col.astype(np.int64), strength(times, got["size"].to_numpy(float)[row]), y, np.ones(len(y)), len(best))


def scored(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``: each row's score; learnt from the training rows' ``labels`` (doc_id, toxic)."""
    letters = log_model(letter_counts(docs))
    codes, w = train(docs, labels, letters)

    def score(batches):
        of = _Found(codes, letters)
        for b in batches:
            z = []
            for t in strings(b.column(b.schema.get_field_index("text"))):
                at, times, size = of.of(t)
                z.append(w[-1] + float(w[at] @ strength(times, size)))
            yield b.append_column(name, pa.array(1 / (1 + np.exp(-np.clip(np.array(z, dtype=float), -30, 30)))))

    return map_arrow(docs, score, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` double")


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score of each row of ``docs``."""
    out = scored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), labels)
    return out.select("doc_id", (~is_train(F.col("doc_id"))).alias("held_out"), "score")


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score below the threshold, each by its own text."""
    return scored(docs, labels, "_tidewater_score").where(F.col("_tidewater_score") < THRESHOLD).select(docs.columns)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
    return got.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
