"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is parsed into phrases, each the longest
match of what follows in that language's text; a letter unknown to it is a phrase. Phrases times the logarithm
of the labelled text's length, by letter, is the cross entropy; the language with the least wins.

Texts are lower-case letters, each run of anything else one space; whole texts are parsed, letter by letter, and all
letters stay apart. The labelled text is a bounded sample of whole rows: ``SAMPLE_DOCS`` rows in all, but at most
``MOST_DOCS`` and at least one a language, by a hash of doc_id, those of up to ``LONG`` characters first.

Cases: null texts and texts without a letter are ``und`` with score 0; null languages teach nothing; ties go to
the alphabetically first language; if nothing can be learnt all rows are ``und``; of rows with one doc_id
one at most is drawn; repeated rows each get their row; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, read, strings

#: Labelled rows that are learnt from: in all, and of a language.
SAMPLE_DOCS, MOST_DOCS = 256, 32
#: Rows of more characters are drawn only where a language lacks shorter ones.
LONG = 2500
_OTHER = re.compile(r"[\W\d_]+")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def automaton(text: str) -> dict[str, dict]:
    """The suffix automaton of ``text``: a state is the dictionary of the states that its letters lead to; returns the root."""
    root: dict[str, dict] = {}
    go, link, length, last = [root], [-1], [0], 0
    for c in text:
        now = len(go)
        go.append({})
        length.append(length[last] + 1)
        link.append(0)
        p, new = last, go[now]
        while p != -1 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p != -1:
            old = go[p][c]
            q = old[0]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(go)
                go.append(dict(old))
                go[twin][0] = twin
                length.append(length[p] + 1)
                link.append(link[q])
                while p != -1 and go[p].get(c) is old:
                    go[p][c] = go[twin]
                    p = link[p]
                link[q] = link[now] = twin
        new[0] = now  # the state's own number, under a key that is no letter
        last = now
    return root


def normal(text: str | None) -> str:
    """A text's letters in lower case, runs of others as one space, none at the ends."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def phrases(text: str, root: dict[str, dict]) -> int:
    """Phrases of the greedy parse of a normal text: each the longest match in the automaton's text, or one unknown letter."""
    n, begin = 0, root.get
    state = _UNKNOWN
    for c in text:
        state = state.get(c)
        if state is None:
            n += 1  # a phrase begins here
            state = begin(c, _UNKNOWN)
    return n


#: After a letter that is unknown: whatever follows begins a phrase.
_UNKNOWN: dict = {}


class Languages:
    """What is learnt: for each language its name, automaton and the bits that a phrase costs."""

    def __init__(self, samples: dict[str, list[str]]):
        self.names = sorted(samples)
        texts = [" ".join(map(normal, samples[n])) for n in self.names]
        self.roots = [automaton(t) for t in texts]
        self.bits = [math.log2(max(2, len(t))) for t in texts]

    def predict(self, text: str | None) -> tuple[str, float]:
        x = normal(text)
        if not self.names or not any(map(str.isalpha, x)):
            return "und", 0.0
        rate = [phrases(x, root) * bits / len(x) for root, bits in zip(self.roots, self.bits, strict=True)]
        low = min(rate)
        share = 1 / sum(math.exp(min(0.0, 12 * (low - r) / max(low, 1e-9))) for r in rate)
        return self.names[rate.index(low)], share


_MADE: dict[int, Languages] = {}


def languages(samples: dict[str, list[str]]) -> Languages:
    """The Python worker's automata of these samples, built once."""
    key = zlib.crc32(repr(sorted(samples.items())).encode("utf-8", "surrogatepass"))
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = Languages(samples)
    return _MADE[key]


def learn(rows: DataFrame) -> dict[str, list[str]]:
    """By language, the texts of a bounded sample of labelled ``rows`` (doc_id, text, lang)."""
    good = rows.where("lang is not null and text is not null and doc_id is not null")
    n = good.agg(F.count_distinct("lang")).first()[0]
    if not n:
        return {}
    docs = min(MOST_DOCS, max(1, SAMPLE_DOCS // n))
    h = F.xxhash64("doc_id", F.lit(3))
    order = F.struct(F.length("text") > LONG, h, F.xxhash64("text"))
    drawn = good.groupBy("lang", F.pmod(h, F.lit(docs)).alias("slot")).agg(F.min_by("text", order).alias("text"))
    out: dict[str, list[str]] = {}
    for r in sorted(drawn.select("lang", "text").collect()):  # SAMPLE_DOCS rows, or one a language
        out.setdefault(r["lang"], []).append(r["text"])
    return out


def identify(docs: DataFrame, samples: dict[str, list[str]]) -> DataFrame:
    """doc_id, lang_pred, score of each row of ``docs`` (doc_id, text), by the texts of each language."""

    def make(batches):
        model = languages(samples)
        for b in batches:
            known: dict = {}
            got = []
            for t in strings(b.column(1)):
                if t not in known:
                    known[t] = model.predict(t)
                got.append(known[t])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, lang_pred string, score double")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    out = identify(docs, learn(docs.where(~is_held_out(F.col("doc_id")))))
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
