"""Token-id files: each shard of documents as a Re-Pair grammar with random-access decoding.

A shard is a run of documents in ascending doc_id order. Its ids (each document closed by the end id) are
compressed by Re-Pair: frequent pairs of neighbouring symbols are replaced by nonterminals, the most frequent first,
until no pair occurs twice. As the end id may also be an id of text, a document's own end is a symbol apart (the last
before the nonterminals). A pair never reaches past it, so each document keeps its own stretch of symbols. The file
holds the rules, their expansion lengths, the symbols, and for each document its place among the symbols and among the
ids; any document, or any range of its ids, decodes by itself.

Pairs are replaced in rounds, many at a time: a round takes the pairs met ``level`` times or more; where two of them
overlap, the more frequent one goes first and the other is counted anew. The level falls (to an eighth) when no pair
reaches it, and ends at two.

Files are the ``payload`` values of a Parquet table, one a row: that works in any store Spark can write.

Layout (little-endian): ``TWRP``, then unsigned 32-bit version, first nonterminal, end id, rules, rounds, documents,
symbols; rules as pairs of unsigned 32-bit symbols; rules made up to the end of each round (unsigned 32-bit; a rule
only names symbols of earlier rounds); expansion lengths (unsigned 32-bit); doc_ids (64-bit); one byte a document that is
1 if its doc_id is not null; unsigned 64-bit ends of the documents among the symbols, then among the ids; symbols
(unsigned 16-bit if all fit, else 32-bit).

Cases: null and empty texts are the end id alone; null doc_ids come first; rows with one doc_id come in order
of a hash of their texts; an empty table gives no files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import encoder, map_arrow, parts, read, shards, strings, table, vocabulary

MAGIC, VERSION = b"TWRP", 2
FILES = "part int, seq int, n_docs long, n_ids long, payload binary"
#: By what the count that pairs must have falls from level to level.
FALL = 8
#: Nonterminals of up to so many ids are held expanded while a file is open; longer ones are expanded step by step.
HELD = 64


def _sorted(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts ``key``, and ``key`` in that order; key and place are sorted as one number where 64 bits hold both."""
    bits = len(key).bit_length()
    if len(key) and int(key.max()).bit_length() + bits <= 64:
        both = np.sort(key << np.uint64(bits) | np.arange(len(key), dtype=np.uint64))
        return (both & np.uint64((1 << bits) - 1)).astype(np.intp), both >> np.uint64(bits)
    order = np.argsort(key)
    return order, key[order]


def _grouped(key: np.ndarray, at: np.ndarray, after: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (``key`` at the places ``at``, ascending; ``after``: the places that follow) met ``level`` times or more without overlaps
    of their own: keys, counts, the places of all of them with the pair at each, and the places that overlap one of the same pair."""
    order, ordered = _sorted(key)
    new = np.r_[True, ordered[1:] != ordered[:-1]] if len(at) else np.empty(0, dtype=bool)
    pair = np.empty(len(at), dtype=np.intp)
    pair[order] = np.cumsum(new) - 1
    keys = ordered[np.flatnonzero(new)]
    again = np.r_[False, (at[1:] == after[:-1]) & (pair[1:] == pair[:-1])] if len(at) else new
    if not again.any():
        odd, n = again, np.bincount(pair, minlength=len(keys))
    else:  # in a run such as a a a a every other place counts
        begins = np.flatnonzero(~again)
        odd = (np.arange(len(at)) - np.repeat(begins, np.diff(np.r_[begins, len(at)]))) % 2 == 1
        n = np.bincount(pair[np.flatnonzero(~odd)], minlength=len(keys))
    good = n >= level
    taken = good[pair]
    counted = np.flatnonzero(taken & ~odd)
    return keys[good], n[good], at[counted], (np.cumsum(good) - 1)[pair[counted]], at[np.flatnonzero(taken & odd)]


def repair(ids: np.ndarray, end: int, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rules (pairs of symbols; the k-th stands for ``first + k``), their number after each round, and the symbols that are left.

    No pair goes on after ``end``. Among what is left no pair occurs twice (occurrences that overlap count once). A level begins
    with a count of all pairs; its later rounds only look at pairs that lost places to others and at those next to a new symbol.
    Places are ``intp`` and are picked by number, not by mask: numpy does both faster."""
    seq = ids.astype(np.uint32)
    shut = seq == end  # symbols whose expansion ends a document
    rules, rounds, made, level = [], [], 0, None
    while len(seq) > 1 and level != 1:
        slot = ((seq[:-1] * np.uint32(2654435761) ^ seq[1:] * np.uint32(2246822519)) >> np.uint32(12)).astype(np.intp)
        met = np.bincount(slot, minlength=1 << 20)  # at least the pair's own count
        most = int(met.max())
        level = max(2, min(level or most, most) // FALL)
        at = np.flatnonzero((met >= level)[slot] & ~shut[:-1])
        n = len(seq)
        after, before = np.arange(1, n + 1), np.arange(-1, n)  # neighbours among the places that are left
        gone = np.zeros(n, dtype=bool)
        while len(at):
            right = after[at]
            bits = np.uint64((first + made).bit_length())
            key = seq[at].astype(np.uint64) << bits | seq[right]
            keys, count, at, pair, aside = _grouped(key, at, right, level)
            if not len(keys):
                break
            rank = np.empty(len(keys), dtype=np.intp)
            rank[np.argsort(-count, kind="stable")] = np.arange(len(keys))
            mine, right = rank[pair], after[at]
            close = at[1:] == right[:-1]  # places that overlap: the better rank goes first
            wins = np.ones(len(at), dtype=bool)
            wins[1:] &= ~(close & (mine[1:] >= mine[:-1]))
            wins[:-1] &= ~(close & (mine[:-1] > mine[1:]))
            used = np.bincount(pair[np.flatnonzero(wins)], minlength=len(keys)) > 1
            wins &= used[pair]
            won = np.flatnonzero(wins)
            p, q = at[won], right[won]
            seq[p] = (first + made + (np.cumsum(used) - 1)[pair[won]]).astype(np.uint32)
            shut[p] = shut[q]
            gone[q] = True
            follows = after[q]
            after[p] = follows
            before[follows] = p
            chosen = keys[used]
            rules.append(np.stack([chosen >> bits, chosen & ((np.uint64(1) << bits) - np.uint64(1))], axis=1).astype(np.uint32))
            made += len(chosen)
            rounds.append(made)
            at = np.sort(np.concatenate([at[np.flatnonzero(~wins)], aside, p, before[p]]))
            at = at[np.flatnonzero(np.r_[True, at[1:] != at[:-1]] & (at >= 0))]
            at = at[np.flatnonzero(~gone[at] & ~shut[at] & (after[at] < n))]
        left = np.flatnonzero(~gone)
        seq, shut = seq[left], shut[left]
        if level == 2:
            level = 1
    return np.concatenate(rules) if rules else np.empty((0, 2), dtype=np.uint32), np.array(rounds, dtype=np.uint32), seq


def _sizes(rules: np.ndarray, rounds: np.ndarray, first: int) -> np.ndarray:
    """How many ids each symbol stands for."""
    size, a = np.ones(first + len(rules), dtype=np.int64), 0
    for b in rounds.tolist():
        size[first + a : first + b] = size[rules[a:b, 0]] + size[rules[a:b, 1]]
        a = b
    return size


class Grammar:
    """Rules with their expansion lengths; the short expansions are held in one array."""

    def __init__(self, rules: np.ndarray, rounds: np.ndarray, first: int):
        self.first = first
        self.left, self.right = rules[:, 0].astype(np.int64), rules[:, 1].astype(np.int64)
        self.size = _sizes(rules, rounds, first)
        steps = list(zip([0, *rounds[:-1].tolist()], rounds.tolist(), strict=True)) if len(rounds) else []
        short = np.where(self.size <= HELD, self.size, 0)
        self.at = np.cumsum(short) - short
        self.flat = np.empty(int(short.sum()), dtype=np.uint32)
        self.flat[:first] = np.arange(first)
        for a, b in steps:
            k = a + np.flatnonzero(short[first + a : first + b])
            n, half = self.size[first + k], self.size[self.left[k]]
            into = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            begin = np.repeat(self.at[self.left[k]], n)
            over = into >= np.repeat(half, n)
            begin[over] = (np.repeat(self.at[self.right[k]] - half, n))[over]
            self.flat[np.repeat(self.at[first + k], n) + into] = self.flat[begin + into]

    def expand(self, symbols: np.ndarray, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The ids from ``begin`` to ``end`` (exclusive) among those that the symbols stand for; what lies outside is never expanded."""
        symbols = symbols.astype(np.int64)
        while True:
            n = self.size[symbols]
            if begin > 0 or end is not None:
                upto = np.cumsum(n)
                a = int(np.searchsorted(upto, begin, side="right"))
                b = len(n) if end is None else min(len(n), int(np.searchsorted(upto, end, side="left")) + 1)
                past = int(upto[a - 1]) if a else 0
                symbols, n, begin = symbols[a : max(a, b)], n[a : max(a, b)], begin - past
                end = None if end is None else end - past
            wide = n > HELD
            if not wide.any():
                break
            two = 1 + wide.astype(np.int64)
            place = np.cumsum(two) - two
            out = np.empty(int(two.sum()), dtype=np.int64)
            out[place] = symbols
            k = symbols[wide] - self.first
            out[place[wide]], out[place[wide] + 1] = self.left[k], self.right[k]
            symbols = out
        shift = self.at[symbols] - (np.cumsum(n) - n)
        ids = self.flat[np.repeat(shift, n) + np.arange(int(n.sum()))]
        return ids[max(0, begin) : end]


def write_shard(doc_ids: list[int | None], docs: list[np.ndarray], end_id: int, first: int) -> bytes:
    """``docs``: each document's ids, without the end id; ``first``: a number above all ids, for the documents' ends."""
    end, first = first, first + 1
    stop = np.array([end], dtype=np.uint32)
    ids = np.concatenate([x for d in docs for x in (d, stop)]) if docs else np.empty(0, dtype=np.uint32)
    rules, rounds, seq = repair(ids, end, first)
    lengths = _sizes(rules, rounds, first)
    id_ends = np.cumsum([len(d) + 1 for d in docs], dtype=np.uint64) if docs else np.empty(0)
    sym_ends = np.searchsorted(np.cumsum(lengths[seq]), id_ends.astype(np.int64), side="left") + 1
    wide = np.uint16 if first + len(rules) <= 65536 else np.uint32
    return b"".join([
        MAGIC, np.array([VERSION, first, end_id, len(rules), len(rounds), len(docs), len(seq)], dtype="<u4").tobytes(), rules.astype("<u4").tobytes(), rounds.astype("<u4").tobytes(),
        lengths[first:].astype("<u4").tobytes(), np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes(),
        np.array([d is not None for d in doc_ids], dtype=np.uint8).tobytes(), sym_ends.astype("<u8").tobytes(), id_ends.astype("<u8").tobytes(), seq.astype(wide).tobytes(),
    ])


@dataclass
class Shard:
    """A file, opened: documents, and ranges of their ids, decode one by one."""

    doc_ids: np.ndarray
    has_id: np.ndarray
    sym_ends: np.ndarray
    id_ends: np.ndarray
    symbols: np.ndarray
    grammar: Grammar
    end_id: int

    @classmethod
    def open(cls, raw: bytes) -> Shard:
        if bytes(raw[:4]) != MAGIC:
            raise ValueError("not a token file")
        version, first, end_id, n_rules, n_rounds, n_docs, n_sym = np.frombuffer(raw, "<u4", 7, 4).tolist()
        if version != VERSION:
            raise ValueError(f"version {version}")
        pos = 32
        got = []
        for kind, n in (("<u4", 2 * n_rules), ("<u4", n_rounds), ("<u4", n_rules), ("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("<u8", n_docs), ("<u2" if first + n_rules <= 65536 else "<u4", n_sym)):
            got.append(np.frombuffer(raw, kind, n, pos))
            pos += got[-1].nbytes
        rules, rounds, lengths, doc_ids, has_id, sym_ends, id_ends, symbols = got
        grammar = Grammar(rules.reshape(-1, 2), rounds, first)
        if not np.array_equal(grammar.size[first:], lengths):
            raise ValueError("expansion lengths differ")
        return cls(doc_ids, has_id, sym_ends.astype(np.int64), id_ends.astype(np.int64), symbols, grammar, end_id)

    def document(self, k: int, begin: int = 0, end: int | None = None) -> np.ndarray:
        """The k-th document's ids (with the end id), or those from ``begin`` to ``end``."""
        return self._named(self.grammar.expand(self.symbols[self.sym_ends[k - 1] if k else 0 : self.sym_ends[k]], begin, end))

    def all_ids(self) -> np.ndarray:
        return self._named(self.grammar.expand(self.symbols))

    def _named(self, ids: np.ndarray) -> np.ndarray:
        ids[ids == self.grammar.first - 1] = self.end_id
        return ids


def write_files(docs: DataFrame, vocab: str, end_id: int = 2, shard_ids: int = 1 << 19, path: str | None = None) -> DataFrame:
    """The table of files, written to ``path`` (which must not exist) or, without one, to the shared scratch folder until the end of
    the process; a file ends with the document that takes it past ``shard_ids`` ids."""

    def make(batches):
        enc, part, seq, ids, rows, n = encoder(vocab), TaskContext.get().partitionId(), 0, [], [], 0
        first = enc.tok.get_vocab_size()

        def file():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([n], pa.int64()), pa.array([write_shard(rows, ids, end_id, first)], pa.binary())], names=["part", "seq", "n_docs", "n_ids", "payload"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ids.append(enc.encode(text))
                rows.append(doc)
                n += len(ids[-1]) + 1
                if n >= shard_ids:
                    yield file()
                    seq, ids, rows, n = seq + 1, [], [], 0
        if rows:
            yield file()

    n = parts(shards(docs))
    docs = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("h"))
    files = map_arrow(docs.repartitionByRange(n, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text"), make, FILES)
    if path is None:
        return table(files, "token-files")
    files.write.parquet(path)
    return docs.sparkSession.read.schema(FILES).parquet(path)


def starts(files: DataFrame, block: int = 1024) -> DataFrame:
    """part, seq and the ids of all files before; sums by blocks of parts first, so no task gets a row for every file."""
    x = files.select("part", "seq", "n_ids", F.floor(F.col("part") / block).alias("block"))
    inner = x.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("block").orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_ids"))
    total = x.groupBy("block").agg(F.sum("n_ids").alias("all"))
    outer = total.withColumn("outer", F.sum("all").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("all"))
    return inner.join(outer.select("block", "outer"), "block").select("part", "seq", (F.col("inner") + F.col("outer")).alias("before"))


def read_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files."""

    def decode(batches):
        for b in batches:
            for part, seq, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                s = Shard.open(raw.as_buffer())
                ids, ends = s.all_ids().astype("<u4"), s.id_ends.tolist()
                begins = [0, *ends[:-1]]
                n = len(ends)
                yield pa.RecordBatch.from_arrays([
                    pa.array([part] * n, pa.int32()), pa.array([seq] * n, pa.int32()), pa.array(s.doc_ids, pa.int64(), mask=s.has_id == 0), pa.array(begins, pa.int64()),
                    pa.array([y - x for x, y in zip(begins, ends, strict=True)], pa.int64()), pa.array([zlib.crc32(ids[x:y]) for x, y in zip(begins, ends, strict=True)], pa.int64()),
                ], names=["part", "seq", "doc_id", "at", "n_tokens", "ids_crc32"])

    rows = map_arrow(files.select("part", "seq", "payload"), decode, "part int, seq int, doc_id long, at long, n_tokens long, ids_crc32 long", 0)
    return rows.join(starts(files), ["part", "seq"]).select("doc_id", (F.col("at") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_files(write_files(read(spark, sf_dir, "documents"), vocabulary()))
