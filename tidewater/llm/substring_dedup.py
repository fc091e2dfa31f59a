"""Suffix-array dedup: bytes covered by a 100-byte string that also starts earlier in the corpus.

All strings of ``LENGTH`` = 100 bytes can't be sorted together, so they are dealt by content first. The anchor
of a string is the ``GRAM``-byte substring of it with the least hash (the leftmost such): equal strings have
equal anchors at equal places. Neighbouring strings of a text with one anchor form a run; a run is
(anchor hash, hash of its bytes, hashes of what stands before and after the anchor, document, first start, strings).

1. Runs go to shards by anchor. A task forwards only the first of equal runs it has seen (the others are
   covered), so a passage that stands in a third of all texts reaches its shard once for each task.
2. In a shard, anchors met once are done with. Of equal runs all but the first are covered. Where runs differ
   under one anchor, they can share a string only if the ``SIDE`` bytes before the anchor are the same or those after it
   (of the 76 other bytes of a string at least 38 stand on one side). The first of each such run is asked for by its bytes.
3. Those bytes go to shards by anchor again (by string, one by one, if an anchor has more than ``HOT`` such runs).
   There a suffix array (Larsson-Sadakane refinement), common prefixes by Kasai's inequality,
   and for large shards the merging of several such arrays by binary search find each string's first start.
4. Every text gets the covered strings back, by bucket of documents.

Only shards of bounded size are held in memory; nothing goes to the driver.

Cases: null texts are empty; texts under 100 bytes keep all; rows with one doc_id come in order of their texts,
null doc_ids first (such tables are numbered by a sort beforehand); extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, parts, read, shards, table

LENGTH = 100
GRAM = 24
#: A string has so many bytes before its anchor, or after it.
SIDE = (LENGTH - GRAM) // 2
HOT = 50_000
#: Bytes that one suffix array takes in; a larger shard makes several and merges them.
ARRAY_BYTES = 8 << 20
GROUP = 2 << 20
FLUSH = 1_000_000
RUN = np.dtype([("anchor", "<u8"), ("sig", "<u8"), ("before", "<u4"), ("after", "<u4"), ("ord", "<i8"), ("lo", "<u4"), ("n", "u1")])
COVER = np.dtype([("ord", "<i8"), ("lo", "<u4"), ("n", "u1")])
ASK = np.dtype([("ord", "<i8"), ("lo", "<u4"), ("n", "u1"), ("hot", "u1"), ("anchor", "<u8")])
PIECE = np.dtype([("anchor", "<u8"), ("ord", "<i8"), ("lo", "<u4"), ("n", "u1")])
_M = 0x9E3779B97F4A7C15 | 1
_INV = pow(_M, -1, 1 << 64)


def utf8(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the strings (first 0) and their bytes; null: none."""
    if col.null_count:
        col = col.fill_null("")
    wide = pa.types.is_large_string(col.type)
    _, ends, data = col.buffers()
    at = np.frombuffer(ends, np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, dtype=np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.empty(0, dtype=np.uint8)
    return at - at[0], raw


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, dtype=np.uint64)
    out[:1] = 1
    out[1:] = base
    return np.cumprod(out, dtype=np.uint64)


_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "m" not in _POWERS or len(_POWERS["m"]) < n:
        _POWERS["m"], _POWERS["i"] = powers(_M, n), powers(_INV, n)
    return _POWERS["m"][:n], _POWERS["i"][:n]


def runs_of(ends: np.ndarray, data: np.ndarray, ords: np.ndarray) -> np.ndarray:
    """The runs of some whole texts."""
    n = len(data)
    size = np.diff(ends)
    if not (size >= LENGTH).any():
        return np.empty(0, dtype=RUN)
    m, inv = _powers(n + 1)
    pre = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * m[:n], out=pre[1:])
    z = mix((pre[GRAM:] - pre[:-GRAM]) * inv[: n - GRAM + 1])
    key = z & np.uint64(0xFFFFFFFF00000000) | np.arange(len(z), dtype=np.uint64)
    width, span = LENGTH - GRAM + 1, 1
    while 2 * span <= width:
        key = np.minimum(key[:-span], key[span:])
        span *= 2
    key = np.minimum(key[: len(key) - (width - span)], key[width - span :])
    anchor = (key & np.uint64(0xFFFFFFFF)).astype(np.int64)  # of the string that starts here
    del key
    count = np.maximum(0, size - LENGTH + 1)
    begin = ends[:-1][count > 0]
    doc = np.flatnonzero(count > 0)
    valid = np.zeros(len(anchor) + 1, dtype=np.int8)
    valid[begin] = 1
    stop = begin + count[doc]
    np.subtract.at(valid, stop, 1)
    valid = np.cumsum(valid[:-1], dtype=np.int8).astype(bool)
    first = np.zeros(len(anchor) + 1, dtype=bool)
    first[1:-1] = anchor[1:] != anchor[:-1]
    first[begin] = True
    first[stop] = True
    edges = np.flatnonzero(first)
    lo = edges[edges < len(anchor)]
    hi = np.append(edges, len(anchor))[np.searchsorted(edges, lo, side="right")]
    ok = valid[lo]
    lo, hi = lo[ok], hi[ok]
    out = np.empty(len(lo), dtype=RUN)
    out["anchor"] = z[anchor[lo]]
    out["sig"] = mix((pre[hi + LENGTH - 1] - pre[lo]) * inv[lo] + (hi - lo).astype(np.uint64))
    at = anchor[lo]  # 0 stands for a side that no string of the run has whole
    for side, has, from_ in (("before", at - lo >= SIDE, at - SIDE), ("after", at - hi < SIDE, at + GRAM)):
        from_ = from_[has]
        out[side] = 0
        out[side][has] = mix((pre[from_ + SIDE] - pre[from_]) * inv[from_]) >> np.uint64(32) | np.uint64(1)
    of = doc[np.searchsorted(begin, lo, side="right") - 1]
    out["ord"], out["lo"], out["n"] = ords[of], lo - ends[of], hi - lo
    return out


def by_number(rows: np.ndarray, number: np.ndarray):
    """(number, rows) for each number, in order."""
    order = np.argsort(number, kind="stable")
    rows, number = rows[order], number[order]
    cuts = np.r_[0, np.flatnonzero(np.diff(number)) + 1, len(number)] if len(number) else np.zeros(1, dtype=np.int64)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield int(number[a]), rows[a:b]


def bucket_of(ords: np.ndarray, n: int) -> np.ndarray:
    return (mix(ords.astype(np.int64).view(np.uint64)) % np.uint64(n)).astype(np.int64)


ROWS = "kind int, shard int, payload binary"


def _rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["kind", "shard", "payload"])


def covered_rows(cover: np.ndarray, n: int) -> list[tuple[int, int, bytes]]:
    return [(1, k, x.tobytes()) for k, x in by_number(cover, bucket_of(cover["ord"], n))]


def cover_of(runs: np.ndarray) -> np.ndarray:
    out = np.empty(len(runs), dtype=COVER)
    for c in COVER.names:
        out[c] = runs[c]
    return out


def runs(docs: DataFrame, n: int) -> DataFrame:
    """Rows (kind, shard, payload): 0, runs by anchor; 1, covered strings by bucket of documents. ``docs``: ord, text."""

    def make(batches):
        held, total = [], 0

        def flush():
            x = np.concatenate(held)
            held.clear()
            x = x[np.lexsort((x["lo"], x["ord"], x["sig"], x["anchor"]))]
            again = np.r_[False, (x["anchor"][1:] == x["anchor"][:-1]) & (x["sig"][1:] == x["sig"][:-1])]
            cover, x = cover_of(x[again]), x[~again]
            return _rows([(0, k, y.tobytes()) for k, y in by_number(x, (x["anchor"] % np.uint64(n)).astype(np.int64))] + covered_rows(cover, n))

        for b in batches:
            ords = b.column(0).to_numpy()
            ends, data = utf8(b.column(1))
            a = 0
            while a < len(ords):
                z = max(a + 1, int(np.searchsorted(ends, ends[a] + GROUP, side="right")) - 1)
                held.append(runs_of(ends[a : z + 1] - ends[a], data[ends[a] : ends[z]], ords[a:z]))
                total += len(held[-1])
                a = z
                if total >= FLUSH:
                    yield flush()
                    held, total = [], 0
        if total:
            yield flush()

    return map_arrow(docs.select("ord", "text"), make, ROWS, 0)


def by_shard(rows: DataFrame, n: int, work) -> DataFrame:
    """``work(payloads of one shard of kind 0) -> rows``, shard by shard; rows of kind 1 are handed on."""

    def make(batches):
        now, held = None, []
        for b in batches:
            mine = int(np.count_nonzero(b.column(0).to_numpy() == 0))  # kinds are sorted
            for shard, payload in zip(b.column(1)[:mine].to_pylist(), b.column(2)[:mine], strict=True):
                if shard != now:
                    if held:
                        yield from work(held)
                    now, held = shard, []
                held.append(payload.as_py())
            if mine < b.num_rows:
                yield b.slice(mine)
        if held:
            yield from work(held)

    return map_arrow(rows.repartition(parts(n), "kind", "shard").sortWithinPartitions("kind", "shard"), make, ROWS, 0)


def settle(n: int, hot: int):
    """Step 2 for one shard."""

    def work(payloads):
        x = np.concatenate([np.frombuffer(p, dtype=RUN) for p in payloads])
        x = x[np.lexsort((x["lo"], x["ord"], x["sig"], x["anchor"]))]
        new = np.r_[True, x["anchor"][1:] != x["anchor"][:-1]]
        group = np.cumsum(new) - 1
        fresh = new | np.r_[True, x["sig"][1:] != x["sig"][:-1]]
        kinds = np.bincount(group, fresh, minlength=0).astype(np.int64)  # different runs under the anchor
        some = np.flatnonzero(fresh & (kinds[group] > 1))
        wanted = np.zeros(len(some), dtype=bool)
        for side in ("before", "after"):
            key = x[side][some]
            order = np.lexsort((key, group[some]))
            twice = np.flatnonzero((key[order[1:]] == key[order[:-1]]) & (group[some[order[1:]]] == group[some[order[:-1]]]) & (key[order[1:]] > 0))
            wanted[order[twice]] = wanted[order[twice + 1]] = True
        some = some[wanted]
        out = np.empty(len(some), dtype=ASK)
        for c in ("ord", "lo", "n", "anchor"):
            out[c] = x[c][some]
        out["hot"] = np.bincount(group[some], minlength=len(kinds))[group[some]] > hot
        yield _rows(covered_rows(cover_of(x[~fresh]), n) + [(2, k, y.tobytes()) for k, y in by_number(out, bucket_of(out["ord"], n))])

    return work


def string_hashes(data: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``LENGTH`` bytes that start at ``where``."""
    m, _ = _powers(LENGTH)
    out = np.empty(len(where), dtype=np.uint64)
    for k in range(0, len(where), 1 << 14):
        out[k : k + (1 << 14)] = (data[where[k : k + (1 << 14), None] + np.arange(LENGTH)].astype(np.uint64) + np.uint64(1)) @ m
    return mix(out)


def fetch(docs: DataFrame, asked: DataFrame, n: int) -> DataFrame:
    """Step 3, the bytes: rows (0, shard, pieces and their bytes) for what is asked. ``docs``: bucket, ord, text."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple[int, int, bytes]] = []
        if right.num_rows and left.num_rows:
            ask = np.concatenate([np.frombuffer(p.as_buffer(), dtype=ASK) for p in right["payload"].combine_chunks()])
            ords = left["ord"].combine_chunks().to_numpy()
            ends, data = utf8(left["text"].combine_chunks())
            order = np.argsort(ords)
            at = order[np.searchsorted(ords[order], ask["ord"])]
            start = ends[at] + ask["lo"]
            if (hot := ask["hot"] > 0).any():  # each string by itself
                ask2, start2 = ask[~hot], start[~hot]
                n_ = ask["n"][hot].astype(np.int64)
                one = np.repeat(ask[hot], n_)
                k = np.arange(len(one)) - np.repeat(np.cumsum(n_) - n_, n_)
                where = np.repeat(start[hot], n_) + k
                one["lo"] += k.astype(np.uint32)
                one["n"] = 1
                one["anchor"] = string_hashes(data, where)
                ask, start = np.concatenate([ask2, one]), np.concatenate([start2, where])
            piece = np.empty(len(ask), dtype=PIECE)
            for c in PIECE.names:
                piece[c] = ask[c]
            for shard, k in by_number(np.arange(len(piece)), (piece["anchor"] % np.uint64(n)).astype(np.int64)):
                size = piece["n"][k].astype(np.int64) + LENGTH - 1
                place = np.repeat(start[k] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out.append((0, shard, np.int64(len(k)).tobytes() + piece[k].tobytes() + data[place].tobytes()))
        return pa.Table.from_batches([_rows(out)])

    return docs.groupBy("bucket").cogroup(asked.select(F.col("shard").alias("bucket"), "payload").groupBy("bucket")).applyInArrow(make, ROWS)


def suffix_order(data: np.ndarray) -> np.ndarray:
    """The suffix array of ``data`` by Larsson-Sadakane refinement: ranks of h bytes give ranks of 2h, and only suffixes whose rank
    another one shares are sorted again. (It is refined to the end, as Kasai's inequality holds for whole suffixes only.)"""
    n = len(data)
    x = np.zeros(n + 8, dtype=np.uint64)
    x[:n] = data.astype(np.uint64) + np.uint64(1)
    first = np.zeros(n, dtype=np.uint64)
    for k in range(7):  # seven bytes, nine bits each
        first = first << np.uint64(9) | x[k : k + n]
    del x
    order = np.argsort(first, kind="stable").astype(np.int32)
    first = first[order]
    new = np.r_[True, first[1:] != first[:-1]] if n else np.empty(0, dtype=bool)
    del first
    rank = np.zeros(n + 1, dtype=np.int32)
    begin = np.flatnonzero(new)
    rank[order] = np.repeat(begin + 1, np.diff(np.r_[begin, n]))  # 1 + the place where its group begins; 0 past the end
    h = 7
    while True:
        shared = np.zeros(n, dtype=bool)
        shared[1:] |= ~new[1:]
        shared[:-1] |= ~new[1:]
        places = np.flatnonzero(shared)
        if not len(places):
            break
        at = order[places]
        key = rank[at].astype(np.int64) << 32 | rank[np.minimum(at.astype(np.int64) + h, n)]
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        order[places] = at
        fresh = np.r_[True, key[1:] != key[:-1]]
        new[places] = fresh
        begin = np.flatnonzero(new)
        group = np.repeat(begin + 1, np.diff(np.r_[begin, n]))
        rank[at] = group[places]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int = LENGTH, step: int = 8) -> np.ndarray:
    """Common prefix (up to ``most`` bytes) of each suffix with the one before it in ``order`` (all suffixes, or those of some places).

    Kasai's inequality: in the text's order a value is at least its neighbour's less one. Every ``step``-th place is
    compared from its start, those after it from what the inequality leaves, all of one kind at a time."""
    n = len(data)
    padded = np.concatenate([data.astype(np.int16), np.full(most + 8, -1, dtype=np.int16)])
    before = np.full(n, -1, dtype=np.int32)
    before[order[1:]] = order[:-1]
    value = np.zeros(n, dtype=np.int16)
    whole = len(order) == n

    def extend(i: np.ndarray) -> None:
        j, got = before[i], value[i]
        live = np.flatnonzero((j >= 0) & (got < most))
        while len(live):
            p, q = i[live] + got[live], j[live] + got[live]
            same = (padded[p] == padded[q]) & (padded[p] >= 0) & (padded[q] >= 0)
            live = live[same]
            got[live] += 1
            live = live[got[live] < most]
        value[i] = got

    if not whole:
        extend(np.sort(order))
        return value[order]
    extend(np.arange(0, n, step))
    for k in range(1, step):
        i = np.arange(k, n, step)
        value[i] = np.maximum(0, value[i - 1] - 1)
        value[i[before[i] < 0]] = 0
        extend(i)
    return value[order]


def later_strings(piece: np.ndarray, data: np.ndarray, array_bytes: int = ARRAY_BYTES) -> np.ndarray:
    """The strings (as covered ones, n = 1) of the pieces that equal an earlier one's (ord, start)."""
    size = piece["n"].astype(np.int64) + LENGTH - 1
    begin = np.cumsum(size) - size
    n = piece["n"].astype(np.int64)
    of = np.repeat(np.arange(len(piece)), n)
    k = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    where, ords, start = begin[of] + k, piece["ord"][of], piece["lo"][of].astype(np.int64) + k
    order = np.lexsort((start, ords))
    rank = np.empty(len(of), dtype=np.int64)  # by (ord, start)
    rank[order] = np.arange(len(of))
    merged: np.ndarray | None = None  # strings of the arrays so far, sorted, each with its first rank
    first_of: np.ndarray = np.empty(0, dtype=np.int64)
    later = np.zeros(len(of), dtype=bool)
    back = np.empty(len(of), dtype=np.int64)
    back[rank] = np.arange(len(of))
    cuts = [0]
    while cuts[-1] < len(piece):
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(begin + size, begin[cuts[-1]] + array_bytes, side="right"))))
    several = len(cuts) > 2
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        lo, hi = begin[a], begin[b - 1] + size[b - 1]
        mine = np.flatnonzero((of >= a) & (of < b))
        text = data[lo:hi]
        full = suffix_order(text)
        prefix = common_prefixes(text, full)
        # the least common prefix on the way from one wanted suffix to the next
        wanted = np.full(hi - lo, -1, dtype=np.int64)
        wanted[where[mine] - lo] = mine
        string = wanted[full]
        is_ = string >= 0
        short = np.cumsum(prefix < LENGTH)  # a step under LENGTH parts what stands on its two sides
        group = short[is_]
        ids = string[is_]
        new = np.r_[True, group[1:] != group[:-1]]
        number = np.cumsum(new) - 1
        least = np.full(int(number[-1]) + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, number, rank[ids])
        later[ids] |= rank[ids] != least[number]
        if several:
            heads = ids[new]
            strings = np.frombuffer(np.concatenate([data[where[heads][:, None] + np.arange(LENGTH)], np.ones((len(heads), 1), dtype=np.uint8)], axis=1).tobytes(), dtype=f"S{LENGTH + 1}")
            if merged is None:
                merged, first_of = strings, least
                continue
            at = np.searchsorted(merged, strings)
            hit = (at < len(merged)) & (merged[np.minimum(at, len(merged) - 1)] == strings)
            was, now = first_of[at[hit]], least[hit]
            later[back[np.maximum(was, now)]] = True
            first_of[at[hit]] = np.minimum(was, now)
            merged = np.insert(merged, at[~hit], strings[~hit])
            first_of = np.insert(first_of, at[~hit], least[~hit])
    out = np.empty(int(later.sum()), dtype=COVER)
    out["ord"], out["lo"], out["n"] = ords[later], start[later], 1
    return joined(out)


def joined(cover: np.ndarray) -> np.ndarray:
    """Neighbouring covered strings as runs of up to 255."""
    x = cover[np.lexsort((cover["lo"], cover["ord"]))]
    if not len(x):
        return x
    lo = x["lo"].astype(np.int64)
    new = np.r_[True, (x["ord"][1:] != x["ord"][:-1]) | (lo[1:] != lo[:-1] + 1)]
    begin = np.flatnonzero(new)
    k = np.arange(len(x)) - np.repeat(begin, np.diff(np.r_[begin, len(x)]))
    begin = np.flatnonzero(k % 255 == 0)
    out = x[begin].copy()
    out["n"] = np.diff(np.r_[begin, len(x)])
    return out


def compare(n: int, array_bytes: int):
    """Step 3 for one shard: pieces of one anchor are only ever compared with each other."""

    def work(payloads):
        pieces, data = [], []
        for p in payloads:
            k = int(np.frombuffer(p, "<i8", 1)[0])
            pieces.append(np.frombuffer(p, PIECE, k, 8))
            data.append(np.frombuffer(p, np.uint8, -1, 8 + k * PIECE.itemsize))
        cover = later_strings(np.concatenate(pieces), np.concatenate(data), array_bytes)
        yield _rows(covered_rows(cover, n))

    return work


def gone_bytes(size: int, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Of ``size`` bytes those that are covered by one of ``n`` strings from ``lo`` on."""
    depth = np.zeros(size + 1, dtype=np.int32)
    np.add.at(depth, lo, 1)
    np.subtract.at(depth, lo + n.astype(np.int64) + LENGTH - 1, 1)
    np.cumsum(depth, out=depth)
    return depth[:-1] > 0


def remove(docs: DataFrame, covered: DataFrame) -> DataFrame:
    """Step 4: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed byte ranges. ``docs``: bucket, ord, doc_id, text."""

    def make(left: pa.Table, right: pa.Table) -> pa.Table:
        ords = left["ord"].combine_chunks().to_numpy() if left.num_rows else np.empty(0, dtype=np.int64)
        ends, data = utf8(left["text"].combine_chunks()) if left.num_rows else (np.zeros(1, dtype=np.int64), np.empty(0, dtype=np.uint8))
        gone = np.zeros(len(data), dtype=bool)
        if right.num_rows and len(ords):
            x = np.concatenate([np.frombuffer(p.as_buffer(), dtype=COVER) for p in right["payload"].combine_chunks()])
            order = np.argsort(ords)
            at = order[np.searchsorted(ords[order], x["ord"])]
            gone = gone_bytes(len(data), ends[at] + x["lo"], x["n"])
        out: list[list] = [[], [], [], []]
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            g = gone[a:b]
            removed = int(np.count_nonzero(g))
            edges = np.flatnonzero(np.diff(np.r_[False, g, False])) if removed else np.empty(0, dtype=np.int64)
            out[0].append(removed)
            out[1].append(len(edges) // 2)
            out[2].append(hashlib.sha256((data[a:b][~g] if removed else data[a:b]).tobytes()).hexdigest())
            out[3].append(edges)
        ids = left["doc_id"].combine_chunks() if left.num_rows else pa.array([], pa.int64())
        cols = [ids, pa.array(np.diff(ends) if len(ords) else np.empty(0, dtype=np.int64)), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.list_(pa.int64()))]
        return pa.Table.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "edges"])

    left, right = docs.groupBy("bucket"), covered.select(F.col("shard").alias("bucket"), "payload").groupBy("bucket")
    return left.cogroup(right).applyInArrow(make, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, edges array<long>")


def numbered(docs: DataFrame) -> DataFrame:
    """ord, doc_id, text: ord is the doc_id, or the place in the order (doc_id, text) if ids are null or repeated."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    odd = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or doc_id is null").limit(1).count()
    if not odd:
        return docs.select(F.col("doc_id").alias("ord"), "doc_id", "text")
    rows = docs.sort("doc_id", "text").rdd.zipWithIndex().map(lambda x: (x[1], x[0][0], x[0][1]))
    return table(docs.sparkSession.createDataFrame(rows, "ord long, doc_id long, text string"), "numbered")


def substring_dedup(docs: DataFrame, n: int | None = None, hot: int = HOT, array_bytes: int = ARRAY_BYTES) -> DataFrame:
    n = n or shards(docs)
    docs = numbered(docs)
    settled = table(by_shard(runs(docs, n), n, settle(n, hot)), "settled")
    # bucket_of() as an SQL expression would repeat its arithmetic; the buckets are made where the ords are read
    dealt = map_arrow(docs, _with_bucket(n), "ord long, doc_id long, text string, bucket int", 0)
    pieces = fetch(dealt.select("bucket", "ord", "text"), settled.where("kind = 2"), n)
    compared = by_shard(pieces, n, compare(n, array_bytes))
    covered = settled.where("kind = 1").unionByName(compared)
    return remove(dealt, covered)


def _with_bucket(n: int):
    def make(batches):
        for b in batches:
            yield b.append_column("bucket", pa.array(bucket_of(b.column(0).to_numpy(), n).astype(np.int32)))

    return make


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents")).drop("edges")
