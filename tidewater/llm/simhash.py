"""SimHash near-duplicates: 64-bit fingerprints of word shingles, compared exactly in tiles.

Copies first fall together by fingerprint. Distinct fingerprints that differ in ``radius`` = 3 bits or fewer
agree on two of five bit blocks at least, so ten tables of tiles (pairs of blocks, 25 or 26 bits) hold every
link. In a tile, fingerprints are sorted by population count and compared block against block by exclusive-or
and bit counts; block pairs whose population counts differ by more than the radius are skipped. A tile of more
than ``HOT`` fingerprints is parted by the other 38 bits: of four further blocks one must agree. What is still
larger goes to pairs of parts, each pair a tile of its own. A tile yields a spanning forest of its links, and
components are found by distributed star steps.

Cases: null, empty and blank texts have fingerprint zero, linked like any other; rows without doc_id keep a
null doc_id and link as others, their component_id is null if nothing reachable has an id; repeated rows stay;
an empty table gives an empty result; extra columns are ignored. The stage tells rows apart by doc_id and text:
different texts of one doc_id are texts of their own, of repeated rows one stays, rows without doc_id come last.

The pipeline's stage (``one_of_each``) has settings of its own: texts are near copies if the Jaccard similarity of
their sets of five-word shingles is ``SIMILAR`` = 0.8 or more. Texts with equal sets fall together. Each set has a
SimHash of 512 bits. Tiles are groups that agree on five or more of these bits; a set is sent to each of its tiles once
(about thirty). A tile is parted again where it is compared, several times over, by further bits, as many as leave some
hundred sets a part. Tiles and parts are so many that two sets at 0.8 are in none together with a probability under 0.0001
(more similar ones still less). In a part, all 512 bits are compared block against block by exclusive-or and bit counts; block
pairs whose population counts or sizes are too far apart are skipped. What differs in no more bits than sets at 0.8 may (four
standard deviations) is decided on the whole sets, once: a pair comes from the first tile that finds it.
First every text is compared with the smallest doc_id of eight of its tiles, until few leave; then all pairs of what
is left are. So each row that goes has a near copy with a smaller doc_id, and no two rows that stay and have shared a
tile are near copies.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import drop, map_arrow, parts, read, shards, strings, table
from tidewater.llm.components import components, roots

RADIUS = 3
#: Widths of the five blocks, from the lowest bit; two of them agree if three bits differ.
BLOCKS = (13, 13, 13, 13, 12)
HOT = 4096
#: Node numbers from here on may stand for fingerprints no row of which has a doc_id.
NO_ID = 1 << 62
LAST = (1 << 63) - 1
#: The stage's shingles and its least similarity (a fraction).
NGRAM = 5
SIMILAR = (4, 5)
#: 64-bit words of the stage's fingerprints, those that tiles compare (all: tiles are told from them), and those that a block is compared by first.
WIDE, WORDS, FIRST = 8, 8, 2
#: Texts of a tile, on average, from which on tiles agree on one bit more than ``WIDTH``.
WIDTH, TILE = 5, 1 << 19
#: Texts of a tile's part, on average, from which on parts agree on one bit more.
INNER = 256
#: The probability that sets at the least similarity are in no part together (the worst case: four shingles of five).
LOST = 1e-4
#: Tiles of the first rounds, their bits, the texts of one from which on they agree on one bit more, and the share of their pairs
#: that must leave for one more round.
STAR, STAR_WIDTH, STAR_TILE, AGAIN = 8, 10, 16384, 0.25
#: Sets under so many shingles may differ by more bits (sums of few signs are often even).
SMALL = 64
#: Bits that fingerprints of sets at the least similarity may differ by: (small sets, larger), in the first words and in all that tiles compare.
FAR_FIRST, FAR = (44, 38), (132, 110)
#: Rows of a tile that one task compares; larger ones are cut into pieces, half as large, that meet in pairs.
PART = 1 << 19
#: Pairs with the same smaller text that one task decides.
SHARED = 1000


def fingerprint(text: str | None, ngram: int = 3, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of the shingles of a whole text."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not ws:
        return 0
    h, digest = b" ".join(ws), xxhash.xxh64_digest
    if len(ws) < ngram:
        return int.from_bytes(digest(h, seed), "big")
    size = np.fromiter(map(len, ws), dtype=np.int64, count=len(ws))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = len(ws) - ngram + 1
    bits = np.zeros(64, dtype=np.int64)
    a, b = starts[:n].tolist(), ends[ngram - 1 :].tolist()
    for k in range(0, n, 1 << 16):
        got = b"".join([digest(h[x:y], seed) for x, y in zip(a[k : k + (1 << 16)], b[k : k + (1 << 16)], strict=True)])
        bits += np.unpackbits(np.frombuffer(got, dtype=np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * bits > n).tobytes(), "big")


def fingerprints(docs: DataFrame, ngram: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the fingerprint's 64 bits as a signed long)."""

    def make(batches):
        for b in batches:
            known: dict = {}
            out = []
            for t in strings(b.column(1)):
                if (f := known.get(t)) is None:
                    f = known[t] = fingerprint(t, ngram, seed)
                out.append(f)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, dtype=np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), make, "doc_id long, fp long")


def _bits(low: int, width: int) -> Column:
    return F.shiftrightunsigned("fp", low).bitwiseAND((1 << width) - 1)


def _tiles(reps: DataFrame) -> DataFrame:
    """tile, sub (0), fp, node: each fingerprint in its ten tiles."""
    at = np.cumsum([0, *BLOCKS]).tolist()
    keys = [F.lit(t << 26) + _bits(at[i], BLOCKS[i]) * (1 << 13) + _bits(at[j], BLOCKS[j]) for t, (i, j) in enumerate(combinations(range(5), 2))]
    return reps.select(F.explode(F.array(*keys)).alias("tile"), "fp", "node")


def _refined(rows: DataFrame) -> DataFrame:
    """Four rows for each of a large tile's: one by each quarter of the bits that the tile doesn't fix."""
    at = np.cumsum([0, *BLOCKS]).tolist()
    out = None
    for t, fixed in enumerate(combinations(range(5), 2)):
        free = [k for b in range(5) if b not in fixed for k in range(at[b], at[b + 1])]
        quarters = [free[len(free) * q // 4 : len(free) * (q + 1) // 4] for q in range(4)]
        subs = []
        for q, bits in enumerate(quarters):
            runs, key, width = [], F.lit(q + 1).cast("long"), 0
            for k in bits:
                if runs and runs[-1][0] + runs[-1][1] == k:
                    runs[-1][1] += 1
                else:
                    runs.append([k, 1])
            for low, width in runs:
                key = key * (1 << width) + _bits(low, width)
            subs.append(key * 4 + q)
        case = F.array(*subs)
        out = F.when(F.shiftright("tile", 26) == t, case) if out is None else out.when(F.shiftright("tile", 26) == t, case)
    return rows.select("tile", F.explode(out).alias("sub"), "fp", "node")


def near(fps: np.ndarray, radius: int = RADIUS, block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of a spanning forest of the links within one tile."""
    pop = np.bitwise_count(fps)
    order = np.argsort(pop, kind="stable")
    x, pop = fps[order], pop[order].astype(np.int64)
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []
    for i in range(0, len(x), block):
        for j in range(i, len(x), block):
            if pop[j] - pop[min(i + block, len(x)) - 1] > radius:
                break
            close = np.bitwise_count(x[i : i + block, None] ^ x[None, j : j + block]) <= radius
            p, q = np.nonzero(np.triu(close, 1) if i == j else close)
            if len(p):
                nodes, root = roots(p + i, q + j)
                a.append(nodes)
                b.append(root)
    if not a:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    nodes, root = roots(np.concatenate(a), np.concatenate(b))
    far = nodes != root
    return order[nodes[far]], order[root[far]]


def _links_in_tiles(rows: DataFrame, n: int) -> DataFrame:
    """a, b: links within the tiles (tile, sub, part) of ``rows``."""

    def links(batches):
        held: list[list[np.ndarray]] = []

        def flush(last: bool):
            nonlocal held
            if not held:
                return
            tile, sub, part, fp, node = (np.concatenate(x) for x in zip(*held, strict=True))
            new = (np.diff(tile) != 0) | (np.diff(sub) != 0) | (np.diff(part) != 0)
            cuts = np.r_[0, np.flatnonzero(new) + 1, len(tile)]
            done = len(tile) if last else cuts[-2]
            size = np.diff(cuts)
            fp = fp.view(np.uint64)
            of = np.repeat(np.arange(len(size)), size)
            small = size[of] <= 64
            a, b = [], []
            for s in range(1, min(64, int(size.max()))):  # all small tiles at once
                ok = np.flatnonzero((of[s:] == of[:-s]) & small[s:])
                ok = ok[ok + s < done]
                if not len(ok):
                    break
                hit = ok[np.bitwise_count(fp[ok] ^ fp[ok + s]) <= RADIUS]
                a.append(node[hit])
                b.append(node[hit + s])
            for k in np.flatnonzero(size > 64):
                if cuts[k] < done:
                    i, j = near(fp[cuts[k] : cuts[k + 1]])
                    a.append(node[cuts[k] + i])
                    b.append(node[cuts[k] + j])
            held = [[x[done:] for x in (tile, sub, part, fp.view(np.int64), node)]] if done < len(tile) else []
            if a:
                a, b = np.concatenate(a), np.concatenate(b)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        count = 0
        for x in batches:
            held.append([x.column(k).to_numpy() for k in range(5)])
            count += x.num_rows
            if count >= 200_000:
                yield from flush(False)
                count = 0
        yield from flush(True)

    rows = rows.repartition(parts(n), "tile", "sub", "part").sortWithinPartitions("tile", "sub", "part")
    return map_arrow(rows.select("tile", "sub", "part", "fp", "node"), links, "a long, b long", 0)


def linked(reps: DataFrame, n: int, hot: int = HOT) -> DataFrame:
    """a, b: nodes of fingerprints (fp, node: one row each) whose links span all links within the radius."""
    tiles = _tiles(reps)
    many = tiles.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(f"n > {hot}").select("tile")
    many = table(many, "hot-tiles")
    zero = F.lit(0).cast("long")
    calm = tiles.join(many, "tile", "left_anti").select("tile", zero.alias("sub"), zero.alias("part"), "fp", "node")
    fine = _refined(tiles.join(many, "tile", "left_semi"))
    sizes = fine.groupBy("tile", "sub").agg(F.ceil(F.count(F.lit(1)) / (8 * hot)).alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.col("parts"))
    # part p of a tile meets part q in the tile's pair (p, q); each pair holds both parts
    pairs = F.transform(F.sequence(zero, F.col("parts") - 1), lambda q: F.least(F.col("own"), q) * F.col("parts") + F.greatest(F.col("own"), q))
    split = fine.join(sizes, ["tile", "sub"]).withColumn("own", own).select("tile", "sub", F.explode(pairs).alias("part"), "fp", "node")
    return _links_in_tiles(calm.unionByName(split), n)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of ``docs``."""
    n = shards(docs)
    of = table(fingerprints(docs), "fingerprints")
    node = F.coalesce(F.min("doc_id"), F.lit(NO_ID) + F.pmod(F.xxhash64("fp"), F.lit(1 << 61)))
    reps = table(of.groupBy("fp").agg(node.alias("node"), F.min("doc_id").alias("least")), "classes")
    labels = components(linked(reps, n))
    classes = reps.join(labels, "node", "left").select("fp", "least", F.coalesce("label", "node").alias("label"))
    if reps.where("least is null").isEmpty():
        classes = classes.select("fp", F.col("label").alias("component_id"))
    else:  # a label may stand for no doc_id
        ids = classes.groupBy("label").agg(F.min("least").alias("component_id"))
        classes = classes.join(ids, "label").select("fp", "component_id")
    return of.join(classes, "fp").select("doc_id", "fp", "component_id")


def shingles(text: str | None, ngram: int = NGRAM, seed: int = 42) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a whole text."""
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()
    h, digest = b" ".join(ws), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, ws), dtype=np.int64, count=len(ws)) + 1) - 1
    n = len(ws) - ngram + 1
    if n < 1:
        return np.array([digest(h, seed)] if ws else [], dtype=np.uint64)
    a, b = [0, *(ends[: n - 1] + 1).tolist()], ends[ngram - 1 :].tolist()
    return np.unique(np.fromiter((digest(h[x:y], seed) for x, y in zip(a, b, strict=True)), dtype=np.uint64, count=n))


_SPREAD = np.random.default_rng(7).integers(0, 1 << 63, WIDE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def wide_bits(hashes: np.ndarray) -> np.ndarray:
    """The 512 bits (0 or 1) of the SimHash of a set of shingles."""
    ones = np.zeros(64 * WIDE, dtype=np.int64)
    for k in range(0, len(hashes), 4096):
        x = hashes[k : k + 4096, None] * _SPREAD
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
    return (2 * ones > len(hashes)).astype(np.uint8)


def tile_widths(rows: int) -> tuple[int, int, int, int]:
    """For so many texts: the bits that a tile agrees on, those that its parts agree on, partings of a tile, and tiles."""
    width = WIDTH
    while rows > TILE << width:
        width += 1
    more = 0
    while rows > INNER << (width + more):
        more += 1
    # sets of four and of five shingles, the worst case at 0.8, agree on 13 of 16 bits; larger ones on 0.85
    near = 0.8125
    times = int(np.ceil(np.log(0.1) / np.log1p(-(near**more)))) if more else 1
    d = np.arange(64 * WIDE + 1)
    ways = np.r_[0, np.cumsum(np.log(d[:0:-1] / d[1:]))]
    share = np.exp(ways + d * np.log(1 - near) + d[::-1] * np.log(near))  # of such pairs, by the bits that differ
    same = d[::-1] / d[-1]
    alone = 1 - same**width * (1 - (1 - same**more) ** times)
    tiles = 1
    while share @ alone**tiles > LOST:
        tiles += 1
    return width, more, times, tiles


def _choices(rows: int) -> tuple[np.ndarray, np.ndarray]:
    width, more, times, tiles = tile_widths(rows)
    rng = np.random.default_rng(11)
    taken = np.stack([rng.choice(64 * WIDE, width, replace=False) for _ in range(tiles)])
    inner = [[rng.choice(np.setdiff1d(np.arange(64 * WIDE), t), more, replace=False) for _ in range(times)] for t in taken]
    return taken, np.array(inner, dtype=np.int64).reshape(tiles, times, more)


def tile_bits(rows: int) -> np.ndarray:
    """The bits that each tile agrees on, for so many texts: (tiles, width)."""
    return _choices(rows)[0]


def inner_bits(rows: int) -> np.ndarray:
    """The bits that the parts of each tile agree on in each of its partings: (tiles, times, bits); no bits: a tile is one part."""
    return _choices(rows)[1]


def star_bits(rows: int, rounds: int = 10) -> np.ndarray:
    """The bits of the tiles of the first rounds: (tiles, width)."""
    width = STAR_WIDTH
    while rows > STAR_TILE << width:
        width += 1
    rng = np.random.default_rng(13)
    return np.stack([rng.choice(64 * WIDE, width, replace=False) for _ in range(rounds * STAR)])


FP = [f"f{k}" for k in range(WORDS)]


def tiles_of(fp: np.ndarray, taken: np.ndarray, first: int = 0) -> np.ndarray:
    """The tiles of fingerprints (rows, WORDS) by the bits ``taken``, the first of which is tile ``first``: (rows, tiles)."""
    weights = (1 << np.arange(taken.shape[1])).astype(np.int32)
    out = np.empty((len(fp), len(taken)), dtype=np.int32)
    for k in range(0, len(fp), 256):
        bits = np.unpackbits(np.ascontiguousarray(fp[k : k + 256]).view(np.uint8), axis=1)
        out[k : k + 256] = bits[:, taken] @ weights
    return out + ((first + np.arange(len(taken), dtype=np.int32)) << taken.shape[1])


def in_tiles(rows: DataFrame, taken: np.ndarray, first: int = 0) -> DataFrame:
    """tile and the columns of ``rows`` (node, class, size, f0 to f7), for each tile of each row; an empty set has none."""

    def make(batches):
        for b in batches:
            fp = np.stack([b.column(f).to_numpy() for f in FP], axis=1)
            tiles = tiles_of(fp, taken, first)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tiles.size + 1, len(taken), dtype=np.int32)), pa.array(tiles.ravel()))
            yield b.append_column("tiles", lists)

    longs = ", ".join(f"{f} long" for f in FP)
    rows = rows.where("size > 0").select("node", "class", "size", *FP)
    return map_arrow(rows, make, f"node long, class long, size int, {longs}, tiles array<int>").select(F.explode("tiles").alias("tile"), "node", "class", "size", *FP)


def sketches(docs: DataFrame) -> DataFrame:
    """node (doc_id), key (a hash of the text), class (equal sets of shingles have one), size and f0 to f7 of each row of ``docs``."""

    def make(batches):
        for b in batches:
            place: dict = {}
            at = [place.setdefault(t, len(place)) for t in strings(b.column(1))]
            kind = np.empty(len(place), dtype=np.int64)
            size = np.empty(len(place), dtype=np.int32)
            bits = np.empty((len(place), 64 * WIDE), dtype=np.uint8)
            for k, t in enumerate(place):
                x = shingles(t)
                kind[k], size[k], bits[k] = _class(x), len(x), wide_bits(x)
            fp = np.packbits(bits[:, : 64 * WORDS], axis=1).view(np.int64)
            at = pa.array(at, pa.int64())
            cols = [pa.array(kind), pa.array(size), *(pa.array(np.ascontiguousarray(fp[:, k])) for k in range(WORDS))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(c.take(at) for c in cols)], names=["node", "key", "class", "size", *FP])

    longs = ", ".join(f"{f} long" for f in FP)
    return map_arrow(_named(docs), make, f"node long, key long, class long, size int, {longs}")


def _class(hashes: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(hashes.tobytes()) - (1 << 63)


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("node"), "text", F.xxhash64("text").alias("key"))


def sieve(rows: DataFrame, n: int) -> DataFrame:
    """One row: ``_sieve``, an array of longs with a bit set for each (node, key) of ``rows``, ``n`` or fewer; two bytes for a row.

    It is small enough to be broadcast where the rows are not, so that texts are sifted where they are read instead of shuffled."""
    words = max(1, n // 4)
    bit = F.pmod(F.xxhash64("node", "key", F.lit(5)), F.lit(64 * words))
    some = rows.select(bit.alias("h")).groupBy(F.expr("h div 64").alias("id")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("bits"))
    all_ = rows.sparkSession.range(words).join(some, "id", "left").select("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))
    got = all_.agg(F.sort_array(F.collect_list(F.struct("id", "bits"))).alias("x"), F.lit(words).cast("long").alias("_words"))
    return table(got.select(F.col("x.bits").alias("_sieve"), "_words"), "sieve")


def sifted(docs: DataFrame, by: DataFrame) -> DataFrame:
    """``docs`` (node, key and others) with ``_may``: false only for rows that are not in the sieve ``by``."""
    return docs.crossJoin(F.broadcast(by)).withColumn("_h", F.pmod(F.xxhash64("node", "key", F.lit(5)), 64 * F.col("_words"))).withColumn("_may", F.expr("(shiftright(_sieve[cast(_h div 64 as int)], cast(_h % 64 as int)) & 1) = 1")).drop("_sieve", "_words", "_h")


def sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """class, set of the rows of ``docs`` that stand for their class in ``reps`` (class, node, key), and of a few more."""

    def make(batches):
        for b in batches:
            sets = [shingles(t) for t in strings(b.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array([_class(x) for x in sets], pa.int64()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["class", "set"])

    rows = sifted(_named(docs), sieve(reps, reps.count())).where("_may").select("text")
    return map_arrow(rows, make, "class long, set binary").join(reps.select("class"), "class", "left_semi").groupBy("class").agg(F.first("set").alias("set"))


def similar(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of ``pairs`` (a, b: classes), the a's whose set has the least similarity, or more, to b's; ``sets``: class, set of each."""
    many = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SHARED).alias("parts"))
    other = sets.select(F.col("class").alias("b"), F.col("set").alias("y")).join(many, "b").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    own = F.pmod(F.xxhash64("a"), F.col("parts"))
    both = pairs.join(many, "b").select("a", "b", own.alias("part")).join(sets.select(F.col("class").alias("a"), F.col("set").alias("x")), "a").join(other, ["b", "part"])

    def decide(batches):
        for r in batches:
            keep = []
            for x, y in zip(r.column(1), r.column(2), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), dtype=np.uint64) for z in (x, y))
                lo, hi = sorted((len(x), len(y)))
                met = len(np.intersect1d(x, y, assume_unique=True)) if SIMILAR[1] * lo >= SIMILAR[0] * hi else 0
                keep.append(SIMILAR[1] * met >= SIMILAR[0] * (lo + hi - met))
            yield pa.RecordBatch.from_arrays([r.column(0).filter(pa.array(keep, pa.bool_()))], names=["class"])

    return map_arrow(both.select("a", "x", "y"), decide, "class long").distinct()


def close_pairs(fp: np.ndarray, size: np.ndarray, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of one tile that may be near copies: ``fp`` (rows, WORDS), ``size`` of their sets."""
    order = np.argsort(size, kind="stable")
    x, n = fp[order], size[order].astype(np.int64)
    pop = np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    starts = range(0, len(x), block)
    low, high = (f.reduceat(pop, starts) if len(x) else pop for f in (np.minimum, np.maximum))
    words = [np.ascontiguousarray(x[:, k]) for k in range(WORDS)]
    a, b = [], []
    for i in starts:
        for j in range(i, len(x), block):
            last = n[min(i + block, len(x)) - 1]
            if SIMILAR[1] * last < SIMILAR[0] * n[j]:
                break
            if max(low[i // block], low[j // block]) - min(high[i // block], high[j // block]) > FAR[0]:
                continue
            far = sum(np.bitwise_count(w[i : i + block, None] ^ w[None, j : j + block]) for w in words[:FIRST])
            p, q = np.nonzero(far <= FAR_FIRST[int(n[i] >= SMALL)])
            p, q = p + i, q + j
            ok = p < q
            p, q = p[ok], q[ok]
            ok = _may_be_near(x[p], x[q], n[p], n[q])
            a.append(order[p[ok]])
            b.append(order[q[ok]])
    none = np.empty(0, dtype=np.int64)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def _may_be_near(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    lo, hi = np.minimum(n, m), np.maximum(n, m)
    far = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
    return (SIMILAR[1] * lo >= SIMILAR[0] * hi) & (far <= np.where(lo < SMALL, *FAR))


def _pairs_in_parts(x: np.ndarray, size: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs that may be near copies within parts, which begin and end at ``cuts``."""
    many = np.diff(cuts)
    of = np.repeat(np.arange(len(many)), many)
    small = many[of] <= 32
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for s in range(1, min(32, int(many.max(initial=0)))):  # all small parts at once
        i = np.flatnonzero((of[s:] == of[:-s]) & small[s:])
        i = i[_may_be_near(x[i], x[i + s], size[i], size[i + s])]
        a.append(i)
        b.append(i + s)
    for k in np.flatnonzero(many > 32):
        i, j = close_pairs(x[cuts[k] : cuts[k + 1]], size[cuts[k] : cuts[k + 1]])
        a.append(i + cuts[k])
        b.append(j + cuts[k])
    return np.concatenate(a), np.concatenate(b)


def _pairs_in_tile(x: np.ndarray, size: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the pairs of a tile that are in a part together, by the ``bits`` (times, bits) of its partings, once each."""
    keys = np.zeros((len(bits), len(x)), dtype=np.uint16 if bits.shape[1] <= 16 else np.uint32)
    for key, row in zip(keys, bits.tolist(), strict=True):
        for k in row:  # bit k of the bytes, the highest of a byte first
            key *= 2
            key += (x[:, k // 64] >> np.uint64(k % 64 // 8 * 8 + 7 - k % 8)).astype(key.dtype) & 1
    a, b = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for t, key in enumerate(keys):
        order = np.argsort(key, kind="stable")
        cuts = np.r_[0, np.flatnonzero(np.diff(key[order])) + 1, len(order)]
        i, j = _pairs_in_parts(x[order], size[order], cuts)
        i, j = order[i], order[j]
        for past in keys[:t]:
            ok = past[i] != past[j]
            i, j = i[ok], j[ok]
        a.append(i)
        b.append(j)
    return np.concatenate(a), np.concatenate(b)


def pairs_in_tiles(taken: np.ndarray, inner: np.ndarray | None = None):
    """From rows (tile, part, class, size, f0 to f7) in order of tile and part to the pairs of classes that may be near copies, each from the first
    tile that finds it (of the parts of a large tile, several may give one pair). ``inner``: the bits of the tiles' partings."""
    if inner is None:
        inner = np.empty((len(taken), 1, 0), dtype=np.int64)

    def from_first(a: np.ndarray, b: np.ndarray, x: np.ndarray, at: int) -> np.ndarray:
        out = np.ones(len(a), dtype=bool)
        for k in range(0, len(a), 1 << 13):
            p, q, keep = (y[k : k + (1 << 13)] for y in (a, b, out))
            differ = np.unpackbits((x[p] ^ x[q]).view(np.uint8), axis=1).astype(bool)
            for t in range(at):
                some = np.flatnonzero(keep)
                some = some[~differ[np.ix_(some, taken[t])].any(axis=1)]
                keep[some] = differ[some[:, None, None], inner[t]].any(axis=2).all(axis=1)
        return out

    def find(batches):
        held: list[list[np.ndarray]] = []

        def flush(last: bool):
            nonlocal held
            if not held:
                return
            tile, part, kind, size, *fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cuts = np.r_[0, np.flatnonzero((np.diff(tile) != 0) | (np.diff(part) != 0)) + 1, len(tile)]
            if not last:
                cuts = cuts[:-1]
            done = cuts[-1]
            held = [[x[done:] for x in (tile, part, kind, size, *fp)]] if done < len(tile) else []
            x = np.stack([f[:done] for f in fp], axis=1).view(np.uint64)
            for begin, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                at = int(tile[begin]) >> taken.shape[1]
                a, b = _pairs_in_tile(x[begin:end], size[begin:end], inner[at])
                a, b = a + begin, b + begin
                ok = from_first(a, b, x, at)
                a, b = kind[a[ok]], kind[b[ok]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        count = 0
        for r in batches:
            held.append([r.column(k).to_numpy() for k in range(4 + WORDS)])
            count += r.num_rows
            if count >= 200_000:
                yield from flush(False)
                count = 0
        yield from flush(True)

    return find


def candidates(rows: DataFrame, n: int, taken: np.ndarray, inner: np.ndarray | None = None, part: int = PART) -> DataFrame:
    """a, b: the pairs of classes in ``rows`` (node, class, size, f0 to f7) that share a part of a tile and may be near copies."""
    zero = F.lit(0).cast("long")
    flat = in_tiles(rows, taken).drop("node")
    hot = table(flat.groupBy("tile").agg(F.count(F.lit(1)).alias("n")).where(f"n > {part}").select("tile", F.ceil(2 * F.col("n") / part).alias("parts")), "hot-tiles")
    if not hot.isEmpty():  # part p of a tile meets part q in the tile's pair (p, q); each pair holds both parts
        own = F.pmod(F.xxhash64("class"), F.col("parts"))
        pairs = F.transform(F.sequence(zero, F.col("parts") - 1), lambda q: F.least(F.col("own"), q) * F.col("parts") + F.greatest(F.col("own"), q))
        split = flat.join(hot, "tile").withColumn("own", own).select("tile", F.explode(pairs).alias("part"), "class", "size", *FP)
        flat = flat.join(hot, "tile", "left_anti").select("tile", zero.alias("part"), "class", "size", *FP).unionByName(split)
    else:
        flat = flat.select("tile", zero.alias("part"), "class", "size", *FP)
    flat = flat.repartition(parts(n), "tile", "part").sortWithinPartitions("tile", "part")
    return map_arrow(flat, pairs_in_tiles(taken, inner), "a long, b long", 0).distinct()


def stars(rows: DataFrame, taken: np.ndarray, first: int) -> DataFrame:
    """a, b: of each class in ``rows`` that may be a near copy of the first row of one of ``STAR`` tiles, the first such row's class.

    The first rows are broadcast: there are 8192 at most for 16.7 million texts, then twice as many for twice the texts."""
    flat = in_tiles(rows, taken[first : first + STAR], first)
    p = flat.groupBy("tile").agg(F.min(F.struct("node", "class", "size", *FP)).alias("p"))
    far = sum((F.bit_count(F.col(f).bitwiseXOR(F.col(f"p.{f}"))) for f in FP), F.lit(0))
    lo, hi = F.least("size", "p.size"), F.greatest("size", "p.size")
    close = (SIMILAR[1] * lo >= SIMILAR[0] * hi) & (far <= F.when(lo < SMALL, FAR[0]).otherwise(FAR[1]))
    found = flat.join(F.broadcast(p), "tile").where((F.struct("node", "class") > F.struct("p.node", "p.class")) & close)
    return found.groupBy("class").agg(F.min(F.struct("p.node", "p.class")).alias("p")).select(F.col("class").alias("a"), F.col("p.class").alias("b"))


def _near(pairs: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """class: those a of ``pairs`` that are near copies of their b; sets are only made of the classes in ``pairs``."""
    some = pairs.select(F.col("a").alias("class")).unionByName(pairs.select(F.col("b").alias("class"))).distinct()
    sets = table(sets_of(docs, table(reps.join(some, "class", "left_semi").select("class", "node", "key"), "some-classes")), "sets")
    out = table(similar(pairs, sets), "copies")
    drop(sets)
    return out


def without_near_copies(of: DataFrame, docs: DataFrame, rows: int) -> DataFrame:
    """node, key, class of the classes in ``of`` (a table of :func:`sketches` of ``docs``, ``rows`` of them) that stay, each by its first row."""
    same = [F.first(c).alias(c) for c in ("size", *FP)]
    reps = table(of.groupBy("class").agg(F.min(F.struct("node", "key")).alias("r"), *same).select("class", "r.*", "size", *FP), "classes")
    n, now, gone, k, taken = shards(docs), reps, [], 0, star_bits(rows)
    while k <= len(taken) - STAR:
        pairs = table(stars(now, taken, k), "pairs")
        gone.append(_near(pairs, reps, docs))
        was, now, k = now, table(now.join(gone[-1], "class", "left_anti"), "left"), k + STAR
        if was is not reps:
            drop(was)
        if gone[-1].count() <= AGAIN * pairs.count():
            break
    pairs = table(candidates(now, n, *_choices(rows)), "candidates")
    order = reps.select("class", F.struct("node", "class").alias("r"))
    x, y = order.select(F.col("class").alias("a"), F.col("r").alias("x")), order.select(F.col("class").alias("b"), F.col("r").alias("y"))
    lo, hi = F.least("x", "y"), F.greatest("x", "y")
    pairs = table(pairs.join(x, "a").join(y, "b").select(hi["class"].alias("a"), lo["class"].alias("b")), "pairs")
    gone.append(_near(pairs, reps, docs))
    out = reps.select("node", "key", "class")
    for less in gone:
        out = out.join(less, "class", "left_anti")
    return out


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies of a smaller doc_id, once each."""
    of = table(sketches(docs), "sketches")
    kept = table(without_near_copies(of, docs, of.count()).select("node", "key"), "kept")
    gone = table(of.select("node", "key").distinct().join(kept, ["node", "key"], "left_anti"), "gone")
    # rows outside the sieve stay; only what may go is matched exactly
    names = {"node": F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)), "key": F.xxhash64("text")}
    mine = docs.select(F.struct(*docs.columns).alias("_row"), *[c.alias(k) for k, c in names.items()])
    mine = sifted(mine, sieve(gone, gone.count()))
    # an outer join, as Spark would push an anti join below the sieve, and shuffle every text
    found = gone.select("node", "key", F.col("node").alias("_gone"))
    out = mine.where("not _may").unionByName(mine.where("_may").join(found, ["node", "key"], "left").where("_gone is null").select(*mine.columns)).select("_row.*")
    if of.groupBy("node", "key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        return out
    return out.withColumn("_tidewater_key", F.xxhash64("text")).dropDuplicates(["doc_id", "_tidewater_key"]).select(docs.columns)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = near_duplicates(read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
