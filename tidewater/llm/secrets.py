"""Secret scans: patterns, and how widely each candidate is owned across the corpus.

Base spans come from three patterns (assignments, access keys, long hexadecimal strings). Besides, strings of
20 or more letters and figures with mixed cases and high entropy are candidates. Every candidate's hash is
counted over the whole corpus: in how many repositories, and with how many owners, does it stand? A widely copied
example has ``EXAMPLE_OWNERS`` owners or more, or two owners and ``EXAMPLE_REPOSITORIES`` repositories or more; any other
looks live, as an owner may use a key in all repositories and share it with a second one. Live mixed-case candidates
become spans of kind ``mixed``; base spans stay whatever the count says.

Counting goes by (hash, owner, repository) first, so a candidate that stands in a third of all rows is added up
where it is read. The counts come back to the rows by a join; of candidates that are more than one in ``HOT`` of all
(of which there are fewer than that) the counts are broadcast, so their rows are not brought together. In ``documents`` the owner is the source, and the repository the source's part in a language.

Cases: null and empty texts have no spans; null owners are one owner; repeated rows each get their row and are
one repository's; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_arrow, read, strings, table

#: The base patterns, with the least number of characters (of group 2 for the first).
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # what [0-9a-f]+ finds with 24 characters or more
KINDS = ("assign", "access", "hex", "mixed")
MIXED = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
EXAMPLE_OWNERS = 3
EXAMPLE_REPOSITORIES = 6
HOT = 1000


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, kind, end, secret's start, secret's end) of the base matches, in order of start and kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end(), m.start(2), m.end(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values())


def mixed_spans(text: str, base: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int]]:
    """Long mixed-case strings of high entropy that no base span touches."""
    out = []
    for m in MIXED.finditer(text):
        s = m.group()
        if any(c.isupper() for c in s) and any(c.islower() for c in s) and any(c.isdigit() for c in s) and entropy(s) >= 3.5 and not any(a < m.end() and m.start() < b for a, _, b, _, _ in base):
            out.append(m.span())
    return out


def scan(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """row, doc_id, owner, repository and the candidates (kind, start, end, hash) of each row (written)."""

    def find(batches):
        for b in batches:
            lists: list[list] = [[], [], [], [], [], []]
            for t in strings(b.column(3)):
                t = t or ""
                base = base_spans(t)
                spans = [(a, k, e, x, y) for a, k, e, x, y in base] + [(x, 3, y, x, y) for x, y in mixed_spans(t, base)]
                for k in range(3):
                    lists[k].append([s[(1, 0, 2)[k]] for s in spans])
                lists[3].append([xxhash.xxh3_64_intdigest(t[s[3] : s[4]]) - (1 << 63) for s in spans])
                lists[4].append([s[3] for s in spans])
                lists[5].append([s[4] for s in spans])
            kinds = [pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), *(pa.array(x, k) for x, k in zip(lists, kinds, strict=True))], names=["doc_id", "owner", "repository", "text_hash", "kind", "start", "end", "hash", "from", "upto"])

    rows = map_arrow(docs.select(F.col("doc_id").cast("long"), owner.cast("string").alias("owner"), repository.cast("string").alias("repository"), "text", F.xxhash64("text").alias("text_hash")), find, "doc_id long, owner string, repository string, text_hash long, kind array<int>, start array<long>, end array<long>, hash array<long>, `from` array<long>, upto array<long>")
    return table(rows.withColumn("row", F.monotonically_increasing_id()), "candidates")


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, repositories, owners, times of each candidate (hash, owner, repository; one row for each time it occurs)."""
    none = F.lit("\x00")
    seen = candidates.groupBy("hash", F.coalesce("owner", none).alias("owner"), F.coalesce("repository", none).alias("repository")).agg(F.count(F.lit(1)).alias("times"))
    owners = seen.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("times").alias("times"))
    return owners.groupBy("hash").agg(F.sum("repositories").alias("repositories"), F.count(F.lit(1)).alias("owners"), F.sum("times").alias("times"))


def live(found: Column) -> Column:
    """Whether a candidate (repositories, owners) looks live."""
    return (found["owners"] < EXAMPLE_OWNERS) & ~((found["owners"] == 2) & (found["repositories"] >= EXAMPLE_REPOSITORIES))


def secrets(docs: DataFrame, owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """row, doc_id, text_hash, and ``found``: each row's candidates (start, kind, end, from, upto, repositories, owners, live) in order of start and kind."""
    rows = scan(docs, F.col("source") if owner is None else owner, F.concat_ws("/", "source", "lang") if repository is None else repository)
    each = rows.select("row", "owner", "repository", F.explode(F.arrays_zip("start", "kind", "end", "hash", "from", "upto")).alias("c")).select("row", "owner", "repository", "c.*")
    counts = table(ownership(each), "ownership")
    total = counts.agg(F.sum("times")).first()[0] or 0  # one value
    hot = F.broadcast(counts.where(F.col("times") * HOT > total))  # fewer than HOT rows
    owned = each.join(hot, "hash").unionByName(each.join(hot, "hash", "left_anti").join(counts, "hash"))
    one = F.struct("start", "kind", "end", "from", "upto", "repositories", "owners", live({"owners": F.col("owners"), "repositories": F.col("repositories")}).alias("live"))
    found = owned.groupBy("row").agg(F.sort_array(F.collect_list(one)).alias("found"))
    return rows.select("row", "doc_id", "text_hash").join(found, "row", "left")


def _digest(b: pa.RecordBatch):
    out = []
    for found in b.column(1).to_pylist():
        base = [x for x in found or [] if x["kind"] < 3]
        spans = [x for x in found or [] if x["kind"] < 3 or x["live"]]
        join = lambda xs: ",".join(f"{KINDS[x['kind']]}:{x['start']}:{x['end']}" for x in xs)
        n = Counter(x["kind"] for x in base)
        out.append((n[0], n[1], n[2], hashlib.sha256(join(base).encode()).hexdigest(), join(spans), sum(x["live"] for x in spans), sum(not x["live"] for x in spans)))
    return out


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(batches):
        for b in batches:
            cols = list(zip(*_digest(b), strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_live", "n_example"])

    found = secrets(read(spark, sf_dir, "documents")).select("doc_id", "found")
    return map_arrow(found, digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_live long, n_example long")


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every secret that looks live replaced by ``mark`` (n_chars follows)."""
    live = secrets(docs).select(F.col("doc_id").alias("_tidewater_id"), F.col("text_hash").alias("_tidewater_hash"), F.filter("found", lambda x: x["live"]).alias("_tidewater_live"))
    live = live.where(F.size("_tidewater_live") > 0).groupBy("_tidewater_id", "_tidewater_hash").agg(F.max("_tidewater_live").alias("_tidewater_live"))  # repeated rows have the same spans

    def cut(batches):
        for b in batches:
            at = b.schema.get_field_index("text")
            texts = []
            for t, spans in zip(strings(b.column(at)), b.column(b.schema.get_field_index("_tidewater_live")).to_pylist(), strict=True):
                last = None
                for x in sorted(spans or [], key=lambda x: -x["from"]):
                    upto = x["upto"] if last is None else min(x["upto"], last)
                    if t is not None and x["from"] < upto <= len(t):
                        t = t[: x["from"]] + mark + t[upto:]
                        last = x["from"]
                texts.append(t)
            yield b.set_column(at, "text", pa.array(texts, pa.string())).drop_columns(["_tidewater_live"])

    same = docs["doc_id"].eqNullSafe(F.col("_tidewater_id")) & (F.xxhash64(docs["text"]) == F.col("_tidewater_hash"))
    joined = docs.join(live, same, "left").select(*docs.columns, "_tidewater_live")
    changed = map_arrow(joined.where("_tidewater_live is not null"), cut, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.unionByName(joined.where("_tidewater_live is null").drop("_tidewater_live"))
