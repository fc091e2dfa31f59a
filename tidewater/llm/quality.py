"""Quality rules: base counts of each text, then robust multivariate outliers by language and source.

Each document's transformed statistics (``FEATURES``) are held against its group's minimum covariance
determinant estimate. Groups are (lang, source) pairs; pairs of fewer than ``MIN_GROUP`` fitted rows are held
against all rows of their language, and those of languages with fewer against all rows. There are four starts
(around the medians, the shortest halves and the outer quartiles); each takes concentration steps (the half nearest to
the centre gives the next centre and covariance) until its determinant stands still, and the least determinant wins.
It is made consistent for the normal distribution, and reweighted once. Quantiles come from
counted bins and moments from partial sums, so a group of any size is only ever added up, never gathered.

A row is fitted if it passes the base rules; its verdict is "kept" if its squared Mahalanobis distance is at
most ``CUTOFF``. Ratios are taken with additive counts, so that short texts lie near the centre, and variances
have a floor, so that statistics which are nearly constant don't reject by themselves.

Cases: a null text has no words and fails the base rules; null lang or source are values like others; repeated
rows each get their row; a table with no fitted row needs no estimate; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.llm.common import SPACES, drop, map_arrow, read, strings, table

SYMBOLS = "#*$%&|<>"
#: log of the mean word length; roots of the shares of symbols, of other marks, of capitals, of repeated lines.
FEATURES = 5
#: Smallest standard deviations of the features.
FLOOR = (0.06, 0.03, 0.03, 0.04, 0.25)
MIN_GROUP = 200
SHARE = 0.5
#: Steps end when no start's log determinant falls by more than ``STILL`` below its least so far.
STILL = 0.01
#: Squared distance beyond which a text is an outlier: the 99.99 % point of chi-square with five degrees of freedom.
CUTOFF = 25.74
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
X = [f"x{k}" for k in range(FEATURES)]
C = [f"c{k}" for k in range(FEATURES)]
PAIRS = [(i, j) for i in range(FEATURES) for j in range(i + 1)]
V = [f"v{i}{j}" for i, j in PAIRS]

_KINDS: dict[str, np.ndarray] = {}


def _kinds() -> np.ndarray:
    """By code point: 1 letter or digit, 2 capital letter, 0 other."""
    if not _KINDS:
        _KINDS["of"] = np.array([2 if (c := chr(k)).isupper() and c.isalpha() else 1 if c.isalnum() else 0 for k in range(0x110000)], dtype=np.uint8)
    return _KINDS["of"]


def repeated(ws: list[bytes], window: int = 5) -> int:
    """Words in windows that occur twice or more."""
    n = len(ws) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, ws), dtype=np.int64, count=len(ws)).view(np.uint64)
    key = h[:n].copy()
    for k in range(1, window):
        key = key * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():  # windows whose hashes differ differ
        return 0
    some = np.zeros(n, dtype=bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    seen: dict = {}
    covered = np.zeros(len(ws), dtype=bool)
    for k in np.flatnonzero(some).tolist():
        first = seen.setdefault(tuple(ws[k : k + window]), k)
        if first != k:
            covered[first : first + window] = covered[k : k + window] = True
    return int(covered.sum())


def counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS``, then letters and digits, capitals, and lines with a word."""
    text = text or ""
    ws = text.encode("utf-8", "surrogatepass").split()
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    kind = np.bincount(_kinds()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)], minlength=3) if text else (0, 0, 0)
    return (
        len(ws), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated(ws),
        int(kind[1] + kind[2]), int(kind[2]), len(lines),
    )


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed and the features of each row."""
    names = [*COUNTS, "letters", "capitals", "lines"]

    def make(batches):
        for b in batches:
            got = np.array([counts(t) for t in strings(b.column(3))], dtype=np.int64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *(pa.array(got[:, k].copy()) for k in range(len(names)))], names=["doc_id", "lang", "source", *names])

    rows = map_arrow(docs.select("doc_id", F.col("lang").cast("string"), F.col("source").cast("string"), "text"), make, "doc_id long, lang string, source string, " + ", ".join(f"{x} long" for x in names))
    chars = F.col("word_chars") + 100
    other = F.greatest(F.lit(0), F.col("word_chars") - F.col("letters") - F.col("n_symbols"))
    x = [
        F.log(chars / (F.col("n_words") + 20)), F.sqrt(F.col("n_symbols") / chars), F.sqrt((other + 3) / chars),
        F.sqrt((F.col("capitals") + 2) / chars), F.sqrt(F.col("n_dup_lines") / (F.col("lines") + 1)),
    ]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return rows.select("doc_id", "lang", "source", *COUNTS, failed.alias("base_failed"), *[e.alias(n) for e, n in zip(x, X, strict=True)])


def _quantiles(binned: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, q0, q1, ...: the bins that hold these shares of the rows of (by, bin)."""
    n = binned.groupBy(*by, "bin").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*by)
    run = n.withColumn("upto", F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(w))
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("upto") >= s * F.col("all"), F.col("bin"))).alias(f"q{k}") for k, s in enumerate(shares)])


def chi2_cdf(x: float, k: int) -> float:
    t = np.linspace(0, x, 20001)[1:]
    grid = np.exp((k / 2 - 1) * np.log(t) - t / 2)
    far = np.linspace(0, x + 200, 200001)[1:]
    whole = np.exp((k / 2 - 1) * np.log(far) - far / 2)
    return float(np.trapezoid(grid, t) / np.trapezoid(whole, far))


def chi2_quantile(p: float, k: int) -> float:
    a, b = 0.0, 200.0
    for _ in range(60):
        m = (a + b) / 2
        a, b = (m, b) if chi2_cdf(m, k) < p else (a, m)
    return (a + b) / 2


def _distance() -> Column:
    """Squared Mahalanobis distance of X from C under the inverse covariance V."""
    d = [F.col(x) - F.col(c) for x, c in zip(X, C, strict=True)]
    return sum(((1 if i == j else 2) * F.col(v) * d[i] * d[j] for (i, j), v in zip(PAIRS, V, strict=True)), F.lit(0.0))


def _step(rows: DataFrame, now: DataFrame, nearest: DataFrame | float, scale: float) -> DataFrame:
    """The next estimate: of each group's rows within the distance ``nearest`` (by group, or one for all); its covariance times ``scale``."""
    x = rows.join(now, "grp").withColumn("d2", _distance())
    x = x.join(nearest, "grp").where("d2 <= near") if isinstance(nearest, DataFrame) else x.where(F.col("d2") <= nearest)
    d = [F.col(a) - F.col(c) for a, c in zip(X, C, strict=True)]
    sums = x.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in C], *[F.sum(e).alias(f"s{k}") for k, e in enumerate(d)], *[F.sum(d[i] * d[j]).alias(f"m{i}{j}") for i, j in PAIRS])

    def invert(batches):
        for b in batches:
            got = {f.name: b.column(k).to_numpy(zero_copy_only=False) for k, f in enumerate(b.schema) if f.name != "grp"}
            n = got["n"].astype(float)
            mean = np.stack([got[f"s{k}"] / n for k in range(FEATURES)], axis=1)
            cov = np.zeros((len(n), FEATURES, FEATURES))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = got[f"m{i}{j}"] / n - mean[:, i] * mean[:, j]
            cov = cov * scale + np.diag(np.square(FLOOR))
            inv = np.linalg.inv(cov)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("grp")), *(pa.array(got[c] + mean[:, k]) for k, c in enumerate(C)), *(pa.array(inv[:, i, j].copy()) for i, j in PAIRS), pa.array(np.linalg.slogdet(cov)[1])], names=["grp", *C, *V, "size"])

    return map_arrow(sums, invert, "grp string, " + ", ".join(f"{c} double" for c in [*C, *V, "size"]), 0)


def estimates(rows: DataFrame) -> DataFrame:
    """grp, centre and inverse covariance, of rows (grp, X)."""
    fine = 1024
    long = rows.select("grp", F.posexplode(F.array(*X)).alias("k", "x")).select("grp", "k", F.floor(F.col("x") * fine).alias("bin"))
    q = _quantiles(long, ["grp", "k"], [n / 20 for n in range(21)])
    halves = F.array(*[F.struct((F.col(f"q{n + 10}") - F.col(f"q{n}")).alias("width"), ((F.col(f"q{n + 10}") + F.col(f"q{n}")) / 2).alias("mid")) for n in range(11)])
    q = q.withColumn("half", F.array_min(halves))
    quartiles = F.col("q15") - F.col("q5")
    starts = [(F.col("q10"), quartiles), (F.col("half.mid"), F.col("half.width")), (F.col("q5"), F.col("half.width")), (F.col("q15"), F.col("half.width"))]
    q = q.select("grp", "k", F.posexplode(F.array(*[F.struct(((m + 0.5) / fine).alias("m"), (w / fine / 1.349).alias("w")) for m, w in starts])).alias("start", "at"))
    q = q.select(F.concat_ws("\x03", "start", "grp").alias("grp"), "k", "at.*")
    centre = [F.max(F.when(F.col("k") == k, F.col("m"))).alias(C[k]) for k in range(FEATURES)]
    spread = [F.max(F.when(F.col("k") == k, F.col("w"))) for k in range(FEATURES)]
    zero = F.lit(0.0)
    start = [(1 / (spread[i] * spread[i] + FLOOR[i] ** 2)).alias(v) if i == j else zero.alias(v) for (i, j), v in zip(PAIRS, V, strict=True)]
    now = table(q.groupBy("grp").agg(*centre, *start).withColumn("least", F.lit(float("inf"))), "mcd")
    each = rows.select(F.explode(F.array(*[F.concat_ws("\x03", F.lit(str(n)), "grp") for n in range(len(starts))])).alias("grp"), *X)
    width = 64  # bins of a distance: 64 to a doubling
    scale = SHARE / chi2_cdf(chi2_quantile(SHARE, FEATURES), FEATURES + 2)
    while True:
        d = each.join(now, "grp").select("grp", F.floor(F.log2(F.greatest(_distance(), F.lit(1e-6))) * width).alias("bin"))
        near = _quantiles(d, ["grp"], [SHARE]).select("grp", F.pow(F.lit(2.0), (F.col("q0") + 1) / width).alias("near"))
        stepped = _step(each, now, near, scale).join(now.select("grp", F.col("least").alias("was")), "grp")
        new = table(stepped.withColumn("least", F.least("was", "size")), "mcd")
        change = new.agg(F.max(F.col("was") - F.col("size"))).first()[0]  # one value
        drop(now)
        now = new
        if change is None or change <= STILL:
            break
    own = F.expr("substring(grp, 3)")  # without the start's number
    best = now.groupBy(own.alias("g")).agg(F.min_by(F.struct(*C, *V), F.struct("size", "grp")).alias("e")).select(F.col("g").alias("grp"), "e.*")
    new = table(best, "mcd")
    drop(now)
    now = new
    most = chi2_quantile(0.975, FEATURES)
    new = table(_step(rows, now, most, 0.975 / chi2_cdf(most, FEATURES + 2)), "mcd")
    drop(now)
    return new


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept, the squared distance and the group of each row."""
    none = F.lit("\x00")
    lang, source = F.coalesce("lang", none), F.coalesce("source", none)
    rows = table(statistics(docs), "statistics")
    fitted = rows.where("not base_failed").groupBy(lang.alias("l"), source.alias("s")).agg(F.count(F.lit(1)).alias("n"))
    langs = fitted.groupBy("l").agg(F.sum("n").alias("pool"), F.min("n").alias("least"))
    some = F.lit("\x02")
    rare = bool(langs.agg(F.bool_or(F.col("pool") < MIN_GROUP)).first()[0])  # one value
    pair = F.concat_ws("\x01", "l", "s")
    own = F.when(F.col("n") >= MIN_GROUP, pair).when(F.col("pool") >= MIN_GROUP, F.col("l")).otherwise(some)
    fit = F.filter(F.array(F.when(F.col("n") >= MIN_GROUP, pair), F.when((F.col("pool") >= MIN_GROUP) & (F.col("least") < MIN_GROUP), F.col("l")), F.when(F.lit(rare), some)), lambda g: g.isNotNull())
    groups = fitted.join(langs, "l").select("l", "s", own.alias("grp"), fit.alias("fit"))
    groups = table(groups, "groups")
    named = rows.withColumns({"l": lang, "s": source}).join(groups, ["l", "s"], "left").drop("l", "s")
    good = table(named.where("not base_failed").select(F.explode("fit").alias("grp"), *X), "fitted")
    final = estimates(good)
    drop(good)
    d2 = named.join(final, "grp", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= CUTOFF, F.lit(True))
    return d2.select("doc_id", *COUNTS, "base_failed", kept.alias("kept"), "distance", F.when(~F.col("base_failed"), F.col("grp")).alias("grp"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents")).drop("grp")
