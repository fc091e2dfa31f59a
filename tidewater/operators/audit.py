"""Integrity audits: hash chains, replay convergence, deletion control, offload plans, presence gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def manifest_hashes(df: DataFrame, group: str, order: str, content: Column) -> DataFrame:
    """group, n and the SHA-256 of the group's contents in order (a day's manifest; it must fit in a task)."""
    rows = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), content.cast("string").alias("c"))))
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.transform(rows, lambda r: r["c"]), "\n"), 256).alias("hash"))


def chain(manifests: DataFrame, group: str = "day", value: str = "hash") -> DataFrame:
    """One row: the links, and the root of hashing each manifest with the link before it, in the order of groups."""
    rows = F.sort_array(F.collect_list(F.struct(group, value)))
    root = F.aggregate(rows, F.lit("genesis"), lambda link, r: F.sha2(F.concat_ws("|", r[value], link), 256))
    return manifests.agg(F.count(F.lit(1)).alias("links"), root.alias("root"))


def compare_logs(expected: DataFrame, actual: DataFrame, key: str = "event_id", content: str = "hash", order: str = "seq") -> DataFrame:
    """Every event that differs: MISSING, UNEXPECTED, DUPLICATE, TAMPERED or REORDERED."""
    a = expected.groupBy(key).agg(F.min(content).alias("_a"), F.min(order).alias("_ao"))
    b = actual.groupBy(key).agg(F.min(content).alias("_b"), F.max(content).alias("_b2"), F.min(order).alias("_bo"), F.count(F.lit(1)).alias("_n"))
    x = a.join(b, key, "full")
    v = F.when(F.col("_n").isNull(), "MISSING").when(F.col("_ao").isNull(), "UNEXPECTED").when(F.col("_n") > 1, "DUPLICATE").when((F.col("_a") != F.col("_b")) | (F.col("_b") != F.col("_b2")), "TAMPERED").when(F.col("_ao") != F.col("_bo"), "REORDERED")
    return x.select(key, v.alias("finding")).where("finding is not null")


def replay(log: DataFrame, keys: list[str], offset: str = "offset", version: str = "version") -> DataFrame:
    """The projection of a log: a row a key, the last by (offset, version)."""
    rest = [c for c in log.columns if c not in keys]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(offset, version)).alias("_r"))
    return last.select(*keys, *[F.col("_r")[c].alias(c) for c in rest])


def converges(log: DataFrame, keys: list[str], cut: int, offset: str = "offset", version: str = "version") -> DataFrame:
    """One row: keys, replayed rows, and keys that differ if the log is replayed upon its own state from an offset on."""
    whole = replay(log, keys, offset, version)
    again = replay(replay(log.where(F.col(offset) < cut), keys, offset, version).unionByName(log.where(F.col(offset) >= cut)), keys, offset, version)
    rest = [c for c in log.columns if c not in keys]
    x = whole.select(*keys, F.struct(*rest).alias("_a")).join(again.select(*keys, F.struct(*rest).alias("_b")), keys, "full")
    zero = F.lit(0).cast("long")
    same = x.agg(F.count(F.lit(1)).alias("keys"), F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("diverged"), zero.alias("replayed"))
    n = log.agg(zero.alias("keys"), zero.alias("diverged"), F.count_if(F.col(offset) >= cut).alias("replayed"))
    return same.unionByName(n).agg(*[F.sum(c).alias(c) for c in ("keys", "diverged", "replayed")])


def deletion_decision(evidence: Column, authorizers: Column, authorized: Column, policy_met: Column, legal_hold: Column) -> Column:
    return F.when(~evidence, "MISSING_EVIDENCE").when(authorizers < 2, "SINGLE_AUTHORIZER").when(~authorized, "UNAUTHORIZED").when(~policy_met, "POLICY").when(legal_hold, "LEGAL_HOLD").otherwise("APPROVED")


def offload_plan(days: DataFrame) -> DataFrame:
    """Days (day, state) that may expire: those verified before the first that isn't."""
    first = days.where("state <> 'VERIFIED'").agg(F.min("day")).first()[0]  # one value
    return days.withColumn("expires", (F.col("state") == "VERIFIED") & (F.lit(True) if first is None else F.col("day") < first))


def absent(samples: DataFrame, stages: list[str], stage: str = "stage") -> DataFrame:
    """Required stages without a sample."""
    want = samples.sparkSession.createDataFrame([(s,) for s in stages], f"{stage} string")
    return want.join(samples.select(stage), stage, "left_anti")


def unowned(writes: dict[str, set[str]], owners: dict[str, set[str]]) -> list[tuple[str, str]]:
    """(writer, column) pairs that a writer doesn't own."""
    return sorted((w, c) for w, cols in writes.items() for c in cols - owners.get(w, set()))


def schema_violations(df: DataFrame, wanted: str) -> list[str]:
    """How a DataFrame's columns differ from a contract (a DDL string); empty if they don't."""
    from pyspark.sql.types import StructType

    want = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(wanted)}
    have = dict(df.dtypes)
    return sorted([f"missing {c}" for c in want.keys() - have.keys()] + [f"extra {c}" for c in have.keys() - want.keys()] + [f"{c}: {have[c]} instead of {want[c]}" for c in want.keys() & have.keys() if want[c] != have[c]])
