"""Lookups and correlations as planner-chosen joins (no side is forced to broadcast; Spark checks sizes)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def enriched(df: DataFrame, dim: DataFrame, on: str, missing: str = "MISSING_INSTRUMENT") -> DataFrame:
    """Left join with a dimension; ``reason`` names the rows it doesn't know."""
    return df.join(dim.withColumn("_known", F.lit(True)), on, "left").withColumn("reason", F.when(F.col("_known").isNull(), missing)).drop("_known")


def orphans(df: DataFrame, of: DataFrame, on: list[str]) -> DataFrame:
    """Rows without a match."""
    return df.join(of.select(*on).distinct(), on, "left_anti")


def drift(live: DataFrame, manifest: DataFrame) -> DataFrame:
    """Names in one list only: name, side (missing: from live, extra: in live)."""
    return manifest.exceptAll(live).withColumn("side", F.lit("missing")).unionByName(live.exceptAll(manifest).withColumn("side", F.lit("extra")))


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, most_age: int | None = None) -> DataFrame:
    """The latest right value at or before each left row's time, by key; null if it is older than ``most_age``.

    Both sides go through one window by key and time instead of a range join, so each row is shuffled once."""
    r = right.select(key, F.col(time).alias("_t"), F.struct(F.col(time).alias("at"), F.col(value).alias("v")).alias("_r"), F.lit(0).alias("_side"))
    l_ = left.select(key, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    x = r.unionByName(l_, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    ok = F.lit(True) if most_age is None else F.col("_t") - F.col("_m.at") <= most_age
    return x.select("_l.*", F.when(ok, F.col("_m.v")).alias(value))


def interpolated(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """``value`` of the right series at each left time, on the line between its neighbours; null outside the series.

    The next neighbour is the last one in reverse order: a frame up to the end of the key would be read anew for every row."""
    before = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key).orderBy(F.desc("_t"), F.desc("_side")).rowsBetween(Window.unboundedPreceding, 0)
    r = right.select(key, F.col(time).alias("_t"), F.struct(F.col(time).alias("t"), F.col(value).cast("double").alias("v")).alias("_r"), F.lit(0).alias("_side"))
    l_ = left.select(key, F.col(time).alias("_t"), F.struct(*left.columns).alias("_l"), F.lit(1).alias("_side"))
    x = r.unionByName(l_, allowMissingColumns=True)
    x = x.withColumn("_a", F.last("_r", ignorenulls=True).over(before)).withColumn("_b", F.last("_r", ignorenulls=True).over(after)).where("_side = 1")
    a, b = F.col("_a"), F.col("_b")
    line = F.when(F.col("_t") == a["t"], a["v"]).when(b["t"] > a["t"], a["v"] + (b["v"] - a["v"]) * (F.col("_t") - a["t"]) / (b["t"] - a["t"]))
    return x.select("_l.*", line.alias(value))


def context(c: DataFrame, back: int) -> DataFrame:
    """Adds ``context``: the close of the candle exactly ``back`` bars earlier in the series, null if there is none."""
    frame = F.col("window_end") - F.col("window_start")
    past = c.select("token", "tf", (F.col("window_start") + back * frame).alias("window_start"), F.col("close_paise").alias("context"))
    return c.join(past, ["token", "tf", "window_start"], "left")


def slices(keys: DataFrame, c: DataFrame, count: int) -> DataFrame:
    """For each (token, tf, tf_ms, newest): closes of the ``count`` bars up to ``newest`` by arithmetic, newest first, null where missing."""
    want = keys.select("token", "tf", "newest", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: F.col("newest") - k * F.col("tf_ms"))).alias("k", "window_start"))
    got = want.join(c.select("token", "tf", "window_start", "close_paise"), ["token", "tf", "window_start"], "left")
    return got.groupBy("token", "tf", "newest").agg(F.sort_array(F.collect_list(F.struct("k", "close_paise"))).alias("s")).select("token", "tf", "newest", F.transform("s", lambda x: x["close_paise"]).alias("slice"))


def _one_of(attempts: DataFrame, keys: list[str], out: str) -> DataFrame:
    """keys, ``out`` (the instruction) and ``out``_many (whether there is more than one) of the rows with all keys."""
    given = attempts.where(" and ".join(f"{k} is not null" for k in keys))
    return given.groupBy(*keys).agg(F.min("instruction_id").alias(out), (F.min("instruction_id") != F.max("instruction_id")).alias(f"{out}_many"))


def correlated(reports: DataFrame, attempts: DataFrame, reconciled: DataFrame) -> DataFrame:
    """Reports (report_id, account, broker_order_id, client_ref) with the instruction they belong to, or why none is named.

    A broker id decides: by the attempt that has it, else by an approved reconciliation (account, broker_order_id,
    instruction_id); an echoed client reference may only contradict it. Without a broker id the client reference decides."""
    filled = lambda c: F.nullif(F.trim(F.col(c).cast("string")), F.lit(""))
    x = reports.withColumns({"broker_order_id": F.when(filled("broker_order_id").isNotNull(), F.col("broker_order_id")), "client_ref": F.when(filled("client_ref").isNotNull(), F.col("client_ref"))})
    x = x.join(_one_of(attempts, ["broker_order_id"], "_b"), "broker_order_id", "left").join(_one_of(attempts, ["client_ref"], "_c"), "client_ref", "left")
    x = x.join(_one_of(reconciled, ["account", "broker_order_id"], "_r"), ["account", "broker_order_id"], "left")
    by_id = F.col("broker_order_id").isNotNull()
    base = F.when(by_id, F.coalesce("_b", "_r")).otherwise(F.col("_c"))
    many = F.when(by_id, F.coalesce("_b_many", "_r_many")).otherwise(F.col("_c_many"))
    other = by_id & F.col("_c").isNotNull() & (F.col("_c_many") | (F.col("_c") != base))
    word = (
        F.when(~by_id & F.col("client_ref").isNull(), "MISSING_BROKER_ID").when(base.isNull(), "NO_MATCHING_INSTRUCTION")
        .when(many | other, "AMBIGUOUS_CORRELATION").otherwise("CORRELATED")
    )
    return x.select("report_id", F.when(word == "CORRELATED", base).alias("instruction_id"), word.alias("correlation"))


def resolved(reports: DataFrame, attempts: DataFrame) -> DataFrame:
    """Reports (report_id, attempt_id, broker_order_id, client_ref) by all three keys: CORRELATED if those that are known name one
    instruction, AMBIGUOUS if they name several, MISSING if none is known."""
    x = reports
    for k, out in (("attempt_id", "_a"), ("broker_order_id", "_b"), ("client_ref", "_c")):
        x = x.join(_one_of(attempts, [k], out), k, "left")
    low, high = F.least("_a", "_b", "_c"), F.greatest("_a", "_b", "_c")
    many = F.coalesce("_a_many", F.lit(False)) | F.coalesce("_b_many", F.lit(False)) | F.coalesce("_c_many", F.lit(False))
    word = F.when(low.isNull(), "MISSING").when(many | (low != high), "AMBIGUOUS").otherwise("CORRELATED")
    return x.select("report_id", F.when(word == "CORRELATED", low).alias("instruction_id"), word.alias("resolution"))


def slots(tokens: DataFrame, limit: int, prefix: str = "slot-") -> DataFrame:
    """token, place, slot, request: distinct positive tokens in ascending order cut into slots of ``limit``.

    The place is a count of smaller tokens, added up from range-partitioned parts; no task gets all tokens."""
    from pyspark.sql.functions import spark_partition_id

    n = int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = tokens.where("token > 0").select("token").distinct().repartitionByRange(n, "token").withColumn("_p", spark_partition_id())
    t = t.withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy("token")))
    size = t.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    base = size.withColumn("_b", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    x = t.join(base, "_p").withColumn("place", F.col("_r") + F.col("_b") - 1)
    return x.select("token", "place", F.concat(F.lit(prefix), F.floor(F.col("place") / limit).cast("string")).alias("slot"))


def suppression(orders: DataFrame, slot_of: DataFrame, state: DataFrame) -> DataFrame:
    """Adds ``verdict`` to orders (token, epoch of the input, published: null for new work, else whether the decision went out).

    While a token's slot (``state``: slot, status, epoch) is UNSAFE, and after it RECOVERED for input of an epoch before the
    recovery's, new work is suppressed and what isn't published is discarded; tokens and slots that are unknown pass."""
    x = orders.join(slot_of.select("token", "slot"), "token", "left").join(state.select("slot", "status", F.col("epoch").alias("_e")), "slot", "left")
    held = (F.col("status") == "UNSAFE") | (F.col("epoch") < F.col("_e"))
    v = F.when(F.col("status").isNull() | ~held | F.coalesce("published", F.lit(False)), "ALLOW").when(F.col("published").isNull(), "SUPPRESS_NEW").otherwise("DISCARD_INFLIGHT")
    return x.withColumn("verdict", v).drop("status", "_e")


def dedup_verdict(incoming: DataFrame, known: DataFrame) -> DataFrame:
    """FIRST, DUPLICATE or HASH_VIOLATION of each (instruction_id, request_hash) against a durable index."""
    x = incoming.join(known.select("instruction_id", F.col("request_hash").alias("_h")), "instruction_id", "left")
    return x.withColumn("verdict", F.when(F.col("_h").isNull(), "FIRST").when(F.col("_h") == F.col("request_hash"), "DUPLICATE").otherwise("HASH_VIOLATION")).drop("_h")


def current(df: DataFrame, keys: list[str], version: str, arrival: str) -> DataFrame:
    """One row a key: the highest version, of equal versions the one that came last."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, arrival)).alias("_r"))
    return best.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def version_outcome(df: DataFrame, key: str, version: str, order: str, same: Column) -> DataFrame:
    """UNKNOWN, APPLIED, or for equal versions DUPLICATE and CONFLICT, for older ones STALE and REGRESSION, of each row against the
    highest version before it (``same``: whether its content is the same)."""
    top = F.max(F.when(F.col(version) >= 0, F.col(version))).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    old = F.when(F.col(version) < top, F.when(same, "STALE").otherwise("REGRESSION")).otherwise(F.when(same, "DUPLICATE").otherwise("CONFLICT"))
    return df.withColumn("outcome", F.when(F.col(version) < 0, "UNKNOWN").when(top.isNull() | (F.col(version) > top), "APPLIED").otherwise(old))


def immutability(df: DataFrame, key: str, content: str, order: str) -> DataFrame:
    """ACCEPTED for a key's first row, DUPLICATE for later ones of equal content, else VIOLATION."""
    w = Window.partitionBy(key).orderBy(order)
    v = F.when(F.row_number().over(w) == 1, "ACCEPTED").when(F.col(content).eqNullSafe(F.first(content).over(w)), "DUPLICATE").otherwise("VIOLATION")
    return df.withColumn("outcome", v)
