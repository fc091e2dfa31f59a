"""Admission of ticks: first-failing reasons, classification, payload checks, dedup, gates, sequence and time checks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import timeframes as tf

MAX_EVENT_MS = 253_402_300_799_999


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds; null if none does."""
    out = None
    for name, failed in rules:
        failed = F.coalesce(failed, F.lit(False))
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


def blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(c) == "")


def reject_reason(schema_version: str = "1") -> Column:
    """Why a raw tick is refused (null: it is valid), in the order in which the checks stand."""
    c = F.col
    return first_reason([
        ("rowkind-not-insert", ~c("change_type").isin("insert", "update_postimage")), ("blank-fingerprint", blank("fingerprint")), ("blank-fingerprint-version", blank("fingerprint_version")),
        ("schema-version", c("schema_version").isNull() | (c("schema_version") != schema_version)), ("validity-state", c("validity_state").isNull() | ~c("validity_state").isin("VALID_TRADE", "VALID_NON_TRADE")),
        ("non-positive-price", (c("validity_state") == "VALID_TRADE") & (c("price_paise") <= 0)), ("negative-qty", c("last_qty") < 0), ("negative-volume-delta", c("volume_delta") < 0),
        ("non-positive-event-time", c("event_time").isNull() | (c("event_time") <= 0)), ("event-time-overflow-window", c("event_time") > MAX_EVENT_MS),
    ])


def validity(mode: Column, price: Column) -> Column:
    return F.when(mode.isin("ltp", "ltpc") & (price <= 0), "INVALID_VALUES").when(mode.isin("ltp", "ltpc", "full") & (price > 0), "VALID_TRADE").otherwise("VALID_NON_TRADE")


def tick_type(state: Column, volume_delta: Column) -> Column:
    return F.when((state == "VALID_TRADE") & (F.coalesce(volume_delta, F.lit(0)) > 0), "TRADE").otherwise("QUOTE")


def freshness(ts: Column, received: Column, max_age_ms: int, skew_ms: int) -> Column:
    return F.when(received - ts > max_age_ms, "STALE").when(ts - received > skew_ms, "FUTURE").otherwise("FRESH")


def payload_state(payload: Column, sha256: Column, most: int = 540) -> Column:
    """VALID, or what is wrong with a payload (binary) and its claimed hash (binary)."""
    size = F.coalesce(F.octet_length(payload), F.lit(0))
    return (
        F.when((size < 1) | (size > most), "MALFORMED_PAYLOAD").when(sha256.isNull() | (F.octet_length(sha256) == 0), "MISSING_HASH").when(F.octet_length(sha256) != 32, "MALFORMED_HASH")
        .when(F.unhex(F.sha2(payload, 256)) != sha256, "HASH_MISMATCH").otherwise("VALID")
    )


def volume_delta(df: DataFrame, key: str = "token", order: str = "seq", total: str = "volume", out: str = "delta") -> DataFrame:
    """What a cumulative volume grew by; null on the first row and where it fell."""
    was = F.lag(total).over(Window.partitionBy(key).orderBy(order))
    return df.withColumn(out, F.when(F.col(total) >= was, F.col(total) - was))


def first_seen(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """Of rows with equal keys the first by ``order``: a map-side aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.col(order)).alias("_r"))
    return first.select(*[F.col(c) if c in keys else F.col("_r")[c].alias(c) for c in df.columns])


def fifo_dedup(df: DataFrame, key: str = "token", mark: str = "fingerprint", order: str = "seq", most: int = 200) -> DataFrame:
    """Per key, drops rows whose mark is among the ``most`` last distinct ones kept; a repeat doesn't refresh its place.

    State runs from row to row, so rows are sorted within hash partitions and folded as they stream by: a key's state
    is ``most`` marks, and its rows are never held together."""
    at = df.columns.index(key), df.columns.index(mark)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, seen = object(), {}
        for b in batches:
            keep = []
            for k, m in zip(b.iloc[:, at[0]], b.iloc[:, at[1]], strict=True):
                if k != now:
                    now, seen = k, {}
                fresh = m not in seen
                if fresh:
                    seen[m] = None
                    if len(seen) > most:
                        del seen[next(iter(seen))]
                keep.append(fresh)
            yield b[keep]

    return df.repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, df.schema)


def monotonic_gate(df: DataFrame, key: str = "token", order: str = "seq", time: str = "event_time", advances: Column | None = None) -> DataFrame:
    """Adds ``accepted``: whether a row's time is past all earlier advancing rows' times, in arrival order.

    Rows that are refused never exceed the running maximum, so that maximum is the gate itself."""
    counted = F.col(time) if advances is None else F.when(advances, F.col(time))
    gate = F.max(counted).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("accepted", gate.isNull() | (F.col(time) > gate))


def sequence_gaps(df: DataFrame, key: str, seq: str, order: str) -> DataFrame:
    """Adds ``missing``: numbers skipped since the highest one so far (0 for repeats and late ones, null at first)."""
    top = F.max(seq).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("missing", F.when(top.isNotNull(), F.greatest(F.lit(0).cast("long"), F.col(seq) - top - 1)))


def time_jumps(df: DataFrame, key: str, time: str, order: str, most_ms: int) -> DataFrame:
    """Adds ``jump_begins``: the first row of each run of rows whose step in time exceeds ``most_ms``."""
    w = Window.partitionBy(key).orderBy(order)
    over = F.coalesce(F.abs(F.col(time) - F.lag(time).over(w)) > most_ms, F.lit(False))
    df = df.withColumn("_over", over)
    return df.withColumn("jump_begins", F.col("_over") & ~F.coalesce(F.lag("_over").over(w), F.lit(False))).drop("_over")


def backward_steps(df: DataFrame, key: str, time: str, order: str) -> DataFrame:
    """key, rows, backward: rows whose time is before that of the row before."""
    w = Window.partitionBy(key).orderBy(order)
    x = df.withColumn("_b", (F.col(time) < F.lag(time).over(w)).cast("long"))
    return x.groupBy(key).agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum("_b"), F.lit(0)).alias("backward"))


def in_session(df: DataFrame, time: str = "event_time") -> DataFrame:
    return df.where(tf.in_session(F.col(time)))


def late_partitions(df: DataFrame, day: str, order: str, key: str) -> DataFrame:
    """Adds ``late``: whether a row's day is before the newest day seen so far for its key."""
    newest = F.max(day).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return df.withColumn("late", F.coalesce(F.col(day) < newest, F.lit(False)))
