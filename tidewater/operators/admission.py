"""Admission of feed ticks in one plan, validators of control records, and subscription plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions.book import div
from tidewater.operators import joins, ticks
from tidewater.operators.ticks import blank, first_reason

#: The version of control records, their events, the reasons of quarantine, limits of a subscription.
CONTRACT_VERSION = 2
EVENTS = ["slot_state", "subscription_ack", "heartbeat_failed", "feed_stalled", "disconnect", "reconnect", "auth_failure", "bridge_shutdown"]
REASONS = ["MALFORMED_JSON", "INVALID_SCHEMA", "INVALID_VALUES", "HASH_MISMATCH", "FUTURE_BROKER_TIMESTAMP", "STALE_BROKER_TIMESTAMP"]
CONNECTIONS, PER_CONNECTION, PER_REQUEST = 3, 1024, 512


def admitted(df: DataFrame, instruments: DataFrame, max_age_ms: int, skew_ms: int) -> DataFrame:
    """Adds reason (null: the tick is admitted), validity and tick_type (null if refused) by the checks in their order:
    payload hash, time, freshness, token, instrument, feed, price.

    ``df``: payload, payload_hash (binary), ts_ms, received_ms, token, feed, mode, price_paise, volume_delta. ``instruments``:
    token (null and repeated ones count once); its size decides how Spark joins."""
    c = F.col
    known = instruments.where("token is not null").select(c("token").alias("_token")).distinct().withColumn("_known", F.lit(True))
    x = df.join(known, c("token") == c("_token"), "left")
    payload, fresh = ticks.payload_state(c("payload"), c("payload_hash")), ticks.freshness(c("ts_ms"), c("received_ms"), max_age_ms, skew_ms)
    state = ticks.validity(c("mode"), c("price_paise"))
    reason = first_reason([
        ("MISSING_PAYLOAD_HASH", payload == "MISSING_HASH"), ("HASH_MISMATCH", payload == "HASH_MISMATCH"), ("INVALID_SCHEMA", payload != "VALID"),
        ("INVALID_VALUES", c("ts_ms").isNull() | (c("ts_ms") <= 0)), ("FUTURE_BROKER_TIMESTAMP", fresh == "FUTURE"), ("STALE_BROKER_TIMESTAMP", fresh == "STALE"),
        ("INVALID_VALUES", c("token").isNull() | (c("token") <= 0)), ("MISSING_INSTRUMENT", c("_known").isNull()), ("INVALID_SCHEMA", c("feed").isNull() | ~c("feed").isin("hft", "token")),
        ("INVALID_VALUES", state == "INVALID_VALUES"),
    ])
    out = x.withColumn("reason", reason).withColumn("validity", F.when(c("reason").isNull(), state))
    return out.withColumn("tick_type", F.when(c("reason").isNull(), ticks.tick_type(c("validity"), c("volume_delta")))).drop("_token", "_known")


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) == "")


def _less(c: str, least: int) -> Column:
    return F.coalesce(F.col(c), F.lit(0)) < least


def event_reason() -> Column:
    """What is wrong with a control event; null: nothing."""
    c = F.col
    return first_reason([
        ("record-type", c("record_type").isNull() | (c("record_type") != "bridge_event")), ("contract-version", c("contract_version").isNull() | (c("contract_version") != CONTRACT_VERSION)),
        ("identity", _empty("slot_id") | _empty("connection_id")), ("state", _empty("state")), ("event", c("event").isNull() | ~c("event").isin(*EVENTS)),
        ("connection-epoch", F.coalesce(c("connection_epoch"), F.lit(0)) == 0), ("received-ts", _less("received_ts_ms", 1)),
        ("token-counts", _less("assigned_tokens", 0) | _less("acknowledged_tokens", 0) | _less("rejected_tokens", 0)),
    ])


def metrics_reason() -> Column:
    """What is wrong with a record of gauges; null: nothing."""
    c = F.col
    return first_reason([
        ("record-type", c("record_type").isNull() | (c("record_type") != "bridge_metrics")), ("contract-version", c("contract_version").isNull() | (c("contract_version") != CONTRACT_VERSION)),
        ("ts", _less("ts_ms", 1)), ("gauges", _less("reconnect_consecutive", 0) | _less("active_sockets", 0) | _less("go_goroutines", 0)),
    ])


def quarantine_reason() -> Column:
    """What is wrong with a quarantine record (raw_payload binary, payload_hash lowercase hex); null: nothing."""
    c = F.col
    return first_reason([
        ("contract-version", c("contract_version").isNull() | (c("contract_version") != CONTRACT_VERSION)), ("slot", blank("slot_id")), ("connection", blank("connection_id")),
        ("connection-epoch", _less("connection_epoch", 1)), ("token", _less("token", 0)), ("reason", c("reason").isNull() | ~c("reason").isin(*REASONS)),
        ("payload", c("raw_payload").isNull() | (F.octet_length("raw_payload") == 0)), ("hash-form", c("payload_hash").isNull() | ~c("payload_hash").rlike(r"\A[0-9a-f]{64}\z")),
        ("hash-mismatch", F.sha2("raw_payload", 256) != c("payload_hash")), ("detected-ts", _less("detected_ts_ms", 1)),
    ])


def capacity_reason(tokens: Column, connections: Column, limit: Column, production: Column, approved: Column) -> Column:
    """Why so many tokens can't be subscribed (policy before capacity); null: they can."""
    return first_reason([("PRODUCTION_POLICY", (connections > 1) & production), ("UNAPPROVED_CONNECTIONS", (connections > 1) & ~approved), ("CAPACITY", tokens > connections * limit)])


def plan_violation(tokens: DataFrame, connections: int, limit: int = PER_CONNECTION, request: int = PER_REQUEST) -> DataFrame:
    """One row: tokens, duplicates (tokens met more than once) and reason (null: the plan can be made)."""
    each = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("_n"))
    x = each.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("tokens"), F.count(F.when(F.col("_n") > 1, 1)).alias("duplicates"), F.count(F.when(F.col("token").isNull() | (F.col("token") <= 0), 1)).alias("_bad"))
    between = lambda v, most: F.lit(not 0 < v <= most)
    reason = first_reason([
        ("EMPTY", F.col("tokens") == 0), ("CONNECTIONS", between(connections, CONNECTIONS)), ("CONNECTION_LIMIT", between(limit, PER_CONNECTION)), ("REQUEST_LIMIT", between(request, PER_REQUEST)),
        ("CAPACITY", F.col("tokens") > connections * limit), ("DUPLICATE", F.col("duplicates") > 0), ("INVALID_TOKEN", F.col("_bad") > 0),
    ])
    return x.select("tokens", "duplicates", reason.alias("reason"))


def subscription_plan(tokens: DataFrame, limit: int = PER_CONNECTION, request: int = PER_REQUEST) -> DataFrame:
    """token, slot and the number of its request within the slot; ``plan_violation`` says whether the plan may be used."""
    x = joins.slots(tokens, limit, "hft-")
    return x.select("token", "slot", div(F.col("place") % limit, request).alias("request"))
