"""Orders and intents: rule checks with first-failing reasons, request rows, state rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewater.functions import identity
from tidewater.operators.ticks import blank, first_reason

#: Fields of an intent's identity, and those that its content hash takes besides.
IDENTITY = ["version", "account_scope_id", "partition_id", "candidate_id", "token", "exchange", "symbol", "side", "quantity", "order_type", "limit_price_paise", "strategy_id", "strategy_version", "rule_id", "detection_ts"]
CONTENT = [*IDENTITY, "created_ts", "expires_ts", "trade_context_id", "product", "validity"]


def intents(df: DataFrame) -> DataFrame:
    """Adds trade_context_id, instruction_id and request_hash."""
    x = df.withColumn("trade_context_id", identity.trade_context_id(*[F.col(c) for c in ("version", "account_scope_id", "token", "candidate_id")]))
    return x.withColumn("instruction_id", identity.instruction_id(*[F.col(c) for c in IDENTITY])).withColumn("request_hash", identity.content_hash(*[F.col(c) for c in CONTENT]))


def intent_reason(now: Column) -> Column:
    """Why an intent is refused; null if it isn't."""
    c = F.col
    return first_reason([
        ("scope", blank("account_scope_id")), ("partition", blank("partition_id")), ("instruction-id", ~c("instruction_id").rlike(r"^ei-v1-[0-9a-f]{64}$") | c("instruction_id").isNull()), ("request-hash", ~c("request_hash").rlike(r"^[0-9a-fA-F]{64}$") | c("request_hash").isNull()),
        ("side", ~c("side").isin("BUY", "SELL") | c("side").isNull()), ("quantity", c("quantity").isNull() | (c("quantity") <= 0)), ("limit-price", (c("order_type") == "LIMIT") & (c("limit_price_paise").isNull() | (c("limit_price_paise") <= 0))),
        ("expired", c("expires_ts").isNull() | (c("expires_ts") <= now)),
    ])


def decision_reason() -> Column:
    """Why a trade decision is refused; null if it isn't."""
    c = F.col
    return first_reason([
        ("side", ~c("side").isin("BUY", "SELL") | c("side").isNull()), ("order-type", ~c("order_type").isin("LIMIT", "MARKET") | c("order_type").isNull()), ("limit-price", (c("order_type") == "LIMIT") & (F.coalesce("limit_price_paise", F.lit(0)) <= 0)),
        ("market-price", (c("order_type") == "MARKET") & c("limit_price_paise").isNotNull()), ("expiry", c("expires_ts") <= c("created_ts")), ("score", c("score").isNull() | F.isnan("score") | (F.abs("score") == float("inf"))),
    ])


def fill_rows(reports: DataFrame) -> DataFrame:
    """Reports with a quantity and a price as fills; the broker's time falls back to the time of receipt."""
    return reports.where("fill_qty > 0 and fill_price_paise > 0").withColumn("event_time", F.coalesce("broker_time", "receive_time")).withColumn("source_version", identity.source_version(F.col("receive_time"), F.col("event_id")))


def position_row(state: Column, at: Column) -> Column:
    """status, closed_ts and closed_reason of a position; a state that isn't one fails."""
    closed = state.isin("CLOSED", "FLAT")
    status = F.when(closed, "CLOSED").when(state == "OPEN", "OPEN").otherwise(F.raise_error(F.concat(F.lit("no such position state: "), state)).cast("string"))
    return F.struct(status.alias("status"), F.when(closed, at).alias("closed_ts"), F.when(closed, state).alias("closed_reason"))


def audit_document(**blocks: Column) -> Column:
    """A nested audit document as JSON: keys in the given order, nulls kept."""
    return F.to_json(F.struct(*[v.alias(k) for k, v in blocks.items()]), {"ignoreNullFields": "false"})


def sealed(df: DataFrame, column: str, key: Column, out: str = "sealed") -> DataFrame:
    """``column`` encrypted (AES-GCM; 16, 24 or 32 bytes of key)."""
    return df.withColumn(out, F.aes_encrypt(F.col(column), key, F.lit("GCM"), F.lit("DEFAULT")))


def opened(df: DataFrame, column: str, key: Column, out: str = "opened") -> DataFrame:
    return df.withColumn(out, F.aes_decrypt(F.col(column), key, F.lit("GCM"), F.lit("DEFAULT")).cast("string"))
