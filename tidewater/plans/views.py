"""Views that derive market-like tables from the stored ones, each with the same view as SQL.

``ticks`` spreads the events over trading days: 1.5 seconds apart on the whole, out of order by up to 8 seconds, from
before the open on even days, and past the close on odd ones. ``fills`` and ``reports`` come from order lines and orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.functions.book import div

#: Three minutes before the open of 2024-01-01.
BEGIN_MS = 1_704_080_520_000
PER_DAY = 3_000
ODD_MS = 18_600_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, i = read(spark, sf_dir, "events"), F.col("event_id")
    time = F.lit(BEGIN_MS) + div(i, PER_DAY) * 86_400_000 + (div(i, PER_DAY) % 2) * ODD_MS + (i % PER_DAY) * 1500 + ((i * 7919) % 23 - 11) * 700
    return e.select(
        i.alias("seq"), (F.col("user_id") % 8).alias("token"), time.alias("event_time"), F.round(F.col("value") * 100).cast("long").alias("price_paise"),
        F.get_json_object("props", "$.k").cast("long").alias("volume_delta"), F.when(F.col("event_type").isin("purchase", "click", "view"), "TRADE").otherwise("QUOTE").alias("tick_type"), "event_type",
    )


TICKS_SQL = f"""ticks AS (SELECT event_id AS seq, user_id % 8 AS token,
  {BEGIN_MS} + (event_id // {PER_DAY}) * 86400000 + ((event_id // {PER_DAY}) % 2) * {ODD_MS} + (event_id % {PER_DAY}) * 1500 + ((event_id * 7919) % 23 - 11) * 700 AS event_time,
  CAST(round(value * 100) AS BIGINT) AS price_paise, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume_delta,
  CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'TRADE' ELSE 'QUOTE' END AS tick_type, event_type FROM events)"""

DAY = "((({0}) + 19800000) // 86400000)"
OPEN = f"({DAY} * 86400000 - 19800000 + 33300000)"
IN_SESSION = "(({0}) + 19800000) % 86400000 BETWEEN 33300000 AND 55799999"
_WS = f"(CASE WHEN fo THEN ({{0}}) - (({{0}}) - {OPEN}) % ms ELSE ({{0}}) - ({{0}}) % ms END)"

TRADES_SQL = f"""{TICKS_SQL},
trades AS (SELECT * FROM ticks WHERE tick_type = 'TRADE' AND volume_delta > 0 AND {IN_SESSION.format("event_time")}),
gate AS (SELECT *, max(event_time) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM trades),
taken AS (SELECT *, lag(event_time) OVER (PARTITION BY token ORDER BY event_time) AS prior FROM gate WHERE m IS NULL OR event_time > m)"""

PARTS_SQL = f"""{TRADES_SQL},
frames(tf, ms, fo) AS (VALUES ('15s', 15000::BIGINT, false), ('30s', 30000, false), ('1m', 60000, false), ('3m', 180000, true), ('5m', 300000, true), ('15m', 900000, true)),
fanned AS (SELECT taken.*, tf, ms, {_WS.format("event_time")} AS ws, {_WS.format("prior")} AS pws FROM taken, frames),
gaps AS (SELECT *, CASE WHEN event_time - prior > 30000 AND {DAY.format("prior")} = {DAY.format("event_time")} AND pws = ws THEN 1 ELSE 0 END AS gap FROM fanned),
parted AS (SELECT *, sum(gap) OVER (PARTITION BY token, tf, ws ORDER BY event_time ROWS UNBOUNDED PRECEDING) AS part FROM gaps),
parts AS (SELECT *, max(part) OVER (PARTITION BY token, tf, ws) AS last_part FROM parted)"""

CANDLES_SQL = f"""{PARTS_SQL},
candles AS (SELECT token, tf, ws AS window_start, arg_min(price_paise, event_time) AS open_paise, max(price_paise) AS high_paise, min(price_paise) AS low_paise,
  arg_max(price_paise, event_time) AS close_paise, CAST(sum(volume_delta) AS BIGINT) AS volume, count(*) AS tick_count, max(event_time) AS last_event_time, ws + min(ms) AS window_end
  FROM parts WHERE part = last_part GROUP BY token, tf, ws)"""


def fills(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = read(spark, sf_dir, "lineitem")
    event = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return x.select(
        F.col("l_suppkey").alias("account"), (F.col("l_partkey") % 5).alias("token"), (F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long") * 100_000_000 + event).alias("version"), event.alias("event_id"),
        F.when(F.col("l_linestatus") == "F", "BUY").otherwise("SELL").alias("side"), F.col("l_quantity").cast("long").alias("qty"), F.round(F.col("l_extendedprice") * 100 / F.col("l_quantity")).cast("long").alias("price_paise"),
    )


def ladders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A five-level book by tick: prices around the tick's, quantities from its number."""
    t = ticks(spark, sf_dir)
    zero = F.lit(0).cast("long")
    px = lambda sign: F.array(*[F.col("price_paise") + sign * (5 + 5 * k) for k in range(5)])
    qty = lambda a: F.array(*[F.greatest(zero, (F.col("seq") * a + k * 37) % 101 - 10) for k in range(5)])
    return t.select("seq", "token", px(-1).alias("bid_px"), px(1).alias("ask_px"), qty(13).alias("bid_qty"), qty(29).alias("ask_qty"))
