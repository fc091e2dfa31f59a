"""Gap-aware, session-aligned candles of several timeframes from one pass over the ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import timeframes as tf
from tidewater.operators.ticks import monotonic_gate


def trades(ticks: DataFrame) -> DataFrame:
    """In-session trades with volume."""
    return ticks.where((F.col("tick_type") == "TRADE") & (F.coalesce("volume_delta", F.lit(0)) > 0) & tf.in_session(F.col("event_time")))


def accepted_trades(ticks: DataFrame) -> DataFrame:
    """Trades that move their token's time forward, with the time of the one before (``prior``)."""
    x = monotonic_gate(trades(ticks)).where("accepted").drop("accepted")
    return x.withColumn("prior", F.lag("event_time").over(Window.partitionBy("token").orderBy("event_time")))


def fan_out(df: DataFrame, frames=tf.TIMEFRAMES) -> DataFrame:
    """A row for each timeframe: tf, tf_ms, window_start of the row's time."""
    each = F.explode(F.array(*[F.struct(F.lit(f.name).alias("tf"), F.lit(f.ms).cast("long").alias("tf_ms"), F.lit(f.from_open).alias("from_open")) for f in frames]))
    return df.withColumn("_f", each).select("*", "_f.*").drop("_f").withColumn("window_start", tf.bucket_start(F.col("event_time"), F.col("tf_ms"), F.col("from_open")))


def _broke(gap_ms: int) -> Column:
    """Whether a gap of more than ``gap_ms`` inside one session and one bar lies before a fanned-out row."""
    prior, t = F.col("prior"), F.col("event_time")
    same_bar = tf.bucket_start(prior, F.col("tf_ms"), F.col("from_open")) == F.col("window_start")
    return F.coalesce((t - prior > gap_ms) & (tf.day_start(prior) == tf.day_start(t)) & same_bar, F.lit(False))


def gap_parts(df: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """Adds ``part``: a gap inside a bar begins the bar anew."""
    bar = Window.partitionBy("token", "tf", "window_start").orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("part", F.sum(_broke(gap_ms).cast("long")).over(bar))


def last_parts(df: DataFrame, gap_ms: int = 30_000) -> DataFrame:
    """The rows of each bar from its last gap on: one maximum by bar, no order needed."""
    since = F.max(F.when(_broke(gap_ms), F.col("event_time"))).over(Window.partitionBy("token", "tf", "window_start"))
    return df.withColumn("_since", since).where(F.col("_since").isNull() | (F.col("event_time") >= F.col("_since"))).drop("_since")


def bars(df: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """Open, high, low, close, volume and tick count by ``keys``: built-in aggregates with a map-side part."""
    at = F.col("event_time") if order is None else order
    return df.groupBy(*keys).agg(
        F.min_by("price_paise", at).alias("open_paise"), F.max("price_paise").alias("high_paise"), F.min("price_paise").alias("low_paise"), F.max_by("price_paise", at).alias("close_paise"),
        F.sum("volume_delta").alias("volume"), F.count(F.lit(1)).alias("tick_count"), F.max("event_time").alias("last_event_time"),
    )


def candles(ticks: DataFrame, frames=tf.TIMEFRAMES, gap_ms: int = 30_000) -> DataFrame:
    """token, tf, window_start, window_end, OHLC, volume, tick_count and last_event_time of each bar's last unbroken part.

    ``ticks``: token, event_time, seq (arrival), price_paise, volume_delta, tick_type. The gate and the lag share one
    partitioning by token, all that follows one by bar."""
    parts = last_parts(fan_out(accepted_trades(ticks), frames), gap_ms)
    out = bars(parts, ["token", "tf", "tf_ms", "window_start"])
    return out.withColumn("window_end", F.col("window_start") + F.col("tf_ms")).drop("tf_ms")


def merged(partials: DataFrame) -> DataFrame:
    """Partial bars (first_key and last_key say which open and close are outermost) merged into whole ones."""
    return partials.groupBy("token", "tf", "window_start").agg(
        F.min_by("open_paise", "first_key").alias("open_paise"), F.max("high_paise").alias("high_paise"), F.min("low_paise").alias("low_paise"),
        F.max_by("close_paise", "last_key").alias("close_paise"), F.sum("volume").alias("volume"), F.sum("tick_count").alias("tick_count"),
    )


def forming(ticks: DataFrame, frames=tf.TIMEFRAMES, gap_ms: int = 30_000) -> DataFrame:
    """The forming bar of each timeframe after every accepted trade."""
    x = gap_parts(fan_out(accepted_trades(ticks), frames), gap_ms)
    w = Window.partitionBy("token", "tf", "window_start", "part").orderBy("event_time").rowsBetween(Window.unboundedPreceding, 0)
    return x.select(
        "token", "tf", "window_start", "event_time", "seq", F.first("price_paise").over(w).alias("open_paise"), F.max("price_paise").over(w).alias("high_paise"), F.min("price_paise").over(w).alias("low_paise"),
        F.col("price_paise").alias("close_paise"), F.sum("volume_delta").over(w).alias("volume"), F.count(F.lit(1)).over(w).alias("tick_count"),
    )


def snapshot(ticks: DataFrame, stats: list[str], depth: list[str]) -> DataFrame:
    """The latest known value of each field after every tick (0 is unknown), and when stats and depth last changed."""
    w = Window.partitionBy("token").orderBy("seq")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    x = ticks.select("token", "seq", "event_time", *[F.last(F.nullif(F.col(c), F.lit(0)), ignorenulls=True).over(upto).alias(c) for c in [*stats, *depth]])
    out = x
    for name, cols in (("stats_changed_at", stats), ("depth_changed_at", depth)):
        now = F.struct(*cols)
        changed = ~now.eqNullSafe(F.lag(now).over(w)) & F.coalesce(*cols).isNotNull()
        out = out.withColumn(f"_{name}", F.when(changed, F.col("event_time")))
    return out.select("token", "seq", "event_time", *stats, *depth, *[F.last(f"_{n}", ignorenulls=True).over(upto).alias(n) for n in ("stats_changed_at", "depth_changed_at")])


def parity(candle_rows: DataFrame, raw: DataFrame) -> DataFrame:
    """Full comparison of bars with a recount: MATCH, MISMATCH, MISSING_CANDLE or EXTRA_CANDLE of each (token, tf, window_start)."""
    keys = ["token", "tf", "window_start"]
    a = candle_rows.select(*keys, F.col("volume").alias("candle_volume"), F.col("tick_count").alias("candle_ticks"))
    b = raw.select(*keys, F.col("volume").alias("raw_volume"), F.col("tick_count").alias("raw_ticks"))
    state = F.when(F.col("candle_ticks").isNull(), "MISSING_CANDLE").when(F.col("raw_ticks").isNull(), "EXTRA_CANDLE").when((F.col("candle_volume") == F.col("raw_volume")) & (F.col("candle_ticks") == F.col("raw_ticks")), "MATCH").otherwise("MISMATCH")
    return a.join(b, keys, "full").withColumn("parity", state)
