"""The feature registry: definitions by id, their routing by cadence and bar size, and market-only rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import book
from tidewater.functions import timeframes as tf
from tidewater.operators import candles, indicators

#: Names of market fields; a book has ``book.LEVELS`` levels a side.
STATS = [
    "total_buy_qty", "total_sell_qty", "day_open_paise", "day_high_paise", "day_low_paise", "prev_close_paise", "vwap_paise", "open_interest", "oi_day_high", "oi_day_low",
    "lower_limit_paise", "upper_limit_paise",
]
SEEN = ["day_volume", "change_flag", "atv", "btv", "imbalance_qty", "indicative_close_paise", "ref_price_paise"]
DEPTH = [f"{side}_{what}_{k}" for side in ("bid", "ask") for what in ("px", "qty", "ord") for k in range(1, book.LEVELS + 1)]
FRAMES = frozenset(f.name for f in tf.TIMEFRAMES)


@dataclass(frozen=True)
class Feature:
    """``value`` is a column of a row that has the market fields and the bar's own features; null or NaN: no value.

    Cadence TICK and MARKET features are known on each tick, CLOSE features from closed bars of their sizes."""

    id: int
    name: str
    cadence: str
    value: Callable[[], Column]
    frames: frozenset[str] = FRAMES
    active: bool = True


def _levels(side: str, what: str) -> Column:
    return F.array(*[F.coalesce(F.col(f"{side}_{what}_{k}"), F.lit(0).cast("long")) for k in range(1, book.LEVELS + 1)])


def _priced(*sides: str) -> Column:
    out = F.lit(True)
    for side in sides:
        out &= F.coalesce(F.col(f"{side}_px_1"), F.lit(0)) > 0
    return out


def _market() -> list[tuple[str, Callable[[], Column]]]:
    stat = lambda n: lambda: F.when(F.col("stats_changed_at").isNotNull(), F.coalesce(F.col(n), F.lit(0)))
    level = lambda n: lambda: F.when(F.col(f"{n[:3]}_px_{n[-1]}") > 0, F.coalesce(F.col(n), F.lit(0)))
    seen = lambda n: lambda: F.col(n)
    spread = lambda: F.when(_priced("bid", "ask"), F.col("ask_px_1") - F.col("bid_px_1"))
    lean = lambda: F.when(F.col("depth_changed_at").isNotNull(), book.imbalance(_levels("bid", "qty"), _levels("ask", "qty")))
    micro = lambda: F.nullif(book.microprice(*[_levels(s, w) for w in ("px", "qty") for s in ("bid", "ask")]), F.lit(0))
    return [
        *[(n, stat(n)) for n in STATS], *[(n, level(n)) for n in DEPTH], *[(n, seen(n)) for n in SEEN],
        ("spread_paise", spread), ("depth_imbalance", lean), ("microprice_paise", micro),
    ]


class Registry:
    """Features by id and name; ids are 0, 1, 2, ... in order of declaration, so that a list only grows at its end."""

    def __init__(self, features: list[Feature]):
        for place, f in enumerate(features):
            if f.id != place:
                raise ValueError(f"feature {f.name} has id {f.id} at place {place}")
        if len({f.name for f in features}) < len(features):
            raise ValueError("two features have one name")
        self.features, self.names = tuple(features), {f.name: f for f in features}

    def by_id(self, k: int) -> Feature:
        if not 0 <= k < len(self.features):
            raise KeyError(f"no feature with id {k}")
        return self.features[k]

    def by_name(self, name: str) -> Feature:
        if name not in self.names:
            raise KeyError(f"no feature {name}")
        return self.names[name]

    def ids(self, frame: str | None = None, cadence: str | None = None) -> list[int]:
        """Ids of the active features, of those that ``frame`` carries, of those with the cadence."""
        return [f.id for f in self.features if f.active and (frame is None or frame in f.frames) and cadence in (None, f.cadence)]

    def snapshot(self, frame: Column) -> Column:
        """The map from id to value that a row of bar size ``frame`` carries; what has no value is left out."""
        routed = {f.id: f.value() if f.frames == FRAMES else F.when(frame.isin(*sorted(f.frames)), f.value()) for f in self.features if f.active}
        return indicators.feature_map(routed)

    def value(self, features: Column, name: str) -> Column:
        """A feature by name out of a snapshot; null without value, an error for a name that isn't registered."""
        return F.element_at(features, F.lit(self.by_name(name).id)) if self.by_name(name).active else F.lit(None).cast("double")


#: Bar sizes of the two features of closed bars are fixed values.
REGISTRY = Registry([
    Feature(0, "last_price", "TICK", lambda: F.col("close_paise")),
    Feature(1, "sma_close_20", "CLOSE", lambda: F.col("sma"), frozenset(["1m", "3m", "5m", "15m"])),
    Feature(2, "rsi_close_14", "CLOSE", lambda: F.col("rsi"), frozenset(["1m", "5m", "15m"])),
    *[Feature(3 + k, n, "MARKET", f) for k, (n, f) in enumerate(_market())],
])


def market_section(rows: DataFrame, market: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (token, tf, seq, ...) with the market ``fields`` known at their tick, on the smallest bar size only."""
    m = market.select("token", "seq", *[F.col(c).alias(f"_{c}") for c in fields])
    small = F.col("tf") == tf.TIMEFRAMES[0].name
    x = rows.join(m, ["token", "seq"], "left")
    return x.select(*[F.col(c) for c in rows.columns], *[F.when(small, F.col(f"_{c}")).alias(c) for c in fields])


def market_rows(ticks: DataFrame, stats: list[str], depth: list[str]) -> DataFrame:
    """Rows with tf MKT: one for each quote in session, later than all trades before it, that changed a market field."""
    known = Window.partitionBy("token").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    trade = (F.col("tick_type") == "TRADE") & (F.coalesce(F.col("volume_delta"), F.lit(0)) > 0)
    latest = F.max(F.when(F.col("_trade") & tf.in_session(F.col("event_time")), F.col("event_time"))).over(known)
    x = ticks.withColumn("_trade", trade).withColumn("_latest", latest)
    x = x.where(tf.in_session(F.col("event_time")) & (F.col("_latest").isNull() | (F.col("event_time") > F.col("_latest"))))
    quotes = x.where(~F.coalesce(F.col("_trade"), F.lit(False))).select("token", "seq")
    every = Window.partitionBy("token").orderBy("seq")
    now = F.struct(*stats, *depth)
    m = candles.snapshot(x, stats, depth).withColumn("_changed", ~now.eqNullSafe(F.lag(now).over(every)) & F.coalesce(*stats, *depth).isNotNull())
    zero = F.lit(0).cast("long")
    bar = ["open_paise", "high_paise", "low_paise", "close_paise", "volume", "tick_count"]
    return m.where("_changed").join(quotes, ["token", "seq"]).select(
        "token", F.lit("MKT").alias("tf"), F.col("event_time").alias("window_start"), F.col("event_time").alias("window_end"), *[zero.alias(c) for c in bar],
        F.col("event_time").alias("last_event_time"), "seq", *stats, *depth, "stats_changed_at", "depth_changed_at",
    )
