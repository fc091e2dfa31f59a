"""Indicators and patterns over closed candles (token, tf, window_start, OHLC)."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES = ["token", "tf"]


def _series() -> Window:
    return Window.partitionBy(*SERIES).orderBy("window_start")


def sma(c: DataFrame, n: int = 20, out: str = "sma") -> DataFrame:
    """Mean of the last ``n`` closes; null before there are that many."""
    w = _series().rowsBetween(1 - n, 0)
    return c.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n, F.sum("close_paise").over(w) / n))


def sma_preview(c: DataFrame, forming_close: Column, n: int = 20, out: str = "sma_preview") -> DataFrame:
    """What the mean would be if ``forming_close`` closed the bar after the ``n - 1`` last ones."""
    w = _series().rowsBetween(1 - n, -1)
    return c.withColumn(out, F.when(F.count(F.lit(1)).over(w) == n - 1, (F.sum("close_paise").over(w) + forming_close) / n))


def rsi(c: DataFrame, n: int = 14, out: str = "rsi", forming: Column | None = None) -> DataFrame:
    """Wilder's relative strength: the first ``n`` changes are averaged, later ones smoothed into them; 100 without losses.

    ``forming`` adds ``rsi_preview``: what the value would be if this close, in the bar's place, ended the series now. The
    smoothing is a recurrence over the whole series, so closes stream by in order and only two averages are kept."""
    keys = [*SERIES, "window_start"]
    slim = c.select(*keys, F.col("close_paise").cast("double").alias("close"), (F.col("close_paise") if forming is None else forming).cast("double").alias("forming"))
    more = [] if forming is None else [f"{out}_preview"]
    schema = ", ".join([*(f"`{k}` {c.schema[k].dataType.simpleString()}" for k in keys), f"`{out}` double", *(f"`{m}` double" for m in more)])

    def value(up: float, down: float) -> float:
        return 100.0 if down == 0 else 100.0 - 100.0 / (1.0 + up / down)

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, k, last, up, down = None, 0, 0.0, 0.0, 0.0

        def step(close: float) -> tuple[float, float]:
            gain, loss = max(close - last, 0.0), max(last - close, 0.0)
            return (up + gain / n, down + loss / n) if k < n else ((up * (n - 1) + gain) / n, (down * (n - 1) + loss) / n)

        for b in batches:
            values, previews = [], []
            for token, frame, close, shown in zip(b["token"].tolist(), b["tf"].tolist(), b["close"].tolist(), b["forming"].tolist(), strict=True):
                if (token, frame) != now:
                    now, k, up, down = (token, frame), 0, 0.0, 0.0
                    previews.append(None)
                else:
                    if more:
                        previews.append(value(*step(shown)) if k + 1 >= n else None)
                    up, down = step(close)
                    k += 1
                last = close
                values.append(value(up, down) if k >= n else None)
            got = b[keys].copy()
            got[out] = pd.array(values, dtype="Float64")
            for m in more:
                got[m] = pd.array(previews, dtype="Float64")
            yield got

    got = slim.repartition(*SERIES).sortWithinPartitions(*keys).mapInPandas(fold, schema)
    rest = [x for x in c.columns if x not in keys]
    return c.join(got, keys) if rest else got


def ring(c: DataFrame, n: int = 15) -> DataFrame:
    """Adds ``ring``: the closes of the ``n`` newest candles, newest first."""
    return c.withColumn("ring", F.reverse(F.collect_list("close_paise").over(_series().rowsBetween(1 - n, 0))))


def islands(c: DataFrame) -> DataFrame:
    """Adds ``island``: a number that grows where candles don't follow each other without a gap."""
    w = _series()
    frame = F.col("window_end") - F.col("window_start")
    gap = F.coalesce(F.col("window_start") - F.lag("window_start").over(w) > frame, F.lit(False)).cast("long")
    return c.withColumn("_gap", gap).withColumn("island", F.sum("_gap").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_gap")


def narrowest(c: DataFrame, n: int = 7) -> DataFrame:
    """Candles whose range is strictly the narrowest of ``n`` contiguous ones (candles with high below low are left out first)."""
    x = islands(c.where("high_paise >= low_paise")).withColumn("range_paise", F.col("high_paise") - F.col("low_paise"))
    w = Window.partitionBy(*SERIES, "island").orderBy("window_start").rowsBetween(1 - n, -1)
    return x.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_m", F.min("range_paise").over(w)).where((F.col("_n") == n - 1) & (F.col("range_paise") < F.col("_m"))).drop("_n", "_m", "island")


class BreakoutFold:
    """The rules for one token: closed candles arm and disarm setups, trades fire them.

    A setup is the bar whose range is strictly the narrowest of its ring; it replaces its timeframe's former one, and a gap in the
    timeframe's bars disarms it. A trade fires, of the setups it leaves (above the high: BUY, below the low: SELL), the
    unfired one of the largest timeframe; the others stay armed and are counted. A setup whose bar comes after a later trade
    (than its end) fires at once if that trade left it, unless it also left a larger timeframe's, fired or not."""

    def __init__(self):
        self.armed: dict[str, list] = {}  # timeframe -> its length, window_start, high, low, whether it fired
        self.last_bar: dict[str, int] = {}
        self.time, self.price, self.mark, self.seq = None, 0, None, None

    @staticmethod
    def side(price: int, setup: list) -> str | None:
        return "BUY" if price > setup[2] else "SELL" if price < setup[3] else None

    def candle(self, tf: str, ms: int, start: int, high: int, low: int, setup: bool) -> list[tuple]:
        if high < low or start <= self.last_bar.get(tf, start - 1):
            return []
        if tf in self.last_bar and start - self.last_bar[tf] > ms:
            self.armed.pop(tf, None)
        self.last_bar[tf] = start
        if not setup:
            return []
        self.armed[tf] = [ms, start, high, low, False]
        larger = any(s[0] > ms and self.side(self.price, s) for s in self.armed.values())
        if self.time is None or self.time <= start + ms or larger or not self.side(self.price, self.armed[tf]):
            return []
        return self._fire(tf, 0, "arm")

    def trade(self, time: int, price: int, mark: str | None, seq: int) -> list[tuple]:
        if self.time is not None and (time < self.time or time == self.time and (mark is None or mark == self.mark)):
            return []
        self.time, self.price, self.mark, self.seq = time, price, mark, seq
        left = sorted((s[0], tf) for tf, s in self.armed.items() if not s[4] and self.side(price, s))
        return self._fire(left[-1][1], len(left) - 1, "live") if left else []

    def _fire(self, tf: str, suppressed: int, path: str) -> list[tuple]:
        if self.price < 0:
            return []
        setup = self.armed[tf]
        setup[4] = True
        return [(tf, setup[1], self.side(self.price, setup), self.price, self.time, self.seq, suppressed, path)]


BREAKOUT = "token long, tf string, window_start long, side string, price_paise long, detection_ts long, seq long, suppressed long, path string"


def breakouts(c: DataFrame, trades: DataFrame, n: int = 7) -> DataFrame:
    """Signals of the trades (token, event_time, seq, price_paise, maybe fingerprint) that leave the narrowest of ``n`` bars of the
    closed candles ``c``, which come at their end (or at ``closed_at``, if they have it), before trades of that time.

    Candles and trades go into one ordered stream by token and are folded; a token's state is one setup a timeframe."""
    end = F.col("closed_at") if "closed_at" in c.columns else F.col("window_end")
    setups = narrowest(c, n).select(*SERIES, "window_start", F.lit(True).alias("setup"))
    bars = c.where("high_paise >= low_paise").join(setups, [*SERIES, "window_start"], "left")
    none = lambda kind: F.lit(None).cast(kind)
    a = bars.select("token", end.alias("t"), F.lit(0).alias("kind"), F.lit(0).cast("long").alias("seq"), "tf", (F.col("window_end") - F.col("window_start")).alias("ms"), "window_start", "high_paise", "low_paise", F.coalesce("setup", F.lit(False)).alias("setup"), none("string").alias("mark"))
    mark = F.col("fingerprint").cast("string") if "fingerprint" in trades.columns else none("string")
    b = trades.select("token", F.col("event_time").alias("t"), F.lit(1).alias("kind"), "seq", none("string").alias("tf"), F.lit(0).cast("long").alias("ms"), F.lit(0).cast("long").alias("window_start"), F.col("price_paise").alias("high_paise"), F.lit(0).cast("long").alias("low_paise"), F.lit(False).alias("setup"), mark.alias("mark"))
    names = [x.split()[0] for x in BREAKOUT.split(", ")]

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, BreakoutFold()
        for x in batches:
            out = []
            for token, t, kind, seq, tf, ms, start, high, low, setup, m in zip(*(x[k].tolist() for k in x.columns), strict=True):
                if token != now:
                    now, state = token, BreakoutFold()
                out += [(token, *r) for r in (state.trade(t, high, m, seq) if kind else state.candle(tf, ms, start, high, low, setup))]
            yield pd.DataFrame(out, columns=names)

    both = a.unionByName(b).repartition("token").sortWithinPartitions("token", "t", "kind", "ms", "window_start", "seq")
    return both.mapInPandas(fold, BREAKOUT)


def feature_map(values: dict[int, Column]) -> Column:
    """A map of the features that have a value (null and NaN are left out)."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("double").alias("value")) for k, v in values.items()])
    return F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull() & ~F.isnan(p["value"])))


def newest(df: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The ``n`` newest rows by key (Spark prunes each task's rows before the shuffle)."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")
