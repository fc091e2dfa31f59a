"""The batch operators under Structured Streaming: stateful candles, dedup, watermarked windows, versioned upserts."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.functions import timeframes as tf
from tidewater.operators import joins

CANDLE = "token long, tf string, window_start long, window_end long, open_paise long, high_paise long, low_paise long, close_paise long, volume long, tick_count long, last_event_time long, sealed boolean"


class CandleFold:
    """The candle rules on one token's trades as they arrive; what the batch query says with windows."""

    def __init__(self, state: dict | None = None, gap_ms: int = 30_000, frames=tf.TIMEFRAMES):
        state = state or {}
        self.prior, self.bars, self.done = state.get("prior"), state.get("bars", {}), state.get("done", {})
        self.gap_ms, self.frames = gap_ms, frames

    def state(self) -> dict:
        return {"prior": self.prior, "bars": self.bars, "done": self.done}

    @staticmethod
    def _day(t: int) -> int:
        return (t + tf.IST_MS) // tf.DAY_MS

    def start(self, t: int, frame: tf.Timeframe) -> int:
        origin = self._day(t) * tf.DAY_MS - tf.IST_MS + tf.OPEN_MS if frame.from_open else 0
        return t - (t - origin) % frame.ms

    def add(self, t: int, price: int, volume: int) -> list[tuple]:
        """Takes a trade; returns the bars it closes. A bar that was sealed takes no more trades."""
        if not tf.OPEN_MS <= (t + tf.IST_MS) % tf.DAY_MS < tf.CLOSE_MS or volume <= 0 or (self.prior is not None and t <= self.prior):
            return []
        gap = self.prior is not None and t - self.prior > self.gap_ms and self._day(t) == self._day(self.prior)
        closed = []
        for f in self.frames:
            ws, bar = self.start(t, f), self.bars.get(f.name)
            if ws <= self.done.get(f.name, ws - 1):
                continue
            if bar and bar[0] == ws and not gap:
                bar[2], bar[3], bar[4], bar[5], bar[6], bar[7] = max(bar[2], price), min(bar[3], price), price, bar[5] + volume, bar[6] + 1, t
                continue
            if bar and bar[0] != ws:
                closed.append(self.row(f, bar, True))
            self.bars[f.name] = [ws, price, price, price, price, volume, 1, t]
        self.prior = t
        return closed

    def seal(self, now: int) -> list[tuple]:
        """Closes the bars whose window has ended by event time ``now``. The last window of each bar size ends with the session, so
        none outlives its day."""
        closed = []
        for f in self.frames:
            bar = self.bars.get(f.name)
            if bar and bar[0] + f.ms <= now:
                closed.append(self.row(f, bar, True))
                self.done[f.name] = bar[0]
                del self.bars[f.name]
        return closed

    def due(self, ttl_ms: int) -> int | None:
        """When the next bar ends; without bars, when the state is to be forgotten."""
        ends = [self.bars[f.name][0] + f.ms for f in self.frames if f.name in self.bars]
        return min(ends) if ends else None if self.prior is None else self.prior + ttl_ms

    def row(self, f: tf.Timeframe, bar: list, sealed: bool) -> tuple:
        return (f.name, bar[0], bar[0] + f.ms, *bar[1:], sealed)

    def forming(self) -> list[tuple]:
        return [self.row(f, self.bars[f.name], False) for f in self.frames if f.name in self.bars]


def candle_stream(ticks: DataFrame, gap_ms: int = 30_000, delay: str | None = None, ttl_ms: int = tf.DAY_MS) -> DataFrame:
    """Closed bars (sealed) and the forming bars of each token after each micro-batch, in update mode.

    State by token: the last accepted time and one bar a timeframe. Ticks of a batch are taken in order of ``seq``. With a
    ``delay`` the stream has a watermark and timers: a bar is sealed when the watermark passes the end of its window (so at the session's
    close at the latest), trades behind the watermark or of a sealed bar are dropped, and a token's state is forgotten ``ttl_ms`` after
    its last trade. Without one, a bar is only sealed by a later trade of its token."""
    names = [x.split()[0] for x in CANDLE.split(", ")]
    order = ["seq", "event_time", "price_paise", "volume_delta"]

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        f = CandleFold(json.loads(state.get[0]) if state.exists else None, gap_ms)
        out = []
        rows = pd.concat([pd.DataFrame(columns=order), *(x[order] for x in frames)] if state.hasTimedOut else [x[order] for x in frames]).sort_values("seq")
        for t, p, v in zip(rows["event_time"], rows["price_paise"], rows["volume_delta"], strict=True):
            out += f.add(int(t), int(p), int(v))
        if delay is not None:
            now = state.getCurrentWatermarkMs()
            out += f.seal(now)
            due = f.due(ttl_ms)
            if due is None or due <= now:
                if state.exists:
                    state.remove()
            else:
                state.update((json.dumps(f.state()),))
                state.setTimeoutTimestamp(due)
        else:
            state.update((json.dumps(f.state()),))
        out += [] if state.hasTimedOut else f.forming()
        yield pd.DataFrame([(key[0], *r) for r in out], columns=names)

    if delay is not None:
        ticks = timed(ticks, delay)
    trades = ticks.where("tick_type = 'TRADE' and volume_delta > 0").select("token", *order, *(["ts"] if delay is not None else []))
    return trades.groupBy("token").applyInPandasWithState(fold, CANDLE, "state string", "update", "NoTimeout" if delay is None else "EventTimeTimeout")


def restarted(start: Callable[[], StreamingQuery], attempts: int = 3, delay_s: float = 30) -> StreamingQuery:
    """Runs a query to its end; one that fails is started anew from its checkpoint, ``attempts`` times, ``delay_s`` apart."""
    for left in range(attempts, -1, -1):
        q = start()
        try:
            q.awaitTermination()
            return q
        except StreamingQueryException:
            if not left:
                raise
            time.sleep(delay_s)
    raise ValueError("attempts is negative")


def timed(ticks: DataFrame, delay: str = "500 milliseconds") -> DataFrame:
    """Adds ``ts`` (from event_time) with a watermark."""
    return ticks.withColumn("ts", F.timestamp_millis("event_time")).withWatermark("ts", delay)


def dedup_stream(ticks: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """First rows of equal keys within the watermark's reach; state leaves with the watermark."""
    return timed(ticks, delay).dropDuplicatesWithinWatermark(keys)


def window_volume(ticks: DataFrame, width: str = "15 seconds", delay: str = "500 milliseconds") -> DataFrame:
    """Volume and ticks of epoch-aligned windows, emitted when the watermark has passed them."""
    x = timed(ticks, delay).where("tick_type = 'TRADE'").groupBy("token", F.window("ts", width)).agg(F.sum("volume_delta").alias("volume"), F.count(F.lit(1)).alias("tick_count"))
    return x.select("token", F.unix_millis("window.start").alias("window_start"), "volume", "tick_count")


class VersionedTable:
    """A key table that micro-batches merge into: older versions are dropped, of equal ones the later batch wins.

    Each merge writes the next generation and then a marker; readers take the newest marked one, so a merge that dies
    leaves no trace, and a batch that comes twice changes nothing."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], version: str):
        self.spark, self.path, self.keys, self.version = spark, path.rstrip("/"), keys, version

    def _fs(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def generation(self) -> int:
        p, fs = self._fs("")
        if not fs.exists(p):
            return -1
        return max([int(s.getPath().getName()[5:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("done-")], default=-1)

    def read(self) -> DataFrame | None:
        g = self.generation()
        return None if g < 0 else self.spark.read.parquet(f"{self.path}/gen-{g}").drop("_batch")

    def merge(self, rows: DataFrame, batch: int) -> None:
        g = self.generation()
        if batch <= g:
            return
        new = rows.withColumn("_batch", F.lit(batch).cast("long"))
        if g >= 0:
            new = self.spark.read.parquet(f"{self.path}/gen-{g}").unionByName(new)
        joins.current(new, self.keys, self.version, "_batch").write.mode("overwrite").parquet(f"{self.path}/gen-{batch}")
        p, fs = self._fs(f"done-{batch}")
        fs.create(p, True).close()
        for k in range(max(0, g - 1), g):
            old, fs = self._fs(f"gen-{k}")
            fs.delete(old, True)

    def sink(self) -> Callable[[DataFrame, int], None]:
        """For ``writeStream.foreachBatch``."""
        return lambda df, batch: self.merge(df, batch)


def split_sink(good: Callable[[DataFrame, int], None], bad: Callable[[DataFrame, int], None], reason: str = "reason") -> Callable[[DataFrame, int], None]:
    """One pass over a batch for two sinks: rows with a reason go to quarantine."""

    def write(df: DataFrame, batch: int) -> None:
        df = df.persist()
        try:
            good(df.where(F.col(reason).isNull()).drop(reason), batch)
            bad(df.where(F.col(reason).isNotNull()), batch)
        finally:
            df.unpersist()

    return write
