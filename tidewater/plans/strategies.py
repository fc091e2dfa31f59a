"""Strategies: named rules from ticks to signals, hosted so that one that fails doesn't stop the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewater.functions import identity
from tidewater.operators import candles, indicators

SIGNAL = ["token", "tf", "window_start", "side", "price_paise", "detection_ts"]


@dataclass(frozen=True)
class Strategy:
    """``signals(ticks)`` gives at least the columns of ``SIGNAL``."""

    rule_id: str
    signals: Callable[[DataFrame], DataFrame]
    version: str = "1"


def narrowest_range_breakout(ticks: DataFrame) -> DataFrame:
    c = candles.candles(ticks)
    return indicators.breakouts(c, candles.accepted_trades(ticks))


def context_probe(ticks: DataFrame) -> DataFrame:
    """Once for each bar whose forerunner (the bar just before it in time) is closed and readable while it forms: at its first trade,
    with the forerunner's start and close."""
    x = candles.fan_out(candles.accepted_trades(ticks)).groupBy("token", "tf", "tf_ms", "window_start")
    x = x.agg(F.min("event_time").alias("detection_ts"), F.max_by("price_paise", "event_time").alias("close"))
    w = Window.partitionBy("token", "tf").orderBy("window_start")
    x = x.withColumn("before", F.lag("window_start").over(w)).withColumn("price_paise", F.lag("close").over(w))
    x = x.where(F.col("before") == F.col("window_start") - F.col("tf_ms"))
    return x.select("token", "tf", F.col("before").alias("window_start"), F.lit("BUY").alias("side"), "price_paise", "detection_ts")


def stub(ticks: DataFrame) -> DataFrame:
    """Sees all ticks and never signals."""
    long = F.lit(0).cast("long")
    return ticks.where("false").select("token", F.lit("").alias("tf"), long.alias("window_start"), F.lit("").alias("side"), long.alias("price_paise"), long.alias("detection_ts"))


REGISTRY: dict[str, Strategy] = {s.rule_id: s for s in (Strategy("n7-breakout", narrowest_range_breakout), Strategy("context-probe", context_probe), Strategy("stub", stub))}


@dataclass
class Hosted:
    signals: DataFrame | None
    failed: dict[str, str] = field(default_factory=dict)


def host(ticks: DataFrame, strategies: list[Strategy], keep: int = 16) -> Hosted:
    """All strategies' signals with candidate ids, each once, the ``keep`` newest of a token and rule; what failed to plan is named."""
    out, failed = None, {}
    for s in strategies:
        try:
            got = s.signals(ticks).select(*SIGNAL).withColumn("rule_id", F.lit(s.rule_id)).withColumn("rule_version", F.lit(s.version))
        except Exception as e:  # a strategy's own fault
            failed[s.rule_id] = f"{type(e).__name__}: {e}"
            continue
        out = got if out is None else out.unionByName(got)
    if out is None:
        return Hosted(None, failed)
    name = F.concat_ws("|", "rule_id", F.col("token").cast("string"), "tf", F.col("window_start").cast("string"), "side")
    once = out.withColumn("candidate_id", identity.name_uuid(name)).dropDuplicates(["candidate_id"])
    return Hosted(indicators.newest(once, ["token", "rule_id"], ["detection_ts", "candidate_id"], keep), failed)


def canonical(signals: DataFrame, rules: set[str], version: str = "1", stub: str = "stub") -> DataFrame:
    """Signals of the configured rules and version; the stub's never."""
    return signals.where(F.col("rule_id").isin(*sorted(rules - {stub})) & (F.col("rule_version") == version))
