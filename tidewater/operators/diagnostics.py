"""Diagnostics over metric samples and logs: window means, growth, first sightings, exactness and drop audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def window_means(samples: DataFrame, windows: DataFrame, key: str = "key", time: str = "t", value: str = "value") -> DataFrame:
    """Mean of the samples of each (key, begins, ends) window (ends exclusive); windows without a sample have null.

    Windows are cut into cells of their largest width, so the range join is an equality join on (key, cell)."""
    width = windows.agg(F.max(F.col("ends") - F.col("begins"))).first()[0] or 1
    w = windows.select(key, "begins", "ends", F.explode(F.sequence(F.floor(F.col("begins") / width), F.floor((F.col("ends") - 1) / width))).alias("_c"))
    s = samples.select(key, F.col(time).alias("_t"), F.col(value).alias("_v"), F.floor(F.col(time) / width).alias("_c"))
    hit = w.join(s, [key, "_c"], "left").where("_t is null or (_t >= begins and _t < ends)")
    got = hit.groupBy(key, "begins", "ends").agg(F.avg("_v").alias("mean"), F.count("_v").alias("n"))
    return windows.select(key, "begins", "ends").join(got, [key, "begins", "ends"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def first_sighting(seen: DataFrame, keys: list[str], at: str, end: str) -> DataFrame:
    """keys, latency: the first time a window was seen at or after its end, less its end."""
    return seen.where(F.col(at) >= F.col(end)).groupBy(*keys, end).agg((F.min(at) - F.col(end)).alias("latency"))


def growth(samples: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, first, last and growth a minute of a size summed over samples of one time."""
    total = samples.groupBy(*keys, time).agg(F.sum(value).alias("_s"))
    x = total.groupBy(*keys).agg(F.min_by("_s", time).alias("first"), F.max_by("_s", time).alias("last"), F.min(time).alias("_a"), F.max(time).alias("_b"))
    return x.select(*keys, "first", "last", F.when(F.col("_b") > F.col("_a"), (F.col("last") - F.col("first")) * 60_000 / (F.col("_b") - F.col("_a"))).alias("per_minute"))


def worst(samples: DataFrame, keys: list[str], part: str, value: str) -> DataFrame:
    """keys, the part with the largest value, and that value."""
    return samples.groupBy(*keys).agg(F.max_by(part, F.struct(value, part)).alias("part"), F.max(value).alias("value"))


def job_totals(samples: DataFrame, rate: str, busy: str, keys: list[str], part: str) -> DataFrame:
    """keys, total rate and worst load: the rate summed over parts, the load of the busiest."""
    per = samples.groupBy(*keys, part).agg(F.avg(rate).alias("_r"), F.max(busy).alias("_b"))
    return per.groupBy(*keys).agg(F.sum("_r").alias("rate"), F.max("_b").alias("busy"))


def throttled(df: DataFrame, rate_in: str, rate_out: str, share: float = 0.5) -> DataFrame:
    return df.withColumn("flag", F.when(F.col(rate_in).isNull() | (F.col(rate_in) == 0), "SOURCE").when(F.col(rate_out) / F.col(rate_in) < share, "OUT_THROTTLED").otherwise("OK"))


def newest_by_window(samples: DataFrame, keys: list[str], time: str, value: str, width: int) -> DataFrame:
    """The newest sample of each key and window of ``width``."""
    return samples.groupBy(*keys, (F.floor(F.col(time) / width) * width).alias("window")).agg(F.max_by(value, time).alias("value"), F.max(time).alias("at"))


def watermarks(samples: DataFrame, source: str, value: str, least: int) -> DataFrame:
    """source, largest and mean watermark, samples; values at or below ``least`` are "none yet"."""
    return samples.where(F.col(value) > least).groupBy(source).agg(F.max(value).alias("max"), F.avg(value).alias("avg"), F.count(F.lit(1)).alias("n"))


def visible_age(df: DataFrame, time: str, polled: str, keys: list[str]) -> DataFrame:
    """Freshest and stalest age of what each poll saw."""
    return df.groupBy(*keys, polled).agg((F.col(polled) - F.max(time)).alias("freshest"), (F.col(polled) - F.min(time)).alias("stalest"))


def dedup_exactness(raw: DataFrame, mark: str, dropped: int) -> DataFrame:
    """One row: extra copies in the log, what the counter says was dropped, and whether they agree.

    Copies are counted by mark first, so the exact distinct count is a sum over partial groups."""
    x = raw.groupBy(mark).agg(F.count(F.lit(1)).alias("_n")).agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("extra"))
    return x.withColumn("dropped", F.lit(dropped).cast("long")).withColumn("exact", F.col("extra") == F.col("dropped"))


def totals(parity: DataFrame, drops: int) -> DataFrame:
    """One row from :func:`tidewater.operators.candles.parity`: volume short and in excess, and whether drops explain it (an excess never is)."""
    d = F.coalesce("candle_volume", F.lit(0)) - F.coalesce("raw_volume", F.lit(0))
    x = parity.agg(F.coalesce(F.sum(F.greatest(-d, F.lit(0))), F.lit(0)).alias("short"), F.coalesce(F.sum(F.greatest(d, F.lit(0))), F.lit(0)).alias("excess"))
    return x.withColumn("ok", (F.col("excess") == 0) & (F.col("short") <= drops))


def tentative_orphans(df: DataFrame, key: str, kind: str, time: str, horizon: int, grace: int) -> DataFrame:
    """Keys that only have tentative rows though ``grace`` has passed before the horizon."""
    x = df.groupBy(key).agg(F.max(time).alias("last"), F.bool_and(F.col(kind) == "TENTATIVE").alias("_only"))
    return x.where(F.col("_only") & (F.col("last") + grace <= horizon)).drop("_only")


def parity_edges(parity: DataFrame, horizon: int, lag_ms: int = 500) -> DataFrame:
    """Adds ``judged``: not a token's first window (it may be partial), and closed before the horizon less ``lag_ms``."""
    first = F.min("window_start").over(Window.partitionBy("token", "tf"))
    return parity.withColumn("judged", (F.col("window_start") > first) & (F.col("window_end") <= horizon - lag_ms))


def latest_live(closed: DataFrame, forming: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """The closed value, or the preview where a newer window is forming."""
    c = closed.groupBy(*keys).agg(F.max("window_start").alias("_cw"), F.max_by(value, "window_start").alias("_cv"))
    f = forming.groupBy(*keys).agg(F.max("window_start").alias("_fw"), F.max_by(value, "window_start").alias("_fv"))
    return c.join(f, keys, "full").select(*keys, F.when(F.col("_fw").isNull() | (F.col("_fw") <= F.col("_cw")), F.col("_cv")).otherwise(F.col("_fv")).alias(value))


def outside_allowed(enabled: DataFrame, allowed: list[str], name: str = "name") -> DataFrame:
    return enabled.where(~F.col(name).isin(*allowed)).select(name).distinct().orderBy(name)


def instance_check(df: DataFrame, instance: str, expected: int, pattern: str) -> DataFrame:
    """One row: distinct instances, those of another form, and whether both are as wanted."""
    x = df.select(instance).distinct().agg(F.count(F.lit(1)).alias("instances"), F.count_if(~F.col(instance).rlike(pattern)).alias("malformed"))
    return x.withColumn("ok", (F.col("instances") == expected) & (F.col("malformed") == 0))


def late_drops(counted: Column, late_in_window: Column, late_rows: Column, injected: Column) -> Column:
    """The counter of late drops must cover every late row of its window (a surplus is no fault), and all injected rows must have come:
    a struct of short, surplus, missing."""
    return F.struct(
        ((injected != 0) & (counted < late_in_window)).alias("short"), F.greatest(F.lit(0).cast("long"), counted - late_in_window).alias("surplus"),
        (late_rows != injected).alias("missing"),
    )


def source_states(df: DataFrame, split: str, seen: str, event_time: str, now: Column, idle_ms: int = 15_000, alert_ms: int = 60_000) -> DataFrame:
    """Splits with the time of their newest event, ACTIVE, IDLE (nothing for ``idle_ms``) or ALERT; the watermark is held back by active
    ones alone, so ``holds`` is their event time. An event counts only if it is later than all before it."""
    w = Window.partitionBy(split).orderBy(seen).rowsBetween(Window.unboundedPreceding, -1)
    x = df.withColumn("_m", F.max(event_time).over(w)).where(F.col("_m").isNull() | (F.col(event_time) > F.col("_m")))
    x = x.groupBy(split).agg(F.max(seen).alias("last_seen"), F.max(event_time).alias("newest"))
    quiet = now - F.col("last_seen")
    state = F.when(quiet >= alert_ms, "ALERT").when(quiet >= idle_ms, "IDLE").otherwise("ACTIVE")
    return x.withColumn("state", state).withColumn("holds", F.when(F.col("state") == "ACTIVE", F.col("newest")))
