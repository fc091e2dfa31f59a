"""Metric series and latency analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewater.operators.indicators import newest


def counter_delta(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """Growth of a counter that may be reset: where it falls, what it had is carried on. keys, delta, resets."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    x = df.withColumn("_c", F.when(F.col(value) < was, was)).groupBy(*keys)
    return x.agg((F.coalesce(F.sum("_c"), F.lit(0)) + F.max_by(value, time) - F.min_by(value, time)).alias("delta"), F.count("_c").alias("resets"))


def pair_progress(df: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """keys, delta, increases, resets from neighbouring samples; a reset counts what the new one has."""
    was = F.lag(value).over(Window.partitionBy(*keys).orderBy(time))
    v = F.col(value)
    x = df.withColumn("_d", F.when(v >= was, v - was).when(v < was, v)).withColumn("_up", (v > was).cast("long")).withColumn("_r", (v < was).cast("long"))
    return x.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(n) for c, n in (("_d", "delta"), ("_up", "increases"), ("_r", "resets"))])


def rates(df: DataFrame, keys: list[str], time: str, value: str, per: int = 1000, order: str | None = None) -> DataFrame:
    """Growth by ``per`` units of time between neighbouring samples (by ``order``); steps that take no time are left out."""
    w = Window.partitionBy(*keys).orderBy(order or time)
    dt, dv = F.col(time) - F.lag(time).over(w), F.col(value) - F.lag(value).over(w)
    return df.withColumn("_dt", dt).withColumn("rate", dv * per / F.nullif(F.col("_dt"), F.lit(0))).where("_dt > 0").drop("_dt")


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: list[int], half_even: bool = True) -> DataFrame:
    """keys, n and the percentiles ``p<share>``: the sample at place round(share / 100 * (n - 1)) (half to even), or floor(share / 100 * n).

    Equal values are counted first, and places are running counts of them: a group is never gathered into an array."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    x = counts.withColumn("_upto", F.sum("_n").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("_all", F.sum("_n").over(w))
    at = lambda s: F.bround(F.lit(s) * (F.col("_all") - 1) / 100) if half_even else F.least(F.floor(F.lit(s) * F.col("_all") / 100), F.col("_all") - 1)
    return x.groupBy(*keys).agg(F.max("_all").alias("n"), *[F.min(F.when(F.col("_upto") > at(s), F.col(value))).alias(f"p{s}") for s in shares])


def kpi_windows(df: DataFrame, time: str, value: str, window_ms: int, limit: Column | float) -> DataFrame:
    """One row: windows, windows whose maximum exceeds ``limit``, the median and the largest of the maxima."""
    x = df.groupBy(F.floor(F.col(time) / window_ms).alias("_w")).agg(F.max(value).alias("_m"))
    return x.agg(F.count(F.lit(1)).alias("windows"), F.coalesce(F.sum((F.col("_m") > limit).cast("long")), F.lit(0)).alias("over"), F.median("_m").alias("median_max"), F.max("_m").alias("max"))


def hop_budget(df: DataFrame, stages: list[str], stage: str = "stage", value: str = "ms") -> DataFrame:
    """stage, place, median and maximum of each stage's cumulative time, and what it adds to the stage before."""
    place = F.create_map(*[x for k, s in enumerate(stages) for x in (F.lit(s), F.lit(k).cast("long"))])
    x = df.where(F.col(stage).isin(*stages)).groupBy(F.col(stage).alias("stage")).agg(F.median(value).alias("median"), F.max(value).alias("max"))
    x = x.withColumn("place", place[F.col("stage")])
    return x.withColumn("adds", F.col("median") - F.coalesce(F.lag("median").over(Window.orderBy("place")), F.lit(0.0)))  # a row for each stage


def breaches(df: DataFrame, key: str, time: str, value: str, limit: float, least_ms: int) -> DataFrame:
    """Runs of samples at or above ``limit`` that last ``least_ms`` or longer: key, begins, ends, samples, peak."""
    w = Window.partitionBy(key).orderBy(time)
    x = df.withColumn("_o", (F.col(value) >= limit).cast("long"))
    x = x.withColumn("_g", F.sum(1 - F.col("_o")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("_o = 1")
    return x.groupBy(key, "_g").agg(F.min(time).alias("begins"), F.max(time).alias("ends"), F.count(F.lit(1)).alias("samples"), F.max(value).alias("peak")).where(F.col("ends") - F.col("begins") >= least_ms).drop("_g")


def census(df: DataFrame, keys: list[str], distinct: str | None = None) -> DataFrame:
    out = [F.count(F.lit(1)).alias("n")] + ([F.countDistinct(distinct).alias("distinct_n"), (F.count(distinct) - F.countDistinct(distinct)).alias("duplicates")] if distinct else [])
    return df.groupBy(*keys).agg(*out)


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """min, max, avg and sum (two decimals) and count by keys."""
    v = F.col(value)
    return df.groupBy(*keys).agg(*[F.round(f(v), 2).alias(n) for f, n in ((F.min, "min"), (F.max, "max"), (F.avg, "avg"), (F.sum, "total"))], F.count(v).alias("n"))


def latency(begin: Column, end: Column, most_ms: int = 86_400_000) -> Column:
    """end - begin; null if begin isn't positive, end is before it, or it takes longer than a day."""
    return F.when((begin > 0) & (end >= begin) & (end - begin <= most_ms), end - begin)


def last_samples(df: DataFrame, keys: list[str], order: list[str], value: str, shares: list[float], most: int = 4096) -> DataFrame:
    """keys, n and percentiles ``p<share>`` of the ``most`` newest samples: place share / 100 * (n + 1) among them in order, between
    two places in proportion, the least and the greatest beyond the ends."""
    x = newest(df.where(F.col(value).isNotNull()), keys, order, most)
    w = Window.partitionBy(*keys)
    x = x.withColumn("_k", F.row_number().over(w.orderBy(value))).withColumn("_n", F.count(F.lit(1)).over(w))
    out = []
    for s in shares:
        place = F.greatest(F.lit(1.0), F.least(F.col("_n").cast("double"), F.lit(s / 100) * (F.col("_n") + 1)))
        part = F.when(F.col("_k") == F.floor(place), 1 - (place - F.floor(place))).when(F.col("_k") == F.floor(place) + 1, place - F.floor(place)).otherwise(0.0)
        out.append(F.sum(F.col(value) * part).alias(f"p{s:g}"))
    return x.groupBy(*keys).agg(F.max("_n").alias("n"), *out)
