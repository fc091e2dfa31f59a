"""Sources and sinks: append logs by day, versioned key tables, manifests, archives, tick JSON, metric text, synthetic load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.functions import book
from tidewater.functions import timeframes as tf

# -- append logs ------------------------------------------------------------------------------------


def append_log(df: DataFrame, path: str, time: str = "event_time") -> None:
    """Appends rows, one folder a day of the exchange."""
    df.withColumn("event_day", tf.event_day(F.col(time))).repartition("event_day", F.pmod(F.xxhash64(time), F.lit(8))).write.mode("append").partitionBy("event_day").parquet(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType | str, first_day: str | None = None, last_day: str | None = None) -> DataFrame:
    """A log's rows; days outside the bounds are never listed as files to read."""
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    names = [f.name for f in schema.fields]
    full = schema if "event_day" in names else T.StructType([*schema.fields, T.StructField("event_day", T.StringType())])
    df = spark.read.schema(full).parquet(path)
    if first_day:
        df = df.where(F.col("event_day") >= first_day)
    return df.where(F.col("event_day") <= last_day) if last_day else df


def log_stream(spark: SparkSession, path: str, schema: T.StructType | str, per_trigger: int = 16, latest: bool = False) -> DataFrame:
    """The same log as a stream, ``per_trigger`` files a batch; ``latest``: the newest files first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("latestFirst", latest).parquet(path)


def days(spark: SparkSession, path: str) -> list[str]:
    """The day folders of a log."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(n.split("=", 1)[1] for s in fs.listStatus(p) if (n := s.getPath().getName()).startswith("event_day="))


def expire(spark: SparkSession, path: str, keep: int, verified: set[str]) -> list[str]:
    """Drops day folders beyond the ``keep`` newest, but only verified ones; returns the dropped days."""
    jvm = spark._jvm
    gone = [d for d in days(spark, path)[:-keep or None] if d in verified] if keep else []
    for d in gone:
        p = jvm.org.apache.hadoop.fs.Path(f"{path}/event_day={d}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return gone


def tail(df: DataFrame, order: str, n: int = 100) -> DataFrame:
    return df.orderBy(F.desc(order)).limit(min(n, 10_000))


# -- manifests --------------------------------------------------------------------------------------


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Instruments of a CSV manifest: columns by name whatever their case (with or without byte order mark), quoted fields allowed.

    token, symbol, exchange, segment, lot_size; TradingSymbol or FullName names the symbol. Raises if a required column
    is missing; rows that break a rule have a ``reason``."""
    raw = spark.read.csv(path, header=True, quote='"', escape='"', encoding="UTF-8")
    by = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    lacking = [n for n in ("token", "lotsize") if n not in by] + ([] if {"tradingsymbol", "fullname"} & by.keys() else ["tradingsymbol"])
    if lacking:
        raise ValueError(f"the manifest lacks {', '.join(lacking)}")
    col = lambda n: F.trim(F.col(f"`{by[n]}`")) if n in by else F.lit(None).cast("string")
    out = raw.select(
        col("token").try_cast("long").alias("token"), F.coalesce(F.nullif(col("tradingsymbol"), F.lit("")), col("fullname")).alias("symbol"), F.coalesce(col("exchange"), F.lit("NSE")).alias("exchange"),
        F.coalesce(col("segment"), F.lit("CM")).alias("segment"), col("lotsize").try_cast("int").alias("lot_size"),
    )
    bad = F.when(F.coalesce(F.col("token"), F.lit(0)) <= 0, "token").when(F.coalesce(F.col("symbol"), F.lit("")) == "", "symbol").when(F.coalesce(F.col("lot_size"), F.lit(0)) <= 0, "lot-size")
    return out.withColumn("reason", bad)


def split_manifest(df: DataFrame, parts: int) -> DataFrame:
    """Adds ``part``: tokens dealt to equal parts by order."""
    from pyspark.sql import Window

    return df.withColumn("part", F.ntile(parts).over(Window.orderBy("token")))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """key, size of each data file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    return files.select(F.col("path").alias("key"), F.col("length").alias("size"))


def manifest_hash(files: DataFrame) -> DataFrame:
    """One row: files, bytes, and the SHA-256 of their sorted keys and sizes."""
    rows = F.array_sort(F.collect_list(F.concat_ws(":", F.element_at(F.split("key", "/"), -1), F.col("size").cast("string"))))
    return files.agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.sha2(F.array_join(rows, "\n"), 256).alias("hash"))


def restore(spark: SparkSession, source: str, target: str) -> int:
    """Copies an archive's Parquet files into one table; refuses one that has delete files. Returns the rows."""
    p = spark._jvm.org.apache.hadoop.fs.Path(f"{source}/*delete*")
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    if found is not None and len(found):
        raise ValueError("the archive has delete files")
    spark.read.option("recursiveFileLookup", True).parquet(source).write.mode("errorifexists").parquet(target)
    return spark.read.parquet(target).count()


# -- ticks as JSON lines ----------------------------------------------------------------------------

_LONGS = "token ts_ms ltp_paise close_paise open_paise high_paise low_paise vwap_paise ltq volume total_buy_qty total_sell_qty open_interest".split()
_LADDERS = "bid_px ask_px bid_qty ask_qty bid_orders ask_orders".split()
TICK_SCHEMA = T.StructType(
    [T.StructField("feed", T.StringType()), T.StructField("mode", T.StringType()), *(T.StructField(c, T.LongType()) for c in _LONGS), *(T.StructField(c, T.ArrayType(T.LongType())) for c in _LADDERS), T.StructField("connection_id", T.StringType()), T.StructField("connection_epoch", T.LongType())]
)


def read_ticks(spark: SparkSession, path: str) -> DataFrame:
    """Ticks of JSON lines by the fixed schema; ladders become five columns a side, missing levels 0. Lines that aren't
    JSON keep their text in ``_corrupt``."""
    schema = T.StructType([*TICK_SCHEMA.fields, T.StructField("_corrupt", T.StringType())])
    x = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return x.select("feed", "mode", *_LONGS, *[F.get(book.ladder(F.coalesce(c, F.array().cast("array<long>"))), F.lit(k)).alias(f"{c}_{k + 1}") for c in _LADDERS for k in range(5)], "connection_id", "connection_epoch", "_corrupt")


# -- metrics as text --------------------------------------------------------------------------------


def parse_metrics(lines: DataFrame, value: str = "value") -> DataFrame:
    """metric, labels (text), sample of exposition lines; comments and lines of another form are left out."""
    pattern = r"^([A-Za-z_:][A-Za-z0-9_:]*)(?:\{([^}]*)\})?\s+(-?[0-9.eE+-]+|NaN|[+-]?Inf)(?:\s+\d+)?\s*$"
    get = lambda k: F.regexp_extract(value, pattern, k)
    return lines.where(~F.col(value).startswith("#") & F.col(value).rlike(pattern)).select(get(1).alias("metric"), get(2).alias("labels"), get(3).try_cast("double").alias("sample"))


# -- synthetic load ---------------------------------------------------------------------------------


def synthetic_ticks(spark: SparkSession, tokens: int, per_token: int, seed: int = 42, begin_ms: int = 1_704_080_700_000, least_ms: int = 55, most_ms: int = 65) -> DataFrame:
    """A seeded schedule of each token, ``least_ms`` to ``most_ms`` between ticks on the whole, numbered in time order by (event_time, token)."""
    k, token = F.pmod(F.col("id"), F.lit(per_token)), book.div(F.col("id"), per_token)
    mean = (least_ms + most_ms) / 2
    jitter: Column = F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(most_ms - least_ms + 1)) - (most_ms - least_ms) // 2
    price: Column = 10_000 + F.pmod(F.xxhash64(token, F.lit(seed)), F.lit(5_000)) + F.pmod(F.xxhash64("id", F.lit(seed + 1)), F.lit(201)) - 100
    x = spark.range(tokens * per_token).select((token + 1).alias("token"), (F.lit(begin_ms) + (k * mean).cast("long") + jitter).alias("event_time"), k.alias("seq"), price.alias("price_paise"), (1 + F.pmod(F.xxhash64("id", F.lit(seed + 2)), F.lit(50))).alias("volume_delta"))
    return x.withColumn("tick_type", F.lit("TRADE"))
