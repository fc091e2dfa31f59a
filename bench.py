"""Times the headline queries on ``$BENCH_SF_DIR`` with ``$BENCH_CPUS`` cores; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidewater import catalog
from tidewater.functions import identity
from tidewater.operators import candles
from tidewater.sources.logs import synthetic_ticks

HEADLINE = [
    "candles", "forming_candles", "candle_parity", "market_snapshot", "sma20", "rsi14", "narrowest_range_setups", "breakout_signals", "dedup_first_seen", "dedup_fifo", "tick_validation", "event_fingerprints",
    "book_walk", "positions", "order_lifecycles", "instrument_enrichment", "correlation", "versioned_current", "forward_fill", "counter_delta", "nearest_rank_percentiles", "dashboard_histogram",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "*")
    n = os.cpu_count() if cpus == "*" else int(cpus)
    conf = {"spark.sql.shuffle.partitions": str(n), "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.ui.showConsoleProgress": "false"}
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("bench").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    queries["tick_reject_census"](spark, sf).collect()  # starts the workers and warms the file cache
    took = {}
    for name in HEADLINE:
        begin = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - begin, 3)
    # throughput on a made-up feed of 1024 tokens, 60 ms apart
    feed, rates = synthetic_ticks(spark, 1024, 3000), {}
    prints = feed.select(identity.event_fingerprint(*[identity.big_endian(F.col(c)) for c in ("token", "event_time", "price_paise", "volume_delta")]).alias("f"))
    for name, df in (("candles_ticks_per_s", candles.candles(feed)), ("fingerprints_per_s", prints)):
        begin = time.perf_counter()
        df.write.format("noop").mode("overwrite").save()
        rates[name] = round(1024 * 3000 / (time.perf_counter() - begin))
    name = os.path.basename(sf)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(name[2:]) if name.startswith("sf") else name, "feed": rates}))
    spark.stop()


if __name__ == "__main__":
    main()
