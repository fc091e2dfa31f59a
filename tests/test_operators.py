"""Folds, sources, streams and strategies against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.functions import identity
from tidewater.functions import timeframes as tf
from tidewater.operators import audit, candles, diagnostics, features, folds, joins, metrics, ticks
from tidewater.plans import strategies
from tidewater.sources import logs
from tidewater.streaming import queries as streaming

OPEN = 1_704_080_700_000


def random_ticks(seed, n=400):
    r = random.Random(seed)
    t, out = OPEN - 60_000, []
    for seq in range(n):
        t += r.choice([500, 1000, 4000, 29_000, 30_000, 30_001, 45_000, 400_000, -3000, 0]) if r.random() < 0.97 else 86_400_000
        out.append((r.randrange(3), seq, t, r.randrange(100, 200), r.randrange(0, 5), r.choice(["TRADE", "TRADE", "QUOTE"])))
    return out


TICK = "token long, seq long, event_time long, price_paise long, volume_delta long, tick_type string"


def folded(rows):
    out, by = {}, {}
    for token, _, t, p, v, kind in sorted(rows, key=lambda r: r[1]):
        if kind == "TRADE":
            f = by.setdefault(token, streaming.CandleFold())
            for b in f.add(t, p, v):
                out[token, b[0], b[1]] = b[2:9]
    for token, f in by.items():
        for b in f.forming():
            out[token, b[0], b[1]] = b[2:9]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_candles_match_the_fold(spark, seed):
    rows = random_ticks(seed)
    got = candles.candles(spark.createDataFrame(rows, TICK)).collect()
    cols = ["window_end", "open_paise", "high_paise", "low_paise", "close_paise", "volume", "tick_count"]
    assert {(r.token, r.tf, r.window_start): tuple(r[c] for c in cols) for r in got} == folded(rows)


def test_candle_stream_matches_batch(spark, tmp_path):
    rows = random_ticks(9)
    src = str(tmp_path / "in")
    for k in range(0, len(rows), 100):
        spark.createDataFrame(rows[k : k + 100], TICK).coalesce(1).write.mode("append").parquet(src)
    seen = {}

    def take(df, batch):
        for r in df.collect():
            key = (r.token, r.tf, r.window_start)
            if key not in seen or seen[key].last_event_time <= r.last_event_time:
                seen[key] = r

    # files of one folder come in order of their times; one by one keeps arrival order
    import os
    import time

    files = sorted((p for p in (tmp_path / "in").glob("*.parquet")), key=lambda p: spark.read.parquet(str(p)).agg(F.min("seq")).first()[0])
    for k, p in enumerate(files):
        os.utime(p, (time.time() + k * 10 - 1000,) * 2)
    q = streaming.candle_stream(logs.log_stream(spark, src, TICK, per_trigger=1)).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(take).trigger(availableNow=True).start()
    q.awaitTermination(120)
    cols = ["window_end", "open_paise", "high_paise", "low_paise", "close_paise", "volume", "tick_count"]
    assert {k: tuple(r[c] for c in cols) for k, r in seen.items()} == folded(rows)


def test_dedup_and_windows_stream(spark, tmp_path):
    rows = [(1, k, OPEN + k * 1000, 100, 1, "TRADE") for k in range(60)] * 2
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, TICK).coalesce(1).write.parquet(src)
    stream = logs.log_stream(spark, src, TICK)
    q = streaming.dedup_stream(stream, ["token", "seq"]).writeStream.format("memory").queryName("dedup").option("checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("dedup").count() == 60
    q = streaming.window_volume(stream).writeStream.format("memory").queryName("volume").outputMode("append").option("checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert {r.tick_count for r in spark.table("volume").collect()} == {30}


def test_versioned_table(spark, tmp_path):
    t = streaming.VersionedTable(spark, str(tmp_path / "t"), ["k"], "v")
    assert t.read() is None
    make = lambda rows: spark.createDataFrame(rows, "k long, v long, x string")
    t.merge(make([(1, 5, "a"), (2, 5, "a")]), 0)
    t.merge(make([(1, 4, "old"), (2, 5, "same")]), 1)
    t.merge(make([(1, 9, "again")]), 1)  # the batch comes twice
    assert {(r.k, r.v, r.x) for r in t.read().collect()} == {(1, 5, "a"), (2, 5, "same")}


def test_positions(spark):
    fills = [(1, 1001, 1, 1, "BUY", 10, 1000), (1, 1001, 2, 2, "BUY", 5, 1100), (1, 1001, 3, 3, "SELL", 8, 1050), (1, 1001, 4, 4, "SELL", 7, 1060), (1, 1001, 5, 5, "SELL", 1, 1), (1, 1001, 5, 6, "BUY", 2, 900), (1, 1001, 3, 9, "BUY", 1, 1)]
    df = spark.createDataFrame(fills, "account long, token long, version long, event_id long, side string, qty long, price_paise long")
    got = sorted(folds.positions(df).collect(), key=lambda r: (r.version, r.event_id))
    by = {(r.version, r.event_id): r for r in got}
    assert [(by[k].state, by[k].open_qty, by[k].closed_qty, by[k].entry_paise) for k in ((1, 1), (2, 2))] == [("OPEN", 10, 0, 1000), ("OPEN", 15, 0, 1033)]
    assert (by[3, 3].state, by[3, 3].closed_qty, by[3, 3].exit_paise) == ("REDUCING", 8, 1050)
    assert by[3, 9].outcome == "VIOLATION"  # an older version of another event
    assert (by[4, 4].state, by[4, 4].exit_paise) == ("CLOSED", 1054)
    assert by[5, 5].outcome == "VIOLATION" and by[5, 6].position_id == "pos-1-1001-BUY-2"


def test_fifo_dedup(spark):
    marks = [1, 2, 1, 3, 4, 1, 2]
    df = spark.createDataFrame([(1, str(m), k) for k, m in enumerate(marks)], "token long, fingerprint string, seq long")
    assert [r.seq for r in ticks.fifo_dedup(df, most=2).orderBy("seq").collect()] == [0, 1, 3, 4, 5, 6]


def test_identities(spark):
    import uuid


    row = spark.range(1).select(identity.name_uuid(F.lit("rule|1|15s|2|BUY")).alias("u"), identity.fnv1a_mod_million(F.lit("a")).alias("f"), identity.length_join(F.lit("v1"), F.lit(None)).alias("j")).first()
    import hashlib

    h = bytearray(hashlib.md5(b"rule|1|15s|2|BUY").digest())
    h[6], h[8] = h[6] & 0x0F | 0x30, h[8] & 0x3F | 0x80
    assert row.u == str(uuid.UUID(bytes=bytes(h))) and row.j == "2:v1|4:null"
    assert row.f == (0xAF63DC4C8601EC8C - (1 << 64)) % 1_000_000


def test_sources(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text('﻿TOKEN,TradingSymbol,lotsize\n1,"A, B",10\n-2,X,1\n3,,5\n4,Y,0\n', encoding="utf-8")
    got = logs.read_manifest(spark, str(p)).collect()
    assert [(r.token, r.symbol, r.reason) for r in got] == [(1, "A, B", None), (-2, "X", "token"), (3, None, "symbol"), (4, "Y", "lot-size")]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError):
        logs.read_manifest(spark, str(tmp_path / "bad.csv"))
    log = str(tmp_path / "log")
    logs.append_log(logs.synthetic_ticks(spark, 3, 10), log)
    logs.append_log(logs.synthetic_ticks(spark, 3, 10, begin_ms=OPEN + tf.DAY_MS), log)
    assert logs.days(spark, log) == ["20240101", "20240102"]
    assert logs.read_log(spark, log, TICK, first_day="20240102").count() == 30
    files = logs.file_manifest(spark, log)
    assert logs.manifest_hash(files).first().files == files.count()
    assert logs.restore(spark, log, str(tmp_path / "whole")) == 60
    assert logs.expire(spark, log, 1, {"20240101"}) == ["20240101"] and logs.days(spark, log) == ["20240102"]
    (tmp_path / "t.json").write_text('{"feed":"hft","token":7,"bid_px":[5,4],"ltp_paise":9}\nnot json\n')
    rows = logs.read_ticks(spark, str(tmp_path / "t.json")).collect()
    assert (rows[0].token, rows[0].bid_px_2, rows[0].bid_px_3, rows[0].ask_px_1) == (7, 4, 0, 0) and rows[1]._corrupt == "not json"
    m = logs.parse_metrics(spark.createDataFrame([("# HELP x",), ('x{a="1"} 2.5',), ("y 3",), ("bad line here",)], "value string")).collect()
    assert [(r.metric, r.sample) for r in m] == [("x", 2.5), ("y", 3.0)]


def test_strategies(spark):
    r = random.Random(1)
    rows = [(1, k, OPEN + k * 2000, 1000 + r.randrange(100), 1, "TRADE") for k in range(2500)]
    df = spark.createDataFrame(rows, TICK)
    bad = strategies.Strategy("bad", lambda t: t.select("nothing"))
    got = strategies.host(df, [strategies.REGISTRY["n7-breakout"], bad])
    assert set(got.failed) == {"bad"}
    assert 0 < got.signals.count() <= 16 and strategies.canonical(got.signals, {"n7-breakout", "stub"}).count() == got.signals.count()


def test_audit_and_metrics(spark):
    log = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 1, "b"), (2, 3, 1, "c")], "k long, offset long, version long, x string")
    assert audit.converges(log, ["k"], 2).first().diverged == 0
    assert [r.stage for r in audit.absent(spark.createDataFrame([("a",)], "stage string"), ["a", "b"]).collect()] == ["b"]
    assert audit.unowned({"w": {"a", "b"}}, {"w": {"a"}}) == [("w", "b")]
    assert audit.schema_violations(log, "k long, offset int, y string") == ["extra version", "extra x", "missing y", "offset: bigint instead of int"]
    s = spark.createDataFrame([(1, t, v) for t, v in enumerate([5, 9, 2, 4])], "k long, t long, v long")
    assert metrics.counter_delta(s, ["k"], "t", "v").first().delta == 8 and metrics.pair_progress(s, ["k"], "t", "v").first().delta == 8
    assert joins.as_of(spark.createDataFrame([(1, 10)], "k long, t long"), spark.createDataFrame([(1, 4, 7)], "k long, t long, v long"), "k", "t", "v", 5).first().v is None


def test_candle_stream_timers(spark, tmp_path):
    """Bars are sealed by event time (the last of the day at the session's close), not only by a later trade of their token; a token
    whose state was forgotten starts anew."""
    import os
    import time

    close = OPEN + 375 * 60_000
    rows = [(1, 0, OPEN + 1000, 100, 2, "TRADE"), (1, 1, OPEN + 9000, 130, 1, "TRADE"), (2, 2, OPEN + 2000, 50, 1, "TRADE"), (2, 3, OPEN + 20_000, 60, 1, "TRADE")]
    late = [(1, 4, close - 5000, 90, 4, "TRADE")]
    after = [(2, 5, close + 60_000, 70, 1, "TRADE"), (2, 6, close + 61_000, 70, 1, "TRADE")]
    again = [(1, 7, close + 20 * 3_600_000 + 1000, 75, 1, "TRADE"), (1, 8, close + 25 * 3_600_000, 75, 1, "TRADE")]
    src = str(tmp_path / "in")
    for k, part in enumerate((rows, late, after, again)):
        spark.createDataFrame(part, TICK).coalesce(1).write.mode("append").parquet(src)
        new = max((tmp_path / "in").glob("*.parquet"), key=lambda p: p.stat().st_mtime)
        os.utime(new, (time.time() - 1000 + k * 10,) * 2)
    sealed = []
    take = lambda df, batch: sealed.extend(df.where("sealed").collect())
    stream = streaming.candle_stream(logs.log_stream(spark, src, TICK, per_trigger=1), delay="500 milliseconds")
    start = lambda: stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).foreachBatch(take).trigger(availableNow=True).start()
    streaming.restarted(start, delay_s=0)
    seen = {(r.token, r.tf, r.window_start): (r.window_end, r.close_paise, r.volume, r.tick_count) for r in sealed}
    assert len(seen) == len(sealed)  # once a bar
    assert seen[1, "15s", OPEN] == (OPEN + 15_000, 130, 3, 2)
    assert seen[2, "15m", OPEN] == (OPEN + 900_000, 60, 2, 2)
    assert {r.tf for r in sealed if r.window_end == close} == {f.name for f in tf.TIMEFRAMES}
    assert all(v == (close, 90, 4, 1) for (token, _, _), v in seen.items() if v[0] == close)


def test_restarts():
    from pyspark.errors import StreamingQueryException

    class Query:
        def __init__(self, fails):
            self.fails = fails

        def awaitTermination(self):  # noqa: N802
            if self.fails:
                raise StreamingQueryException("fault")

    made = []

    def start(good):
        def f():
            made.append(Query(len(made) < good))
            return made[-1]

        return f

    assert streaming.restarted(start(2), attempts=3, delay_s=0) is made[2]
    made.clear()
    with pytest.raises(StreamingQueryException):
        streaming.restarted(start(9), attempts=3, delay_s=0)
    assert len(made) == 4


def test_feature_registry(spark):
    r = features.REGISTRY
    assert [f.id for f in r.features] == list(range(55))
    assert (r.by_id(15).name, r.by_id(44).name, r.by_id(45).name, r.by_id(54).name) == ("bid_px_1", "ask_ord_5", "day_volume", "microprice_paise")
    assert r.ids(cadence="TICK") == [0] and r.ids("30s", "CLOSE") == [] and r.ids("3m", "CLOSE") == [1] and r.ids("5m", "CLOSE") == [1, 2]
    for bad in (lambda: r.by_id(55), lambda: r.by_id(-1), lambda: r.by_name("none"), lambda: r.value(F.col("m"), "none")):
        with pytest.raises(KeyError):
            bad()
    one = features.Feature(0, "a", "TICK", lambda: F.lit(1.0))
    for wrong in ([features.Feature(1, "a", "TICK", lambda: F.lit(1.0))], [one, features.Feature(1, "a", "TICK", lambda: F.lit(1.0))]):
        with pytest.raises(ValueError):
            features.Registry(wrong)
    off = features.Registry([one, features.Feature(1, "b", "TICK", lambda: F.lit(2.0), active=False), features.Feature(2, "c", "CLOSE", lambda: F.lit(float("nan")))])
    x = spark.range(1).select(off.snapshot(F.lit("1m")).alias("m")).select("m", off.value(F.col("m"), "a").alias("a"), off.value(F.col("m"), "b").alias("b"), off.value(F.col("m"), "c").alias("c")).first()
    assert (x.m, x.a, x.b, x.c) == ({0: 1.0}, 1.0, None, None)


def test_last_samples(spark):
    r = random.Random(3)
    rows = [(k % 3, k, r.randrange(40)) for k in range(900)]
    got = {x.g: x for x in metrics.last_samples(spark.createDataFrame(rows, "g long, t long, v long"), ["g"], ["t"], "v", [0.1, 50, 99.9], 64).collect()}
    for g in range(3):
        v = sorted([x[2] for x in rows if x[0] == g][-64:])

        def at(p, v=v):
            place = p / 100 * 65
            k = int(place)
            return v[0] if k < 1 else v[-1] if k >= 64 else v[k - 1] + (place - k) * (v[k] - v[k - 1])

        assert got[g].n == 64
        assert [got[g]["p0.1"], got[g]["p50"], got[g]["p99.9"]] == pytest.approx([at(0.1), at(50), at(99.9)])


def test_source_states(spark):
    rows = [("a", 0, 5), ("a", 50_000, 9), ("b", 1000, 7), ("b", 58_000, 7), ("c", 42_000, 3)]
    got = {r.s: (r.state, r.holds) for r in diagnostics.source_states(spark.createDataFrame(rows, "s string, seen long, t long"), "s", "seen", "t", F.lit(61_000)).collect()}
    assert got == {"a": ("ACTIVE", 9), "b": ("ALERT", None), "c": ("IDLE", None)}  # b's second event doesn't advance


def test_escaped(spark):
    rows = [("a|b",), ("a\\",), ("\U0001f600",), ("",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "x string").select(identity.escaped(F.col("x"))).collect()]
    assert got == ["3:a\\|b", "2:a\\\\", "2:\U0001f600", "0:", "\\0"]


def test_interpolation_reads_no_frame_to_the_end_of_a_key(spark):
    r = random.Random(31)
    right = {(k % 2, t): float(r.randrange(100)) for k, t in enumerate(r.sample(range(1000), 300))}
    left = [(k, t) for k in range(3) for t in range(0, 1000, 7)]
    a, b = spark.createDataFrame(left, "token long, at long"), spark.createDataFrame([(*k, v) for k, v in right.items()], "token long, at long, price double")
    got = joins.interpolated(a, b, "token", "at", "price")
    assert "unboundedfollowing" not in got._jdf.queryExecution().optimizedPlan().toString().lower()  # such a frame takes the square of a key's rows
    for x in got.collect():
        times = sorted(t for k, t in right if k == x.token)
        lo, hi = max((t for t in times if t <= x["at"]), default=None), min((t for t in times if t >= x["at"]), default=None)
        if lo is None or hi is None:
            assert x.price is None
        else:
            p, q = right[x.token, lo], right[x.token, hi]
            assert x.price == (p if lo == hi else pytest.approx(p + (q - p) * (x["at"] - lo) / (hi - lo)))
