"""The registered queries over the reference tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewater.functions import book, identity, text
from tidewater.functions import timeframes as tf
from tidewater.operators import audit, candles, folds, indicators, joins, metrics, ticks
from tidewater.plans import extra, registry
from tidewater.plans.views import CANDLES_SQL, DAY, IN_SESSION, PARTS_SQL, TICKS_SQL, TRADES_SQL, fills, ladders, read
from tidewater.plans.views import ticks as tick_view

FLAGSHIP = "candles"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _QUERIES | extra.QUERIES | registry.QUERIES


def oracle_sql() -> dict[str, str]:
    return _SQL | extra.SQL | registry.SQL


def _candles(s: SparkSession, d: str) -> DataFrame:
    return candles.candles(tick_view(s, d))


def long(x) -> F.Column:
    return F.lit(x).cast("long")


# -- ticks ----------------------------------------------------------------------------------------


@query(f"WITH {CANDLES_SQL} SELECT * FROM candles")
def candles_query(s, d):
    return _candles(s, d)


_QUERIES["candles"], _SQL["candles"] = _QUERIES.pop("candles_query"), _SQL.pop("candles_query")

_RAW = """raw AS (SELECT event_id AS seq, CASE WHEN event_id % 97 = 0 THEN 'delete' ELSE 'insert' END AS change_type, CASE WHEN event_id % 53 = 0 THEN ' ' ELSE 'f' || event_id END AS fingerprint,
  CASE WHEN event_id % 59 = 0 THEN NULL ELSE 'v1' END AS fingerprint_version, CASE WHEN event_id % 61 = 0 THEN '2' ELSE '1' END AS schema_version,
  CASE WHEN event_type = 'error' THEN 'INVALID_VALUES' WHEN event_type = 'view' THEN 'VALID_NON_TRADE' ELSE 'VALID_TRADE' END AS validity_state,
  CAST(round(value * 100) AS BIGINT) - 500 AS price_paise, event_id % 71 - 1 AS last_qty, CAST(json_extract_string(props, '$.k') AS BIGINT) - 2 AS volume_delta, (event_id % 83) * 1000000000000 * 4 AS event_time FROM events)"""
_REASON = """CASE WHEN change_type NOT IN ('insert', 'update_postimage') THEN 'rowkind-not-insert' WHEN trim(fingerprint) = '' THEN 'blank-fingerprint' WHEN fingerprint_version IS NULL THEN 'blank-fingerprint-version'
  WHEN schema_version <> '1' THEN 'schema-version' WHEN validity_state NOT IN ('VALID_TRADE', 'VALID_NON_TRADE') THEN 'validity-state' WHEN validity_state = 'VALID_TRADE' AND price_paise <= 0 THEN 'non-positive-price'
  WHEN last_qty < 0 THEN 'negative-qty' WHEN volume_delta < 0 THEN 'negative-volume-delta' WHEN event_time <= 0 THEN 'non-positive-event-time' WHEN event_time > 253402300799999 THEN 'event-time-overflow-window' END"""


def _raw(s, d):
    i = F.col("event_id")
    return read(s, d, "events").select(
        i.alias("seq"), F.when(i % 97 == 0, "delete").otherwise("insert").alias("change_type"), F.when(i % 53 == 0, " ").otherwise(F.concat(F.lit("f"), i.cast("string"))).alias("fingerprint"),
        F.when(i % 59 != 0, "v1").alias("fingerprint_version"), F.when(i % 61 == 0, "2").otherwise("1").alias("schema_version"),
        F.when(F.col("event_type") == "error", "INVALID_VALUES").when(F.col("event_type") == "view", "VALID_NON_TRADE").otherwise("VALID_TRADE").alias("validity_state"),
        (F.round(F.col("value") * 100).cast("long") - 500).alias("price_paise"), (i % 71 - 1).alias("last_qty"), (F.get_json_object("props", "$.k").cast("long") - 2).alias("volume_delta"), ((i % 83) * 4_000_000_000_000).alias("event_time"),
    )


@query(f"WITH {_RAW} SELECT seq, {_REASON} AS reason FROM raw")
def tick_validation(s, d):
    return _raw(s, d).select("seq", ticks.reject_reason().alias("reason"))


@query(f"WITH {_RAW} SELECT coalesce({_REASON}, 'valid') AS reason, count(*) AS n FROM raw GROUP BY 1")
def tick_reject_census(s, d):
    return _raw(s, d).groupBy(F.coalesce(ticks.reject_reason(), F.lit("valid")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {TICKS_SQL} SELECT seq, CASE WHEN (event_time + 19800000) % 86400000 < 33300000 THEN 'PRE_OPEN' WHEN {IN_SESSION.format("event_time")} THEN 'IN_SESSION' ELSE 'POST_CLOSE' END AS phase,
  strftime(epoch_ms(event_time + 19800000), '%Y%m%d') AS event_day, {DAY.format("event_time")} * 86400000 + 13500000 AS session_open FROM ticks""")
def session_phase(s, d):
    t = F.col("event_time")
    return tick_view(s, d).select("seq", tf.session_phase(t).alias("phase"), tf.event_day(t).alias("event_day"), tf.session_open(t).alias("session_open"))


@query(f"""WITH {TICKS_SQL}, m AS (SELECT seq, token, price_paise - 400 AS price, CASE seq % 4 WHEN 0 THEN 'ltp' WHEN 1 THEN 'full' WHEN 2 THEN 'quote' ELSE 'ltpc' END AS mode, volume_delta % 3 AS delta, event_time, event_time + (seq % 13) * 1000 - 4000 AS received FROM ticks),
v AS (SELECT *, CASE WHEN mode IN ('ltp', 'ltpc') AND price <= 0 THEN 'INVALID_VALUES' WHEN mode IN ('ltp', 'ltpc', 'full') AND price > 0 THEN 'VALID_TRADE' ELSE 'VALID_NON_TRADE' END AS validity FROM m)
SELECT seq, validity, CASE WHEN validity = 'VALID_TRADE' AND delta > 0 THEN 'TRADE' ELSE 'QUOTE' END AS tick_type, CASE WHEN received - event_time > 5000 THEN 'STALE' WHEN event_time - received > 2000 THEN 'FUTURE' ELSE 'FRESH' END AS freshness FROM v""")
def tick_classification(s, d):
    t, i = tick_view(s, d), F.col("seq") % 4
    m = t.select("seq", (F.col("price_paise") - 400).alias("price"), F.when(i == 0, "ltp").when(i == 1, "full").when(i == 2, "quote").otherwise("ltpc").alias("mode"), (F.col("volume_delta") % 3).alias("delta"), "event_time", (F.col("event_time") + (F.col("seq") % 13) * 1000 - 4000).alias("received"))
    v = m.withColumn("validity", ticks.validity(F.col("mode"), F.col("price")))
    return v.select("seq", "validity", ticks.tick_type(F.col("validity"), F.col("delta")).alias("tick_type"), ticks.freshness(F.col("event_time"), F.col("received"), 5000, 2000).alias("freshness"))


@query("""SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN 'MISSING_HASH' WHEN event_id % 5 = 1 THEN 'HASH_MISMATCH' WHEN event_id % 5 = 2 THEN 'MALFORMED_HASH' ELSE 'VALID' END AS state FROM events""")
def payload_integrity(s, d):
    i, p = F.col("event_id") % 5, F.encode("props", "utf-8")
    h = F.when(i == 1, F.unhex(F.sha2(F.concat(p, p), 256))).when(i == 2, F.unhex(F.md5(p))).when(i > 2, F.unhex(F.sha2(p, 256)))
    return read(s, d, "events").select(F.col("event_id").alias("seq"), ticks.payload_state(p, h).alias("state"))


@query(f"WITH {TICKS_SQL}, x AS (SELECT *, row_number() OVER (PARTITION BY token, price_paise ORDER BY seq) AS n FROM ticks) SELECT token, price_paise, seq, event_time FROM x WHERE n = 1")
def dedup_first_seen(s, d):
    return ticks.first_seen(tick_view(s, d).select("token", "price_paise", "seq", "event_time"), ["token", "price_paise"])


@query()
def dedup_fifo(s, d):
    return ticks.fifo_dedup(tick_view(s, d).select("token", F.col("price_paise").cast("string").alias("fingerprint"), "seq"), most=200)


@query(f"WITH {TRADES_SQL} SELECT token, seq, event_time, m IS NULL OR event_time > m AS accepted FROM gate")
def monotonic_gate(s, d):
    return ticks.monotonic_gate(candles.trades(tick_view(s, d))).select("token", "seq", "event_time", "accepted")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, seq, sum(volume_delta) OVER (PARTITION BY token, seq // 500 ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS volume FROM ticks), y AS (SELECT *, lag(volume) OVER (PARTITION BY token ORDER BY seq) AS was FROM x)
SELECT token, seq, CASE WHEN volume >= was THEN volume - was END AS delta FROM y""")
def volume_delta(s, d):
    w = Window.partitionBy("token", book.div(F.col("seq"), 500)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    x = tick_view(s, d).select("token", "seq", F.sum("volume_delta").over(w).alias("volume"))
    return ticks.volume_delta(x).select("token", "seq", "delta")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, seq, max(seq) OVER (PARTITION BY token ORDER BY event_time, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, event_time FROM ticks)
SELECT token, seq, CASE WHEN top IS NOT NULL THEN greatest(0, seq - top - 1) END AS missing FROM x""")
def sequence_gaps(s, d):
    t = tick_view(s, d).withColumn("o", F.struct("event_time", "seq"))
    return ticks.sequence_gaps(t, "token", "seq", "o").select("token", "seq", "missing")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT *, coalesce(abs(event_time - lag(event_time) OVER w) > 20000, false) AS o FROM ticks WINDOW w AS (PARTITION BY token ORDER BY seq))
SELECT token, seq, o AND NOT coalesce(lag(o) OVER (PARTITION BY token ORDER BY seq), false) AS jump_begins FROM x""")
def time_jumps(s, d):
    return ticks.time_jumps(tick_view(s, d), "token", "event_time", "seq", 20_000).select("token", "seq", "jump_begins")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, event_time < lag(event_time) OVER (PARTITION BY token ORDER BY seq) AS b FROM ticks) SELECT token, count(*) AS rows, count(*) FILTER (b) AS backward FROM x GROUP BY token""")
def backward_steps(s, d):
    return ticks.backward_steps(tick_view(s, d), "token", "event_time", "seq")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, seq, strftime(epoch_ms(event_time + 19800000 + (seq % 7) * 7200000), '%Y%m%d') AS event_day FROM ticks),
y AS (SELECT *, max(event_day) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM x) SELECT token, seq, event_day, coalesce(event_day < m, false) AS late FROM y""")
def late_partitions(s, d):
    x = tick_view(s, d).select("token", "seq", tf.event_day(F.col("event_time") + (F.col("seq") % 7) * 7_200_000).alias("event_day"))
    return ticks.late_partitions(x, "event_day", "seq", "token")


# -- candles, snapshots, indicators -----------------------------------------------------------------


@query(f"""WITH {PARTS_SQL} SELECT token, tf, ws AS window_start, event_time, seq, first_value(price_paise) OVER w AS open_paise, max(price_paise) OVER w AS high_paise, min(price_paise) OVER w AS low_paise, price_paise AS close_paise,
  CAST(sum(volume_delta) OVER w AS BIGINT) AS volume, count(*) OVER w AS tick_count FROM parts WINDOW w AS (PARTITION BY token, tf, ws, part ORDER BY event_time ROWS UNBOUNDED PRECEDING)""")
def forming_candles(s, d):
    return candles.forming(tick_view(s, d))


@query(f"""WITH {PARTS_SQL} SELECT token, tf, ws AS window_start, arg_min(price_paise, event_time) AS open_paise, max(price_paise) AS high_paise, min(price_paise) AS low_paise, arg_max(price_paise, event_time) AS close_paise,
  CAST(sum(volume_delta) AS BIGINT) AS volume, count(*) AS tick_count FROM parts GROUP BY token, tf, ws""")
def merged_candles(s, d):
    x = candles.fan_out(candles.accepted_trades(tick_view(s, d))).withColumn("part", F.col("seq") % 3)
    partial = candles.bars(x, ["token", "tf", "window_start", "part"])
    first = x.groupBy("token", "tf", "window_start", "part").agg(F.min("event_time").alias("first_key"))
    return candles.merged(partial.join(first, ["token", "tf", "window_start", "part"]).withColumnRenamed("last_event_time", "last_key"))


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, seq, event_time, nullif(volume_delta % 5, 0) AS a, nullif(price_paise % 3, 0) AS b FROM ticks),
y AS (SELECT token, seq, event_time, last_value(a IGNORE NULLS) OVER w AS total, last_value(b IGNORE NULLS) OVER w AS bid FROM x WINDOW w AS (PARTITION BY token ORDER BY seq ROWS UNBOUNDED PRECEDING)),
z AS (SELECT *, CASE WHEN total IS DISTINCT FROM lag(total) OVER w AND total IS NOT NULL THEN event_time END AS tc, CASE WHEN bid IS DISTINCT FROM lag(bid) OVER w AND bid IS NOT NULL THEN event_time END AS bc FROM y WINDOW w AS (PARTITION BY token ORDER BY seq))
SELECT token, seq, event_time, total, bid, last_value(tc IGNORE NULLS) OVER w AS stats_changed_at, last_value(bc IGNORE NULLS) OVER w AS depth_changed_at FROM z WINDOW w AS (PARTITION BY token ORDER BY seq ROWS UNBOUNDED PRECEDING)""")
def market_snapshot(s, d):
    x = tick_view(s, d).select("token", "seq", "event_time", (F.col("volume_delta") % 5).alias("total"), (F.col("price_paise") % 3).alias("bid"))
    return candles.snapshot(x, ["total"], ["bid"])


@query(f"""WITH {CANDLES_SQL}, raw AS (SELECT token, tf, ws AS window_start, CAST(sum(volume_delta) AS BIGINT) AS volume, count(*) AS tick_count FROM parts GROUP BY token, tf, ws)
SELECT coalesce(c.token, r.token) AS token, coalesce(c.tf, r.tf) AS tf, coalesce(c.window_start, r.window_start) AS window_start, c.volume AS candle_volume, c.tick_count AS candle_ticks, r.volume AS raw_volume, r.tick_count AS raw_ticks,
  CASE WHEN c.token IS NULL THEN 'MISSING_CANDLE' WHEN r.token IS NULL THEN 'EXTRA_CANDLE' WHEN c.volume = r.volume AND c.tick_count = r.tick_count THEN 'MATCH' ELSE 'MISMATCH' END AS parity
FROM candles c FULL JOIN raw r ON c.token = r.token AND c.tf = r.tf AND c.window_start = r.window_start""")
def candle_parity(s, d):
    t = tick_view(s, d)
    return candles.parity(candles.candles(t), candles.bars(candles.fan_out(candles.accepted_trades(t)), ["token", "tf", "window_start"]))


@query(f"""WITH {CANDLES_SQL} SELECT token, tf, window_start, round(CASE WHEN count(*) OVER w = 20 THEN sum(close_paise) OVER w / 20 END, 6) AS sma,
  round(CASE WHEN count(*) OVER v = 19 THEN (sum(close_paise) OVER v + close_paise + 100) / 20 END, 6) AS preview FROM candles
  WINDOW w AS (PARTITION BY token, tf ORDER BY window_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), v AS (PARTITION BY token, tf ORDER BY window_start ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)""")
def sma20(s, d):
    x = indicators.sma_preview(indicators.sma(_candles(s, d)), F.col("close_paise") + 100, out="preview")
    return x.select("token", "tf", "window_start", F.round("sma", 6).alias("sma"), F.round("preview", 6).alias("preview"))


@query(f"""WITH RECURSIVE {CANDLES_SQL}, n AS MATERIALIZED (SELECT token, tf, window_start, close_paise, row_number() OVER w AS k, close_paise - lag(close_paise) OVER w AS ch FROM candles WINDOW w AS (PARTITION BY token, tf ORDER BY window_start)),
r AS (SELECT token, tf, window_start, k, 0.0::DOUBLE AS u, 0.0::DOUBLE AS v, NULL::DOUBLE AS pu, NULL::DOUBLE AS pv FROM n WHERE k = 1
  UNION ALL SELECT n.token, n.tf, n.window_start, n.k, CASE WHEN n.k <= 15 THEN r.u + greatest(n.ch, 0) / 14.0::DOUBLE ELSE (r.u * 13 + greatest(n.ch, 0)) / 14 END, CASE WHEN n.k <= 15 THEN r.v + greatest(-n.ch, 0) / 14.0::DOUBLE ELSE (r.v * 13 + greatest(-n.ch, 0)) / 14 END,
    CASE WHEN n.k < 15 THEN NULL WHEN n.k = 15 THEN r.u + greatest(n.ch + 100, 0) / 14.0::DOUBLE ELSE (r.u * 13 + greatest(n.ch + 100, 0)) / 14 END, CASE WHEN n.k < 15 THEN NULL WHEN n.k = 15 THEN r.v + greatest(-n.ch - 100, 0) / 14.0::DOUBLE ELSE (r.v * 13 + greatest(-n.ch - 100, 0)) / 14 END
  FROM r JOIN n ON n.token = r.token AND n.tf = r.tf AND n.k = r.k + 1)
SELECT token, tf, window_start, round(CASE WHEN k < 15 THEN NULL WHEN v = 0 THEN 100 ELSE 100 - 100 / (1 + u / v) END, 4) AS rsi, round(CASE WHEN pv = 0 THEN 100 ELSE 100 - 100 / (1 + pu / pv) END, 4) AS preview FROM r""")
def rsi14(s, d):
    c = _candles(s, d).select("token", "tf", "window_start", "close_paise")
    x = indicators.rsi(c, forming=F.col("close_paise") + 100)
    return x.select("token", "tf", "window_start", F.round("rsi", 4).alias("rsi"), F.round("rsi_preview", 4).alias("preview"))


@query(f"""WITH {CANDLES_SQL}, x AS (SELECT token, tf, window_start, list(close_paise) OVER (PARTITION BY token, tf ORDER BY window_start ROWS BETWEEN 14 PRECEDING AND CURRENT ROW) AS l FROM candles)
SELECT token, tf, window_start, array_to_string(list_reverse(l), ',') AS ring FROM x""")
def closed_ring(s, d):
    return indicators.ring(_candles(s, d)).select("token", "tf", "window_start", F.array_join(F.transform("ring", lambda x: x.cast("string")), ",").alias("ring"))


_SETUPS = f"""{CANDLES_SQL}, isl AS (SELECT *, CASE WHEN window_start - lag(window_start) OVER (PARTITION BY token, tf ORDER BY window_start) > window_end - window_start THEN 1 ELSE 0 END AS g, high_paise - low_paise AS range_paise FROM candles),
isl2 AS (SELECT *, sum(g) OVER (PARTITION BY token, tf ORDER BY window_start ROWS UNBOUNDED PRECEDING) AS island FROM isl),
setups AS (SELECT * FROM isl2 WINDOW w AS (PARTITION BY token, tf, island ORDER BY window_start ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER w = 6 AND range_paise < min(range_paise) OVER w)"""


@query(f"WITH {_SETUPS} SELECT token, tf, window_start, window_end, high_paise, low_paise, range_paise FROM setups")
def narrowest_range_setups(s, d):
    return indicators.narrowest(_candles(s, d)).select("token", "tf", "window_start", "window_end", "high_paise", "low_paise", "range_paise")


@query()
def breakout_signals(s, d):
    t = tick_view(s, d)
    return indicators.breakouts(candles.candles(t), candles.accepted_trades(t))


@query(f"""WITH {_SETUPS}, h AS (SELECT token, tf, window_start, md5('n7|' || token || '|' || tf || '|' || window_start || '|BUY') AS h FROM setups)
SELECT token, tf, window_start, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-3' || substr(h, 14, 3) || '-' || substr('89ab', ((instr('0123456789abcdef', substr(h, 17, 1)) - 1) % 4 + 1)::INT, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS candidate_id FROM h""")
def candidate_ids(s, d):
    name = F.concat_ws("|", F.lit("n7"), F.col("token").cast("string"), "tf", F.col("window_start").cast("string"), F.lit("BUY"))
    return indicators.narrowest(_candles(s, d)).select("token", "tf", "window_start", identity.name_uuid(name).alias("candidate_id"))


@query(f"""WITH {CANDLES_SQL}, x AS (SELECT token, tf, window_start, CASE WHEN count(*) OVER w = 20 THEN sum(close_paise) OVER w / 20 END AS sma, close_paise FROM candles WINDOW w AS (PARTITION BY token, tf ORDER BY window_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT token, tf, window_start, 0::INTEGER AS id, close_paise::DOUBLE AS value FROM x UNION ALL SELECT token, tf, window_start, 1, sma FROM x WHERE sma IS NOT NULL""")
def feature_maps(s, d):
    x = indicators.sma(_candles(s, d)).withColumn("features", indicators.feature_map({0: F.col("close_paise"), 1: F.col("sma")}))
    return x.select("token", "tf", "window_start", F.explode("features").alias("id", "value"))


@query(f"WITH {CANDLES_SQL} SELECT c.token, c.tf, c.window_start, p.close_paise AS context FROM candles c LEFT JOIN candles p ON p.token = c.token AND p.tf = c.tf AND p.window_start = c.window_start - 2 * (c.window_end - c.window_start)")
def candle_context(s, d):
    return joins.context(_candles(s, d), 2).select("token", "tf", "window_start", "context")


@query(f"""WITH {CANDLES_SQL}, k AS (SELECT token, tf, max(window_start) AS newest, min(window_end - window_start) AS ms FROM candles GROUP BY token, tf), w AS (SELECT k.token, k.tf, newest, i, c.close_paise FROM k CROSS JOIN range(8) r(i) LEFT JOIN candles c ON c.token = k.token AND c.tf = k.tf AND c.window_start = newest - i * ms)
SELECT token, tf, newest, string_agg(coalesce(close_paise::VARCHAR, '-'), ',' ORDER BY i) AS slice FROM w GROUP BY token, tf, newest""")
def candle_slices(s, d):
    c = _candles(s, d)
    k = c.groupBy("token", "tf").agg(F.max("window_start").alias("newest"), F.min(F.col("window_end") - F.col("window_start")).alias("tf_ms"))
    return joins.slices(k, c, 8).select("token", "tf", "newest", F.array_join(F.transform("slice", lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",").alias("slice"))


# -- book -------------------------------------------------------------------------------------------

_BOOK = f"""{TICKS_SQL}, book AS (SELECT seq, token, list_transform(range(5), lambda k: price_paise - 5 - 5 * k) AS bp, list_transform(range(5), lambda k: price_paise + 5 + 5 * k) AS ap,
  list_transform(range(5), lambda k: greatest(0, (seq * 13 + k * 37) % 101 - 10)) AS bq, list_transform(range(5), lambda k: greatest(0, (seq * 29 + k * 37) % 101 - 10)) AS aq FROM ticks)"""


@query(f"""WITH {_BOOK}, x AS (SELECT *, list_sum(bq)::BIGINT AS b, list_sum(aq)::BIGINT AS a FROM book) SELECT seq, CASE WHEN bp[1] <= 0 OR ap[1] <= 0 THEN 0 ELSE ap[1] - bp[1] END AS spread, b AS bid_total, a AS ask_total,
  round(CASE WHEN a + b <> 0 THEN (b - a) / (a + b) END, 9) AS imbalance, CASE WHEN bp[1] > 0 AND ap[1] > 0 AND bq[1] > 0 AND aq[1] > 0 THEN (bp[1] * aq[1] + ap[1] * bq[1] + (bq[1] + aq[1]) // 2) // (bq[1] + aq[1]) ELSE 0 END AS microprice FROM x""")
def book_scalars(s, d):
    b, a, p, q = (F.col(c) for c in ("bid_px", "ask_px", "bid_qty", "ask_qty"))
    return ladders(s, d).select("seq", book.spread(b, a).alias("spread"), book.total(p).alias("bid_total"), book.total(q).alias("ask_total"), F.round(book.imbalance(p, q), 9).alias("imbalance"), book.microprice(b, a, p, q).alias("microprice"))


@query(f"""WITH {_BOOK}, l AS (SELECT seq, 1 + seq % 150 AS want, unnest(ap) AS p, unnest(aq) AS q, unnest(range(5)) AS k, ap[1] AS best FROM book), g AS (SELECT *, CASE WHEN p > 0 THEN q ELSE 0 END AS e FROM l),
m AS (SELECT *, greatest(0, least(e, want - coalesce(sum(e) OVER (PARTITION BY seq ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS take FROM g),
n AS (SELECT seq, want, best, sum(take) AS got, sum(take * p) AS cost FROM m GROUP BY ALL) SELECT seq, CAST(CASE WHEN got = want THEN (cost + want // 2) // want END AS BIGINT) AS mean_paise, CAST(CASE WHEN got = want THEN (cost + want // 2) // want - best END AS BIGINT) AS slippage FROM n""")
def book_walk(s, d):
    x = ladders(s, d).withColumn("mean_paise", book.walk(F.col("ask_px"), F.col("ask_qty"), 1 + F.col("seq") % 150))
    return x.select("seq", "mean_paise", book.slippage(F.get("ask_px", F.lit(0)), F.col("mean_paise"), F.lit(True)).alias("slippage"))


# -- identities -------------------------------------------------------------------------------------


@query("""SELECT event_id, sha256(unhex(lpad(to_hex(event_id), 16, '0')) || '|'::BLOB || unhex(lpad(to_hex(user_id), 16, '0')) || '|'::BLOB || event_type::BLOB) AS fingerprint FROM events""")
def event_fingerprints(s, d):
    return read(s, d, "events").select("event_id", identity.event_fingerprint(identity.big_endian(F.col("event_id")), identity.big_endian(F.col("user_id")), F.encode("event_type", "utf-8")).alias("fingerprint"))


_IDS = "len('v1') || ':v1|' || len(o_orderkey::VARCHAR) || ':' || o_orderkey || '|' || len(o_orderstatus) || ':' || o_orderstatus || '|4:null'"


@query(f"SELECT o_orderkey, 'ei-v1-' || sha256({_IDS}) AS instruction_id, 'trade-v1-' || sha256({_IDS}) AS trade_context_id, sha256({_IDS}) AS request_hash FROM orders")
def intent_ids(s, d):
    f = (F.lit("v1"), F.col("o_orderkey"), F.col("o_orderstatus"), F.lit(None))
    return read(s, d, "orders").select("o_orderkey", identity.instruction_id(*f).alias("instruction_id"), identity.trade_context_id(*f).alias("trade_context_id"), identity.content_hash(*f).alias("request_hash"))


@query()
def source_versions(s, d):
    return tick_view(s, d).select("seq", identity.source_version(F.col("event_time"), F.concat(F.lit("evt-"), F.col("seq").cast("string"))).alias("source_version"))


@query("SELECT p_brand, sha256(string_agg(k::VARCHAR, ',' ORDER BY k)) AS set_hash FROM (SELECT DISTINCT p_brand, p_partkey AS k FROM part) GROUP BY p_brand")
def token_set_hash(s, d):
    return read(s, d, "part").groupBy("p_brand").agg(identity.set_hash(F.collect_set("p_partkey")).alias("set_hash"))


# -- vocabulary -------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'FILLED' WHEN 'O' THEN 'PENDING' ELSE 'UNKNOWN' END AS state FROM orders""")
def lifecycle_synonyms(s, d):
    word = F.when(F.col("o_orderstatus") == "F", " complete ").when(F.col("o_orderstatus") == "O", "NewAck").otherwise("p?")
    return read(s, d, "orders").select("o_orderkey", text.lifecycle_state(word).alias("state"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'signup' THEN 'canceled' WHEN 'purchase' THEN 'fill' WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 'fill' ELSE 'unknown' END ELSE 'ack' END AS event,
  CASE WHEN event_type = 'error' THEN 'rejected' WHEN event_type = 'click' AND event_id % 2 = 1 THEN 'unknown' ELSE 'success' END AS outcome FROM events""")
def postback_normal(s, d):
    e = F.col("event_type")
    status = F.when(e == "error", "REJECTED").when(e == "signup", " canceled").when(e == "click", "complete").when(e == "view", "open")
    x = read(s, d, "events").select("event_id", text.postback_event(status, F.when(e == "purchase", "Fill"), (F.col("event_id") + 1) % 2).alias("event"))
    return x.select("event_id", "event", text.outcome(F.col("event")).alias("outcome"))


@query("""SELECT event_id, CASE event_type WHEN 'error' THEN 'FATAL' WHEN 'view' THEN 'RETRYABLE' WHEN 'click' THEN 'REJECTED' ELSE 'UNKNOWN' END AS retry_class, CASE event_type WHEN 'error' THEN 'rejected' WHEN 'view' THEN 'unknown' WHEN 'click' THEN 'success' ELSE 'unknown' END AS response_class,
  'user ' || user_id || ' token=***' AS redacted FROM events""")
def classifications(s, d):
    e = F.col("event_type")
    message = F.when(e == "error", "Authorization failed after timeout").when(e == "view", "read timed out").when(e == "click", "record too large").otherwise("odd")
    status, body = F.when(e == "error", 400).when(e == "view", 429).otherwise(200), F.when(e == "click", "success").otherwise("")
    secret = F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" token=s3cret"), F.col("event_id").cast("string"))
    return read(s, d, "events").select("event_id", text.retry_class(message).alias("retry_class"), text.response_class(status, body).alias("response_class"), text.redact(secret).alias("redacted"))


# -- joins ------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_brand, CASE WHEN p_brand IS NULL THEN 'MISSING_INSTRUMENT' END AS reason FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_partkey % 10 <> 3) ON p_partkey = l_partkey")
def instrument_enrichment(s, d):
    dim = read(s, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return joins.enriched(read(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), dim, "l_partkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def orphan_rows(s, d):
    return joins.orphans(read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("SELECT name, CASE WHEN count(*) FILTER (a) = 0 THEN 'extra' ELSE 'missing' END AS side FROM (SELECT n_name AS name, true AS a FROM nation WHERE n_nationkey % 5 <> 0 UNION ALL SELECT n_name, false FROM nation WHERE n_nationkey % 7 <> 0) GROUP BY name HAVING count(*) = 1")
def catalog_drift(s, d):
    n = read(s, d, "nation").select(F.col("n_name").alias("name"), "n_nationkey")
    return joins.drift(n.where("n_nationkey % 7 <> 0").select("name"), n.where("n_nationkey % 5 <> 0").select("name"))


@query(f"""WITH {TICKS_SQL}, g AS (SELECT DISTINCT token, (event_time // 60000) * 60000 AS at FROM ticks), v AS (SELECT token, event_time AS at, arg_max(price_paise, seq) AS price FROM ticks WHERE seq % 5 = 0 GROUP BY 1, 2)
SELECT g.token, g.at, CASE WHEN g.at - v.at <= 120000 THEN v.price END AS price FROM g ASOF LEFT JOIN v ON g.token = v.token AND g.at >= v.at""")
def forward_fill(s, d):
    t = tick_view(s, d)
    grid = t.select("token", (book.div(F.col("event_time"), 60_000) * 60_000).alias("at")).distinct()
    v = t.where("seq % 5 = 0").groupBy("token", F.col("event_time").alias("at")).agg(F.max_by("price_paise", "seq").alias("price"))
    return joins.as_of(grid, v, "token", "at", "price", 120_000)


@query(f"""WITH {TICKS_SQL}, g AS (SELECT DISTINCT token, (event_time // 60000) * 60000 AS t FROM ticks), v AS (SELECT token, event_time AS t, arg_max(price_paise, seq) AS price FROM ticks WHERE seq % 5 = 0 GROUP BY 1, 2),
a AS (SELECT g.token, g.t, v.t AS t0, v.price AS p0 FROM g ASOF LEFT JOIN v ON g.token = v.token AND g.t >= v.t), b AS (SELECT a.*, v.t AS t1, v.price AS p1 FROM a ASOF LEFT JOIN v ON a.token = v.token AND a.t <= v.t)
SELECT token, t AS at, round(CASE WHEN t0 = t THEN p0 WHEN t1 > t0 THEN p0 + (p1 - p0) * (t - t0)::DOUBLE / (t1 - t0) END, 6) AS price FROM b""")
def interpolation(s, d):
    t = tick_view(s, d)
    grid = t.select("token", (book.div(F.col("event_time"), 60_000) * 60_000).alias("at")).distinct()
    v = t.where("seq % 5 = 0").groupBy("token", F.col("event_time").alias("at")).agg(F.max_by("price_paise", "seq").alias("price"))
    return joins.interpolated(grid, v, "token", "at", "price").withColumn("price", F.round("price", 6))


_ATTEMPTS = """att AS (SELECT o_orderkey AS i, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey - (o_orderkey % 50 = 0)::BIGINT END AS b, 2 * o_orderkey - 2 * (o_orderkey % 70 = 0)::BIGINT AS c, 3 * o_orderkey AS a FROM orders),
  rec AS (SELECT i % 4 AS acc, i AS b, i FROM att WHERE i % 5 = 0),
  rep AS (SELECT l_orderkey * 10 + l_linenumber AS id, (l_orderkey + (l_linenumber = 7)::BIGINT) % 4 AS acc, CASE WHEN l_linenumber NOT IN (3, 4) THEN l_orderkey END AS b,
    CASE l_linenumber WHEN 1 THEN 2 * l_orderkey WHEN 3 THEN 2 * l_orderkey WHEN 5 THEN 2 * l_orderkey + 2 END AS c, CASE WHEN l_linenumber = 6 THEN 3 * l_orderkey + 3 ELSE 3 * l_orderkey + (l_linenumber = 4)::BIGINT END AS a FROM lineitem),
  ab AS (SELECT b, min(i) AS i, min(i) <> max(i) AS m FROM att WHERE b IS NOT NULL GROUP BY b), ac AS (SELECT c, min(i) AS i, min(i) <> max(i) AS m FROM att GROUP BY c),
  ar AS (SELECT acc, b, min(i) AS i, min(i) <> max(i) AS m FROM rec GROUP BY acc, b), aa AS (SELECT a, min(i) AS i, min(i) <> max(i) AS m FROM att GROUP BY a)"""


def _attempts(s, d):
    k = F.col("o_orderkey")
    same = lambda n: (k % n == 0).cast("long")
    return read(s, d, "orders").select(k.alias("instruction_id"), F.when(k % 3 != 0, k - same(50)).alias("broker_order_id"), (2 * k - 2 * same(70)).alias("client_ref"), (3 * k).alias("attempt_id"))


def _reports(s, d):
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    is_ = lambda m: (n == m).cast("long")
    return read(s, d, "lineitem").select(
        (k * 10 + n).alias("report_id"), ((k + is_(7)) % 4).alias("account"), F.when(~n.isin(3, 4), k).alias("broker_order_id"),
        F.when(n.isin(1, 3), 2 * k).when(n == 5, 2 * k + 2).alias("client_ref"), F.when(n == 6, 3 * k + 3).otherwise(3 * k + is_(4)).alias("attempt_id"),
    )


@query(f"""WITH {_ATTEMPTS}, x AS (SELECT rep.id, rep.b, rep.c, CASE WHEN rep.b IS NOT NULL THEN coalesce(ab.i, ar.i) ELSE ac.i END AS i, CASE WHEN rep.b IS NULL THEN ac.m WHEN ab.i IS NOT NULL THEN ab.m ELSE ar.m END AS m,
  rep.b IS NOT NULL AND ac.i IS NOT NULL AND (ac.m OR ac.i <> coalesce(ab.i, ar.i)) AS o FROM rep LEFT JOIN ab ON ab.b = rep.b LEFT JOIN ac ON ac.c = rep.c LEFT JOIN ar ON ar.acc = rep.acc AND ar.b = rep.b),
y AS (SELECT id, i, CASE WHEN b IS NULL AND c IS NULL THEN 'MISSING_BROKER_ID' WHEN i IS NULL THEN 'NO_MATCHING_INSTRUCTION' WHEN m OR o THEN 'AMBIGUOUS_CORRELATION' ELSE 'CORRELATED' END AS w FROM x)
SELECT id AS report_id, CASE WHEN w = 'CORRELATED' THEN i END AS instruction_id, w AS correlation FROM y""")
def correlation(s, d):
    k = F.col("instruction_id")
    approved = _attempts(s, d).where(k % 5 == 0).select((k % 4).alias("account"), k.alias("broker_order_id"), "instruction_id")
    return joins.correlated(_reports(s, d).drop("attempt_id"), _attempts(s, d).drop("attempt_id"), approved)


@query(f"""WITH {_ATTEMPTS}, x AS (SELECT rep.id, aa.i AS ai, ab.i AS bi, ac.i AS ci, coalesce(aa.m, false) OR coalesce(ab.m, false) OR coalesce(ac.m, false) AS m FROM rep
  LEFT JOIN aa ON aa.a = rep.a LEFT JOIN ab ON ab.b = rep.b LEFT JOIN ac ON ac.c = rep.c),
y AS (SELECT id, least(ai, bi, ci) AS i, CASE WHEN coalesce(ai, bi, ci) IS NULL THEN 'MISSING' WHEN m OR least(ai, bi, ci) <> greatest(ai, bi, ci) THEN 'AMBIGUOUS' ELSE 'CORRELATED' END AS w FROM x)
SELECT id AS report_id, CASE WHEN w = 'CORRELATED' THEN i END AS instruction_id, w AS resolution FROM y""")
def three_key_resolution(s, d):
    return joins.resolved(_reports(s, d).drop("account"), _attempts(s, d))


@query("SELECT p_partkey AS token, row_number() OVER (ORDER BY p_partkey) - 1 AS place, 'slot-' || ((row_number() OVER (ORDER BY p_partkey) - 1) // 100) AS slot FROM part WHERE p_partkey > 0")
def slot_assignment(s, d):
    return joins.slots(read(s, d, "part").select(F.col("p_partkey").alias("token")), 100)


@query("""WITH sl AS (SELECT p_partkey AS token, 'slot-' || ((row_number() OVER (ORDER BY p_partkey) - 1) // 20) AS slot FROM part WHERE p_partkey > 0 AND p_partkey % 10 <> 3),
st AS (SELECT 'slot-' || i AS slot, CASE WHEN i % 3 = 1 THEN 'UNSAFE' ELSE 'RECOVERED' END AS status, (i % 11)::BIGINT AS e FROM range(200) r(i) WHERE i % 3 <> 0),
x AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_partkey AS token, CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS published, (l_orderkey % 12)::BIGINT AS epoch FROM lineitem)
SELECT id, x.token, CASE WHEN sl.slot IS NULL OR st.slot IS NULL THEN 'ALLOW' WHEN status = 'UNSAFE' OR epoch < e THEN CASE WHEN published IS NULL THEN 'SUPPRESS_NEW' WHEN published THEN 'ALLOW' ELSE 'DISCARD_INFLIGHT' END ELSE 'ALLOW' END AS verdict
FROM x LEFT JOIN sl ON sl.token = x.token LEFT JOIN st ON st.slot = sl.slot""")
def suppression(s, d):
    slot_of = joins.slots(read(s, d, "part").where("p_partkey % 10 <> 3").select(F.col("p_partkey").alias("token")), 20)
    i, n = F.col("id"), F.col("l_linenumber") % 3
    state = s.range(200).where("id % 3 <> 0").select(F.concat(F.lit("slot-"), i.cast("string")).alias("slot"), F.when(i % 3 == 1, "UNSAFE").otherwise("RECOVERED").alias("status"), (i % 11).alias("epoch"))
    x = read(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_partkey").alias("token"), F.when(n == 1, True).when(n == 2, False).alias("published"), (F.col("l_orderkey") % 12).alias("epoch"))
    return joins.suppression(x, slot_of, state).select("id", "token", "verdict")


@query("SELECT o_orderkey AS instruction_id, CASE WHEN o_orderkey % 3 = 0 THEN 'FIRST' WHEN o_orderkey % 2 = 0 THEN 'DUPLICATE' ELSE 'HASH_VIOLATION' END AS verdict FROM orders")
def intent_dedup(s, d):
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("instruction_id"), F.lit("a").alias("request_hash"))
    known = o.where("instruction_id % 3 <> 0").withColumn("request_hash", F.when(F.col("instruction_id") % 2 == 0, "a").otherwise("b"))
    return joins.dedup_verdict(o, known).select("instruction_id", "verdict")


@query(f"WITH {TICKS_SQL} SELECT token, seq, version, price_paise FROM (SELECT *, volume_delta % 10 AS version FROM ticks) QUALIFY row_number() OVER (PARTITION BY token ORDER BY version DESC, seq DESC) = 1")
def versioned_current(s, d):
    x = tick_view(s, d).select("token", "seq", (F.col("volume_delta") % 10).alias("version"), "price_paise")
    return joins.current(x, ["token"], "version", "seq")


@query(f"""WITH {TICKS_SQL}, x AS (SELECT token, seq, volume_delta - 3 AS version, price_paise % 2 = 0 AS same FROM ticks), y AS (SELECT *, max(CASE WHEN version >= 0 THEN version END) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM x)
SELECT token, seq, CASE WHEN version < 0 THEN 'UNKNOWN' WHEN top IS NULL OR version > top THEN 'APPLIED' WHEN version < top AND same THEN 'STALE' WHEN version < top THEN 'REGRESSION' WHEN same THEN 'DUPLICATE' ELSE 'CONFLICT' END AS outcome FROM y""")
def version_outcomes(s, d):
    x = tick_view(s, d).withColumn("version", F.col("volume_delta") - 3)
    return joins.version_outcome(x, "token", "version", "seq", F.col("price_paise") % 2 == 0).select("token", "seq", "outcome")


@query("SELECT o_orderkey, CASE WHEN row_number() OVER w = 1 THEN 'ACCEPTED' WHEN o_orderstatus IS NOT DISTINCT FROM first_value(o_orderstatus) OVER w THEN 'DUPLICATE' ELSE 'VIOLATION' END AS outcome FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)")
def immutability(s, d):
    return joins.immutability(read(s, d, "orders"), "o_custkey", "o_orderstatus", "o_orderkey").select("o_orderkey", "outcome")


# -- folds ------------------------------------------------------------------------------------------


@query()
def positions(s, d):
    return folds.positions(fills(s, d))


@query()
def order_lifecycles(s, d):
    x = read(s, d, "lineitem")
    status = F.when(F.col("l_returnflag") == "A", "FILLED").when(F.col("l_returnflag") == "R", "PARTIAL").otherwise("PENDING")
    v = F.datediff("l_shipdate", F.lit("1970-01-01")).cast("long")
    n, qty = F.col("l_linenumber").cast("long"), F.col("l_quantity").cast("long")
    return folds.lifecycles(x.select(
        (F.col("l_orderkey") % 7).alias("account"), F.col("l_orderkey").alias("order_id"), (v * 10 + n).alias("arrival"), v.alias("version"), (v * 10 + n % 2).alias("event_id"), status.alias("status"),
        (n * 50).alias("cumulative_qty"), (qty % 40).alias("pending_qty"), qty.alias("fill_qty"), F.round(F.col("l_extendedprice")).cast("long").alias("price_paise"),
    ))


@query()
def gate_machine(s, d):
    target = F.element_at(F.array(*[F.lit(x) for x in ("RECONCILING", "APPROVAL_PENDING", "ENABLED", "HALTED")]), (F.col("event_id") % 4 + 1).cast("int"))
    return folds.machine(read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), target.alias("target")), folds.GATE, "HALTED")


@query()
def fence_leases(s, d):
    e = F.col("event_type")
    action = F.when(e == "error", "revoke").when(e == "view", "renew").when(e == "signup", "halt").otherwise("acquire")
    holder = F.concat(F.lit("h"), (F.col("seq") % 3).cast("string"))
    return folds.leases(tick_view(s, d).select(F.col("token").alias("key"), "seq", action.alias("action"), holder.alias("holder"), (F.col("seq") - F.col("seq") % 9).alias("token"), F.col("event_time").alias("at"), long(20_000).alias("ttl")))


@query()
def safety_states(s, d):
    status = F.when(F.col("tick_type") == "QUOTE", "UNSAFE").otherwise("RECOVERED")
    return folds.safety(tick_view(s, d).select(F.col("token").alias("key"), "seq", (book.div(F.col("seq"), 50) - F.col("seq") % 3).alias("epoch"), status.alias("status")))


# -- audits and metrics -----------------------------------------------------------------------------


@query(f"""WITH {TICKS_SQL} SELECT strftime(epoch_ms(event_time + 19800000), '%Y%m%d') AS day, count(*) AS n, sha256(string_agg(seq || '|' || price_paise, chr(10) ORDER BY seq)) AS hash FROM ticks GROUP BY 1""")
def manifests(s, d):
    x = tick_view(s, d).withColumn("day", tf.event_day(F.col("event_time")))
    return audit.manifest_hashes(x, "day", "seq", F.concat_ws("|", F.col("seq").cast("string"), F.col("price_paise").cast("string")))


@query(f"""WITH RECURSIVE {TICKS_SQL}, m AS MATERIALIZED (SELECT strftime(epoch_ms(event_time + 19800000), '%Y%m%d') AS day, sha256(string_agg(seq || '|' || price_paise, chr(10) ORDER BY seq)) AS hash, row_number() OVER (ORDER BY 1) AS k FROM ticks GROUP BY 1),
n AS MATERIALIZED (SELECT hash, row_number() OVER (ORDER BY day) AS k FROM m), c AS (SELECT 0::BIGINT AS k, 'genesis' AS link UNION ALL SELECT n.k, sha256(n.hash || '|' || c.link) FROM c JOIN n ON n.k = c.k + 1) SELECT max(k) AS links, arg_max(link, k) AS root FROM c""".replace(", row_number() OVER (ORDER BY 1) AS k FROM ticks", " FROM ticks"))
def hash_chain(s, d):
    return audit.chain(manifests(s, d))


@query("""WITH a AS (SELECT o_orderkey AS event_id, o_orderkey AS seq FROM orders WHERE o_orderkey % 7 <> 0) SELECT o_orderkey AS event_id, CASE WHEN o_orderkey % 7 = 0 THEN 'UNEXPECTED' WHEN o_orderkey % 11 = 0 THEN 'MISSING' WHEN o_orderkey % 13 = 0 THEN 'DUPLICATE' WHEN o_orderkey % 17 = 0 THEN 'TAMPERED' WHEN o_orderkey % 19 = 0 THEN 'REORDERED' END AS finding
FROM orders WHERE (o_orderkey % 7 = 0 AND o_orderkey % 11 <> 0) OR (o_orderkey % 7 <> 0 AND (o_orderkey % 11 = 0 OR o_orderkey % 13 = 0 OR o_orderkey % 17 = 0 OR o_orderkey % 19 = 0))""")
def log_comparison(s, d):
    k = F.col("event_id")
    o = read(s, d, "orders").select(F.col("o_orderkey").alias("event_id"), F.lit("h").alias("hash"), F.col("o_orderkey").alias("seq"))
    b = o.where(k % 11 != 0).select("event_id", F.when(k % 17 == 0, "x").otherwise("h").alias("hash"), F.when(k % 19 == 0, k + 1).otherwise(k).alias("seq"))
    return audit.compare_logs(o.where(k % 7 != 0), b.unionByName(b.where("event_id % 13 = 0")))


@query("SELECT count(DISTINCT o_custkey) AS keys, 0::BIGINT AS diverged, (SELECT count(*) FROM orders WHERE o_orderkey >= 500) AS replayed FROM orders")
def replay_convergence(s, d):
    o = read(s, d, "orders").select("o_custkey", F.col("o_orderkey").alias("offset"), (F.col("o_orderkey") % 9).alias("version"), "o_orderstatus")
    return audit.converges(o, ["o_custkey"], 500)


@query("""SELECT day, state, state = 'VERIFIED' AND day < (SELECT coalesce(min(day) FILTER (state <> 'VERIFIED'), '99999999') FROM x) AS expires FROM x""".join(["WITH x AS (SELECT strftime(o_orderdate, '%Y%m%d') AS day, CASE WHEN count(*) >= 2 OR strftime(o_orderdate, '%Y%m%d') < '19960101' THEN 'VERIFIED' ELSE 'WRITING' END AS state FROM orders GROUP BY o_orderdate) ", ""]))
def offload_plan(s, d):
    x = read(s, d, "orders").groupBy(F.date_format("o_orderdate", "yyyyMMdd").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return audit.offload_plan(x.select("day", F.when((F.col("n") >= 2) | (F.col("day") < "19960101"), "VERIFIED").otherwise("WRITING").alias("state")))


_COUNTER = f"""{TICKS_SQL}, c AS (SELECT token, seq, sum(volume_delta) OVER (PARTITION BY token, seq // 700 ORDER BY seq ROWS UNBOUNDED PRECEDING)::BIGINT AS v, event_time FROM ticks)"""


def _counter(s, d):
    w = Window.partitionBy("token", book.div(F.col("seq"), 700)).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return tick_view(s, d).select("token", "seq", F.sum("volume_delta").over(w).alias("v"), "event_time")


@query(f"""WITH {_COUNTER}, x AS (SELECT *, lag(v) OVER (PARTITION BY token ORDER BY seq) AS was FROM c) SELECT token, CAST(coalesce(sum(was) FILTER (v < was), 0) + arg_max(v, seq) - arg_min(v, seq) AS BIGINT) AS delta, count(*) FILTER (v < was) AS resets FROM x GROUP BY token""")
def counter_delta(s, d):
    return metrics.counter_delta(_counter(s, d), ["token"], "seq", "v")


@query(f"""WITH {_COUNTER}, x AS (SELECT *, lag(v) OVER (PARTITION BY token ORDER BY seq) AS was FROM c) SELECT token, CAST(coalesce(sum(CASE WHEN v >= was THEN v - was WHEN v < was THEN v END), 0) AS BIGINT) AS delta, count(*) FILTER (v > was) AS increases, count(*) FILTER (v < was) AS resets FROM x GROUP BY token""")
def pair_progress(s, d):
    return metrics.pair_progress(_counter(s, d), ["token"], "seq", "v")


@query(f"""WITH {_COUNTER}, x AS (SELECT *, event_time - lag(event_time) OVER w AS dt, v - lag(v) OVER w AS dv FROM c WINDOW w AS (PARTITION BY token ORDER BY seq)) SELECT token, seq, round(dv * 1000 / dt, 6) AS rate FROM x WHERE dt > 0""")
def interval_rates(s, d):
    return metrics.rates(_counter(s, d), ["token"], "event_time", "v", order="seq").select("token", "seq", F.round("rate", 6).alias("rate"))


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) FILTER (k = round_even(50 * (n - 1) / 100, 0)) AS p50, min(value) FILTER (k = round_even(95 * (n - 1) / 100, 0)) AS p95, min(value) FILTER (k = round_even(99 * (n - 1) / 100, 0)) AS p99 FROM x GROUP BY event_type""")
def nearest_rank_percentiles(s, d):
    return metrics.nearest_rank(read(s, d, "events"), ["event_type"], "value", [50, 95, 99])


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(n) AS n, min(value) FILTER (k = least(n * 50 // 100, n - 1)) AS p50, min(value) FILTER (k = least(n * 99 // 100, n - 1)) AS p99 FROM x GROUP BY event_type""")
def floor_percentiles(s, d):
    return metrics.nearest_rank(read(s, d, "events"), ["event_type"], "value", [50, 99], half_even=False)


@query(f"WITH {TICKS_SQL}, x AS (SELECT event_time // 60000 AS w, max(price_paise) AS m FROM ticks GROUP BY 1) SELECT count(*) AS windows, count(*) FILTER (m > 20000) AS over, median(m) AS median_max, max(m) AS max FROM x")
def kpi_windows(s, d):
    return metrics.kpi_windows(tick_view(s, d), "event_time", "price_paise", 60_000, 20_000)


@query("""WITH x AS (SELECT event_type AS stage, median(value) AS median, max(value) AS max FROM events GROUP BY 1), y AS (SELECT *, CASE stage WHEN 'view' THEN 0::BIGINT WHEN 'click' THEN 1 WHEN 'signup' THEN 2 ELSE 3 END AS place FROM x WHERE stage <> 'error')
SELECT stage, median, max, place, round(median - coalesce(lag(median) OVER (ORDER BY place), 0), 6) AS adds FROM y""")
def hop_budget(s, d):
    return metrics.hop_budget(read(s, d, "events"), ["view", "click", "signup", "purchase"], "event_type", "value").withColumn("adds", F.round("adds", 6))


@query(f"""WITH {TICKS_SQL}, x AS (SELECT *, CASE WHEN price_paise >= 3000 THEN 1 ELSE 0 END AS o FROM ticks), y AS (SELECT *, sum(1 - o) OVER (PARTITION BY token ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT token, min(seq) AS begins, max(seq) AS ends, count(*) AS samples, max(price_paise) AS peak FROM y WHERE o = 1 GROUP BY token, g HAVING max(seq) - min(seq) >= 40""")
def alert_breaches(s, d):
    return metrics.breaches(tick_view(s, d), "token", "seq", "price_paise", 3000, 40)


@query("SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_custkey) AS distinct_n, count(o_custkey) - count(DISTINCT o_custkey) AS duplicates FROM orders GROUP BY 1")
def rule_census(s, d):
    return metrics.census(read(s, d, "orders"), ["o_orderstatus"], "o_custkey")


@query("SELECT event_type, min(value) AS min, max(value) AS max, round(avg(value), 2) AS avg, round(sum(value), 2) AS total, count(*) AS n FROM events GROUP BY 1")
def metric_summary(s, d):
    return metrics.summary(read(s, d, "events"), ["event_type"], "value")


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100) AS BIGINT)) // count(*) AS BIGINT) AS avg_paise, max(value) AS max_value FROM events WHERE event_type LIKE '%i%' GROUP BY 1, 2")
def dashboard_histogram(s, d):
    x = read(s, d, "events").where(F.col("event_type").like("%i%"))
    return x.groupBy(F.date_trunc("day", F.col("ts")).cast("timestamp_ntz").alias("day"), "event_type").agg(F.count(F.lit(1)).alias("n"), book.div(F.sum(F.round(F.col("value") * 100).cast("long")), F.count(F.lit(1))).alias("avg_paise"), F.max("value").alias("max_value"))


@query(f"WITH {TICKS_SQL} SELECT seq, token, price_paise FROM ticks ORDER BY price_paise DESC, seq DESC LIMIT 50")
def newest_k(s, d):
    return tick_view(s, d).select("seq", "token", "price_paise").orderBy(F.desc("price_paise"), F.desc("seq")).limit(50)


@query(f"WITH {TICKS_SQL} SELECT token, event_type, seq FROM ticks QUALIFY row_number() OVER (PARTITION BY token, event_type ORDER BY seq DESC) <= 16")
def newest_ledger(s, d):
    return indicators.newest(tick_view(s, d).select("token", "event_type", "seq"), ["token", "event_type"], ["seq"], 16)


@query("SELECT o_orderkey, CASE WHEN b > 0 AND e >= b AND e - b <= 86400000 THEN e - b END AS ms FROM (SELECT o_orderkey, (o_orderkey % 5) * 1000 AS b, o_orderkey * 60000 AS e FROM orders)")
def guarded_latency(s, d):
    x = read(s, d, "orders").select("o_orderkey", ((F.col("o_orderkey") % 5) * 1000).alias("b"), (F.col("o_orderkey") * 60_000).alias("e"))
    return x.select("o_orderkey", metrics.latency(F.col("b"), F.col("e")).alias("ms"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'MISSING_EVIDENCE' WHEN o_orderkey % 3 = 0 THEN 'SINGLE_AUTHORIZER' WHEN o_orderkey % 5 = 0 THEN 'UNAUTHORIZED' WHEN o_orderkey % 7 = 0 THEN 'POLICY' WHEN o_orderkey % 11 = 0 THEN 'LEGAL_HOLD' ELSE 'APPROVED' END AS decision FROM orders""")
def deletion_decisions(s, d):
    k = F.col("o_orderkey")
    return read(s, d, "orders").select("o_orderkey", audit.deletion_decision(k % 2 != 0, F.when(k % 3 == 0, 1).otherwise(2), k % 5 != 0, k % 7 != 0, k % 11 == 0).alias("decision"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 1500 WHEN 1 THEN 90000 WHEN 2 THEN NULL ELSE 172800000 END::BIGINT AS ttl FROM orders""")
def ttl_parse(s, d):
    k = F.col("o_orderkey") % 4
    return read(s, d, "orders").select("o_orderkey", tf.ttl_ms(F.when(k == 0, "1500ms").when(k == 1, "90s").when(k == 2, "9 weeks").otherwise("2d")).alias("ttl"))


@query("""SELECT a, b, (a || '>' || b) IN ('FLAT>OPEN', 'OPEN>REDUCING', 'OPEN>CLOSED', 'REDUCING>OPEN', 'REDUCING>CLOSED', 'CLOSED>OPEN') AS allowed FROM (SELECT unnest(['FLAT', 'OPEN', 'REDUCING', 'CLOSED']) AS a) CROSS JOIN (SELECT unnest(['FLAT', 'OPEN', 'REDUCING', 'CLOSED']) AS b)""")
def transition_table(s, d):
    states = list(folds.POSITION)
    x = s.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    return x.select("a", "b", folds.allowed(folds.POSITION, F.col("a"), F.col("b")).alias("allowed"))
