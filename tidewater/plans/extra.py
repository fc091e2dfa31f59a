"""Further registered queries: intents, diagnostics, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import text
from tidewater.functions import timeframes as tf
from tidewater.operators import candles, diagnostics, indicators, intents
from tidewater.plans.views import CANDLES_SQL, PARTS_SQL, TICKS_SQL, read
from tidewater.plans.views import ticks as tick_view

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(s, d):
    k = F.col("o_orderkey")
    x = read(s, d, "orders").select(
        k.alias("key"), F.lit("v1").alias("version"), F.when(k % 31 == 0, " ").otherwise("acct").alias("account_scope_id"), F.when(k % 29 != 0, "p0").alias("partition_id"), F.concat(F.lit("c"), k.cast("string")).alias("candidate_id"), (k % 100).alias("token"), F.lit("NSE").alias("exchange"), F.lit("SYM").alias("symbol"),
        F.when(k % 23 == 0, "HOLD").when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (k % 19).alias("quantity"), F.when(k % 3 == 0, "LIMIT").otherwise("MARKET").alias("order_type"), F.when(k % 5 != 0, k * 10).alias("limit_price_paise"), F.lit("n7").alias("strategy_id"), F.lit("1").alias("strategy_version"), F.lit("r").alias("rule_id"),
        (k * 1000).alias("detection_ts"), (k * 1000 + 5).alias("created_ts"), (k * 1000 + (k % 7) * 100).alias("expires_ts"), F.lit("I").alias("product"), F.lit("DAY").alias("validity"), (k % 13 - 6).cast("double").alias("score"),
    )
    return intents.intents(x)


@query("""SELECT o_orderkey AS key, CASE WHEN k % 31 = 0 THEN 'scope' WHEN k % 29 = 0 THEN 'partition' WHEN k % 23 = 0 THEN 'side' WHEN k % 19 <= 0 THEN 'quantity' WHEN k % 3 = 0 AND (k % 5 = 0 OR k * 10 <= 0) THEN 'limit-price' WHEN k * 1000 + (k % 7) * 100 <= 5000000 THEN 'expired' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def intent_validation(s, d):
    return _orders(s, d).select("key", intents.intent_reason(F.lit(5_000_000)).alias("reason"))


@query("""SELECT o_orderkey AS key, CASE WHEN k % 23 = 0 THEN 'side' WHEN k % 3 = 0 AND (k % 5 = 0 OR k * 10 <= 0) THEN 'limit-price' WHEN k % 3 <> 0 AND k % 5 <> 0 THEN 'market-price' WHEN (k % 7) * 100 <= 5 THEN 'expiry' END AS reason FROM (SELECT o_orderkey, o_orderkey AS k FROM orders)""")
def decision_validation(s, d):
    return _orders(s, d).select("key", intents.decision_reason().alias("reason"))


@query("""SELECT o_orderkey AS key, CASE WHEN o_orderstatus = 'F' THEN 'CLOSED' ELSE 'OPEN' END AS status, CASE WHEN o_orderstatus = 'F' THEN o_orderkey * 2 END AS closed_ts, CASE WHEN o_orderstatus = 'F' THEN 'FLAT' END AS closed_reason FROM orders""")
def position_state_rows(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "FLAT").otherwise("OPEN")
    return read(s, d, "orders").select(F.col("o_orderkey").alias("key"), intents.position_row(state, F.col("o_orderkey") * 2).alias("r")).select("key", "r.*")


@query("""SELECT event_id, '{"strategy":{"id":"n7","version":null},"value":' || (event_id % 7) || '}' AS doc, CASE WHEN event_id % 7 = 3 THEN 'n7' END AS id FROM events""")
def audit_documents(s, d):
    doc = intents.audit_document(strategy=F.struct(F.lit("n7").alias("id"), F.lit(None).cast("string").alias("version")), value=F.col("event_id") % 7)
    x = read(s, d, "events").select("event_id", doc.alias("doc"))
    return x.select("event_id", "doc", F.when(F.get_json_object("doc", "$.value") == "3", F.get_json_object("doc", "$.strategy.id")).alias("id"))


@query("SELECT event_id, 'user ' || user_id AS opened FROM events")
def sealed_round_trip(s, d):
    key = F.lit("0123456789abcdef").cast("binary")
    x = read(s, d, "events").select("event_id", F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("v"))
    return intents.opened(intents.sealed(x, "v", key), "sealed", key).select("event_id", "opened")


@query(f"""WITH {TICKS_SQL}, w AS (SELECT DISTINCT token, (event_time // 90000) * 90000 - 7000 AS begins, (event_time // 90000) * 90000 + 61000 AS ends FROM ticks)
SELECT w.token AS key, begins, ends, round(avg(price_paise), 6) AS mean, count(price_paise) AS n FROM w LEFT JOIN ticks t ON t.token = w.token AND t.event_time >= begins AND t.event_time < ends GROUP BY 1, 2, 3""")
def window_means(s, d):
    t = tick_view(s, d).select(F.col("token").alias("key"), F.col("event_time").alias("t"), F.col("price_paise").alias("value"))
    at = F.floor(F.col("t") / 90_000) * 90_000
    w = t.select("key", (at - 7000).alias("begins"), (at + 61_000).alias("ends")).distinct()
    return diagnostics.window_means(t, w).withColumn("mean", F.round("mean", 6))


@query(f"""WITH {PARTS_SQL} SELECT token, tf, ws + ms AS window_end, min(seen) - (ws + ms) AS latency FROM (SELECT token, tf, ws, ms, event_time + 40000 AS seen FROM parts) WHERE seen >= ws + ms GROUP BY token, tf, ws + ms, ws, ms""")
def first_sightings(s, d):
    x = candles.fan_out(candles.accepted_trades(tick_view(s, d))).select("token", "tf", (F.col("window_start") + F.col("tf_ms")).alias("window_end"), (F.col("event_time") + 40_000).alias("seen"))
    return diagnostics.first_sighting(x, ["token", "tf"], "seen", "window_end")


@query(f"""WITH {TICKS_SQL}, t AS (SELECT token, event_time // 60000 * 60000 AS m, CAST(sum(volume_delta) AS BIGINT) AS v FROM ticks GROUP BY 1, 2)
SELECT token, arg_min(v, m) AS first, arg_max(v, m) AS last, round(CASE WHEN max(m) > min(m) THEN (arg_max(v, m) - arg_min(v, m)) * 60000 / (max(m) - min(m)) END, 9) AS per_minute FROM t GROUP BY 1""")
def state_growth(s, d):
    x = tick_view(s, d).withColumn("at", F.floor(F.col("event_time") / 60_000) * 60_000)
    return diagnostics.growth(x, ["token"], "at", "volume_delta").withColumn("per_minute", F.round("per_minute", 9))


@query(f"WITH {TICKS_SQL} SELECT token, arg_max(event_type, (price_paise, event_type)) AS part, max(price_paise) AS value FROM ticks GROUP BY 1")
def worst_part(s, d):
    return diagnostics.worst(tick_view(s, d), ["token"], "event_type", "price_paise")


@query(f"""WITH {TICKS_SQL}, p AS (SELECT token, event_type, avg(volume_delta) AS r, max(price_paise) AS b FROM ticks GROUP BY 1, 2), j AS (SELECT token, sum(r) AS rate, max(b) AS busy FROM p GROUP BY 1)
SELECT token, round(rate, 6) AS rate, busy, CASE WHEN busy = 0 THEN 'SOURCE' WHEN rate / busy < 0.01 THEN 'OUT_THROTTLED' ELSE 'OK' END AS flag FROM j""")
def job_totals(s, d):
    x = diagnostics.job_totals(tick_view(s, d), "volume_delta", "price_paise", ["token"], "event_type")
    return diagnostics.throttled(x, "busy", "rate", 0.01).withColumn("rate", F.round("rate", 6))


@query(f"""WITH {TICKS_SQL} SELECT token, event_type, (seq // 300) * 300 AS window, arg_max(price_paise, seq) AS value, max(seq) AS at FROM ticks GROUP BY 1, 2, 3""")
def newest_by_window(s, d):
    return diagnostics.newest_by_window(tick_view(s, d), ["token", "event_type"], "seq", "price_paise", 300)


@query(f"WITH {TICKS_SQL} SELECT event_type, max(volume_delta) AS max, round(avg(volume_delta), 6) AS avg, count(*) AS n FROM ticks WHERE volume_delta > 10 GROUP BY 1")
def source_watermarks(s, d):
    return diagnostics.watermarks(tick_view(s, d), "event_type", "volume_delta", 10).withColumn("avg", F.round("avg", 6))


@query(f"WITH {TICKS_SQL}, p AS (SELECT token, event_time, (seq // 1000) * 1000 + {2 * 10**12} AS polled FROM ticks) SELECT token, polled, polled - max(event_time) AS freshest, polled - min(event_time) AS stalest FROM p GROUP BY 1, 2")
def visible_age(s, d):
    x = tick_view(s, d).withColumn("polled", F.floor(F.col("seq") / 1000) * 1000 + 2 * 10**12)
    return diagnostics.visible_age(x, "event_time", "polled", ["token"])


@query("SELECT count(*) - count(DISTINCT value) AS extra, 7::BIGINT AS dropped, count(*) - count(DISTINCT value) = 7 AS exact FROM events")
def dedup_exactness(s, d):
    return diagnostics.dedup_exactness(read(s, d, "events"), "value", 7)


@query(f"""WITH {CANDLES_SQL}, raw AS (SELECT token, tf, ws, sum(volume_delta) AS volume FROM parts GROUP BY 1, 2, 3), x AS (SELECT coalesce(c.volume, 0) - coalesce(r.volume, 0) AS d FROM candles c FULL JOIN raw r ON c.token = r.token AND c.tf = r.tf AND c.window_start = r.ws)
SELECT CAST(sum(greatest(-d, 0)) AS BIGINT) AS short, CAST(sum(greatest(d, 0)) AS BIGINT) AS excess, sum(greatest(d, 0)) = 0 AND sum(greatest(-d, 0)) <= 1000 AS ok FROM x""")
def volume_totals(s, d):
    t = tick_view(s, d)
    p = candles.parity(candles.candles(t), candles.bars(candles.fan_out(candles.accepted_trades(t)), ["token", "tf", "window_start"]))
    return diagnostics.totals(p, 1000)


@query("""SELECT o_custkey, max(o_orderkey) AS last FROM orders GROUP BY 1 HAVING bool_and(o_orderstatus = 'F') AND max(o_orderkey) + 50 <= 12000""")
def tentative_orphans(s, d):
    x = read(s, d, "orders").withColumn("kind", F.when(F.col("o_orderstatus") == "F", "TENTATIVE").otherwise("FINAL"))
    return diagnostics.tentative_orphans(x, "o_custkey", "kind", "o_orderkey", 12_000, 50)


@query(f"""WITH {CANDLES_SQL} SELECT token, tf, window_start, window_start > min(window_start) OVER (PARTITION BY token, tf) AND window_end <= 1704090000000 - 500 AS judged FROM candles""")
def parity_edges(s, d):
    return diagnostics.parity_edges(candles.candles(tick_view(s, d)), 1_704_090_000_000).select("token", "tf", "window_start", "judged")


@query(f"""WITH {CANDLES_SQL} SELECT token, tf, arg_max(close_paise, window_start) AS value FROM candles GROUP BY 1, 2""")
def latest_live(s, d):
    c = candles.candles(tick_view(s, d)).withColumnRenamed("close_paise", "value")
    newest = c.groupBy("token", "tf").agg(F.max("window_start").alias("m"))
    c = c.join(newest, ["token", "tf"])
    return diagnostics.latest_live(c.where("window_start < m or tf = '5m'"), c.where("window_start = m"), ["token", "tf"])


@query(f"""WITH {PARTS_SQL}, f AS (SELECT token, tf, ws, seq, close_paise FROM (SELECT token, tf, ws, seq, price_paise AS close_paise, row_number() OVER (PARTITION BY token, tf, ws ORDER BY event_time DESC) AS n FROM parts) WHERE n = 1) SELECT token, tf, ws AS window_start, seq AS last_seq, close_paise FROM f""")
def sealed_rows(s, d):
    x = candles.forming(tick_view(s, d))
    last = x.groupBy("token", "tf", "window_start").agg(F.max_by(F.struct("seq", "close_paise"), "event_time").alias("r"))
    return last.select("token", "tf", "window_start", F.col("r.seq").alias("last_seq"), F.col("r.close_paise").alias("close_paise"))


@query("SELECT DISTINCT n_name AS name FROM nation WHERE n_name NOT IN ('FRANCE', 'BRAZIL')")
def outside_allow_list(s, d):
    return diagnostics.outside_allowed(read(s, d, "nation").select(F.col("n_name").alias("name")), ["FRANCE", "BRAZIL"])


@query("SELECT count(DISTINCT c_name) AS instances, count(DISTINCT c_name) FILTER (NOT regexp_matches(c_name, '^Customer#[0-9]*[02468]$')) AS malformed, false AS ok FROM customer")
def instance_check(s, d):
    return diagnostics.instance_check(read(s, d, "customer"), "c_name", 10, "^Customer#[0-9]*[02468]$")


@query("SELECT o_orderkey, epoch_ms(date_trunc('day', o_orderdate)) AS day_ms, epoch_ms(o_orderdate) - epoch_ms(o_orderdate) % 86400000 + 86400000 - 19800000 + 86400000 * 2 + 5000 AS bound FROM orders WHERE epoch_ms(o_orderdate) % 86400000 = 0")
def expiry_bounds(s, d):
    t = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return read(s, d, "orders").select("o_orderkey", t.alias("day_ms"), tf.expiry_bound(t, tf.ttl_ms(F.lit("2d")), 5000).alias("bound"))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def tick_counts(s, d):
    return read(s, d, "events").groupBy("event_type").count().withColumnRenamed("count", "n")


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'v' || event_id END AS shown FROM events WHERE event_type = 'view' OR event_type = 'click'")
def log_predicate(s, d):
    x = read(s, d, "events").where(F.col("event_type").rlike("view|click"))
    return x.select("event_id", F.when(F.col("event_id") % 2 == 0, text.redact(F.concat(F.lit("v"), F.col("event_id").cast("string")))).alias("shown"))


@query(f"""WITH {CANDLES_SQL}, k AS (SELECT token, tf, window_start, window_end, row_number() OVER (PARTITION BY token, tf ORDER BY window_start DESC) AS n FROM candles) SELECT token, tf, window_start FROM k WHERE n <= 15""")
def newest_ring_rows(s, d):
    return indicators.newest(candles.candles(tick_view(s, d)), ["token", "tf"], ["window_start"], 15).select("token", "tf", "window_start")
