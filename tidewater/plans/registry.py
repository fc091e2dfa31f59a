"""Registered queries: admission, control records, features, decision identities, probes and audits of sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.functions import identity
from tidewater.operators import admission, candles, diagnostics, features, folds, indicators, joins, metrics
from tidewater.plans import strategies
from tidewater.plans.views import CANDLES_SQL, IN_SESSION, PARTS_SQL, TICKS_SQL, read
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


def _long(v) -> F.Column:
    return F.lit(v).cast("long")


@query("""WITH x AS (SELECT event_id AS seq, event_id % 17 AS h, CASE WHEN event_id % 19 = 0 THEN 0 ELSE event_id * 1000 END AS ts,
  event_id * 1000 + (event_id % 13) * 1000 - 4000 AS received, user_id % 30 - 1 AS token,
  CASE event_id % 11 WHEN 0 THEN 'other' WHEN 1 THEN 'token' ELSE 'hft' END AS feed,
  CASE event_id % 4 WHEN 0 THEN 'ltp' WHEN 1 THEN 'full' WHEN 2 THEN 'quote' ELSE 'ltpc' END AS mode,
  CAST(round(value * 100) AS BIGINT) - 400 AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) % 3 AS delta FROM events),
y AS (SELECT *, CASE WHEN h = 0 THEN 'MISSING_PAYLOAD_HASH' WHEN h = 1 THEN 'HASH_MISMATCH' WHEN h = 2 THEN 'INVALID_SCHEMA'
  WHEN ts <= 0 THEN 'INVALID_VALUES' WHEN ts - received > 2000 THEN 'FUTURE_BROKER_TIMESTAMP' WHEN received - ts > 5000 THEN 'STALE_BROKER_TIMESTAMP'
  WHEN token <= 0 THEN 'INVALID_VALUES' WHEN token NOT IN (SELECT n_nationkey FROM nation) THEN 'MISSING_INSTRUMENT' WHEN feed = 'other' THEN 'INVALID_SCHEMA'
  WHEN mode IN ('ltp', 'ltpc') AND price <= 0 THEN 'INVALID_VALUES' END AS reason FROM x),
z AS (SELECT *, CASE WHEN reason IS NULL THEN CASE WHEN mode IN ('ltp', 'ltpc', 'full') AND price > 0 THEN 'VALID_TRADE' ELSE 'VALID_NON_TRADE' END END AS validity FROM y)
SELECT seq, reason, validity, CASE WHEN reason IS NULL THEN CASE WHEN validity = 'VALID_TRADE' AND delta > 0 THEN 'TRADE' ELSE 'QUOTE' END END AS tick_type FROM z""")
def tick_admission(s, d):
    i, p = F.col("event_id"), F.encode("props", "utf-8")
    sha, m, f = F.unhex(F.sha2(p, 256)), i % 4, i % 11
    x = read(s, d, "events").select(
        i.alias("seq"), p.alias("payload"), F.when(i % 17 == 1, F.unhex(F.sha2(F.concat(p, p), 256))).when(i % 17 == 2, F.unhex(F.md5(p))).when(i % 17 > 2, sha).alias("payload_hash"),
        F.when(i % 19 == 0, _long(0)).otherwise(i * 1000).alias("ts_ms"), (i * 1000 + (i % 13) * 1000 - 4000).alias("received_ms"), (F.col("user_id") % 30 - 1).alias("token"),
        F.when(f == 0, "other").when(f == 1, "token").otherwise("hft").alias("feed"), F.when(m == 0, "ltp").when(m == 1, "full").when(m == 2, "quote").otherwise("ltpc").alias("mode"),
        (F.round(F.col("value") * 100).cast("long") - 400).alias("price_paise"), (F.get_json_object("props", "$.k").cast("long") % 3).alias("volume_delta"),
    )
    known = read(s, d, "nation").select(F.col("n_nationkey").alias("token"))
    return admission.admitted(x, known, 5000, 2000).select("seq", "reason", "validity", "tick_type")


@query("""SELECT event_id, CASE WHEN event_id % 31 = 0 THEN 'record-type' WHEN event_id % 29 = 0 THEN 'contract-version' WHEN event_id % 23 = 0 THEN 'identity' WHEN event_id % 19 = 0 THEN 'state'
  WHEN event_type = 'view' THEN 'event' WHEN event_id % 17 = 0 THEN 'connection-epoch' WHEN event_id % 13 = 0 THEN 'received-ts' WHEN event_id % 11 = 0 THEN 'token-counts' END AS event_reason,
  CASE WHEN event_id % 29 = 0 THEN 'contract-version' WHEN event_id % 13 = 0 THEN 'ts' WHEN event_id % 11 = 0 THEN 'gauges' END AS metrics_reason,
  CASE WHEN event_id % 29 = 0 THEN 'contract-version' WHEN event_id % 23 = 0 THEN 'slot' WHEN event_id % 17 = 0 THEN 'connection-epoch' WHEN event_id % 11 = 0 THEN 'token'
  WHEN event_type = 'view' THEN 'reason' WHEN event_id % 7 = 0 THEN 'hash-form' WHEN event_id % 5 = 0 THEN 'hash-mismatch' WHEN event_id % 13 = 0 THEN 'detected-ts' END AS quarantine_reason FROM events""")
def record_validation(s, d):
    i, view = F.col("event_id"), F.col("event_type") == "view"
    p = F.encode("props", "utf-8")
    when = lambda k, a, b: F.when(i % k == 0, a).otherwise(b)
    base = read(s, d, "events").select(
        i, view.alias("view"), when(31, "bridge_metrics", "bridge_event").alias("record_type"), when(29, 1, 2).alias("contract_version"), when(23, "", "hft-0").alias("slot_id"), F.lit("hft-0").alias("connection_id"),
        when(19, "", "LIVE").alias("state"), F.when(view, "opened").otherwise("reconnect").alias("event"), when(17, 0, 4).alias("connection_epoch"), when(13, 0, 99).alias("received_ts_ms"),
        F.lit(3).alias("assigned_tokens"), F.lit(None).cast("int").alias("acknowledged_tokens"), when(11, -1, 0).alias("rejected_tokens"), when(13, 0, 99).alias("ts_ms"), F.lit(0).alias("reconnect_consecutive"),
        F.lit(1).alias("active_sockets"), when(11, -1, 7).alias("go_goroutines"), when(11, -1, 7).alias("token"), F.when(view, "NONE").otherwise("HASH_MISMATCH").alias("reason"), p.alias("raw_payload"),
        F.when(i % 7 == 0, F.upper(F.sha2(p, 256))).when(i % 5 == 0, F.sha2(F.concat(p, p), 256)).otherwise(F.sha2(p, 256)).alias("payload_hash"), when(13, 0, 99).alias("detected_ts_ms"),
    )
    x = base.withColumn("event_reason", admission.event_reason()).withColumn("quarantine_reason", admission.quarantine_reason())
    return x.withColumn("record_type", F.lit("bridge_metrics")).withColumn("metrics_reason", admission.metrics_reason()).select("event_id", "event_reason", "metrics_reason", "quarantine_reason")


@query("""SELECT token, 'hft-' || (place // 40) AS slot, (place % 40) // 16 AS request FROM (SELECT token, row_number() OVER (ORDER BY token) - 1 AS place FROM (SELECT DISTINCT c_custkey AS token FROM customer WHERE c_custkey > 0))""")
def subscription_requests(s, d):
    return admission.subscription_plan(read(s, d, "customer").select(F.col("c_custkey").alias("token")), 40, 16)


@query("""WITH v AS (SELECT count(*) AS tokens FROM nation), w AS (SELECT count(*) AS tokens FROM (SELECT o_custkey FROM orders)),
u AS (SELECT count(*) FILTER (n > 1) AS duplicates FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1))
SELECT 'nation' AS source, tokens, 0::BIGINT AS duplicates, 'INVALID_TOKEN' AS reason FROM v UNION ALL
SELECT 'orders', tokens, duplicates, CASE WHEN tokens > 3072 THEN 'CAPACITY' WHEN duplicates > 0 THEN 'DUPLICATE' END FROM w, u UNION ALL SELECT 'wide', tokens, 0, 'CONNECTIONS' FROM v""")
def subscription_violations(s, d):
    nation, orders = read(s, d, "nation").select(F.col("n_nationkey").alias("token")), read(s, d, "orders").select(F.col("o_custkey").alias("token"))
    named = lambda n, x: x.select(F.lit(n).alias("source"), "*")
    return named("nation", admission.plan_violation(nation, 1)).unionByName(named("orders", admission.plan_violation(orders, 3))).unionByName(named("wide", admission.plan_violation(nation, 4)))


@query("""SELECT s_suppkey, CASE WHEN s_suppkey % 3 + 1 > 1 AND s_suppkey % 2 = 0 THEN 'PRODUCTION_POLICY' WHEN s_suppkey % 3 + 1 > 1 AND s_suppkey % 5 <> 0 THEN 'UNAPPROVED_CONNECTIONS'
  WHEN s_suppkey * 20 > (s_suppkey % 3 + 1) * 1024 THEN 'CAPACITY' END AS reason FROM supplier""")
def capacity_check(s, d):
    k = F.col("s_suppkey")
    return read(s, d, "supplier").select("s_suppkey", admission.capacity_reason(k * 20, k % 3 + 1, F.lit(1024), k % 2 == 0, k % 5 == 0).alias("reason"))


def _decisions(s, d):
    k = F.col("o_orderkey")
    some = lambda n, v: F.when(k % n != 0, v)
    text = lambda p: F.concat(F.lit(p), k.cast("string"))
    return read(s, d, "orders").select(
        k.alias("key"), F.col("o_custkey").alias("token"), text("A|").alias("symbol"), text("t\\").alias("trade_context_id"), F.when(k % 2 == 0, "BUY").otherwise("SELL").alias("side"), (k % 19 + 1).alias("quantity"),
        some(3, k * 10).alias("limit_price_paise"), F.lit("LIMIT").alias("order_type"), some(5, F.lit("I")).alias("product_type"), F.lit("1").alias("strategy_version"), text("c").alias("candidate_id"),
        text("e").alias("evaluation_id"), F.lit("NSE").alias("exchange"), F.lit("n7").alias("strategy_id"), F.lit("cfg").alias("configuration_version"), some(7, (k % 13).cast("double") / 2).alias("composite_score"),
        F.lit("p").alias("portfolio_id"), F.lit("acct").alias("account_scope_id"), F.lit(None).cast("string").alias("reservation_id"), F.lit(None).cast("string").alias("reservation_version"),
        (k * 1000).alias("created_ts"), some(11, k * 1000 + 5).alias("expiry_ts"), F.lit(None).cast("string").alias("supersedes_instruction_id"), F.lit(None).cast("string").alias("superseded_by_instruction_id"),
    )


_FIELD = "coalesce(length({0}) || ':' || replace(replace({0}, '\\', '\\\\'), '|', '\\|'), '\\0')"
_DECISION = "'|' || o_custkey || '|' || {} || '|' || {} || '|' || {} || '|' || (k % 19 + 1) || '|' || coalesce(CAST(CASE WHEN k % 3 <> 0 THEN k * 10 END AS VARCHAR), '\\0') || '|5:LIMIT|' || {} || '|1:1'".format(
    *[_FIELD.format(f) for f in ("('A|' || k)", "('t\\' || k)", "(CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END)", "(CASE WHEN k % 5 <> 0 THEN 'I' END)")]
)


@query(f"""SELECT k AS key, 'ins-v1-' || sha256('tdi-v2' || {_DECISION}) AS id, sha256('tdc-v2' || {_DECISION} || '|' || {_FIELD.format("('c' || k)")} || '|' || {_FIELD.format("('e' || k)")}
  || '|3:NSE|2:n7|3:cfg|' || coalesce(CAST(CASE WHEN k % 7 <> 0 THEN CAST(k % 13 AS DOUBLE) / 2 END AS VARCHAR), '\\0') || '|1:p|4:acct|\\0|\\0|' || (k * 1000) || '|'
  || coalesce(CAST(CASE WHEN k % 11 <> 0 THEN k * 1000 + 5 END AS VARCHAR), '\\0') || '|\\0|\\0') AS content FROM (SELECT *, o_orderkey AS k FROM orders)""")
def decision_ids(s, d):
    return _decisions(s, d).select("key", identity.decision_id().alias("id"), identity.decision_hash().alias("content"))


@query("""SELECT o_orderkey AS key, sha256('{"fill_price":"' || floor(o_totalprice)::BIGINT || '","id":"' || o_orderkey || '","remarks":"' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'a\\u003cb\\u0026c' END || '","status":"'
  || o_orderstatus || '"}') AS id FROM orders""")
def report_ids(s, d):
    k = F.col("o_orderkey")
    fields = {"status": F.col("o_orderstatus"), "id": k, "remarks": F.when(k % 3 != 0, "a<b&c"), "fill_price": F.floor("o_totalprice").cast("long")}
    return read(s, d, "orders").select(k.alias("key"), identity.map_hash(fields).alias("id"))


@query("""WITH x AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS n FROM events WHERE value IS NOT NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value) AS k, count(*) OVER (PARTITION BY event_type) AS m FROM x WHERE n <= 100),
p AS (SELECT *, greatest(1.0, least(m, 0.5::DOUBLE * (m + 1)))::DOUBLE AS a, greatest(1.0, least(m, 0.99::DOUBLE * (m + 1)))::DOUBLE AS b FROM y)
SELECT event_type, max(m) AS n, sum(value * CASE WHEN k = floor(a) THEN 1 - (a - floor(a)) WHEN k = floor(a) + 1 THEN a - floor(a) ELSE 0 END) AS p50,
  sum(value * CASE WHEN k = floor(b) THEN 1 - (b - floor(b)) WHEN k = floor(b) + 1 THEN b - floor(b) ELSE 0 END) AS p99 FROM p GROUP BY 1""")
def last_sample_percentiles(s, d):
    return metrics.last_samples(read(s, d, "events"), ["event_type"], ["event_id"], "value", [50, 99], 100)


@query(f"""WITH {TICKS_SQL}, g AS (SELECT *, max(event_time) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ticks),
c AS (SELECT token, count(*) FILTER (event_time <= m) AS dropped, count(*) FILTER (event_time <= m - 3000) AS late FROM g GROUP BY 1)
SELECT token, dropped < late AS short, dropped - late AS surplus, token % 2 = 1 AS missing FROM c""")
def late_drop_audit(s, d):
    from pyspark.sql import Window

    m = F.max("event_time").over(Window.partitionBy("token").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    g, t = tick_view(s, d).withColumn("m", m), F.col("event_time")
    c = g.groupBy("token").agg(F.count(F.when(t <= F.col("m"), 1)).alias("dropped"), F.count(F.when(t <= F.col("m") - 3000, 1)).alias("late"))
    want = F.col("late") + F.col("token") % 2
    return c.select("token", diagnostics.late_drops(F.col("dropped"), F.col("late"), F.col("late"), want).alias("r")).select("token", "r.*")


@query(f"""WITH {TICKS_SQL}, g AS (SELECT *, seq * 1000 AS seen, max(event_time) OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m FROM ticks),
x AS (SELECT token, max(seen) AS last_seen, max(event_time) AS newest FROM g WHERE m IS NULL OR event_time > m GROUP BY 1), y AS (SELECT max(event_id) * 1000 + 10000 AS now FROM events)
SELECT token, last_seen, newest, CASE WHEN now - last_seen >= 20000 THEN 'ALERT' WHEN now - last_seen >= 15000 THEN 'IDLE' ELSE 'ACTIVE' END AS state, CASE WHEN now - last_seen < 15000 THEN newest END AS holds FROM x, y""")
def idle_sources(s, d):
    now = read(s, d, "events").agg((F.max("event_id") * 1000 + 10_000).alias("now"))
    x = tick_view(s, d).withColumn("seen", F.col("seq") * 1000).select("token", "seen", "event_time")
    return diagnostics.source_states(x, "token", "seen", "event_time", now.scalar(), 15_000, 20_000)


@query("""WITH c(k, s) AS (VALUES (0, 'OPEN'), (1, 'DOCUMENTING'), (2, 'DOCUMENTATION_READY'), (3, 'APPROVED_FOR_IMPLEMENTATION'), (4, 'IMPLEMENTED'), (5, 'VERIFIED'), (6, 'STRUCK_THROUGH'), (-9, 'BLOCKED'))
SELECT x.s AS a, y.s AS b, CASE WHEN x.k = 6 THEN false WHEN y.k = -9 OR x.k = -9 THEN true ELSE y.k = x.k + 1 END AS allowed FROM c AS x, c AS y""")
def work_item_transitions(s, d):
    states = [*folds.WORK_CHAIN, "BLOCKED"]
    x = s.createDataFrame([(a, b) for a in states for b in states], "a string, b string")
    return x.select("a", "b", folds.allowed(folds.WORK_ITEM, F.col("a"), F.col("b")).alias("allowed"))


@query("SELECT o_orderkey AS key, o_orderstatus <> 'P' AS known FROM orders")
def reservation_states(s, d):
    state = F.when(F.col("o_orderstatus") == "F", "RELEASED").when(F.col("o_orderstatus") == "O", "OPEN").otherwise("PARTIAL")
    return read(s, d, "orders").select(F.col("o_orderkey").alias("key"), state.isin(*folds.RESERVATION_STATES).alias("known"))


@query(f"""WITH {PARTS_SQL}, b AS (SELECT token, tf, ms, ws, min(event_time) AS detection_ts, arg_max(price_paise, event_time) AS c FROM parts GROUP BY 1, 2, 3, 4),
x AS (SELECT *, lag(ws) OVER w AS before, lag(c) OVER w AS price_paise FROM b WINDOW w AS (PARTITION BY token, tf ORDER BY ws))
SELECT token, tf, before AS window_start, 'BUY' AS side, price_paise, detection_ts FROM x WHERE before = ws - ms""")
def context_probe(s, d):
    return strategies.context_probe(tick_view(s, d))


_STATS, _BOOK = ["total_buy_qty", "vwap_paise"], ["bid_px_1", "ask_px_1", "bid_qty_1", "ask_qty_1"]
_VALUES = {"total_buy_qty": "volume_delta % 5", "vwap_paise": "price_paise % 7", "bid_px_1": "price_paise % 3 * 100", "ask_px_1": "price_paise % 3 * 100 + seq % 2 * 5", "bid_qty_1": "seq % 4", "ask_qty_1": "seq % 5"}
_SNAP = f"""v AS (SELECT token, seq, event_time, {", ".join(f"nullif({v}, 0) AS {n}" for n, v in _VALUES.items())} FROM {{0}}),
f AS (SELECT token, seq, event_time, {", ".join(f"last_value({n} IGNORE NULLS) OVER w AS {n}" for n in _VALUES)} FROM v WINDOW w AS (PARTITION BY token ORDER BY seq ROWS UNBOUNDED PRECEDING)),
l AS (SELECT *, {", ".join(f"lag({n}) OVER w AS p_{n}" for n in _VALUES)} FROM f WINDOW w AS (PARTITION BY token ORDER BY seq)),
h AS (SELECT *, {" OR ".join(f"{n} IS DISTINCT FROM p_{n}" for n in _STATS)} AS s_changed, {" OR ".join(f"{n} IS DISTINCT FROM p_{n}" for n in _BOOK)} AS d_changed FROM l),
snap AS (SELECT *, max(CASE WHEN s_changed THEN event_time END) OVER w AS s_max, last_value(CASE WHEN s_changed THEN event_time END IGNORE NULLS) OVER w AS stats_changed_at,
  last_value(CASE WHEN d_changed THEN event_time END IGNORE NULLS) OVER w AS depth_changed_at FROM h WINDOW w AS (PARTITION BY token ORDER BY seq ROWS UNBOUNDED PRECEDING))"""


def _fielded(s, d):
    return tick_view(s, d).select("*", *[F.expr(v).alias(n) for n, v in _VALUES.items()])


def _market(s, d):
    """Snapshots with all market fields; those the view doesn't fill are null."""
    m = candles.snapshot(_fielded(s, d), _STATS, _BOOK)
    rest = [n for n in [*features.STATS, *features.DEPTH, *features.SEEN] if n not in _VALUES]
    return m.select("*", *[F.lit(None).cast("long").alias(n) for n in rest])


@query(f"""WITH {TICKS_SQL}, q AS (SELECT *, tick_type = 'TRADE' AND volume_delta > 0 AS trade, max(CASE WHEN tick_type = 'TRADE' AND volume_delta > 0 AND {IN_SESSION.format("event_time")} THEN event_time END)
  OVER (PARTITION BY token ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS latest FROM ticks),
a AS (SELECT * FROM q WHERE {IN_SESSION.format("event_time")} AND (latest IS NULL OR event_time > latest)), {_SNAP.format("a")}
SELECT token, 'MKT' AS tf, event_time AS window_start, event_time AS window_end, 0::BIGINT AS open_paise, 0::BIGINT AS high_paise, 0::BIGINT AS low_paise, 0::BIGINT AS close_paise, 0::BIGINT AS volume,
  0::BIGINT AS tick_count, event_time AS last_event_time, seq, {", ".join(_VALUES)}, stats_changed_at, depth_changed_at
FROM snap JOIN (SELECT token, seq FROM a WHERE NOT trade) USING (token, seq) WHERE (s_changed OR d_changed)""")
def market_only_rows(s, d):
    return features.market_rows(_fielded(s, d), _STATS, _BOOK)


@query(f"""WITH {PARTS_SQL}, {_SNAP.format("ticks")}
SELECT p.token, p.tf, p.seq, {", ".join(f"CASE WHEN p.tf = '15s' THEN s.{n} END AS {n}" for n in [*_VALUES, "stats_changed_at", "depth_changed_at"])} FROM parts p LEFT JOIN snap s ON p.token = s.token AND p.seq = s.seq""")
def market_sections(s, d):
    rows = candles.forming(tick_view(s, d)).select("token", "tf", "seq")
    return features.market_section(rows, candles.snapshot(_fielded(s, d), _STATS, _BOOK), [*_VALUES, "stats_changed_at", "depth_changed_at"])


def _id(name: str) -> int:
    return features.REGISTRY.by_name(name).id


@query(f"""WITH {CANDLES_SQL}, {_SNAP.format("ticks")}, lastseq AS (SELECT token, tf, ws AS window_start, arg_max(seq, event_time) AS seq FROM parts GROUP BY 1, 2, 3),
x AS (SELECT c.token, c.tf, c.window_start, c.close_paise, CASE WHEN c.tf IN ('1m', '3m', '5m', '15m') AND count(*) OVER w = 20 THEN sum(c.close_paise) OVER w / 20 END AS sma, s.* EXCLUDE (token)
  FROM candles c JOIN lastseq USING (token, tf, window_start) JOIN snap s ON s.token = c.token AND s.seq = lastseq.seq WINDOW w AS (PARTITION BY c.token, c.tf ORDER BY c.window_start ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
e AS (SELECT token, tf, window_start, unnest([0, 1, {_id("total_buy_qty")}, {_id("vwap_paise")}, {_id("bid_px_1")}, {_id("bid_qty_1")}, {_id("ask_px_1")}, {_id("ask_qty_1")}, {_id("spread_paise")}, {_id("depth_imbalance")}, {_id("microprice_paise")}]) AS id,
  unnest([close_paise::DOUBLE, sma, CASE WHEN stats_changed_at IS NOT NULL THEN coalesce(total_buy_qty, 0) END, CASE WHEN stats_changed_at IS NOT NULL THEN coalesce(vwap_paise, 0) END,
  bid_px_1, CASE WHEN bid_px_1 > 0 THEN coalesce(bid_qty_1, 0) END, ask_px_1, CASE WHEN ask_px_1 > 0 THEN coalesce(ask_qty_1, 0) END, ask_px_1 - bid_px_1,
  CASE WHEN depth_changed_at IS NOT NULL AND coalesce(bid_qty_1, 0) + coalesce(ask_qty_1, 0) <> 0 THEN (coalesce(bid_qty_1, 0) - coalesce(ask_qty_1, 0))::DOUBLE / (coalesce(bid_qty_1, 0) + coalesce(ask_qty_1, 0)) END,
  CASE WHEN bid_px_1 > 0 AND ask_px_1 > 0 AND bid_qty_1 > 0 AND ask_qty_1 > 0 THEN (bid_px_1 * ask_qty_1 + ask_px_1 * bid_qty_1 + (bid_qty_1 + ask_qty_1) // 2) // (bid_qty_1 + ask_qty_1) END]) AS value FROM x),
z AS (SELECT token, tf, window_start, {", ".join(f"CASE WHEN stats_changed_at IS NOT NULL THEN 0 END AS n{k}" for k in range(1))} FROM x WHERE stats_changed_at IS NOT NULL)
SELECT token, tf, window_start, id::INTEGER AS id, value::DOUBLE AS value FROM e WHERE value IS NOT NULL UNION ALL
SELECT token, tf, window_start, other::INTEGER, 0::DOUBLE FROM z, (SELECT unnest([{", ".join(str(_id(n)) for n in features.STATS if n not in _STATS)}, -1]) AS other) WHERE other >= 0 UNION ALL
SELECT token, tf, window_start, ord::INTEGER, 0::DOUBLE FROM x, (SELECT {_id("bid_ord_1")} AS ord, true AS bid UNION ALL SELECT {_id("ask_ord_1")}, false) WHERE CASE WHEN bid THEN bid_px_1 > 0 ELSE ask_px_1 > 0 END""")
def registry_features(s, d):
    """Every active feature of closed bars that has a value, but the relative strength (its query is ``rsi14``)."""
    t = tick_view(s, d)
    last = candles.fan_out(candles.accepted_trades(t)).groupBy("token", "tf", "window_start").agg(F.max_by("seq", "event_time").alias("seq"))
    bars = indicators.sma(candles.candles(t)).select("token", "tf", "window_start", "close_paise", "sma").join(last, ["token", "tf", "window_start"])
    x = bars.join(_market(s, d).drop("event_time"), ["token", "seq"]).withColumn("rsi", F.lit(None).cast("double"))
    x = x.withColumn("features", features.REGISTRY.snapshot(F.col("tf")))
    return x.select("token", "tf", "window_start", F.explode("features").alias("id", "value"))
