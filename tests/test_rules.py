"""The order, safety and signal rules, case by case."""

import random

import pytest
from pyspark.sql import functions as F

from tidewater.operators import folds, indicators, joins

# -- suppression ------------------------------------------------------------------------------------


def test_suppression(spark):
    slots = spark.createDataFrame([(t, f"hft-{(t - 1) // 3}") for t in range(1, 7)], "token long, slot string")
    cases = [
        # states, then (token, epoch, published, verdict)
        ([], [(1, 5, None, "ALLOW"), (999, 5, None, "ALLOW")]),
        ([("hft-0", "UNSAFE", 5)], [(2, 5, None, "SUPPRESS_NEW"), (2, 5, False, "DISCARD_INFLIGHT"), (2, 5, True, "ALLOW"), (5, 5, None, "ALLOW"), (2, 9, None, "SUPPRESS_NEW")]),
        ([("hft-0", "RECOVERED", 6)], [(1, 5, None, "SUPPRESS_NEW"), (1, 6, None, "ALLOW"), (1, 5, False, "DISCARD_INFLIGHT"), (1, 5, True, "ALLOW")]),
    ]
    for states, orders in cases:
        state = spark.createDataFrame(states, "slot string, status string, epoch long")
        got = joins.suppression(spark.createDataFrame([(k, *o[:3]) for k, o in enumerate(orders)], "id long, token long, epoch long, published boolean"), slots, state).collect()
        assert [r.verdict for r in sorted(got, key=lambda r: r.id)] == [o[3] for o in orders]


# -- correlation ------------------------------------------------------------------------------------


def test_correlation(spark):
    attempts = spark.createDataFrame([("instr-1", "b-1", None), ("instr-2", None, "ref-b-2"), ("instr-3", "b-3", "ref-x"), ("instr-4", "b-4", None), ("instr-5", "b-4", None)], "instruction_id string, broker_order_id string, client_ref string")
    approved = spark.createDataFrame([("acc-1", "b-9", "instr-1"), ("acc-2", "b-8", "instr-2")], "account string, broker_order_id string, instruction_id string")
    cases = [
        ("acc-1", "b-1", None, "instr-1", "CORRELATED"), ("acc-1", None, "ref-b-2", "instr-2", "CORRELATED"), ("acc-1", " ", "ref-b-2", "instr-2", "CORRELATED"), ("acc-1", None, None, None, "MISSING_BROKER_ID"),
        ("acc-1", None, "  ", None, "MISSING_BROKER_ID"), ("acc-1", None, "ref-none", None, "NO_MATCHING_INSTRUCTION"), ("acc-1", "b-9", None, "instr-1", "CORRELATED"), ("acc-1", "b-8", None, None, "NO_MATCHING_INSTRUCTION"),
        ("acc-1", "b-99", "ref-b-2", None, "NO_MATCHING_INSTRUCTION"), ("acc-1", "b-1", "ref-b-2", None, "AMBIGUOUS_CORRELATION"), ("acc-1", "b-9", "ref-b-2", None, "AMBIGUOUS_CORRELATION"),
        ("acc-1", "b-1", "ref-none", "instr-1", "CORRELATED"), ("acc-1", "b-3", "ref-x", "instr-3", "CORRELATED"), ("acc-1", "b-4", None, None, "AMBIGUOUS_CORRELATION"),
    ]
    reports = spark.createDataFrame([(k, *c[:3]) for k, c in enumerate(cases)], "report_id long, account string, broker_order_id string, client_ref string")
    got = sorted(joins.correlated(reports, attempts, approved).collect(), key=lambda r: r.report_id)
    assert [(r.instruction_id, r.correlation) for r in got] == [c[3:] for c in cases]


# -- breakouts --------------------------------------------------------------------------------------

MS = {"15s": 15_000, "1m": 60_000}


def seven(fold, tf, last=(10_006, 10_005), ranges=(7, 6, 5, 4, 3, 2)):
    """Six wider bars and then the narrowest, which arms."""
    out = []
    for k, r in enumerate(ranges):
        out += fold.candle(tf, MS[tf], k * MS[tf], 10_000 + k, 10_000 + k - r, False)
    return out + fold.candle(tf, MS[tf], 6 * MS[tf], *last, True)


def test_a_setup_fires_once():
    for price, side in ((10_007, "BUY"), (10_004, "SELL")):
        f = indicators.BreakoutFold()
        assert seven(f, "15s") == []
        assert f.trade(199_999, 10_006, "a", 0) == f.trade(200_000, 10_005, "b", 1) == []
        assert f.trade(200_001, price, "c", 2) == [("15s", 90_000, side, price, 200_001, 2, 0, "live")]
        assert f.trade(200_002, 10_009, "d", 3) == f.trade(200_003, 10_001, "e", 4) == []


def test_the_largest_timeframe_wins_and_the_others_stay_armed():
    f = indicators.BreakoutFold()
    seven(f, "15s")
    seven(f, "1m")
    assert f.trade(500_000, 10_007, "a", 1) == [("1m", 360_000, "BUY", 10_007, 500_000, 1, 1, "live")]
    assert f.trade(500_000, 10_007, "a", 1) == []  # comes again
    assert f.trade(500_001, 10_008, "b", 2) == [("15s", 90_000, "BUY", 10_008, 500_001, 2, 0, "live")]


def test_trades_that_come_again():
    f = indicators.BreakoutFold()
    seven(f, "15s")
    assert f.trade(200_000, 10_006, "fp-1", 1) == [] and f.trade(200_000, 10_007, "fp-1", 1) == []
    assert f.trade(200_000, 10_007, None, 1) == [] and f.trade(199_999, 10_007, "fp-3", 1) == []
    assert len(f.trade(200_000, 10_007, "fp-2", 1)) == 1


def test_gaps_and_inverted_bars():
    f = indicators.BreakoutFold()
    seven(f, "15s")
    f.candle("15s", 15_000, 6 * 15_000, 99_999, 99_990, True)  # the same bar again
    f.candle("15s", 15_000, 7 * 15_000, 100, 200, False)  # high below low
    assert f.armed["15s"][1] == 90_000 and f.last_bar["15s"] == 90_000
    f.candle("15s", 15_000, 8 * 15_000, 10_010, 10_009, False)
    assert "15s" not in f.armed and f.trade(200_000, 10_020, "a", 1) == []
    f = indicators.BreakoutFold()
    seven(f, "15s")
    f.candle("15s", 15_000, 7 * 15_000, 10_007, 10_007, True)
    assert f.armed["15s"][1] == 105_000


def test_firing_while_arming():
    f = indicators.BreakoutFold()
    assert f.trade(95_000, 10_007, "a", 1) == [] and seven(f, "15s") == []  # a trade of the bar itself
    assert len(f.trade(110_000, 10_008, "b", 2)) == 1
    f = indicators.BreakoutFold()
    assert f.trade(500_000, 10_007, "a", 1) == []
    assert seven(f, "15s") == [("15s", 90_000, "BUY", 10_007, 500_000, 1, 0, "arm")]
    f = indicators.BreakoutFold()
    seven(f, "1m")
    assert len(f.trade(500_000, 10_007, "a", 1)) == 1 and seven(f, "15s") == []  # the larger one has it, though it fired


def test_breakouts_over_tables(spark):
    r = random.Random(3)
    bars = []
    for token in (1, 2):
        for tf, ms in MS.items():
            at = 0
            for _ in range(40):
                at += ms * (2 if r.random() < 0.05 else 1)
                high = 1000 + r.randrange(30)
                bars.append((token, tf, at, at + ms, high, high - r.randrange(0, 25)))
    trades = [(1 + r.randrange(2), r.randrange(2_500_000), k, 960 + r.randrange(90), str(k)) for k in range(400)]
    c = spark.createDataFrame(bars, "token long, tf string, window_start long, window_end long, high_paise long, low_paise long")
    t = spark.createDataFrame(trades, "token long, event_time long, seq long, price_paise long, fingerprint string")
    got = sorted(tuple(x) for x in indicators.breakouts(c, t).collect())
    want = []
    for token in (1, 2):
        f, ring = indicators.BreakoutFold(), {}
        events = [(b[3], 0, b[3] - b[2], b) for b in bars if b[0] == token] + [(x[1], 1, x[2], x) for x in trades if x[0] == token]
        for _, kind, _, x in sorted(events, key=lambda e: e[:3]):
            if kind:
                want += [(token, *y) for y in f.trade(x[1], x[3], x[4], x[2])]
                continue
            _, tf, ws, we, high, low = x
            old = ring.get(tf, [])
            ring[tf] = (old if not old or ws - old[-1][0] <= we - ws else [])[-6:] + [(ws, high - low)]
            narrow = len(ring[tf]) == 7 and all(ring[tf][-1][1] < z for _, z in ring[tf][:-1])
            want += [(token, *y) for y in f.candle(tf, we - ws, ws, high, low, narrow)]
    assert got == sorted(want) and len(got) > 5 and any(x[6] for x in got)


# -- lifecycles -------------------------------------------------------------------------------------

REPORT = "account long, order_id long, arrival long, version long, event_id string, status string, cumulative_qty long, pending_qty long, fill_qty long, price_paise long"


@pytest.mark.parametrize(
    ("reports", "outcomes"),
    [
        ([(1, "e1", "PARTIAL", 10, 0, 10, 1000), (2, "e2", "FILLED", 10, 0, 0, 0)], ["APPLIED", "APPLIED"]),
        ([(1, "e1", "PARTIAL", 10, 0, 10, 1000)] * 2, ["APPLIED", "DUPLICATE"]),
        ([(2, "e2", "PARTIAL", 20, 0, 10, 1000), (1, "e1", "PARTIAL", 10, 0, 10, 1000)], ["APPLIED", "STALE"]),
        ([(1, "e1", "PARTIAL", 10, 0, 10, 1000), (1, "other", "PARTIAL", 10, 0, 10, 1000)], ["APPLIED", "CONFLICT"]),
        ([(1, "e1", "PARTIAL", 10, 0, 10, 1000), (1, "e1", "PARTIAL", 10, 5, 10, 1000)], ["APPLIED", "CONFLICT"]),
        ([(1, "e1", "FILLED", 10, 0, 0, 0), (2, "e2", "PENDING", 10, 10, 0, 0)], ["APPLIED", "REGRESSION"]),
        ([(1, "e1", "FILLED", 10, 0, 0, 0), (2, "e2", "FILLED", 5, 0, 0, 0)], ["APPLIED", "REGRESSION"]),
        ([(1, "e1", "FILLED", 10, 0, 0, 0), (2, "e2", "FILLED", 10, 0, 0, 0)], ["APPLIED", "APPLIED"]),
        ([(1, "e1", "PARTIAL", 5, 5, 5, 100), (2, "e2", "FILLED", 2, 0, 0, 0)], ["APPLIED", "REGRESSION"]),
        ([(1, "e1", "PARTIAL", 5, 5, 5, 100), (2, "e2", "PENDING", 5, 5, 0, 0), (3, "e3", "CANCELLED", 5, 0, 0, 0)], ["APPLIED", "REGRESSION", "APPLIED"]),
        ([(1, "e1", "PENDING", 5, 10, 0, 0)], ["IMPOSSIBLE_QUANTITY"]),
        ([(1, "e1", "PARTIAL", 10, 0, 11, 1000)], ["FILL_OVERRUN"]),
        ([(1, "e1", "NOT_A_STATE", 10, 0, 0, 0)], ["UNKNOWN_STATUS"]),
        ([(0, "e0", "PENDING", 10, 0, 0, 0), (-1, "e1", "PENDING", 10, 0, 0, 0)], ["APPLIED", "STALE_EVENT"]),
    ],
)
def test_lifecycles(spark, reports, outcomes):
    rows = [(1, 1, k, *r) for k, r in enumerate(reports)]
    got = sorted(folds.lifecycles(spark.createDataFrame(rows, REPORT)).collect(), key=lambda x: x.arrival)
    assert [x.reason if x.outcome == "UNKNOWN" else x.outcome for x in got] == outcomes


def test_average_fill_price(spark):
    rows = [(1, 1, 1, 1, "a", "PARTIAL", 10, 5, 10, 1000), (1, 1, 2, 2, "b", "FILLED", 15, 0, 5, 1300), (2, 1, 1, 1, "a", "PENDING", 0, 0, 0, 0)]
    got = {(x.account, x.arrival): x.avg_paise for x in folds.lifecycles(spark.createDataFrame(rows, REPORT)).collect()}
    assert got == {(1, 1): 1000, (1, 2): 1100, (2, 1): 0}


# -- leases, safety, positions ----------------------------------------------------------------------


def lease(spark, requests, booted=True):
    df = spark.createDataFrame([(1, k, *r) for k, r in enumerate(requests, 1)], "key long, seq long, action string, holder string, token long, at long, ttl long")
    return [(x.outcome, x.holder, x.fence) for x in sorted(folds.leases(df, booted).collect(), key=lambda x: x.seq)]


def test_leases(spark):
    got = lease(spark, [("acquire", "a", None, 1000, 5000), ("renew", "a", 1, 3000, 5000), ("renew", "a", 0, 3100, 5000), ("renew", "b", 1, 3100, 5000), ("acquire", "b", None, 7000, 5000), ("renew", "a", 1, 8000, 5000), ("acquire", "b", None, 8001, 5000)])
    assert got == [("ACQUIRED", "a", 1), ("RENEWED", "a", 1), ("CONFLICT", "a", 1), ("CONFLICT", "a", 1), ("CONFLICT", "a", 1), ("CONFLICT", "a", 1), ("ACQUIRED", "b", 7)]
    got = lease(spark, [("acquire", "a", None, 1000, 5000), ("revoke", "b", None, 2000, 0), ("revoke", "a", None, 9000, 0), ("revoke", "a", None, 9001, 0), ("renew", "a", 1, 9002, 5000), ("acquire", "b", None, 9003, 5000), ("halt", None, None, 9004, 0), ("renew", "b", 6, 9005, 5000), ("acquire", "a", None, 9006, 5000)])
    assert [x[0] for x in got] == ["ACQUIRED", "NOT_OWNER", "REVOKED", "ALREADY_CLEAR", "CONFLICT", "ACQUIRED", "HALTED", "CONFLICT", "ACQUIRED"]
    assert [x[2] for x in got] == [1, 1, 1, 1, 1, 6, 7, 7, 9]
    assert [x[0] for x in lease(spark, [("revoke", "a", None, 1, 0), ("acquire", "a", None, 1, 5), ("init", None, None, 1, 0), ("acquire", "a", None, 1, 5), ("init", None, None, 1, 0)], False)] == ["NOT_FOUND", "CONFLICT", "INITIALIZED", "ACQUIRED", "EXISTING"]


def test_safety(spark):
    events = [(5, "RECOVERED"), (5, "UNSAFE"), (5, "UNSAFE"), (4, "UNSAFE"), (6, "UNSAFE"), (6, "RECOVERED"), (7, "RECOVERED"), (7, "UNSAFE"), (6, "UNSAFE"), (8, "UNSAFE"), (-1, "UNSAFE")]
    want = ["IGNORED_NO_PRIOR_UNSAFE", "NEW_UNSAFE", "IGNORED_DUPLICATE", "IGNORED_STALE_EPOCH", "NEW_UNSAFE", "IGNORED_STALE_EPOCH", "RECOVERED", "IGNORED_DUPLICATE", "IGNORED_STALE_EPOCH", "NEW_UNSAFE", "MALFORMED"]
    df = spark.createDataFrame([(1, k, *e) for k, e in enumerate(events)], "key long, seq long, epoch long, status string")
    assert [x.outcome for x in sorted(folds.safety(df).collect(), key=lambda x: x.seq)] == want
    assignment = spark.createDataFrame([(1, "h1")], "key long, token_set_hash string")
    full = spark.createDataFrame([(1, 0, "OTHER", 2, "m", "h1"), (1, 1, "INGESTION", 1, "m", "h1"), (1, 2, "INGESTION", 2, "n", "h1"), (9, 3, "INGESTION", 2, "m", "h1"), (1, 4, "INGESTION", 2, "m", "h2"), (1, 5, "INGESTION", 2, "m", "h1")], "key long, seq long, source_component string, contract_version int, manifest_fingerprint string, token_set_hash string")
    got = folds.safety(full.withColumn("epoch", F.lit(3).cast("long")).withColumn("status", F.lit("UNSAFE")), assignment, "m").collect()
    assert [x.outcome for x in sorted(got, key=lambda x: x.seq)] == ["IGNORED_SOURCE_COMPONENT", "IGNORED_CONTRACT_VERSION", "IGNORED_MANIFEST_MISMATCH", "IGNORED_UNKNOWN_SLOT", "IGNORED_HASH_MISMATCH", "NEW_UNSAFE"]


def test_versions_of_positions(spark):
    fills = [(1, 1, -1, 1, "BUY", 1, 1), (1, 1, 0, 2, "BUY", 10, 100), (1, 1, 0, 3, "BUY", 1, 1), (1, 1, 5, 4, "BUY", 1, 1)]
    df = spark.createDataFrame(fills, "account long, token long, version long, event_id long, side string, qty long, price_paise long")
    got = {x.event_id: x.outcome for x in folds.positions(df).collect()}
    assert got == {1: "VIOLATION", 2: "APPLIED", 3: "VIOLATION", 4: "APPLIED"}


def test_lengths_are_utf16_units(spark):
    from tidewater.functions import identity

    assert spark.range(1).select(identity.length_join(F.lit("a😀é"), F.lit(None)).alias("j")).first().j == "4:a😀é|4:null"
