"""Order-book scalars over five-level ladders (arrays of whole prices and quantities, best level first)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEVELS = 5


def div(a: Column, b: Column | int) -> Column:
    """Whole-number division that drops the remainder."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b).cast("long"))


def ladder(a: Column) -> Column:
    """The first five levels; missing ones are 0."""
    return F.transform(F.sequence(F.lit(0), F.lit(LEVELS - 1)), lambda i: F.coalesce(F.get(a, i), F.lit(0).cast("long")))


def total(qty: Column) -> Column:
    return F.aggregate(qty, F.lit(0).cast("long"), lambda s, x: s + x)


def spread(bid_px: Column, ask_px: Column) -> Column:
    b, a = F.get(bid_px, F.lit(0)), F.get(ask_px, F.lit(0))
    return F.when((b <= 0) | (a <= 0), F.lit(0).cast("long")).otherwise(a - b)


def imbalance(bid_qty: Column, ask_qty: Column) -> Column:
    """(bids - asks) / (bids + asks) over all levels; null without quantity."""
    b, a = total(bid_qty), total(ask_qty)
    return F.when(b + a != 0, (b - a) / (b + a))


def microprice(bid_px: Column, ask_px: Column, bid_qty: Column, ask_qty: Column) -> Column:
    """Best prices weighted by the other side's best quantity, rounded; 0 unless all four are positive."""
    b, a, p, q = (F.get(x, F.lit(0)) for x in (bid_px, ask_px, bid_qty, ask_qty))
    return F.when((b > 0) & (a > 0) & (p > 0) & (q > 0), div(b * q + a * p + div(p + q, 2), p + q)).otherwise(F.lit(0).cast("long"))


def walk(px: Column, qty: Column, want: Column) -> Column:
    """Rounded mean price of taking ``want`` from the levels in order (levels without price or quantity are passed over); null if they don't hold it or nothing is wanted."""
    zero = F.lit(0).cast("long")
    take = lambda s, l: F.when((l["p"] > 0) & (l["q"] > 0), F.least(s["left"], l["q"])).otherwise(zero)  # noqa: E731, E741
    end = F.aggregate(
        F.arrays_zip(px.alias("p"), qty.alias("q")), F.struct(want.cast("long").alias("left"), zero.alias("cost")),
        lambda s, l: F.struct((s["left"] - take(s, l)).alias("left"), (s["cost"] + take(s, l) * F.coalesce(l["p"], zero)).alias("cost")),  # noqa: E741
    )
    return F.when((want > 0) & (end["left"] == 0), div(end["cost"] + div(want.cast("long"), 2), want.cast("long")))


def slippage(best: Column, mean: Column, buy: Column) -> Column:
    return F.when(buy, mean - best).otherwise(best - mean)


def has_level(px: Column, qty: Column, level: int = 0) -> Column:
    return (F.coalesce(F.get(px, F.lit(level)), F.lit(0)) > 0) & (F.coalesce(F.get(qty, F.lit(level)), F.lit(0)) > 0)


def age_ms(now: Column, seen: Column) -> Column:
    """0 if seen now or later; the largest long if never."""
    return F.when(seen.isNull() | (seen <= 0), F.lit(2**63 - 1)).otherwise(F.greatest(F.lit(0).cast("long"), now - seen))
