"""State machines: deterministic folds over ordered events of a key, and their transition tables.

Rows are hash-partitioned by key and sorted; the fold streams over them, so a key's state is a few numbers and its
events are never held together.
"""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Allowed transitions.
POSITION = {"FLAT": ["OPEN"], "OPEN": ["REDUCING", "CLOSED"], "REDUCING": ["OPEN", "CLOSED"], "CLOSED": ["OPEN"]}
ATTEMPT = {"PREPARED": ["SUBMITTING"], "SUBMITTING": ["ACCEPTED", "REJECTED", "CANCELLED", "UNKNOWN"], "UNKNOWN": ["ACCEPTED", "REJECTED", "CANCELLED"]}
GATE = {"HALTED": ["RECONCILING"], "RECONCILING": ["APPROVAL_PENDING", "HALTED"], "APPROVAL_PENDING": ["ENABLED", "HALTED"], "ENABLED": ["HALTED"]}
LEDGER = {
    "RECEIVED": ["CORRELATED", "QUARANTINED", "FAILED"], "CORRELATED": ["AUDIT_WRITTEN", "QUARANTINED", "FAILED"], "AUDIT_WRITTEN": ["LIFECYCLE_APPLIED", "QUARANTINED", "FAILED"],
    "LIFECYCLE_APPLIED": ["POSITION_APPLIED", "QUARANTINED", "FAILED"], "POSITION_APPLIED": ["COMPLETE", "QUARANTINED", "FAILED"],
}
WORK_CHAIN = ["OPEN", "DOCUMENTING", "DOCUMENTATION_READY", "APPROVED_FOR_IMPLEMENTATION", "IMPLEMENTED", "VERIFIED", "STRUCK_THROUGH"]
RESERVATION_STATES = ["RESERVED", "SUBMITTING", "PENDING", "OPEN", "RELEASE_PENDING", "RELEASED", "UNKNOWN"]
OFFLOAD = {"PENDING": ["WRITING"], "WRITING": ["COMMITTED", "FAILED"], "COMMITTED": ["VERIFYING"], "VERIFYING": ["VERIFIED", "FAILED"], "FAILED": ["PENDING", "MANUAL"]}

#: A work item goes one step along its chain, or is blocked; a blocked one goes anywhere; the chain's last state is final.
WORK_ITEM = {a: [b, "BLOCKED"] for a, b in zip(WORK_CHAIN, WORK_CHAIN[1:], strict=False)} | {"BLOCKED": [*WORK_CHAIN, "BLOCKED"]}


def allowed(table: dict[str, list[str]], a: Column, b: Column) -> Column:
    """Whether a transition stands in the table."""
    return F.concat_ws(">", a, b).isin(*[f"{x}>{y}" for x, ys in table.items() for y in ys])


def _rows(b: pd.DataFrame) -> Iterator[Any]:
    """Rows as plain Python values; nulls are None."""
    make = namedtuple("Row", b.columns)  # noqa: PYI024
    cols = [[None if v is pd.NA or v != v else v for v in b[c].tolist()] if b[c].hasnans else b[c].tolist() for c in b.columns]
    return map(make, *cols)


def fold(df: DataFrame, keys: list[str], order: list[str], start: Callable[[], Any], step: Callable[[Any, Any], tuple[Any, tuple]], schema: str) -> DataFrame:
    """``step(state, row) -> (state, output)`` over each key's rows in order."""
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state = None, None
        for b in batches:
            out = []
            for r in _rows(b):
                key = tuple([getattr(r, k) for k in keys])
                if key != now:
                    now, state = key, start()
                state, got = step(state, r)
                out.append(got)
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


LONG = 2**63 - 1


def mean(price: int, qty: int, new_price: int, new_qty: int) -> int | None:
    """Weighted whole-number mean, dropping the remainder; null where 64 bits don't hold it."""
    whole = price * qty + new_price * new_qty
    return None if whole > LONG or qty + new_qty > LONG else whole // (qty + new_qty)


def positions(fills: DataFrame) -> DataFrame:
    """Each fill (account, token, version, event_id, side, qty, price_paise) with the position it leads to.

    A buy adds to what is open and re-averages the entry over what is still held; a sell adds to what is closed and
    averages the exit; selling more than is held is a VIOLATION, and so are negative versions and versions not newer of another
    event (of the same one they are DUPLICATE or STALE). A buy after CLOSED begins the next cycle."""

    def step(s, r):
        cycle, version, event, state, opened, closed, entry, exit_, _ = s
        if r.version < 0 or version is not None and r.version <= version:
            known = version is not None and r.version >= 0 and r.event_id == event
            word = "VIOLATION" if not known else "STALE" if r.version < version else "DUPLICATE"
        elif r.side == "BUY":
            if state == "CLOSED":
                cycle, opened, closed, entry, exit_ = cycle + 1, 0, 0, 0, 0
            avg = mean(entry, opened - closed, r.price_paise, r.qty)
            word = "VIOLATION" if avg is None else "APPLIED"
            if avg is not None:
                opened, entry, state = opened + r.qty, avg, "OPEN" if not closed else "REDUCING"
        elif opened - closed < r.qty:
            word = "VIOLATION"
        else:
            avg = mean(exit_, closed, r.price_paise, r.qty)
            word = "VIOLATION" if avg is None else "APPLIED"
            if avg is not None:
                closed, exit_ = closed + r.qty, avg
                state = "CLOSED" if closed == opened else "REDUCING"
        if word == "APPLIED":
            version, event = r.version, r.event_id
        s = (cycle, version, event, state, opened, closed, entry, exit_, word)
        return s, (r.account, r.token, r.version, r.event_id, f"pos-{r.account}-{r.token}-BUY-{cycle}", word, state, opened, closed, entry, exit_)

    start = lambda: (1, None, None, "FLAT", 0, 0, 0, 0, "")
    out = "account long, token long, version long, event_id long, position_id string, outcome string, state string, open_qty long, closed_qty long, entry_paise long, exit_paise long"
    return fold(fills, ["account", "token"], ["version", "event_id"], start, step, out)


#: How far along an order state is, and those that end an order.
RANK = {"UNKNOWN": 0, "SUBMITTING": 1, "PENDING": 2, "PARTIAL": 3, "FILLED": 4, "CANCELLED": 5, "REJECTED": 5}
FINAL = {"FILLED", "CANCELLED", "REJECTED"}


def lifecycles(reports: DataFrame) -> DataFrame:
    """Each report (account, order_id, arrival, version, event_id, status, cumulative_qty, pending_qty, fill_qty, price_paise) with
    its outcome, the reason if it isn't clean, and the order after it.

    Quantities that can't be and unknown states are UNKNOWN; a first report is taken; then versions decide (equal ones are
    DUPLICATE if event, state and quantities are the same, else CONFLICT); of newer ones a smaller cumulative quantity, another
    state after a final one, and a lower state that isn't final are REGRESSION. Fills average into the price by quantity."""

    def step(s, r):
        word = reason = None
        if s is not None:
            version, event, status, done, pending, avg = s
            same = (event, status, done, pending) == (r.event_id, r.status, r.cumulative_qty, r.pending_qty)
        if r.cumulative_qty < r.pending_qty or r.cumulative_qty < 0 or r.pending_qty < 0:
            word, reason = "UNKNOWN", "IMPOSSIBLE_QUANTITY"
        elif r.fill_qty > r.cumulative_qty:
            word, reason = "UNKNOWN", "FILL_OVERRUN"
        elif r.status not in RANK:
            word, reason = "UNKNOWN", "UNKNOWN_STATUS"
        elif s is None:
            pass
        elif r.version < 0 or version < 0:
            word, reason = "UNKNOWN", "STALE_EVENT"
        elif r.version == version:
            word, reason = ("DUPLICATE", None) if same else ("CONFLICT", "LIFECYCLE_CONFLICT")
        elif r.version < version:
            word, reason = "STALE", "STALE_EVENT"
        elif r.cumulative_qty < done or (r.status != status if status in FINAL else RANK[r.status] < RANK[status] and r.status not in FINAL):
            word, reason = "REGRESSION", "TERMINAL_REGRESSION"
        if word is None:
            word, filled = "APPLIED", r.fill_qty > 0 and r.price_paise > 0
            before, old = (s[3], s[5]) if s is not None else (0, 0)
            if filled:
                old = r.price_paise if before == 0 else (before * old + r.fill_qty * r.price_paise) // (before + r.fill_qty)
            s = (r.version, r.event_id, r.status, r.cumulative_qty, r.pending_qty, old)
        now = s or (None, None, None, None, None, None)
        return s, (r.account, r.order_id, r.arrival, r.version, word, reason, now[2], now[3], now[4], now[5])

    out = "account long, order_id long, arrival long, version long, outcome string, reason string, state string, cumulative_qty long, pending_qty long, avg_paise long"
    return fold(reports, ["account", "order_id"], ["arrival"], lambda: None, step, out)


def machine(events: DataFrame, table: dict[str, list[str]], first: str) -> DataFrame:
    """Each event (key, seq, target) with whether it was taken, and the state after it."""

    def step(s, r):
        ok = r.target in table.get(s, [])
        s = r.target if ok else s
        return s, (r.key, r.seq, r.target, ok, s)

    return fold(events, ["key"], ["seq"], lambda: first, step, "key long, seq long, target string, taken boolean, state string")


def leases(events: DataFrame, booted: bool = True) -> DataFrame:
    """Each request (key, seq, action, holder, token, at, ttl) with its outcome, and the holder and fence token after it.

    ``init`` makes a key known (all are, if ``booted``). ``acquire`` of a free, expired or one's own lease is ACQUIRED with a new
    token; ``renew`` by its holder with the current token, before it expires, is RENEWED (the token stays); all else is CONFLICT.
    ``revoke`` is REVOKED by the holder, expired or not (the token stays), NOT_OWNER by others, ALREADY_CLEAR or NOT_FOUND.
    ``halt`` clears the lease under a new token. Tokens are the granting requests' ``seq``, one rising sequence over all keys."""

    def step(s, r):
        known, holder, until, fence = s
        live = holder is not None and r.at < until
        if r.action == "init":
            word, known = "EXISTING" if known else "INITIALIZED", True
        elif not known:
            word = "NOT_FOUND" if r.action == "revoke" else "CONFLICT"
        elif r.action == "acquire":
            word = "CONFLICT" if live and holder != r.holder else "ACQUIRED"
            if word == "ACQUIRED":
                holder, until, fence = r.holder, r.at + r.ttl, r.seq
        elif r.action == "renew":
            word = "RENEWED" if live and holder == r.holder and r.token == fence else "CONFLICT"
            until = r.at + r.ttl if word == "RENEWED" else until
        elif r.action == "revoke":
            word = "ALREADY_CLEAR" if holder is None else "REVOKED" if holder == r.holder else "NOT_OWNER"
            holder, until = (None, 0) if word == "REVOKED" else (holder, until)
        else:
            word, holder, until, fence = "HALTED", None, 0, r.seq
        return (known, holder, until, fence), (r.key, r.seq, word, holder, fence)

    return fold(events, ["key"], ["seq"], lambda: (booted, None, 0, 0), step, "key long, seq long, outcome string, holder string, fence long")


#: What a safety request must say of its source and contract.
SOURCE, CONTRACT = "INGESTION", 2


def safety(events: DataFrame, assignment: DataFrame | None = None, manifest: str | None = None) -> DataFrame:
    """Each request (key, seq, epoch, status: UNSAFE or RECOVERED) of a slot's safety with its outcome, and the slot after it.

    Requests may carry source_component, contract_version, manifest_fingerprint and token_set_hash; those that fail a gate (in this
    order; the last two against ``manifest`` and the ``assignment``'s key and token_set_hash) change nothing. UNSAFE opens at a first
    or newer epoch; RECOVERED closes it at a newer one only."""
    x = events
    gate = F.lit(None).cast("string")
    if assignment is not None:
        x = x.join(assignment.select("key", F.col("token_set_hash").alias("_h")), "key", "left")
        gate = F.when(F.col("_h").isNull(), "IGNORED_UNKNOWN_SLOT").when(~F.col("_h").eqNullSafe(F.col("token_set_hash")), "IGNORED_HASH_MISMATCH")
    for name, bad, word in (
        ("manifest_fingerprint", ~F.col("manifest_fingerprint").eqNullSafe(F.lit(manifest)) if manifest else F.lit(False), "IGNORED_MANIFEST_MISMATCH"),
        ("contract_version", ~F.col("contract_version").eqNullSafe(F.lit(CONTRACT)), "IGNORED_CONTRACT_VERSION"), ("source_component", ~F.col("source_component").eqNullSafe(F.lit(SOURCE)), "IGNORED_SOURCE_COMPONENT"),
    ):
        if name in events.columns:
            gate = F.when(bad, word).otherwise(gate)
    x = x.select("key", "seq", F.coalesce("epoch", F.lit(-1)).cast("long").alias("epoch"), "status", gate.alias("gate"))

    def step(s, r):
        epoch, status = s
        if r.gate:
            word = r.gate
        elif r.epoch < 0 or r.status not in ("UNSAFE", "RECOVERED"):
            word = "MALFORMED"
        elif r.status == "UNSAFE":
            word = "NEW_UNSAFE" if status is None or r.epoch > epoch else "IGNORED_DUPLICATE" if r.epoch == epoch else "IGNORED_STALE_EPOCH"
        else:
            word = "IGNORED_NO_PRIOR_UNSAFE" if status != "UNSAFE" else "RECOVERED" if r.epoch > epoch else "IGNORED_STALE_EPOCH"
        if word in ("NEW_UNSAFE", "RECOVERED"):
            epoch, status = r.epoch, r.status
        return (epoch, status), (r.key, r.seq, word, epoch, status)

    return fold(x, ["key"], ["seq"], lambda: (-1, None), step, "key long, seq long, outcome string, epoch long, status string")
