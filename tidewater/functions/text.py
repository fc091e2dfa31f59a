"""Vocabulary and text rules: states, outcomes, redaction, classification."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Order states by their synonyms.
LIFECYCLE_STATES = {
    "ACCEPTED": "PENDING", "NEW": "PENDING", "NEWACK": "PENDING", "OPEN": "PENDING", "PENDING": "PENDING", "PARTIALLY_FILLED": "PARTIALLY_FILLED",
    "COMPLETE": "FILLED", "FILLED": "FILLED", "CANCELED": "CANCELLED", "CANCELLED": "CANCELLED", "REJECTED": "REJECTED",
}


def lookup(x: Column, table: dict[str, str], other: str) -> Column:
    m = F.create_map(*[F.lit(v) for v in chain.from_iterable(table.items())])
    return F.coalesce(F.element_at(m, F.upper(F.trim(x))), F.lit(other))


def lifecycle_state(x: Column) -> Column:
    return lookup(x, LIFECYCLE_STATES, "UNKNOWN")


def postback_event(status: Column, report: Column, fill_qty: Column) -> Column:
    """Event type of a report, first match first: rejected, canceled, fill, complete with a quantity, ack, unknown."""
    s, r = F.lower(F.trim(F.coalesce(status, F.lit("")))), F.lower(F.trim(F.coalesce(report, F.lit(""))))
    return (
        F.when((s == "rejected") | (r == "rejected"), "rejected").when(s.isin("canceled", "cancelled") | r.isin("canceled", "cancelled"), "canceled")
        .when(r == "fill", "fill").when((s == "complete") & (F.coalesce(fill_qty, F.lit(0)) > 0), "fill").when(r.isin("newack", "ack") | (s == "open"), "ack").otherwise("unknown")
    )


def outcome(event: Column) -> Column:
    return F.when(event.isin("fill", "ack", "canceled"), "success").when(event == "rejected", "rejected").otherwise("unknown")


def redact(x: Column, most: int = 512) -> Column:
    """Secrets after a key word are masked; at most ``most`` characters stay."""
    return F.substring(F.regexp_replace(x, r"(?i)(token|secret|password|authorization)(\s*[=:]\s*)\S+", "$1$2***"), 1, most)


def retry_class(message: Column) -> Column:
    """FATAL before REJECTED before RETRYABLE, by what the message says; UNKNOWN otherwise."""
    m = F.lower(F.coalesce(message, F.lit("")))
    has = lambda *ws: m.rlike("|".join(ws))
    return F.when(has("authoriz", "schema", "not exist", "corrupt"), "FATAL").when(has("too large", "invalid", "reject"), "REJECTED").when(has("timeout", "timed out", "unavailable", "retry", "network", "disconnect"), "RETRYABLE").otherwise("UNKNOWN")


def response_class(status: Column, body_status: Column) -> Column:
    """success, rejected or unknown of an HTTP status and the body's own word; if they contradict each other: unknown."""
    ok, said = status.between(200, 299), F.lower(F.coalesce(body_status, F.lit("")))
    return F.when(ok & (said == "success"), "success").when(status.between(400, 499) & (said != "success") & ~status.isin(408, 429), "rejected").when(ok & said.isin("error", "rejected", "failure"), "rejected").otherwise("unknown")
