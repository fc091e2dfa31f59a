"""Identities: fingerprints, name-based ids and content hashes, JVM-side where built-ins reach."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def big_endian(x: Column) -> Column:
    """A long's eight bytes."""
    return F.unhex(F.lpad(F.hex(x.cast("long")), 16, "0"))


def event_fingerprint(*fields: Column) -> Column:
    """SHA-256 of the fields joined by a bar: longs as eight bytes, strings as UTF-8 (give those as binary)."""
    parts: list[Column] = []
    for f in fields:
        parts += [f, F.lit(b"|")]
    return F.sha2(F.concat(*parts[:-1]), 256)


def name_uuid(name: Column) -> Column:
    """The version 3 UUID of a name without namespace: its MD5 with version and variant set."""
    h = F.md5(name)
    variant = F.substring(F.lit("89ab"), F.pmod(F.conv(F.substring(h, 17, 1), 16, 10).cast("int"), F.lit(4)) + 1, F.lit(1))
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-3"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def length_join(*fields: Column) -> Column:
    """``length:value`` of each field (length in UTF-16 units), joined by bars; null is ``4:null``."""
    out = []
    for f in fields:
        s = F.coalesce(f.cast("string"), F.lit("null"))
        units = F.octet_length(F.encode(s, "UTF-16BE")) / 2  # characters beyond U+FFFF are two units
        out.append(F.concat(units.cast("int").cast("string"), F.lit(":"), s))
    return F.concat_ws("|", *out)


def content_hash(*fields: Column) -> Column:
    return F.sha2(length_join(*fields), 256)


def instruction_id(*fields: Column) -> Column:
    return F.concat(F.lit("ei-v1-"), content_hash(*fields))


def trade_context_id(*fields: Column) -> Column:
    return F.concat(F.lit("trade-v1-"), content_hash(*fields))


def set_hash(values: Column) -> Column:
    """SHA-256 of an array's distinct values in ascending order, joined by commas."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.array_distinct(values)), lambda x: x.cast("string")), ","), 256)


@F.pandas_udf(T.LongType())
def fnv1a_mod_million(s: pd.Series) -> pd.Series:
    """FNV-1a (64 bits, as a signed number) of a string's UTF-8, floor-modulo 10^6: built-ins have no wrapping multiplication."""

    def one(x):
        if x is None:
            return None
        h = 0xCBF29CE484222325
        for b in x.encode():
            h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        return (h - (1 << 64) if h >> 63 else h) % 1_000_000

    return s.map(one)


def source_version(receive_ms: Column, event_id: Column) -> Column:
    return receive_ms * 1_000_000 + fnv1a_mod_million(event_id)


def escaped(value: Column) -> Column:
    r"""``length:value`` with bars and backslashes escaped (length of the plain value in UTF-16 units); null is ``\0``."""
    text = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    units = (F.octet_length(F.encode(value, "UTF-16BE")) / 2).cast("int").cast("string")
    return F.coalesce(F.concat(units, F.lit(":"), text), F.lit("\\0"))


def bare(value: Column) -> Column:
    r"""A number as text; null is ``\0``."""
    return F.coalesce(value.cast("string"), F.lit("\\0"))


def _identity(version: str) -> list[Column]:
    c = F.col
    return [
        F.lit(version), c("token").cast("string"), escaped(c("symbol")), escaped(c("trade_context_id")), escaped(c("side")), c("quantity").cast("string"), bare(c("limit_price_paise")),
        escaped(c("order_type")), escaped(c("product_type")), escaped(c("strategy_version")),
    ]


def decision_id() -> Column:
    """The id of a trade decision by what it would execute."""
    return F.concat(F.lit("ins-v1-"), F.sha2(F.concat_ws("|", *_identity("tdi-v2")), 256))


def decision_hash() -> Column:
    """The hash of a trade decision's whole content."""
    c = F.col
    more = [
        *[escaped(c(n)) for n in ("candidate_id", "evaluation_id", "exchange", "strategy_id", "configuration_version")], bare(c("composite_score")),
        *[escaped(c(n)) for n in ("portfolio_id", "account_scope_id", "reservation_id", "reservation_version")], c("created_ts").cast("string"), bare(c("expiry_ts")),
        escaped(c("supersedes_instruction_id")), escaped(c("superseded_by_instruction_id")),
    ]
    return F.sha2(F.concat_ws("|", *_identity("tdc-v2"), *more), 256)


def map_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields as a JSON object of texts with sorted names (null is the empty text; ``<``, ``>``, ``&`` and the two
    line separators beyond ASCII are written as escapes)."""
    doc = F.to_json(F.struct(*[F.coalesce(fields[n].cast("string"), F.lit("")).alias(n) for n in sorted(fields)]))
    for sign in ("<", ">", "&", "\u2028", "\u2029"):
        doc = F.replace(doc, F.lit(sign), F.lit(f"\\u{ord(sign):04x}"))
    return F.sha2(doc, 256)
