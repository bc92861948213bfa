"""Scalar functions of the ledger model as column expressions (SCL-01 to SCL-31, UDF-01)."""

from __future__ import annotations

from collections.abc import Mapping
from decimal import ROUND_HALF_EVEN, Decimal, InvalidOperation, localcontext

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .exact import let

#: Confirmations after which a block counts as final; fixed values.
FINALITY = {"ethereum": 64, "bitcoin": 6}
DEFAULT_FINALITY = 64


def lookup(values: Mapping[str, object], key: Column) -> Column:
    """The value of a fixed map at key, null where it has none."""
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def canonical_address(chain: Column, address: Column) -> tuple[Column, Column]:
    """SCL-01: (canonical form, error). Hex and bech32 addresses in lower case, base58 as it is; malformed hex is an error."""
    a = F.trim(address)
    evm = ~chain.isin("bitcoin")
    good = a.rlike("^0x[0-9a-fA-F]{40}$")
    form = F.when(evm, F.when(good, F.lower(a))).when(F.lower(a).rlike("^(bc1|tb1|bcrt1)"), F.lower(a)).otherwise(a)
    return form, F.when(a.isNull() | (a == ""), "empty address").when(evm & ~good, "malformed hex address")


def to_canonical_ts(raw: Column) -> Column:
    """SCL-02: epoch seconds or ISO text as a timestamp; text without an offset is UTC; anything else is null."""
    digits = F.trim(raw).rlike(r"^\d+$")
    return F.coalesce(F.timestamp_seconds(F.when(digits, F.trim(raw)).try_cast("bigint")), F.try_to_timestamp(F.when(~digits, F.trim(raw))))


def detect_chain(address: Column) -> Column:
    """SCL-03: the family an address form belongs to."""
    return F.when(address.rlike("^0x[0-9a-fA-F]{40}$"), "evm").when(address.rlike("^(bc1[0-9a-z]{8,87}|[13][1-9A-HJ-NP-Za-km-z]{25,39})$"), "bitcoin").otherwise("unknown")


def confirmations(tip: Column, height: Column) -> Column:
    """SCL-04: blocks on top of a height, itself included; 0 without a height."""
    return F.coalesce(F.greatest(F.lit(0).cast("long"), tip - height + 1), F.lit(0).cast("long"))


def finality_threshold(chain: Column) -> Column:
    return F.coalesce(lookup(FINALITY, chain), F.lit(DEFAULT_FINALITY))


def finality(chain: Column, confirmed: Column) -> Column:
    """SCL-04: final from the chain's number of confirmations on."""
    return F.when(confirmed >= finality_threshold(chain), "final").otherwise("provisional")


def shift_point(units: Column, places: int) -> Column:
    """An integer (as decimal or text) with the decimal point `places` digits from the right, as text."""
    text = units.cast("string")
    sign, digits = F.when(text.startswith("-"), "-").otherwise(""), F.regexp_replace(text, "^-", "")
    padded = F.when(F.length(digits) > places, digits).otherwise(F.lpad(digits, places + 1, "0"))
    return F.concat(sign, F.substring(padded, F.lit(1), F.length(padded) - places), F.lit("."), F.substring(padded, -places, places))


@F.pandas_udf(StringType())
def exact_value(amount: pd.Series, decimals: pd.Series, price: pd.Series) -> pd.Series:
    """UDF-01: amount / 10^decimals x price with one half-even rounding at 18 places, for numbers of any size."""

    def value(a, d, p):
        if a is None or d is None or p is None or d != d:
            return None
        with localcontext() as c:
            c.prec = 400
            try:
                return format((Decimal(a).scaleb(-int(d)) * Decimal(p)).quantize(Decimal(1).scaleb(-18), ROUND_HALF_EVEN), "f")
            except InvalidOperation:
                return None

    return pd.Series([value(*r) for r in zip(amount, decimals, price)], dtype=object)


@F.pandas_udf(StringType())
def exact_unit_price(total: pd.Series, amount: pd.Series, decimals: pd.Series) -> pd.Series:
    """SCL-06: total / (amount / 10^decimals) at 18 places, half-even; null for a zero amount."""

    def price(t, a, d):
        if t is None or a is None or d is None or d != d:
            return None
        with localcontext() as c:
            c.prec = 400
            try:
                human = Decimal(a).scaleb(-int(d))
                return format((Decimal(t) / human).quantize(Decimal(1).scaleb(-18), ROUND_HALF_EVEN), "f") if human else None
            except InvalidOperation:
                return None

    return pd.Series([price(*r) for r in zip(total, amount, decimals)], dtype=object)


def compute_value(amount: Column, decimals: int, price: Column) -> Column:
    """SCL-05: the exact value of a base-unit amount at a unit price of eight places, as text with 18 places.

    Whole numbers of price units are multiplied in DECIMAL(38,0), so no digit is lost; where that overflows the result is
    null, and exact_value gives it.
    """
    units = F.try_multiply(amount.try_cast("decimal(38,0)"), (price.cast("decimal(28,8)") * F.lit(100_000_000)).cast("decimal(28,0)")).try_cast("decimal(38,0)")
    spare = 10 - decimals
    if spare >= 0:
        return shift_point(F.try_multiply(units, F.lit(10**spare).cast(f"decimal({spare + 1},0)")).try_cast("decimal(38,0)"), 18)
    text = F.bround(units, spare).cast("string")
    whole = F.substring(text, F.lit(1), F.length(text) + spare)
    return shift_point(F.when(whole.isin("", "-"), "0").otherwise(whole), 18)


def to_base_units(display: Column, decimals: Column) -> Column:
    """SCL-07: struct(amount text, rounded, truncation_risk) of a displayed decimal amount; half-even to a whole number."""
    def units(part: Column) -> Column:
        whole, fraction = part["whole"], part["fraction"]
        exact = F.concat(whole, F.rpad(fraction, 60, "0")).substr(F.lit(1), F.length(whole) + decimals)
        rounded = F.length(fraction) > decimals
        by_rule = F.bround(F.concat(whole, F.substring(F.rpad(fraction, 60, "0"), F.lit(1), decimals), F.lit("."), F.substring(fraction, decimals + 1, F.length(fraction))).try_cast("decimal(38,18)"), 0).cast("decimal(38,0)").cast("string")
        amount = F.when(rounded, by_rule).otherwise(F.coalesce(F.nullif(F.regexp_replace(exact, "^(-?)0+(?=.)", "$1"), F.lit("")), F.lit("0")))
        return F.struct(amount.alias("amount"), rounded.alias("rounded"), ((F.length(fraction) < decimals) & (F.length(fraction) > 0)).alias("truncation_risk"))

    def parts(clean: Column) -> Column:
        split = F.split(clean, r"\.")
        return F.struct(split[0].alias("whole"), F.regexp_replace(F.coalesce(F.try_element_at(split, F.lit(2)), F.lit("")), "0+$", "").alias("fraction"))

    return let(F.regexp_replace(F.trim(display), ",", ""), lambda clean: F.when(clean.rlike(r"^-?\d+(\.\d*)?$"), let(parts(clean), units)))


def format_amount(amount: Column, decimals: int, symbol: Column) -> Column:
    """SCL-08: at most eight places, zeros at the end trimmed, and the symbol."""
    number = F.bround((amount.cast("decimal(38,0)") / F.lit(10**decimals).cast("decimal(20,0)")).cast("decimal(38,10)"), 8).cast("string")
    return F.concat_ws(" ", F.regexp_replace(F.regexp_replace(number, r"(\.\d*?)0+$", "$1"), r"\.$", ""), symbol)


def usd_label(value: Column) -> Column:
    """SCL-09: '$1,234.56' from one dollar on, below that four significant digits without zeros at the end; null stays null."""
    places = F.greatest(F.lit(3) - F.floor(F.log10(F.abs(value))).cast("int"), F.lit(0))
    text = F.format_number(value, 12)
    fine = F.regexp_replace(F.regexp_replace(F.substring(text, F.lit(1), F.lit(2) + places), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(value >= 1, F.concat(F.lit("$"), F.format_number(value, 2))).when(value == 0, "$0").when(value.isNotNull(), F.concat(F.lit("$"), fine))


def short(text: Column) -> Column:
    """SCL-10: first four, ellipsis, last four of anything longer than nine characters."""
    return F.when(F.length(text) > 9, F.concat(F.substring(text, 1, 4), F.lit("…"), F.substring(text, -4, 4))).otherwise(text)


def cap(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 1), F.lit("…"))).otherwise(text)


def script_type(address: Column) -> Column:
    """SCL-11: output script type by the form of a UTXO address."""
    a = F.lower(address)
    return (
        F.when(a.startswith("bc1p"), "p2tr").when(a.startswith("bc1"), F.when(F.length(address) <= 45, "p2wpkh").otherwise("p2wsh"))
        .when(F.substring(address, 1, 1).isin("1", "m", "n"), "p2pkh").when(F.substring(address, 1, 1).isin("3", "2"), "p2sh").otherwise("other")
    )


def topic_address(topic: Column) -> Column:
    """SCL-12: the address in an indexed topic: its last 40 hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.right(topic, F.lit(40))))


def address_topic(address: Column) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.regexp_replace(F.lower(address), "^0x", ""), 64, "0"))


def trace_key(trace_id: Column) -> Column:
    """SCL-13: hierarchical ids as arrays of numbers, which order as the hierarchy does; a bad part is 0."""
    return F.transform(F.split(trace_id, "_"), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))


def entity_name(first: Column, last: Column, kind: Column) -> Column:
    """SCL-14: 'Last, First' for individuals, else the last name alone."""
    return F.when(kind == "Individual", F.nullif(F.concat_ws(", ", last, first), F.lit(""))).otherwise(last)


def truthy(text: Column) -> Column:
    """SCL-16: false for null and the usual words for no."""
    return F.coalesce(~F.lower(F.trim(text)).isin("", "0", "false", "no", "none", "null", "n"), F.lit(False))


def note(*parts: Column) -> Column:
    """SCL-17: parts that are there, joined by a spaced bar; null if none is."""
    return F.nullif(F.concat_ws(" | ", *parts), F.lit(""))


def lookalike_key(address: Column) -> Column:
    """SCL-19: first and last four hex digits of a 0x address; null for other forms."""
    a = F.lower(address)
    return F.when(a.startswith("0x") & (F.length(a) >= 10), F.concat(F.substring(a, 3, 4), F.lit("-"), F.substring(a, -4, 4)))


def change_confidence(votes: Column) -> Column:
    """SCL-20: grows with the agreeing heuristics, up to 0.85."""
    return F.round(F.least(F.lit(0.85), F.lit(0.4) + F.lit(0.15) * votes), 3)


def price_key(chain: Column, contract: Column, native_ids: Mapping[str, str]) -> Column:
    """SCL-21: chain:contract for tokens, the feed's id for native assets, null for unknown chains."""
    return F.when(contract.isNotNull(), F.concat(chain, F.lit(":"), F.lower(contract))).otherwise(F.concat(F.lit("coingecko:"), lookup(native_ids, chain)))


def is_failed(is_error: Column, text: Column) -> Column:
    """SCL-23: an error flag of 1, or a status text that says error or fail."""
    return F.coalesce(is_error == "1", F.lit(False)) | F.coalesce(F.lower(text).rlike("error|fail") | (F.trim(text) == "1"), F.lit(False))


def cluster_name(origin: Column, kind: Column, n: Column) -> Column:
    """SCL-24: a display name for an unnamed cluster."""
    by_kind = lookup({"evm-deposit-reuse": "Deposit-reuse cluster", "evm-airdrop": "Airdrop cluster", "btc-change": "Change cluster", "co-spend": "Co-spend cluster"}, kind)
    return F.concat(F.coalesce(by_kind, F.concat(F.initcap(origin), F.lit(" cluster")), F.lit("Cluster")), F.lit(" ("), n.cast("string"), F.when(n == 1, " address)").otherwise(" addresses)"))


def clip(text: Column, n: int = 80) -> Column:
    """SCL-25: trimmed, null if empty, cut with an ellipsis."""
    return cap(F.nullif(F.trim(text), F.lit("")), n)


def row_hash(*names: str) -> Column:
    """SCL-26: SHA-256 of the row as JSON, keys in order, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


def valuation_state(value: Column, moved: Column) -> Column:
    """SCL-27: valued, unvalued, or none where nothing moved."""
    return F.when(~moved, "none").when(value.isNull(), "unvalued").otherwise("valued")


def parse_edition_date(text: Column) -> Column:
    """SCL-29: month/day/year; null if it is no date."""
    return F.try_to_timestamp(text, F.lit("M/d/yyyy")).cast("date")


def concise_method(method: Column) -> Column:
    """SCL-31: 'change:h1+h2@agree>=N' as a short label."""
    parts = F.regexp_extract(method, r"^change:([^@]+)", 1)
    agree = F.regexp_extract(method, r"agree>=(\d+)", 1)
    return F.when(parts != "", F.concat(F.size(F.split(parts, r"\+")).cast("string"), F.lit(" change heuristics"), F.when(agree != "", F.concat(F.lit(", "), agree, F.lit(" agree"))).otherwise(""))).otherwise(method)
