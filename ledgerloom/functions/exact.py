"""Exact whole numbers of up to 90 digits as native columns: amounts of 256 bits come as text and are summed, compared and subtracted as limbs.

A number is an array of five longs, base 10^18, most significant first; all but the first lie in [0, 10^18), the first carries the sign. Arrays of
one length are ordered by their elements, so Spark's own comparisons, min, max and sorting hold for them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LIMBS, DIGITS = 5, 18
_BASE = "1" + "0" * DIGITS
_UNIT, _HALF = 10**DIGITS, 10 ** (DIGITS // 2)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), 0)


def _base() -> Column:
    return F.lit(_BASE).cast("decimal(19,0)")


def carried(parts: list[Column]) -> Column:
    """A number from five parts of up to 36 digits and either sign, most significant first; null if one is null."""
    zero = F.lit(0).cast("decimal(38,0)")
    low_first = F.array(*(p.cast("decimal(38,0)") for p in reversed(parts[1:])))

    def step(state: Column, part: Column) -> Column:
        return let((part + state["carry"]).cast("decimal(38,0)"), lambda x: F.struct(
            ((x - F.pmod(x, _base())).cast("decimal(38,0)") / _base()).cast("decimal(38,0)").alias("carry"),
            F.concat(F.array(F.pmod(x, _base()).cast("long")), state["limbs"]).alias("limbs"),
        ))

    low = F.aggregate(low_first, F.struct(zero.alias("carry"), F.array().cast("array<long>").alias("limbs")), step)
    whole = let(low, lambda s: F.concat(F.array((parts[0].cast("decimal(38,0)") + s["carry"]).cast("long")), s["limbs"]))
    missing = parts[0].isNull()
    for p in parts[1:]:
        missing = missing | p.isNull()
    return F.when(~missing, whole)


def _settled(parts: list[Column]) -> Column:
    """carried() for parts that are sums or differences of two limbs: these fit a long, so that no decimal is made. A part that is null makes the first limb null."""
    low, carry = [], None
    for part in reversed(parts[1:]):
        whole = part if carry is None else part + carry
        low.insert(0, F.pmod(whole, F.lit(_UNIT)))
        carry = F.call_function("div", whole + F.lit(4 * _UNIT), F.lit(_UNIT)) - 4  # rounds down, whatever the sign
    limbs = F.array(parts[0] + carry, *low)
    return F.when(F.get(limbs, 0).isNotNull(), limbs)


def parse(text: Column) -> Column:
    """The number that a text says: digits with an optional sign, spaces around allowed. Null for other texts and for more than 90 digits."""
    clean = F.trim(text.cast("string"))
    digits = F.regexp_extract(clean, rf"^[+-]?0*(\d{{1,{LIMBS * DIGITS}}})$", 1)

    def limbs(d: Column) -> Column:
        padded = F.lpad(d, LIMBS * DIGITS, "0")
        return F.array(*(F.substring(padded, 1 + DIGITS * i, DIGITS).cast("long") for i in range(LIMBS)))

    return F.when(digits != "", let(F.struct(clean.alias("clean"), digits.alias("digits")), lambda t: let(limbs(t["digits"]), lambda n: F.when(t["clean"].startswith("-"), negated(n)).otherwise(n))))


def parts_of(number: Column) -> list[Column]:
    """A number as ten longs, the two halves of each limb, whose sums, also over windows, are exact for up to 9 * 10^9 rows; `joined` makes a number of such sums."""
    halves = []
    for i in range(LIMBS):
        low = F.pmod(F.get(number, i), F.lit(_HALF))
        halves += [F.call_function("div", F.get(number, i) - low, F.lit(_HALF)), low]
    return halves


def joined(sums: list[Column]) -> Column:
    """The number of sums of parts_of; null if one is null. Only the first part can be negative, so carries are plain quotients."""
    def settled(own: list[Column]) -> Column:
        digits, carry = [], F.lit(0).cast("long")
        for part in reversed(own[1:]):
            whole = part + carry
            digits.insert(0, whole % F.lit(_HALF))
            carry = F.call_function("div", whole, F.lit(_HALF))
        limbs = F.array((own[0] + carry) * F.lit(_HALF) + digits[0], *(digits[i] * F.lit(_HALF) + digits[i + 1] for i in range(1, 2 * LIMBS - 1, 2)))
        return F.when(F.get(limbs, 0).isNotNull(), limbs)

    return let(F.array(*sums), lambda a: settled([F.get(a, i) for i in range(2 * LIMBS)]))


def total(number: Column) -> Column:
    """The sum of a group; nulls are left out, a group of nulls alone sums to null. Ten plain sums, joined once."""
    return joined([F.sum(p) for p in parts_of(number)])


def negated(number: Column) -> Column:
    return let(number, lambda n: _settled([-F.get(n, i) for i in range(LIMBS)]))


def plus(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda n: _settled([F.get(n["a"], i) + F.get(n["b"], i) for i in range(LIMBS)]))


def minus(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda n: _settled([F.get(n["a"], i) - F.get(n["b"], i) for i in range(LIMBS)]))


def times(number: Column, factor: Column) -> Column:
    """A number times a whole number of up to 18 digits; more digits than 90 fail the query."""
    return carried([F.get(number, i).cast("decimal(19,0)") * factor.cast("decimal(18,0)") for i in range(LIMBS)])


def text(number: Column) -> Column:
    """Decimal text without leading zeros."""
    def written(n: Column) -> Column:
        return F.regexp_replace(F.concat(*(F.lpad(F.get(n, i).cast("string"), DIGITS, "0") for i in range(LIMBS))), r"^0+(?=\d)", "")

    return let(number, lambda n: F.when(F.get(n, 0) < 0, F.concat(F.lit("-"), let(negated(n), written))).when(n.isNotNull(), written(n)))


def from_hex(word: Column) -> Column:
    """The number of a hex word of up to 256 bits, with or without 0x; an empty word is 0, no hex number is null."""
    digits = F.regexp_replace(F.lower(F.trim(word)), "^0x", "")
    pieces = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.conv(F.substring(F.lpad(digits, 70, "0"), 1 + 14 * i, 14), 16, 10).cast("long"))
    zero = F.array(*(F.lit(0).cast("long") for _ in range(LIMBS)))
    shifted = lambda acc, piece: plus(times(acc, F.lit(2**56)), F.array(*(F.lit(0).cast("long") for _ in range(LIMBS - 1)), piece))
    return F.when(digits.rlike("^[0-9a-f]{0,70}$"), F.aggregate(pieces, zero, shifted))


def is_text(rows: DataFrame, name: str) -> bool:
    return dict(rows.dtypes)[name] == "string"


def is_exact(rows: DataFrame, name: str) -> bool:
    """Whether a column holds amounts in text or numbers of this module."""
    return dict(rows.dtypes)[name] in ("string", "array<bigint>")


def numbers(rows: DataFrame, *names: str) -> DataFrame:
    """Rows with their columns of text as exact numbers, by parse(); each step is a projection of its own, so that a text is read once and its limbs are plain columns."""
    names, own = [n for n in names if is_text(rows, n)], rows.columns
    clean = rows.select("*", *(F.trim(F.col(n)).alias(f"__clean_{n}") for n in names))
    digits = clean.select("*", *(F.regexp_extract(f"__clean_{n}", rf"^[+-]?0*(\d{{1,{LIMBS * DIGITS}}})$", 1).alias(f"__digits_{n}") for n in names))
    padded = digits.select("*", *(F.when(F.col(f"__digits_{n}") != "", F.lpad(f"__digits_{n}", LIMBS * DIGITS, "0")).alias(f"__padded_{n}") for n in names))
    limbs = padded.select(*own, *(f"__clean_{n}" for n in names), *(F.substring(f"__padded_{n}", 1 + DIGITS * i, DIGITS).cast("long").alias(f"__limb_{n}_{i}") for n in names for i in range(LIMBS)))
    array = lambda n: F.array(*(F.col(f"__limb_{n}_{i}") for i in range(LIMBS)))
    number = lambda n: F.when(F.col(f"__limb_{n}_0").isNotNull(), F.when(F.col(f"__clean_{n}").startswith("-"), negated(array(n))).otherwise(array(n)))
    return limbs.select(*((number(c) if c in names else F.col(f"`{c}`")).alias(c) for c in own))


def parsed(rows: DataFrame, *names: str) -> DataFrame:
    """Rows with the ten parts of their columns of text or exact numbers beside them (__name_0 and on), so that sum_of reads each text once and adds up plain longs."""
    names = [n for n in names if is_exact(rows, n)]
    beside = numbers(rows.select("*", *(F.col(n).alias(f"__{n}") for n in names)), *(f"__{n}" for n in names))
    return beside.select(*rows.columns, *(p.alias(f"__{n}_{i}") for n in names for i, p in enumerate(parts_of(F.col(f"__{n}")))))


def multiplied(rows: DataFrame, name: str, number: str, factor: str) -> DataFrame:
    """Rows with a column `name` beside them: times() of an exact number and a whole number column of up to 18 digits, in plain longs.

    Halves of limbs have products that fit a long. Each step is a projection of its own, so that its expressions are computed once and stay small.
    """
    div, half, limbs = lambda a, b: F.call_function("div", a, F.lit(b)), F.lit(_HALF), range(LIMBS)
    col, own = lambda c, i: F.col(f"__{c}{i}"), [F.col(f"`{c}`") for c in rows.columns]
    f = F.col(factor).cast("long")
    split = rows.select(*own, div(f, _HALF).alias("__high"), (f % half).alias("__low"), *(p.alias(f"__h{i}") for i, p in enumerate(parts_of(F.col(number)))))
    upper, lower = (lambda i: col("h", 2 * i)), (lambda i: col("h", 2 * i + 1))
    crossed = split.select(
        *own, *((upper(i) * F.col("__high")).alias(f"__top{i}") for i in limbs), *((upper(i) * F.col("__low") + lower(i) * F.col("__high")).alias(f"__middle{i}") for i in limbs),
        *((lower(i) * F.col("__low")).alias(f"__bottom{i}") for i in limbs),
    )
    wide = crossed.select(*own, *((col("top", i) + div(col("middle", i), _HALF)).alias(f"__over{i}") for i in limbs), *((col("bottom", i) + col("middle", i) % half * half).alias(f"__under{i}") for i in limbs))
    above = lambda i: col("over", i) + div(col("under", i), _UNIT) if i < LIMBS else F.lit(0)
    parts = wide.select(*own, *((col("under", i) % F.lit(_UNIT) + above(i + 1) + (above(0) * F.lit(_UNIT) if not i else F.lit(0))).alias(f"__part{i}") for i in limbs))
    return parts.select(*own, _settled([col("part", i) for i in limbs]).alias(name))


def sum_of(rows: DataFrame, name: str) -> Column:
    """The sum of a column of rows in the column's own kind: a number type is summed as it is, amounts in text and exact numbers exactly, to text."""
    if f"__{name}_0" in rows.columns:
        return text(joined([F.sum(f"__{name}_{i}") for i in range(2 * LIMBS)]))
    return text(total(parse(F.col(name)) if is_text(rows, name) else F.col(name))) if is_exact(rows, name) else F.sum(name)


def shown(rows: DataFrame, name: str) -> Column:
    """A column of rows as sum_of gives its sums: exact numbers as text, others as they are."""
    return (F.col(name) if is_text(rows, name) or not is_exact(rows, name) else text(F.col(name))).alias(name)
