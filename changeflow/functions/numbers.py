"""Number parsing, rounding and unit prices."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from changeflow.functions.text import strip

# Unit prices in dollars.
USD_PER_MILLION_RECORDS = 0.50
USD_PER_GIB = 0.10
USD_PER_COMPUTE_HOUR = 0.05

_NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$"


def parse_float(x: Column) -> Column:
    """Text to double, null when it is no number.

    A plain cast settles nearly every value. It would take type suffixes and hexadecimal text,
    and it refuses digit groups joined by ``_``; such text goes through the patterns.
    """
    text = x.cast("string")
    low = F.lower(text)
    odd = low.endswith("d") | low.endswith("f") | low.contains("x")
    plain = F.regexp_replace(strip(text), r"(?<=\d)_(?=\d)", "")
    return F.coalesce(
        F.when(~odd, text.try_cast("double")), F.when(plain.rlike(_NUMBER), plain.try_cast("double"))
    )


def without_nan(number: Column) -> Column:
    """A double, null where it is NaN, which Spark orders above every number; ``number`` is worked out once."""
    return F.nanvl(number, F.lit(None).cast("double"))


def parse_int(x: Column) -> Column:
    """Text to whole number by way of double, cutting the fraction; null when it is no number."""
    return parse_float(x).try_cast("bigint")


def parse_bool(x: Column) -> Column:
    return F.when(x.isNotNull(), F.lower(x.cast("string")).isin("true", "1", "yes"))


def percent(done: Column, total: Column) -> Column:
    """``done`` of ``total`` in percent with one decimal, ties to even, by whole-number steps."""
    scaled = done.cast("bigint") * 1000
    rest = scaled % total
    whole = ((scaled - rest) / total).cast("bigint")
    up = (rest * 2 > total) | ((rest * 2 == total) & (whole % 2 == 1))
    return (whole + up.cast("int")).cast("double") / 10


def in_dollars(cost: Column, places: int = 4) -> Column:
    """A cost rounded to the reported places, ties away from zero."""
    return F.round(cost.cast("decimal(38,12)"), places).cast("double")


# Ten-thousandths of a dollar for a unit of usage, from the prices above, as parts of one common denominator.
_PARTS = 225 << 27
_PARTS_OF = {"records_usd": _PARTS // 200, "transfer_usd": 125 * (_PARTS >> 27), "compute_usd": _PARTS // 7200}


def _dollars(parts: Column) -> Column:
    """Parts as dollars with four places, a half rounded up; whole numbers until the last step."""
    doubled = parts * F.lit(2) + F.lit(_PARTS).cast("decimal(12,0)")
    units = F.call_function("div", doubled, F.lit(2 * _PARTS).cast("decimal(12,0)"))
    return (units.cast("decimal(20,0)") * F.lit("0.0001").cast("decimal(4,4)")).cast("decimal(18,4)")


def usage_cost(records: Column, byte_count: Column, compute_ms: Column) -> dict[str, Column]:
    """Cost of each component in dollars, and of all, as decimals of the stored scale of four places.

    The cost of all is the exact sum rounded once, so it may differ from the rounded components in the last place.
    """
    amounts = zip(_PARTS_OF.items(), (records, byte_count, compute_ms), strict=True)
    exact = {name: amount.cast("decimal(20,0)") * F.lit(parts).cast("decimal(10,0)") for (name, parts), amount in amounts}
    first, second, third = exact.values()
    return {name: _dollars(parts) for name, parts in exact.items()} | {"cost_usd": _dollars(first + second + third)}
