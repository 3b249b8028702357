"""Sums of doubles that do not depend on the order of the rows.

A double is cut into ``LIMBS`` integer digits of base 2^24, digit i standing for 2^(-24 i); the first
one holds the whole part. Digits and products of digits are summed as integers (exact, so retries,
partitions and merge order cannot change them) and turned into one double at the end, after the
carries have been settled, so nothing cancels either. Values are exact to 2^-72; only numbers below
2^-19 have bits beyond that, which are cut row by row and so in the same way every time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LIMBS = 4
BASE_BITS = 24
#: Size below which a value can be summed exactly.
LIMIT = float(1 << 31)
_WIDE = "decimal(38,0)"


def _base() -> Column:
    return F.lit(1 << BASE_BITS).cast("decimal(10,0)")


def summable(x: Column) -> Column:
    """Whether a value is finite and below ``LIMIT`` in size (null: yes, it adds nothing)."""
    return x.isNull() | (F.abs(x) < F.lit(LIMIT))


def limbs(x: Column) -> Column:
    """ARRAY<BIGINT> of the digits of ``x``, all of its sign; zeros if ``x`` is null or cannot be
    summed (count those with ``summable``)."""
    # each step multiplies by a power of two and takes off a whole part, both without rounding
    rest = F.when(summable(x), F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
    digits = []
    for i in range(LIMBS):
        scaled = rest if i == 0 else rest * F.lit(float(1 << BASE_BITS))
        whole = F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)).cast("long")
        digits.append(whole)
        rest = scaled - whole.cast("double")
    return F.array(*digits)


def square_limbs(d: Column) -> Column:
    """Digits of the square of the number whose ``limbs`` are ``d`` (not carried)."""
    return F.array(
        *[sum((d[i] * d[k - i] for i in range(max(0, k - LIMBS + 1), min(k, LIMBS - 1) + 1)), F.lit(0).cast("long")) for k in range(2 * LIMBS - 1)]
    )


def sums(d: str, size: int, prefix: str) -> list[Column]:
    """Aggregates ``prefix0..``: the sum of each digit of the array column ``d``."""
    return [F.sum(F.col(d)[i].cast("decimal(28,0)")).cast(_WIDE).alias(f"{prefix}{i}") for i in range(size)]


def to_double(digits: Sequence[Column]) -> Column:
    """The number with these (summed) digits as a double: carries first, then the smallest digit."""

    def settle(acc: Column, t: Column) -> Column:
        whole = (t + acc["carry"]).cast(_WIDE)
        rest = F.pmod(whole, _base())
        return F.struct(
            ((whole - rest) / _base()).cast(_WIDE).alias("carry"),
            ((acc["value"] + rest.cast("double")) * F.lit(2.0**-BASE_BITS)).alias("value"),
        )

    start = F.struct(F.lit(0).cast(_WIDE).alias("carry"), F.lit(0.0).alias("value"))
    low = F.array(*[c.cast(_WIDE) for c in reversed(digits[1:])])
    top = digits[0].cast(_WIDE)
    return F.aggregate(low, start, settle, lambda acc: (top + acc["carry"]).cast(_WIDE).cast("double") + acc["value"])


def spread_digits(s1: Sequence[Column], s2: Sequence[Column], n: Column) -> list[Column]:
    """Digits of ``n * sum(x^2) - sum(x)^2`` from the digit sums of x and of its squares."""
    n = n.cast(_WIDE)
    out = []
    for k, t in enumerate(s2):
        square = [(s1[i].cast(_WIDE) * s1[k - i].cast(_WIDE)).cast(_WIDE) for i in range(max(0, k - len(s1) + 1), min(k, len(s1) - 1) + 1)]
        value = (n * t.cast(_WIDE)).cast(_WIDE)
        for x in square:
            value = (value - x).cast(_WIDE)
        out.append(value)
    return out
