"""Totals, rounding and number text."""

import math

from pyspark.sql import Column, functions as F

_MICRO = 1_000_000
# What is left below a millionth of an amount is a digit only beyond the noise of its last few bits.
_NOISE = 2.0**-49
# An amount is cut into multiples of 2^_TOP, multiples of 2^_STEP below it, and millionths of what is left.
_TOP, _STEP = 56, 8
PARTS = 4


def _limbs(amount: Column) -> list[Column]:
    """The parts of an amount that are added up apart from each other, PARTS in number.

    Millionths of what a multiple of 2^_STEP leaves (a bigint, with room for 60 billion rows of the largest), multiples of
    2^_STEP and of 2^_TOP, and what is left below a millionth. The multiples are whole numbers kept as doubles: their sums
    are exact up to 2^53 and lose last bits beyond instead of overflowing, which is at totals of 2e18 and of 6e32.
    """
    amount = amount.cast("double")
    top = F.rint(amount * F.lit(2.0**-_TOP))
    # Beyond 2^(53 + _TOP) nothing is left; NaN and infinities stay in the first part.
    rest = F.when(F.abs(amount) >= F.lit(math.inf), F.lit(0.0)).otherwise(amount - top * F.lit(2.0**_TOP))
    steps = F.rint(rest * F.lit(2.0**-_STEP))
    left = rest - steps * F.lit(2.0**_STEP)
    millionths = F.rint(left * F.lit(float(_MICRO))).cast("bigint")
    below = left - millionths / F.lit(float(_MICRO))
    return [millionths, steps, top, F.when(F.abs(below) > F.abs(amount) * F.lit(_NOISE), below).otherwise(F.lit(0.0))]


def _joined(millionths: Column, steps: Column, top: Column, below: Column) -> Column:
    """The total of added parts, rounded once: in bigints where they have room, in 38 digits beyond, in doubles far beyond."""
    micro, unit = F.lit(float(_MICRO)), F.lit(_MICRO << _STEP)
    short = steps.cast("bigint") * unit + millionths
    long = top.cast("decimal(38,0)") * F.lit(1 << (_TOP - _STEP)) + steps.cast("decimal(38,0)")
    return below + (
        F.when((top == 0) & (F.abs(steps) < 2.0**32) & (F.abs(millionths) < 1 << 60), short.cast("double") / micro)
        .when((F.abs(top) < 2.0**40) & (F.abs(steps) < 2.0**62), (long * unit + millionths).cast("double") / micro)
        .otherwise(top * F.lit(2.0**_TOP) + steps * F.lit(2.0**_STEP) + millionths / micro)
    )


def exact_sum(amount: Column, where: Column | None = None) -> Column:
    """Sum of money or quantities of any size, of the rows that a condition selects; null when all are null.

    An amount is cut into parts whose sums are exact, so partial sums combine to the same bits in any order and none
    overflows. What may differ in its last bits is the sum of digits below a millionth, and totals beyond those that _limbs
    tells. The hash aggregate keeps fixed-width buffers (decimal sums cost several times more).
    """
    limbs = _limbs(amount)
    return _joined(*(F.sum(limb if where is None else F.when(where, limb)) for limb in limbs))


def exact_total(amount: Column, where: Column | None = None) -> Column:
    """As exact_sum; nothing to add gives 0."""
    return F.coalesce(exact_sum(amount, where), F.lit(0.0))


def part_sums(name: str) -> list[Column]:
    """The sums of a column's parts, for totals that are added up in two steps (see total_of_parts)."""
    return [F.sum(limb).alias(f"{name}_{k}") for k, limb in enumerate(_limbs(F.col(name)))]


def sum_of_parts(name: str, where: Column | None = None) -> Column:
    """exact_sum of a column from the part sums of its groups, or of those that a condition selects."""
    parts = [F.col(f"{name}_{k}") for k in range(PARTS)]
    return _joined(*(F.sum(part if where is None else F.when(where, part)) for part in parts))


def total_of_parts(name: str, where: Column | None = None) -> Column:
    return F.coalesce(sum_of_parts(name, where), F.lit(0.0))


def plain_text(number: Column, digits: int) -> Column:
    """'-1234.5': rounded half-even on the exact binary value."""
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))


def grouped_text(number: Column, digits: int) -> Column:
    """'-1,234.5'."""
    return F.format_number(number, digits)


def signed_text(number: Column, digits: int) -> Column:
    """'+1,234.5' or '-1,234.5'."""
    text = F.format_number(number, digits)
    return F.when(text.startswith("-"), text).otherwise(F.concat(F.lit("+"), text))


def rounded(number: Column, digits: int) -> Column:
    """Round on the exact binary value (2.675 -> 2.67), unlike F.round, which goes through text."""
    return plain_text(number, digits).cast("double")
