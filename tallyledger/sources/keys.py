"""From a cleaned key back to conditions on the raw columns it is made of, so that a filter on keys reaches the scan."""

from __future__ import annotations

import decimal
from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..config import Mapping
from ..functions.cells import quoted, type_of

_LARGEST = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}
MISSING = "-"


def _number(piece: str, dtype: T.DataType) -> Column | None:
    """The one number of an integer or decimal type that is written like this; None if there is none."""
    if isinstance(dtype, T.DecimalType):
        digits = piece.lstrip("-").replace(".", "", 1)
        if not (digits.isascii() and digits.isdigit()):
            return None
        value = decimal.Decimal(piece)
        fits = -value.as_tuple().exponent == dtype.scale and len(digits.lstrip("0")) <= dtype.precision
        return F.lit(piece).cast(dtype) if fits and str(value) == piece else None
    if not piece.lstrip("-").isascii() or not piece.lstrip("-").isdigit() or str(int(piece)) != piece:
        return None
    bits = next(bits for kind, bits in _LARGEST.items() if isinstance(dtype, kind))
    return F.lit(int(piece)).cast(dtype) if -(1 << bits) <= int(piece) < 1 << bits else None


def _all_numbers(parts: list[tuple[Column, T.DataType]], pieces: list[str]) -> Column:
    """Numbers hold no separator and missing parts leave no trace: a piece for each part that is there, in order."""
    ways = []
    for present in combinations(range(len(parts)), len(pieces)):
        given = [_number(piece, parts[k][1]) for k, piece in zip(present, pieces, strict=True)]
        if all(number is not None for number in given):
            equal = [parts[k][0] == number for k, number in zip(present, given, strict=True)]
            ways.append(reduce(and_, equal + [parts[k][0].isNull() for k in range(len(parts)) if k not in present]))
    return reduce(or_, ways) if ways else F.lit(False)


def raw_key_condition(table: DataFrame, mapping: Mapping, key: str) -> Column | None:
    """What every row with this cleaned key fulfils, in terms of raw columns alone; None where nothing is known.

    Integers and decimals are compared with the numbers the key was put together from. Text that may have white space
    around it must hold each piece of the key; which rows are meant exactly is left to the comparison of cleaned keys.
    """
    names = mapping if isinstance(mapping, list) else [mapping]
    if not all(isinstance(name, str) for name in names):
        return None
    parts = [(quoted(name), type_of(table, name)) for name in names]
    pieces = key.split("|")
    if all(isinstance(dtype, (*_LARGEST, T.DecimalType)) for _, dtype in parts):
        found = _all_numbers(parts, pieces)
    else:
        held = [[_holds(column, dtype, piece) for column, dtype in parts] for piece in pieces if piece]
        known = [[c for c in row if c is not None] for row in held if not any(c is True for c in row)]
        if not known:
            return None
        found = reduce(and_, [reduce(or_, row) if row else F.lit(False) for row in known])
    if key == MISSING and not isinstance(mapping, list):
        return parts[0][0].isNull() | found
    return found


def _holds(column: Column, dtype: T.DataType, piece: str) -> Column | bool | None:
    """Whether a part can have given a piece: a condition, None for never, True for a type of which nothing is known."""
    if isinstance(dtype, T.StringType):
        return column.contains(piece)
    if isinstance(dtype, (*_LARGEST, T.DecimalType)):
        number = _number(piece, dtype)
        return None if number is None else column == number
    return True
