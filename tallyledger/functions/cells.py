"""Cleaning of single cells: text, numbers, dates and keys."""

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .vocabulary import WHITE_SPACE


def quoted(name: str) -> Column:
    """Reference a physical column whose name may hold spaces, dots or '#'."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def strip(text: Column) -> Column:
    """Trim any white space, not only blanks."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def tighten_separator(text: Column) -> Column:
    """'M/OLIVE |30' and 'M/OLIVE|30' are the same composite key; the pattern runs only where it can match."""
    tight = F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]*\|[\s\x1c-\x1f]*", "|")
    return F.when(text.contains("|"), tight).otherwise(text)


def is_tidy(dtype: T.DataType) -> bool:
    """Values of this type turn into text without white space or separators."""
    return isinstance(dtype, (T.NumericType, T.BooleanType, T.DateType))


def key_text(cell: Column, tidy: bool = False) -> Column:
    """A key is never null: missing becomes '-', everything else is trimmed text."""
    text = F.coalesce(cell.cast("string"), F.lit("-"))
    return text if tidy else strip(text)


def free_text(cell: Column, tidy: bool = False) -> Column:
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return text if tidy else strip(text)


def type_code(cell: Column) -> Column:
    return F.coalesce(F.upper(strip(cell.cast("string"))), F.lit("NONE"))


def number_or_zero(cell: Column, dtype: T.DataType) -> Column:
    """Numeric value of a cell; anything that is not a finite number counts as 0."""
    if isinstance(dtype, T.StringType):
        # Java reads '12d' and '12f' as numbers; a stock file does not mean that.
        parsed = F.when(~F.rlike(cell, F.lit(r"[dDfF]\s*$")), cell.try_cast("double"))
    else:
        parsed = cell.cast("double")
    if isinstance(dtype, (T.IntegralType, T.DecimalType)):
        return F.coalesce(parsed, F.lit(0.0))
    # NaN sorts above infinity, so the upper bound drops it too.
    finite = (parsed > F.lit(float("-inf"))) & (parsed < F.lit(float("inf")))
    return F.when(finite, parsed).otherwise(F.lit(0.0))


def moment(cell: Column, dtype: T.DataType) -> Column:
    """A wall-clock timestamp without a zone; unreadable text is an error."""
    if isinstance(dtype, T.NullType):
        return F.lit(None).cast("timestamp_ntz")
    return cell.cast("timestamp_ntz")


def repaired_key(cell: Column, dtype: T.DataType) -> Column:
    """Key text as it was typed, before the spreadsheet turned it into a date or a float.

    A date cell was a fraction size ('5/6'), a whole float was an integer ('58').
    """
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        text = F.concat(F.month(cell).cast("string"), F.lit("/"), F.dayofmonth(cell).cast("string"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        number = F.when(~F.isnan(cell), cell.cast("double"))
        whole = (number == F.floor(number)) & (F.abs(number) < F.lit(1e18))
        text = F.when(whole, number.try_cast("bigint").cast("string")).otherwise(
            number.cast("string")
        )
    else:
        text = strip(cell.cast("string"))
    return F.coalesce(text, F.lit(""))


def non_blank(text: Column) -> Column:
    """Null for a blank, so that aggregates skip it."""
    return F.when(text != "", text)
