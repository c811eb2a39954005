"""Numeric parsing, rounding and guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from casewatch.functions.text import col, strip

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def to_double(value: str | Column) -> Column:
    """Number in text, else null.

    The pattern comes first because a plain cast also accepts ``1d``, ``inf``.
    """
    text = strip(col(value).cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def to_int(value: str | Column) -> Column:
    """Nearest integer (ties to even) of a number in text, else null.

    A text that is just its integer written out needs no pattern.
    """
    text = col(value).cast("string")
    plain = text.try_cast("int")
    return F.when(plain.cast("string") == text, plain).otherwise(F.rint(to_double(value)).try_cast("int"))


def round_even(value: str | Column, digits: int) -> Column:
    """Round half to even on the double value, as numpy does."""
    scale = float(10**digits)
    return F.rint(col(value) * scale) / scale


def round_up(value: str | Column, digits: int) -> Column:
    """Round half up, as SQL ``NUMERIC`` does for positive values."""
    scale = float(10**digits)
    return F.floor(col(value) * scale + 0.5).cast("double") / scale


def within(value: str | Column, bounds: tuple[float, float]) -> Column:
    """The value where it lies in the closed range, else null."""
    return F.when(col(value).between(*bounds), col(value))


def exact_mean(
    value: str | Column, places: int = 2, out: int = 2, half_up: bool = False
) -> Column:
    """Mean of values with at most ``places`` decimals, rounded to ``out``.

    Values are summed as scaled integers, so ties round the same way whatever
    the order in which partitions are merged or tasks are retried.
    """
    total = F.sum(F.rint(col(value) * float(10**places)).cast("long"))
    mean = total / (F.count(col(value)) * 10 ** (places - out))
    return (F.floor(mean + 0.5).cast("double") if half_up else F.rint(mean)) / float(10**out)


def safe_ratio(part: Column, whole: Column) -> Column:
    """Quotient as double; null where the denominator is zero."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def half_up_percent(part: Column, whole: Column) -> Column:
    """Whole percentage, half up; zero where there is nothing to divide by."""
    percent = F.floor(safe_ratio(part * 100, whole) + 0.5)
    return F.coalesce(percent, F.lit(0)).cast("int")


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating column."""
    floating = (T.DoubleType, T.FloatType)
    return df.select(*[
        F.when(
            ~F.isnan(F.col(f"`{f.name}`")) & (F.abs(F.col(f"`{f.name}`")) != float("inf")),
            F.col(f"`{f.name}`"),
        ).alias(f.name)
        if isinstance(f.dataType, floating)
        else F.col(f"`{f.name}`")
        for f in df.schema.fields
    ])
