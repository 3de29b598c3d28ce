"""Column expressions for readings, units, keys and dates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrapanel.refdata import MISSING_AT_OR_BELOW, MM_PER_INCH

# Letters only the cast's extra notations use: suffixed ('1d', '2f') and hex floats.
_NOT_DECIMAL = "[dDfFxX]"


def _is_reading(value: Column, threshold: float = MISSING_AT_OR_BELOW) -> Column:
    # NaN orders above infinity, so this leaves finite readings only.
    return (value > threshold) & (value < float("inf"))


def to_number(text: Column) -> Column:
    """Text to a finite double; anything that is not plain decimal notation becomes null."""
    number = F.when(~text.rlike(_NOT_DECIMAL), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def drop_missing(value: Column, threshold: float = MISSING_AT_OR_BELOW) -> Column:
    """Null for NaN, infinities, nulls and missing-data markers."""
    return F.when(_is_reading(value, threshold), value)


def readings_of(texts: list[Column]) -> Column:
    """The readings among some text columns as an array.

    The same rules as to_number and drop_missing, but the notation is checked once
    for the whole row and cell by cell only where that finds something.
    """
    cells = F.array(*texts)
    plain = F.when(~F.concat_ws(" ", *texts).rlike(_NOT_DECIMAL), cells).otherwise(
        F.filter(cells, lambda cell: ~cell.rlike(_NOT_DECIMAL))
    )
    return F.filter(plain.try_cast("array<double>"), lambda value: _is_reading(value))


def celsius_to_fahrenheit(value: Column) -> Column:
    return value * 9 / 5 + 32


def mm_to_inches(value: Column) -> Column:
    return value / MM_PER_INCH


def pad_key(key: Column, width: int) -> Column:
    """Left-pad with zeros; a longer key is kept whole."""
    text = key.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def first_of_month(year: Column, month: Column) -> Column:
    return F.when(month.between(1, 12), F.make_date(year, month, F.lit(1)))


def probe_month(as_of: Column) -> Column:
    """The month two before as_of, the newest one expected to be published."""
    return F.trunc(F.add_months(as_of, -2), "month")


def null_if_nan(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def split_ids(ids: str | Iterable[str]) -> list[str]:
    """'ga, FL' -> ['GA', 'FL']."""
    parts = ids.split(",") if isinstance(ids, str) else ids
    return [part.strip().upper() for part in parts if part.strip()]
