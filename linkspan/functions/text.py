"""Text, date and value helpers on columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkspan import codes


def strip(value: Column) -> Column:
    """Text without leading and trailing white space of any kind."""
    return F.btrim(value.cast("string"), F.lit(codes.WHITESPACE))


def clean_text(value: Column) -> Column:
    """Lower-case text without surrounding white space."""
    return strip(F.lower(value.cast("string")))


def filled(value: Column) -> Column:
    """True for a value that is neither null nor the empty string."""
    return F.coalesce(value.cast("string") != "", F.lit(False))


def blank_like(value: Column) -> Column:
    """True for null and for text that only says there is nothing."""
    return F.coalesce(clean_text(value).isin("", "null", "none"), F.lit(True))


def canonical(value: Column, words: Mapping[str, Iterable[str]]) -> Column:
    """The code whose word list holds the cleaned value, else null."""
    text = clean_text(value)
    out = F.lit(None).cast("string")
    for code, spellings in reversed(list(words.items())):
        out = F.when(text.isin(*spellings), code).otherwise(out)
    return out


_DAY_FIRST = r"^(\d{1,2})([/\- ])(\d{1,2})\2(\d{4})$"
_YEAR_FIRST = r"^\d{4}-\d{1,2}-\d{1,2}$"
_NAMED_MONTH = {
    "d-MMM-yyyy": r"^\d{1,2}-[a-z]{3}-\d{4}$",
    "d MMM yyyy": r"^\d{1,2} [a-z]{3} \d{4}$",
    "d MMMM yyyy": r"^\d{1,2} [a-z]{3,} \d{4}$",
}


def year_first_date(value: Column) -> Column:
    """Date written year-month-day; anything else gives null."""
    text = clean_text(value)
    return F.when(text.rlike(_YEAR_FIRST), text.try_cast("date"))


def birth_date(value: Column) -> Column:
    """Date in any accepted format; text that fits none gives null.

    The formats differ in shape, so at most one applies.  Those in digits are
    turned into year-month-day and cast; month names need a format, which is
    only tried on text of its shape, since a failed parse is far dearer than a
    look at the text.
    """
    text = clean_text(value)
    digits = F.regexp_replace(text, _DAY_FIRST, "$4-$3-$1")
    named = [
        F.when(text.rlike(shape), F.try_to_date(text, fmt)) for fmt, shape in _NAMED_MONTH.items()
    ]
    return F.coalesce(F.when(digits.rlike(_YEAR_FIRST), digits.try_cast("date")), *named)


def plausible_birth(date: Column) -> Column:
    """Birth dates before 1900 become null."""
    return F.when(F.year(date) >= codes.EARLIEST_BIRTH_YEAR, date)


def finite_or_null(df: DataFrame) -> DataFrame:
    """NaN and infinities become null in every floating-point column."""
    fractional = {name for name, kind in df.dtypes if kind in ("double", "float")}
    infinities = (float("inf"), float("-inf"))
    return df.select(
        *[
            F.when(~(F.isnan(name) | F.col(name).isin(*infinities)), F.col(name)).alias(name)
            if name in fractional
            else F.col(name)
            for name in df.columns
        ]
    )


def mask_ids(value: Column, strategy: str = "mask") -> Column:
    """Hide every free-standing 16-digit number of a text.

    "mask" keeps the last three digits, "redact" replaces the whole number.
    """
    if strategy == "mask":
        return F.regexp_replace(value, r"\b\d{13}(\d{3})\b", "*" * 13 + "$1")
    if strategy == "redact":
        return F.regexp_replace(value, r"\b\d{16}\b", "[REDACTED]")
    raise ValueError(f"unknown strategy: {strategy}")
