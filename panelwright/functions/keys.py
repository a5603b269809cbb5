"""Key normalisation as built-in column expressions (stay inside codegen)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted key spellings and the default exchange prefixes.
NUMERIC_CODE = r"^[0-9]{1,6}$"
SYMBOLIC_CODE = r"^[A-Za-z][A-Za-z0-9_-]{0,31}$"
CLOCK = r"^([0-9]{1,2}):([0-9]{2})(:[0-9]{2}([.][0-9]+)?)?$"
CODE_PREFIXES = ("0", "3", "6")

# One to four digits whose last two are a minute below 60 and the rest an hour below 24.
VALID_HHMM = r"^(?=[0-9]{1,4}$)(?:(?:[01]?[0-9]|2[0-3])(?=[0-9]{2}$))?[0-5]?[0-9]$"
BLANKS = " \t\n\r\f\x0b"

# Expressions repeat their input wherever they mention it twice, so the ones below
# are phrased to mention it as rarely as possible.


def _text(value: Column) -> Column:
    return F.btrim(value.cast("string"), F.lit(BLANKS))


def normalize_code(value: Column) -> Column:
    """Exchange-free security code: digits padded to six, symbols upper-cased, else NULL."""
    stem = F.substring_index(_text(value), ".", 1)
    return F.when(stem.rlike(NUMERIC_CODE), F.lpad(stem, 6, "0")).when(
        stem.rlike(SYMBOLIC_CODE), F.upper(stem)
    )


def normalize_date(value: Column) -> Column:
    """First eight digits as an INT ``YYYYMMDD`` (not calendar-checked), else NULL."""
    digits = F.regexp_replace(value.cast("string"), r"[^0-9]", "")
    return F.nullif(F.regexp_extract(digits, r"^[0-9]{8}", 0), F.lit("")).cast("int")


def normalize_datetime(value: Column) -> Column:
    """Like :func:`normalize_date`, but a DATE; impossible days become NULL."""
    return F.try_to_date(F.lpad(normalize_date(value).cast("string"), 8, "0"), "yyyyMMdd")


def integer_datetime(value: Column) -> Column:
    """:func:`normalize_datetime` for integer columns, by arithmetic in the common case."""
    year, month, day = ((value / 10_000).cast("int"), (value / 100).cast("int") % 100, (value % 100).cast("int"))
    leap = (year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0))
    fits = (day <= 28) | ((day <= 30) & (month != 2)) | ((day == 31) & month.isin(1, 3, 5, 7, 8, 10, 12)) | ((day == 29) & (month == 2) & leap)
    real = month.between(1, 12) & (day >= 1) & (day <= 31) & fits
    eight = value.between(10_000_000, 99_999_999)
    return F.when(eight, F.when(real, F.make_date(year, month, day))).otherwise(normalize_datetime(value))


def normalize_minute(value: Column) -> Column:
    """HHMM INT from ``930``, ``"930.0"``, ``"09:30"`` or ``"09:30:00"``, else NULL."""
    digits = F.regexp_replace(F.regexp_replace(_text(value), r"\.0+$", ""), CLOCK, "$1$2")
    return F.when(digits.rlike(VALID_HHMM), digits.cast("int"))


def integer_date(value: Column) -> Column:
    """:func:`normalize_date` for integer columns, without the text round trip in the common case."""
    return F.when(value.between(10_000_000, 99_999_999), value.cast("int")).otherwise(normalize_date(value))


def integer_minute(value: Column) -> Column:
    """:func:`normalize_minute` for integer columns."""
    return F.when(value.between(0, 2359) & (value % 100 < 60), value.cast("int"))


def has_prefix(code: Column, prefixes: Sequence[str] = CODE_PREFIXES) -> Column:
    """True for codes starting with one of *prefixes*; NULL codes are False."""
    sizes = sorted({len(prefix) for prefix in prefixes})
    starts = [F.substring(code, 1, size).isin(*[p for p in prefixes if len(p) == size]) for size in sizes]
    return F.coalesce(reduce(Column.__or__, starts, F.lit(False)) & code.isNotNull(), F.lit(False))


def year_of(date: Column) -> Column:
    """Year of an eight-digit ``YYYYMMDD`` integer; anything else is NULL."""
    return F.when(date.between(10_000_000, 99_991_231), F.floor(date / 10_000).cast("int"))


def _slot_of(hhmm: int) -> int | None:
    """Half hours end on the hour and half hour; 09:30 itself joins the first one."""
    clock = hhmm // 100 * 60 + hhmm % 100
    if hhmm % 100 < 60 and 570 <= clock <= 690:
        return max(1, -(-(clock - 570) // 30))
    if hhmm % 100 < 60 and 781 <= clock <= 900:
        return 4 - (-(clock - 780) // 30)
    return None


def session_slot(minute: Column) -> Column:
    """Half-hour slot 1..8 of an HHMM minute; NULL outside 09:30-11:30 and 13:01-15:00.

    A constant array indexed by the minute: one mention of the input, no branches.
    """
    slots = ", ".join(str(_slot_of(hhmm) or "NULL") for hhmm in range(930, 1501))
    return F.get(F.expr(f"array({slots})"), minute - 930)
