"""Numbers in text form and numbers fit for JSON."""

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

def div(a: Column, b: Column | int) -> Column:
    """Whole-number division, exact for bigint and decimal."""
    return F.call_function("div", a, b if isinstance(b, Column) else F.lit(b))


def _decimal_digits() -> tuple[str, str]:
    """All characters that are decimal digits, and the digit of each."""
    found = [chr(c) for c in range(0x80, 0x110000) if unicodedata.category(chr(c)) == "Nd"]
    return "".join(found), "".join(str(unicodedata.digit(c)) for c in found)


_DIGITS, _VALUES = _decimal_digits()


def whole_number_sql(digits: str) -> str:
    """SQL of a text of decimal digits, in any script and of any length, as a canonical
    number: ASCII digits without leading zeros; null for the empty text."""
    return (f"if({digits} = '', null, coalesce(nullif(ltrim('0', if({digits} rlike '^[0-9]+$', {digits}, "
            f"translate({digits}, '{_DIGITS}', '{_VALUES}'))), ''), '0'))")


# A decimal literal: what a strict number parser accepts. Java would also take
# "5d" or "0x1p3", and "nan" or "Infinity" are no measurements.
_NUMBER = r"^\s*[+-]?(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?\s*$"


def finite_number(text: Column) -> Column:
    """Double value of a numeric text, else null. Never NaN or infinite."""
    value = F.when(text.rlike(_NUMBER), F.trim(text).try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def finite_only(value: Column) -> Column:
    """JSON-safe text of a double: ``nan``, ``inf`` and ``-inf`` become strings."""
    return (F.when(F.isnan(value), F.lit("nan"))
            .when(value == float("inf"), F.lit("inf"))
            .when(value == float("-inf"), F.lit("-inf"))
            .otherwise(value.cast("string")))


def ms_text(us: Column) -> Column:
    """Milliseconds with up to three digits from whole microseconds, exact at any size."""
    us = us.cast("bigint")
    frac = F.rtrim(F.lpad((us % 1000).cast("string"), 3, "0"), F.lit("0"))
    return F.concat(div(us, 1000).cast("string"), F.lit("."),
                    F.when(frac == "", F.lit("0")).otherwise(frac))


def percent(part: Column, whole: Column) -> Column:
    """Share in percent, two digits; null when the whole is zero."""
    return F.round(part / F.nullif(whole, F.lit(0)) * 100, 2)
