"""Column expressions for names, numbers and times; all stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What is trimmed from names and numbers, and the characters a number may have.
BLANKS, NUMBER_CHARACTERS = " \t\n\r\x0b\f", "0123456789+-.eE"


def _trim(c: Column) -> Column:
    return F.trim(c, F.lit(BLANKS))


def norm_name(c: Column | str) -> Column:
    """Trimmed, lower case, with ``-``, ``_``, ``.`` and blank all shown as ``-``; NULL stays NULL."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.lower(_trim(c)), "_. ", "---")


def norm_label(c: Column | str) -> Column:
    """Like :func:`norm_name`, in the form of an enum constant: upper case joined by ``_``."""
    c = F.col(c) if isinstance(c, str) else c
    return F.translate(F.upper(_trim(c)), "-. ", "___")


def norm_token(c: Column | str) -> Column:
    """Trimmed and lower case."""
    c = F.col(c) if isinstance(c, str) else c
    return F.lower(_trim(c))


def finite(c: Column | str) -> Column:
    """The double itself, or NULL where it is NULL, NaN or infinite."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), c)


def usable_number(c: Column | str) -> Column:
    """Text as a finite double, or NULL where the trimmed text is no finite number.

    Sign, digits, point and exponent are all a number may have: of texts of these characters a
    cast takes just those that are numbers, so no pattern is matched.
    """
    c = F.col(c) if isinstance(c, str) else c
    t = _trim(c)
    return finite(F.when(F.translate(t, NUMBER_CHARACTERS, "") == "", t.try_cast("double")))


def epoch_ms(c: Column | str) -> Column:
    """Epoch seconds (DOUBLE) as whole milliseconds; NULL, NaN and infinite times become NULL."""
    return F.round(finite(c) * 1000.0).cast("bigint")
