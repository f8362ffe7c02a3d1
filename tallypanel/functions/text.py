"""Text labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallypanel.functions.days import day_label, parse_day

# The characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def zero_pad(text: Column) -> Column:
    """Pad one character to two; longer text stays whole (``lpad`` would cut it)."""
    return F.when(F.length(text) == 1, F.concat(F.lit("0"), text)).otherwise(text)


def date_text(text: Column) -> Column:
    """``yyyy-M-d`` text to ``MM-dd-yyyy`` text; NULL if it is no day of the calendar."""
    return day_label(parse_day(text, strict=False))


def clean_label(text: Column) -> Column:
    """The second comma-separated field if ``", "`` occurs, else all of it; stripped."""
    field = F.when(F.contains(text, F.lit(", ")), F.split_part(text, F.lit(","), F.lit(2)))
    return F.btrim(field.otherwise(text), F.lit(WHITESPACE))


def thousands(number: Column) -> Column:
    """``1234567`` to ``1,234,567``."""
    return F.format_number(number, 0)


def elapsed_label(elapsed: Column) -> Column:
    """Day-time interval to ``MM min SS sec``; full hours are left out."""
    minutes = F.extract(F.lit("MINUTE"), elapsed).cast("int")
    seconds = F.floor(F.extract(F.lit("SECOND"), elapsed)).cast("int")
    return F.format_string("%02d min %02d sec", minutes, seconds)
