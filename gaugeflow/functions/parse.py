"""Column parsers for messy numbers, dates and coordinates; built-in functions only.

A value that cannot be parsed is null.  Casts never raise, also in ANSI mode.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The markers of missing values.
MISSING = ["", "-", "na", "n/a", "nan", "null", "nil", "bdl", "below detection", "nd", "not detected"]
MISSING_CELL = r"(?i)^(bdl|nd|nr|na|nil|n/?a|-+|\*+)$"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once; written out, long bodies don't compile."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def number(text: Column) -> Column:
    """A finite double of a trimmed text, else null.

    Casts also take hexadecimal numbers and numbers with a letter of their type
    behind them, which hold an x or don't end in a digit or point.
    """
    trimmed = F.trim(text)
    last = F.ascii(F.right(trimmed, F.lit(1)))
    plain = (last.between(48, 57) | (last == 46)) & ~F.contains(trimmed, F.lit("x")) & ~F.contains(trimmed, F.lit("X"))
    return F.when(plain, finite(trimmed))


def finite(value: Column) -> Column:
    """``value`` as a double with NaN and infinities as null."""
    as_double = value.try_cast("double")
    return F.when(~F.isnan(as_double) & (F.abs(as_double) < F.lit(float("inf"))), as_double)


def safe_float(text: Column) -> Column:
    """A number; a range ``a-b`` gives its middle; ``<>≤≥`` in front and commas are dropped."""
    s = F.trim(text)
    at = F.instr(s, "-")
    low, high = number(F.substring(s, F.lit(1), at - 1)), number(F.substring(s, at + 1, F.length(s)))
    spread = F.when((at > 1) & (F.substring_index(s, "-", 2) == s), (low + high) / 2)
    plain = number(F.replace(F.ltrim(s, F.lit("<>≤≥")), F.lit(","), F.lit("")))
    return F.when(F.lower(s).isin(MISSING), F.lit(None).cast("double")).otherwise(F.coalesce(spread, plain))


def to_numeric(text: Column) -> Column:
    """A number after commas are dropped; everything else is null."""
    return number(F.replace(text, F.lit(","), F.lit("")))


def table_number(text: Column) -> Column:
    """A number of a table cell; falls back on the first number in the text."""
    return _bound(F.regexp_replace(F.trim(text), r"[<>≤≥~]|\s+", ""), _cell_number)


def _cell_number(s: Column) -> Column:
    spread = r"^(\d+\.?\d*)[-–](\d+\.?\d*)$"
    middle = (number(F.regexp_extract(s, spread, 1)) + number(F.regexp_extract(s, spread, 2))) / 2
    bare = F.replace(s, F.lit(","), F.lit(""))
    first = number(F.regexp_extract(bare, r"(\d+\.?\d*)", 1))
    return F.when((s == "") | s.rlike(MISSING_CELL), F.lit(None).cast("double")).otherwise(
        F.coalesce(middle, number(bare), first)
    )


def made_date(year: Column, month: Column, day: Column) -> Column:
    """A date of whole numbers as text; null if there is no such day."""
    parts = [F.lpad(p, n, "0") for p, n in ((year, 4), (month, 2), (day, 2))]
    filled = (F.length(year) > 0) & (F.length(month) > 0) & (F.length(day) > 0)
    return F.when(filled, F.try_to_date(F.concat_ws("-", *parts), "yyyy-MM-dd"))


def _groups(text: Column, pattern: str, *order: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in order]


def safe_date(text: Column) -> Column:
    """A date of the first ten characters, of five orders (day before month); else the year's first day."""
    s = F.trim(text)
    head = F.substring(s, 1, 10)
    found = F.coalesce(
        made_date(*_groups(head, r"^(\d{4})-(\d{1,2})-(\d{1,2})$", 1, 2, 3)),
        made_date(*_groups(head, r"^(\d{1,2})-(\d{1,2})-(\d{4})$", 3, 2, 1)),
        made_date(*_groups(head, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 2, 1)),
        made_date(*_groups(head, r"^(\d{4})/(\d{1,2})/(\d{1,2})$", 1, 2, 3)),
        made_date(*_groups(head, r"^(\d{1,2})/(\d{1,2})/(\d{4})$", 3, 1, 2)),
        made_date(F.regexp_extract(s, r"^(\d{4})", 1), F.lit("1"), F.lit("1")),
    )
    return F.when(~F.lower(s).isin("", "nat", "nan", "none"), found)


def _month(name: Column) -> Column:
    """The number of a month by the first three letters of its name, as text; else empty."""
    at = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(name, 1, 3)))
    return F.when(at > 0, at.cast("string")).otherwise("")


def parse_date(text: Column) -> Column:
    """A date in the ways of mixed sources: ISO with or without time, day first with two or
    four digits of the year, month names, quarters, and day numbers of spreadsheets."""
    s = F.trim(F.replace(F.regexp_replace(F.trim(text), r"\s*[+-]\d{2}:\d{2}$", ""), F.lit("Z"), F.lit("")))
    digit = lambda x: F.ascii(x).between(48, 57)
    return _bound(s, lambda x: F.when(digit(x), _date_of_digits(x)).otherwise(_date_of_words(x)))


def _date_of_digits(s: Column) -> Column:
    """A date that begins with a digit."""
    iso = r"^(\d{4})-(\d{1,2})-(\d{1,2})(?:[T ].*)?$"
    dmy = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{4})"
    short = r"^(\d{1,2})[/.-](\d{1,2})[/.-](\d{2})$"
    yy = F.regexp_extract(s, short, 3)
    century = F.when(yy == "", "").when(yy.try_cast("int") < 50, F.concat(F.lit("20"), yy)).otherwise(
        F.concat(F.lit("19"), yy)
    )
    day_first, year_month = r"^(\d{1,2})\s+([A-Za-z]+)\s+(\d{4})", r"^(\d{4})\s+([A-Za-z]+)"
    quarter = F.regexp_extract(s, r"^(\d{4})-?[Qq]([1-4])", 2)
    serial = number(s)
    one = F.lit("1")
    return F.coalesce(
        made_date(*_groups(s, iso, 1, 2, 3)),
        made_date(*_groups(s, dmy, 3, 2, 1)),
        made_date(*_groups(s, r"^(\d{4})/(\d{1,2})/(\d{1,2})", 1, 2, 3)),
        made_date(century, *_groups(s, short, 2, 1)),
        made_date(F.regexp_extract(s, day_first, 3), _month(F.regexp_extract(s, day_first, 2)), F.regexp_extract(s, day_first, 1)),
        made_date(F.regexp_extract(s, year_month, 1), _month(F.regexp_extract(s, year_month, 2)), one),
        made_date(
            F.regexp_extract(s, r"^(\d{4})-?[Qq]([1-4])", 1),
            F.when(quarter == "", "").otherwise((quarter.try_cast("int") * 3 - 2).cast("string")),
            one,
        ),
        F.when((serial > 30000) & (serial < 60000), F.date_add(F.lit("1899-12-30").cast("date"), serial.cast("int"))),
    )


def _date_of_words(s: Column) -> Column:
    """A date that begins with the name of a month."""
    month_first, month_year = r"^([A-Za-z]+)\s+(\d{1,2}),?\s+(\d{4})", r"^([A-Za-z]+)\s+(\d{4})"
    return F.coalesce(
        made_date(F.regexp_extract(s, month_first, 3), _month(F.regexp_extract(s, month_first, 1)), F.regexp_extract(s, month_first, 2)),
        made_date(F.regexp_extract(s, month_year, 2), _month(F.regexp_extract(s, month_year, 1)), F.lit("1")),
    )


def mixed_timestamp(text: Column, formats: tuple[str, ...] = ("yyyy-MM-dd'T'HH:mm:ss[.SSS]XXX", "yyyy-MM-dd HH:mm:ss", "dd-MM-yyyy HH:mm", "yyyy-MM-dd")) -> Column:
    """The first of ``formats`` that parses."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def coordinate(text: Column) -> Column:
    """Decimal degrees of a decimal, degree-minute-second or degree-minute text; S and W are negative."""
    s = F.trim(text)
    dms = r"""(?i)^(\d+)[°\s]+(\d+)['\s]+(\d+(?:\.\d+)?)["″\s]*([NSEW])?"""
    dm = r"""(?i)^(\d+)[°\s]+(\d+(?:\.\d+)?)['\s]*([NSEW])?"""
    part = lambda p, k: F.regexp_extract(s, p, k).try_cast("double")
    sign = lambda p, k: F.when(F.upper(F.regexp_extract(s, p, k)).isin("S", "W"), -1.0).otherwise(1.0)
    return F.coalesce(
        number(s),
        sign(dms, 4) * (part(dms, 1) + part(dms, 2) / 60 + part(dms, 3) / 3600),
        sign(dm, 3) * (part(dm, 1) + part(dm, 2) / 60),
    )
