"""Text and date expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A cell starting with one of these is read as a formula by spreadsheets.
FORMULA_LEAD = r"^[=+@\t\r-]"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SEASON_MONTHS = (6, 7, 8)


def null_text(value: Column) -> Column:
    """Text form of a value; null becomes the empty string."""
    return F.coalesce(value.cast("string"), F.lit(""))


def first_present(*values: Column) -> Column:
    """First value that is neither null nor blank, returned untrimmed."""
    return F.coalesce(*[F.when(F.trim(value.cast("string")) != "", value) for value in values])


def is_blank(value: Column) -> Column:
    return F.trim(null_text(value)) == ""


def starts_formula(value: Column) -> Column:
    return null_text(value).rlike(FORMULA_LEAD)


def spreadsheet_safe(value: Column) -> Column:
    """Prefix an apostrophe to a cell that a spreadsheet would evaluate."""
    text = null_text(value)
    return F.when(text.rlike(FORMULA_LEAD), F.concat(F.lit("'"), text)).otherwise(text)


def spreadsheet_unescape(value: Column) -> Column:
    """Inverse of :func:`spreadsheet_safe`; null where the cell was not escaped by it."""
    rest = F.substring(value, 2, 1 << 30)
    return F.when(value.startswith("'") & rest.rlike(FORMULA_LEAD), rest)


def parse_slash_date(value: Column, strict: bool = True) -> Column:
    """Date from the first ten characters, ``yyyy/MM/dd`` or ``yyyy-MM-dd``."""
    text = F.replace(F.left(null_text(value), F.lit(10)), F.lit("/"), F.lit("-"))
    parsed = F.when(text.rlike(ISO_DATE), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).cast("date"))
    if not strict:
        return parsed
    problem = F.raise_error(F.concat(F.lit("invalid date: "), null_text(value))).cast("date")
    return F.when(parsed.isNotNull(), parsed).otherwise(problem)


def is_iso_date(value: Column) -> Column:
    text = null_text(value)
    return F.coalesce(text.rlike(ISO_DATE) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull(), F.lit(False))


def is_iso8601(value: Column) -> Column:
    """A date, or a date-time with optional fraction and zone, whose fields exist in the calendar.

    The text is parsed in parts: the date and time of day, then what is left after a fraction of
    any length, which must be empty, ``Z`` or an offset that exists (with or without colon).
    """
    text = null_text(value)
    clock = F.try_to_timestamp(F.left(text, F.lit(19)), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    rest = F.substring(text, 20, 1 << 30)
    zone = F.when(rest.startswith("."), F.ltrim(F.substring(rest, 2, 1 << 30), F.lit("0123456789"))).otherwise(rest)
    digits = F.when(rest.startswith("."), F.length(rest) - F.length(zone) > 1).otherwise(True)
    parse = lambda form: F.try_to_timestamp(F.concat(F.lit("2000-01-01T00:00:00"), zone), F.lit("yyyy-MM-dd'T'HH:mm:ss" + form))
    signed = zone.startswith("+") | zone.startswith("-")
    offset = signed & (((F.length(zone) == 6) & parse("xxx").isNotNull()) | ((F.length(zone) == 5) & parse("xx").isNotNull()))
    valid = (F.length(text) >= 19) & clock.isNotNull() & digits & ((zone == "") | (zone == "Z") | F.coalesce(offset, F.lit(False)))
    return is_iso_date(value) | F.coalesce(valid, F.lit(False))


def is_season(day: Column) -> Column:
    """June, July or August."""
    return F.month(day).isin(*SEASON_MONTHS)


def decode_day_offset(units: Column, offset: Column) -> Column:
    """Date for an integer offset under a ``days since yyyy-MM-dd`` unit."""
    base = F.regexp_extract(units, r"days since (\d{4}-\d{2}-\d{2})", 1)
    return F.date_add(F.try_to_timestamp(base, F.lit("yyyy-MM-dd")).cast("date"), offset.cast("int"))


def decode_packed(raw: Column, sentinels: list[float], scale: float, offset: float) -> Column:
    """Missing sentinels become null before scale and offset are applied."""
    if not (scale > 0 and abs(offset) < float("inf")):
        raise ValueError("scale must be positive and offset finite")
    return F.when(raw.isin(*sentinels), F.lit(None).cast("double")).otherwise(raw * F.lit(scale) + F.lit(offset))
