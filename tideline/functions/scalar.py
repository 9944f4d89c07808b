"""Scalar column expressions: parsing, cleansing, guarded arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.schemas import DIGIT_SYMBOL_EXCEPTIONS, INVALID_SYMBOL_PARTS


def _c(col: Column | str) -> Column:
    return F.col(col) if isinstance(col, str) else col


def nan_to_null(col: Column | str) -> Column:
    """NaN is a value to Spark (and sorts above everything); make it NULL once, on ingest."""
    return F.nullif(_c(col), F.lit(float("nan")))


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """NULL instead of an error on a zero divisor (ANSI mode stays on)."""
    return F.try_divide(_c(num), _c(den))


def parse_date(col: Column | str) -> Column:
    """Strict date: malformed text raises."""
    return F.to_date(_c(col))


def parse_period(col: Column | str) -> Column:
    """Lenient period to first day: ``YYYY``, ``YYYY-MM``, ``YYYY-MM-DD``, ``YYYY-Qn``; else NULL."""
    text = F.trim(_c(col))
    months = (F.right(text, F.lit(1)).try_cast("int") - 1) * 3
    quarter = F.add_months(F.try_to_date(F.left(text, F.lit(4))), months)
    return F.coalesce(F.try_to_date(text), F.when(text.rlike(r"^\d{4}-?Q[1-4]$"), quarter))


def parse_number(col: Column | str) -> Column:
    """Lenient double: unparsable text and NaN become NULL.

    The JVM parser would take a type suffix ("1.5d"), which is not a number in a
    data file, so a suffix is made unparsable first.
    """
    text = F.regexp_replace(_c(col).cast("string"), r"(?<=[\d.])[dDfF]\s*$", "?")
    return nan_to_null(text.try_cast("double"))


def cleanse_number(col: Column | str) -> Column:
    """Text number from a hand-edited CSV: thousands commas removed, missing tokens to NULL.

    Blank, ``NA``, ``N/A``, ``null``, ``None`` and ``.`` do not parse, and
    ``NaN`` parses to NaN; all come out as NULL.
    """
    return parse_number(F.replace(_c(col).cast("string"), F.lit(","), F.lit("")))


def unix_date(col: Column | str) -> Column:
    """Unix seconds to the UTC calendar day, independent of the session time zone."""
    return F.date_from_unix_date(F.floor(_c(col) / F.lit(86400)).cast("int"))


def date_parts(col: Column | str = "date") -> list[Column]:
    c = _c(col)
    return [F.year(c).alias("year"), F.month(c).alias("month"), F.dayofmonth(c).alias("day")]


def is_weekday(col: Column | str = "date") -> Column:
    """Monday to Friday (``weekday`` counts from Monday = 0)."""
    return F.weekday(_c(col)) <= 4


def pair_symbol(col: Column | str) -> Column:
    """``BTC-USD`` to ``BTC``; other tickers unchanged."""
    c = _c(col)
    return F.when(c.endswith("-USD"), F.replace(c, F.lit("-USD"), F.lit(""))).otherwise(c)


def series_id_parts(col: Column | str) -> dict[str, Column]:
    """``provider/dataset/code…`` split; the code keeps any further slashes."""
    parts = F.split(_c(col), "/")
    return {
        "provider": F.try_element_at(parts, F.lit(1)),
        "dataset": F.try_element_at(parts, F.lit(2)),
        "series_code": F.array_join(F.slice(parts, 3, F.greatest(F.size(parts) - 2, F.lit(0))), "/"),
    }


def is_valid_ticker(col: Column | str) -> Column:
    """Common-stock symbol test: no warrants, units, rights, preferreds, long or numeric symbols."""
    c = _c(col)
    upper = F.upper(c)
    clean = F.lit(True)
    for part in INVALID_SYMBOL_PARTS:
        clean = clean & ~F.contains(upper, F.lit(part))
    # text after the last "-P" empty or a single letter marks a preferred share
    preferred = F.contains(upper, F.lit("-P")) & F.substring_index(upper, "-P", -1).rlike(r"^\p{L}?$")
    numeric = c.rlike(r"\p{Nd}") & ~c.isin(*DIGIT_SYMBOL_EXCEPTIONS)
    return clean & ~preferred & (F.length(c) <= 5) & ~numeric


def snake_name(name: str) -> str:
    """Landed column name to snake case."""
    return name.lower().replace(" ", "_")
