"""Posted-date strings, absolute or relative, to dates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from postlens.functions.text import let, squash

_MONTH = (
    "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|"
    "oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)
_CLOCK = r"(?:[t ,]+\d{1,2}:\d{2}.*)?$"
_ISO = r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _CLOCK
_DAY_NAME_YEAR = rf"^(?:[a-z]+,? )?(\d{{1,2}})(?:st|nd|rd|th)?[ -]({_MONTH})[.,]?[ -](\d{{4}})" + _CLOCK
_NAME_DAY_YEAR = rf"^(?:[a-z]+,? )?({_MONTH})\.? (\d{{1,2}})(?:st|nd|rd|th)?,? (\d{{4}})" + _CLOCK
_NUMERIC = r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})" + _CLOCK
_MONTH_INDEX = "janfebmaraprmayjunjulaugsepoctnovdec"


def _ymd(year: Column, month: Column, day: Column) -> Column:
    """A date from three numbers, NULL when they name no calendar day."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def _group(text: Column, pattern: str, index: int) -> Column:
    return F.regexp_extract(text, pattern, index)


def _month_number(name: Column) -> Column:
    return ((F.instr(F.lit(_MONTH_INDEX), F.substring(name, 1, 3)) + 2) / 3).cast("int")


def _absolute(text: Column, today: date, legacy_dayfirst: bool) -> Column:
    def number(pattern: str, index: int) -> Column:
        return _group(text, pattern, index).cast("int")

    year, month, day = (number(_ISO, i) for i in (1, 2, 3))
    if legacy_dayfirst:
        swap = day <= 12
        month, day = F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day)
    first, second, short = (number(_NUMERIC, i) for i in (1, 2, 3))
    century = today.year - today.year % 100
    long_year = (
        F.when(short >= 100, short)
        .when(short + century >= today.year + 50, short + century - 100)
        .when(short + century < today.year - 50, short + century + 100)
        .otherwise(short + century)
    )
    # Day first, unless only the other reading is a month.
    month_first = (second > 12) & (first <= 12)
    return (
        F.when(text.rlike(_ISO), _ymd(year, month, day))
        .when(
            text.rlike(_DAY_NAME_YEAR),
            _ymd(number(_DAY_NAME_YEAR, 3), _month_number(_group(text, _DAY_NAME_YEAR, 2)), number(_DAY_NAME_YEAR, 1)),
        )
        .when(
            text.rlike(_NAME_DAY_YEAR),
            _ymd(number(_NAME_DAY_YEAR, 3), _month_number(_group(text, _NAME_DAY_YEAR, 1)), number(_NAME_DAY_YEAR, 2)),
        )
        .when(
            text.rlike(_NUMERIC),
            _ymd(long_year, F.when(month_first, first).otherwise(second), F.when(month_first, second).otherwise(first)),
        )
    )


def parse_posted_date(raw: Column, today: date, legacy_dayfirst: bool = False) -> Column:
    """Date of a posting relative to ``today``; NULL when the string names no full date.

    ISO dates are read as ISO. ``legacy_dayfirst`` swaps their day and month when the day is
    at most 12, the way a day-first parser reads them.
    """
    text = F.lower(squash(F.coalesce(raw, F.lit(""))))
    return let(text, lambda t: _read(t, today, legacy_dayfirst))


def _read(text: Column, today: date, legacy_dayfirst: bool) -> Column:
    base = F.lit(today)

    def ago(unit: str, days: int) -> Column:
        count = F.regexp_extract(text, rf"(\d+)\s*\+?\s*{unit}", 1).try_cast("int")
        return F.when(count < 1_000_000, F.date_sub(base, count * days))

    def has(unit: str) -> Column:
        return text.rlike(rf"\d\s*\+?\s*(?:{unit})")

    relative = text.contains("ago") | text.contains("posted")
    cleaned = F.trim(F.regexp_replace(text, r"\bposted\b[:\s]*", ""))
    return (
        F.when(text == "", F.lit(None).cast("date"))
        .when(text.contains("today") | text.contains("just posted") | text.contains("just now"), base)
        .when(text.contains("yesterday"), F.date_sub(base, 1))
        .when(relative & has("hour|hr|minute|min"), base)
        .when(relative & has("day"), ago("day", 1))
        .when(relative & has("week"), ago("week", 7))
        .when(relative & has("month"), ago("month", 30))
        .otherwise(let(cleaned, lambda t: _absolute(t, today, legacy_dayfirst)))
    )


def epoch_millis_date(millis: Column) -> Column:
    """UTC ISO date of an epoch-milliseconds value."""
    return F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd")
