"""Date parsing and epidemiological calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from casewatch import presets
from casewatch.functions.numbers import within
from casewatch.functions.text import col, strip

_TIME = r"(?:[T ]+([0-9]{1,2}):([0-9]{2})(?::([0-9]{2}(?:\.[0-9]{1,6})?))?)?"
_YEAR_FIRST = rf"^([0-9]{{4}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{1,2}}){_TIME}Z?$"
_YEAR_LAST = rf"^([0-9]{{1,2}})[-/.]([0-9]{{1,2}})[-/.]([0-9]{{4}}|[0-9]{{2}}){_TIME}$"
_COMPACT = rf"^([0-9]{{4}})([0-9]{{2}})([0-9]{{2}}){_TIME}$"
# Year, month and day, with a time of seconds or without: what a cast reads by itself.
_PLAIN = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?:[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)?\z"
_NAMED_FORMATS = ("d MMM yyyy", "d-MMM-yyyy", "MMM d, yyyy", "d MMMM yyyy", "MMMM d, yyyy")


def _timestamp(year: Column, first: Column, second: Column, parts: list[Column]) -> Column:
    """Month-first reading; the two swap when the first cannot be a month."""
    a, b = first.cast("int"), second.cast("int")
    month, day = F.when(a <= 12, a).otherwise(b), F.when(a <= 12, b).otherwise(a)
    hour, minute, second_ = parts
    return F.try_make_timestamp_ntz(
        year.cast("int"), month, day,
        F.coalesce(hour.cast("int"), F.lit(0)),
        F.coalesce(minute.cast("int"), F.lit(0)),
        F.coalesce(F.nullif(second_, F.lit("")), F.lit("0")).cast("decimal(16,6)"),
    )


def parse_date(value: str | Column) -> Column:
    """Two-pass date reading: month first, then day first for what is left.

    The numeric layouts are told apart by pattern, split once and assembled
    with ``try_make_timestamp_ntz``, which costs no parser exception per bad row.
    A date whose first number exceeds 12 can only be day first, so the second
    pass is the swap in ``_timestamp``. Dates that a cast reads alike skip all of it.
    """
    raw = col(value).cast("string")
    plain = F.when(raw.rlike(_PLAIN), raw.try_cast("timestamp_ntz"))
    text = strip(raw)
    # One split serves all layouts: date numbers, then hour, minute, second, fraction.
    pieces = F.split(text, "[-/.T :Z]+")
    part = [F.nullif(F.get(pieces, i), F.lit("")) for i in range(7)]
    clock = [part[3], part[4], F.concat_ws(".", part[5], part[6])]
    compact_clock = [part[1], part[2], F.concat_ws(".", part[3], part[4])]
    short = part[2].cast("int")
    full_year = F.when(F.length(part[2]) == 4, short).when(
        short < 69, short + 2000
    ).otherwise(short + 1900)
    compact = [F.substring(part[0], at, n) for at, n in ((1, 4), (5, 2), (7, 2))]
    named = F.coalesce(*[
        F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in _NAMED_FORMATS
    ])
    by_layout = (
        F.when(text.rlike(_YEAR_FIRST), _timestamp(*part[:3], clock))
        .when(text.rlike(_YEAR_LAST), _timestamp(full_year, *part[:2], clock))
        .when(text.rlike(_COMPACT), _timestamp(*compact, compact_clock))
        .when(text.rlike("[A-Za-z]{3}"), named)
    )
    return F.coalesce(plain, by_layout)


def _fits_week(year: Column, week: Column) -> Column:
    """The week exists in that ISO year: 28 December is always in its last week."""
    last = F.weekofyear(F.make_date(year, F.lit(12), F.lit(28)))
    return year.between(1, 9999) & (week >= 1) & (week <= last)


def iso_week_monday(year: str | Column, week: str | Column) -> Column:
    """Monday of an ISO week; null for a week the year does not have."""
    y, w = col(year).cast("int"), col(week).cast("int")
    safe_year = F.when(y.between(1, 9999), y)
    first = F.trunc(F.make_date(safe_year, F.lit(1), F.lit(4)), "week")
    return F.when(_fits_week(safe_year, w), F.date_add(first, (w - 1) * 7))


def iso_week_month(year: str | Column, week: str | Column) -> Column:
    return F.month(iso_week_monday(year, week))


def calendar_week_monday(year: str | Column, week: str | Column) -> Column:
    """Monday of week ``%W`` (week 1 starts at the first Monday of the year)."""
    y, w = col(year).cast("int"), col(week).cast("int")
    first = F.trunc(F.make_date(y, F.lit(1), F.lit(7)), "week")
    return F.when(w.between(0, 53), F.date_add(first, (w - 1) * 7))


def case_month(notified: str | Column, year: str | Column, week: str | Column) -> Column:
    """Month of notification, else of the ISO week's Monday."""
    return F.coalesce(F.month(col(notified)), iso_week_month(year, week))


def _second_of_day(value: Column) -> Column:
    whole = F.hour(value) * 3600 + F.minute(value) * 60
    return whole + F.extract(F.lit("SECOND"), value)


def delay_days(
    notified: str | Column,
    onset: str | Column,
    bounds: tuple[int, int] = presets.DELAY_RANGE,
) -> Column:
    """Whole days (floor) from onset to notification inside ``bounds``, else null."""
    later, earlier = col(notified), col(onset)
    short = (_second_of_day(later) < _second_of_day(earlier)).cast("int")
    return within(F.datediff(later, earlier) - short, bounds)
