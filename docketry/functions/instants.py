"""Dates and instants. Instants need an explicit offset; text without one is unusable."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from docketry.functions.text import _col

_OFFSET_TEXT = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})$"


def parse_instant(text: Column | str) -> Column:
    """Offset ISO text as an instant, otherwise null."""
    value = F.trim(_col(text))
    return F.when(value.rlike(_OFFSET_TEXT), F.try_to_timestamp(value))


def instant_le(left: Column | str, right: Column | str) -> Column:
    """``left <= right`` as instants; false when either side cannot be read."""
    return F.coalesce(parse_instant(left) <= parse_instant(right), F.lit(False))


def compact_to_date(text: Column | str) -> Column:
    """Date in the first eight digits of a text such as a receipt number, else null."""
    value = _col(text).cast("string")
    return F.when(value.rlike(r"^\d{8}"), F.try_to_date(F.substring(value, 1, 8), "yyyyMMdd"))


def compact_to_iso(text: Column | str) -> Column:
    """Eight digits as ``yyyy-mm-dd``; any other text is returned unchanged."""
    value = _col(text)
    split = F.concat_ws("-", F.substring(value, 1, 4), F.substring(value, 5, 2), F.substring(value, 7, 2))
    return F.when(value.rlike(r"^\d{8}$"), split).otherwise(value)


def monday_of(day: Column | str) -> Column:
    return F.date_trunc("week", _col(day)).cast("date")


def week_label(monday: Column | str) -> Column:
    """Month and day of the first and last day of a week; the month is not repeated inside one month."""
    first = _col(monday)
    last = F.date_add(first, 6)
    head = F.concat(F.month(first).cast("string"), F.lit("월 "), F.dayofmonth(first).cast("string"), F.lit("일~"))
    tail = F.concat(F.dayofmonth(last).cast("string"), F.lit("일"))
    month = F.when(F.month(first) != F.month(last), F.concat(F.month(last).cast("string"), F.lit("월 "))).otherwise("")
    return F.concat(head, month, tail)


def covered_until(finished: Column | str, window_end: Column | str, zone: str = "Asia/Seoul") -> Column:
    """Earlier of the finish instant and midnight after the window's last day in ``zone``."""
    midnight = F.to_utc_timestamp(F.date_add(_col(window_end), 1).cast("timestamp"), zone)
    return F.when(_col(finished).isNotNull(), F.least(_col(finished), midnight))


def target_years(day: Column | str, count: int = 3) -> Column:
    """Fiscal years to hold, newest first: the last year from April on, the year before that until March."""
    latest = F.year(_col(day)) - F.when(F.month(_col(day)) >= 4, 1).otherwise(2)
    return F.sequence(latest, latest - F.lit(count - 1), F.lit(-1))


def catchup_days(today: Column | str, since: Column | str, limit: int) -> Column:
    """Days to read this run, oldest first: from the last confirmed day or yesterday, at most ``limit``."""
    yesterday = F.date_sub(_col(today), 1)
    start = F.least(yesterday, F.coalesce(_col(since), yesterday))
    return F.slice(F.sequence(start, _col(today)), 1, limit)
