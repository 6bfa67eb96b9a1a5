"""Service-day clocks, calendars and instants as Column expressions.

Clocks are integer seconds from the start of the service day and may pass 24:00:00. Text that
is not a clock gives null, never a guess.
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86_400
#: Day rules of published timetables, Monday = 0 ... Sunday = 6, holiday = 7; fixed values.
DAY_RULES = {
    "每日": [0, 1, 2, 3, 4, 5, 6, 7],
    "星期一至五": [0, 1, 2, 3, 4],
    "星期一至六": [0, 1, 2, 3, 4, 5],
    "星期六": [5],
    "星期日": [6],
    "星期日及公眾假期": [6, 7],
    "星期六、日及公眾假期": [5, 6, 7],
    "公眾假期": [7],
}


def seconds(text: Column, hours_below: int | None = None, seconds_optional: bool = False) -> Column:
    """'H+:MM:SS' to seconds (hours unbounded unless hours_below); null where it is no clock."""
    shape = r"^\s*\d{1,3}:[0-5]\d(:[0-5]\d)?\s*$" if seconds_optional else r"^\s*\d{1,3}:[0-5]\d:[0-5]\d\s*$"
    part = F.split(F.trim(text), ":")
    number = lambda i: F.coalesce(F.try_element_at(part, F.lit(i)).try_cast("int"), F.lit(0))
    good = text.rlike(shape)
    if hours_below is not None:
        good &= number(1) < hours_below
    return F.when(good, number(1) * 3600 + number(2) * 60 + number(3)).cast("int")


def clock(value: Column) -> Column:
    """Seconds to 'HH:MM:SS' with hours beyond 23; fractions are rounded half to even."""
    whole = F.bround(value.cast("double")).cast("bigint")
    return F.format_string("%02d:%02d:%02d", F.floor(whole / 3600), F.floor(whole / 60) % 60, whole % 60)


def night_clock(text: Column, rolls_below: int = 3) -> Column:
    """'H:MM' to seconds; an hour under rolls_below belongs to the night of the day before (+24 h)."""
    part = F.split(F.trim(text), ":")
    hour, minute = part[0].try_cast("int"), F.try_element_at(part, F.lit(2)).try_cast("int")
    good = text.rlike(r"^\s*\d{1,2}:[0-5]\d\s*$")
    return F.when(good, (hour + F.when(hour < rolls_below, 24).otherwise(0)) * 3600 + minute * 60).cast("int")


def twelve_hour(text: Column) -> Column:
    """'7.30 p.m.', '12:05am', 'noon', 'midnight' to seconds."""
    low = F.lower(F.trim(text))
    shape = r"^(\d{1,2})[.:](\d{2})\s*([ap])\.?m\.?$"
    hour, minute, half = (F.regexp_extract(low, shape, i) for i in (1, 2, 3))
    value = (hour.try_cast("int") % 12 + F.when(half == "p", 12).otherwise(0)) * 3600 + minute.try_cast("int") * 60
    usable = low.rlike(shape) & hour.try_cast("int").between(1, 12) & (minute.try_cast("int") < 60)
    return F.when(low.isin("noon", "12 noon", "12.00 noon"), 43_200).when(low.isin("midnight", "12 midnight", "12.00 midnight"), 0).when(usable, value).cast("int")


def strict_instant(text: Column) -> Column:
    """ISO-8601 with an explicit offset to a timestamp; a naive time is null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(text))


def local_instant(text: Column, zone: str = "Asia/Hong_Kong") -> Column:
    """ISO-8601 to a timestamp; a naive time is local to the zone."""
    naive = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d+)?)?$")
    return F.when(naive, F.to_utc_timestamp(F.try_to_timestamp(text), zone)).otherwise(strict_instant(text))


def epoch(instant: Column) -> Column:
    return F.unix_timestamp(instant.cast("timestamp"))


def minutes_to_seconds(minutes: Column) -> Column:
    """Minutes to seconds, half to even; null stays null."""
    return F.bround(minutes.cast("double") * 60).cast("int")


def day_category(date: Column, is_holiday: Column) -> Column:
    """0-6 from Monday, or 7 on a holiday in place of the weekday."""
    return F.when(is_holiday, F.lit(7)).otherwise(F.weekday(date)).cast("int")


def day_rule(text: Column) -> Column:
    """Days of a published day rule, null where the wording is unknown."""
    pairs = [x for k, days in DAY_RULES.items() for x in (F.lit(k), F.array(*[F.lit(d) for d in days]))]
    return F.try_element_at(F.create_map(*pairs), F.regexp_replace(text, r"\s+", ""))


def active_on(date: Column, weekday_bits: list[Column], start: Column, end: Column, exception: Column) -> Column:
    """Service on a date: exception 1 adds, 2 removes, else the weekday's bit inside the range."""
    bit = F.element_at(F.array(*[b.cast("int") for b in weekday_bits]), F.weekday(date) + 1) == 1
    return F.when(exception == 1, True).when(exception == 2, False).otherwise(F.coalesce(bit & date.between(start, end), F.lit(False)))


def dates_between(start: Column, end: Column) -> Column:
    return F.when(start <= end, F.sequence(start, end)).otherwise(F.array().cast("array<date>"))


def wait_minutes(seconds_left: Column) -> Column:
    """Whole minutes until an arrival, rounded up, never negative."""
    return F.greatest(F.lit(0), F.ceil(seconds_left / 60)).cast("int")


def frequency_wait(at: Column, start: Column, end: Column, headway: Column, exact: Column) -> Column:
    """Seconds until boarding in a band [start, end): the next listed start, or a full headway as upper bound."""
    later = F.greatest(at, start)
    listed = start + F.ceil((later - start) / headway) * headway
    board = F.when(exact == 1, listed).otherwise(later + headway)
    return F.when((later < end) & ((exact != 1) | (listed < end)), board - at).cast("int")
