"""Partial dates, episodes and durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_instant(text: Column) -> Column:
    """ISO text, taken as UTC if it names no zone; null if it is none."""
    return F.try_to_timestamp(text)


def is_partial_date(text: Column) -> Column:
    month = F.rlike(text, F.lit(r"^\d{4}-\d{2}$")) & F.try_to_timestamp(F.concat(text, F.lit("-01")), F.lit("yyyy-MM-dd")).isNotNull()
    day = F.rlike(text, F.lit(r"^\d{4}-\d{2}-\d{2}$")) & F.try_to_timestamp(text, F.lit("yyyy-MM-dd")).isNotNull()
    return F.coalesce(month | day, F.lit(False))


def period_start(text: Column) -> Column:
    return F.when(is_partial_date(text), F.try_to_timestamp(F.rpad(text, 10, "-01"), F.lit("yyyy-MM-dd")).cast("date"))


def period_end(text: Column) -> Column:
    return F.when(F.length(text) == 7, F.last_day(period_start(text))).otherwise(period_start(text))


def episode_fault(start: Column, end: Column, ongoing: Column, end_required: bool = True) -> Column:
    """What is wrong with an episode, or null. Medications need an end unless ongoing; events don't."""
    missing = F.when(~ongoing & end.isNull(), F.lit("end required")) if end_required else F.when(ongoing & end.isNotNull(), F.lit("ongoing forbids an end"))
    known_end = F.when(ongoing, F.lit(None).cast("string")).otherwise(end) if end_required else end
    return F.coalesce(
        F.when(~is_partial_date(start), F.lit("bad start")),
        missing,
        F.when(known_end.isNotNull() & ~is_partial_date(known_end), F.lit("bad end")),
        F.when(period_end(known_end) < period_start(start), F.lit("end before start")),
    )


def at_noon(date: Column) -> Column:
    return F.to_timestamp(date) + F.make_dt_interval(hours=F.lit(12))


def bar_end(start: Column, end: Column, ongoing: Column, now: Column, medication: bool) -> Column:
    """The day a timeline bar ends on: never before it starts."""
    last = F.when(ongoing, now).when(end.isNotNull(), period_end(end)).otherwise(period_end(start) if medication else period_start(start))
    return F.greatest(last, period_start(start))


def duration_label(days: Column) -> Column:
    weeks, months = F.floor(days / 7 + 0.5), F.floor(days / 30.44 + 0.5)
    word = lambda n, unit: F.concat(n.cast("int").cast("string"), F.lit(f" {unit}"), F.when(n == 1, F.lit("")).otherwise(F.lit("s")))
    return F.when(days < 1, F.lit("<1 day")).when(days < 14, word(days, "day")).when(days < 60, word(weeks, "week")).otherwise(word(months, "month"))


def month_key(text: Column) -> Column:
    return F.substring(text, 1, 7)


def log_duration(ms: Column) -> Column:
    """Milliseconds, seconds (two decimals below ten), minutes and seconds, or hours and minutes; halves go up."""
    whole = F.floor(ms / 1000 + 0.5)
    minutes, number = F.floor(whole / 60), lambda x: x.cast("long").cast("string")
    seconds = F.when(ms < 10_000, F.format_string("%.2fs", ms / 1000.0)).otherwise(F.format_string("%.1fs", ms / 1000.0))
    short = F.concat(number(minutes), F.lit("m "), number(whole % 60), F.lit("s"))
    long_ = F.concat(number(F.floor(minutes / 60)), F.lit("h "), number(minutes % 60), F.lit("m"))
    finite = F.coalesce(F.abs(ms.cast("double")) < float("inf"), F.lit(False))
    return F.when(~finite, F.lit("—")).when(ms < 1000, F.concat(number(F.floor(ms + 0.5)), F.lit("ms"))).when(ms < 60_000, seconds).otherwise(F.when(minutes < 60, short).otherwise(long_))
