"""Minutes of a service day, clock texts and delay texts as column expressions. Service minutes may exceed 1440."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MINUTES, DAY_SECONDS = 1440, 86400
MINUS = "−"


def stamp(text: Column) -> Column:
    """`dd.mm.yyyy hh:mm[:ss]` as a timestamp without zone; null if it is none. Seconds count if they are complete."""
    kept = F.when(F.length(text) >= 19, F.substring(text, 1, 19)).when(F.length(text) >= 16, F.substring(text, 1, 16))
    return F.try_to_timestamp(kept, F.lit("dd.MM.yyyy HH:mm[:ss]")).cast("timestamp_ntz")


def service_day(text: Column) -> Column:
    return F.try_to_date(F.substring(text, 1, 10), "dd.MM.yyyy")


def seconds_between(start: Column, end: Column) -> Column:
    """As wall clocks show them: timestamps without zone know no shifts."""
    return F.timestamp_diff("SECOND", start, end)


def minute_of_day(ts: Column) -> Column:
    return F.hour(ts) * 60 + F.minute(ts)


def clock_to_minutes(text: Column) -> Column:
    """`HH:mm[:ss]` as minutes; hours may exceed 23; null if it is no clock time."""
    hours, minutes = (F.try_to_number(F.regexp_extract(text, r"^(\d{1,4}):(\d{1,2})(?::\d{1,2})?\z", g), F.lit("9999")).cast("int") for g in (1, 2))
    return F.when(minutes <= 59, hours * 60 + minutes)


def minutes_to_clock(minutes: Column) -> Column:
    m = F.pmod(minutes, F.lit(DAY_MINUTES)).cast("int")
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), F.pmod(m, F.lit(60))))


def seconds_to_clock(seconds: Column) -> Column:
    s = F.pmod(seconds, F.lit(DAY_SECONDS)).cast("int")
    shown = F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("int"), F.pmod(s, F.lit(60)))
    return F.when(s.isNotNull(), shown)


def delay_text(seconds: Column) -> Column:
    """"on time", "+1m 52s late", "-30s early"; null stays null."""
    size = F.abs(seconds).cast("int")
    minutes, rest = F.floor(size / 60).cast("int"), F.pmod(size, F.lit(60))
    amount = F.when(minutes > 0, F.format_string("%dm %ds", minutes, rest)).otherwise(F.format_string("%ds", rest))
    return F.when(seconds > 0, F.concat(F.lit("+"), amount, F.lit(" late"))).when(seconds < 0, F.concat(F.lit("-"), amount, F.lit(" early"))).when(seconds == 0, "on time")


def duration_text(seconds: Column) -> Column:
    """"m Min s Sek", leaving out what is 0."""
    m, s = F.floor(seconds / 60).cast("int"), F.pmod(seconds, F.lit(60)).cast("int")
    return F.when((m > 0) & (s > 0), F.format_string("%d Min %d Sek", m, s)).when(m > 0, F.format_string("%d Min", m)).when(seconds.isNotNull(), F.format_string("%d Sek", s))


def _minutes_seconds(size: Column) -> Column:
    return F.format_string("%d:%02d", F.floor(size / 60).cast("int"), F.pmod(size, F.lit(60)).cast("int"))


def seconds_text(seconds: Column, signed: bool = False) -> Column:
    """"40 s", "1:10", with a sign below 0, and above if signed."""
    size = F.abs(seconds).cast("int")
    sign = F.when(seconds < 0, MINUS).when((seconds > 0) & F.lit(signed), "+").otherwise("")
    return F.concat(sign, F.when(size < 60, F.format_string("%d s", size)).otherwise(_minutes_seconds(size)))


def tick_text(seconds: Column) -> Column:
    """":09" within the first minute, else "1:30" with a sign below 0."""
    size = F.abs(seconds).cast("int")
    plain = F.concat(F.when(seconds < 0, MINUS).otherwise(""), _minutes_seconds(size))
    return F.when(seconds.between(0, 60), F.format_string(":%02d", seconds.cast("int"))).otherwise(plain)


def actual_clock(planned: Column, delay: Column) -> Column:
    """When a service that is planned for a service minute leaves, by the clock; null without a delay."""
    return seconds_to_clock(F.pmod(planned, F.lit(DAY_MINUTES)) * 60 + delay)


def timeline_low(*values: Column) -> Column:
    """The timeline's start: 0, or the 30 seconds at or below the least value. Nulls are left out."""
    return F.least(F.lit(0), *[(F.floor(v / 30) * 30).cast("int") for v in values])


def timeline_high(*values: Column) -> Column:
    """The timeline's end: 60, or the 30 seconds at or above the largest value."""
    return F.greatest(F.lit(60), *[(F.ceil(v / 30) * 30).cast("int") for v in values])


def rolled_date(day: Column, minutes: Column) -> Column:
    """The calendar date of a service minute."""
    return F.date_add(day, F.floor(minutes / DAY_MINUTES).cast("int"))
