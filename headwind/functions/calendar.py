"""The service calendar as column expressions: day types, nationwide holidays, pools of days, candidate dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Day types by weekday number, Monday first; the pools that they belong to.
DAY_TYPES = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
WEEKDAYS, WEEKEND, ALL_DAYS = "weekdays", "weekend", "all"
SUNDAY = 6

# Nationwide holidays by calendar day and by distance from Easter Sunday.
FIXED_HOLIDAYS = {(1, 1): "Neujahr", (1, 2): "Berchtoldstag", (8, 1): "Bundesfeier", (12, 25): "Weihnachten", (12, 26): "Stephanstag"}
EASTER_HOLIDAYS = {-2: "Karfreitag", 1: "Ostermontag", 39: "Auffahrt", 50: "Pfingstmontag"}


def easter_sunday(year: Column) -> Column:
    """Easter Sunday of a Gregorian year: the Sunday after the paschal full moon of the church's tables.

    The moon falls `age` days after 21 March, by the year's place in the cycle of 19 years and the centuries' corrections.
    """
    y = year.cast("int")
    century, place = F.floor(y / 100), y % 19
    age = F.pmod(19 * place + 15 + century - F.floor(century / 4) - F.floor((8 * century + 13) / 25), F.lit(30))
    latest = (age == 29) | ((age == 28) & (place > 10))
    moon = F.date_add(F.make_date(y, F.lit(3), F.lit(21)), (age - F.when(latest, 1).otherwise(0)).cast("int"))
    return F.next_day(moon, "SU")


def holiday_name(day: Column) -> Column:
    """The holiday's name, or null. Where two fall together, the one by calendar day has precedence."""
    key = F.month(day) * 100 + F.dayofmonth(day)
    fixed = F.create_map(*[x for (m, d), n in FIXED_HOLIDAYS.items() for x in (F.lit(100 * m + d), F.lit(n))])
    moving = F.create_map(*[x for k, n in EASTER_HOLIDAYS.items() for x in (F.lit(k), F.lit(n))])
    return F.coalesce(F.try_element_at(fixed, key), F.try_element_at(moving, F.datediff(day, easter_sunday(F.year(day)))))


def is_holiday(day: Column) -> Column:
    return holiday_name(day).isNotNull()


def day_type(day: Column) -> Column:
    """0 for Monday to 6 for Sunday; a holiday counts as a Sunday."""
    return F.when(is_holiday(day), SUNDAY).otherwise(F.weekday(day)).cast("int")


def day_type_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DAY_TYPES]), number + 1)


def pool_of(number: Column) -> Column:
    return F.when(number < 5, WEEKDAYS).otherwise(WEEKEND)


def delay_sets(number: Column) -> Column:
    """The sets that a day type's observations count in: its own, its pool, and all days."""
    return F.array(day_type_name(number), pool_of(number), F.lit(ALL_DAYS))


def month_window(before: DataFrame, count: int, day: str = "day") -> DataFrame:
    """The `count` whole months before each row's day, oldest first, as (day, month)."""
    first = F.add_months(F.trunc(day, "month"), -count)
    return before.select(day, F.explode(F.sequence(first, F.add_months(F.trunc(day, "month"), -1), F.expr("interval 1 month"))).alias("month"))


def timetable_dates(today: DataFrame, day: str = "today", window: tuple[str, str] | None = None) -> DataFrame:
    """For each day given and each day type the date to take its timetable from: (today, day_type, date).

    The same weekday of three weeks before to three weeks after, nearest first and the later one on a tie, inside the
    window; a holiday only if there is nothing else. A day type without any date in the window has no row.
    """
    types = today.select(F.col(day).alias("today"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_type"))
    ahead = F.pmod(F.col("day_type") - F.weekday("today"), F.lit(7))
    offsets = types.select("*", F.explode(F.transform(F.sequence(F.lit(-3), F.lit(3)), lambda w: ahead + 7 * w)).alias("offset"))
    dates = offsets.withColumn("date", F.date_add("today", F.col("offset").cast("int")))
    if window:
        dates = dates.where(F.col("date").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    best = Window.partitionBy("today", "day_type").orderBy(is_holiday(F.col("date")), F.abs("offset"), F.desc("offset"))
    return dates.withColumn("rank", F.row_number().over(best)).where("rank = 1").select("today", "day_type", "date")


def next_date_of(today: Column, wanted: Column) -> Column:
    """The first date from today on, within a week, of the wanted day type; today if there is none."""
    days = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda i: F.date_add(today, i))
    return F.coalesce(F.try_element_at(F.filter(days, lambda d: day_type(d) == wanted), F.lit(1)), today)


def link_date(today: Column, shared: Column, most_ahead: int = 14) -> Column:
    """A shared date if it can be chosen today, else the next date of its day type."""
    return F.when(shared.between(today, F.date_add(today, most_ahead)), shared).otherwise(next_date_of(today, day_type(shared)))


def selectable(today: Column, date: Column, most_ahead: int = 14) -> Column:
    return date.between(today, F.date_add(today, most_ahead))


def calendar(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, day_type, holiday) of whole years."""
    span = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(31)))).alias("day"))
    return span.select("day", day_type(F.col("day")).alias("day_type"), holiday_name(F.col("day")).alias("holiday"))
