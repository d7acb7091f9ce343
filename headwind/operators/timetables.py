"""Timetables of a date from a feed's tables, trips past midnight, and line names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.functions import calendar, names
from headwind.session import tasks_for

DAY = 1440
#: MB of a feed's stop times, as text, for a task; about 500,000 rows for each day type that their trips run on.
STOP_TIMES_MB = 16
_WEEKDAYS = calendar.DAY_TYPES


def active_services(dates: DataFrame, calendar_table: DataFrame | None, exceptions: DataFrame | None) -> DataFrame:
    """(date, service_id) running on each date: the weekly calendar, less removed and plus added dates.

    calendar_table: service_id, monday..sunday (0/1), start_date, end_date; exceptions: service_id, date, exception_type
    (1 added, 2 removed); dates of both as dates.
    """
    spark = dates.sparkSession
    if calendar_table is None:
        weekly = spark.createDataFrame([], "date date, service_id string")
    else:
        # A row for each weekday that a service runs on, so that dates meet them by weekday.
        flags = F.array(*[F.when(F.col(d).cast("int") == 1, F.lit(k)) for k, d in enumerate(_WEEKDAYS)])
        runs = calendar_table.select("service_id", "start_date", "end_date", F.explode(F.array_compact(flags)).alias("weekday"))
        weekly = dates.withColumn("weekday", F.weekday("date")).join(runs, "weekday").where(F.col("date").between(F.col("start_date"), F.col("end_date"))).select("date", "service_id")
    if exceptions is None:
        return weekly.distinct()
    special = exceptions.join(dates, "date", "left_semi")
    removed, added = (special.where(F.col("exception_type").cast("int") == k).select("date", "service_id") for k in (2, 1))
    return weekly.join(removed, ["date", "service_id"], "left_anti").unionByName(added).distinct()


def minutes(text: Column) -> Column:
    """A feed's HH:MM:SS as minutes of the service day; null if it is missing or no time."""
    parts = F.split(F.trim(text), ":")
    h, m = (F.try_element_at(parts, F.lit(k)).try_cast("int") for k in (1, 2))
    return F.when((h >= 0) & m.between(0, 59), h * 60 + m)


def feed_stop_times(dates: DataFrame, stop_times: DataFrame, trips: DataFrame, routes: DataFrame, services: DataFrame) -> DataFrame:
    """(day_type, trip, seq, n_stops, stop, line, dep, route_type) of each date's running trips.

    dates: (day_type, date). Rows without a departure time are left out before stops are numbered. Trips are dealt to
    tasks by the size of stop_times.
    """
    running = dates.join(services, "date").join(trips, "service_id").join(renamed_routes(routes), "route_id", "left")
    # `dep` is made from what was dealt: with an exchange right under it, a join falls back on Spark's own number of tasks.
    dealt = stop_times.repartition(tasks_for(stop_times, STOP_TIMES_MB), "trip_id")
    timed = dealt.withColumn("dep", minutes(F.col("departure_time"))).where("dep is not null")
    rows = running.join(timed, "trip_id")
    trip = Window.partitionBy("day_type", "trip_id")
    order = trip.orderBy(F.col("stop_sequence").cast("int"))
    return rows.select(
        "day_type", F.col("trip_id").alias("trip"), F.row_number().over(order).alias("seq"), F.count("*").over(trip).cast("int").alias("n_stops"),
        F.col("stop_id").alias("stop"), F.col("line"), "dep", F.col("route_type").cast("int").alias("route_type"),
    )


def renamed_routes(routes: DataFrame) -> DataFrame:
    """routes with `line`: category and number where the long name gives them, else the short name; and `renamed`."""
    full = names.full_line_name(F.col("route_short_name"), F.coalesce("route_long_name", F.lit("")))
    return routes.withColumn("line", F.coalesce(full, "route_short_name")).withColumn("renamed", full.isNotNull() & (full != F.col("route_short_name")))


def patterns(stop_times: DataFrame) -> DataFrame:
    """(day_type, pattern, stops, first_stop, last_stop, trips, departures): trips of one line that share their stops."""
    order = F.array_sort(F.collect_list(F.struct("seq", "stop", "dep")))
    trips = stop_times.groupBy("day_type", "trip", "line").agg(order.alias("s"))
    listed = trips.select("day_type", "line", F.transform("s", lambda x: x["stop"]).alias("stops"), F.transform("s", lambda x: x["dep"]).alias("deps"))
    grouped = listed.groupBy("day_type", "line", "stops").agg(F.count("*").alias("trips"), F.array_sort(F.collect_list("deps")).alias("departures"))
    return grouped.select("day_type", "line", "stops", F.element_at("stops", 1).alias("first_stop"), F.element_at("stops", -1).alias("last_stop"), "trips", "departures")


def past_midnight(stop_times: DataFrame) -> DataFrame:
    """Whole trips that depart at or after 1440 from a stop other than their last."""
    trip = Window.partitionBy("day_type", "trip")
    late = F.max(F.when((F.col("seq") < F.col("n_stops")) & (F.col("dep") >= DAY), 1).otherwise(0)).over(trip)
    return stop_times.withColumn("late", late).where("late = 1").drop("late")


def feed_stations(stops: DataFrame) -> DataFrame:
    """(bpuic): the station numbers that a feed's stop ids begin with."""
    return stops.select(names.station_of_stop(F.col("stop_id")).cast("int").alias("bpuic")).where("bpuic is not null").distinct()


def build_totals(routes: DataFrame, stop_times: DataFrame) -> dict[str, int]:
    """Routes read and renamed; trips and patterns past midnight."""
    read = renamed_routes(routes).agg(F.count("*"), F.count_if("renamed")).first()
    late = past_midnight(stop_times)
    trips = late.select("day_type", "trip").distinct().count()
    return {"routes": read[0], "renamed": read[1], "late_trips": trips, "late_patterns": patterns(late).count()}
