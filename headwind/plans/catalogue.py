"""The registered queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.functions import calendar, clock, names
from headwind.operators import departures as board
from headwind.operators import observations, services, stations, timetables
from headwind.plans import fixtures as fx
from headwind.session import new_path
from headwind.sources import files, readers, storage

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _days(spark: SparkSession, first: str, last: str, name: str = "day") -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias(name))


def _texts(df: DataFrame) -> DataFrame:
    """Dates as text, so that every engine shows them alike."""
    return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


# Parsing


@query
def obs_parse_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(observations.extract_observations(fx.stop_event_text(spark, sf_dir)))


@query
def obs_drop_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.drop_reasons(fx.stop_event_text(spark, sf_dir))


@query
def station_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = fx.stop_event_text(spark, sf_dir).select("BPUIC")
    stop_id = F.concat(F.col("BPUIC"), F.lit(":0:3"))
    return raw.groupBy(F.col("BPUIC").alias("raw"), names.station_number(F.col("BPUIC")).alias("bpuic"), names.station_of_stop(stop_id).alias("stop_number")).agg(F.count("*").alias("n"))


@query
def stop_event_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stop events written as semicolon-separated files, half of them in another order of columns, and read back."""
    raw = fx.stop_event_text(spark, sf_dir)
    folder = new_path(spark, "stop-event-files")
    for half, order in enumerate((raw.columns, raw.columns[::-1])):
        mine = raw.where(F.pmod(F.xxhash64(*raw.columns), F.lit(2)) == half).select(*order)
        mine.write.csv(f"{folder}/{half}", sep=";", header=True, quoteAll=half == 1, emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    paths = [f"{folder}/{half}/{n}" for half in (0, 1) for n in files.children(f"{folder}/{half}") if n.endswith(".csv")]
    return _texts(observations.extract_observations(readers.read_stop_events(spark, paths)))


# Service statistics


@query
def service_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_groups(fx.observations(spark, sf_dir))


@query
def service_stats_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_statistics(fx.observations(spark, sf_dir), pools=False)


@query
def service_stats_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_statistics(fx.observations(spark, sf_dir))


@query
def service_stats_min_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_statistics(fx.observations(spark, sf_dir), min_samples=3)


@query
def service_stats_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.table(spark, sf_dir, "supplier").where("s_acctbal > 4000").select((F.lit(fx.STATION) + F.col("s_suppkey")).cast("int").alias("bpuic"))
    return services.service_statistics(fx.observations(spark, sf_dir), stations=known)


@query
def service_histogram_p10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lower decile of each station and line over all days, from counts of delays alone."""
    by = ["bpuic", "line"]
    return services.statistics(services.delay_counts(fx.observations(spark, sf_dir), by), by)


@query
def order_delay_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = ["bpuic", "line"]
    return services.statistics(services.delay_counts(fx.order_observations(spark, sf_dir), by), by)


@query
def ignored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = fx.observations(spark, sf_dir).where("service_day < DATE '2024-01-15' and line <> 'error'")
    return services.ignored_lines(fx.observations(spark, sf_dir), services.line_table(known))


@query
def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.observations(spark, sf_dir).withColumn("delay_s", (F.col("delay_s") * 40).cast("int"))
    return services.shard_rows(services.service_statistics(wide))


@query
def stored_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations stored by service day, read back, aggregated, published by delay set and bucket, and read by manifest."""
    root = new_path(spark, "stored")
    storage.write_observations(fx.observations(spark, sf_dir), f"{root}/observations")
    obs = storage.read_observations(spark, f"{root}/observations", storage.stored_days(f"{root}/observations"))
    storage.publish_statistics(services.service_statistics(obs), root)
    return storage.read_statistics(spark, root)


@query
def coverage_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.coverage_days(fx.observations(spark, sf_dir))


@query
def distinct_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.service_statistics(fx.observations(spark, sf_dir)).agg(F.count_distinct("bpuic").alias("stations"))


@query
def line_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return services.line_table(fx.observations(spark, sf_dir))


@query
def run_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.observations(spark, sf_dir).withColumn("delay_s", (F.col("delay_s") * 40).cast("int"))
    rows = services.shard_rows(services.service_statistics(wide))
    return rows.groupBy("delay_set").agg(F.count("*").alias("services"), F.sum(F.col("samples").cast("bigint")).alias("samples"), F.count_if("clamped").alias("clamped"), F.count_distinct("bpuic").alias("stations"), F.count_distinct("bucket").alias("buckets"))


@query
def first_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of the first three service days alone."""
    obs = fx.observations(spark, sf_dir)
    days = obs.select("service_day").distinct().orderBy("service_day").limit(3)
    return services.service_statistics(obs.join(F.broadcast(days), "service_day", "left_semi"), pools=False)


# Calendar


@query
def calendar_day_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.dates(spark, sf_dir)
    number = calendar.day_type(F.col("day"))
    return _texts(d.select("day", number.alias("day_type"), calendar.day_type_name(number).alias("name"), calendar.pool_of(number).alias("pool"), calendar.holiday_name(F.col("day")).alias("holiday")))


@query
def holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(calendar.calendar(spark, 2020, 2035).where("holiday is not null").select("day", "holiday"))


@query
def easter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(spark.range(1900, 2200).select(F.col("id").cast("int").alias("year"), calendar.easter_sunday(F.col("id")).alias("easter")))


@query
def epoch_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(fx.dates(spark, sf_dir).select("day", F.unix_date("day").alias("number")))


@query
def timetable_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(calendar.timetable_dates(_days(spark, "2026-01-01", "2026-12-31", "today"), window=("2025-12-14", "2026-12-12")))


@query
def month_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _texts(calendar.month_window(_days(spark, "2026-01-01", "2026-12-31"), 12))


@query
def next_date_of_day_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, "2026-03-01", "2026-06-30", "today").withColumn("wanted", F.explode(F.sequence(F.lit(0), F.lit(6))))
    shared = F.date_add("today", F.col("wanted") * 5 - 8)
    return _texts(days.select("today", "wanted", calendar.next_date_of(F.col("today"), F.col("wanted")).alias("next"), calendar.link_date(F.col("today"), shared).alias("linked")))


@query
def date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, "2026-03-01", "2026-03-31", "today").withColumn("date", F.explode(F.sequence(F.date_sub("today", 3), F.date_add("today", 17))))
    return _texts(days.select("today", "date", calendar.selectable(F.col("today"), F.col("date")).alias("ok")))


# Timetables


@query
def feed_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stop times of a week's dates from a feed's text files, which are written first."""
    folder = new_path(spark, "feed")
    fx.write_feed(spark, sf_dir, folder)
    first, last = readers.feed_window(spark, folder)
    dates = calendar.timetable_dates(spark.sql("SELECT DATE '2026-08-20' AS today"), window=(first, last)).select("day_type", "date")
    tables = readers.read_feed(spark, folder)
    running = timetables.active_services(dates.select("date").distinct(), tables["calendar"], tables["calendar_dates"])
    return timetables.feed_stop_times(dates, tables["stop_times"], tables["trips"], tables["routes"], running)


@query
def line_full_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = F.array(*[F.lit(x) for x in ("RE", "S", "EC", " IR ", "R", "CC")])
    forms = F.array(F.concat_ws(" ", "c", "n"), F.concat("c", "n"), F.concat(F.lit("N"), F.col("n")), F.concat_ws("  ", "c", "n"), F.concat_ws(" ", F.lit("RE"), F.col("n")))
    p = fx.table(spark, sf_dir, "part").select("p_partkey", F.element_at(cats, (F.col("p_partkey") % 6 + 1).cast("int")).alias("short"))
    p = p.withColumns({"c": F.trim("short"), "n": ((F.col("p_partkey") * 7) % 1300).cast("string")}).withColumn("long", F.element_at(forms, (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select("p_partkey", "short", "long", names.full_line_name(F.col("short"), F.col("long")).alias("line"))


@query
def stop_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = timetables.patterns(fx.stop_times(spark, sf_dir))
    return made.select("day_type", "line", F.array_join("stops", ",").alias("stops"), "first_stop", "last_stop", "trips")


@query
def trip_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timetables.past_midnight(fx.stop_times(spark, sf_dir))


@query
def trip_destinations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.boardable(fx.stop_times(spark, sf_dir)).groupBy("line", "stop", "destination").agg(F.count("*").alias("n"), F.min("dep").alias("first"))


@query
def route_type_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = fx.table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 14).cast("int").alias("route_type"))
    mode = names.route_type_name(F.col("route_type"))
    return o.groupBy("route_type").agg(F.count("*").alias("n")).select("route_type", "n", mode.alias("mode"), names.platform_word(mode).alias("platform"))


# Boards


def _found(spark: SparkSession, sf_dir: str, times: tuple[int, ...]) -> DataFrame:
    return board.candidates(board.boardable(fx.stop_times(spark, sf_dir)), fx.anchors(spark, sf_dir, times))


_SHOWN = ("anchor", "query_day", "offset", "day_type", "trip", "seq", "stop", "line", "dep", "clock", "destination")


@query
def departures_later(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.page_later(_found(spark, sf_dir, (15, 500, 1200))).select(*_SHOWN)


@query
def departures_earlier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.page_earlier(_found(spark, sf_dir, (15, 500, 1200))).select(*_SHOWN)


@query
def departures_around(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.page_around(_found(spark, sf_dir, (30, 510, 1230))).select(*_SHOWN)


@query
def next_departure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.next_departures(_found(spark, sf_dir, (15, 500, 1200))).select(*_SHOWN)


@query
def earlier_with_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = board.earlier_with_tail(board.boardable(fx.stop_times(spark, sf_dir)), fx.anchors(spark, sf_dir, (300, 365, 500)))
    return made.select(*_SHOWN)


@query
def departures_rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later pages near midnight; an empty one is asked for on the next day."""
    made = board.page_over_dates(board.boardable(fx.stop_times(spark, sf_dir)), fx.anchors(spark, sf_dir, (1380, 1439, 1500)))
    return made.select(*_SHOWN, "rolled")


@query
def departure_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five board requests from the station's name to statistics, with a timetable that has no Saturday."""
    stops, times = fx.stops(spark, sf_dir), board.boardable(fx.stop_times(spark, sf_dir)).where("day_type <> 5")
    asks = spark.createDataFrame(fx.BOARD_REQUESTS, "anchor int, query string, day_type int, at int, limit int")
    stats = services.service_statistics(fx.matched_observations(spark, sf_dir))
    made = board.departure_board(times, stops, stats, asks, stations.resolve(stops, [r[1] for r in fx.BOARD_REQUESTS]), scopes=("all",))
    return made.select("anchor", "origin", "query_day", "own", "station_number", "stop", "offset", "trip", "seq", "line", "clock", "destination", *[F.col(f"stats_all.{c}").alias(c) for c in ("kind", "matched", "catch_buffer_s", "samples")])


@query
def segment_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _found(spark, sf_dir, (15, 359, 360)).groupBy("anchor", "at", "query_day", "offset").agg(F.count("*").alias("n"), F.min("clock").alias("first"), F.max("clock").alias("last"))


@query
def shared_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.shared_minutes(board.page_later(_found(spark, sf_dir, (15, 500)))).select("anchor", "trip", "seq", "clock", "shared")


@query
def page_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return board.page_extremes(board.page_around(_found(spark, sf_dir, (30, 510))))


@query
def page_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a page from 12:00 adds to the page from 08:30, for the same stop and day."""
    spot = ["stop", "query_day"]
    found = board.candidates(board.boardable(fx.stop_times(spark, sf_dir)), fx.anchors(spark, sf_dir, (510, 720)))
    page = board.page_later(found).withColumn("anchor", F.floor(F.col("anchor") / 2).cast("int"))
    shown, fresh = page.where("at = 510"), page.where("at = 720")
    return board.fresh_rows(fresh, shown.select("anchor", "clock", "line", "destination").distinct()).select("anchor", *spot, "trip", "seq", "clock", "line", "destination")


def _enriched(spark: SparkSession, sf_dir: str, scopes: tuple[str, ...] = board.SCOPES) -> DataFrame:
    stats = services.service_statistics(fx.matched_observations(spark, sf_dir))
    return board.with_statistics(board.page_later(_found(spark, sf_dir, (15,))), stats, scopes)


@query
def departures_with_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir, ("day",))
    return rows.select("anchor", "offset", "trip", "seq", "line", "dep", "clock", F.col("stats_day.matched").alias("matched"), F.col("stats_day.catch_buffer_s").alias("catch_buffer_s"), F.col("stats_day.avg_delay_s").alias("avg_delay_s"), F.col("stats_day.samples").alias("samples"))


@query
def departure_match_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir, ("group",))
    return rows.groupBy(F.col("stats_group.kind").alias("kind"), "offset").agg(F.count("*").alias("n"))


@query
def departures_scopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir)
    return rows.select("anchor", "offset", "trip", "seq", *[F.col(f"stats_{s}.{c}").alias(f"{s}_{c}") for s in board.SCOPES for c in ("kind", "catch_buffer_s", "samples")])


@query
def departure_timing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _enriched(spark, sf_dir, ("all",))
    buffer, mean = F.col("stats_all.catch_buffer_s"), F.col("stats_all.avg_delay_s")
    return rows.select(
        "anchor", "offset", "trip", "seq", clock.minutes_to_clock(F.col("dep")).alias("planned"), clock.actual_clock(F.col("dep"), mean).alias("actual"), clock.delay_text(mean).alias("delay"),
        clock.actual_clock(F.col("dep"), buffer).alias("latest"), F.when(buffer < 0, clock.duration_text(-buffer)).alias("before_plan"),
    )


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(bundle, day_type): eight bundles of the served days; number k lacks those whose number has a bit in common with k."""
    days = fx.observations(spark, sf_dir).select(calendar.day_type(F.col("service_day")).alias("day_type")).distinct()
    return days.select(F.explode(F.sequence(F.lit(0), F.lit(7))).alias("bundle"), "day_type").where(F.col("bundle").bitwiseAND(F.col("day_type")) == 0)


@query
def scopes_offered(spark: SparkSession, sf_dir: str) -> DataFrame:
    sets = _bundles(spark, sf_dir).select("bundle", F.explode(calendar.delay_sets(F.col("day_type"))).alias("delay_set"))
    return board.scopes_offered(sets, spark.range(8).select(F.col("id").cast("int").alias("bundle")))


@query
def day_type_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day type that answers for each one asked for: itself if there is data, else the first that has; and whether
    statistics exist for it, which never fall back."""
    asked = spark.range(8).select(F.col("id").cast("int").alias("bundle"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("day_type"))
    found = board.resolve_day_types(asked, _bundles(spark, sf_dir), by=("bundle",))
    return found.select("bundle", F.col("day_type").alias("asked"), calendar.day_type_name(F.col("answers")).alias("answers"), F.col("own").alias("statistics"))


@query
def board_stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = fx.stops(spark, sf_dir)
    return board.board_stops(s).join(board.delay_station(s), "stop").select("stop", "board_stop", "station_number")


# Stations


@query
def station_search_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.search_by_name(fx.stops(spark, sf_dir), ["united", "Supplier#0", "king", " RUSSIA ", "an", "i"], 8)


@query
def station_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.search_by_place(fx.stops(spark, sf_dir), [(46.5, 8.0), (46.02, 7.51), (46.9, 8.9)], 30.0, 10)


@query
def station_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.resolve(fx.stops(spark, sf_dir), ["8500004:0:0", "8500007", "russia", "Supplier#000000003", "nowhere", "8500004:0:3"])


@query
def recent_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stations.recent_stations(fx.lookups(spark, sf_dir))


@query
def suggestion_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = fx.table(spark, sf_dir, "events").select("user_id", (F.lit(fx.STATION) + F.col("event_id") % 20).cast("int").alias("station")).distinct()
    return stations.without_recent(asked, stations.recent_stations(fx.lookups(spark, sf_dir)))


# Formats


@query
def timeline_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = services.service_statistics(fx.observations(spark, sf_dir))
    mean, buffer = F.col("avg_delay_s"), F.col("catch_buffer_s")
    lo, hi = clock.timeline_low(mean, buffer), clock.timeline_high(mean, buffer)
    return stats.select("delay_set", *services.SERVICE, lo.alias("lo"), hi.alias("hi"), clock.tick_text(lo).alias("lo_text"), clock.tick_text(hi).alias("hi_text"), F.floor((buffer - lo) * 100000 / (hi - lo)).cast("int").alias("buffer_pos"))


@query
def delay_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = fx.observations(spark, sf_dir).select("delay_s").distinct()
    s = F.col("delay_s")
    return d.select("delay_s", clock.delay_text(s).alias("text"), clock.seconds_text(s).alias("seconds"), clock.seconds_text(s, True).alias("signed"), clock.duration_text(F.abs(s)).alias("duration"), clock.tick_text(s).alias("tick"))


@query
def clock_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = spark.range(0, 3000, 7).select(F.col("id").cast("int").alias("minute"))
    text = F.format_string("%02d:%02d:00", F.floor(F.col("minute") / 60).cast("int"), F.col("minute") % 60)
    rolled = clock.rolled_date(F.lit("2026-12-30").cast("date"), F.col("minute"))
    return _texts(m.select("minute", clock.minutes_to_clock(F.col("minute")).alias("clock"), clock.clock_to_minutes(text).alias("back"), clock.seconds_to_clock(F.col("minute") * 61 - 5000).alias("seconds"), rolled.alias("date")))
