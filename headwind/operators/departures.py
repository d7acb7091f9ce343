"""Departure boards over stop times: segments of two service days, pages with whole minutes, and delay statistics.

Boards are answered for a table of anchors at once: (anchor, stop, query_day, at, limit). `at` and clocks are minutes of
the query day; the previous service day's departures past midnight appear on it 1440 minutes earlier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.functions import calendar, names

DAY = 1440
#: Anchors before this minute also see the night services of the day before.
TAIL_CUTOFF = 360
SCOPES = ("day", "group", "all")


def boardable(stop_times: DataFrame) -> DataFrame:
    """stop_times without each trip's last stop, and with the trip's destination.

    stop_times: day_type, trip, seq, n_stops, stop, line, dep. Of rows alike in day_type, trip and seq one stays.
    """
    # One exchange: repeated rows and the destination are both seen within a trip in order.
    trip = Window.partitionBy("day_type", "trip").orderBy("seq", "stop")
    whole = trip.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    seen = stop_times.withColumns({"before": F.lag("seq").over(trip), "destination": F.last("stop").over(whole)})
    once = F.col("before").isNull() | (F.col("before") != F.col("seq"))
    return seen.where(once & (F.col("seq") < F.col("n_stops"))).drop("before")


def segments(board: DataFrame) -> DataFrame:
    """Each departure on the query days that show it: on its own day, and if past midnight on the next one too.

    Adds query_day, offset and clock.
    """
    own = F.struct(F.col("day_type").alias("query_day"), F.lit(0).alias("offset"))
    after = F.struct(F.pmod(F.col("day_type") + 1, F.lit(7)).cast("int").alias("query_day"), F.lit(DAY).alias("offset"))
    shown = F.array_compact(F.array(own, F.when(F.col("dep") >= DAY, after)))
    return board.withColumn("seg", F.explode(shown)).select("*", "seg.query_day", "seg.offset", (F.col("dep") - F.col("seg.offset")).alias("clock")).drop("seg")


def candidates(board: DataFrame, anchors: DataFrame, tail: Column | None = None) -> DataFrame:
    """All departures that an anchor's board may show, with the anchor's columns.

    tail: whether an anchor sees the previous day's night services; by default those before TAIL_CUTOFF do.
    """
    tail = F.col("at") < TAIL_CUTOFF if tail is None else tail
    return segments(board).join(anchors, ["stop", "query_day"]).where((F.col("offset") == 0) | tail)


def _first(rows: DataFrame, order: Column) -> DataFrame:
    """The first `limit` rows of each anchor, and all that tie with the last of them."""
    ranked = rows.withColumn("rank", F.rank().over(Window.partitionBy("anchor").orderBy(order)))
    return ranked.where(F.col("rank") <= F.col("limit")).drop("rank")


def page_later(found: DataFrame) -> DataFrame:
    return _first(found.where(F.col("clock") >= F.col("at")), F.asc("clock"))


def page_earlier(found: DataFrame) -> DataFrame:
    return _first(found.where(F.col("clock") < F.col("at")), F.desc("clock"))


def page_around(found: DataFrame) -> DataFrame:
    """A page before the anchor, the anchor's minute, and a page from the next minute on; no row is in two of them."""
    away = F.col("clock") - F.col("at")
    sided = found.withColumn("side", F.signum(away).cast("int"))
    ranked = sided.withColumn("rank", F.rank().over(Window.partitionBy("anchor", "side").orderBy(F.abs(away))))
    return ranked.where((F.col("side") == 0) | (F.col("rank") <= F.col("limit"))).drop("side", "rank")


def next_departures(found: DataFrame) -> DataFrame:
    """Every service of the earliest minute from the anchor on."""
    return page_later(found.withColumn("limit", F.lit(1)))


def earlier_with_tail(board: DataFrame, anchors: DataFrame) -> DataFrame:
    """Earlier pages; one that reaches below TAIL_CUTOFF, or is empty, is made with the previous day's services instead.

    Both pages come from one ranking of one join: an anchor's rows with the night services and those without.
    """
    found = candidates(board, anchors, F.lit(True)).where(F.col("clock") < F.col("at"))
    late = F.desc("clock")
    ranked = found.withColumn("plain", (F.col("offset") == 0) | (F.col("at") < TAIL_CUTOFF))
    ranked = ranked.withColumns({"rank": F.rank().over(Window.partitionBy("anchor").orderBy(late)), "plain_rank": F.rank().over(Window.partitionBy("anchor", "plain").orderBy(late))})
    first = F.col("plain") & (F.col("plain_rank") <= F.col("limit"))
    least = F.min(F.when(first, F.col("clock"))).over(Window.partitionBy("anchor"))
    again = (F.col("at") >= TAIL_CUTOFF) & (F.coalesce("least", F.lit(0)) < TAIL_CUTOFF)
    kept = ranked.withColumn("least", least).where(F.when(again, F.col("rank") <= F.col("limit")).otherwise(first))
    return kept.drop("plain", "rank", "plain_rank", "least")


def page_extremes(page: DataFrame) -> DataFrame:
    """(anchor, earliest, latest, n) of each page with rows."""
    return page.groupBy("anchor").agg(F.min("clock").alias("earliest"), F.max("clock").alias("latest"), F.count("*").alias("n"))


def shared_minutes(page: DataFrame) -> DataFrame:
    """page with `shared`: whether another row of the page leaves in the same minute."""
    return page.withColumn("shared", F.count("*").over(Window.partitionBy("anchor", "clock")) > 1)


def fresh_rows(page: DataFrame, shown: DataFrame) -> DataFrame:
    """Rows that are not among those shown, by anchor, minute, line and destination."""
    return page.join(shown, ["anchor", "clock", "line", "destination"], "left_anti")


def delay_sets_by_scope(day_type: Column) -> dict[str, Column]:
    """The delay set of each scope for a departure's own service day."""
    return {"day": calendar.day_type_name(day_type), "group": calendar.pool_of(day_type), "all": F.lit(calendar.ALL_DAYS)}


def scopes_offered(sets: DataFrame, bundles: DataFrame | None = None) -> DataFrame:
    """(day_type, scope, offered) for the delay sets (delay_set) that a bundle has; of several bundles by their columns."""
    by = bundles.columns if bundles is not None else []
    days = (bundles if bundles is not None else sets.sparkSession.range(1).select()).withColumn("day_type", F.explode(F.sequence(F.lit(0), F.lit(6))))
    wanted = days.select(*by, "day_type", F.explode(F.create_map(*[x for k, v in delay_sets_by_scope(F.col("day_type")).items() for x in (F.lit(k), v)])).alias("scope", "delay_set"))
    has = sets.select(*by, "delay_set").distinct().withColumn("has", F.lit(True))
    return wanted.join(has, [*by, "delay_set"], "left").select(*by, "day_type", "scope", F.coalesce("has", F.lit(False)).alias("offered"))


def packed_statistics(stats: DataFrame) -> DataFrame:
    """(bpuic, minute, known): all statistics of a station's minute together, so that one join serves every lookup.

    stats: delay_set, bpuic, line, dep_min, catch_buffer_s, avg_delay_s, samples; unique by the first four.
    """
    row = F.struct("delay_set", "line", names.numbered_prefix(F.col("line")).alias("prefix"), "catch_buffer_s", "avg_delay_s", "samples")
    return stats.groupBy("bpuic", F.col("dep_min").alias("minute")).agg(F.collect_list(row).alias("known"))


def with_statistics(page: DataFrame, stats: DataFrame, scopes: tuple[str, ...] = SCOPES, station: str = "stop") -> DataFrame:
    """page with a struct for each scope: kind, matched, catch_buffer_s, avg_delay_s, samples.

    A departure takes the statistics of its own line name. Failing that, a category with a number takes those of the plain
    category if no other departure of the minute has that category; a plain category takes those of the only numbered line
    of the category that no departure of the minute goes by. kind: exact, category, number or none. Departures of a
    minute are those of one anchor and segment.
    """
    name = names.trimmed(F.col("line"))
    minute = F.pmod("dep", F.lit(DAY)).cast("int")
    named = page.withColumns({"name": name, "minute": minute, "category": names.category(name)})
    named = named.withColumn("taken", F.collect_set("name").over(Window.partitionBy("anchor", "offset", "minute")))
    packed = packed_statistics(stats).withColumnsRenamed({"bpuic": "of_station", "minute": "of_minute"})
    out = named.join(packed, (F.col(station) == F.col("of_station")) & (F.col("minute") == F.col("of_minute")), "left")
    alone = ~F.exists("taken", lambda x: (x != F.col("name")) & names.category(x).eqNullSafe(F.col("category")))
    for scope, wanted in delay_sets_by_scope(F.col("day_type")).items():
        if scope not in scopes:
            continue
        out = out.withColumn("wanted", wanted).withColumn("mine", F.filter("known", lambda r: r["delay_set"] == F.col("wanted")))
        out = out.withColumns({
            "exact": F.try_element_at(F.filter("mine", lambda r: r["line"] == F.col("name")), F.lit(1)),
            "plain": F.try_element_at(F.filter("mine", lambda r: r["line"] == F.col("category")), F.lit(1)),
            "numbered": F.filter("mine", lambda r: (r["prefix"] == F.col("category")) & ~F.array_contains("taken", r["line"])),
        })
        kind = (
            F.when(F.col("exact").isNotNull(), "exact")
            .when(F.col("category").isNull(), "none")
            .when((F.col("category") != F.col("name")) & alone & F.col("plain").isNotNull(), "category")
            .when((F.col("category") == F.col("name")) & (F.size("numbered") == 1), "number")
            .otherwise("none")
        )
        out = out.withColumn("kind", kind)
        got = F.when(F.col("kind") == "exact", F.col("exact")).when(F.col("kind") == "category", F.col("plain")).when(F.col("kind") == "number", F.try_element_at("numbered", F.lit(1)))
        out = out.withColumn("got", got)
        out = out.withColumn(f"stats_{scope}", F.struct("kind", F.col("got.line").alias("matched"), F.col("got.catch_buffer_s").alias("catch_buffer_s"), F.col("got.avg_delay_s").alias("avg_delay_s"), F.col("got.samples").alias("samples")))
    return out.drop("name", "category", "taken", "of_station", "of_minute", "known", "wanted", "mine", "exact", "plain", "numbered", "kind", "got")


def board_stops(stops: DataFrame) -> DataFrame:
    """(stop, board_stop): the stops whose departures a stop's board shows - itself and those of the same station."""
    keyed = stops.select("stop", F.coalesce("parent", "stop").alias("station"))
    return keyed.join(keyed.select(F.col("stop").alias("board_stop"), "station"), "station").select("stop", "board_stop")


def delay_station(stops: DataFrame) -> DataFrame:
    """(stop, station_number): of the parent if it has one, else the stop's own, from the source ids."""
    parents = stops.select(F.col("stop").alias("parent"), names.station_of_stop(F.col("source_stop_id")).alias("parent_number"))
    return stops.join(parents, "parent", "left").select("stop", F.coalesce("parent_number", names.station_of_stop(F.col("source_stop_id"))).alias("station_number"))


def ordered_board(page: DataFrame, destination: str = "destination") -> DataFrame:
    """page by minute, then line and destination in language order."""
    return page.orderBy("anchor", "clock", F.collate("line", "UNICODE"), F.collate(F.col(destination).cast("string"), "UNICODE"))


def resolve_day_types(asked: DataFrame, served: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """asked (day_type, by...) with `answers`, the day type whose timetable answers, and `own`, whether it is the one asked for.

    served: the day types (day_type, by...) that have data. One that has none is answered by the first that has, Monday
    first; answers is null if there is no data at all. Statistics never fall back: they are those of the day type that
    answers only where `own` holds.
    """
    # One row for each of `by`, so that what is joined to is as small as the list of bundles.
    lists = served.groupBy(*by).agg(F.array_sort(F.collect_set(F.col("day_type").cast("int"))).alias("has")).withColumnsRenamed({c: f"of_{c}" for c in by})
    if by:
        known = asked.join(lists, [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in by], "left").drop(*[f"of_{c}" for c in by])
    else:
        known = asked.withColumn("has", F.array(*[F.lit(x) for x in lists.first()["has"]]).cast("array<int>"))  # seven at most
    own = F.coalesce(F.array_contains("has", F.col("day_type")), F.lit(False))
    return known.withColumns({"own": own, "answers": F.when(own, F.col("day_type")).otherwise(F.try_element_at("has", F.lit(1)))}).drop("has")


def roll_over(page: DataFrame, anchors: DataFrame, later: bool = True, window: tuple[str, str] | None = None) -> DataFrame:
    """The anchors to ask instead where a page is empty: the neighbouring day, a day's minutes on or back, not below 0.

    With a column `date` the day type is the calendar's for the neighbouring date, and dates outside the window (first,
    last) are not asked; without one it is the next or last weekday.
    """
    step = 1 if later else -1
    empty = anchors.join(page.select("anchor").distinct(), "anchor", "left_anti")
    at = F.greatest(F.lit(0), F.col("at") - step * DAY).cast("int")
    if "date" not in anchors.columns:
        return empty.withColumns({"query_day": F.pmod(F.col("query_day") + step, F.lit(7)).cast("int"), "at": at})
    moved = empty.withColumns({"date": F.date_add("date", step), "at": at})
    if window:
        moved = moved.where(F.col("date").between(F.lit(window[0]).cast("date"), F.lit(window[1]).cast("date")))
    return moved.withColumn("query_day", calendar.day_type(F.col("date")))


def page_over_dates(board: DataFrame, anchors: DataFrame, later: bool = True, steps: int = 1, window: tuple[str, str] | None = None) -> DataFrame:
    """Pages of the anchors; an empty one is asked for on the neighbouring day instead, up to `steps` days on.

    Adds `rolled`, how many days a page's rows are from the day that was asked for. Anchors without rows to the end have none.
    """
    made, now = None, anchors
    for turn in range(steps + 1):
        page = (page_later if later else page_earlier)(candidates(board, now)).withColumn("rolled", F.lit(turn))
        made = page if made is None else made.unionByName(page)
        now = roll_over(page, now, later, window) if turn < steps else now
    return made


def departure_board(board: DataFrame, stops: DataFrame, stats: DataFrame, asks: DataFrame, origins: DataFrame, page=page_later, scopes: tuple[str, ...] = SCOPES) -> DataFrame:
    """The whole answer to board requests: station, day type, stops of the station, page and statistics.

    asks: (anchor, query, day_type, at, limit); origins: (query, stop) as stations.resolve() gives them; board: boardable
    stop times; stats: service statistics, looked up under the station's number. A request whose station or day type
    cannot be resolved has no rows. Adds to each departure the anchor's columns, origin, query_day, station_number, own
    (whether the day type asked for has a timetable) and a struct for each scope.
    """
    resolved = resolve_day_types(asks, board.select("day_type").distinct()).where("answers is not null")
    known = resolved.join(origins.select("query", F.col("stop").alias("origin")), "query")
    around = board_stops(stops).withColumnsRenamed({"stop": "origin", "board_stop": "stop"})
    numbered = delay_station(stops).withColumnRenamed("stop", "origin")
    anchors = known.join(around, "origin").join(numbered, "origin").select("anchor", "stop", F.col("answers").alias("query_day"), "at", "limit", "origin", "own", "station_number")
    return with_statistics(page(candidates(board, anchors)), stats, scopes, "station_number")


def scope_for(wanted: str | None, offered: list[str]) -> str:
    """The scope that a board shows: the one picked if it is offered, else the finest that is."""
    return wanted if wanted in offered else next((s for s in SCOPES if s in offered), SCOPES[0])
