"""The driver's test tables as stop events, observations, stop times and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.session import tasks_for

STATION = 8_500_000
# Line names that cover every kind of match.
TRIP_LINES = ("RE12", "RE", "RE5", "S3", "9", "IC21", "S")
ROUTES = (("RE", "RE 12"), ("RE", "Regio"), ("RE", "RE5"), ("S", "S 3"), ("9", "Bus 9"), ("IC", "IC 21"), ("S", ""))
#: MB of lineitem's packed columns for a task; about 400,000 rows.
LINE_ITEMS_MB = 2
#: Board requests: (anchor, query, day type, minute, limit).
BOARD_REQUESTS = [(0, "8500004:0:0", 2, 15, 5), (1, "8500007", 6, 480, 3), (2, "russia", 0, 1200, 4), (3, "nowhere", 0, 15, 4), (4, "Supplier#000000003", 5, 1439, 12)]
EVENT_LINES = {"view": "RE12", "click": "RE", "signup": "S3", "error": "9", "purchase": "IC"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stop_event_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events rendered as the nine text columns of a stop-event file, with some rows of every kind that is dropped."""
    e = table(spark, sf_dir, "events").select("*", F.inline(F.array(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), _offset().alias("off")))))
    planned = F.concat(F.date_format("ts", "dd.MM.yyyy HH:"), F.lit("30:00"))
    number = F.concat((F.lit(STATION) + F.pmod("user_id", F.lit(5))).cast("string"), F.when(F.col("event_id") % 2 == 0, "12").otherwise(""))
    return e.select(
        F.date_format(F.date_sub(F.col("ts").cast("date"), F.col("off")), "dd.MM.yyyy").alias("BETRIEBSTAG"),
        F.when(F.col("k") == 7, "  ").otherwise(F.concat(F.lit(" "), F.col("event_type"), F.lit("  "))).alias("LINIEN_TEXT"),
        F.when(F.col("k") == 1, "TRUE").otherwise("false").alias("ZUSATZFAHRT_TF"), F.when(F.col("k") == 2, "true").otherwise("").alias("FAELLT_AUS_TF"), F.when(F.col("k") == 3, "True").otherwise("yes").alias("DURCHFAHRT_TF"),
        F.when(F.col("k") == 8, "85x0001").when(F.col("k") == 9, "0").otherwise(number).alias("BPUIC"),
        F.when(F.col("k") == 10, F.substring(planned, 1, 10)).otherwise(planned).alias("ABFAHRTSZEIT"),
        F.when(F.col("k") == 11, "31.02.2024 10:00:00").when(F.col("k") == 12, F.date_format(F.expr("ts + interval 3 days"), "dd.MM.yyyy HH:mm:ss")).otherwise(F.date_format("ts", "dd.MM.yyyy HH:mm:ss")).alias("AB_PROGNOSE"),
        F.when(F.col("k") == 4, "").when(F.col("k") == 5, "Unbekannt").when(F.col("k") == 6, "PROGNOSE").otherwise("REAL").alias("AB_PROGNOSE_STATUS"),
    )


def _offset():
    return F.when((F.hour("ts") < 4) & (F.col("event_id") % 3 == 0), 1).otherwise(0)


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(service_day, bpuic, line, dep_min, day_offset, delay_s) from events: every hour's events are one planned minute."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.date_sub(F.col("ts").cast("date"), _offset()).alias("service_day"), (F.lit(STATION) + F.pmod("user_id", F.lit(5))).cast("int").alias("bpuic"), F.col("event_type").alias("line"),
        (F.hour("ts") * 60 + 30).cast("int").alias("dep_min"), _offset().cast("int").alias("day_offset"), (F.minute("ts") * 60 + F.second("ts") - 1800).cast("int").alias("delay_s"),
    )


def matched_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations at a hundred stations under line names that partly differ from those of the stop times."""
    e = table(spark, sf_dir, "events")
    names = F.create_map(*[x for k, v in EVENT_LINES.items() for x in (F.lit(k), F.lit(v))])
    return e.select(
        F.date_sub(F.col("ts").cast("date"), _offset()).alias("service_day"), (F.lit(STATION) + F.pmod("user_id", F.lit(100))).cast("int").alias("bpuic"), F.element_at(names, F.col("event_type")).alias("line"),
        (F.hour("ts") * 60 + 30).cast("int").alias("dep_min"), _offset().cast("int").alias("day_offset"), (F.minute("ts") * 60 + F.second("ts") - 1800).cast("int").alias("delay_s"),
    )


def stop_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day_type, trip, seq, n_stops, stop, line, dep): an order is a trip, its line items are the stops."""
    from pyspark.sql import Window

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.weekday(F.col("o_orderdate").cast("date")).cast("int").alias("day_type"))
    trip = Window.partitionBy("l_orderkey")
    order = trip.orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    li = li.repartition(tasks_for(li, LINE_ITEMS_MB), "l_orderkey").select("l_orderkey", "l_suppkey", F.row_number().over(order).alias("seq"), F.count("*").over(trip).cast("int").alias("n_stops"))
    line = F.element_at(F.array(*[F.lit(x) for x in TRIP_LINES]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    dep = (30 + 60 * ((F.col("o_orderkey") * 5) % 24) + 60 * (F.col("seq") - 1)).cast("int")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("day_type", F.col("l_orderkey").alias("trip"), "seq", "n_stops", (F.lit(STATION) + F.col("l_suppkey")).cast("int").alias("stop"), line.alias("line"), dep.alias("dep"))


def write_feed(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """A feed of the stop times: a service for each weekday; on Wednesday 2026-08-19 Monday's service runs instead.

    Every eleventh stop has no departure time. Routes are named by category and number in their long names. A table is a
    folder of files that each have the header, written by as many tasks as its rows need.
    """
    times = stop_times(spark, sf_dir)
    service = F.concat(F.lit("d"), F.col("day_type"))
    route = F.concat(F.lit("r"), F.col("trip") % 7)
    clock = F.when((F.col("trip") + F.col("seq")) % 11 != 0, F.format_string("%02d:%02d:00", F.floor(F.col("dep") / 60).cast("int"), F.col("dep") % 60)).otherwise("")
    rows = lambda schema, *values: spark.createDataFrame(list(values), schema)
    tables = {
        "stop_times": times.select(F.col("trip").alias("trip_id"), clock.alias("departure_time"), F.col("stop").alias("stop_id"), (F.col("seq") * 10).alias("stop_sequence")),
        "trips": times.select(route.alias("route_id"), service.alias("service_id"), F.col("trip").alias("trip_id")).distinct(),
        "routes": rows("route_id string, route_short_name string, route_long_name string, route_type int", *[(f"r{k}", a, b, k % 4) for k, (a, b) in enumerate(ROUTES)]),
        "stops": stops(spark, sf_dir).select(F.col("source_stop_id").alias("stop_id"), F.col("name").alias("stop_name")),
        "calendar": rows("service_id string, monday int, tuesday int, wednesday int, thursday int, friday int, saturday int, sunday int, start_date string, end_date string", *[(f"d{k}", *[int(k == d) for d in range(7)], "20260101", "20261231") for k in range(7)]),
        "calendar_dates": rows("service_id string, date string, exception_type int", ("d2", "20260819", 2), ("d0", "20260819", 1)),
        "feed_info": rows("feed_start_date string, feed_end_date string", ("20260101", "20261231")),
    }
    for name, df in tables.items():
        df.write.csv(f"{folder}/{name}.txt", header=True, emptyValue="")


def anchors(spark: SparkSession, sf_dir: str, times: tuple[int, ...], limit: int = 12) -> DataFrame:
    """An anchor for every stop, day type and time; those of one stop and day are numbered one after another."""
    each = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("query_day"))
    each = each.select("s_suppkey", "query_day", F.posexplode(F.array(*[F.lit(t) for t in times])).alias("turn", "at"))
    number = ((F.col("s_suppkey") * 7 + F.col("query_day")) * len(times) + F.col("turn")).cast("int")
    return each.select(number.alias("anchor"), (F.lit(STATION) + F.col("s_suppkey")).cast("int").alias("stop"), "query_day", "at", F.lit(limit).alias("limit"))


def stops(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stop, source_stop_id, name, platform, parent, lat, lon): a supplier is a stop, four of them a station."""
    s = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    number = F.lit(STATION) + k
    return s.select(
        number.alias("stop"), F.concat(number.cast("string"), F.lit(":0:"), (k % 4).cast("string")).alias("source_stop_id"), F.concat_ws(" ", "n_name", "s_name").alias("name"),
        F.when(k % 4 != 0, (k % 4).cast("string")).alias("platform"), F.when(k % 4 != 0, number - k % 4).alias("parent"),
        (46 + (k * 37 % 100) / 100).cast("double").alias("lat"), (7 + (k * 53 % 200) / 100).cast("double").alias("lon"),
    )


def order_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Few services with many samples each: days from order to shipping, read as seconds."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_linestatus", "l_shipdate")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(
        (F.lit(STATION) + F.col("l_suppkey") % 10).cast("int").alias("bpuic"), F.concat("l_returnflag", "l_linestatus").alias("line"),
        F.datediff(F.col("l_shipdate").cast("date"), F.col("o_orderdate").cast("date")).alias("delay_s"),
    )


def lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, station, ts): every event is a look-up of a station."""
    return table(spark, sf_dir, "events").select("user_id", (F.lit(STATION) + F.get_json_object("props", "$.k").cast("int") % 20).cast("int").alias("station"), "ts")


def dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct days of orders."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("day")).distinct()

