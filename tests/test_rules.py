"""Small cases worked out by hand, and properties."""

import random
from datetime import date, datetime, timedelta

import pytest
from dateutil.easter import easter
from pyspark.sql import functions as F

from headwind.functions import calendar, clock, names
from headwind.operators import departures as board
from headwind.operators import services, timetables
from headwind.operators.observations import COLUMNS, drop_reasons, extract_observations


def _values(spark, rows, schema, *columns):
    return [tuple(r) if len(columns) > 1 else r[0] for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def _obs(spark, rows):
    schema = "service_day date, bpuic int, line string, dep_min int, day_offset int, delay_s int"
    return spark.createDataFrame([(date(2026, 3, 5), 8507000, "S3", 428, off, d) for off, ds in rows for d in ds], schema)


@pytest.mark.parametrize("delays, buffer, mean", [([-30, 150], -30, 60), ([10 * k for k in range(1, 11)], 20, 55), ([42], 42, 42), ([1, 2], 1, 2), ([-1, -2], -2, -2), ([-1, 0], -1, -1)])
def test_buffer_and_mean(spark, delays, buffer, mean):
    got = services.service_statistics(_obs(spark, [(0, delays)]), pools=False).collect()[0]
    assert (got["catch_buffer_s"], got["avg_delay_s"], got["samples"]) == (buffer, mean, len(delays))


@pytest.mark.parametrize("rows, least, offset", [([(0, [1] * 3), (1, [1] * 5)], 1, 1), ([(0, [1] * 3), (1, [1] * 3)], 1, 0), ([(-1, [1] * 3), (1, [1] * 3)], 1, -1), ([(0, [1] * 3), (-1, [1] * 5)], 4, -1)])
def test_choice_of_day_offset(spark, rows, least, offset):
    got = services.service_statistics(_obs(spark, rows), min_samples=least, pools=False).collect()
    assert [r["day_offset"] for r in got] == [offset]


def test_least_samples_hold_before_the_choice(spark):
    assert services.service_statistics(_obs(spark, [(0, [1] * 3), (1, [2] * 3)]), min_samples=4).count() == 0


def test_statistics_properties(spark):
    rng = random.Random(3)
    rows = [(date(2026, 3, 2) + timedelta(rng.randrange(30)), 8500000 + rng.randrange(2), rng.choice("ab"), 60 * rng.randrange(2), rng.choice([0, 0, 1]), rng.randrange(-100, 400)) for _ in range(1500)]
    obs = spark.createDataFrame(rows, "service_day date, bpuic int, line string, dep_min int, day_offset int, delay_s int")
    got = {tuple(r[:4]): r for r in services.service_statistics(obs).collect()}
    again = {tuple(r[:4]): r for r in services.service_statistics(obs.repartition(7).orderBy(F.rand(1))).collect()}
    assert got == again
    for (name, bpuic, line, dep), r in got.items():
        days = [x for x in rows if x[1:4] == (bpuic, line, dep) and x[4] == r["day_offset"]]
        kind = lambda d: calendar.DAY_TYPES[6 if d == date(2026, 4, 3) else d.weekday()]
        pool = lambda d: "weekdays" if kind(d) in calendar.DAY_TYPES[:5] else "weekend"
        own = sorted(x[5] for x in days if name in (kind(x[0]), pool(x[0]), "all"))
        assert r["samples"] == len(own) and r["catch_buffer_s"] == own[len(own) // 10] and r["catch_buffer_s"] in own
        assert sum(x >= r["catch_buffer_s"] for x in own) >= 0.9 * len(own)


def test_plan_shuffles_twice_and_scans_once(spark):
    plan = services.service_statistics(_obs(spark, [(0, [1])]))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2


def test_shard_limits(spark):
    obs = _obs(spark, [(0, [40000] * 300)])
    got = services.shard_rows(services.service_statistics(obs, pools=False)).collect()[0]
    assert (got["catch_buffer_s"], got["samples"], got["clamped"], got["bucket"]) == (32767, 255, True, 8507000 % 1024)


def test_stations(spark):
    given = ["850700712", "8507007x9", "0000132", "85x", "", "0", None]
    assert _values(spark, [(x,) for x in given], "t string", names.station_number(F.col("t"))) == [8507007, 8507007, 132, None, None, None, None]
    assert _values(spark, [("8507000:0:3",), ("x:1",), ("77",), (None,)], "t string", names.station_of_stop(F.col("t"))) == [8507000, None, 77, None]


def _event(**changed):
    row = dict(BETRIEBSTAG="05.03.2026", LINIEN_TEXT="S3", ZUSATZFAHRT_TF="false", FAELLT_AUS_TF="", BPUIC="8507000", ABFAHRTSZEIT="05.03.2026 07:08", AB_PROGNOSE="05.03.2026 07:09:30", AB_PROGNOSE_STATUS="REAL", DURCHFAHRT_TF="yes") | changed
    return tuple(row[c] for c in COLUMNS)


@pytest.mark.parametrize(
    "changed, got",
    [
        ({}, (428, 0, 90)),
        ({"BETRIEBSTAG": "04.03.2026", "ABFAHRTSZEIT": "05.03.2026 00:30", "AB_PROGNOSE": "05.03.2026 00:30"}, (30, 1, 0)),
        ({"ABFAHRTSZEIT": "29.03.2026 01:50", "AB_PROGNOSE": "29.03.2026 03:10", "BETRIEBSTAG": "29.03.2026"}, (110, 0, 4800)),
        ({"AB_PROGNOSE": "06.03.2026 07:08:00"}, (428, 0, 86400)),
        ({"AB_PROGNOSE": "06.03.2026 07:08:01"}, "delay"),
        ({"AB_PROGNOSE_STATUS": "PROGNOSE"}, (428, 0, 90)),
        ({"AB_PROGNOSE_STATUS": "Unbekannt"}, "status"),
        ({"AB_PROGNOSE_STATUS": None}, "status"),
        ({"FAELLT_AUS_TF": "TRUE"}, "flag"),
        ({"LINIEN_TEXT": "  "}, "line"),
        ({"BPUIC": "85x"}, "station"),
        ({"AB_PROGNOSE": "05.03.2026"}, "stamp"),
        ({"AB_PROGNOSE": "31.02.2026 10:00"}, "stamp"),
        ({"AB_PROGNOSE": "05.03.2026 07:09:3"}, (428, 0, 60)),
        ({"BETRIEBSTAG": "01.03.2026"}, "service_day"),
        ({"BETRIEBSTAG": "nothing"}, "service_day"),
    ],
)
def test_observations(spark, changed, got):
    raw = spark.createDataFrame([_event(**changed)], ", ".join(f"{c} string" for c in COLUMNS))
    rows = [tuple(r) for r in extract_observations(raw).select("dep_min", "day_offset", "delay_s").collect()]
    if isinstance(got, str):
        assert rows == [] and drop_reasons(raw).collect()[0]["reason"] == got
    else:
        assert rows == [got]


def test_calendar(spark):
    years = spark.range(1900, 2200).select("id", calendar.easter_sunday(F.col("id")).alias("e")).collect()
    assert all(r["e"] == easter(r["id"]) for r in years)
    free = {str(r["day"])[5:]: r["holiday"] for r in calendar.calendar(spark, 2026, 2026).where("holiday is not null").collect()}
    assert sorted(free) == ["01-01", "01-02", "04-03", "04-06", "05-14", "05-25", "08-01", "12-25", "12-26"] and free["05-14"] == "Auffahrt"
    assert calendar.calendar(spark, 2026, 2026).where("holiday is not null and day_type <> 6").count() == 0


def test_timetable_dates(spark):
    asked = spark.createDataFrame([(date(2026, 8, 17),), (date(2026, 12, 24),)], "today date")
    got = {(r["today"].day, r["day_type"]): (r["date"].month, r["date"].day) for r in calendar.timetable_dates(asked).collect()}
    assert [got[17, k] for k in range(7)] == [(8, 17), (8, 18), (8, 19), (8, 20), (8, 14), (8, 15), (8, 16)]
    assert (got[24, 4], got[24, 5]) == ((12, 18), (12, 19))
    months = calendar.month_window(spark.createDataFrame([(date(2026, 8, 17),)], "day date"), 3)
    assert [r["month"].month for r in months.collect()] == [5, 6, 7]


def test_line_names(spark):
    given = [("RE", "RE 12"), ("S", "S3"), ("R", "RE 12"), ("EC", "EC 4"), ("RE", "N1"), ("IR", "IR 1234"), (" RE ", "RE  1")]
    assert _values(spark, given, "a string, b string", names.full_line_name(F.col("a"), F.col("b"))) == ["RE12", "S3", None, None, None, None, None]
    assert _values(spark, [("RE12",), ("RE",), ("9",), ("S3x",), ("Ä1",)], "t string", names.category(F.col("t"))) == ["RE", "RE", None, None, "Ä"]


def test_clocks(spark):
    assert _values(spark, [(1470,), (None,)], "m int", clock.minutes_to_clock(F.col("m"))) == ["00:30", None]
    assert _values(spark, [(-5,)], "s int", clock.seconds_to_clock(F.col("s"))) == ["23:59:55"]
    assert _values(spark, [(112,), (-30,), (0,), (60,), (None,)], "s int", clock.delay_text(F.col("s"))) == ["+1m 52s late", "-30s early", "on time", "+1m 0s late", None]
    assert _values(spark, [(1439, 90)], "m int, b int", clock.actual_clock(F.col("m"), F.col("b"))) == ["00:00:30"]
    assert _values(spark, [(75, 20), (None, -20)], "a int, b int", clock.timeline_low(F.col("a"), F.col("b")), clock.timeline_high(F.col("a"), F.col("b"))) == [(0, 90), (-30, 60)]
    assert _values(spark, [("08:00",), ("25:10:30",), ("8:60",), ("x",), (None,)], "t string", clock.clock_to_minutes(F.col("t"))) == [480, 1510, None, None, None]


def test_name_tiers(spark):
    given = ["Bern", "Bern Wankdorf", "Thun, Bernstrasse", "Zollbern"]
    assert _values(spark, [(x,) for x in given], "t string", names.match_tier(F.col("t"), F.lit(" bern "))) == [0, 1, 2, 3]
    assert _values(spark, [("a.b",), ("acb",)], "t string", names.match_tier(F.col("t"), F.lit("a.b"))) == [0, 3]


def _departures(spark, deps, line="S3"):
    rows = [(0, i, s, 2, 1 if s == 1 else 2, line, d + 5 * (s - 1)) for i, d in enumerate(deps) for s in (1, 2)]
    return board.boardable(spark.createDataFrame(rows, "day_type int, trip int, seq int, n_stops int, stop int, line string, dep int"))


def _anchors(spark, at, limit, day=0):
    return spark.createDataFrame([(1, 1, day, at, limit)], "anchor int, stop int, query_day int, at int, `limit` int")


@pytest.mark.parametrize("page, at, limit, got", [("later", 500, 2, [500, 505, 505]), ("later", 501, 1, [505, 505]), ("earlier", 510, 1, [505, 505]), ("around", 505, 1, [500, 505, 505, 510])])
def test_pages(spark, page, at, limit, got):
    found = board.candidates(_departures(spark, [500, 505, 505, 510]), _anchors(spark, at, limit))
    assert sorted(r["clock"] for r in getattr(board, f"page_{page}")(found).collect()) == got


def test_pages_are_disjoint_and_complete(spark):
    deps = [400 + (k * 7) % 60 for k in range(40)]
    all_ = _departures(spark, deps)
    at, seen = 0, []
    while rows := board.page_later(board.candidates(all_, _anchors(spark, at, 5))).collect():
        seen += [r["clock"] for r in rows]
        at = max(r["clock"] for r in rows) + 1
    assert sorted(seen) == sorted(deps)


def test_previous_day(spark):
    found = board.candidates(_departures(spark, [1470]), _anchors(spark, 15, 3, day=1)).collect()
    assert [(r["clock"], r["dep"], r["offset"], r["day_type"]) for r in found] == [(30, 1470, 1440, 0)]
    assert board.candidates(_departures(spark, [1470]), _anchors(spark, 360, 3, day=1)).count() == 0
    again = board.earlier_with_tail(_departures(spark, [1470]), _anchors(spark, 400, 3, day=1))
    assert [r["clock"] for r in again.collect()] == [30]


def test_tail(spark):
    rows = [(0, 1, 1, 2, 1, "S", 1430), (0, 1, 2, 2, 2, "S", 1445), (0, 2, 1, 2, 1, "S", 1440), (0, 2, 2, 2, 2, "S", 1445)]
    times = spark.createDataFrame(rows, "day_type int, trip int, seq int, n_stops int, stop int, line string, dep int")
    assert {r["trip"] for r in timetables.past_midnight(times).collect()} == {2}


@pytest.mark.parametrize(
    "line, others, known, kind, matched",
    [
        ("RE12", [], ["RE"], "category", "RE"), ("RE12", ["RE5"], ["RE"], "none", None), ("RE12", ["RE"], ["RE"], "none", None), ("RE12", ["S3"], ["RE"], "category", "RE"),
        ("RE", [], ["RE12"], "number", "RE12"), ("RE", [], ["RE12", "RE5"], "none", None), ("RE", ["RE5"], ["RE12", "RE5"], "number", "RE12"),
        ("9", [], ["91"], "none", None), ("RE12", ["RE5"], ["RE12", "RE"], "exact", "RE12"), (" RE12 ", [], ["RE12"], "exact", "RE12"),
    ],
)
def test_matching(spark, line, others, known, kind, matched):
    page = spark.createDataFrame([(1, 0, 0, i, 1, 8507000, x, 510, 510) for i, x in enumerate([line, *others])], "anchor int, `offset` int, day_type int, trip int, seq int, stop int, line string, dep int, clock int")
    stats = spark.createDataFrame([("monday", 8507000, x, 510, 10, 20, 5) for x in known], "delay_set string, bpuic int, line string, dep_min int, catch_buffer_s int, avg_delay_s int, samples int")
    got = board.with_statistics(page, stats).where("trip = 0").collect()[0]
    assert (got["stats_day"]["kind"], got["stats_day"]["matched"]) == (kind, matched) and got["stats_all"]["kind"] == "none"


def test_board_order_is_by_language(spark):
    page = spark.createDataFrame([(1, 5, x, "d") for x in ("Z", "a", "ä", "b", "10", "2")], "anchor int, clock int, line string, destination string")
    assert [r["line"] for r in board.ordered_board(page).collect()] == ["10", "2", "a", "ä", "b", "Z"]


def test_selectable_dates(spark):
    today = datetime(2026, 3, 1).date()
    got = _values(spark, [(today, today + timedelta(k)) for k in (-1, 0, 14, 15)], "t date, d date", calendar.selectable(F.col("t"), F.col("d")))
    assert got == [False, True, True, False]
