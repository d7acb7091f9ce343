"""Binary shards and timetable messages."""

import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from headwind.operators import departures as board
from headwind.operators import services, timetables
from headwind.sources import binary, files


def _varint(n):
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def _field(number, value):
    return _varint(number << 3 | 2) + _varint(len(value)) + value if isinstance(value, bytes) else _varint(number << 3) + _varint(value)


def _timetable():
    times = struct.pack("<8H", 1, 480, 2, 490, 3, 1450, 4, 1460)
    pattern = _field(1, times) + _field(9, 7) + _field(3, struct.pack("<2I", 5, 300)) + _field(4, 1)
    return _field(1, _field(1, b"\x00")) + _field(2, pattern) + _field(3, _field(1, 3) + _field(2, b"B")) + _field(3, _field(1, 99) + _field(2, "Ä1".encode())) + _field(8, b"more")


def test_timetable_message(spark, tmp_path):
    files.write_bytes(str(tmp_path / "a.pb"), _timetable(), pack=True)
    rows = binary.read_timetables(spark, [str(tmp_path / "a.pb")]).orderBy("trip", "seq").drop("path").collect()
    assert [tuple(r) for r in rows] == [(0, 0, 1, 2, 5, 480, 0, "Ä1"), (0, 0, 2, 2, 300, 490, 0, "Ä1"), (0, 1, 1, 2, 5, 1450, 0, "Ä1"), (0, 1, 2, 2, 300, 1460, 0, "Ä1")]
    for damaged in (_timetable()[:-1], b"\x0b", _field(2, _field(3, b"123"))):
        with pytest.raises(ValueError):
            binary.timetable_rows(damaged)
    assert binary.timetable_rows(b"").empty


def test_shards_round_trip(spark, tmp_path):
    rows = [("all", 8507000, "S3", 600, 10, 20, 9, 0), ("all", 8507000, "RE", 60, -5, 99_999, 300, 1), ("all", 8507000 + 1024, "S3", 70, 1, 2, 3, -1), ("monday", 8507007, "RE", 1, 1, 1, 1, 0), ("monday", 8507007, "unknown", 1, 1, 1, 1, 0)]
    stats = spark.createDataFrame(rows, "delay_set string, bpuic int, line string, dep_min int, catch_buffer_s int, avg_delay_s int, samples int, day_offset int")
    lines = binary.numbered_lines(stats.where("line <> 'unknown'"))
    shards = binary.pack_shards(services.shard_rows(stats).drop("clamped"), lines).collect()
    assert {(r["delay_set"], r["bucket"]) for r in shards} == {("all", 8507000 % 1024), ("monday", 8507007 % 1024)}
    for r in shards:
        files.write_bytes(str(tmp_path / r["delay_set"] / f"{r['bucket']}.bin.gz"), bytes(r["data"]))
    back = binary.read_shards(spark, str(tmp_path)).join(lines.withColumnRenamed("line", "name"), F.col("line") == F.col("number"))
    got = sorted(tuple(r) for r in back.select("delay_set", "bpuic", "dep_min", "catch_buffer_s", "avg_delay_s", "samples", "day_offset").collect())
    assert got == [("all", 8507000, 60, -5, 32767, 255, 1), ("all", 8507000, 600, 10, 20, 9, 0), ("all", 8508024, 70, 1, 2, 3, -1), ("monday", 8507007, 1, 1, 1, 1, 0)]
    with pytest.raises(ValueError, match="format"):
        binary.unpack_shard(b"\x01\x00\x00\x00\x00")
    assert binary.unpack_shard(binary.pack_shard(pd.DataFrame({c: [] for c in ("bpuic", *binary.ROW.names)}))).empty


def test_empty_pages_roll_over(spark):
    anchors = spark.createDataFrame([(1, 1, 6, 1500, 3), (2, 1, 0, 100, 3)], "anchor int, stop int, query_day int, at int, `limit` int")
    page = spark.createDataFrame([(2,)], "anchor int")
    assert [tuple(r) for r in board.roll_over(page, anchors).select("anchor", "query_day", "at").collect()] == [(1, 0, 60)]
    assert [tuple(r) for r in board.roll_over(page.limit(0), anchors, later=False).orderBy("anchor").select("query_day", "at").collect()] == [(5, 2940), (6, 1540)]
    assert board.scope_for("group", ["day", "group"]) == "group" and board.scope_for("all", ["group"]) == "group" and board.scope_for(None, []) == "day"


def test_pages_over_dates_follow_the_calendar(spark):
    from datetime import date

    # 3 April 2026 is Good Friday: its timetable is Sunday's.
    anchors = spark.createDataFrame([(1, 1, date(2026, 4, 2), 3, 1500, 3), (2, 1, date(2026, 4, 15), 2, 1500, 3)], "anchor int, stop int, date date, query_day int, at int, `limit` int")
    empty = spark.createDataFrame([], "anchor int")
    rolled = board.roll_over(empty, anchors, window=("2026-04-01", "2026-04-15")).collect()
    assert [(r["anchor"], r["date"], r["query_day"], r["at"]) for r in rolled] == [(1, date(2026, 4, 3), 6, 60)]
    times = spark.createDataFrame([(6, 7, 1, 1, "S", 90, 9)], "day_type int, trip int, seq int, stop int, line string, dep int, destination int")
    page = board.page_over_dates(times, anchors, window=("2026-04-01", "2026-04-15")).collect()
    assert [(r["anchor"], r["date"], r["clock"], r["rolled"]) for r in page] == [(1, date(2026, 4, 3), 90, 1)]
    asked = spark.createDataFrame([(0,), (6,)], "day_type int")
    got = board.resolve_day_types(asked, times.select("day_type")).orderBy("day_type").collect()
    assert [(r["answers"], r["own"]) for r in got] == [(6, False), (6, True)]
    assert board.resolve_day_types(asked, times.select("day_type").limit(0)).where("answers is null and not own").count() == 2


def test_build_totals(spark):
    routes = spark.createDataFrame([("r1", "RE", "RE 12"), ("r2", "EC", "EC 4"), ("r3", "S", None)], "route_id string, route_short_name string, route_long_name string")
    rows = [(0, 1, 1, 2, 1, "S", 1450), (0, 1, 2, 2, 2, "S", 1460), (0, 2, 1, 2, 1, "S", 100), (0, 2, 2, 2, 2, "S", 110)]
    times = spark.createDataFrame(rows, "day_type int, trip int, seq int, n_stops int, stop int, line string, dep int")
    assert timetables.build_totals(routes, times) == {"routes": 3, "renamed": 1, "late_trips": 1, "late_patterns": 1}
