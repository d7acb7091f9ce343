"""Sources and sinks: round trips over files made here."""

import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from headwind.plans import build
from headwind.sources import files, readers, storage
from headwind.streaming.extract import extract_stream

HEAD = "BETRIEBSTAG;FAHRT_BEZEICHNER;LINIEN_TEXT;ZUSATZFAHRT_TF;FAELLT_AUS_TF;BPUIC;ABFAHRTSZEIT;AB_PROGNOSE;AB_PROGNOSE_STATUS;DURCHFAHRT_TF"


def _row(day, line, bpuic, planned, actual, status="REAL", extra="false"):
    return f'{day};x;"{line}";{extra};false;{bpuic};{planned};{actual};{status};false'


@pytest.fixture
def archive(tmp_path):
    path = tmp_path / "month.zip"
    first = "\r\n".join(["﻿" + HEAD, _row("05.03.2026", " RE12 ", "850700712", "05.03.2026 07:08", "05.03.2026 07:09:30"), _row("05.03.2026", "S3", "8507000", "06.03.2026 00:30", "06.03.2026 00:29:00"), _row("05.03.2026", "S3", "85x", "05.03.2026 07:08", "05.03.2026 07:09:30"), "05.03.2026;short"])
    # Another order of columns.
    other = "LINIEN_TEXT;" + HEAD.replace(";LINIEN_TEXT", "") + "\n" + "RE12;" + _row("06.03.2026", "!", "8507007", "06.03.2026 07:08", "06.03.2026 07:08:10").replace(';"!"', "") + "\n"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("data/2026-03-06_IstDaten.csv", other)
        z.writestr("data/2026-03-05_istdaten.csv", first)
        z.writestr("readme.txt", "nothing")
    return str(path)


def test_members_are_found_by_name_and_day(archive):
    found = files.members(archive)
    assert files.find_member(found, "readme.txt").size == 7
    assert files.find_member(found, "2026-03-06_IstDaten.csv") is not None
    assert files.find_member(found, "IstDaten.csv") is None
    assert [d for d, _ in files.day_members(found)] == [date(2026, 3, 5), date(2026, 3, 6)]


def test_build_of_delays(spark, archive, tmp_path):
    root = str(tmp_path / "out")
    a = build.arguments([root, "--archives", archive, "--today", "2026-04-10", "--months", "1"])
    manifest = build.run(spark, a)
    assert manifest["services"] == 7 and manifest["stations"] == 2 and manifest["lines"] == ["RE12", "S3"]
    assert manifest["days"] == {"thursday": 1, "friday": 1, "weekdays": 2, "all": 2}
    stored = storage.read_statistics(spark, root)
    got = storage.station_statistics(stored, "weekdays", 8507007)
    assert [tuple(r) for r in got.select("line", "dep_min", "catch_buffer_s", "avg_delay_s", "samples", "day_offset").collect()] == [("RE12", 428, 10, 50, 2, 0)]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(delay_set" in plan
    night = storage.station_statistics(stored, "thursday", 8507000).collect()[0]
    assert (night["dep_min"], night["day_offset"], night["avg_delay_s"]) == (30, 1, -60)


def test_days_that_are_there_are_kept(spark, archive, tmp_path):
    root = str(tmp_path / "out")
    since, until = date(2026, 3, 1), date(2026, 4, 1)
    assert build.extract(spark, root, [archive], since, until, limit=1) == [date(2026, 3, 5)]
    assert storage.missing_days(f"{root}/observations", [date(2026, 3, 5), date(2026, 3, 6)]) == [date(2026, 3, 6)]
    assert storage.missing_days(f"{root}/observations", [date(2026, 3, 5)], force=True) == [date(2026, 3, 5)]
    # Without its archive, a day that is there still counts.
    assert build.extract(spark, root, [], since, until) == [date(2026, 3, 5)]
    assert build.extract(spark, root, [archive], since, until) == [date(2026, 3, 5), date(2026, 3, 6)]
    assert storage.read_observations(spark, f"{root}/observations", [date(2026, 3, 6)]).count() == 1


def test_a_missing_column_is_an_error(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text("BETRIEBSTAG;BPUIC\n1;2\n")
    with pytest.raises(ValueError, match="LINIEN_TEXT"):
        readers.read_stop_events(spark, [str(path)])
    assert readers.read_stop_events(spark, []).count() == 0


def test_stream_equals_batch(spark, archive, tmp_path):
    source = tmp_path / "in"
    member = files.find_member(files.members(archive), "2026-03-05_istdaten.csv")
    path = files.unpack(member, str(source / "a.csv"))
    names = readers.header(files.first_line(path))
    extract_stream(spark, str(source), names, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    batch = build.extract_observations(readers.read_stop_events(spark, [path]))
    made = spark.read.parquet(str(tmp_path / "t")).select(batch.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, batch.collect())) and made.count() == 2


def test_stream_of_files_with_other_headers(spark, archive, tmp_path):
    source, found = tmp_path / "in", files.members(archive)
    paths = [files.unpack(m, str(source / f"{d}.csv")) for d, m in files.day_members(found)]
    for _ in range(2):  # the second run finds nothing new
        extract_stream(spark, str(source), ["FAHRT_BEZEICHNER"], str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    batch = build.extract_observations(readers.read_stop_events(spark, paths))
    made = spark.read.parquet(str(tmp_path / "t")).select(batch.columns)
    assert sorted(map(str, made.collect())) == sorted(map(str, batch.collect())) and made.count() == 3


def test_files_are_unpacked_in_tasks_and_deleted(spark, archive, tmp_path):
    import os

    from headwind import session

    found = [(m, str(tmp_path / "all" / f"{i}.txt")) for i, m in enumerate(files.members(archive))]
    assert files.unpack_all(spark, found) == [t for _, t in found] and files.unpack_all(spark, []) == []
    assert open(found[2][1]).read() == "nothing"
    since, until, root = date(2026, 3, 1), date(2026, 4, 1), str(tmp_path / "out")
    mark = session.made()
    build.extract(spark, root, [archive], since, until, limit=1, prune=True)
    assert os.path.exists(archive) and not any(files.exists(p) for p in session._made[mark:])
    build.extract(spark, root, [archive], since, until, prune=True)
    assert not os.path.exists(archive) and len(storage.stored_days(f"{root}/observations")) == 2


def test_parts_and_rules(tmp_path, monkeypatch):
    assert build.arguments(["out", "--skip", "delays"]).skip == ["delays"]
    with pytest.raises(SystemExit):
        build.arguments(["out", "--skip", "delays", "--only", "delays"])
    path = str(tmp_path / "x")
    files.write_bytes(path, b"x")
    assert files.fingerprint(path, 1) != files.fingerprint(path, 2)


def test_manifest_keeps_other_keys(tmp_path):
    root = str(tmp_path)
    storage.publish(root, {"a": 1})
    assert storage.publish(root, {"b": 2}) == {"a": 1, "b": 2}
    storage.stamp(root, "x", "1")
    assert storage.is_fresh(root, "x", "1") and not storage.is_fresh(root, "x", "2")


def test_packed_bytes_are_reproducible_and_sniffed(tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    files.write_bytes(a, b'{"x": 1}', pack=True)
    files.write_bytes(b, b'{"x": 1}', pack=True)
    assert open(a, "rb").read() == open(b, "rb").read() and files.read_json(a) == {"x": 1}
    assert files.read_json(str(tmp_path / "none"), optional=True) is None


FEED = {
    "feed_info.txt": "feed_publisher_name,feed_start_date,feed_end_date\nx,20251214,20261212\n",
    "stops.txt": 'stop_id,stop_name\n8507000:0:1,"Bern, Bahnhof"\n8507007,B\nx1,C\n',
    "routes.txt": 'route_id,route_short_name,route_long_name,route_type\nr1,RE,"RE 12",2\nr2,EC,EC 4,2\n',
    "trips.txt": "route_id,service_id,trip_id\nr1,wk,t1\nr1,wk,t2\nr2,sun,t3\n",
    "stop_times.txt": "trip_id,departure_time,stop_id,stop_sequence\nt1,07:00:00,8507000,1\nt1,,8507007,2\nt1,07:30:00,x1,5\nt2,23:50:00,8507000,1\nt2,24:05:00,8507007,2\nt2,24:10:00,x1,3\nt3,23:50:00,8507000,1\nt3,24:05:00,x1,2\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nwk,1,1,1,1,1,0,0,20251214,20261212\nsun,0,0,0,0,0,0,1,20251214,20261212\n",
    "calendar_dates.txt": "service_id,date,exception_type\nwk,20260817,2\nsun,20260817,1\n",
}


def test_build_of_timetables(spark, tmp_path):
    feed, root = tmp_path / "feed.zip", str(tmp_path / "out")
    with zipfile.ZipFile(feed, "w") as z:
        for name, text in FEED.items():
            z.writestr(name, text)
    manifest = build.build_timetables(spark, root, str(feed), date(2026, 8, 17))
    # Monday 17 August is nearest for itself; the feed takes the week service out on that day.
    assert manifest["timetable_dates"]["monday"] == "2026-08-17" and manifest["timetable_dates"]["friday"] == "2026-08-14"
    times = spark.read.parquet(f"{root}/{manifest['timetables']}/stop_times")
    assert times.where("day_type = 0").select("trip").distinct().collect()[0][0] == "t3"
    t1 = times.where("day_type = 1 and trip = 't1'").orderBy("seq").select("seq", "n_stops", "stop", "line", "dep").collect()
    assert [tuple(r) for r in t1] == [(1, 2, "8507000", "RE12", 420), (2, 2, "x1", "RE12", 450)]
    tail = spark.read.parquet(f"{root}/{manifest['timetables']}/tail")
    assert {r[0] for r in tail.select("trip").distinct().collect()} == {"t2"}
    assert sorted(r[0] for r in spark.read.parquet(f"{root}/{manifest['timetables']}/stations").collect()) == [8507000, 8507007]
    assert build.build_timetables(spark, root, str(feed), date(2026, 8, 17)) == manifest


def test_arguments():
    a = build.arguments(["out", "--today", "2026-01-05"])
    assert (a.months, a.min_samples) == (12, 1) and build.first_of_window(a.today, 12) == date(2025, 1, 1)
    with pytest.raises(SystemExit):
        build.arguments(["out", "--months", "0"])
    assert build.arguments(["out", "--min-samples", "0"]).min_samples == 0


def test_short_rows_are_dropped(spark, archive, tmp_path):
    member = files.find_member(files.members(archive), "2026-03-05_istdaten.csv")
    raw = readers.read_stop_events(spark, [files.unpack(member, str(tmp_path / "a.csv"))])
    assert raw.count() == 4 and raw.where(F.col("BPUIC").isNull()).count() == 1
