"""The batch build from the command line: archives and a feed to observations, statistics, timetables and a manifest."""

from __future__ import annotations

import argparse
from datetime import date

from pyspark.sql import DataFrame, SparkSession

from headwind.functions import calendar, names
from headwind.operators import services, timetables
from headwind.operators.departures import boardable
from headwind.operators.observations import extract_observations
from headwind.session import build_session, new_path
from headwind.sources import files, readers, storage


PARTS = ("timetables", "delays")


def arguments(argv: list[str] | None = None) -> argparse.Namespace:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("root", help="folder of the results")
    p.add_argument("--archives", nargs="*", default=[], help="monthly archives of stop events")
    p.add_argument("--feed", help="archive of the timetable feed")
    p.add_argument("--months", type=int, default=12, help="whole months before today to cover")
    p.add_argument("--days", type=int, help="only the first days, for a trial")
    p.add_argument("--min-samples", type=int, default=1, help="samples that a service needs for each day offset")
    p.add_argument("--today", type=date.fromisoformat, default=None, help="the day to count from")
    p.add_argument("--only", choices=PARTS, help="run one part alone")
    p.add_argument("--skip", choices=PARTS, action="append", default=[], help="leave a part out; may be repeated")
    p.add_argument("--force", action="store_true", help="extract days again that are there")
    p.add_argument("--prune", action="store_true", help="delete each archive once its days are stored")
    a = p.parse_args(argv)
    if a.only and a.skip:
        p.error("--only and --skip exclude each other")
    if a.months < 1 or a.min_samples < 0 or (a.days is not None and a.days < 1):
        p.error("months and days must be at least 1, min-samples at least 0")
    a.today = a.today or date.today()
    return a


def first_of_window(today: date, months: int) -> date:
    at = today.year * 12 + today.month - 1 - months
    return date(at // 12, at % 12 + 1, 1)


def extract(spark: SparkSession, root: str, archives: list[str], since: date, until: date, limit: int | None = None, force: bool = False, prune: bool = False) -> list[date]:
    """Observations of the archives' days in [since, until); returns the days that this run covers.

    Days that are there are not extracted again, and days whose archive is missing count if they are there. Files are
    unpacked in tasks, and what is unpacked is deleted once its rows are stored. prune: so is an archive of which all days
    in the window are stored; a run that was limited to some days keeps it.
    """
    target = f"{root}/observations"
    held = {a: files.day_members(files.members(a)) for a in archives}
    offered = {d: m for found in held.values() for d, m in found if since <= d < until}
    cached = {d for d in storage.stored_days(target) if since <= d < until}
    days = sorted(offered.keys() | cached)[:limit]
    todo = [d for d in storage.missing_days(target, days, force) if d in offered]
    if todo:
        staged = new_path(spark, "stop-events")
        paths = files.unpack_all(spark, [(offered[d], f"{staged}/{d.isoformat()}.csv") for d in todo])
        storage.write_observations(extract_observations(readers.read_stop_events(spark, paths)), target)
        files.remove(staged)
    # A day without a single kept row has no files: it was read all the same.
    there = set(storage.stored_days(target)) | set(todo)
    for archive, found in held.items() if prune else ():
        if all(d in there for d, _ in found if since <= d < until):
            files.remove(archive)
    return days


def aggregate(spark: SparkSession, root: str, days: list[date], min_samples: int = 1, stations: DataFrame | None = None) -> dict:
    """Statistics of the covered days, published with what they cover."""
    obs = storage.read_observations(spark, f"{root}/observations", days)
    manifest = storage.publish_statistics(services.service_statistics(obs, min_samples, stations), root)
    covered = {r["delay_set"]: r["days"] for r in services.coverage_days(obs).collect()}
    return manifest | storage.publish(root, {"days": covered, "min_samples": min_samples})


def build_timetables(spark: SparkSession, root: str, feed: str, today: date) -> dict:
    """Stop times and tails of a date for each day type, from an archived feed; skipped if nothing changed."""
    folder = new_path(spark, "feed")
    files.unpack_all(spark, [(m, f"{folder}/{m.name.rsplit('/', 1)[-1]}") for m in files.members(feed)])
    window = readers.feed_window(spark, folder)
    asked = spark.createDataFrame([(today,)], "today date")
    dates = calendar.timetable_dates(asked, window=window).select("day_type", "date")
    chosen = {calendar.DAY_TYPES[r["day_type"]]: r["date"].isoformat() for r in dates.collect()}
    absent = [d for d in calendar.DAY_TYPES if d not in chosen]
    if absent:
        raise ValueError(f"no date within three weeks of {today} in the feed for {', '.join(absent)}")
    mark = files.fingerprint(feed, names.RULES, sorted(chosen.items()))
    if storage.is_fresh(root, "timetables", mark):
        return files.read_json(f"{root}/{storage.MANIFEST}")
    tables = readers.read_feed(spark, folder)
    running = timetables.active_services(dates.select("date").distinct(), tables["calendar"], tables["calendar_dates"])
    times = timetables.feed_stop_times(dates, tables["stop_times"], tables["trips"], tables["routes"], running)
    name = f"timetables-{mark[:16]}"
    times.repartition("day_type", "trip").sortWithinPartitions("day_type", "trip", "seq").write.mode("overwrite").partitionBy("day_type").parquet(f"{root}/{name}/stop_times")
    stored = spark.read.parquet(f"{root}/{name}/stop_times")
    storage.write_tail(timetables.past_midnight(stored), f"{root}/{name}/tail")
    # Boards need no sort of the whole timetable: each departure is stored with its trip's destination.
    boardable(stored).repartition("day_type", "stop").sortWithinPartitions("day_type", "stop", "dep").write.mode("overwrite").partitionBy("day_type").parquet(f"{root}/{name}/boards")
    timetables.feed_stations(tables["stops"]).write.mode("overwrite").parquet(f"{root}/{name}/stations")
    files.remove(folder)
    storage.publish(root, {"timetables": name, "timetable_dates": chosen})
    return storage.stamp(root, "timetables", mark)


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    manifest = {}
    wanted = [p for p in PARTS if (p == a.only if a.only else p not in a.skip)]
    if a.feed and "timetables" in wanted:
        manifest = build_timetables(spark, a.root, a.feed, a.today)
    if "delays" in wanted:
        days = extract(spark, a.root, a.archives, first_of_window(a.today, a.months), a.today.replace(day=1), a.days, a.force, a.prune)
        known = files.read_json(f"{a.root}/{storage.MANIFEST}", optional=True) or {}
        stations = spark.read.parquet(f"{a.root}/{known['timetables']}/stations") if "timetables" in known else None
        if days:
            manifest = aggregate(spark, a.root, days, a.min_samples, stations)
    return manifest


def main(argv: list[str] | None = None) -> None:
    run(build_session("headwind-build"), arguments(argv))


if __name__ == "__main__":
    main()
