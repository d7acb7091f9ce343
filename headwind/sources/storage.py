"""Tables at rest: observations by service day, statistics by delay set and bucket, a manifest that publishes them.

What is written stays in a folder of its own until the manifest names it, and the manifest is replaced in one move, so a
reader sees the old or the new state. day_type is derived, never stored: a change of the calendar moves no files.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from headwind.operators import services
from headwind.sources import files

MANIFEST = "manifest.json"


def write_observations(obs: DataFrame, folder: str) -> None:
    """Replace the service days that obs has; other days stay."""
    placed = obs.repartition("service_day").sortWithinPartitions("bpuic", "line", "dep_min")
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("service_day").parquet(folder)


def stored_days(folder: str) -> list[date]:
    """Service days that have files."""
    return [date.fromisoformat(n.split("=", 1)[1]) for n in files.children(folder) if n.startswith("service_day=") and not n.endswith("__HIVE_DEFAULT_PARTITION__")]


def missing_days(folder: str, wanted: list[date], force: bool = False) -> list[date]:
    """The days to extract: those without files, or all if forced."""
    there = set() if force else set(stored_days(folder))
    return [d for d in wanted if d not in there]


def read_observations(spark: SparkSession, folder: str, days: list[date] | None = None) -> DataFrame:
    """Observations of the given days alone, whatever else lies there; by partition, so no other file is read."""
    df = spark.read.parquet(folder)
    return df if days is None else df.where(F.col("service_day").isin(list(days)))


def write_statistics(stats: DataFrame, folder: str) -> DataFrame:
    """Write shard rows by delay set and bucket, in order of station, line and minute; returns them as read back."""
    rows = services.shard_rows(stats)
    placed = rows.repartition("delay_set", "bucket").sortWithinPartitions("delay_set", "bucket", "bpuic", "line", "dep_min")
    placed.write.mode("overwrite").partitionBy("delay_set", "bucket").option("compression", "zstd").parquet(folder)
    return stats.sparkSession.read.parquet(folder)


def station_statistics(stored: DataFrame, delay_set: str, bpuic: int) -> DataFrame:
    """One station's statistics of a set: the bucket is part of the query, so one partition is read."""
    return stored.where((F.col("delay_set") == delay_set) & (F.col("bucket") == bpuic % services.BUCKETS) & (F.col("bpuic") == bpuic))


def write_tail(tail: DataFrame, folder: str) -> None:
    tail.repartition("day_type").sortWithinPartitions("trip", "seq").write.mode("overwrite").partitionBy("day_type").parquet(folder)


def publish(root: str, changes: dict) -> dict:
    """Merge changes over the manifest as it is now, and replace it; returns the result."""
    merged = (files.read_json(f"{root}/{MANIFEST}", optional=True) or {}) | changes
    files.write_json(f"{root}/{MANIFEST}", merged)
    return merged


def publish_statistics(stats: DataFrame, root: str) -> dict:
    """Write statistics to a new folder and name it in the manifest, with what was written."""
    name = f"statistics-{uuid.uuid4().hex}"
    stored = write_statistics(stats, f"{root}/{name}")
    totals = stored.agg(F.count("*"), F.count_if("clamped"), F.count_distinct("bpuic")).first()
    sets = [r[0] for r in stored.select("delay_set").distinct().orderBy("delay_set").collect()]
    lines = [r[0] for r in stored.select("line").distinct().orderBy("line").collect()]
    return publish(root, {"statistics": name, "delay_sets": sets, "lines": lines, "services": totals[0], "clamped": totals[1], "stations": totals[2], "buckets": services.BUCKETS})


def read_statistics(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{files.read_json(f'{root}/{MANIFEST}')['statistics']}")


def is_fresh(root: str, key: str, stamp: str) -> bool:
    """Whether the manifest says that key was made from inputs of that stamp."""
    return ((files.read_json(f"{root}/{MANIFEST}", optional=True) or {}).get("stamps") or {}).get(key) == stamp


def stamp(root: str, key: str, value: str) -> dict:
    known = (files.read_json(f"{root}/{MANIFEST}", optional=True) or {}).get("stamps") or {}
    return publish(root, {"stamps": known | {key: value}})
