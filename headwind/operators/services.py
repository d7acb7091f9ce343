"""Observations to service statistics: samples, mean delay and the nearest-rank lower decile ("catch buffer").

A service is (station, line, planned minute). Its statistics exist for each delay set: a weekday, the pool of working
days or of the weekend, and all days. Pools are computed from the observations, as percentiles don't merge; what does
merge is the count of each delay, so observations are first counted by delay, on the map side too, and each set's
percentile is read off the running count. The counts are then dealt once by service, and everything after - the sets,
running counts, totals, the choice of day offset - happens in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headwind.functions import calendar

SERVICE = ("bpuic", "line", "dep_min")
BUCKETS = 1024


def rounded_mean(total: Column, n: Column) -> Column:
    """total / n to a whole number, halves away from 0."""
    return (F.signum(total).cast("bigint") * F.floor((2 * F.abs(total) + n) / (2 * n))).cast("int")


def delay_counts(obs: DataFrame, by: list[str]) -> DataFrame:
    """(by..., delay_s, n): how often each delay was seen. This is what statistics of any coarser set follow from."""
    return obs.groupBy(*by, "delay_s").agg(F.count("*").alias("n"))


def statistics(counts: DataFrame, by: list[str]) -> DataFrame:
    """(by..., samples, avg_delay_s, catch_buffer_s) from delay_counts: the buffer is the delay of 0-based rank n div 10."""
    group = Window.partitionBy(*by)
    ranked = counts.withColumn("upto", F.sum("n").over(group.orderBy("delay_s").rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("samples", F.sum("n").over(group))
    reached = F.when(F.col("upto") > F.floor(F.col("samples") / 10), F.col("delay_s"))
    made = ranked.groupBy(*by).agg(F.max("samples").alias("samples"), F.sum(F.col("n") * F.col("delay_s")).alias("total"), F.min(reached).alias("catch_buffer_s"))
    return made.select(*by, F.col("samples").cast("bigint").alias("samples"), rounded_mean(F.col("total"), F.col("samples")).alias("avg_delay_s"), F.col("catch_buffer_s").cast("int").alias("catch_buffer_s"))


def service_groups(obs: DataFrame) -> DataFrame:
    """(service..., day_offset, samples, total_delay_s) of all days."""
    return obs.groupBy(*SERVICE, "day_offset").agg(F.count("*").alias("samples"), F.sum("delay_s").cast("bigint").alias("total_delay_s"))


def best_offset(stats: DataFrame, by: list[str]) -> DataFrame:
    """Of the day offsets of a service the best sampled one; on a tie the smaller one, and of -1 and 1 the former."""
    order = Window.partitionBy(*by).orderBy(F.desc("samples"), F.abs("day_offset"), "day_offset")
    return stats.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def service_statistics(obs: DataFrame, min_samples: int = 1, stations: DataFrame | None = None, pools: bool = True) -> DataFrame:
    """(delay_set, service..., catch_buffer_s, avg_delay_s, samples, day_offset).

    obs: service_day, service..., day_offset, delay_s. min_samples holds for each day offset, before one is chosen.
    stations: (bpuic) of the stations to keep; it is applied first, as the station is part of the key.
    """
    if stations is not None:
        obs = obs.join(stations.select("bpuic").distinct(), "bpuic", "left_semi")
    counted = delay_counts(obs.withColumn("day_type", calendar.day_type(F.col("service_day"))), [*SERVICE, "day_offset", "day_type"])
    placed = counted.repartition(*SERVICE)
    sets = calendar.delay_sets(F.col("day_type")) if pools else F.array(calendar.day_type_name(F.col("day_type")))
    each = placed.withColumn("delay_set", F.explode(sets))
    by = [*SERVICE, "delay_set", "day_offset"]
    pooled = each.groupBy(*by, "delay_s").agg(F.sum("n").alias("n"))
    stats = statistics(pooled, by).where(F.col("samples") >= min_samples)
    return best_offset(stats, [*SERVICE, "delay_set"]).select("delay_set", *SERVICE, "catch_buffer_s", "avg_delay_s", "samples", "day_offset")


def ignored_lines(obs: DataFrame, lines: DataFrame) -> DataFrame:
    """(line, n): observations whose line the line table lacks."""
    return obs.join(lines.select("line").distinct(), "line", "left_anti").groupBy("line").agg(F.count("*").alias("n"))


def line_table(obs: DataFrame) -> DataFrame:
    return obs.select("line").distinct()


def coverage_days(obs: DataFrame) -> DataFrame:
    """(delay_set, days): distinct service days of each set that has any."""
    days = obs.select("service_day").distinct()
    return days.select("service_day", F.explode(calendar.delay_sets(calendar.day_type(F.col("service_day")))).alias("delay_set")).groupBy("delay_set").agg(F.count("*").alias("days"))


def shard_rows(stats: DataFrame) -> DataFrame:
    """Statistics as they are stored: clamped to two bytes, samples to one, with the station's bucket."""
    clamp = lambda c: F.greatest(F.lit(-32768), F.least(F.lit(32767), F.col(c))).cast("int")
    return stats.withColumns({
        "clamped": ((F.col("catch_buffer_s") != clamp("catch_buffer_s")) | (F.col("avg_delay_s") != clamp("avg_delay_s"))),
        "catch_buffer_s": clamp("catch_buffer_s"), "avg_delay_s": clamp("avg_delay_s"),
        "samples": F.least(F.lit(255), "samples").cast("int"), "bucket": bucket(F.col("bpuic")),
    })


def bucket(bpuic: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(bpuic, F.lit(buckets)).cast("int")
