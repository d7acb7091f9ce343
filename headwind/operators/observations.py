"""Stop events as text to observations: flags, status, line, station, stamps, delay and day offset, in that order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headwind.functions import clock, names

#: The columns that a stop event needs, by their names in the files.
COLUMNS = ("BETRIEBSTAG", "LINIEN_TEXT", "ZUSATZFAHRT_TF", "FAELLT_AUS_TF", "BPUIC", "ABFAHRTSZEIT", "AB_PROGNOSE", "AB_PROGNOSE_STATUS", "DURCHFAHRT_TF")
FLAGS = ("FAELLT_AUS_TF", "DURCHFAHRT_TF", "ZUSATZFAHRT_TF")
UNKNOWN_STATUS = "unbekannt"
MOST_DELAY = clock.DAY_SECONDS

_PARSED = ("bpuic", "line", "planned", "actual", "day")


def parsed(raw: DataFrame) -> DataFrame:
    """raw with the parsed columns bpuic, line, planned, actual, day, and reason: the first test that a row fails, or null.

    Missing values fail as empty ones do. Reasons: flag, status, line, station, stamp, delay, service_day.
    """
    missing = [c for c in COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"the stop events lack the columns {', '.join(missing)}")
    values = F.struct(
        names.station_number(F.col("BPUIC")).alias("bpuic"),
        F.btrim(F.col("LINIEN_TEXT"), F.lit(" ")).alias("line"),
        clock.stamp(F.col("ABFAHRTSZEIT")).alias("planned"),
        clock.stamp(F.col("AB_PROGNOSE")).alias("actual"),
        clock.service_day(F.col("BETRIEBSTAG")).alias("day"),
    )
    # A generator of one row keeps tests of parsed values above it, so that nothing is parsed twice.
    kept = [F.col(f"`{c}`") for c in raw.columns if c.lower() not in _PARSED]
    typed = raw.select(*kept, F.inline(F.array(values)))
    return typed.withColumn("reason", _reason())


def _flagged() -> Column:
    out = F.lit(False)
    for flag in FLAGS:
        out |= F.lower(F.coalesce(flag, F.lit(""))) == "true"
    return out


def _unknown_status() -> Column:
    return F.lower(F.coalesce("AB_PROGNOSE_STATUS", F.lit(""))).isin("", UNKNOWN_STATUS)


def _reason() -> Column:
    delay = clock.seconds_between(F.col("planned"), F.col("actual"))
    offset = F.datediff(F.col("planned").cast("date"), F.col("day"))
    return (
        F.when(_flagged(), "flag")
        .when(_unknown_status(), "status")
        .when(F.coalesce("line", F.lit("")) == "", "line")
        .when(F.col("bpuic").isNull(), "station")
        .when(F.col("planned").isNull() | F.col("actual").isNull(), "stamp")
        .when(~delay.between(-MOST_DELAY, MOST_DELAY), "delay")
        .when(F.col("day").isNull() | ~offset.between(-1, 1), "service_day")
    )


def extract_observations(raw: DataFrame) -> DataFrame:
    """(service_day, bpuic, line, dep_min, day_offset, delay_s) of the rows that pass every test."""
    kept = parsed(raw.where(~_flagged()).where(~_unknown_status())).where("reason is null")
    return kept.select(
        F.col("day").alias("service_day"), "bpuic", "line", clock.minute_of_day(F.col("planned")).cast("int").alias("dep_min"),
        F.datediff(F.col("planned").cast("date"), F.col("day")).cast("int").alias("day_offset"), clock.seconds_between(F.col("planned"), F.col("actual")).cast("int").alias("delay_s"),
    )


def drop_reasons(raw: DataFrame) -> DataFrame:
    """(reason, n): rows by the first test that they fail; `kept` for those that pass."""
    return parsed(raw).groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))
