"""Stop-event files and feed tables as DataFrames of text columns."""

from __future__ import annotations

from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from headwind.operators.observations import COLUMNS
from headwind.sources import files


def _texts(names: list[str]) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def header(line: str, sep: str = ";") -> list[str]:
    """Column names of a header line, without quotes, in unique form."""
    found = [x.strip().strip('"') for x in line.split(sep)]
    return [n if n and found.index(n) == i else f"_column_{i}" for i, n in enumerate(found)]


def read_stop_events(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The needed columns of semicolon-separated files as text, by their names in each file's header.

    Files may order their columns differently and have more. A missing column is an error; a short row has nulls; no files
    give no rows. Only the needed columns are parsed.
    """
    by_header: dict[tuple[str, ...], list[str]] = defaultdict(list)
    for path in paths:
        by_header[tuple(header(files.first_line(path)))].append(path)
    out = None
    for names, own in by_header.items():
        missing = [c for c in COLUMNS if c not in names]
        if missing:
            raise ValueError(f"{own[0]} lacks the columns {', '.join(missing)}")
        read = spark.read.schema(_texts(list(names))).option("unescapedQuoteHandling", "STOP_AT_CLOSING_QUOTE")
        part = read.csv(own, sep=";", header=True, quote='"', escape="", mode="PERMISSIVE", enforceSchema=True).select(*COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], _texts(list(COLUMNS)))


def read_feed_table(spark: SparkSession, folder: str, name: str, optional: bool = False) -> DataFrame | None:
    """A feed's comma-separated table as text by its header; None for a missing optional one.

    The table is a file, or a folder of files that all have the same header.
    """
    path = f"{folder}/{name}"
    if optional and not files.exists(path):
        return None
    names = header(files.first_line(files.first_part(path)), ",")
    return spark.read.schema(_texts(names)).csv(path, header=True, quote='"', escape='"', enforceSchema=True, multiLine=False)


def _dated(df: DataFrame | None, *columns: str) -> DataFrame | None:
    return None if df is None else df.withColumns({c: F.try_to_date(c, "yyyyMMdd") for c in columns})


def read_feed(spark: SparkSession, folder: str) -> dict[str, DataFrame | None]:
    """The tables of an unpacked feed, dates parsed. calendar and calendar_dates may be missing, not both."""
    weekly = _dated(read_feed_table(spark, folder, "calendar.txt", True), "start_date", "end_date")
    special = _dated(read_feed_table(spark, folder, "calendar_dates.txt", True), "date")
    if weekly is None and special is None:
        raise ValueError(f"{folder} has neither calendar.txt nor calendar_dates.txt")
    tables = {n: read_feed_table(spark, folder, f"{n}.txt") for n in ("stops", "routes", "trips", "stop_times")}
    return tables | {"calendar": weekly, "calendar_dates": special}


def feed_window(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """The first and last day that a feed says it covers, as ISO dates; None if it doesn't."""
    info = read_feed_table(spark, folder, "feed_info.txt", True)
    if info is None or not {"feed_start_date", "feed_end_date"} <= set(info.columns):
        return None
    row = _dated(info, "feed_start_date", "feed_end_date").select("feed_start_date", "feed_end_date").first()
    return None if row is None or None in row else (row[0].isoformat(), row[1].isoformat())
