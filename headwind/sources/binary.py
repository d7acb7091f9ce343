"""The binary bundle of a departure board: statistics shards and timetable messages.

A shard has the statistics of one delay set and station bucket; its line numbers index the sorted line table. A timetable
is a protobuf message of stops, patterns and services. Both are whole files of bounded size, one to a task.
"""

from __future__ import annotations

import gzip
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from headwind.session import ship

# The shard's format number and layout, and the largest known route type.
FORMAT = 2
STATION = np.dtype([("bpuic", "<u4"), ("first", "<u4"), ("count", "<u4")])
ROW = np.dtype([("line", "<u2"), ("dep_min", "<u2"), ("catch_buffer_s", "<i2"), ("avg_delay_s", "<i2"), ("samples", "u1"), ("day_offset", "i1")])
MOST_ROUTE_TYPE = 10
MOST_LINES = 1 << 16

_STATS = "delay_set string, bpuic int, line int, dep_min int, catch_buffer_s int, avg_delay_s int, samples int, day_offset int"


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(line, number) of the distinct lines in order; there are few enough for two bytes, or it is an error."""
    distinct = lines.select("line").distinct()
    n = distinct.count()
    if n > MOST_LINES:
        raise ValueError(f"{n} lines are more than a shard can number")
    return distinct.withColumn("number", F.row_number().over(Window.orderBy("line")) - 1)


def pack_shard(rows: pd.DataFrame) -> bytes:
    """A shard of (bpuic, line, dep_min, ...) with numbered lines and values within their limits."""
    rows = rows.sort_values(["bpuic", "line", "dep_min"], kind="stable")
    ids, first, counts = np.unique(rows["bpuic"].to_numpy(), return_index=True, return_counts=True)
    stations = np.zeros(len(ids), STATION)
    stations["bpuic"], stations["first"], stations["count"] = ids, first, counts
    packed = np.zeros(len(rows), ROW)
    for name in ROW.names:
        packed[name] = rows[name].to_numpy()
    return gzip.compress(struct.pack("<BI", FORMAT, len(ids)) + stations.tobytes() + packed.tobytes(), 9, mtime=0)


def unpack_shard(data: bytes) -> pd.DataFrame:
    data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data
    version, n = struct.unpack_from("<BI", data)
    if version != FORMAT:
        raise ValueError(f"shard format {version} is not known")
    stations = np.frombuffer(data, STATION, n, 5)
    rows = np.frombuffer(data, ROW, offset=5 + n * STATION.itemsize)
    out = pd.DataFrame({name: rows[name].astype(np.int32) for name in ROW.names})
    out.insert(0, "bpuic", np.repeat(stations["bpuic"].astype(np.int32), stations["count"]))
    return out


def pack_shards(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """(delay_set, bucket, data) of shard rows; rows of lines that the table lacks are left out."""
    ship(rows.sparkSession)
    numbered = rows.join(F.broadcast(lines), "line").drop("line").withColumnRenamed("number", "line")

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"delay_set": [key[0]], "bucket": [int(key[1])], "data": [pack_shard(pdf)]})

    return numbered.groupBy("delay_set", "bucket").applyInPandas(pack, "delay_set string, bucket int, data binary")


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """The rows of the shards <folder>/<delay set>/<bucket>.bin.gz, lines as numbers."""
    ship(spark)
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin.gz").option("recursiveFileLookup", "true").load(folder)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                yield unpack_shard(bytes(content)).assign(delay_set=path.rsplit("/", 2)[-2])

    return found.select("path", "content").mapInPandas(read, _STATS)


def _number(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data):
            raise ValueError("the timetable is cut off")
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value & 0xFFFFFFFF, at
        shift += 7


def message_fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field, value) of a protobuf message in order; values are numbers or bytes."""
    at = 0
    while at < len(data):
        tag, at = _number(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _number(data, at)
        elif kind in (1, 2, 5):
            size, at = _number(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            if at + size > len(data):
                raise ValueError("the timetable is cut off")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind} is not known")
        yield tag >> 3, value


def timetable_rows(data: bytes) -> pd.DataFrame:
    """(pattern, trip, seq, n_stops, stop, dep, route_type, line) of a timetable message; unknown fields are passed over."""
    patterns, kinds = [], []
    for field, entry in message_fields(data):
        if field == 2 and isinstance(entry, bytes):
            patterns.append(dict(message_fields(entry)))
        elif field == 3 and isinstance(entry, bytes):
            own = dict(message_fields(entry))
            kind = own.get(1, 0)
            kinds.append((kind if kind <= MOST_ROUTE_TYPE else 0, own.get(2, b"").decode()))
    parts = []
    for number, own in enumerate(patterns):
        stops, times = own.get(3, b""), own.get(1, b"")
        if len(stops) % 4 or len(times) % 4 or (len(times) // 4) % max(len(stops) // 4, 1):
            raise ValueError("a pattern of the timetable is damaged")
        stop = np.frombuffer(stops, "<u4")
        dep = np.frombuffer(times, "<u2").reshape(-1, 2)[:, 1]
        if not len(stop) or not len(dep):
            continue
        trips = len(dep) // len(stop)
        kind, name = kinds[own.get(4, 0)]
        parts.append(pd.DataFrame({"pattern": number, "trip": np.repeat(np.arange(trips), len(stop)), "seq": np.tile(np.arange(1, len(stop) + 1), trips), "n_stops": len(stop), "stop": np.tile(stop, trips).astype(np.int64), "dep": dep.astype(np.int32), "route_type": kind, "line": name}))
    columns = ["pattern", "trip", "seq", "n_stops", "stop", "dep", "route_type", "line"]
    return pd.concat(parts)[columns] if parts else pd.DataFrame({c: [] for c in columns})


def read_timetables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of timetable files with their path; a damaged file is an error."""
    ship(spark)
    found = spark.read.format("binaryFile").load(paths)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in zip(frame["path"], frame["content"]):
                data = bytes(content)
                yield timetable_rows(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).assign(path=path)

    return found.select("path", "content").mapInPandas(read, "path string, pattern int, trip int, seq int, n_stops int, stop bigint, dep int, route_type int, line string")
