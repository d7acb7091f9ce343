"""Files in any store that pyarrow can open: folders, JSON, first lines, archives. Archives are unpacked in tasks."""

from __future__ import annotations

import gzip
import hashlib
import json
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from headwind.session import ship

# Fixed value: the names of a day's file in a monthly archive.
_DAY_FILE = re.compile(r"(\d{4})-(\d{2})-(\d{2})[_-].*IstDaten.*\.csv$", re.IGNORECASE)
_CHUNK = 1 << 20


def locate(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def exists(path: str) -> bool:
    files, own = locate(path)
    return files.get_file_info(own).type != pafs.FileType.NotFound


def children(path: str) -> list[str]:
    """Names in a folder, in order; none if there is no folder."""
    files, own = locate(path)
    return sorted(x.base_name for x in files.get_file_info(pafs.FileSelector(own, allow_not_found=True)))


def read_bytes(path: str, optional: bool = False) -> bytes | None:
    """A file's bytes, unpacked if they are gzip; None for a missing optional file."""
    if optional and not exists(path):
        return None
    files, own = locate(path)
    with files.open_input_file(own) as f:
        data = f.read()
    return gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data


def read_json(path: str, optional: bool = False) -> dict | None:
    data = read_bytes(path, optional)
    return None if data is None else json.loads(data)


def write_bytes(path: str, data: bytes, pack: bool = False) -> None:
    """Write a file whole: first beside it, then moved over it. Packed bytes are the same for the same data."""
    files, own = locate(path)
    files.create_dir(own.rsplit("/", 1)[0], recursive=True)
    with files.open_output_stream(f"{own}.next", compression=None) as f:
        f.write(gzip.compress(data, 9, mtime=0) if pack else data)
    files.move(f"{own}.next", own)


def write_json(path: str, value: dict) -> None:
    write_bytes(path, json.dumps(value, ensure_ascii=False, sort_keys=True).encode())


def remove(path: str) -> None:
    """Delete a file or a folder; nothing happens if there is none."""
    files, own = locate(path)
    kind = files.get_file_info(own).type
    if kind == pafs.FileType.Directory:
        files.delete_dir(own)
    elif kind == pafs.FileType.File:
        files.delete_file(own)


def first_part(path: str) -> str:
    """The path itself, or the first file that Spark reads in it if it is a folder; a folder without one is an error."""
    files, own = locate(path)
    if files.get_file_info(own).type != pafs.FileType.Directory:
        return path
    parts = [n for n in children(path) if n[0] not in "._"]
    if not parts:
        raise FileNotFoundError(f"{path} has no files")
    return f"{path}/{parts[0]}"


def first_line(path: str) -> str:
    """A text file's first line without a byte order mark and line end; `` for an empty file."""
    files, own = locate(path)
    with files.open_input_stream(own) as f:
        data = f.read(_CHUNK)
    return data.decode("utf-8-sig", "replace").splitlines()[0] if data else ""


def fingerprint(path: str, *more: object) -> str:
    """Changes when a file's size or time changes, or anything else that a result depends on."""
    files, own = locate(path)
    info = files.get_file_info(own)
    return hashlib.sha256(repr((info.size, info.mtime_ns, *more)).encode()).hexdigest()


@dataclass(frozen=True)
class Member:
    archive: str
    name: str
    size: int


def members(archive: str) -> list[Member]:
    """The files in an archive; archives beyond 4 GB too."""
    files, own = locate(archive)
    with files.open_input_file(own) as f, zipfile.ZipFile(f) as z:
        return [Member(archive, x.filename, x.file_size) for x in z.infolist() if not x.is_dir()]


def find_member(found: list[Member], name: str) -> Member | None:
    """The file of that name, at the top or in any folder."""
    return next((m for m in found if m.name == name or m.name.endswith(f"/{name}")), None)


def day_members(found: list[Member]) -> list[tuple[date, Member]]:
    """The stop-event files of an archive by day, in order."""
    out = []
    for m in found:
        if at := _DAY_FILE.search(m.name):
            out.append((date(*map(int, at.groups())), m))
    return sorted(out, key=lambda x: x[0])


def unpack(member: Member, target: str) -> str:
    """Stream a stored or deflated file of an archive to target; other methods are an error."""
    files, own = locate(member.archive)
    out_files, out = locate(target)
    out_files.create_dir(out.rsplit("/", 1)[0], recursive=True)
    part = f"{out}.{uuid.uuid4().hex}.next"  # a task that runs twice writes the same file twice, whole each time
    with files.open_input_file(own) as f, zipfile.ZipFile(f) as z:
        if z.getinfo(member.name).compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            raise ValueError(f"{member.name} is packed by a method that is not supported")
        with z.open(member.name) as source, out_files.open_output_stream(part, compression=None) as sink:
            while piece := source.read(_CHUNK):
                sink.write(piece)
    out_files.move(part, out)
    return target


def unpack_all(spark: SparkSession, wanted: list[tuple[Member, str]]) -> list[str]:
    """Unpack files of archives to their targets, each in a task of its own; returns the targets.

    Archives and targets must lie where all executors reach them. What is sent are names; the driver reads no content.
    """
    if not wanted:
        return []
    ship(spark)
    listed = spark.createDataFrame([(m.archive, m.name, m.size, t) for m, t in wanted], "archive string, name string, size bigint, target string")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"target": [unpack(Member(x.archive, x.name, int(x.size)), x.target) for x in frame.itertuples()]})

    spread = listed.repartitionByRange(min(len(wanted), 10_000), "target")
    return sorted(r["target"] for r in spread.mapInPandas(run, "target string").collect())
