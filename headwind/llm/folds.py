"""Folds by the checksum of an id, and bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, parts: int) -> Column:
    """crc32(doc_id as text) mod parts; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(rows: DataFrame, most: int, key: Column) -> DataFrame:
    """About `most` rows, all if there are no more, chosen by a hash of key: the same rows in every run."""
    n = rows.count()
    if n <= most:
        return rows
    return rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30)) < int(most / n * (1 << 30)))
