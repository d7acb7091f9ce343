"""Extraction as a stream of files: every new stop-event file is parsed once, by the reader and the plan of the batch.

The stream is one of paths alone. Each micro-batch reads its files by their own headers, so files may order their columns
differently. The rows are stateless, so no watermark is needed; a trigger of what is available makes it an incremental
batch job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from headwind.operators.observations import extract_observations
from headwind.sources import files, readers

#: Files of a micro-batch: their paths are all that reaches the driver.
FILES = 1_000


def extract_stream(spark: SparkSession, folder: str, names: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Parse the files of folder that have not been parsed yet; returns the running query.

    Every file must have the columns names and those that a stop event needs, in any order. target is partitioned by
    micro-batch and service day; a micro-batch that is run again replaces what it wrote, so rows come once.
    """
    paths = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("maxFilesPerTrigger", FILES).option("recursiveFileLookup", True).load(folder).select("path")

    def add(found: DataFrame, batch: int) -> None:
        own = sorted(r["path"] for r in found.collect())
        for path in own:
            lacking = [n for n in names if n not in readers.header(files.first_line(path))]
            if lacking:
                raise ValueError(f"{path} lacks the columns {', '.join(lacking)}")
        rows = extract_observations(readers.read_stop_events(found.sparkSession, own))
        rows.write.mode("overwrite").partitionBy("service_day").parquet(f"{target}/batch={batch}")

    return paths.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
