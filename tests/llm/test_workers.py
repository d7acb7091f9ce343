"""What is sent to the executors' Python at once."""

import pyarrow as pa
from pyspark.sql import functions as F

from headwind.llm import workers


def _sizes(texts):
    """Rows of each batch that comes to the one task of a table."""

    def run(batches):
        yield pa.RecordBatch.from_pydict({"n": [b.num_rows for b in batches]})

    return [r["n"] for r in workers.mapped(texts, run, "n bigint").collect()]


def _most(spark):
    found = _sizes(spark.range(0, 8000, 1, 1).select(F.repeat(F.lit("word "), 400).alias("text")))
    assert sum(found) == 8000
    return max(found)


def test_batches_are_bounded_in_bytes(spark):
    assert _most(spark) <= workers.SENT_BYTES // 2000 + 1


def test_a_lower_bound_of_the_session_stays(spark):
    spark.conf.set(workers._SENT, "100k")
    try:
        assert _most(spark) <= 60 and spark.conf.get(workers._SENT) == "100k"
    finally:
        spark.conf.unset(workers._SENT)


def test_a_row_of_any_size_is_sent(spark):
    assert _sizes(spark.range(0, 3, 1, 1).select(F.repeat(F.lit("word "), 1_000_000).alias("text"))) == [1, 1, 1]
