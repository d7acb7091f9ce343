"""A feed's large tables are written, read and joined by tasks whose share does not grow with the table."""

import os

import pytest
from pyspark.sql import functions as F

from headwind.operators import timetables
from headwind.plans import fixtures as fx
from headwind.plans.catalogue import QUERIES
from headwind.session import tasks_for
from headwind.sources import files, readers

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_no_task_writes_a_whole_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fx, "LINE_ITEMS_MB", 0.01, raising=False)
    fx.write_feed(spark, SF, str(tmp_path))
    for name in ("stop_times", "trips"):
        folder = tmp_path / f"{name}.txt"
        assert folder.is_dir()
        lines = [p.read_text().splitlines() for p in folder.glob("*.csv")]
        assert len(lines) >= 4 and len({x[0] for x in lines}) == 1
        assert max(map(len, lines)) < sum(map(len, lines)) / 2
    got, times = readers.read_feed(spark, str(tmp_path)), fx.stop_times(spark, SF)
    want = times.select(F.col("trip").cast("string"), F.col("stop").cast("string"), (F.col("seq") * 10).cast("string"))
    assert sorted_rows(got["stop_times"].select("trip_id", "stop_id", "stop_sequence")) == sorted_rows(want)
    assert got["trips"].count() == times.select("trip").distinct().count()


def test_a_table_is_a_file_or_a_folder_of_files(spark, tmp_path):
    (tmp_path / "file.txt").write_text("a,b\n1,2\n")
    folder = tmp_path / "folder.txt"
    folder.mkdir()
    for name, text in (("_SUCCESS", ""), (".part-0.crc", "x"), ("part-0.csv", "a,b\n1,2\n"), ("part-1.csv", "a,b\n3,4\n")):
        (folder / name).write_text(text)
    assert sorted_rows(readers.read_feed_table(spark, str(tmp_path), "file.txt")) == [("1", "2")]
    assert sorted_rows(readers.read_feed_table(spark, str(tmp_path), "folder.txt")) == [("1", "2"), ("3", "4")]
    spark.createDataFrame([], "a int, b int").write.csv(str(tmp_path / "none.txt"), header=True)
    none = readers.read_feed_table(spark, str(tmp_path), "none.txt")
    assert none.columns == ["a", "b"] and none.count() == 0
    (tmp_path / "bare.txt").mkdir()
    with pytest.raises(FileNotFoundError, match="bare.txt"):
        files.first_part(str(tmp_path / "bare.txt"))


def test_tasks_grow_with_the_table(spark):
    path = f"{SF}/lineitem.parquet"
    mb = os.path.getsize(path) / (1 << 20) / 10
    assert [tasks_for(spark.read.parquet(*[path] * k), mb) for k in (1, 2, 6)] == [10, 20, 60]
    assert tasks_for(spark.read.parquet(path), 100) == 1
    assert tasks_for(spark.createDataFrame([(1,)], "a int"), 100) in (1, 4)


@pytest.mark.parametrize("n", [3, 9])
def test_trips_are_joined_by_as_many_tasks_as_they_are_dealt_to(spark, monkeypatch, n):
    want = sorted_rows(QUERIES["feed_times"](spark, SF))
    monkeypatch.setattr(timetables, "tasks_for", lambda table, mb: n, raising=False)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        made = QUERIES["feed_times"](spark, SF)
        assert "SortMergeJoin [trip_id" in made._jdf.queryExecution().executedPlan().toString()
        assert made.rdd.getNumPartitions() == n
        assert sorted_rows(made) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
