"""Intermediate tables in the shared folder."""

import os

import pytest

from headwind import session


def test_tables_are_kept_until_released(spark):
    session.release(spark)
    made = session.materialize(spark.range(5), "five")
    path = session._made[0].removeprefix("file://")
    assert made.count() == 5 and os.path.isdir(path) and os.path.basename(path).startswith("five-")
    assert session.release(spark) == 1 and not os.path.exists(path) and session.release(spark) == 0


def test_the_named_folder_is_used(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert session.shared_dir(spark) == named.rstrip("/") if named else session.shared_dir(spark).startswith("file://")


def test_settings(spark):
    assert spark.conf.get("spark.sql.session.timeZone") == "UTC" and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_release_keeps_what_is_still_read(spark):
    session.release(spark)
    older = session.materialize(spark.range(3), "older")
    mark = session.made()
    session.materialize(spark.range(4), "between")
    last = session.materialize(spark.range(5), "last")
    assert session.release(spark, mark, keep=last) == 1 and session.made() == mark + 1
    assert last.count() == 5 and older.count() == 3
    session.release(spark)


def test_each_written_table_gives_memory_back(spark, monkeypatch):
    calls, mark = [], session.made()
    monkeypatch.setattr(session, "give_back", calls.append, raising=False)
    assert session.materialize(spark.range(5), "five").count() == 5 and session.release(spark, mark) == 1
    assert calls == [spark]


def test_giving_memory_back_needs_no_trim(spark):
    assert session.give_back(spark) in (True, False)


def test_a_cluster_needs_a_shared_folder(spark):
    class Conf:
        get = staticmethod(lambda key, default=None: None)

    class Far:
        conf = Conf

        class sparkContext:
            master = "spark://far:7077"
            getConf = staticmethod(lambda: Conf)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Far)


def test_other_queries_work_without_the_text_operators(monkeypatch):
    import __spark_entry__ as entry

    def missing(name):
        raise ModuleNotFoundError("No module named 'public_tokenizers'")

    monkeypatch.setattr(entry.importlib, "import_module", missing)
    with pytest.warns(UserWarning, match="public_tokenizers"):
        assert set(entry.queries()) == set(entry.QUERIES)
