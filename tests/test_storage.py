"""Intermediate tables."""

import threading

import pytest

from lodestrata import storage
from lodestrata.storage import cleanup, drop_table, materialize, scratch, spread


def test_tables_are_written_dropped_and_cleaned(spark):
    cleanup(spark)
    a, b = materialize(spark.range(5), "a"), materialize(spark.range(0), "b")
    assert a.count() == 5 and b.count() == 0
    drop_table(a, b)
    with pytest.raises(Exception):  # noqa: B017
        a.count()
    materialize(spark.range(3), "c")
    assert cleanup(spark) == 1 and cleanup(spark) == 0


def test_spread_leaves_many_files_alone(spark, tmp_path):
    spark.range(100).repartition(8).write.parquet(str(tmp_path / "x"))
    df = spark.read.parquet(str(tmp_path / "x"))
    assert "RoundRobin" not in spread(df)._jdf.queryExecution().toString()
    one = spark.read.parquet(df.inputFiles()[0])
    assert "RoundRobin" in spread(one)._jdf.queryExecution().toString()


def test_a_scope_leaves_other_threads_tables_alone(spark):
    """A search during a build: the build's end drops the build's tables only."""
    cleanup(spark)
    begun, ended, seen = threading.Event(), threading.Event(), {}

    def search():
        with scratch(spark):
            held = materialize(spark.range(7), "search")
            begun.set()
            ended.wait(60)
            seen["rows"] = held.count()

    with scratch(spark):
        other = threading.Thread(target=search)
        other.start()
        begun.wait(60)
        built = materialize(spark.range(3), "build")
        with scratch(spark):
            inner = materialize(spark.range(4), "inner")
        with pytest.raises(Exception):  # noqa: B017
            inner.count()
        assert built.count() == 3
    ended.set()
    other.join()
    assert seen == {"rows": 7} and not storage._written


def test_lookups_leave_nothing_behind(spark, tmp_path):
    from lodestrata.engine import CodeIndex
    from lodestrata.sources.index import build_index
    from lodestrata.tools import AgentTools

    (tmp_path / "a.py").write_text("def f():\n    return g()\n\n\ndef g():\n    return 1\n")
    build_index(spark, str(tmp_path))
    cleanup(spark)
    tools = AgentTools(spark, str(tmp_path))
    assert tools.find_callers("g")[0]["symbol"] == "f" and tools.impact_analysis("g") and tools.find_symbol("f")
    assert CodeIndex(spark, str(tmp_path)).search("f")
    assert not storage._written
