from datetime import datetime

import pytest
from pyspark.sql import functions as F

from rooftop.sources import builds
from rooftop.sources.builds import AppendOnceTable, StampedTable
from rooftop.sources.tables import Format

T1, T2, T3 = (datetime(2024, 1, d, 12) for d in (1, 2, 3))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data, schema="v long, k string"):
    return spark.createDataFrame(data, schema)


@pytest.mark.parametrize("literals", [2_000, 0])
def test_newest_complete_build_of_each_value(spark, tmp_dir, monkeypatch, literals):
    monkeypatch.setattr(builds, "MAX_LITERALS", literals)
    t = StampedTable(tmp_dir + "/t", "k")
    first = frame(spark, [(1, "a"), (2, "b"), (3, None), (4, "c d/é=")])
    t.write(first, T1)
    t.write(frame(spark, [(10, "a"), (30, None)]), T2)
    t.write_data(frame(spark, [(99, "b")]), T3)  # no log entry: not there

    def at(when=None):
        return rows(t.read(spark, first.schema, when).select("v", "k", F.date_format("build_datetime", "dd")))
    old = [(1, "a", "01"), (2, "b", "01"), (3, None, "01"), (4, "c d/é=", "01")]
    assert at(T1) == at(datetime(2024, 1, 2)) == old
    assert at(T2) == at() == sorted([(10, "a", "02"), (2, "b", "01"), (30, None, "02"), (4, "c d/é=", "01")], key=str)
    assert at(datetime(2023, 1, 1)) == []


def test_builds_are_pruned_by_partition(spark, tmp_dir):
    t = StampedTable(tmp_dir + "/t", ["k", "j"])
    df = frame(spark, [(1, "a", 1), (2, "b", 2)], "v long, k string, j int")
    t.write(df, T1)
    t.write(frame(spark, [(5, "a", 1)], "v long, k string, j int"), T2)
    read = t.read(spark, df.schema)
    plan = read._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "build_datetime" in filters and "k#" in filters
    assert rows(read.select("v", "k", "j")) == [(2, "b", 2), (5, "a", 1)]
    files = read.select(F.input_file_name()).distinct().count()
    assert files == 2


def test_no_keys_and_csv(spark, tmp_dir):
    t = StampedTable(tmp_dir + "/t", (), Format.CSV)
    df = frame(spark, [(1, "x"), (2, "y")])
    t.write(df, T1)
    t.write(frame(spark, [(3, "z")]), T2)
    assert rows(t.read(spark, df.schema, T1).select("v", "k")) == [(1, "x"), (2, "y")]
    assert rows(t.read(spark, df.schema).select("v", "k")) == [(3, "z")]


def test_a_stamp_is_used_once(spark, tmp_dir):
    t = StampedTable(tmp_dir + "/t", "k")
    t.write(frame(spark, [(1, "a")]), T1)
    with pytest.raises(ValueError, match="has a build"):
        t.write(frame(spark, [(2, "a")]), T1)


@pytest.mark.parametrize("literals", [2_000, 0])
@pytest.mark.parametrize("fmt", [Format.PARQUET, Format.JSON, Format.CSV])
def test_append_once(spark, tmp_dir, monkeypatch, fmt, literals):
    monkeypatch.setattr(builds, "MAX_LITERALS", literals)
    t = AppendOnceTable(tmp_dir + "/t", fmt)
    a, b = frame(spark, [(1, "a")]), frame(spark, [(2, "b"), (3, None)])
    assert rows(t.read(spark, a.schema)) == []
    t.write_data(b, "a1e5")  # a failed attempt
    assert [t.append(a, "one"), t.append(a, "one"), t.append(b, "two/x"), t.append(a, "one")] == [True, False, True, False]
    assert rows(t.read(spark, a.schema)) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(r[0] for r in t.jobs(spark).collect()) == ["one", "two/x"]


def test_two_attempts_at_once_count_once(spark, tmp_dir):
    t = AppendOnceTable(tmp_dir + "/t")
    df = frame(spark, [(1, "a")])
    other = AppendOnceTable(tmp_dir + "/t")
    written = t.write_data

    def slow(frame_, attempt):  # another run of the job ends while this one writes
        written(frame_, attempt)
        assert other.append(df, "job")
    t.write_data = slow
    assert t.append(df, "job") is False
    assert rows(t.read(spark, df.schema)) == [(1, "a")]
