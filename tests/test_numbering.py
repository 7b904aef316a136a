import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from rooftop.operators import numbering
from rooftop.operators.numbering import global_row_number
from rooftop.session import materialized


def reference(df, key, tiebreak=()):
    w = Window.orderBy(F.col(key).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in tiebreak])
    return df.withColumn("rn", F.row_number().over(w))


def test_equals_unpartitioned_window_unique_keys(spark):
    keys = random.Random(1).sample(range(10**9), 5000)
    df = spark.createDataFrame([(k, str(k)) for k in keys], "k bigint, v string").repartition(7)
    for per_bucket in (100, 1000, 10**6, 10**9):
        got = sorted(tuple(r) for r in global_row_number(df, "k", rows_per_range=per_bucket).collect())
        want = sorted(tuple(r) for r in reference(df, "k").collect())
        assert got == want


def test_repeats_and_nulls(spark):
    rnd = random.Random(2)
    rows = [(rnd.choice([None, *range(50)]), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "k int, t int")
    got = {tuple(r) for r in global_row_number(df, "k", tiebreak=["t"], rows_per_range=3).collect()}
    want = {tuple(r) for r in reference(df, "k", ["t"]).collect()}
    assert got == want


def test_no_global_window_over_input(spark):
    import re
    df = spark.range(0, 1000).withColumnRenamed("id", "k")
    plan = global_row_number(df, "k")._jdf.queryExecution().executedPlan().toString()
    # the only window is the running sum over the per-partition counts
    assert "row_number()" not in plan
    assert re.search(r"sum\(_n#\d+L?\) windowspecdefinition\(_part#", plan)


def test_no_partition_holds_more_than_its_share(spark, monkeypatch):
    """A far outlier, many NULLs, one value in a third of the rows, and wholly tied rows."""
    rows = [(None,)] * 3000 + [(7,)] * 3000 + [(i,) for i in range(3000)] + [(10**15,)]
    df = spark.createDataFrame(rows, "k bigint").repartition(6)
    placed = []
    monkeypatch.setattr(numbering, "materialized", lambda d, name: placed.append(materialized(d, name)) or placed[-1])
    got = global_row_number(df, "k", rows_per_range=500)
    assert sorted(r.rn for r in got.collect()) == list(range(1, len(rows) + 1))
    ks = [r.k for r in sorted(got.collect(), key=lambda r: r.rn)]
    assert ks == sorted(ks, key=lambda k: (k is not None, k or 0))
    shares = placed[-1].groupBy("_part").count().collect()
    assert len(shares) >= 15 and max(r["count"] for r in shares) < 3 * len(rows) / 19


def test_materialized_input(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k").filter("k % 3 != 0")
    got = sorted(tuple(r) for r in global_row_number(df, "k", materialize=True).collect())
    want = sorted(tuple(r) for r in reference(df, "k").collect())
    assert got == want


def test_range_method_text_keys_and_hot_key(spark):
    rnd = random.Random(3)
    rows = [("hot" if i % 3 == 0 else f"k{rnd.randint(0, 500):04d}", rnd.randint(0, 10**6), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, t bigint, u int").repartition(5)
    got = {tuple(r) for r in global_row_number(df, "k", tiebreak=["t", "u"], rows_per_range=200).collect()}
    want = {tuple(r) for r in reference(df, "k", ["t", "u"]).collect()}
    assert got == want


def test_range_method_on_integral_keys_and_nulls(spark):
    rows = [(None if i % 50 == 0 else i % 97, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "k int, t int")
    got = {tuple(r) for r in global_row_number(df, "k", tiebreak=["t"]).collect()}
    want = {tuple(r) for r in reference(df, "k", ["t"]).collect()}
    assert got == want
