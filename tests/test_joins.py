from contextlib import contextmanager

from rooftop.operators.addresses import latest_addresses
from rooftop.plans.joins import join_dimension

from .test_addresses import frames, rows


def test_salted_join_equals_plain_join_with_hot_key(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i % 7}") for i in range(3000)] + [(-1, "nokey")],
                                "id bigint, k string")
    dim = spark.createDataFrame([("hot", 1.5)] + [(f"k{j}", float(j)) for j in range(7)], "k string, v double")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(dim, "k", how).select("id", "k", "v").collect()), key=repr)
        for kw in ({"strategy": "uniform", "salt_buckets": 8}, {"strategy": "salted", "rows_per_task": 100},
                   {"strategy": "salted", "rows_per_task": 10**9}):
            salted = join_dimension(big, dim, "k", how, **kw)
            assert "_salt" not in salted.columns
            assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=repr) == plain
        auto = join_dimension(big, dim, "k", how)
        assert sorted(map(tuple, auto.select("id", "k", "v").collect()), key=repr) == plain


def test_addresses_same_result_without_broadcast(spark):
    e, b, m = frames(spark)
    want = rows(latest_addresses(e, b, m))
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}):
        assert rows(latest_addresses(e, b, m)) == want


@contextmanager
def conf(spark, settings):
    prev = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in prev.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_flagship_filters_the_city_first_and_moves_entrances_once(spark):
    from rooftop.plans.queries import QUERIES
    with conf(spark, {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}):
        plan = QUERIES["address_latest"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    depth = lambda x: len(x) - len(x.lstrip(" +-:"))
    top = next(i for i, x in enumerate(lines) if "SortMergeJoin [propertyRegistrationNumberIdentifier" in x)
    city = next(i for i, x in enumerate(lines) if "Contains(lower(" in x)
    assert city > top and depth(lines[city]) > depth(lines[top])
    # above the join of the entrances there is no exchange: its partitioning serves the last reduction
    assert not any("Exchange" in x for x in lines[:top])
    scan = next(i for i, x in enumerate(lines) if "FileScan" in x and "o_orderstatus" in x and "o_orderpriority" in x)
    assert sum("Exchange" in x for x in lines[top:scan]) == 1


def test_adaptive_salting_spreads_hot_key(spark):
    from pyspark.sql import functions as F
    big = spark.createDataFrame([(i, "hot" if i % 10 else "cold") for i in range(5000)], "id bigint, k string")
    dim = spark.createDataFrame([("hot", 1.0), ("cold", 2.0)], "k string, v double")
    j = join_dimension(big, dim, "k", "inner", strategy="salted", rows_per_task=500)
    # the hot key (4500 rows) is cut into ceil(4500/500) = 9 salted groups.
    # On data this small AQE would merge the partitions or broadcast a side at
    # run time, so look at the shuffle layout with both turned off.
    with conf(spark, {"spark.sql.adaptive.coalescePartitions.enabled": "false",
                      "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
                      "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        per_task = (j.withColumn("p", F.spark_partition_id()).groupBy("p", "k").count()
                    .filter("k = 'hot'").collect())
    assert j.count() == 5000
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 4500


def test_cluster_conf():
    from rooftop.session import cluster_conf
    c = cluster_conf(100 * 10**12)
    assert c["spark.sql.shuffle.partitions"] == str(-(-100 * 10**12 // (256 << 20)))
    assert cluster_conf(10 * 2**30)["spark.sql.shuffle.partitions"] == "40"
    assert cluster_conf(1)["spark.sql.shuffle.partitions"] == "1"


def test_salted_join_with_hot_null_key(spark):
    big = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(2000)], "id bigint, k string")
    dim = spark.createDataFrame([("a", 1.0), (None, 9.0)], "k string, v double")
    for how in ("inner", "left"):
        plain = sorted(map(tuple, big.join(dim, "k", how).select("id", "k", "v").collect()), key=repr)
        salted = join_dimension(big, dim, "k", how, strategy="salted", rows_per_task=100)
        assert sorted(map(tuple, salted.select("id", "k", "v").collect()), key=repr) == plain


def test_null_keys_of_a_left_join_are_spread(spark):
    from pyspark.sql import functions as F
    big = spark.createDataFrame([(i, None) for i in range(4000)], "id bigint, k string")
    dim = spark.createDataFrame([("a", 1.0)], "k string, v double")
    with conf(spark, {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}):
        j = join_dimension(big, dim, "k", "left", strategy="salted")
        per_task = j.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in per_task) == 4000 and max(r["count"] for r in per_task) < 2000
