import os
from collections import Counter

import numpy as np
import pytest

from rooftop.llm import sharding as S

from .conftest import SF, with_clashes


def check(rows, shards, total):
    sizes = Counter(r.shard for r in rows)
    counts = [sizes.get(s, 0) for s in range(shards)]
    assert sum(counts) == total and max(counts) - min(counts) <= 1 and counts == sorted(counts, reverse=True)
    for s in sizes:
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))


@pytest.mark.parametrize("buckets", [1, 7, 64])
def test_shards_are_even_and_gapless(spark, buckets):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = S.external_shuffle(docs, 7, buckets=buckets).collect()
    check(rows, 7, docs.count())
    assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in docs.collect())


def test_same_result_for_any_partitioning_and_another_for_another_seed(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    def places(df, seed=42):
        return {r.doc_id: (r.shard, r.slot) for r in S.external_shuffle(df, 5, seed=seed, buckets=6).collect()}

    a = places(docs)
    assert a == places(docs.repartition(13)) == places(docs.orderBy("text"))
    assert a != places(docs, seed=1)


def test_order_is_shuffled(spark):
    rows = S.external_shuffle(spark.range(20_000).selectExpr("id AS doc_id", "'x' AS text"), 4, buckets=9).collect()
    order = np.array([r.doc_id for r in sorted(rows, key=lambda r: (r.shard, r.slot))], dtype=float)
    assert abs(np.corrcoef(order, np.arange(order.size))[0, 1]) < 0.03
    in_shard = Counter((r.shard, r.doc_id // 5000) for r in rows)
    assert all(abs(n - 1250) < 200 for n in in_shard.values())


def test_fisher_yates_is_uniform():
    seen = Counter(tuple(S.fisher_yates(3, s, 0)) for s in range(6000))
    assert len(seen) == 6 and all(abs(n - 1000) < 150 for n in seen.values())


def test_odd_rows_few_rows_and_empty_tables(spark, odd, empty):
    wide = with_clashes(odd)
    got = S.external_shuffle(wide, 40, buckets=3)
    assert got.columns == [*wide.columns, "shard_", "slot_"]
    check(got.selectExpr("shard_ AS shard", "slot_ AS slot").collect(), 40, odd.count())
    assert S.external_shuffle(empty, 40).count() == 0


def test_written_shards_hold_their_rows_in_order(spark, tmp_dir):
    docs = spark.range(1000).selectExpr("id AS doc_id", "'t' AS text")
    sharded = S.external_shuffle(docs, 4, buckets=5)
    S.write_shards(sharded, os.path.join(tmp_dir, "out"))
    back = spark.read.parquet(os.path.join(tmp_dir, "out"))
    assert {(r.doc_id, r.shard, r.slot) for r in back.collect()} == \
        {(r.doc_id, r.shard, r.slot) for r in sharded.collect()}
    for s in range(4):
        for part in {r[0] for r in back.filter(f"shard = {s}").selectExpr("input_file_name()").distinct().collect()}:
            slots = [r.slot for r in spark.read.parquet(part).collect()]
            assert slots == sorted(slots)


def test_against_a_plain_replay(spark):
    """Scatter, the order in a bucket, its permutation, the buckets end to end and the cut into shards, in plain lists."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    for buckets, shards, seed in ((5, 7, 42), (1, 300, 3), (40, 2, 42)):
        content = F.xxhash64("doc_id", "text")
        rows = docs.select("doc_id", content.alias("c"), F.pmod(F.xxhash64(F.lit(seed), content), F.lit(buckets)).alias("b")).collect()
        order = []
        for b in range(buckets):
            own = sorted((r.c, r.doc_id) for r in rows if r.b == b)
            places = list(range(len(own)))
            np.random.Generator(np.random.PCG64([seed, b])).shuffle(places)
            out = [None] * len(own)
            for (_, doc), p in zip(own, places):
                out[p] = doc
            order += out
        want, small, more, at = {}, *divmod(len(order), shards), 0
        for s in range(shards):
            for slot in range(small + (s < more)):
                want[order[at]] = (s, slot)
                at += 1
        got = {r.doc_id: (r.shard, r.slot) for r in S.external_shuffle(docs, shards, seed=seed, buckets=buckets).collect()}
        assert got == want
