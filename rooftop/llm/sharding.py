"""Sharding by a two-pass external shuffle.

Pass one scatters the records into buckets by a seeded hash of their content,
so that a bucket is a uniform random part of the input, sized for one task's
memory.  Pass two permutes each bucket by Fisher-Yates and lays the buckets end
to end: bucket b's records take the positions after those of the buckets before
it, in their permuted order.  The whole order is a uniform shuffle; cutting it
into equal runs gives shards whose row counts differ by at most one, and every
bucket's records fall into one run or a few neighbouring ones, so each task
writes its part of the shards straight from its bucket.

Only the permutation (8 bytes a record) is held in memory.  Records stream past
it in Arrow batches, ordered by content, so a task that is run again draws the
same positions, and the sorts around it spill to disk.  Bucket sizes are a
table of at most ``max_buckets`` rows, counted beforehand; when an input is so
large that its buckets would be more, buckets grow and stream all the same.
Records that are equal in every column fall into one bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 16
RECORD_BYTES = 16  # counted for each record besides its text


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus the record's own share."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("long")


def bucket_count(docs: DataFrame, text_col: str, bucket_bytes: int = BUCKET_BYTES,
                 max_buckets: int = MAX_BUCKETS) -> int:
    total = docs.agg(F.sum(record_size(col(text_col)))).first()[0] or 0
    return int(min(max_buckets, max(1, -(-total // bucket_bytes))))


def fisher_yates(size: int, seed: int, bucket: int) -> np.ndarray:
    """The new place of each of ``size`` records; numpy shuffles an array by Fisher-Yates."""
    places = np.arange(size, dtype=np.int64)
    np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(places)
    return places


def _permuter(sizes: dict[int, tuple[int, int]], seed: int, bucket_name: str, place_name: str):
    """Streams records ordered by bucket and gives each its position in the whole order."""

    def permute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, at, places = None, 0, np.zeros(0, dtype=np.int64)
        for batch in batches:
            buckets = batch.column(bucket_name).to_numpy(zero_copy_only=False)
            out = np.empty(buckets.size, dtype=np.int64)
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(buckets)) + 1, [buckets.size]])
            for s, e in zip(cuts[:-1], cuts[1:]):
                if s == e:
                    continue
                if buckets[s] != now:
                    now, at = int(buckets[s]), 0
                    size, offset = sizes[now]
                    places = fisher_yates(size, seed, now) + offset
                out[s:e] = places[at:at + e - s]
                at += e - s
            arrays = [pa.array(out) if n == place_name else batch.column(n) for n in batch.schema.names]
            yield pa.RecordBatch.from_arrays(arrays, batch.schema.names)
    return permute


def external_shuffle(docs: DataFrame, shards: int, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                     shard_col: str = "shard", slot_col: str = "slot", buckets: int | None = None,
                     bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``docs`` with a shard (int) and a slot (long, gapless from 0 in its shard) for every row.

    The first rows-modulo-shards shards have one row more than the others.
    Partitions of the result hold whole buckets ordered by shard and slot.
    Null ids and texts are hashed as such; repeated rows each get a slot; an
    empty table gives no rows; with fewer rows than shards the last ones stay empty.
    All other columns are kept, the two new ones come last (with underscores
    appended to their names while the input has such columns).
    """
    names = docs.columns
    shard_col = fresh(names, shard_col)
    slot_col = fresh(names, slot_col)
    n_buckets = buckets or bucket_count(docs, text_col, bucket_bytes)
    content = F.xxhash64(col(id_col), col(text_col))
    placed_in = F.pmod(F.xxhash64(F.lit(seed), content), F.lit(n_buckets)).cast("int")
    counts = {r["b"]: r["n"] for r in docs.groupBy(placed_in.alias("b")).agg(F.count("*").alias("n")).collect()}
    total = 0
    sizes: dict[int, tuple[int, int]] = {}
    for b in sorted(counts):
        sizes[b] = (counts[b], total)
        total += counts[b]

    # plain names on the way: a record's own columns may be called anything
    plain = [f"c{i}" for i in range(len(names))]
    bucket, place, tie = "b", "p", "t"
    rows = docs.select(placed_in.alias(bucket), content.alias(tie), F.lit(0).cast("long").alias(place),
                       *(col(c).alias(p) for c, p in zip(names, plain)))
    sortable = [p for p, f in zip(plain, docs.schema.fields) if f.dataType.simpleString() in _ORDERED]
    scattered = rows.repartitionById(n_buckets, F.col(bucket)).sortWithinPartitions(bucket, tie, *sortable)
    shuffled = scattered.mapInArrow(_permuter(sizes, seed, bucket, place), scattered.schema)

    small, more = divmod(total, shards)
    edge = more * (small + 1)  # rows in the larger shards, which come first
    p = F.col(place)
    in_rest = (F.lit(more) + F.floor((p - edge) / max(small, 1))).cast("int")
    shard = F.when(p < edge, F.floor(p / (small + 1)).cast("int")).otherwise(in_rest)
    slot = F.when(p < edge, p % (small + 1)).otherwise((p - edge) % max(small, 1))
    # the order of the places, by the columns that a writer of shard folders looks at
    return shuffled.select(*(F.col(p).alias(c) for c, p in zip(names, plain)), shard.alias(shard_col),
                           slot.cast("long").alias(slot_col)).sortWithinPartitions(shard_col, slot_col)


_ORDERED = {"tinyint", "smallint", "int", "bigint", "string", "float", "double", "boolean", "date", "timestamp"}


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard") -> None:
    """Write one folder per shard; each task appends its buckets' runs, in their shuffled order."""
    sharded.write.partitionBy(shard_col).parquet(path)
