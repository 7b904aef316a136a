"""SimHash near-duplicate groups by covering locality-sensitive hashing.

A text's fingerprint has 64 bits: a bit is set if it is set in over half of the
text's shingle hashes.  Two fingerprints are linked at ``radius`` or fewer
differing bits.  Ordinary bit sampling would miss some such pairs; a covering
family misses none: the 64 bit positions get codes in GF(2)^(radius+1), none
of them zero, dealt evenly, and for each non-zero vector v there is one table
whose mask has the positions with <code, v> = 1.  The codes of at most
``radius`` differing positions span at most ``radius`` dimensions, so some v is
orthogonal to all of them, and in v's table the two fingerprints agree on every
masked bit: they share that bucket.  For radius 3 there are 15 tables of 32 to 36 bits.

Copies collapse first (one row per distinct fingerprint), so a group of a
million equal texts is one row.  A bucket holds distinct fingerprints that
agree on the masked bits; it yields a spanning forest of its links, never its
pairs.  Buckets over ``bucket_cap`` fingerprints go by an exact route whose
work is linear in the bucket: a member is sent to every bit string within
floor(radius/2) ("inner") and ceil(radius/2) ("outer") flips of itself in the
unmasked bits.  Linked members meet at such a string, one of them as inner, and
everything meeting an inner member there is connected to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, stash
from .components import components

BITS = 64


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks; any two 64-bit strings within ``radius`` agree on one mask's bits."""
    codes = (1 << (radius + 1)) - 1
    position_code = [1 + i % codes for i in range(BITS)]
    return [sum(1 << i for i in range(BITS) if (position_code[i] & v).bit_count() % 2)
            for v in range(1, codes + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(text: bytes, size: int) -> list[int]:
    """Unsigned XXH64 (seed 42) of each word shingle, repeats included.

    ``bytes.lower`` and ``bytes.split`` fold A-Z and split at 0x20, 0x09-0x0D only.
    """
    words = text.lower().split()
    if not words:
        return []
    if len(words) < size:
        return [xxhash.xxh64_intdigest(b" ".join(words), 42)]
    h, join = xxhash.xxh64_intdigest, b" ".join
    return [h(join(w), 42) for w in zip(*(words[i:] for i in range(size)))]


def fingerprint_of(text: bytes, size: int, block: int = 65_536) -> int:
    """The unsigned 64-bit fingerprint; zero for a text without words."""
    hashes = shingle_hashes(text, size)
    if not hashes:
        return 0
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), block):
        bits = np.unpackbits(np.array(hashes[i:i + block], dtype=">u8").view(np.uint8))
        ones += bits.reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">u8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    """Signed long with the bits of the text's fingerprint (null text: zero)."""

    @F.arrow_udf("long")
    def fingerprints(texts: pa.Array) -> pa.Array:
        raw = texts.cast(pa.binary()).to_pylist()
        return pa.array([_signed(fingerprint_of(t, shingle)) if t else 0 for t in raw], pa.int64())

    return fingerprints(text)


def bucket_forest(members: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Links (from, to) of a spanning forest over all links between the bucket's fingerprints."""
    rest = np.unique(members)
    src: list[int] = []
    dst: list[int] = []
    while rest.size > 1:
        root, rest = rest[0], rest[1:]
        front = np.array([root], dtype=rest.dtype)
        while front.size and rest.size:
            hit = np.zeros(rest.size, dtype=bool)
            for i in range(0, front.size, 64):
                near = np.bitwise_count((front[i:i + 64, None] ^ rest[None, :]).view(np.uint64)) <= radius
                hit |= near.any(axis=0)
            front = rest[hit]
            rest = rest[~hit]
            src.extend([int(root)] * front.size)
            dst.extend(front.tolist())
    return src, dst


def _links_of_buckets(radius: int):
    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            values = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            pairs = starts[ends - starts == 2]
            a, b = values[pairs], values[pairs + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            src, dst = a[near].tolist(), b[near].tolist()
            for s, e in zip(starts, ends):
                if e - s > 2:
                    x, y = bucket_forest(values[s:e], radius)
                    src += x
                    dst += y
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["a", "b"])
    return links


def _flips(free: int, most: int) -> list[int]:
    """Every XOR mask of at most ``most`` of the bits set in ``free``."""
    bits = [1 << i for i in range(BITS) if free >> i & 1]
    return [sum(c) for k in range(most + 1) for c in combinations(bits, k)]


def hot_bucket_links(hot: DataFrame, masks: list[int], radius: int) -> DataFrame:
    """Links of buckets of any size, in work linear in their members: ``hot(t, key, fp)``."""
    inner, outer = radius // 2, radius - radius // 2
    rows = [(t, [(_signed(x), x.bit_count() <= inner) for x in _flips(~m & (2 ** BITS - 1), outer)])
            for t, m in enumerate(masks)]
    # one row per table: its size is fixed by the radius
    flips = F.broadcast(hot.sparkSession.createDataFrame(rows, "t2 int, flips array<struct<x: long, inner: boolean>>"))
    meet = hot.join(flips, F.col("t") == F.col("t2")).select("t", "key", "fp", F.explode("flips").alias("f")) \
        .select("t", "key", F.col("fp"), F.col("fp").bitwiseXOR(F.col("f.x")).alias("z"), F.col("f.inner").alias("inner"))
    # a meeting point has at most as many members as there are flips: the lists are bounded
    at = meet.groupBy("t", "key", "z").agg(
        F.min(F.when(F.col("inner"), F.col("fp"))).alias("a"), F.collect_set("fp").alias("fps"))
    return at.filter(F.col("a").isNotNull() & (F.size("fps") > 1)) \
        .select("a", F.explode("fps").alias("b")).filter(F.col("a") != F.col("b")).distinct()


def fingerprint_links(fps: DataFrame, radius: int = 3, bucket_cap: int = 4096) -> DataFrame:
    """Links (a, b) that connect exactly what the links at ``radius`` or fewer bits connect.

    ``fps(fp)``: distinct signed 64-bit fingerprints.
    """
    masks = covering_masks(radius)
    numbers = F.array(*(F.lit(_signed(m)) for m in masks))
    members = fps.select("fp", F.posexplode(numbers).alias("t", "m")) \
        .select("fp", "t", F.col("fp").bitwiseAND(F.col("m")).alias("key"))
    shared = members.groupBy("t", "key").agg(F.count("*").alias("n")).filter(F.col("n") > 1) \
        .select(F.col("t").alias("t2"), F.col("key").alias("key2"), "n")
    met = stash(members.join(shared, (F.col("t") == F.col("t2")) & (F.col("key") == F.col("key2")))
                .select("t", "key", "fp", "n"), "buckets")
    small = met.filter(F.col("n") <= bucket_cap).groupBy("t", "key") \
        .agg(F.collect_list("fp").alias("fps")).select("fps") \
        .mapInArrow(_links_of_buckets(radius), "a long, b long")
    return small.unionByName(hot_bucket_links(met.filter(F.col("n") > bucket_cap), masks, radius))


def simhash_components(prints: DataFrame, id_col: str, fp_col: str, radius: int = 3,
                       bucket_cap: int = 4096) -> DataFrame:
    """(fp, component_id) for every distinct fingerprint; component_id is the smallest id reachable."""
    fps = prints.groupBy(col(fp_col).alias("fp")).agg(F.min(col(id_col)).alias("first_id"))
    roots = components(fingerprint_links(fps.select("fp"), radius, bucket_cap))
    rooted = fps.join(roots, F.col("fp") == F.col("node"), "left") \
        .select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy(F.col("root").alias("root2")).agg(F.min("first_id").alias("component_id"))
    return rooted.join(least, F.col("root") == F.col("root2")).select("fp", "component_id")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                   radius: int = 3, bucket_cap: int = 4096) -> DataFrame:
    """One row per document: (id, fingerprint as 16 hex digits, component_id).

    Null and empty texts, and texts without words, have fingerprint zero and
    link like any other.  Null ids are never the smallest unless the whole
    component has none (component_id is then null).  Repeated rows stay and
    share a component.  Other columns are ignored; an empty table gives an
    empty result.
    """
    prints = stash(docs.select(col(id_col).alias("id"), fingerprint(col(text_col), shingle).alias("p")), "prints")
    comp = simhash_components(prints, "id", "p", radius, bucket_cap)
    return prints.join(comp, F.col("p") == F.col("fp")).select(
        F.col("id").alias(id_col),
        F.lpad(F.lower(F.hex("p")), 16, "0").alias("fingerprint"),
        "component_id")


# Up to so many keys of removed rows (16 bytes each) are sent to the scan; beyond, they are joined.
BROADCAST_KEYS = 2_000_000


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                       radius: int = 3, bucket_cap: int = 4096) -> DataFrame:
    """The rows of ``docs`` less near copies: of each component the row with the smallest id stays.

    Ties (repeated ids) go to the smallest content hash, null ids come last; of
    rows equal in id and text the one with the smallest hash of all its columns
    (but maps) stays.  All columns are kept as they are.  Texts are not shuffled: what moves
    are the keys of the rows that go, sent to the scan where they are few enough.
    """
    names = docs.columns
    key, key2, order = fresh(names, "_row"), fresh(names, "_row2"), fresh(names, "_order")
    text = F.coalesce(col(text_col), F.lit(""))
    keys = (F.xxhash64(F.lit(1), col(id_col), text, F.length(text)), F.xxhash64(F.lit(2), text, col(id_col)))
    prints = stash(docs.select(col(id_col).alias("id"), keys[0].alias("k1"), keys[1].alias("k2"),
                               fingerprint(col(text_col), shingle).alias("p")), "prints")
    fps = prints.groupBy("p").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "k1", "k2")).alias("best"))
    fps = fps.withColumnRenamed("p", "fp")
    roots = components(fingerprint_links(fps.select("fp"), radius, bucket_cap))
    best = fps.join(roots, F.col("fp") == F.col("node"), "left") \
        .groupBy(F.coalesce("root", "fp").alias("r")).agg(F.min("best").alias("best"))
    keep = best.select(F.col("best.k1").alias("k1"), F.col("best.k2").alias("k2"))
    rows = prints.groupBy("k1", "k2").agg(F.count("*").alias("n"))
    gone = stash(rows.join(keep, ["k1", "k2"], "left_anti").select(F.col("k1").alias("g1"), F.col("k2").alias("g2")), "gone")
    repeated = stash(rows.filter("n > 1").join(keep, ["k1", "k2"], "left_semi")
                     .select(F.col("k1").alias("r1"), F.col("k2").alias("r2")), "repeated")

    def sent(df: DataFrame) -> tuple[DataFrame, int]:
        n = df.count()
        return (F.broadcast(df) if n <= BROADCAST_KEYS else df), n

    keyed = docs.withColumns({key: keys[0], key2: keys[1]})
    gone, _ = sent(gone)
    out = keyed.join(gone, (F.col(key) == F.col("g1")) & (F.col(key2) == F.col("g2")), "left_anti")
    repeated, n = sent(repeated)
    if not n:
        return out.select(*(col(c) for c in names))
    hashed = [col(f.name) for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]  # maps have no hash
    same = (F.col(key) == F.col("r1")) & (F.col(key2) == F.col("r2"))
    # of wholly repeated rows one: only these are numbered
    first = W.partitionBy(key, key2).orderBy(order)
    one = keyed.join(repeated, same, "left_semi").withColumn(order, F.xxhash64(*hashed)) \
        .withColumn(order, F.row_number().over(first)).filter(F.col(order) == 1)
    return out.join(repeated, same, "left_anti").select(*(col(c) for c in names)) \
        .unionByName(one.select(*(col(c) for c in names)))
