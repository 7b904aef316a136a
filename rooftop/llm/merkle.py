"""Merkle manifest of a table: leaves, subroots per group, one root, and a proof for every row.

A row's leaf is the SHA-256 of its columns, each ``-`` if null, else its UTF-8
byte count, a colon and its value.  The leaves of a group stand in the given
order; while a group has several nodes, every ``ARITY`` consecutive ones become
their hash (of the digests as hex text; a last run may be shorter, even of one
node), up to the group's subroot.  The subroots, in the order of the groups (null
first, bytewise), are the leaves of one more such tree, whose root is the table's.

Storage (van Emde Boas layout)
------------------------------
The nodes are kept in *blocks*: aligned subtrees of ``HEIGHT`` levels above
``ARITY ** HEIGHT`` leaves.  A block is one array of digests, in which the
subtree is split at half its height, the upper part first, then each lower one,
all split again in the same way.  ``address`` gives a node's place from its depth
and index alone; building a block and reading a leaf's siblings both use it.
The block roots are the leaves of the next table of blocks, and so on until a
group has one block.  Then proofs are made downwards: a block's path to the root
is the same for all its leaves.

Scale: texts are read once and only digests move on.  Leaves are numbered by
range partitions, so a group with most of the rows is spread; a task holds one
block at a time.  Every table of blocks is written to the shared folder.

Defined results: rows with equal order keys stand in the order of their leaves
(equal leaves are interchangeable); null keys come first; an empty table has no
rows and no root; only the named columns count, others pass unread.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from .common import col, stash

ARITY = 8
HEIGHT = 4
DIGEST = 32
ROWS_PER_RANGE = 250_000
_LOCAL_BITS = (1 << 33) - 1


# -- addresses and blocks -----------------------------------------------------
def tree_size(levels: int) -> int:
    """Nodes of a complete subtree with this many levels of nodes."""
    return (ARITY ** levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Places of the nodes ``index`` of a depth in the layout of a subtree with ``levels`` levels of nodes."""
    index = np.asarray(index, dtype=np.int64)
    if levels == 1:
        return np.zeros_like(index)
    top = levels // 2
    if depth < top:
        return address(top, depth, index)
    bottom, below = levels - top, depth - top
    tree, inside = np.divmod(index, ARITY ** below)
    return tree_size(top) + tree * tree_size(bottom) + address(bottom, below, inside)


def parent(digests: bytes) -> bytes:
    """The hash of a run of digests (as hex text)."""
    return hashlib.sha256(digests.hex().encode()).digest()


def levels_above(count: int) -> int:
    """Levels of hashing until ``count`` nodes are one."""
    n = 0
    while count > 1:
        count, n = -(-count // ARITY), n + 1
    return n


def build_block(leaves: bytes, edges: int) -> bytes:
    """The layout of the block over ``leaves`` (joined digests), ``edges`` levels of hashing high."""
    level, placed, end = leaves, [], 0
    for depth in range(edges, -1, -1):
        n = len(level) // DIGEST
        at = address(edges + 1, depth, np.arange(n))
        placed.append((at, np.frombuffer(level, np.uint8).reshape(n, DIGEST)))
        end = max(end, int(at.max()) + 1)
        if depth:
            run = ARITY * DIGEST
            level = b"".join(parent(level[i:i + run]) for i in range(0, len(level), run))
    store = np.zeros((end, DIGEST), np.uint8)
    for at, nodes in placed:
        store[at] = nodes
    return store.tobytes()


def block_paths(store: bytes, edges: int, count: int) -> tuple[list[bytes], list[bytes]]:
    """For each leaf of a block: (place in the run, length of the run) level by level, and the siblings."""
    nodes = np.frombuffer(store, np.uint8).reshape(-1, DIGEST)
    sides, siblings = [b""] * count, [b""] * count
    at = np.arange(count)  # index of each leaf's ancestor at the depth
    for depth in range(edges, 0, -1):
        n = -(-count // ARITY ** (edges - depth))
        level = nodes[address(edges + 1, depth, np.arange(n))].tobytes()
        for leaf in range(count):
            first, place = divmod(int(at[leaf]), ARITY)
            run = level[first * ARITY * DIGEST:(first + 1) * ARITY * DIGEST]
            sides[leaf] += bytes((place, len(run) // DIGEST))
            siblings[leaf] += run[:place * DIGEST] + run[(place + 1) * DIGEST:]
        at = at // ARITY
    return sides, siblings


def fold_path(leaf: bytes, sides: bytes, siblings: bytes) -> bytes:
    """The root that a leaf and its proof give."""
    node, at = leaf, 0
    for i in range(0, len(sides), 2):
        place, run = sides[i], sides[i + 1]
        others = siblings[at:at + (run - 1) * DIGEST]
        at += len(others)
        node = parent(others[:place * DIGEST] + node + others[place * DIGEST:])
    return node


@pandas_udf(T.BinaryType())
def fold(leaf: pd.Series, sides: pd.Series, siblings: pd.Series) -> pd.Series:
    """``fold_path`` over columns."""
    return pd.Series([None if x is None else fold_path(x, s, o) for x, s, o in zip(leaf, sides, siblings)], dtype=object)


# -- leaves -------------------------------------------------------------------
def field_text(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(columns: Sequence[Column]) -> Column:
    """The digest of a row's columns, as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field_text(c) for c in columns]), 256))


def numbered(df: DataFrame, group: str, order: Sequence[str], rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Add ``pos`` (from 0) and ``total`` within each ``group``, in ``order``, by range partitions.

    The partitions cut the whole order (last the row's place in the input), so
    neither a large group nor rows equal in all of it meet in one task.
    """
    parts = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(df.count() / rows_per_range))
    by = [F.col(c).asc_nulls_first() for c in (group, *order)]
    place = F.monotonically_increasing_id()
    ranged = stash(
        df.withColumn("_place", place).repartitionByRange(parts, *by, "_place").sortWithinPartitions(*by, "_place")
        .drop("_place")
        .select("*", F.spark_partition_id().alias("_part"), place.bitwiseAND(F.lit(_LOCAL_BITS)).alias("_at")), "ranged")
    # a row for each group and partition that has it: groups + partitions at most
    runs = ranged.groupBy("_part", group).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(group)
    before = whole.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("_part", group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_shift"),
                       F.sum("_n").over(whole).alias("total"))
    return ranged.join(runs, ["_part", group]).withColumn("pos", F.col("_at") + F.col("_shift")) \
        .drop("_part", "_at", "_shift")


# -- trees of blocks ----------------------------------------------------------
_BLOCK = T.StructType([
    T.StructField("tree", T.StringType()), T.StructField("block", T.LongType()), T.StructField("total", T.LongType()),
    T.StructField("edges", T.IntegerType()), T.StructField("count", T.IntegerType()),
    T.StructField("top", T.BinaryType()), T.StructField("store", T.BinaryType())])


def _blocks(leaves: DataFrame, height: int) -> DataFrame:
    """One row per block of the leaves (tree, pos, total, digest)."""
    width = ARITY ** height

    def build(key, table):
        digests = table.sort_by("pos")["digest"].to_pylist()
        total = table["total"][0].as_py()
        edges = height if total > width else levels_above(total)
        store = build_block(b"".join(digests), edges)
        return pa.table([pa.array([x], t) for x, t in (
            (key[0].as_py(), pa.string()), (key[1].as_py(), pa.int64()), (total, pa.int64()), (edges, pa.int32()),
            (len(digests), pa.int32()), (store[:DIGEST], pa.binary()), (store, pa.binary()))],
            names=_BLOCK.fieldNames())

    return leaves.select("tree", F.floor(F.col("pos") / F.lit(width)).alias("block"), "pos", "total", "digest") \
        .groupBy("tree", "block").applyInArrow(build, _BLOCK)


def _raise(leaves: DataFrame, height: int) -> list[tuple[DataFrame, DataFrame]]:
    """Tables of leaves and their blocks, level by level, until every tree has one block."""
    width, levels = ARITY ** height, []
    while True:
        blocks = stash(_blocks(leaves, height), "merkle-blocks")
        levels.append((leaves, blocks))
        most = blocks.agg(F.max("total")).first()[0]
        if most is None or most <= width:
            return levels
        leaves = blocks.filter(F.col("total") > width).select(
            "tree", F.col("block").alias("pos"), F.ceil(F.col("total") / F.lit(width)).alias("total"),
            F.col("top").alias("digest"))


def _tops(levels: list[tuple[DataFrame, DataFrame]], height: int) -> DataFrame:
    """tree, top: the root of every tree."""
    done = [b.filter(F.col("total") <= ARITY ** height).select("tree", "top") for _, b in levels]
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def _descend(levels: list[tuple[DataFrame, DataFrame]], above: DataFrame, height: int) -> DataFrame:
    """The rows of the lowest leaves with ``sides`` and ``siblings`` up to the root.

    ``above``: tree, sides, siblings from the tree's root on, and columns to hand down.
    """
    width, paths = ARITY ** height, None
    handed = [c for c in above.columns if c not in ("tree", "sides", "siblings")]
    for leaves, blocks in reversed(levels):
        stored = blocks.select("tree", "block", "edges", "count", "store", "total")
        upper = stored.filter(F.col("total") <= width).join(above, "tree")
        if paths is not None:
            own = paths.select("tree", F.col("pos").alias("block"), "sides", "siblings", *handed)
            upper = upper.unionByName(stored.filter(F.col("total") > width).join(own, ["tree", "block"]))
        kept = [f for f in leaves.schema.fields if f.name not in ("total",)]
        names = [f.name for f in kept]
        down = [above.schema[c] for c in handed]
        schema = T.StructType([*kept, T.StructField("sides", T.BinaryType()), T.StructField("siblings", T.BinaryType()),
                               *down])
        left = leaves.select(*names, F.floor(F.col("pos") / F.lit(width)).alias("block"))
        paths = left.groupBy("tree", "block").cogroup(
            upper.select("tree", "block", "edges", "count", "store", "sides", "siblings", *handed)
            .groupBy("tree", "block")).applyInArrow(_prover(names, handed), schema)
    return paths


def _prover(names: Sequence[str], handed: Sequence[str]):
    """Adds the paths to the leaves of one block."""
    def prove(rows, block):
        rows = rows.sort_by("pos").select(names)
        if not rows.num_rows or not block.num_rows:
            raise ValueError("a block without its leaves")
        get = {c: block[c][0].as_py() for c in ("store", "edges", "count", "sides", "siblings")}
        sides, siblings = block_paths(get["store"], get["edges"], get["count"])
        for name, values in (("sides", [x + get["sides"] for x in sides]),
                             ("siblings", [x + get["siblings"] for x in siblings])):
            rows = rows.append_column(name, pa.array(values, pa.binary()))
        for c in handed:
            rows = rows.append_column(c, pa.array([block[c][0].as_py()] * rows.num_rows, block.schema.field(c).type))
        return rows
    return prove


@dataclass(frozen=True)
class Manifest:
    """Tables of blocks of the groups' trees and of the tree over their subroots."""

    levels: list
    outer: list
    height: int

    def subroots(self) -> DataFrame:
        """tree (the group's key: empty for null, else ``=`` and its text), top (its subroot)."""
        return _tops(self.levels, self.height)

    def root(self) -> DataFrame:
        """One row with the table's root (none for an empty table)."""
        return _tops(self.outer, self.height).select(F.col("top").alias("root"))


def manifest(df: DataFrame, columns: Sequence[str], group: str, order: str,
             carry: Mapping[str, Column] | None = None, height: int = HEIGHT) -> Manifest:
    """Hash the rows of ``df`` over ``columns`` and build the blocks (see module doc).

    ``carry``: columns of the rows that the proofs are to hold beside them
    (of any type, by names other than the manifest's own).
    """
    carry = carry or {}
    key = F.coalesce(F.concat(F.lit("="), col(group).cast("string")), F.lit(""))
    leaves = stash(df.select(
        key.alias("tree"), col(order).alias("key"), leaf_hash([col(c) for c in columns]).alias("digest"),
        *[v.alias(f"carry_{k}") for k, v in carry.items()]), "merkle-leaves")
    placed = stash(numbered(leaves, "tree", ["key", "digest"]), "merkle-placed")
    levels = _raise(placed, height)
    tops = stash(_tops(levels, height).withColumnRenamed("top", "digest"), "merkle-subroots")
    outer = numbered(tops.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), "tree", ["name"])
    return Manifest(levels, _raise(stash(outer, "merkle-outer"), height), height)


def proofs(made: Manifest) -> DataFrame:
    """A proof for every row: key, leaf, subroot, root, sides, siblings, and the carried columns.

    ``siblings`` are the other digests of each run on the way up, from left to
    right; ``sides`` has two bytes a level: the node's place in its run and the
    run's length.  ``fold`` recomputes the root from them.
    """
    top = _tops(made.outer, made.height).select(
        "tree", F.lit(b"").alias("sides"), F.lit(b"").alias("siblings"), F.col("top").alias("root"))
    subroots = _descend(made.outer, top, made.height).select(
        F.col("name").alias("tree"), "sides", "siblings", "root", F.col("digest").alias("subroot"))
    paths = _descend(made.levels, stash(subroots, "merkle-subproofs"), made.height)
    carried = [F.col(c).alias(c[len("carry_"):]) for c in paths.columns if c.startswith("carry_")]
    return paths.select("key", F.col("digest").alias("leaf"), "subroot", "root", "sides", "siblings", *carried)


def hex_text(digest: Column) -> Column:
    return F.lower(F.hex(digest))


# -- the documents' manifest --------------------------------------------------
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def verify_documents(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """The manifest of ``documents`` and a check of rows whose text was tampered with.

    doc_id, leaf, subroot, root, proof_sha256 of the untampered table;
    folded_root from the tampered leaf (text in lower case where 3 divides the
    CRC-32 of the id; rows without an id are left as they are), verified.
    """
    fields = [col(c) for c in FIELDS]
    changed = F.crc32(col("doc_id").cast("string")) % F.lit(3) == 0
    tampered = F.when(changed, leaf_hash([*fields[:-1], F.translate(col("text"), UPPER, LOWER)]))
    proved = proofs(manifest(docs, FIELDS, "lang", "doc_id", {"tampered": tampered}, height))
    folded = fold(F.coalesce("tampered", "leaf"), F.col("sides"), F.col("siblings"))
    return proved.withColumn("folded", folded).select(
        F.col("key").alias("doc_id"), hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("subroot")).alias("subroot"),
        hex_text(F.col("root")).alias("root"), F.sha2(hex_text(F.col("siblings")).cast("binary"), 256).alias("proof_sha256"),
        hex_text(F.col("folded")).alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"))
