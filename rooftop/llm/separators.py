"""Document boundaries and token counts of flat token files without an index.

A stream is a folder of files of fixed-width little-endian token ids, read in
the order of their names; documents end with an end-of-document id and may run
over block and file boundaries.  The files are cut into blocks, each block is
searched on its own with one vectorised comparison, and what a block cannot
know by itself, where its first document began and how many documents came
before, is stitched by a prefix scan: block summaries (documents ended, last
end) are scanned within each file, file summaries over the stream, and the two
are added to the block's own findings.  Only positions move, never tokens.

Spark lists the files with their lengths; a file of any size becomes one row for
each block, and a task reads its blocks by offset and length, one at a time.  The
ends found are written once, and the scans read those.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stash
from .tokens import WORD_VOCABULARY, word_encoder

FILE_TOKENS = 4 << 20
BLOCKS_PER_TASK = 64
END_OF_DOCUMENT = 65535  # no vocabulary entry: texts can hold the vocabulary's own end token


def _store(path: str):
    """The file system of a path or URI as Spark writes it, and the path in it."""
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def write_token_files(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                      end_id: int = END_OF_DOCUMENT, vocabulary: str = WORD_VOCABULARY,
                      file_tokens: int = FILE_TOKENS, width: int = 2) -> DataFrame:
    """Tokenise ``docs`` into flat files of ids of ``width`` bytes (2 or 4) under ``path``, a folder that all executors share.

    Returns (id, file, ordinal), where each document is: the files themselves
    hold ids only.  A document of the text's ids and the end id; a null text is
    empty.  A document longer than a file is continued in the next one.  An id that
    is the end id or does not fit the width fails the job.  A task
    writes its files under names of its partition number, first under a name of
    its attempt, then moved, so a retry leaves no part files.  The result must
    be written or counted for the files to appear.
    """

    if width not in (2, 4):
        raise ValueError("ids have 2 or 4 bytes")
    largest, dtype = (1 << 8 * width) - 1, f"<u{width}"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(path)
        store.create_dir(folder, recursive=True)
        encode = word_encoder(vocabulary).encode
        context = TaskContext.get()
        part, attempt = (context.partitionId(), context.taskAttemptId()) if context else (0, 0)
        end = np.array([end_id], dtype=dtype).tobytes()
        held = bytearray()
        files = ordinal = 0
        most = width * file_tokens

        def name() -> str:
            return f"part-{part:08d}-{files:06d}.tokens"

        def flush(some: bytes) -> None:
            nonlocal files
            draft = f"{folder}/_{attempt}-{name()}"
            with store.open_output_stream(draft) as out:
                out.write(some)
            store.move(draft, f"{folder}/{name()}")
            files += 1

        for batch in batches:
            ids: list = []
            names: list[str] = []
            ordinals: list[int] = []
            for key, text in zip(batch.column(0), batch.column(1)):
                ids.append(key.as_py())
                names.append(name())
                ordinals.append(ordinal)
                got = np.frombuffer(encode(text.as_py() or ""), dtype="<u4")
                top = int(got.max(initial=0))
                if top > largest or (top >= end_id and (got == end_id).any()):
                    raise ValueError(f"the text of id {key.as_py()!r} has a token id that is the end id {end_id} "
                                     f"or does not fit {8 * width} bits (largest: {top})")
                held += got.astype(dtype).tobytes() + end
                ordinal += 1
                whole = len(held) // most * most
                for at in range(0, whole, most):
                    flush(bytes(held[at:at + most]))
                del held[:whole]
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column(0).type), pa.array(names),
                                              pa.array(ordinals, pa.int64())], ["id", "file", "ordinal"])
        if held:
            flush(bytes(held))

    slim = docs.select(col(id_col).alias("id"), col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    return slim.mapInArrow(write, f"id {kind}, file string, ordinal long")


def _search(end_id: int, width: int):
    """Reads blocks by their place in a file and finds the end ids in them."""
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, source = None, None
        try:
            for batch in batches:
                places = zip(*(batch.column(c).to_pylist() for c in ("path", "file", "b", "at", "size")))
                for path, file, b, at, size in places:  # one block in memory at a time
                    if path != now:
                        if source is not None:
                            source.close()
                        store, name = _store(path)
                        now, source = path, store.open_input_file(name)
                    raw = source.read_at(size, at)
                    if len(raw) != size:
                        raise OSError(f"{path} ended within a block at {at}")
                    ends = np.flatnonzero(np.frombuffer(raw, dtype=f"<u{width}") == end_id).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([file]), pa.array([b], pa.int64()), pa.array([ends], pa.list_(pa.int32())),
                         pa.array([size // width], pa.int64())], names=["file", "b", "ends", "n"])
        finally:
            if source is not None:
                source.close()
    return search


def scan_token_files(spark: SparkSession, path: str, end_id: int = END_OF_DOCUMENT, width: int = 2,
                     block_tokens: int = 1 << 18, pattern: str = "*.tokens") -> DataFrame:
    """One row per document of the stream.

    Columns: ``file`` (where it ends), ``file_ordinal`` (documents ended in that
    file before it), ``ordinal`` (in the stream), ``first_token`` (position in the
    stream), ``n_tokens`` (its end id not counted) and ``terminated``.  Ids after
    the stream's last end are one document that is not terminated.  Empty files
    count nothing; an empty stream gives no rows.  A file whose size is not a
    multiple of the width ends in a torn id: the scan fails.
    """
    size = width * block_tokens
    # without the content column the files are listed and not read
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path) \
        .select("path", F.element_at(F.split("path", "/"), -1).alias("file"), "length")
    whole = F.when(F.col("length") % width == 0, F.col("length")) \
        .otherwise(F.raise_error(F.concat(F.lit("torn token in "), F.col("file"))).cast("long"))
    starts = F.when(whole > 0, F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long"))) \
        .otherwise(F.array().cast("array<long>"))
    blocks = files.select("path", "file", "length", F.posexplode(starts).alias("b", "at")).select(
        "path", "file", F.col("b").cast("long").alias("b"), "at",
        F.least(F.lit(size).cast("long"), F.col("length") - F.col("at")).alias("size"))
    # blocks of one file go to many tasks, each a run of places; a fixed number, as the rows themselves are tiny
    count = files.agg(F.sum(F.ceil(F.col("length") / size))).first()[0] or 0
    tasks = max(1, min(count, max(spark.sparkContext.defaultParallelism, -(-count // BLOCKS_PER_TASK))))
    dealt = blocks.repartitionByRange(int(tasks), "file", "b").sortWithinPartitions("file", "b")
    found = stash(dealt.mapInArrow(_search(end_id, width), "file string, b long, ends array<int>, n long"), "token-ends")
    # within the file: documents ended and last end before each block
    own_last = F.when(F.size("ends") > 0, F.col("b") * block_tokens + F.element_at("ends", -1))
    found = found.withColumn("own_last", own_last)
    before = W.partitionBy("file").orderBy("b").rowsBetween(W.unboundedPreceding, -1)
    found = found.select("file", "b", "ends", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("docs"),
                         F.max("own_last").over(before).alias("last"), "n", "own_last")
    # over the stream: one row per file
    per_file = found.groupBy("file").agg(F.sum("n").alias("tokens"), F.sum(F.size("ends")).alias("ended"),
                                         F.max("own_last").alias("last_end"))
    order = W.orderBy("file")
    prior = order.rowsBetween(W.unboundedPreceding, -1)
    placed = per_file.withColumn("at", F.coalesce(F.sum("tokens").over(prior), F.lit(0))) \
        .withColumn("stream_end", F.col("at") + F.col("last_end")) \
        .select(F.col("file").alias("f2"), "at", "tokens", "ended",
                F.coalesce(F.sum("ended").over(prior), F.lit(0)).alias("file_docs"),
                F.max("stream_end").over(prior).alias("prior_end"),
                (F.lead("file").over(order).isNull()).alias("final"),
                F.coalesce("stream_end", F.max("stream_end").over(prior)).alias("all_end"))
    joined = found.join(placed, F.col("file") == F.col("f2"))
    carried = F.coalesce(F.col("at") + F.col("last"), "prior_end", F.lit(-1).cast("long"))
    base = F.col("at") + F.col("b") * block_tokens
    before_it = F.concat(F.array(F.lit(None).cast("int")), F.slice("ends", 1, F.greatest(F.size("ends") - 1, F.lit(0))))
    per_end = joined.filter(F.size("ends") > 0).select(
        "file", "docs", "file_docs", carried.alias("carried"), base.alias("base"),
        F.posexplode(F.arrays_zip(F.col("ends").alias("end"), before_it.alias("prior"))).alias("k", "e"))
    previous = F.coalesce(F.col("base") + F.col("e.prior"), "carried")
    done = per_end.select(
        "file", (F.col("docs") + F.col("k")).alias("file_ordinal"),
        (F.col("file_docs") + F.col("docs") + F.col("k")).alias("ordinal"),
        (previous + 1).alias("first_token"), (F.col("base") + F.col("e.end") - previous - 1).alias("n_tokens"),
        F.lit(True).alias("terminated"))
    tail = placed.filter(F.col("final")) \
        .withColumn("first_token", F.coalesce("all_end", F.lit(-1).cast("long")) + 1) \
        .withColumn("n_tokens", F.col("at") + F.col("tokens") - F.col("first_token")).filter(F.col("n_tokens") > 0) \
        .select(F.col("f2").alias("file"), F.lit(None).cast("long").alias("file_ordinal"),
                (F.col("file_docs") + F.col("ended")).alias("ordinal"), "first_token",
                "n_tokens", F.lit(False).alias("terminated"))
    return done.unionByName(tail)


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
                 end_id: int = END_OF_DOCUMENT, vocabulary: str = WORD_VOCABULARY, file_tokens: int = FILE_TOKENS,
                 block_tokens: int = 1 << 18, width: int = 2) -> DataFrame:
    """Write ``docs`` as flat token files under ``path``, scan them, and give each document its count.

    (id, file, file_ordinal, first_token, n_tokens) for every row of ``docs``;
    repeated rows and null ids stay.  A task's documents follow one another in
    its files, so the n-th document of a task is the n-th end in them.
    """
    placed = stash(write_token_files(docs, path, id_col, text_col, end_id, vocabulary, file_tokens, width), "token-places")
    scanned = scan_token_files(docs.sparkSession, path, end_id, width, block_tokens)
    part = F.substring("file", 1, len("part-00000000"))
    first = scanned.groupBy(part.alias("p")).agg(F.min("ordinal").alias("first"))
    placed = placed.select("id", part.alias("task"), "ordinal").join(first, F.col("task") == F.col("p")) \
        .select("id", (F.col("first") + F.col("ordinal")).alias("o"))
    return scanned.filter("terminated").join(placed, F.col("ordinal") == F.col("o")).select(
        F.col("id").alias(id_col), "file", "file_ordinal", "first_token", "n_tokens")
