import os

import numpy as np
import pyarrow as pa
import pytest

from rooftop.llm import separators as S

from .conftest import SF, with_clashes
from .test_packing import real_ids


def write(folder, files, dtype="<u2"):
    os.makedirs(folder)
    for name, ids in files.items():
        np.array(ids, dtype=dtype).tofile(os.path.join(folder, name))


def brute(files, end):
    out, at, first = [], 0, 0
    for name in sorted(files):
        for ordinal_token in files[name]:
            if ordinal_token == end:
                out.append((name, first, at - first, True))
                first = at + 1
            at += 1
    if at > first:
        out.append((max(n for n in files), first, at - first, False))
    return [(i, *r) for i, r in enumerate(out)]


def rows(df):
    return sorted((r.ordinal, r.file, r.first_token, r.n_tokens, r.terminated) for r in df.collect())


STREAMS = [
    {"a.tokens": [1, 2, 9, 3, 9, 9, 4], "b.tokens": [5, 6, 9], "c.tokens": [7]},
    {"a.tokens": [], "b.tokens": [9, 9, 9, 9], "c.tokens": []},
    {"a.tokens": list(range(10, 40)), "b.tokens": list(range(10, 40)), "c.tokens": [1, 9]},
    {"a.tokens": [1, 2, 3]},
    {"a.tokens": [9] * 50, "b.tokens": [1] * 33 + [9] + [2] * 31},
]


@pytest.mark.parametrize("stream", STREAMS)
@pytest.mark.parametrize("block", [1, 4, 1 << 18])
def test_streams_against_brute_force(spark, tmp_dir, stream, block):
    folder = os.path.join(tmp_dir, "s")
    write(folder, stream)
    got = S.scan_token_files(spark, folder, end_id=9, block_tokens=block)
    want = brute(stream, 9)
    last = [n for n in sorted(stream)][-1]
    want = [(i, last if not t else f, a, n, t) for i, f, a, n, t in want]
    assert rows(got) == want


def test_random_stream_and_four_byte_ids(spark, tmp_dir):
    rng = np.random.default_rng(4)
    stream = {f"{i:03d}.tokens": rng.integers(0, 30, rng.integers(0, 900)).tolist() for i in range(9)}
    stream["008.tokens"].append(7)
    folder = os.path.join(tmp_dir, "s")
    write(folder, stream, "<u4")
    assert rows(S.scan_token_files(spark, folder, end_id=7, width=4, block_tokens=64)) == brute(stream, 7)


def test_a_torn_file_fails(spark, tmp_dir):
    folder = os.path.join(tmp_dir, "s")
    write(folder, {"a.tokens": [1, 2]}, "u1")
    with open(os.path.join(folder, "b.tokens"), "wb") as f:
        f.write(b"abc")
    with pytest.raises(Exception, match="torn token"):
        S.scan_token_files(spark, folder, end_id=9).collect()


def test_counts_of_the_whole_table(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(3)
    got = S.token_counts(docs, os.path.join(tmp_dir, "files"), file_tokens=5000, block_tokens=700).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {r.doc_id: len(real_ids(r.text)) for r in docs.collect()}
    assert len(got) == docs.count()
    names = sorted(os.listdir(os.path.join(tmp_dir, "files")))
    assert all(n.startswith("part-") and n.endswith(".tokens") for n in names if not n.startswith("."))


def test_odd_rows_clashing_columns_and_empty_tables(spark, odd, empty, tmp_dir):
    got = S.token_counts(with_clashes(odd), os.path.join(tmp_dir, "a")).collect()
    want = sorted((repr(r.doc_id), len(real_ids(r.text))) for r in odd.collect())
    assert sorted((repr(r.doc_id), r.n_tokens) for r in got) == want


def test_texts_with_the_vocabularys_end_token(spark, tmp_dir):
    texts = ["one two", "a <|endoftext|> b", "three", "<|endoftext|>", "x<|endoftext|><|startoftext|>y", "four five six", ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    got = S.token_counts(docs, os.path.join(tmp_dir, "a"), file_tokens=4, block_tokens=3).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: len(real_ids(t)) for i, t in enumerate(texts)}
    assert len(got) == len(texts)


def test_ids_that_cannot_be_told_from_an_end_or_do_not_fit_fail(spark, tmp_dir, monkeypatch):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b")], "doc_id long, text string")
    with pytest.raises(Exception, match="end id 49407"):
        S.write_token_files(docs, os.path.join(tmp_dir, "a"), end_id=49407).collect()

    class Wide:
        encode = staticmethod(lambda text: np.array([1, 65536 + 7], dtype="<u4").tobytes())

    monkeypatch.setattr(S, "word_encoder", lambda name: Wide)
    # the function itself, in this process: workers have modules of their own
    write = write_of(docs, os.path.join(tmp_dir, "b"))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["x"])], ["id", "text"])
    with pytest.raises(ValueError, match="fit 16 bits"):
        list(write(iter([batch])))


def write_of(docs, path):
    """The task function of write_token_files."""
    taken = []

    class Frame:
        schema = docs.schema

        def select(self, *_):
            return docs_view

        def mapInArrow(self, f, _):
            taken.append(f)

    docs_view = Frame()
    docs_view.schema = docs.withColumnRenamed("doc_id", "id").schema
    S.write_token_files(docs_view, path)
    return taken[0]


def test_four_byte_ids_from_the_writer(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    got = S.token_counts(docs, os.path.join(tmp_dir, "files"), end_id=100_000, width=4, file_tokens=3000, block_tokens=500)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {r.doc_id: len(real_ids(r.text)) for r in docs.collect()}
    with pytest.raises(ValueError):
        S.write_token_files(docs, os.path.join(tmp_dir, "x"), width=3)


def test_a_large_file_is_read_by_several_tasks_and_searched_once(spark, tmp_dir):
    rng = np.random.default_rng(6)
    stream = {"a.tokens": rng.integers(0, 200, 300_000).tolist(), "b.tokens": rng.integers(0, 200, 10).tolist()}
    folder = os.path.join(tmp_dir, "s")
    write(folder, stream)
    seen = []
    real = S.stash
    S.stash = lambda df, name: seen.append(df) or real(df, name)
    try:
        got = S.scan_token_files(spark, folder, end_id=9, block_tokens=5000)
    finally:
        S.stash = real
    assert rows(got)[:-1] == brute(stream, 9)[:-1] or rows(got) == brute(stream, 9)
    assert len(seen) == 1 and seen[0].rdd.getNumPartitions() > 1
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Arrow" not in plan and "Python" not in plan
