import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from rooftop.llm import packing as P
from rooftop.llm.tokens import WORD_VOCABULARY, word_encoder

from .conftest import SF, with_clashes

REAL = Tokenizer.from_file(public_tokenizers.path(WORD_VOCABULARY))


def real_ids(text):
    return REAL.encode(text or "", add_special_tokens=False).ids


def fast_ids(text):
    return np.frombuffer(word_encoder().encode(text), dtype="<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    assert fast_ids(text) == real_ids(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abcdefgh ABC'stre.,!?-_0189éàßüÿ²ºµ\t\n<|>$%&", max_size=80))
def test_ids_of_plain_texts(text):
    assert fast_ids(text) == real_ids(text)


def test_ids_of_the_corpus_and_of_special_strings(spark):
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect():
        assert fast_ids(r.text or "") == real_ids(r.text)
    for t in ("<|endoftext|> x", "ΑΣ Σ", "İstanbul", "don't 'S 's ''s", "\x85 a b \x1c c", "9²½x", "ẞ ß"):
        assert fast_ids(t) == real_ids(t)


def test_a_cache_that_overflows_gives_the_same_ids():
    from rooftop.llm.tokens import WordEncoder

    small = WordEncoder(public_tokenizers.path(WORD_VOCABULARY), most=3)
    text = "the quick brown fox jumps over the lazy dog, again and again"
    assert np.frombuffer(small.encode(text), dtype="<u4").tolist() == real_ids(text)


def check_pieces(rows, docs, tiers=P.TIERS):
    """Pieces tile every document and every window; returns padding and real ids."""
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for (doc, text) in docs:
        ids = real_ids(text) + [2]
        at = 0
        for r in sorted(by_doc.pop(doc), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.length > 0
            assert bytes(r.ids) == np.array(ids[at:at + r.length], dtype="<u4").tobytes()
            at += r.length
        assert at == len(ids)
    assert not by_doc
    return check_windows(rows, tiers)


def check_windows(rows, tiers=P.TIERS):
    by_window = {}
    for r in rows:
        by_window.setdefault(r.sequence_id, []).append(r)
    padding = 0
    for pieces in by_window.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        size = pieces[0].window_size
        assert at <= size <= tiers[-1] and size in tiers
        assert len({r.step_group for r in pieces}) == 1
        if at < size:
            assert size == tiers[-1]
            padding += size - at
    return padding, sum(r.length for r in rows)


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = P.pack_documents(docs, block_tokens=1 << 14).collect()
    padding, real = check_pieces(rows, [tuple(r) for r in docs.collect()])
    assert padding < 4096 * docs.rdd.getNumPartitions()
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in P.piece_crc32(P.pack_documents(docs, block_tokens=1 << 14)).collect()}
    assert all(crc[r.doc_id, r.start] == zlib.crc32(bytes(r.ids)) for r in rows)


def test_odd_rows_and_clashing_columns(odd, empty):
    rows = P.pack_documents(with_clashes(odd)).collect()
    ones = odd.filter("doc_id not in (7, 8)").select("doc_id", "text").distinct()
    own = [r for r in rows if r.doc_id in {o.doc_id for o in ones.collect()} - {None}]
    check_windows(rows)
    for (doc, text) in [tuple(r) for r in ones.filter("doc_id is not null").collect()]:
        pieces = sorted((r for r in own if r.doc_id == doc), key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in pieces) == np.array(real_ids(text) + [2], dtype="<u4").tobytes()
    total = sum(len(real_ids(r.text)) + 1 for r in odd.collect())
    assert sum(r.length for r in rows) == total
    assert P.pack_documents(empty).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 10_000), max_size=120))
def test_blocks_lose_nothing_and_fill_windows(lengths):
    full, rest = P.pack_block([(i, 0, n) for i, n in enumerate(lengths)], P.TIERS)
    last = P.last_windows(rest, P.TIERS)
    assert all(w.used == w.size and w.size in P.TIERS for w in full)
    assert sum(p[2] for p in rest) < P.TIERS[-1]
    assert sum(w.used < w.size for w in last) <= 1
    tiles = {}
    for w in full + last:
        assert w.used == sum(p[2] for p in w.pieces)
        for doc, start, length in w.pieces:
            tiles.setdefault(doc, []).append((start, length))
    for i, n in enumerate(lengths):
        at = 0
        for start, length in sorted(tiles[i]):
            assert start == at
            at += length
        assert at == n


def test_steps_are_balanced():
    windows = [P.Window(4096, [(0, 0, 4096)], 4096) for _ in range(40)] + \
              [P.Window(512, [(0, 0, 256), (1, 0, 256)], 512) for _ in range(64)]
    groups = P.step_groups(windows, 8 * 4096)
    size = {}
    for w, g in zip(windows, groups):
        size[g] = size.get(g, 0) + w.size
    assert max(size.values()) - min(size.values()) <= 4096


def test_tiers_must_be_rising_powers_of_two(odd):
    with pytest.raises(ValueError):
        P.pack_documents(odd, tiers=(300, 4096))


def test_ids_without_tiktoken(monkeypatch):
    import sys

    import public_tokenizers

    from rooftop.llm import tokens
    texts = ["Plain words, 12 and more!", "é and ß", "", "a <|endoftext|> b", "don't  stop\n"]
    path = public_tokenizers.path(tokens.WORD_VOCABULARY)
    usual = [tokens.WordEncoder(path).encode(t) for t in texts]
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    bare = tokens.WordEncoder(path)
    assert bare.pieces_of is None and [bare.encode(t) for t in texts] == usual
