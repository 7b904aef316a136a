import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rooftop.llm import merkle
from rooftop.llm.common import table

from .conftest import SF, with_clashes

COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def brute(rows):
    """Rows of (doc_id, text, lang, source, n_chars) to result rows, by plain lists."""
    def field(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"

    def lower(t):
        return None if t is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in t)

    def up(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i:i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            first = at // 8 * 8
            run = level[first:first + 8]
            out.append((run[:at - first], run[at - first + 1:]))
            at //= 8
        return out

    groups = {}
    for d, t, lang, source, n in rows:
        leaf = H(*map(field, (d, source, lang, n, t)))
        bad = H(*map(field, (d, source, lang, n, lower(t)))) if d is not None and zlib.crc32(str(d).encode()) % 3 == 0 else leaf
        groups.setdefault(lang, []).append((d is not None, d or 0, leaf, d, bad))
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    trees = {k: up([x[2] for x in sorted(groups[k])]) for k in names}
    outer = up([trees[k][-1][0] for k in names])
    out = []
    for o, k in enumerate(names):
        for i, (_, _, leaf, d, bad) in enumerate(sorted(groups[k])):
            steps = path(trees[k], i) + path(outer, o)
            cur = bad
            for left, right in steps:
                cur = H(*left, cur, *right)
            out.append((d, leaf, trees[k][-1][0], outer[-1][0], H(*[x for s in steps for p in s for x in p]), cur,
                        cur == outer[-1][0]))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def raw(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


@pytest.mark.parametrize("levels", [1, 2, 3, 4, 5])
def test_layout_is_a_permutation_with_aligned_subtrees(levels):
    places = [merkle.address(levels, d, np.arange(8 ** d)) for d in range(levels)]
    assert sorted(np.concatenate(places).tolist()) == list(range(merkle.tree_size(levels)))
    assert places[0].tolist() == [0]
    if levels > 1:  # each lower subtree is stored in one piece
        top = levels // 2
        size = merkle.tree_size(levels - top)
        for tree in range(8 ** top):
            inside = [places[d][tree * 8 ** (d - top):(tree + 1) * 8 ** (d - top)] for d in range(top, levels)]
            at = np.sort(np.concatenate(inside))
            assert at.tolist() == list(range(at[0], at[0] + size))


def test_a_truncated_block_keeps_its_addresses():
    for n in (1, 2, 8, 9, 65, 511, 512):
        leaves = [hashlib.sha256(bytes([i % 256, i // 256])).digest() for i in range(n)]
        for edges in (3, merkle.levels_above(n)):
            store = merkle.build_block(b"".join(leaves), edges)
            sides, siblings = merkle.block_paths(store, edges, n)
            assert all(merkle.fold_path(x, s, o) == store[:32] for x, s, o in zip(leaves, sides, siblings))
            assert all(len(s) == 2 * edges for s in sides)


def test_documents_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    want = brute(raw(docs))
    assert got(merkle.verify_documents(docs)) == want
    assert got(merkle.verify_documents(docs, height=1)) == want  # many levels of blocks
    assert {r[6] for r in want} == {True, False}


def test_odd_rows_and_clashing_names(spark, odd):
    docs = odd.withColumn("n_chars", F.length("text").cast("long"))
    want = brute(raw(docs))
    assert got(merkle.verify_documents(with_clashes(docs), height=1)) == want
    more = with_clashes(docs).withColumn("tree", F.lit("x")).withColumn("pos", F.lit("y")).withColumn("digest", F.lit("z"))
    assert got(merkle.verify_documents(more)) == want


def test_lone_row_one_group_and_empty(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(1, "A b", None, None, None)], [(i, "Text", "en", "s", i) for i in range(9)],
                 [(None, None, None, None, None)] * 20, [(i, "T", str(i), "s", 1) for i in range(70)]):
        df = spark.createDataFrame(rows, schema)
        assert got(merkle.verify_documents(df)) == brute([tuple(r) for r in rows])


def test_any_change_of_a_row_breaks_its_proof(spark):
    docs = table(spark, SF, "documents").limit(100)
    proofs = merkle.proofs(merkle.manifest(docs, merkle.FIELDS, "lang", "doc_id")).collect()
    for r in proofs[:20]:
        leaf, sides, siblings = bytes(r.leaf), bytes(r.sides), bytes(r.siblings)
        assert merkle.fold_path(leaf, sides, siblings) == bytes(r.root)
        assert merkle.fold_path(leaf[:-1] + bytes([leaf[-1] ^ 1]), sides, siblings) != bytes(r.root)
        assert merkle.fold_path(leaf, sides, siblings[:-1] + bytes([siblings[-1] ^ 1])) != bytes(r.root)
