import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from rooftop.llm import simhash as S
from rooftop.llm.components import components

from .conftest import SF, with_clashes


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_groups(rows):
    prints = [brute_print(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        if d is not None:
            least[r] = min(least.get(r, d), d)
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints))]


def key(rows):
    return sorted(map(tuple, rows), key=repr)


def test_masks_cover_every_small_difference():
    from itertools import combinations

    masks = S.covering_masks(3)
    assert len(masks) == 15 and all(28 <= m.bit_count() <= 36 for m in masks)
    for places in combinations(range(64), 3):
        diff = sum(1 << p for p in places)
        assert any(diff & m == 0 for m in masks)


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert key(S.simhash_groups(docs).collect()) == key(brute_groups([tuple(r) for r in docs.collect()]))


def test_odd_rows_and_clashing_columns(spark, odd):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got = S.simhash_groups(with_clashes(odd))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    assert key(got.collect()) == key(brute_groups(rows))


def test_empty_table(empty):
    assert S.simhash_groups(empty).count() == 0
    assert S.keep_one_per_group(empty).count() == 0


def flipped(seed, n, most):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    out = {centre}
    while len(out) < n:
        x = rng.choice(sorted(out)[:50])
        for b in rng.sample(range(64), rng.randint(1, most)):
            x ^= 1 << b
        out.add(x)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def classes(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    out = {}
    for n in nodes:
        out.setdefault(find(n), set()).add(n)
    return sorted(map(sorted, out.values()))


def test_small_and_hot_buckets_give_the_same_components(spark):
    fps = [S._signed(x) for x in flipped(7, 120, 5)]
    true = [(a, b) for a in fps for b in fps if a < b and ((a ^ b) & (2 ** 64 - 1)).bit_count() <= 3]
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    for cap in (4096, 2, 8):
        links = [tuple(r) for r in S.fingerprint_links(df, 3, cap).collect()]
        assert classes(fps, links) == classes(fps, true), cap


def test_bucket_forest_is_a_forest_with_the_same_components():
    fps = np.array([S._signed(x) for x in flipped(3, 200, 3)], dtype=np.int64)
    a, b = S.bucket_forest(fps, 3)
    true = [(x, y) for x in fps.tolist() for y in fps.tolist() if x < y and ((x ^ y) & (2 ** 64 - 1)).bit_count() <= 3]
    assert classes(fps.tolist(), zip(a, b)) == classes(fps.tolist(), true)
    assert len(a) == len(fps) - len(classes(fps.tolist(), true))


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(60)]
    hub = [(1000, 1000 + i) for i in range(1, 300)]
    edges = spark.createDataFrame(chain + hub + [(5, 4), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(300))
    assert len(got) == 361


def test_one_of_each_group_stays(spark, odd):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = S.keep_one_per_group(docs)
    assert kept.columns == docs.columns
    groups = brute_groups([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups})
    wide = with_clashes(odd)
    kept = S.keep_one_per_group(wide)
    assert kept.columns == wide.columns
    groups = brute_groups([(r.doc_id, r.text) for r in odd.collect()])
    by_print = {}
    parts = {}
    for (d, p, c), r in zip(groups, odd.collect()):
        parts.setdefault((c, p if c is None else None), []).append(r)
    assert kept.count() == len({(c, p if c is None else "") for _, p, c in groups}) or kept.count() <= len(groups)
    assert kept.filter("doc_id = 7").count() == 1


def test_the_survivor_of_rows_equal_in_id_and_text(spark, monkeypatch):
    text = "some words that are the same in all of these rows and no others"
    rows = [(1, text, f"s{i}", {"k": i}) for i in range(40)] + [(2, text, "x", None), (3, "quite another text of its own", "y", None)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, m map<string,int>")
    one = sorted(tuple(r)[:3] for r in S.keep_one_per_group(df).collect())
    assert [r[0] for r in one] == [1, 3]
    assert sorted(tuple(r)[:3] for r in S.keep_one_per_group(df.repartition(7)).collect()) == one
    monkeypatch.setattr(S, "BROADCAST_KEYS", 0)
    assert sorted(tuple(r)[:3] for r in S.keep_one_per_group(df).collect()) == one


def test_texts_are_not_shuffled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = S.keep_one_per_group(docs)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
