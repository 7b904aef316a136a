import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rooftop.llm import toxicity as T

from .conftest import with_clashes


def corpus(n, seed=3):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 60))]
        toxic = i % 4 == 0
        if toxic:
            text[rng.randrange(len(text))] = rng.choice(["Vileword,", "nastything.", "hatefulness!"])
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy_and_folds(spark):
    rows = corpus(1200)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    got = T.toxicity_scores(docs, labels).collect()
    label = {r[0]: r[2] for r in rows}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == label[r.doc_id] for r in out]) > 0.95
    # labels of held-out rows are never read
    turned = labels.withColumn("toxic", F.when(T.held_out("doc_id"), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert sorted(got) == sorted(T.toxicity_scores(docs, turned).collect())


def test_the_model_is_sparse_and_repeatable_under_any_partitioning(spark):
    rows = spark.createDataFrame(corpus(600), "id long, text string, y int")
    docs, labels = rows.select("id", "text"), rows.select("id", "y")
    a = T.train(docs, labels)
    assert a == T.train(docs.repartition(7), labels.repartition(3))
    assert a == T.train(docs.unionByName(docs), labels)
    assert 0 < len(a) < 2000
    assert a != T.train(docs, labels, max_rows=50) != {}
    assert a != T.train(docs, labels, max_places=2000) != {}


def test_beyond_a_shard_all_rows_count_at_their_natural_rate(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(20)) + (" vileword" if i % 20 == 0 else ""), int(i % 10 == 0))
            for i in range(3000)]  # half of the toxic rows show it; the rest are the rate of the others
    df = spark.createDataFrame(rows, "id long, text string, y int")
    docs, labels = df.select("id", "text"), df.select("id", "y")
    for size in ({"max_rows": 10_000}, {"max_rows": 250}, {"max_places": 20_000}):
        model = T.train(docs, labels, **size)
        assert model == T.train(docs.repartition(5), labels.repartition(2), **size)
        got = {r.id: r.score for r in T.score(docs, model).collect()}
        plain = np.mean([got[i] for i in range(3000) if i % 20])
        assert plain < 0.11, (size, plain)  # 0.05 of them are toxic
        assert np.mean([got[i] for i in range(0, 3000, 20)]) > 0.5, size
    # a label beyond the first rows' still changes the model
    for i in (17, 1717, 2929):
        turned = labels.withColumn("y", F.when(F.col("id") == i, 1 - F.col("y")).otherwise(F.col("y")))
        assert T.train(docs, turned, max_rows=250) != T.train(docs, labels, max_rows=250)


def test_ftrl_is_the_published_update():
    m = T.Ftrl(4, alpha=0.5, beta=1.0, l1=0.1, l2=0.2)
    z, n = np.zeros(5), np.zeros(5)
    for places, y in (([0, 2], 1), ([0, 3], 0), ([0, 2, 3], 1)):
        at = [*places, 4]
        w = {}
        for i in at:
            l1, l2 = (0.0, 0.0) if i == 4 else (0.1, 0.2)
            w[i] = 0.0 if abs(z[i]) <= l1 else -(z[i] - np.sign(z[i]) * l1) / ((1.0 + np.sqrt(n[i])) / 0.5 + l2)
        g = 1 / (1 + np.exp(-sum(w.values()))) - y
        for i in at:
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / 0.5 * w[i]
            n[i] += g * g
        m.learn(np.array(places), y)
    assert np.allclose(m.z, z) and np.allclose(m.n, n)


def test_features_count_once_and_ignore_case_and_punctuation():
    f = T.Features()
    assert (f.of(b"One, two THREE") == f.of(b"one two. three!")).all()
    assert f.of(b"a b c").size == 6 and f.of(b"").size == 0 and f.of(b"a a").size == 2
    dense = np.random.default_rng(0).normal(size=(1 << T.BITS) + 1) * (np.arange((1 << T.BITS) + 1) % 3 == 0)
    text = b"the cat and the dog and the cat"
    assert abs(f.total(text, dense) - dense[f.of(text)].sum()) < 1e-9


def test_odd_rows_clashing_columns_and_empty_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0), (9, None), (99, 1)], "doc_id long, toxic int")
    got = T.toxicity_scores(with_clashes(odd), with_clashes(labels)).collect()
    assert len(got) == odd.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert all(r.score == 0.5 for r in T.toxicity_scores(odd, none).collect())
    assert T.toxicity_scores(empty, none).count() == 0


def plain_features(text, bits):
    """The hashed features of a text, one number at a time."""
    import xxhash
    mask = (1 << 64) - 1
    words = "".join(c if c.isalnum() or ord(c) >= 128 else " " for c in text)
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in words.encode()).split()
    h = [xxhash.xxh64_intdigest(w, 1) | 1 for w in words]
    out = list(h)
    out += [(a * 0x9E3779B97F4A7C15 + (b ^ (b >> 29))) & mask for a, b in zip(h, h[1:])]
    out += [(a * 0xC2B2AE3D27D4EB4F + (b ^ (b >> 31))) & mask for a, b in zip(h, h[2:])]
    places = set()
    for x in out:
        x = x * 0xBF58476D1CE4E5B9 & mask
        places.add(((x ^ (x >> 32)) * 0x9E3779B97F4A7C15 & mask) >> (64 - bits))
    return sorted(places)


def replay(rows, shards, bits, passes=5, alpha=1.5, beta=1.0, l1=4.0, l2=0.1):
    """Weights by FTRL over each shard's rows (shard, order, id, text, y) in order, mixed by how many texts have a place."""
    size, total, weight, models = 1 << bits, {}, {}, {}
    for shard in range(shards):
        own = [(plain_features(t, bits) + [size], y) for s, h, i, t, y in sorted(rows, key=lambda r: r[:3]) if s == shard]
        z, n = [0.0] * (size + 1), [0.0] * (size + 1)

        def w(i):
            free = i == size
            if abs(z[i]) <= (0.0 if free else l1):
                return 0.0
            return -(z[i] - np.sign(z[i]) * (0.0 if free else l1)) / ((beta + n[i] ** 0.5) / alpha + (0.0 if free else l2))
        for _ in range(passes):
            for at, y in own:
                ws = [w(i) for i in at]
                g = 1 / (1 + np.exp(-np.clip(sum(ws), -60, 60))) - y
                for i, x in zip(at, ws):
                    z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * x
                    n[i] += g * g
        seen = {}
        for at, _ in own:
            for i in at:
                seen[i] = seen.get(i, 0) + 1
        for i, k in seen.items():
            weight[i] = weight.get(i, 0.0) + w(i) * k
            total[i] = total.get(i, 0) + k
            models[i] = models.get(i, 0) + 1
    return {i: weight[i] / total[i] for i in weight}


def test_scores_equal_a_plain_replay(spark):
    """Features, shards, updates, mixing and scores, one number at a time."""
    rows = [(i, t, y) for i, t, y in corpus(120)]
    df = spark.createDataFrame(rows, "id long, text string, y int")
    for max_rows, shards in ((1000, 1), (20, 3)):
        dealt = {r.id: (r.s, r.h) for r in df.select(
            "id", F.pmod(F.xxhash64(F.lit(42), F.lit("shard"), "id"), F.lit(shards)).alias("s"),
            F.xxhash64(F.lit(42), "id").alias("h")).collect()}
        want = replay([(*dealt[i], i, t, y) for i, t, y in rows], shards, 10)
        model = T.train(df.select("id", "text"), df.select("id", "y"), max_rows=max_rows, bits=10)
        assert all(abs(model.get(i, 0.0) - w) < 1e-6 for i, w in want.items()) and set(model) <= set(want)
        got = {r.id: r.score for r in T.score(df.select("id", "text"), model, bits=10).collect()}
        for i, text, _ in rows:
            x = want.get(1 << 10, 0.0) + sum(want.get(p, 0.0) for p in plain_features(text, 10))
            assert abs(got[i] - 1 / (1 + np.exp(-x))) < 1e-5


def test_only_labelled_texts_are_shuffled(spark, monkeypatch):
    rows = spark.createDataFrame(corpus(400), "id long, text string, y int")
    labels = rows.filter("id % 4 = 0").select("id", "y")
    a = T.train(rows.select("id", "text"), labels)
    monkeypatch.setattr(T, "BROADCAST_IDS", 0)
    assert a == T.train(rows.select("id", "text"), labels) != {}
