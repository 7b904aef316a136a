"""Toxicity scores: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are its lower-cased words, adjacent pairs and pairs with one
word between, each hashed to one of 2^bits places and counted once a text.
FTRL-proximal keeps for each place the adjusted gradient sum z and the squared
gradient sum n; the weight follows from both, with a learning rate of its own
and exactly zero while |z| is within the L1 strength.  So the model that is sent
to the tasks is a short list of places and weights, at most 2^bits of them.

Training reads every labelled row.  The rows are dealt by a seeded hash of their
ids into shards of about ``2 * max_rows``, so each shard has the classes at the
rate of the whole; a task streams a shard in the order of another hash and keeps
its features for the passes after the first.  A shard with more than
``max_places`` features is learnt as several.  The shards' models are mixed place
by place, each weight counting by the shard's texts that have the place: a shard
that never met a place has no say in it.  With one shard this is plain FTRL.

Only texts with a label are shuffled: the labelled ids meet the texts first,
sent to the scan where they are at most ``BROADCAST_IDS``, else by a join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

BITS = 18
# Up to so many labelled ids (some 100 MB as a hash table) are sent to every task.
BROADCAST_IDS = 2_000_000
# Weights of several shards are summed as whole multiples of 2^-24, so in any order alike.
SUM_SCALE = float(1 << 24)
_TO_SPACE = bytes(i if chr(i).isalnum() or i >= 128 else 32 for i in range(128)) + bytes(range(128, 256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_SKIP = np.uint64(0xC2B2AE3D27D4EB4F)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


class Features:
    """Hashed features of texts; remembers the hash of at most ``most`` words."""

    def __init__(self, bits: int = BITS, most: int = 300_000):
        self.shift = np.uint64(64 - bits)
        self.most = most
        self.known: dict[bytes, int] = {}

    def _hash(self, word: bytes) -> int:
        if len(self.known) >= self.most:
            self.known.clear()
        h = self.known[word] = xxhash.xxh64_intdigest(word, 1) | 1  # never zero: "or" below tests for a miss
        return h

    def places(self, text: bytes) -> np.ndarray:
        """The places of a text's features, repeats included."""
        known, learn = self.known.get, self._hash
        words = text.translate(_TO_SPACE).lower().split()
        h = np.array([known(w) or learn(w) for w in words], dtype=np.uint64)
        parts = [h]
        if h.size > 1:
            parts.append(h[:-1] * _PAIR + (h[1:] ^ (h[1:] >> np.uint64(29))))
        if h.size > 2:
            parts.append(h[:-2] * _SKIP + (h[2:] ^ (h[2:] >> np.uint64(31))))
        x = np.concatenate(parts) * _MIX
        return ((x ^ (x >> np.uint64(32))) * _PAIR >> self.shift).astype(np.int64)

    def of(self, text: bytes) -> np.ndarray:
        """The sorted distinct places of a text's features."""
        return np.unique(self.places(text))

    def total(self, text: bytes, weights: np.ndarray) -> float:
        """The sum of the weights of a text's distinct features."""
        at = self.places(text)
        return float(weights[np.unique(at[weights[at] != 0])].sum())


class Ftrl:
    """FTRL-proximal for logistic loss; the place after the last is the intercept, without penalty."""

    def __init__(self, size: int, alpha: float, beta: float, l1: float, l2: float):
        self.z = np.zeros(size + 1)
        self.n = np.zeros(size + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        free = at == self.z.size - 1
        l1 = np.where(free, 0.0, self.l1)
        rate = (self.beta + np.sqrt(n)) / self.alpha + np.where(free, 0.0, self.l2)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / rate)

    def learn(self, places: np.ndarray, label: int) -> None:
        at = np.append(places, self.z.size - 1)
        w = self.weights(at)
        g = sigmoid(w.sum()) - label
        grown = self.n[at] + g * g
        self.z[at] += g - (np.sqrt(grown) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] = grown


def sigmoid(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -60, 60)))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 10_000, passes: int = 5, bits: int = BITS,
          alpha: float = 1.5, beta: float = 1.0, l1: float = 4.0, l2: float = 0.1, seed: int = 42,
          max_places: int = 1 << 26) -> dict[int, float]:
    """Non-zero weights by place; place 2^bits is the intercept.

    ``docs(id, text)``; ``labels(id, y)`` with at most one label an id, 0 or 1 (others
    and null ids are left out).  Of rows under one id one counts.  Without any
    labelled row the model is empty and scores 0.5.  ``max_rows`` and ``max_places``
    bound a shard; no row is left out.
    """
    kind = docs.schema["id"].dataType
    known = labels.select(F.col("id").try_cast(kind).alias("id"), F.col("y").cast("int").alias("y")) \
        .filter(F.col("id").isNotNull() & F.col("y").isin(0, 1))
    count = known.count()
    shards = max(1, -(-count // (2 * max_rows)))

    def dealt(rows: DataFrame, y, text) -> DataFrame:
        return rows.select(F.pmod(F.xxhash64(F.lit(seed), F.lit("shard"), "id"), F.lit(shards)).cast("int").alias("shard"),
                           F.xxhash64(F.lit(seed), "id").alias("h"), "id", y.alias("y"), text.alias("text"))

    # one exchange: an id's label comes before its texts
    ids = known.select("id")
    texts = docs.join(F.broadcast(ids) if count <= BROADCAST_IDS else ids, "id", "left_semi")
    stream = dealt(known, F.col("y"), F.lit(None).cast("binary")) \
        .unionByName(dealt(texts, F.lit(None).cast("int"), F.coalesce(F.col("text"), F.lit("")).cast("binary"))) \
        .repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "h", "id", F.col("y").desc_nulls_last())

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
        """(shard, label, text) of each labelled id that has a text; of several texts the smallest."""
        now = label = least = None
        for b in batches:
            raw = b.column("text")
            for i, (shard, h, id_, y) in enumerate(zip(*(b.column(c).to_pylist() for c in ("shard", "h", "id", "y")))):
                key = (shard, h, str(id_))
                if key != now:
                    if least is not None:
                        yield now[0], label, least
                    now, label, least = key, y, None
                if y is None and label is not None:
                    text = raw[i].as_py()
                    least = text if least is None else min(least, text)
        if least is not None:
            yield now[0], label, least

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = Features(bits).of
        part, shard, kept, room = 0, None, [], max_places

        def model() -> pa.RecordBatch:
            m = Ftrl(1 << bits, alpha, beta, l1, l2)
            seen = np.zeros(m.z.size)
            seen[-1] = len(kept)
            for places, _ in kept:
                seen[places] += 1
            for _ in range(passes):
                for places, y in kept:
                    m.learn(places, y)
            some = np.flatnonzero(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(some.size, shard), pa.int32()), pa.array(np.full(some.size, part), pa.int32()),
                 pa.array(some, pa.int64()), pa.array(m.weights(some)), pa.array(seen[some])],
                ["shard", "part", "place", "weight", "n"])

        for at, y, text in examples(batches):
            places = of(text).astype("<i4")
            if kept and (at != shard or places.size > room):
                yield model()
                part, kept, room = part + 1, [], max_places
            shard = at
            room -= places.size
            kept.append((places, y))
        if kept:
            yield model()

    models = stream.mapInArrow(fit, "shard int, part int, place long, weight double, n double")
    share = F.round(F.col("weight") * F.col("n") * F.lit(SUM_SCALE)).cast("decimal(38,0)")
    mixed = models.groupBy("place").agg(F.count("*").alias("models"), F.max("weight").alias("one"),
                                        F.sum(share).cast("double").alias("sum"), F.sum("n").alias("n"))
    weight = F.when(F.col("models") == 1, F.col("one")).otherwise(F.col("sum") / F.lit(SUM_SCALE) / F.col("n"))
    # at most 2^bits + 1 rows
    return {r["place"]: r["weight"] for r in mixed.select("place", weight.alias("weight")).filter("weight != 0").collect()}


def score(docs: DataFrame, model: dict[int, float], text_col: str = "text", score_col: str = "score",
          bits: int = BITS) -> DataFrame:
    """``docs`` with a score between 0 and 1 in place of its text column; a null text is empty."""
    places = np.array(sorted(model), dtype=np.int64)
    values = np.array([model[p] for p in places.tolist()])

    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        dense = np.zeros((1 << bits) + 1)
        dense[places] = values
        features = Features(bits)
        return pa.array([float(sigmoid(dense[-1] + features.total(t or b"", dense)))
                         for t in texts.cast(pa.binary()).to_pylist()], pa.float64())

    return docs.select(*(col(c) for c in docs.columns if c != text_col), scores(col(text_col)).alias(score_col))


def held_out(id_col: str, folds: int = 5):
    """Whether crc32 of the id's text is divisible by ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col(id_col).cast("string"), F.lit(""))) % folds == 0


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    label_col: str = "toxic", max_rows: int = 10_000, **settings) -> DataFrame:
    """(id, held_out, score, predicted) for every row of ``docs``.

    Learns from rows of ``docs`` that have a label and are not held out; an id
    labelled twice has the larger label, a null label is none.  Other columns
    of either table are never inputs.  Null and empty texts score the
    intercept.  Repeated rows stay.
    """
    known = labels.select(col(id_col).alias("id"), col(label_col).alias("y")).filter(~held_out("id")) \
        .groupBy("id").agg(F.max("y").alias("y"))
    texts = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).filter(~held_out("id"))
    model = train(texts, known, max_rows, **settings)
    slim = docs.select(col(id_col).alias("id_"), col(text_col).alias("t_"), held_out(id_col).alias("held_out"))
    return score(slim, model, "t_").select(
        F.col("id_").alias(id_col), "held_out", "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
