"""Approximate nearest neighbours by an adaptive dimension scan of probed lists.

Largest inner product becomes smallest distance: a vector x gets one more
component sqrt(M^2 - |x|^2), M the largest norm, a query gets zero there.  All
vectors are turned by one random rotation, so any few of the rotated components
are a fair sample of a distance.  Vectors are assigned to the lists of a k-means
fitted on a bounded sample; a query probes its nearest lists.

Within a list the rotated vectors lie in column blocks.  The scan adds up
squared differences block by block.  After d of D dimensions a candidate whose
partial distance, scaled by D/d, is above the query's threshold by more than
sampling error allows (a factor 1 + e/sqrt(d), squared) is given up; most are,
after a block or two.  What is left is scored exactly on the original vectors.
The threshold is the distance of the query's k-th best of its first list; so
the first lists are searched first, and all others with their thresholds.

How many lists to probe is measured, not guessed: for ``calibration`` sampled
queries the true neighbours are found by brute force over all rows, and the
smallest number of lists that holds ``recall`` of them is used.

Lists of any size are cut into blocks of vectors and of queries, as large as a
task holds well; a task compares one block with one block, so a vector is sent
once for every ``Q_BLOCK`` queries of its list, and a query once for every
``V_BLOCK`` vectors.  The lists' centroids, at most ``MAX_LISTS`` of them, and their
counts are all that is sent to the tasks.

Every row takes part for itself: rows that share an id or a vector are each a
candidate, and each a query where the condition holds.  Vectors of different
lengths have no inner product, so each length is searched on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, stash

# Lists are a quarter of the root of the rows up to this many; then they grow, and are cut into more blocks.
MAX_LISTS = 16_384
SAMPLE_PER_LIST = 16
V_BLOCK, Q_BLOCK = 32_768, 8_192
COLUMN_BLOCK = 13
ERROR_FACTOR = 2.1
SLACK = 1e-9


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>) of the rows that take part: an id, and a vector that is whole, finite and not zero."""
    v = col(vec_col).cast("array<double>")
    inf = F.lit(float("inf"))
    return vectors.select(col(id_col).cast("long").alias("vec_id"), v.alias("v")) \
        .filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull()) \
        .filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < inf)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype=np.float64).reshape(-1, dim)


def kmeans(x: np.ndarray, k: int, seed: int, rounds: int = 12) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest_centre(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest_centre(x: np.ndarray, centres: np.ndarray, block: int = 4096) -> np.ndarray:
    half = (centres ** 2).sum(axis=1) / 2
    parts = [np.argmin(half - x[i:i + block] @ centres.T, axis=1) for i in range(0, len(x), block)]
    return np.concatenate([np.zeros(0, dtype=np.int64), *parts])


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    extra = np.sqrt(np.maximum(largest ** 2 - (x ** 2).sum(axis=1), 0.0))
    return np.hstack([x, extra[:, None]])


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest scores, ties to the smaller id."""
    if scores.size > 4 * k:
        edge = np.partition(scores, scores.size - k)[scores.size - k]
        some = np.flatnonzero(scores >= edge)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def exact_scores(v: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (v * q).sum(axis=1)


def adaptive_scan(v: np.ndarray, ids: np.ndarray, rows: np.ndarray, q: np.ndarray, q_rows: np.ndarray, limits: np.ndarray,
                  rotation: np.ndarray, largest: float, k: int) -> tuple[list, list, list]:
    """(query rows, vector ids, scores): each query's best k of the block among those that pass the tests.

    ``rows`` and ``q_rows`` tell rows apart: a query's own row is not its candidate.
    ``limits``: each query's squared distance to beat in the lifted space, or infinity.
    """
    dim = rotation.shape[0]
    turned = lifted(v, largest) @ rotation
    turned_q = np.hstack([q, np.zeros((len(q), 1))]) @ rotation
    edges = [*range(0, dim, COLUMN_BLOCK), dim]
    blocks = [np.ascontiguousarray(turned[:, a:b]) for a, b in zip(edges[:-1], edges[1:])]
    squares = [(b ** 2).sum(axis=1) for b in blocks]
    head_q = np.ascontiguousarray(turned_q[:, :edges[1]])
    out_q: list = []
    out_v: list = []
    out_s: list = []
    for start in range(0, len(q), 128):
        part = slice(start, start + 128)
        first = (head_q[part] ** 2).sum(axis=1)[:, None] + squares[0][None, :] - 2 * head_q[part] @ blocks[0].T
        for j, i in enumerate(range(start, min(start + 128, len(q)))):
            limit = limits[i]
            if np.isfinite(limit):
                alive, partial = np.arange(len(v)), first[j]
                for b, done in enumerate(edges[1:]):
                    if b:
                        qb = turned_q[i, edges[b]:done]
                        partial = partial + squares[b][alive] + qb @ qb - 2 * (blocks[b][alive] @ qb)
                    margin = (1 + ERROR_FACTOR / math.sqrt(done)) ** 2 * done / dim if done < dim else 1.0
                    pass_ = partial <= limit * margin * (1 + SLACK) + SLACK
                    alive, partial = alive[pass_], partial[pass_]
                    if not alive.size:
                        break
                alive = alive[rows[alive] != q_rows[i]]
            else:
                alive = np.flatnonzero(rows != q_rows[i])
            if alive.size:
                scores = exact_scores(v[alive], q[i])
                top = best(scores, ids[alive], k)
                out_q += [int(q_rows[i])] * len(top)
                out_v += ids[alive][top].tolist()
                out_s += scores[top].tolist()
    return out_q, out_v, out_s


def _grouped_search(dim: int, rotation: np.ndarray, largest: float, k: int):
    def search(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        found = ([], [], [])
        if vectors.num_rows and queries.num_rows:
            v, q = (_matrix(t.column("v").combine_chunks(), dim) for t in (vectors, queries))
            found = adaptive_scan(v, vectors.column("vec_id").to_numpy(), vectors.column("row").to_numpy(), q,
                                  queries.column("q_row").to_numpy(), queries.column("limit_sq").to_numpy(),
                                  rotation, largest, k)
        return pa.table(dict(zip(("q_row", "vec_id", "score"), (
            pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64()), pa.array(found[2], pa.float64())))))
    return search


def _search(assigned: DataFrame, probes: DataFrame, sizes: dict[int, int], dim: int, rotation: np.ndarray,
            largest: float, k: int) -> DataFrame:
    """Compare ``probes(q_row, v, limit_sq, list)`` with their lists, block by block."""
    spark = assigned.sparkSession
    asked = {r["list"]: r["n"] for r in probes.groupBy("list").agg(F.count("*").alias("n")).collect()}
    plan = [(int(x), -(-sizes.get(x, 0) // V_BLOCK), -(-n // Q_BLOCK)) for x, n in sorted(asked.items())]
    # one row per list, at most MAX_LISTS
    plan = F.broadcast(spark.createDataFrame(plan, "list_ int, v_blocks int, q_blocks int"))
    key = ["list", "vb", "qb"]
    vectors = assigned.join(plan, F.col("list") == F.col("list_")).select(
        "row", "vec_id", "v", "list", F.pmod(F.xxhash64("row"), "v_blocks").cast("int").alias("vb"),
        F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)).alias("qb"))
    queries = probes.join(plan, F.col("list") == F.col("list_")).filter("v_blocks > 0").select(
        "q_row", "v", "limit_sq", "list", F.explode(F.sequence(F.lit(0), F.col("v_blocks") - 1)).alias("vb"),
        F.pmod(F.xxhash64("q_row"), "q_blocks").cast("int").alias("qb"))
    return vectors.groupBy(*key).cogroup(queries.groupBy(*key)).applyInArrow(
        _grouped_search(dim, rotation, largest, k), "q_row long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("q_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _lists_needed(vectors: DataFrame, sample: np.ndarray, sample_rows: np.ndarray, centres: np.ndarray,
                  largest: float, k: int, recall: float) -> int:
    """The least number of nearest lists that holds ``recall`` of the sample queries' true neighbours."""
    dim = sample.shape[1]

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in sample_rows]
        for b in batches:
            ids, rows, v = b.column("vec_id").to_numpy(), b.column("row").to_numpy(), _matrix(b.column("v"), dim)
            own = nearest_centre(lifted(v, largest), centres)
            scores = sample @ v.T
            for i, s in enumerate(scores):
                s = np.where(rows == sample_rows[i], -np.inf, s)
                top = best(s, ids, k)
                more = held[i] + [(s[t], int(ids[t]), int(own[t])) for t in top if np.isfinite(s[t])]
                held[i] = sorted(more, key=lambda r: (-r[0], r[1]))[:k]
        out = [(i, *r) for i, found in enumerate(held) for r in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[c] for r in out], t) for c, t in enumerate((pa.int64(), pa.float64(), pa.int64(), pa.int32()))],
            ["q_row", "score", "vec_id", "list"])

    # at most k rows for each of the sampled queries
    true = _top(vectors.mapInArrow(brute, "q_row long, score double, vec_id long, list int"), k).collect()
    far = (centres ** 2).sum(axis=1) / 2 - np.hstack([sample, np.zeros((len(sample), 1))]) @ centres.T
    place = np.argsort(np.argsort(far, axis=1), axis=1)
    ranks = np.sort([place[r["q_row"], r["list"]] for r in true])
    if not ranks.size:
        return 1
    return int(ranks[min(ranks.size - 1, math.ceil(recall * ranks.size) - 1)]) + 1


def nearest_neighbours(vectors: DataFrame, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
                       query: str = "vec_id % 20 = 0", seed: int = 42, sample_rows: int = 20_000,
                       calibration: int = 64, recall: float = 0.97) -> DataFrame:
    """(query_id, rank from 1, vec_id, score) of each query's k nearest found, by largest inner product.

    ``query`` is a condition on ``vec_id``.  Scores are exact, in double
    precision, on the original vectors; ties go to the smaller id; a row is not
    its own neighbour, but another row of the same id is.  Vectors that are null
    or zero, or hold null or non-finite components, and rows without an id take
    no part.  A row meets the rows whose vectors have its length.  With too few
    candidates a query has all of them; an empty table gives no rows.  Other
    columns are ignored.
    """
    clean = stash(usable(vectors, id_col, vec_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    shapes = clean.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect()
    out = clean.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for shape in shapes:  # one search for each length that vectors have
        found = _search_length(clean.filter(F.size("v") == shape["d"]), shape["d"], shape["n"], k, query, seed, sample_rows,
                               calibration, recall)
        out = found if shape is shapes[0] else out.unionByName(found)
    return out


def _search_length(clean: DataFrame, dim: int, total: int, k: int, query: str, seed: int, sample_rows: int,
                   calibration: int, recall: float) -> DataFrame:
    """``nearest_neighbours`` among ``total`` vectors (row, vec_id, v) of one length."""
    norm_sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    largest = math.sqrt(clean.agg(F.max(norm_sq)).first()[0])
    n_lists = max(1, min(MAX_LISTS, round(math.sqrt(total) / 4)))
    sample_rows = max(sample_rows, SAMPLE_PER_LIST * n_lists)
    sample = clean.orderBy(F.xxhash64(F.lit(seed), "vec_id", "row"), "row").limit(sample_rows).toArrow()
    x = _matrix(sample.column("v").combine_chunks(), dim)
    centres = kmeans(lifted(x, largest), min(n_lists, len(x)), seed)
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim + 1, dim + 1)))[0]
    few = slice(0, calibration)
    probes = _lists_needed(clean, x[few], sample.column("row").to_numpy()[few], centres, largest, k, recall)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = nearest_centre(lifted(_matrix(b.column("v"), dim), largest), centres)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(own, pa.int32())],
                                             ["row", "vec_id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (centres ** 2).sum(axis=1) / 2
        for b in batches:
            q = _matrix(b.column("v"), dim)
            far = half - np.hstack([q, np.zeros((len(q), 1))]) @ centres.T
            near = np.argsort(far, axis=1, kind="stable")[:, :probes].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), b.column("v"), pa.array(list(near))],
                                             ["q_row", "query_id", "v", "lists"])

    assigned = stash(clean.mapInArrow(assign, "row long, vec_id long, v array<double>, list int"), "lists")
    sizes = {r["list"]: r["n"] for r in assigned.groupBy("list").agg(F.count("*").alias("n")).collect()}
    asked = stash(clean.filter(F.expr(query)).mapInArrow(
        probe, "q_row long, query_id long, v array<double>, lists array<int>"), "queries")
    none = F.lit(float("inf"))
    home = asked.select("q_row", "v", none.alias("limit_sq"), F.element_at("lists", 1).alias("list"))
    at_home = stash(_search(assigned, home, sizes, dim, rotation, largest, k), "home-found")
    worst = _top(at_home, k).groupBy(F.col("q_row").alias("q2")) \
        .agg(F.when(F.count("*") == k, F.min("score")).alias("worst"))
    q_sq = F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)
    limit = F.coalesce(q_sq + largest ** 2 - 2 * F.col("worst"), none)
    away = asked.filter(F.size("lists") > 1).join(worst, F.col("q_row") == F.col("q2"), "left").select(
        "q_row", "v", limit.alias("limit_sq"), F.explode(F.slice("lists", 2, MAX_LISTS)).alias("list"))
    found = at_home.unionByName(_search(assigned, stash(away, "probes"), sizes, dim, rotation, largest, k))
    return _top(found, k).join(asked.select("q_row", "query_id"), "q_row") \
        .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
