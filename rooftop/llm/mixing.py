"""Mixing sources to target weights by hierarchical token budgets.

Leaves of a tree (say domain, language, source) hold documents.  The token
budget of the root is handed down level by level: a node's budget is dealt to
its children by their weights, but no child gets more than its subtree can
supply (its tokens times ``max_epochs``).  What a child cannot take goes to its
siblings by their weights, again up to their supply; only when a whole subtree
is short has its parent already given the rest to the subtree's siblings.  That
is water-filling: sorted by supply per weight, the first children are given all
they have, and the others share the rest at one common level, found with running
sums; no loop over rounds is needed.

A leaf spends its budget as a prefix of its seeded epochs.  An epoch is the
leaf's documents in the order of a hash of the seed, the epoch's number and the
document, so a budget of 2.3 times a leaf's tokens is every document twice and,
of the third epoch, the documents up to the cut, the last one in part.  The cut
is found by running sums over hash ranges of about a thousand documents and then
within the ranges, so a leaf with a third of all documents is spread over many
tasks.  Rows equal in id and text stand together in every order; where the cut
falls among them, running sums over blocks of them give each its part, so the
budget is met to the token however many there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, fresh, stash

RANGE_DOCS = 1024
TIED_BLOCK = 65_536
HASH_BITS = 60


def base_order(seed: int, ident: Column, text: Column) -> Column:
    """What a document's place in every epoch comes from: an MD5, as any SQL engine has it."""
    none = F.lit("-")
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), none), F.lit(":"), F.coalesce(text, none)))


def epoch_order(base: Column, epoch: Column) -> Column:
    """A document's place in an epoch: 60 bits."""
    digest = F.md5(F.concat(epoch.cast("string"), F.lit(":"), base))
    return F.conv(F.substring(digest, 1, HASH_BITS // 4), 16, 10).cast("long")


def _water_fill(children: DataFrame, parent: list[str], budget: str) -> DataFrame:
    """Adds ``share``: each child's part of its parent's budget, by ``weight`` up to ``supply``.

    Children of a parent whose weights are all zero share evenly; a zero weight
    beside others gets what those cannot take.
    """
    by = W.partitionBy(*parent)
    some = F.max(F.when(F.col("supply") > 0, F.col("weight")).otherwise(0.0)).over(by) > 0
    # a zero weight joins at the end of the queue: a tiny weight, far below any real one
    w = F.when(F.col("supply") <= 0, 0.0).when(some, F.greatest(F.col("weight"), F.lit(1e-12))).otherwise(1.0)
    c = children.withColumn("w", w).withColumn("ratio", F.when(F.col("w") > 0, F.col("supply") / F.col("w")).otherwise(0.0))
    queue = by.orderBy("ratio", "node")
    before = queue.rowsBetween(W.unboundedPreceding, -1)
    after = queue.rowsBetween(W.currentRow, W.unboundedFollowing)
    left = F.greatest(F.col(budget) - F.coalesce(F.sum("supply").over(before), F.lit(0.0)), F.lit(0.0))
    level = F.when(F.sum("w").over(after) > 0, left / F.sum("w").over(after)).otherwise(0.0)
    # at or past the first child whose supply is above the common level, all share that level
    c = c.withColumn("level", level).withColumn("fits", F.col("ratio") <= F.col("level"))
    full = F.min(F.col("fits").cast("int")).over(queue.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1
    c = c.withColumn("full", full)
    first = F.min(F.when(~F.col("full"), F.struct("ratio", "node", "level"))).over(by)
    c = c.withColumn("common", first["level"])
    return c.withColumn("share", F.when(F.col("full"), F.col("supply"))
                        .otherwise(F.least(F.col("w") * F.col("common"), F.col("supply")))) \
        .drop("w", "ratio", "level", "fits", "full", "common")


def leaf_budgets(leaves: DataFrame, levels: list[str], weights: dict[str, dict[str, float]], total: float,
                 max_epochs: int) -> DataFrame:
    """``leaves(*levels, tokens, ...)`` with the budget (tokens, long) of each.

    ``weights[level][node]`` is a child's weight among its siblings; nodes
    without an entry weigh 1.  The root's budget is ``total``, or all there is
    with every epoch used if that is less.
    """
    now = leaves.withColumn("leaf_supply", F.col("tokens").cast("double") * max_epochs)
    now = now.withColumn("budget", F.lit(float(total)))
    for depth, level in enumerate(levels):
        path, above = levels[:depth + 1], levels[:depth]
        given = weights.get(level, {})
        weight = F.lit(1.0)
        for node, w in given.items():
            weight = F.when(F.col(level) == node, F.lit(float(w))).otherwise(weight)
        # a level without ancestors is one group: the root's children
        nodes = now.groupBy(*path).agg(F.sum("leaf_supply").alias("supply"), F.first("budget").alias("budget")) \
            .withColumn("weight", weight).withColumn("node", F.col(level))
        shares = _water_fill(nodes, above or [F.lit(0)], "budget") \
            .select(*(F.col(p).alias(f"{p}_of") for p in path), F.col("share"))
        same = F.lit(True)
        for p in path:
            same = same & F.col(p).eqNullSafe(F.col(f"{p}_of"))
        now = now.join(shares, same).drop("budget", *(f"{p}_of" for p in path)).withColumnRenamed("share", "budget")
    return now.withColumn("budget", F.round("budget").cast("long")).drop("leaf_supply")


def mix(docs: DataFrame, levels: dict[str, Column], weights: dict[str, dict[str, float]], tokens: Column,
        total: float | None = None, max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id",
        text_col: str = "text", epochs_col: str = "epochs", part_col: str = "part_tokens") -> DataFrame:
    """``docs`` with the number of whole copies of each row the mixture takes, and a partial copy's tokens.

    ``levels`` names the tree's levels, root first, with the column that gives a
    row's node; ``tokens`` is a row's length (null: 0).  ``epochs`` is the number of
    times the row is used in whole, ``part_tokens`` how many leading tokens a
    further use has (0: none; only at a leaf's cut).  Without ``total`` the budget
    is the number of tokens there are.  A null node is a node of its own.  Rows
    with no tokens follow their neighbours in the order.  Rows equal in id and
    text share a place in the order; at a cut the first of them are used in
    whole, one in part and the others not.  All rows and columns come back, the
    two new ones last (with underscores appended to their names while the input
    has such columns); an empty table stays empty.
    """
    names = docs.columns
    own = {level: fresh(names, f"_mix_{level}") for level in levels}
    b_col = fresh(names, "_base")
    epochs_col, part_col = fresh(names, epochs_col), fresh(names, part_col)
    tokens = F.coalesce(tokens, F.lit(0)).cast("long")
    marked = docs.withColumns({**{own[level]: node.cast("string") for level, node in levels.items()},
                               b_col: base_order(seed, col(id_col), col(text_col))})
    path = list(own.values())
    slim = stash(marked.select(*path, tokens.alias("tokens"), F.col(b_col).alias("base")), "mix-docs")
    leaves = stash(slim.groupBy(*path).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")), "mix-leaves")
    if total is None:
        total = leaves.agg(F.sum("tokens")).first()[0] or 0
    budgets = leaf_budgets(leaves, path, {own[k]: v for k, v in weights.items() if k in own}, total, max_epochs)
    budgets = stash(budgets.withColumn("whole", F.when(F.col("tokens") > 0, F.floor(F.try_divide("budget", "tokens")))
                                       .otherwise(0).cast("long"))
                    .withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mix-budgets")
    cuts = _cuts(slim, budgets, path)

    plan = budgets.select(*(F.col(p).alias(f"{p}_p") for p in path), "whole", "rest")
    chosen = plan.join(cuts, _same([f"{p}_p" for p in path], [f"{p}_c" for p in path]), "left") \
        .drop(*(f"{p}_c" for p in path))
    leaf, w, r, cut, before, at, n, taken = (fresh([*names, *path], x) for x in (
        "_leaf", "_whole", "_rest", "_cut", "_before", "_at", "_n", "_taken"))
    # a table of leaves: written, its size is known and a small one is sent to the rows instead of the rows to it
    chosen = stash(chosen.select(
        *(F.col(f"{p}_p") for p in path), F.col("whole").alias(w), F.col("rest").alias(r), F.col("cut_h").alias(cut),
        F.col("cut_before").alias(before), F.col("cut_docs"), F.monotonically_increasing_id().alias(leaf)), "mix-plan")
    most = chosen.agg(F.max("cut_docs")).first()[0] or 0
    joined = marked.join(chosen.drop("cut_docs"), _same(path, [f"{p}_p" for p in path])) \
        .withColumn(at, epoch_order(F.col(b_col), F.col(w)))

    def finished(rows: DataFrame) -> DataFrame:
        more = F.when(F.col(at) < F.col(cut), 1).otherwise(0)
        # a last document that fits in whole is a whole copy
        ends = F.coalesce((F.col(taken) == F.col(n)) & (F.col(n) > 0), F.lit(False))
        return rows.select(
            *(col(c) for c in names), (F.col(w) + more + F.when(ends, 1).otherwise(0)).cast("int").alias(epochs_col),
            F.when(ends, 0).otherwise(F.coalesce(F.col(taken), F.lit(0))).cast("long").alias(part_col))

    # lengths are counted for the rows at a cut only
    here = F.col(at) == F.col(cut)
    counted = joined.withColumn(n, F.when(here, tokens))
    if most <= 1:
        return finished(counted.withColumn(taken, F.when(here, F.least(F.col(r) - F.col(before), F.col(n)))))
    # several rows at one cut: their running sums in the order in which they were written
    place, block, upto = (fresh(counted.columns, x) for x in ("_place", "_block", "_upto"))
    tied = stash(counted.filter(here).withColumn(place, F.monotonically_increasing_id()), "mix-tied")
    slim = tied.select(leaf, place, n, r, before, F.floor(F.col(place) / F.lit(TIED_BLOCK)).alias(block))
    sums = slim.groupBy(leaf, block).agg(F.sum(n).alias(upto))
    sums = sums.withColumn(upto, F.coalesce(F.sum(upto).over(
        W.partitionBy(leaf).orderBy(block).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    inside = F.coalesce(F.sum(n).over(W.partitionBy(leaf, block).orderBy(place).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.col(r) - F.col(before) - F.col(upto) - inside
    shares = slim.join(sums, [leaf, block]).select(place, F.greatest(F.lit(0), F.least(left, F.col(n))).alias(taken))
    others = counted.filter(~F.coalesce(here, F.lit(False))).withColumn(taken, F.lit(None).cast("long"))
    return finished(tied.join(shares, place)).unionByName(finished(others))


def _same(left: list[str], right: list[str]) -> Column:
    out = F.lit(True)
    for a, b in zip(left, right):
        out = out & F.col(a).eqNullSafe(F.col(b))
    return out


def _cuts(slim: DataFrame, budgets: DataFrame, path: list[str]) -> DataFrame:
    """Where each leaf's ``rest`` ends: the place in the epoch, the tokens before it, and the rows that have the place."""
    leaf = budgets.filter(F.col("rest") > 0).select(
        *(F.col(p).alias(f"{p}_c") for p in path), "rest", "whole",
        F.greatest(F.ceil(F.col("docs") / RANGE_DOCS), F.lit(1)).cast("long").alias("ranges"))
    key = [f"{p}_c" for p in path]
    span = F.lit(2.0 ** HASH_BITS)
    rows = slim.join(leaf, _same(path, key)).withColumn("h", epoch_order(F.col("base"), F.col("whole"))) \
        .select(*key, "rest", "tokens", "h",
                F.least(F.floor(F.col("h") / span * F.col("ranges")), F.col("ranges") - 1).alias("range"))
    sums = rows.groupBy(*key, "range").agg(F.sum("tokens").alias("in_range"), F.first("rest").alias("rest"))
    run = W.partitionBy(*key).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    at = sums.withColumn("start", F.coalesce(F.sum("in_range").over(run), F.lit(0)))
    hit = at.filter((F.col("start") < F.col("rest")) & (F.col("start") + F.col("in_range") >= F.col("rest"))) \
        .select(*(F.col(k).alias(f"{k}2") for k in key), F.col("range").alias("range2"), "start")
    near = rows.join(hit, _same(key, [f"{k}2" for k in key]) & (F.col("range") == F.col("range2")))
    ties = near.groupBy(*key, "h").agg(F.sum("tokens").alias("t"), F.count("*").alias("docs"),
                                       F.first("start").alias("start"), F.first("rest").alias("rest"))
    order = W.partitionBy(*key).orderBy("h").rowsBetween(W.unboundedPreceding, -1)
    placed = ties.withColumn("before", F.col("start") + F.coalesce(F.sum("t").over(order), F.lit(0)))
    return placed.filter((F.col("before") < F.col("rest")) & (F.col("before") + F.col("t") >= F.col("rest"))) \
        .select(*key, F.col("h").alias("cut_h"), F.col("before").alias("cut_before"), F.col("docs").alias("cut_docs"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text (runs without ASCII white space), a space between them."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return F.array_join(F.slice(words, F.lit(1), n.cast("int")), " ")


def take_copies(mixed: DataFrame, text_col: str | None = None, cut=first_words) -> DataFrame:
    """One row for each use of ``mix``'s rows; its two columns go.

    The partial use has the text that ``cut(text, tokens)`` leaves of it; without
    ``text_col`` it is a whole document too.
    """
    epochs_col, part_col = mixed.columns[-2:]
    partial = F.when(F.col(part_col) > 0, 1).otherwise(0)
    names = mixed.columns[:-2]
    copy = fresh(mixed.columns, "_copy")
    n = F.col(epochs_col) + partial
    uses = mixed.filter(n > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), n)))
    if text_col is not None:
        # only the last use of a row with a part is cut
        last = (F.col(copy) > F.col(epochs_col)) & (F.col(part_col) > 0)
        uses = uses.withColumn(text_col, F.when(last, cut(col(text_col), F.col(part_col))).otherwise(col(text_col)))
    return uses.select(*(col(c) for c in names))
