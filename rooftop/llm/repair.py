"""Conversation structure repair by weighted CYK interval parsing.

A well-formed conversation has the role initials ``(s?(ua)+)?``: a system turn at
most, then user and assistant in turns.  Its repair is the cheapest sequence of
edits of its rows that gives such initials:

    K keep 0,   R rerole to user or assistant 1,   D delete 2,   I insert an empty turn 5

Blank and repeated rows must go; a truncated row that stays adds 5.  Of equally
cheap repairs the one whose audit (the initials of its edits, in order) is least
in ASCII counts.

Grammar
-------
The nonterminal ``[p, q]`` spans rows that lead the pattern's automaton from
state p to q (0 start, 1 after s, 2 after u, 3 after a).  In Chomsky normal form:
``[p, q] -> [p, r] [r, q]``; ``[p, q] -> row`` where the row, kept or reroled, is
a step from p to q; ``[p, p] -> row`` for a deleted one.  Inserted turns are empty
spans: every cell is closed under them on both sides.  A cell holds the least
(cost, audit) for each nonterminal.

Cells are combined bottom-up by span length: 1, 2, 4, ... rows.  One split point
a span is enough, since a derivation of [p, q] passes some state r at *every*
split point, so all split points give the same minimum.  Least audits combine
as well: of two audits of equal cost over the same rows neither is a proper
prefix of the other (it would need another insertion, which costs), so the
order of two audits holds whatever follows.

Scale
-----
Rows are ordered by range partitions over (conversation, turn, role, text hash,
place), so a conversation with most of the rows is spread over tasks, each of
which streams its part and keeps a cell per ``SPAN`` rows.  Conversations in one
cell are finished there; the cells of others meet in rounds of bounded groups,
and their states are handed down again.  Only ids, flags and hashes take part;
texts are joined to the edits at the end.  Repeats are found by the first place
of each (conversation, role, text hash), a combinable minimum.

Defined results: null role or text counts as one space, a null conversation is
one like any other, null turns come first; rows equal in turn stand by role,
then text hash; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, stash

SPAN = 256
ROWS_PER_RANGE = 200_000
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5

# -- the grammar ---------------------------------------------------------------
STEPS = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
PAIRS = ((0, 0), (0, 1), (0, 2), (0, 3), (1, 1), (1, 2), (1, 3), (2, 2), (2, 3), (3, 2), (3, 3))
_AT = {p: i for i, p in enumerate(PAIRS)}
# binary rules by the nonterminal they give: (its place, [(left, right), ...])
RULES = tuple((i, tuple((_AT[p, r], _AT[r, q]) for r in range(4) if (p, r) in _AT and (r, q) in _AT))
              for i, (p, q) in enumerate(PAIRS))
ACCEPT = (_AT[0, 0], _AT[0, 3])
Cell = list  # of (cost, audit) or None, one for each of PAIRS


def combine(left: Cell, right: Cell) -> Cell:
    """The cell of two adjacent spans."""
    out: Cell = [None] * len(PAIRS)
    for at, rules in RULES:
        best = None
        for i, j in rules:
            x, y = left[i], right[j]
            if x is None or y is None:
                continue
            cost = x[0] + y[0]
            if best is None or cost < best[0]:
                best = (cost, x[1] + y[1])
            elif cost == best[0]:
                audit = x[1] + y[1]
                if audit < best[1]:
                    best = (cost, audit)
        out[at] = best
    return out


def _insertions() -> Cell:
    """The cell of the empty span: no turn, or inserted ones."""
    cell: Cell = [(0, "") if p == q else None for p, q in PAIRS]
    for role in "ua":
        for step in STEPS[role]:
            cell[_AT[step]] = (INSERT, "I")
    while (more := combine(cell, cell)) != cell:
        cell = more
    return cell


EMPTY = _insertions()


def row_cell(symbol: str) -> Cell:
    """The closed cell of one row: ``d`` to be deleted, else its initial (``x``: another), upper case if truncated."""
    cell: Cell = [(DELETE, "D") if p == q else None for p, q in PAIRS]
    if symbol != "d":
        more, initial = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for role, steps in STEPS.items():
            for step in steps:
                if role == initial:
                    cell[_AT[step]] = (KEEP + more, "K")
                elif role != "s":
                    cell[_AT[step]] = (REROLE + more, "R")
    return combine(combine(EMPTY, cell), EMPTY)


ROW_CELLS = {s: row_cell(s) for s in "dsuaxSUAX"}


def parse(symbols: str) -> Cell:
    """The cell of a span of rows, combined bottom-up by span length."""
    cells = [ROW_CELLS[s] for s in symbols] or [EMPTY]
    while len(cells) > 1:
        cells = [combine(*cells[i:i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


def states(cells: list[Cell], start: int, end: int) -> list[int]:
    """The states between adjacent spans in the least (cost, audit) from ``start`` to ``end``."""
    # best way to reach each state after each span, as (cost, audit, states so far)
    best = {start: (0, "", [start])}
    for cell in cells:
        reached: dict[int, tuple] = {}
        for r, (cost, audit, way) in best.items():
            for q in range(4):
                x = cell[_AT[r, q]] if (r, q) in _AT else None
                if x is not None:
                    new = (cost + x[0], audit + x[1], [*way, q])
                    if q not in reached or new[:2] < reached[q][:2]:
                        reached[q] = new
        best = reached
    return best[end][2]


def edits(symbols: str, audit: str, state: int) -> Iterator[tuple[str, int | None, str | None]]:
    """(edit, place of its row, new role) of an audit that starts in ``state``."""
    at = 0
    for edit in audit:
        row, role = None, None
        if edit != "I":
            row, at = at, at + 1
        if edit == "K":
            state = dict(STEPS[symbols[row].lower()])[state]
        elif edit != "D":
            role = "assistant" if state == 2 else "user"
            state = dict(STEPS[role[0]])[state]
        yield edit, row, role


# -- rows ----------------------------------------------------------------------
def damage(conversations: DataFrame) -> DataFrame:
    """Rows dropped, emptied, cut, repeated or given a role by the CRC-32 of ``conv_id:turn`` modulo 20."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(col("turn").cast("string"), blank))
    kind = F.crc32(key) % F.lit(20)
    text = F.coalesce(col("text"), blank)
    return conversations.select(
        col("conv_id").alias("conv_id"), col("turn").alias("turn"),
        F.when(kind == 4, F.lit("user")).otherwise(F.coalesce(col("role"), blank)).alias("role"),
        F.when(kind == 1, F.lit("")).when(kind == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        kind.alias("kind")) \
        .filter(F.col("kind") != 0) \
        .select("conv_id", "turn", "role", "text",
                F.explode(F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1)))).drop("col")


def group_key(c: Column) -> Column:
    """A text that is never null and tells all conversations apart."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def _symbols(rows: DataFrame) -> DataFrame:
    """key, turn, role, hash, place, and what the grammar sees of each row: its fault and symbol."""
    trimmed = F.rtrim(F.col("text"), F.lit(SPACE))
    slim = rows.select(
        "key", "turn", "role", F.sha2(F.col("text").cast("binary"), 256).alias("hash"), "place",
        (trimmed == "").alias("empty"), (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("open"))
    # the earliest place of each text in its conversation; the others repeat it
    first = slim.groupBy("key", "role", "hash").agg(F.min(F.struct("turn", "place")).alias("m")) \
        .select(F.col("m.place").alias("place"), F.lit(True).alias("first"))
    initial = F.substring("role", 1, 1)
    fault = F.when(F.col("empty"), F.lit("blank")).when(F.col("first").isNull(), F.lit("duplicate")) \
        .when(F.col("open"), F.lit("truncated"))
    letter = F.when(initial.isin(*STEPS), initial).otherwise(F.lit("x"))
    return slim.join(first, "place", "left").select(
        "key", "turn", "role", "hash", "place", fault.alias("fault"), initial.alias("initial"),
        F.when(fault.isin("blank", "duplicate"), F.lit("d")).when(fault == "truncated", F.upper(letter))
        .otherwise(letter).alias("symbol"))


# -- cells ---------------------------------------------------------------------
_VALUES = "costs array<bigint>, audits array<string>, illegal bigint, first string, last string"
_CELLS = f"key string, ord bigint, whole boolean, places array<bigint>, symbols string, {_VALUES}"
_JOINED = f"key string, ord bigint, children array<bigint>, ways array<binary>, {_VALUES}"
_LIST = pa.list_(pa.int64())
_VALUE_TYPES = [("costs", _LIST), ("audits", pa.list_(pa.string())), ("illegal", pa.int64()), ("first", pa.string()),
                ("last", pa.string())]
LEGAL = frozenset({"su", "ua", "au"})


def _values(cell: Cell, illegal: int, first: str, last: str) -> tuple:
    return [x and x[0] for x in cell], [x and x[1] for x in cell], illegal, first, last


def _batch(rows: list[tuple], head: list) -> pa.RecordBatch:
    types = [*head, *_VALUE_TYPES]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(types)],
                                      names=[n for n, _ in types])


def _span_cells(span: int):
    """Streams sorted rows of a partition into a cell for each ``span`` rows of a conversation."""
    head = [("key", pa.string()), ("ord", pa.int64()), ("whole", pa.bool_()), ("places", _LIST), ("symbols", pa.string())]

    def cell(key, start, whole, places, symbols, initials):
        illegal = sum(x + y not in LEGAL for x, y in zip(initials, initials[1:]))
        return (key, start, whole, places, symbols, *_values(parse(symbols), illegal, initials[0], initials[-1]))

    def stream(batches):
        out, key, rows, start, at, part = [], None, [], 0, 0, 0
        alone = False  # the conversation began in this partition and has no cell yet
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("key", "place", "symbol", "initial", "part")]
            for k, *row, part in zip(*columns):
                if rows and (k != key or len(rows) == span):
                    out.append(cell(key, start, alone and k != key, *_unzip(rows)))
                    alone, rows = False, []
                    if len(out) >= 2000:
                        yield _batch(out, head)
                        out = []
                if k != key:
                    alone, key = key is not None, k
                if not rows:
                    start = (part << 33) + at
                rows.append(row)
                at += 1
        if rows:
            out.append(cell(key, start, False, *_unzip(rows)))
        if out:
            yield _batch(out, head)
    return stream


def _unzip(rows):
    places, symbols, initials = zip(*rows)
    return list(places), "".join(symbols), list(initials)


def _cells_of(table) -> list[Cell]:
    return [[None if c is None else (c, a) for c, a in zip(cs, audits)]
            for cs, audits in zip(table["costs"].to_pylist(), table["audits"].to_pylist())]


def _join_cells(shift: int):
    """The cell of adjacent spans of one conversation, and the states between them for each nonterminal."""
    head = [("key", pa.string()), ("ord", pa.int64()), ("children", _LIST), ("ways", pa.list_(pa.binary()))]

    def join(table):
        table = table.sort_by("ord")
        cells, order = _cells_of(table), table["ord"].to_pylist()
        firsts, lasts = table["first"].to_pylist(), table["last"].to_pylist()
        whole = list(cells)
        while len(whole) > 1:
            whole = [combine(*whole[i:i + 2]) if i + 1 < len(whole) else whole[i] for i in range(0, len(whole), 2)]
        ways = [bytes(states(cells, p, q)) if whole[0][i] else None for i, (p, q) in enumerate(PAIRS)]
        illegal = sum(table["illegal"].to_pylist()) + sum(x + y not in LEGAL for x, y in zip(lasts, firsts[1:]))
        row = (table["key"][0].as_py(), order[0] >> shift << shift, order, ways,
               *_values(whole[0], illegal, firsts[0], lasts[-1]))
        return pa.Table.from_batches([_batch([row], head)])
    return join


def _choice(df: DataFrame) -> DataFrame:
    """Add ``pair``: the better of the accepting nonterminals."""
    (a, b), costs, audits = ACCEPT, F.col("costs"), F.col("audits")
    worse = (costs[b] > costs[a]) | ((costs[b] == costs[a]) & (audits[b] > audits[a]))
    return df.withColumn("pair", F.when(worse, F.lit(a)).otherwise(F.lit(b)))


def _edit_rows(batches):
    """The edits of each cell whose nonterminal ``pair`` is chosen."""
    for batch in batches:
        out = []
        columns = [batch.column(c).to_pylist() for c in ("key", "ord", "places", "symbols", "audit", "pair")]
        for key, order, places, symbols, audit, pair in zip(*columns):
            for k, (edit, row, role) in enumerate(edits(symbols, audit, PAIRS[pair][0])):
                out.append((key, order, k, None if row is None else places[row], edit, role))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[i] for r in out], t) for i, t in enumerate(
                (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))],
            names=["key", "ord", "k", "place", "edit", "role"])


@dataclass(frozen=True)
class Repair:
    """``report``: a row per conversation (key, faults, cost, audit); ``rows``: the repaired
    rows (key, ord, k for their order, edit, role, text)."""

    report: DataFrame
    rows: DataFrame


def repair(conversations: DataFrame, span: int = SPAN, rows_per_range: int = ROWS_PER_RANGE) -> Repair:
    """Parse and repair conversations (conv_id, turn, role, text; see module doc)."""
    rows = stash(conversations.select(
        group_key(col("conv_id")).alias("key"), col("turn").alias("turn"),
        F.coalesce(col("role"), F.lit(" ")).alias("role"), F.coalesce(col("text"), F.lit(" ")).alias("text"),
        F.monotonically_increasing_id().alias("place")), "repair-rows")
    seen = stash(_symbols(rows), "repair-symbols")
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(seen.count() / rows_per_range))
    order = [F.col(c).asc_nulls_first() for c in ("key", "turn", "role", "hash", "place")]
    cells = stash(
        seen.repartitionByRange(parts, *order).sortWithinPartitions(*order)
        .select("key", "place", "symbol", "initial", F.spark_partition_id().cast("long").alias("part"))
        .mapInArrow(_span_cells(span), _CELLS), "repair-cells")

    # conversations of several cells: joined in rounds, within a partition, then over 64 of them and so on
    parts_of, rounds, shift = cells.filter(~F.col("whole")), [], 33
    while True:
        joined = stash(parts_of.select("key", "ord", "costs", "audits", "illegal", "first", "last")
                       .groupBy("key", F.shiftright("ord", shift).alias("bucket"))
                       .applyInArrow(_join_cells(shift), _JOINED), "repair-joined")
        rounds.append(joined)
        parts_of, shift = joined, shift + 6
        if joined.groupBy("key").count().filter(F.col("count") > 1).isEmpty():
            break
    tops = _choice(cells.filter("whole").select("key", "costs", "audits", "illegal")
                   .unionByName(joined.select("key", "costs", "audits", "illegal")))
    parsed = tops.select("key", "illegal", F.get("costs", "pair").alias("cost"), F.get("audits", "pair").alias("audit"))

    # the states handed down: from a joined cell to its children
    chosen = _choice(joined.select("key", "ord", "costs", "audits")).select("key", "ord", "pair")
    names = F.create_map(*[x for i, (p, q) in enumerate(PAIRS) for x in (F.lit(f"{p:02X}{q:02X}"), F.lit(i))])
    for joined in reversed(rounds):
        down = joined.select("key", "ord", "children", "ways").join(chosen, ["key", "ord"]) \
            .select("key", F.hex(F.get("ways", "pair")).alias("way"), F.posexplode("children").alias("n", "child"))
        chosen = down.select("key", F.col("child").alias("ord"),
                             names[F.substring("way", F.col("n") * 2 + 1, F.lit(4))].alias("pair"))
    ends = ["key", "ord", "places", "symbols", F.get("audits", "pair").alias("audit"), "pair"]
    picked = _choice(cells.filter("whole")).select(*ends).unionByName(
        cells.filter(~F.col("whole")).join(chosen, ["key", "ord"]).select(*ends))
    edited = stash(picked.mapInArrow(_edit_rows, "key string, ord bigint, k int, place bigint, edit string, role string"),
                   "repair-edits")

    kept = edited.filter(F.col("edit").isin("K", "R")).withColumnRenamed("role", "new") \
        .join(rows.select("place", "role", "text"), "place") \
        .select("key", "ord", "k", "edit", F.coalesce("new", "role").alias("role"), "text")
    inserted = edited.filter(F.col("edit") == "I").select("key", "ord", "k", "edit", "role", F.lit("").alias("text"))

    faults = seen.groupBy("key").agg(
        *[F.count(F.when(F.col("fault") == f, 1)).alias(f) for f in ("blank", "duplicate", "truncated")],
        (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).alias("gaps"))
    return Repair(faults.join(parsed, "key"), kept.unionByName(inserted))


def _digests(batches):
    """Streams sorted pieces of texts into a SHA-256 of each key's, joined by newlines."""
    key, digest, out = None, None, []

    def batch():
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.string()) for i in (0, 1)],
                                          names=["key", "repaired_sha256"])

    for b in batches:
        for k, piece in zip(b.column("key").to_pylist(), b.column("piece").to_pylist()):
            if k != key:
                if digest is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = k, hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(piece.encode())
        if out:
            yield batch()
            out = []
    if digest is not None:
        out.append((key, digest.hexdigest()))
        yield batch()


def text_digests(rows: DataFrame) -> DataFrame:
    """key, repaired_sha256 of ``role:text`` lines in order.  A digest runs over its text in sequence, so a
    conversation's rows are sorted and streamed through one task, which holds one batch of them."""
    pieces = rows.select("key", "ord", "k", F.concat("role", F.lit(":"), "text").alias("piece"))
    return pieces.repartition("key").sortWithinPartitions("key", "ord", "k").select("key", "piece") \
        .mapInArrow(_digests, "key string, repaired_sha256 string")


def repair_damaged(conversations: DataFrame, span: int = SPAN, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """Damage the conversations, repair them, and report on every original one (see ``damage`` and ``repair``).

    A conversation without rows after the damage has zeros, an empty audit and
    the digest of the empty text.
    """
    fixed = repair(damage(conversations), span, rows_per_range)
    ids = conversations.select(col("conv_id").alias("conv_id")).distinct().withColumn("key", group_key(F.col("conv_id")))
    out = ids.join(fixed.report, "key", "left").join(text_digests(fixed.rows), "key", "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "conv_id", *[F.coalesce(F.col(c).cast("long"), zero).alias(c)
                     for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"))
