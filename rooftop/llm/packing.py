"""Hierarchical multi-length packing of token documents into training windows.

Windows have several sizes (tiers), powers of two up to the context size.  Each
task streams its documents and packs them a block at a time:

1. Cut: whole windows of the largest tier are cut off a long document; what is
   left goes to the smallest tier that holds it.
2. Pack: within each tier, longest first, pieces go to the open window with the
   least room that takes them (best fit).
3. Fill: the gaps of each window, largest tiers first, are filled with the
   longest pieces of shorter tiers that fit; a gap that no piece fits takes the
   head of one, whose rest goes back to its tier.
4. What the last windows of a block could not fill is carried to the next block
   of the task; at the task's end it goes to windows of falling tier sizes that
   it fills exactly, and fewer ids than the smallest tier make one padded window.
5. Step groups: full windows are dealt to optimizer steps of about
   ``step_tokens`` ids, most expensive first to the step with the least
   attention cost so far, so steps of a block are balanced.

A task needs no other task's rows, so nothing is shuffled and a retried task
gives the same pieces.  Padding is at most one window for each task.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, fresh
from .tokens import WORD_VOCABULARY, word_encoder

TIERS = (256, 512, 1024, 2048, 4096)
END_ID = 2


@dataclass
class Window:
    """A window of ``size`` ids and its pieces (document, start, length) in order."""

    size: int
    pieces: list[tuple[int, int, int]] = field(default_factory=list)
    used: int = 0

    def put(self, piece: tuple[int, int, int]) -> None:
        self.pieces.append(piece)
        self.used += piece[2]


class Shelf:
    """Pieces of one tier, longest findable by length."""

    def __init__(self) -> None:
        self.lengths: list[int] = []
        self.by_length: dict[int, list[tuple[int, int]]] = {}

    def add(self, doc: int, start: int, length: int) -> None:
        stack = self.by_length.setdefault(length, [])
        if not stack:
            insort(self.lengths, length)
        stack.append((doc, start))

    def longest(self, most: int) -> int:
        """The largest length of at most ``most``, or 0."""
        i = bisect_left(self.lengths, most + 1)
        return self.lengths[i - 1] if i else 0

    def take(self, length: int) -> tuple[int, int, int]:
        stack = self.by_length[length]
        doc, start = stack.pop()
        if not stack:
            self.lengths.pop(bisect_left(self.lengths, length))
            del self.by_length[length]
        return doc, start, length


def route(lengths: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[Window], dict[int, Shelf]]:
    """Whole windows cut off long pieces, and the rests on their tier's shelf."""
    top = tiers[-1]
    full: list[Window] = []
    shelves = {t: Shelf() for t in tiers}
    for doc, start, length in lengths:
        while length >= top:
            w = Window(top)
            w.put((doc, start, top))
            full.append(w)
            start, length = start + top, length - top
        if length:
            shelves[tiers[bisect_left(tiers, length)]].add(doc, start, length)
    return full, shelves


def pack_tier(shelf: Shelf, size: int) -> list[Window]:
    """Best fit, longest first: the open window with the least room that takes the piece."""
    windows: list[Window] = []
    rooms: list[tuple[int, int]] = []  # (room, window), sorted
    while shelf.lengths:
        piece = shelf.take(shelf.lengths[-1])
        i = bisect_left(rooms, (piece[2], -1))
        if i < len(rooms):
            room, k = rooms.pop(i)
        else:
            room, k = size, len(windows)
            windows.append(Window(size))
        windows[k].put(piece)
        if room > piece[2]:
            insort(rooms, (room - piece[2], k))
    return windows


def fill_gaps(windows: list[Window], tier: int, shelves: dict[int, Shelf], tiers: tuple[int, ...]) -> None:
    """Fill the windows of a tier from shorter tiers: longest fitting piece first, then a cut one."""
    shorter = [t for t in reversed(tiers) if t < tier]
    for w in windows:
        while w.used < w.size:
            room = w.size - w.used
            best = max((shelves[t].longest(room), t) for t in shorter) if shorter else (0, 0)
            if best[0]:
                w.put(shelves[best[1]].take(best[0]))
                continue
            source = next((t for t in reversed(shorter) if shelves[t].lengths), None)
            if source is None:
                break
            doc, start, length = shelves[source].take(shelves[source].lengths[0])
            w.put((doc, start, room))
            rest = length - room
            shelves[tiers[bisect_left(tiers, rest)]].add(doc, start + room, rest)


def pack_block(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[Window], list]:
    """Full windows, and the pieces of those that could not be filled."""
    done, shelves = route(pieces, tiers)
    rest: list[tuple[int, int, int]] = []
    for tier in reversed(tiers):
        windows = pack_tier(shelves[tier], tier)
        fill_gaps(windows, tier, shelves, tiers)
        # windows of one tier that stay short: the fullest first take from the emptiest
        short = sorted((w for w in windows if w.used < w.size), key=lambda w: -w.used)
        done += [w for w in windows if w.used == w.size]
        spare = [p for w in reversed(short) for p in w.pieces]
        rest += spare
    full, rest = fill_exactly(rest, tiers[-1])
    return done + full, rest


def fill_exactly(pieces: list[tuple[int, int, int]], size: int) -> tuple[list[Window], list]:
    """Windows of ``size`` filled by cutting pieces in order; the last ids that fill none come back."""
    total = sum(p[2] for p in pieces)
    windows: list[Window] = []
    pieces = pieces[::-1]
    while total >= size:
        w = Window(size)
        while w.used < size:
            doc, start, length = pieces.pop()
            take = min(length, size - w.used)
            w.put((doc, start, take))
            if take < length:
                pieces.append((doc, start + take, length - take))
        windows.append(w)
        total -= size
    return windows, pieces[::-1]


def last_windows(pieces: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> list[Window]:
    """Falling tiers filled exactly; a rest below the smallest tier is one window padded to the largest."""
    out: list[Window] = []
    for tier in reversed(tiers):
        full, pieces = fill_exactly(pieces, tier)
        out += full
    if pieces:
        w = Window(tiers[-1])
        for p in pieces:
            w.put(p)
        out.append(w)
    return out


def step_groups(windows: list[Window], step_tokens: int) -> list[int]:
    """A step for each window: as many steps as the ids fill, costs balanced greedily."""
    steps = max(1, round(sum(w.size for w in windows) / step_tokens))
    heap = [(0, s) for s in range(steps)]
    out = [0] * len(windows)

    def cost(w: Window) -> int:  # attention within each piece, plus the dense layers' share per id
        return sum(p[2] * p[2] for p in w.pieces) + 4096 * w.size

    costs = [cost(w) for w in windows]
    for k in sorted(range(len(windows)), key=lambda k: (-costs[k], k)):
        so_far, s = heapq.heappop(heap)
        out[k] = s
        heapq.heappush(heap, (so_far + costs[k], s))
    return out


PIECE_SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, " \
               "window_size int, step_group long"


def _packer(vocabulary: str, tiers: tuple[int, ...], end_id: int, block_tokens: int, step_tokens: int, id_name: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_encoder(vocabulary).encode, np.array([end_id], dtype="<u4").tobytes()
        context = TaskContext.get()
        # ids unique over all tasks: the partition number above, a counter below
        base = (context.partitionId() if context else 0) << 36
        made = steps_made = 0
        ids: dict[int, np.ndarray] = {}
        key_of: dict[int, object] = {}
        waiting: list[tuple[int, int, int]] = []
        held = next_doc = 0

        def rows(windows: list[Window]) -> pa.RecordBatch:
            nonlocal made, steps_made
            cols: list[list] = [[] for _ in range(9)]
            groups = step_groups(windows, step_tokens)
            for w, g in zip(windows, groups):
                at = 0
                for doc, start, length in w.pieces:
                    for c, v in zip(cols, (key_of[doc], start, length, ids[doc][start:start + length].tobytes(),
                                           ids[doc].size, base + made, at, w.size, base + steps_made + g)):
                        c.append(v)
                    at += length
                made += 1
            steps_made += max(groups, default=-1) + 1
            kinds = [key_type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(),
                     pa.int32(), pa.int64()]
            names = [id_name, "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window_size",
                     "step_group"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

        def parts(windows: list[Window]) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(windows), 512):
                yield rows(windows[i:i + 512])

        key_type = pa.int64()
        for batch in batches:
            key_type = batch.column(0).type
            for key, text in zip(batch.column(0), batch.column(1)):
                got = np.frombuffer(encode(text.as_py() or "") + end, dtype="<u4")
                ids[next_doc] = got
                key_of[next_doc] = key.as_py()
                waiting.append((next_doc, 0, got.size))
                held += got.size
                next_doc += 1
                if held >= block_tokens:
                    full, waiting = pack_block(waiting, tiers)
                    yield from parts(full)
                    kept = {p[0] for p in waiting}
                    ids = {k: v for k, v in ids.items() if k in kept}
                    key_of = {k: v for k, v in key_of.items() if k in kept}
                    held = sum(p[2] for p in waiting)
        full, waiting = pack_block(waiting, tiers)
        yield from parts(full + last_windows(waiting, tiers))
    return pack


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tiers: tuple[int, ...] = TIERS,
                   end_id: int = END_ID, vocabulary: str = WORD_VOCABULARY, block_tokens: int = 1 << 20,
                   step_tokens: int = 1 << 17) -> DataFrame:
    """Pieces of all documents, one row per piece.

    Columns: the id, ``start`` and ``length`` (ids before the piece in its
    document, ids in it), ``ids`` (binary, little-endian unsigned 32 bits),
    ``doc_tokens``, ``sequence_id`` (unique window), ``offset`` in the window,
    ``window_size`` (a tier; a window that is not full is padded to it) and
    ``step_group``.  A null or empty text is its end id alone.  Repeated rows
    and null ids are packed like any other; other columns are ignored; an empty
    table gives no rows.  A text of any length is packed whole.
    """
    if list(tiers) != sorted(set(tiers)) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    out_id = id_col if fresh(PIECE_SCHEMA.replace(",", "").split(), id_col) == id_col else f"{id_col}_"
    slim = docs.select(col(id_col).alias(out_id), col(text_col).alias("text_"))
    kind = slim.schema[out_id].dataType.simpleString()
    return slim.mapInArrow(_packer(vocabulary, tuple(tiers), end_id, block_tokens, step_tokens, out_id),
                           f"`{out_id}` {kind}, {PIECE_SCHEMA}")


def piece_crc32(pieces: DataFrame) -> DataFrame:
    """The pieces with ``ids_crc32`` in place of ``ids``."""
    return pieces.withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")
