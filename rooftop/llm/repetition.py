"""Quality rules on repetition: characters inside duplicated word n-grams and lines.

Each Arrow batch is cut into blocks of texts of a bounded size (a longer text
is a block of its own).  Words get numbers that no other text of the block
shares, so an n-gram's number sequence is equal only to itself within its text.
Two n-gram measures follow:

* the three-word windows of the base rule are compared exactly (pairs are
  ranked, then ranked again with the third word);
* the windows of ``N_GRAM_LIMITS`` words are compared by a 64-bit rolling hash over
  random word codes, each length made from the one before by one multiply-add.

A word is covered if it lies in a window found twice or more in its text (the
first one included); a length's coverage is the share of word characters
covered.  The thresholds fall with the length, because longer repeats are less
often accidental.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, fresh

SYMBOLS = b"#*$%&|<>"
# Three times the published duplicate n-gram limits, which count
# copies after the first only; here the first is counted too, and a short text
# with one line given twice is to stay.
N_GRAM_LIMITS = {5: 0.45, 6: 0.42, 7: 0.39, 8: 0.36, 9: 0.33, 10: 0.30}
DUP_LINE_LIMIT = 0.30
MIN_WORDS = 50
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _codes(numbers: np.ndarray) -> np.ndarray:
    """A pseudo-random 64-bit code for each number (splitmix64)."""
    x = numbers.astype(np.uint64) * MULTIPLIER + np.uint64(0x632BE59BD9B4E019)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _repeated(keys: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Those of the window starts whose key occurs twice or more; rising."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = s[1:] == s[:-1]
    hit = np.zeros(keys.size, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    return starts[hit]


def _longer(starts: np.ndarray, left: np.ndarray, n: int) -> np.ndarray:
    """Starts of n-word windows that can repeat: both their (n-1)-word windows do, and the text goes on."""
    both = starts[:-1][starts[1:] == starts[:-1] + 1]
    return both[left[both] >= n]


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words that lie in one of the windows of n words."""
    steps = np.zeros(size + 1, dtype=np.int32)
    steps[starts] += 1
    np.subtract.at(steps, starts + n, 1)
    return np.cumsum(steps[:-1]) > 0


def _per_text(values: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[first + count] - total[first]


def word_chars_of(word: bytes) -> int:
    return len(word) if word.isascii() else len(word.decode("utf-8", "replace"))


def measure_block(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of each text of a block; every array has one entry a text."""
    numbers: list[int] = []
    chars_of: list[int] = []
    count = np.zeros(len(texts), dtype=np.int64)
    symbols = np.zeros(len(texts), dtype=np.int64)
    dup_lines = np.zeros(len(texts), dtype=np.int64)
    dup_line_chars = np.zeros(len(texts), dtype=np.int64)
    for i, text in enumerate(texts):
        words = text.split()
        count[i] = len(words)
        base = len(chars_of)
        own = {w: base + k for k, w in enumerate(dict.fromkeys(words))}
        numbers += [own[w] for w in words]
        chars_of += [word_chars_of(w) for w in own]
        symbols[i] = len(text) - len(text.translate(None, SYMBOLS))
        if b"\n" in text:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if line in seen:
                    dup_lines[i] += 1
                    dup_line_chars[i] += sum(map(word_chars_of, line.split()))
                elif line.strip():
                    seen.add(line)
    ids = np.array(numbers, dtype=np.int64)
    chars = np.array(chars_of, dtype=np.int64)[ids] if ids.size else ids
    first = np.cumsum(count) - count
    left = np.repeat(first + count, count) - np.arange(ids.size)  # words from here to the text's end
    out = {"n_words": count, "word_chars": _per_text(chars, first, count), "n_symbols": symbols,
           "n_dup_lines": dup_lines, "dup_line_chars": dup_line_chars}

    # a window repeats only if both windows shorter by a word do, so each length
    # looks only where the last one found repeats; numbers of three words are exact
    many = max(1, len(chars_of))
    starts = np.flatnonzero(left >= 2)
    starts = _repeated(ids[starts] * many + ids[starts + 1], starts)
    starts = _longer(starts, left, 3)
    if starts.size:
        pair = np.unique(ids[starts] * many + ids[starts + 1], return_inverse=True)[1].astype(np.int64)
        starts = _repeated(pair * many + ids[starts + 2], starts)
    out["n_repeat_words"] = _per_text(_covered(starts, 3, ids.size), first, count)

    codes = _codes(ids)
    rolling = (codes[:-2] * MULTIPLIER + codes[1:-1]) * MULTIPLIER + codes[2:]
    for n in range(4, max(N_GRAM_LIMITS) + 1):
        rolling = rolling[:-1] * MULTIPLIER + codes[n - 1:]
        starts = _longer(starts, left, n)
        starts = _repeated(rolling[starts], starts)
        if n in N_GRAM_LIMITS:
            out[f"dup_{n}_gram_chars"] = _per_text(chars * _covered(starts, n, ids.size), first, count)
    return out


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars",
            *(f"dup_{n}_gram_chars" for n in N_GRAM_LIMITS))


def _blocks(texts: list[bytes], most: int) -> Iterator[list[bytes]]:
    block: list[bytes] = []
    held = 0
    for t in texts:
        if block and held + len(t) > most:
            yield block
            block, held = [], 0
        block.append(t)
        held += len(t)
    if block:
        yield block


def repetition_measures(text: Column, block_bytes: int = 2 << 20) -> Column:
    """A struct of longs with ``MEASURES`` for each text; a null text counts as empty."""

    @F.arrow_udf("struct<" + ", ".join(f"{m}: long" for m in MEASURES) + ">")
    def measures(texts: pa.Array) -> pa.Array:
        raw = [t or b"" for t in texts.cast(pa.binary()).to_pylist()]
        parts = [measure_block(b) for b in _blocks(raw, block_bytes)]
        columns = [np.concatenate([p[m] for p in parts]) if parts else np.zeros(0, dtype=np.int64) for m in MEASURES]
        return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(MEASURES))

    return measures(text)


def base_failed(m: Column) -> Column:
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def too_repetitive(m: Column, n_gram_limits: dict[int, float] | None = None,
                   dup_line_limit: float = DUP_LINE_LIMIT) -> Column:
    """The method's verdict: some length's covered share, or the duplicated lines' share, is over its limit."""
    limits = N_GRAM_LIMITS if n_gram_limits is None else n_gram_limits
    verdict = m["dup_line_chars"] > dup_line_limit * m["word_chars"]
    for n, limit in limits.items():
        verdict = verdict | (m[f"dup_{n}_gram_chars"] > limit * m["word_chars"])
    return verdict


def judge_repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, measures..., base_failed, kept) for every row.

    A null or empty text has no words, so it fails the base rule.  Ids may be
    null or repeated; other columns are ignored; an empty table gives no rows.
    """
    m = docs.select(col(id_col).alias("id_"), repetition_measures(col(text_col)).alias("m_"))
    failed = base_failed(F.col("m_"))
    return m.select(F.col("id_").alias(id_col), *(F.col("m_")[c].alias(c) for c in MEASURES),
                    failed.alias("base_failed"), (~failed & ~too_repetitive(F.col("m_"))).alias("kept"))


def keep_unrepetitive(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that both the base rule and the method keep, all columns as they are."""
    m = fresh(docs.columns, "_measures")
    judged = docs.withColumn(m, repetition_measures(col(text_col)))
    return judged.filter(~base_failed(F.col(m)) & ~too_repetitive(F.col(m))).select(*(col(c) for c in docs.columns))
