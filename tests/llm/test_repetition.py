from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from rooftop.llm import repetition as R

from .conftest import SF, with_clashes


def words_of(text):
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def covered(words, n):
    grams = [tuple(words[i:i + n]) for i in range(len(words) - n + 1)]
    count = Counter(grams)
    return {j for i, g in enumerate(grams) if count[g] > 1 for j in range(i, i + n)}


def brute(text):
    text = text or ""
    words = words_of(text)
    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if words_of(line):
            if line in seen:
                dup += 1
                dup_chars += sum(map(len, words_of(line)))
            seen.add(line)
    out = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(c in "#*$%&|<>" for c in text),
           "n_dup_lines": dup, "dup_line_chars": dup_chars, "n_repeat_words": len(covered(words, 3))}
    for n in R.N_GRAM_LIMITS:
        out[f"dup_{n}_gram_chars"] = sum(len(words[i]) for i in covered(words, n))
    out["base_failed"] = len(words) < 50 or 100 * out["n_repeat_words"] > 50 * len(words)
    bad = out["dup_line_chars"] > R.DUP_LINE_LIMIT * out["word_chars"] or any(
        out[f"dup_{n}_gram_chars"] > limit * out["word_chars"] for n, limit in R.N_GRAM_LIMITS.items())
    out["kept"] = not out["base_failed"] and not bad
    return out


def test_whole_table_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in R.judge_repetition(docs).collect():
        got = r.asDict()
        assert {k: got[k] for k in brute("")} == brute(text[got["doc_id"]])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é", max_size=60), max_size=6))
def test_blocks_against_brute_force(texts):
    got = R.measure_block([t.encode() for t in texts])
    for i, t in enumerate(texts):
        want = brute(t)
        assert {m: int(got[m][i]) for m in R.MEASURES} == {m: want[m] for m in R.MEASURES}


def test_block_size_changes_nothing(spark):
    texts = [(r.text or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    whole = R.measure_block(texts)
    at = 0
    for block in R._blocks(texts, 20_000):
        part = R.measure_block(block)
        for m in R.MEASURES:
            assert (whole[m][at:at + len(block)] == part[m]).all()
        at += len(block)


def test_odd_rows_clashing_columns_and_empty_tables(odd, empty):
    rows = R.judge_repetition(with_clashes(odd)).collect()
    want = sorted(repr((r.doc_id, brute(r.text))) for r in odd.collect())
    assert sorted(repr((r.doc_id, {k: r[k] for k in brute("")})) for r in rows) == want
    assert R.judge_repetition(empty).count() == 0
    wide = with_clashes(odd)
    kept = R.keep_unrepetitive(wide)
    assert kept.columns == wide.columns
    assert kept.count() == sum(brute(r.text)["kept"] for r in odd.collect())
    assert R.keep_unrepetitive(empty).count() == 0
