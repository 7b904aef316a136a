import random

import pytest
from pyspark.sql import functions as F

from rooftop.llm import mixing as M

from .conftest import SF, with_clashes



def levels():
    return {"lang": F.col("lang"), "source": F.col("source")}


def fill(budget, children):
    """children: {node: (weight, supply)}; rounds of proportional shares until nothing is left over."""
    got = {c: 0.0 for c in children}
    for zero_too in (False, True):
        for _ in range(1000):
            left = budget - sum(got.values())
            open_ = {c: (w if w > 0 else float(zero_too)) for c, (w, s) in children.items()
                     if s - got[c] > 1e-9 and (w > 0 or zero_too)}
            if left < 1e-9 or not open_:
                break
            for c, w in open_.items():
                got[c] += min(left * w / sum(open_.values()), children[c][1] - got[c])
    return got


def brute_budgets(leaves, weights, total, epochs):
    langs = {}
    for (lang, source), t in leaves.items():
        langs.setdefault(lang, {})[source] = t * epochs
    top = fill(total, {x: (weights.get("lang", {}).get(x, 1.0), sum(s.values())) for x, s in langs.items()})
    return {(x, s): b for x in langs for s, b in fill(
        top[x], {s: (weights.get("source", {}).get(s, 1.0), v) for s, v in langs[x].items()}).items()}


@pytest.mark.parametrize("seed", range(4))
def test_budgets_against_rounds_of_shares(spark, seed):
    rng = random.Random(seed)
    leaves = {(f"l{i % 4}", f"s{i}"): rng.choice([0, 5, 100, 1000]) for i in range(14)}
    weights = {"lang": {"l0": 5.0, "l1": 0.5}, "source": {f"s{i}": rng.choice([0.0, 1.0, 3.0]) for i in range(5)}}
    total = rng.choice([10, 1500, 4000, 10 ** 6])
    df = spark.createDataFrame([(*k, t) for k, t in leaves.items()], "lang string, source string, tokens long")
    got = {(r.lang, r.source): r.budget for r in M.leaf_budgets(df, ["lang", "source"], weights, total, 2).collect()}
    want = brute_budgets(leaves, weights, total, 2)
    for k in want:
        assert abs(got[k] - want[k]) <= 1, (k, got, want)


def used(rows, tokens):
    out = {}
    for r in rows:
        k = (r.lang, r.source)
        out[k] = out.get(k, 0) + r.epochs * tokens(r) + r.part_tokens
    return out


@pytest.mark.parametrize("total", [None, 3000, 50_000])
def test_leaves_spend_their_budgets_exactly(spark, total):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    weights = {"lang": {"en": 1.0, "de": 5.0}}
    mixed = M.mix(docs, levels(), weights, F.col("n_chars"), total=total, max_epochs=3).collect()
    assert len(mixed) == docs.count()
    leaves = {}
    for r in mixed:
        leaves[r.lang, r.source] = leaves.get((r.lang, r.source), 0) + r.n_chars
    want = brute_budgets(leaves, weights, total or sum(leaves.values()), 3)
    got = used(mixed, lambda r: r.n_chars)
    for k in want:
        assert abs(got[k] - want[k]) <= 1
    for r in mixed:
        own = [x.epochs for x in mixed if (x.lang, x.source) == (r.lang, r.source)]
        assert max(own) - min(own) <= 1 and 0 <= r.part_tokens < max(1, r.n_chars)


def test_ranges_of_a_hot_leaf_change_nothing(spark, monkeypatch):
    docs = spark.range(3000).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source", "id % 7 AS n")
    a = M.mix(docs, levels(), {}, F.col("n"), total=4321).collect()
    monkeypatch.setattr(M, "RANGE_DOCS", 50)
    b = M.mix(docs, levels(), {}, F.col("n"), total=4321).collect()
    assert sorted(a) == sorted(b) and used(a, lambda r: r.n) == {("en", "s"): 4321}


@pytest.mark.parametrize("total, block", [(1000, 65_536), (1003, 64), (2400, 7), (1, 65_536)])
def test_equal_rows_share_a_cut_exactly(spark, monkeypatch, total, block):
    """1,000 equal rows of four tokens beside others: the budget is met to the token."""
    monkeypatch.setattr(M, "TIED_BLOCK", block)
    same = [(1, "four words of text", "en", "s")] * 1000
    other = [(i, f"text {i}", "en", "s") for i in range(2, 40)] + [(None, None, "en", "s")] * 5
    for rows in (same, same + other):
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
        size = F.size(F.split(F.coalesce("text", F.lit("")), " "))
        mixed = M.mix(df, levels(), {}, size, total=total).collect()
        assert len(mixed) == len(rows)
        assert used(mixed, lambda r: len((r.text or "").split(" "))) == {("en", "s"): total}
        parts = [r for r in mixed if r.part_tokens]
        assert len(parts) <= 1 and all(r.part_tokens < 4 for r in parts)
        assert max(r.epochs for r in mixed) - min(r.epochs for r in mixed) <= 1


def test_each_epoch_has_an_order_of_its_own(spark):
    docs = spark.range(400).selectExpr("id AS doc_id", "'t' AS text", "'en' AS lang", "'s' AS source")
    first = {r.doc_id for r in M.mix(docs, levels(), {}, F.lit(1), total=200).collect() if r.epochs == 1}
    third = {r.doc_id for r in M.mix(docs, levels(), {}, F.lit(1), total=1000).collect() if r.epochs == 3}
    assert len(first) == len(third) == 200 and 60 < len(first & third) < 140


def test_odd_rows_clashing_columns_and_empty_tables(spark, odd, empty):
    wide = with_clashes(odd)
    mixed = M.mix(wide, levels(), {"lang": {"en": 2.0}}, F.length("text"), total=100)
    assert mixed.columns == [*wide.columns, "epochs_", "part_tokens"] and mixed.count() == odd.count()
    copies = M.take_copies(M.mix(wide, levels(), {}, F.length("text"), max_epochs=2))
    assert copies.columns == wide.columns and copies.count() >= 1
    assert M.mix(empty, levels(), {}, F.length("text")).count() == 0
    assert M.mix(odd, levels(), {}, F.lit(0)).agg(F.sum("epochs")).first()[0] == 0
