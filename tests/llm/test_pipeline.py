import re

import duckdb

import corpus_pipeline as C
from rooftop.llm import pii, simhash
from rooftop.llm.common import stash
from rooftop.llm.oracles import mixture_sql
from rooftop.llm.packing import END_ID
from rooftop.llm.queries import DOMAINS, WEIGHTS

from .conftest import SF, with_clashes
from .test_packing import real_ids
from .test_pii import brute_redact
from .test_repetition import brute as measured
from .test_simhash import brute_groups


def test_stages_against_brute_force(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()

    kept = stash(C.quality_rules(spark, docs, SF), "q")
    want = [r for r in rows if measured(r.text)["kept"]]
    assert kept.columns == docs.columns and sorted(kept.collect()) == sorted(want)

    single = stash(C.near_duplicates(spark, kept, SF), "n")
    first = {c for _, _, c in brute_groups([(r.doc_id, r.text) for r in want])}
    want = [r for r in want if r.doc_id in first]
    assert single.columns == docs.columns and sorted(single.collect()) == sorted(want)

    clean = stash(C.personal_data(spark, single, SF), "p")
    found = {r.doc_id: r for r in pii.find_personal_data(single).collect()}
    assert clean.columns == docs.columns
    for r in clean.collect():
        assert r.n_chars == len(r.text)
        text = next(x.text for x in want if x.doc_id == r.doc_id)
        n_base = sum(found[r.doc_id][f"n_{k}"] for k in pii.KINDS)
        if n_base == len(list(filter(None, found[r.doc_id].spans.split(",")))):
            assert r.text == brute_redact(text)

    mixed = stash(C.source_mixture(spark, clean, SF), "m")
    assert mixed.columns == docs.columns
    con = duckdb.connect()
    clean.write.parquet(tmp_dir + "/clean")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_dir}/clean/*.parquet')")
    uses = con.execute(mixture_sql(WEIGHTS, DOMAINS)).fetchall()
    texts, copies = {r.doc_id: r.text for r in clean.collect()}, []
    for doc, _, _, epochs, part in uses:
        copies += [(doc, texts[doc])] * epochs
        copies += [(doc, " ".join(re.findall(r"[^ \t\n\x0b\x0c\r]+", texts[doc])[:part]))] * (part > 0)
    assert sorted((r.doc_id, r.text) for r in mixed.collect()) == sorted(copies)
    assert all(r.n_chars == len(r.text) for r in mixed.collect())
    words = sum(len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t)) for _, t in copies)
    assert abs(words - sum(len(re.findall(r"[^ \t\n\x0b\x0c\r]+", t)) for t in texts.values())) <= 80

    pieces = C.pack(spark, mixed, SF).collect()
    total = sum(len(real_ids(r.text)) + 1 for r in mixed.collect())
    assert sum(r.length for r in pieces) == total and END_ID == 2


def test_run_over_whole_documents(spark):
    assert [n for n, _ in C.STAGES] == ["quality_rules", "near_duplicates", "personal_data", "source_mixture", "packing"]
    out = C.run(spark, SF)
    assert out.count() > 0 and "ids_crc32" in out.columns


def test_odd_rows_and_empty_tables(spark, odd, empty):
    for start in (with_clashes(odd), empty):
        docs = start
        for name, stage in C.STAGES:
            after = stash(stage(spark, docs, SF), name)
            if name != "packing":
                assert after.columns == docs.columns
            docs = after


def test_one_of_a_group_of_copies_goes_on(spark):
    text = " ".join(f"word{i} and w{i * 7 % 50}" for i in range(60))
    rows = [(i, text if i % 2 else text.replace("word7 ", "word8 ")) for i in range(40)] + [(100, "quite other " * 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.keep_one_per_group(df).collect())[0] == 0
