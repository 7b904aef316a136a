import random
import re

from pyspark.sql import functions as F

from rooftop.llm import licenses as L
from rooftop.llm.common import table

from .conftest import SF, with_clashes

COLUMNS = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
RULES = L.default_rules()


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(L.WORDS, low)


def brute(doc_id, text, rules=RULES):
    """One document by all rules, without gates, and every pair of matches compared."""
    ws = words_of(text)
    joined = " " + "  ".join(ws) + " "
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(r.regex, joined):
            start = joined[:m.start()].count("  ") + (m.start() > 0)
            found.append((i, start, start + len(m.group(1).split("  "))))
    base = [f for f in found if f[0] < 3]
    labels = list(L.BASE_PHRASES.values())
    def beaten(a):
        return any(b[1] <= a[1] and b[2] >= a[2] and (
            rules[b[0]].priority > rules[a[0]].priority or rules[b[0]].priority == rules[a[0]].priority and (
                b[2] - b[1] > a[2] - a[1] or b[2] - b[1] == a[2] - a[1] and b[0] < a[0])) for b in found)
    kept = [a for a in found if not beaten(a)]
    own = {rules[a[0]].label for a in kept}
    of_base = {labels[f[0]] for f in base}
    starts = [f[1] for f in base]
    return (doc_id, len(ws), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(of_base)),
            ",".join(sorted(of_base | own)), max((rules[a[0]].confidence for a in kept), default=0.0))


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def test_rules_are_hundreds_and_hold_keyword_and_anchor():
    assert len(RULES) > 300 and len({(r.label, r.pattern) for r in RULES}) == len(RULES)
    for r in RULES:
        re.compile(r.regex)
        must = r.pattern
        while (less := re.sub(r"\((?:[^()]|\[\^ \])*\)(?:\?|\{0,4\})", "", must)) != must:
            must = less  # without optional groups
        groups = re.sub(r"\([^()]*\)", "", must)
        assert any(a in must for a in L.ANCHORS), r
        assert re.search(rf"(?<![a-z0-9]){r.keyword}(?![a-z0-9])", must), r
        assert groups.strip() or must


NOTICES = [
    ("Released under the MIT License.", "mit"),
    ("Licensed under the Apache License, Version 2.0.", "apache,apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3.", "gpl,gpl-3.0"),
    ("Licensed under CC BY-NC 4.0.", "cc-by-nc-4.0"),
    ("SPDX-License-Identifier: BSD-3-Clause", "bsd-3-clause"),
    ("GNU Lesser General Public License v2.1 or later", "gpl,lgpl-2.1"),
    ("GPLv3", "gpl-3.0"),
    ("https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa-4.0"),
    ("Copyright (c) 2020 by Some Body. All rights reserved.", "proprietary"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("Creative Commons Attribution-ShareAlike 3.0 Unported", "cc-by-sa-3.0"),
    ("Mozilla Public Licence, v. 2.0", "mpl-2.0"),
    ("mit der Lizenz, mit dem Hund", ""),
    ("a license to nothing", ""),
]


def test_known_notices(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(NOTICES)], "doc_id long, text string")
    rows = {r.doc_id: r for r in L.license_labels(df).collect()}
    for i, (text, labels) in enumerate(NOTICES):
        assert tuple(rows[i]) == brute(i, text) and rows[i].labels == labels, text


def test_documents_against_brute_force(spark):
    docs = table(spark, SF, "documents")
    assert got(L.license_labels(docs)) == sorted((brute(r.doc_id, r.text) for r in docs.collect()), key=repr)


def test_random_mixtures_of_license_words(spark):
    rng = random.Random(12)
    vocabulary = sorted({w for r in RULES for w in re.findall(r"[a-z0-9]+", r.pattern)})
    phrases = ["mit license", "apache license", "general public license", "version 2 0", "licensed under the", "gnu",
               "gnu lesser general public license version 2.1", "cc by-nc 4.0", "MIT LİCENSE", "K", "mit\x00license",
               "spdx-license-identifier: gpl-2.0-or-later", "apache license version 2.0", "x"]
    docs = [(i, rng.choice([" ", ", ", "\n", "\x1f"]).join(rng.choice(phrases if rng.random() < .6 else vocabulary)
                                                           for _ in range(rng.randrange(60)))) for i in range(150)]
    docs += [(None, None), (7, ""), (7, ""), (8, " \x85\xa0 "), (9, "mit license " * 3000), (10, "w" * 300_000 + " mit license")]
    df = with_clashes(spark.createDataFrame(docs, "doc_id long, text string"), ("doc_",))
    want = sorted((brute(*d) for d in docs if d[0] != 9), key=repr)
    assert [r for r in got(L.license_labels(df)) if r[0] != 9] == want
    many = [r for r in got(L.license_labels(df)) if r[0] == 9]
    assert [r for r in many if r[2] > 5] == [(9, 6000, 3000, 0, 5998, "mit", "mit", 0.6)]


def test_rules_given_by_the_caller_and_their_order(spark):
    rules = [L.LicenseRule("mit", "mit license", "mit", 0, .5), L.LicenseRule("apache", "apache license", "apache", 0, .5),
             L.LicenseRule("gpl", "general public license", "public", 0, .5),
             L.LicenseRule("a", "license one", "license", 2, .7), L.LicenseRule("b", "license one", "license", 2, .9),
             L.LicenseRule("c", "mit license one two", "license", 1, .4)]
    text = "mit license one two, license one"
    row = L.license_labels(spark.createDataFrame([(1, text)], "doc_id long, text string"), rules).first()
    assert tuple(row) == brute(1, text, rules) and row.labels == "a,c,mit" and row.score == .7


def test_empty_table_and_no_python_in_the_plan(spark):
    assert got(L.license_labels(spark.createDataFrame([], "doc_id long, text string"))) == []
    docs = table(spark, SF, "documents")
    text = docs.select(L._matches(F.concat(F.lit(" "), F.col("text")), RULES[:5]))._jdf.queryExecution().toString() + \
        L.license_labels(docs)._jdf.queryExecution().toString()
    assert "Python" not in text and "Arrow" not in text
