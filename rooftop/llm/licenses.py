"""License scan by ordered signature rules, in DataFrame functions alone.

A text becomes its words (A to Z in lower case, runs of ASCII letters and digits
and of other characters), each with a space on either side.  A rule is a regular
expression over words with a keyword that all its matches hold, a label, a
priority and a confidence.  Texts without any anchor (a piece of a word that
every rule needs) are done after a few substring searches; of the others only
the rules whose keyword occurs are tried, on the whole text.

Overlaps: a match inside the interval of a match of higher priority goes, as
does one inside a longer match of its own priority, or, at the same place, a
match of an earlier rule.  What stays gives the labels and the score, the
highest confidence.  The three base phrases are rules of the lowest priority;
their labels and places are reported whether or not they are suppressed.

Scale: one pass over the texts, without a shuffle; matches (word numbers, no
text) are then resolved by windows over each text's matches, so the work grows
with their number and not with its square.

Defined results: a null text is empty (no words, labels empty, score 0); every
row gives one row, also rows repeated in all columns; other columns are not
read.  A word has no length limit, and matches of one rule do not overlap.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import col, stash

WORD_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# The only letters beyond ASCII whose lower case has an ASCII letter.
ODD_CAPITALS = ("İ", "K")


@dataclass(frozen=True)
class LicenseRule:
    """``pattern``: a regular expression over words, with one space between words and no capturing group;
    ``keyword``: a word of every match."""

    label: str
    pattern: str
    keyword: str
    priority: int
    confidence: float

    @property
    def regex(self) -> str:
        """The pattern over texts in which each word has a space of its own on either side."""
        return f" ({self.pattern.replace(' ', '  ')}) "


# -- the rules -------------------------------------------------------------------
# The contract's phrases and their labels: fixed values.
BASE_PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# label; keyword; name; versions (- none).  A version's label is label-version.
FAMILIES = """
0bsd; 0bsd; 0bsd licen[cs]e; -
aal; assurance; attribution assurance licen[cs]e; -
afl; academic; academic free licen[cs]e; 1.1 1.2 2.0 2.1 3.0
agpl; affero; (?:gnu )?affero general public licen[cs]e; 1.0 3.0
agpl; agpl; (?:gnu )?agpl; 1.0 3.0
apache; apache; apache (?:software )?licen[cs]e; 1.0 1.1 2.0
apsl; apple; apple public source licen[cs]e; 1.0 1.1 1.2 2.0
artistic; artistic; artistic licen[cs]e; 1.0 2.0
beerware; beerware; (?:the )?beerware licen[cs]e; -
bsd; bsd; bsd (?:style |type )?licen[cs]e; -
bsd-2-clause; bsd; (?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd) licen[cs]e; -
bsd-3-clause; bsd; (?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd) licen[cs]e; -
bsd-4-clause; bsd; (?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd) licen[cs]e; -
bsl; boost; boost software licen[cs]e; 1.0
busl; business; business source licen[cs]e; 1.0 1.1
cc0; cc0; cc0; 1.0
cddl; development; common development and distribution licen[cs]e; 1.0 1.1
cecill; cecill; cecill; 1.0 1.1 2.0 2.1
cpl; common; common public licen[cs]e; 0.5 1.0
ecl; educational; educational community licen[cs]e; 1.0 2.0
epl; eclipse; eclipse public licen[cs]e; 1.0 2.0
eupl; european; european union public licen[cs]e; 1.0 1.1 1.2
eupl; eupl; eupl; 1.0 1.1 1.2
gfdl; documentation; (?:gnu )?free documentation licen[cs]e; 1.1 1.2 1.3
gpl; public; (?:gnu )?general public licen[cs]e(?: gpl)?; 1.0 2.0 3.0
gpl; gpl; (?:gnu )?gpl; 1.0 2.0 3.0
hpnd; historical; historical permission notice and disclaimer; -
isc; isc; isc licen[cs]e; -
lgpl; lesser; (?:gnu )?lesser general public licen[cs]e; 2.1 3.0
lgpl; library; (?:gnu )?library general public licen[cs]e; 2.0
lgpl; lgpl; (?:gnu )?lgpl; 2.0 2.1 3.0
lppl; latex; latex project public licen[cs]e; 1.0 1.1 1.2 1.3
mit; mit; mit licen[cs]e; -
mit-0; mit; mit (?:0|no attribution) licen[cs]e; -
mpl; mozilla; mozilla public licen[cs]e; 1.0 1.1 2.0
mpl; mpl; mpl; 1.0 1.1 2.0
ms-pl; microsoft; microsoft public licen[cs]e; -
ms-rl; microsoft; microsoft reciprocal licen[cs]e; -
ncsa; ncsa; (?:university of illinois )?ncsa (?:open source )?licen[cs]e; -
odbl; database; open (?:data commons open )?database licen[cs]e; 1.0
ofl; font; (?:sil )?open font licen[cs]e; 1.0 1.1
openrail; openrail; (?:creativeml )?openrail(?: m)? licen[cs]e; -
osl; open; open software licen[cs]e; 1.0 2.0 2.1 3.0
php; php; php licen[cs]e; 3.0 3.01
postgresql; postgresql; postgresql licen[cs]e; -
psf; python; python software foundation licen[cs]e; 2.0
python; python; python licen[cs]e; 2.0
qpl; q; q public licen[cs]e; 1.0
ruby; ruby; ruby licen[cs]e; -
sspl; server; server side public licen[cs]e; 1.0
unlicense; unlicense; (?:the )?unlicense; -
upl; universal; universal permissive licen[cs]e; 1.0
vim; vim; vim licen[cs]e; -
w3c; w3c; w3c (?:software (?:notice )?(?:and )?)?licen[cs]e; -
wtfpl; wtfpl; wtfpl; -
x11; x11; x11 licen[cs]e; -
zlib; zlib; zlib (?:libpng )?licen[cs]e; -
zpl; zope; zope public licen[cs]e; 1.1 2.0 2.1
"""

# label; keyword; words of a license's own text or of a notice
SIGNATURES = """
mit; permission; permission is hereby granted free of charge to any person obtaining a copy of this software
mit; copyright; the above copyright notice and this permission notice shall be included in all copies
isc; permission; permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
hpnd; permission; permission to use copy modify (?:and )?distribute(?: and sell)? this software and its documentation for any purpose
bsd; redistribution; redistribution and use in source and binary forms with or without modification are permitted
bsd-2-clause; redistributions; redistributions in binary form must reproduce the above copyright notice
bsd-3-clause; permission; may be used to endorse or promote products derived from this software without specific prior written permission
bsd-4-clause; advertising; all advertising materials mentioning features or use of this software must display the following acknowledge?ment
zlib; warranty; this software is provided as is without any express or implied warranty in no event will the authors be held liable
apache-2.0; license; you may not use this file except in compliance with the license
apache-2.0; license; unless required by applicable law or agreed to in writing software distributed under the license
gpl; redistribute; this program is free software you can redistribute it and or modify it under the terms of the gnu general public license
lgpl; redistribute; this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license
agpl; redistribute; you can redistribute it and or modify it under the terms of the gnu affero general public license
gpl; warranty; this program is distributed in the hope that it will be useful but without any warranty
mpl-2.0; license; this source code form is subject to the terms of the mozilla public license v 2 0
mpl-1.1; license; the contents of this file are subject to the mozilla public license version 1 1
epl; license; this program and the accompanying materials are made available under the terms of the eclipse public license
bsl-1.0; license; permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
unlicense; domain; this is free and unencumbered software released into the public domain
wtfpl; license; do what the fuck you want to public license
beerware; beer; the beer ware license revision 42
public-domain; domain; (?:released|placed|dedicated|put) (?:in|into|to) the public domain
public-domain; domain; (?:is|are) in the public domain
cc0-1.0; copyright; to the extent possible under law the (?:author|person)s? (?:has|have) (?:dedicated|waived) all copyright
creative-commons; creative; (?:a )?creative commons licen[cs]e
proprietary; proprietary; (?:proprietary and confidential|confidential and proprietary)
proprietary; reserved; copyright (?:c )?(?:[0-9]{4} )?(?:by )?(?:[^ ]+ ){0,4}all rights reserved
proprietary; license; end user license agreement
proprietary; licensed; (?:this )?software is licensed not sold
non-commercial; license; license for non(?: )?commercial use only
copyright; copyright; copyright (?:c )?[0-9]{4}
"""

# letters of a Creative Commons license and what they stand for
CREATIVE_COMMONS = {"by": "attribution", "nc": "non(?: )?commercial", "nd": "no(?: )?deriv(?:ative)?s?(?: works)?",
                    "sa": "share(?: )?alike"}
CC_KINDS = ("by", "by nc", "by nd", "by sa", "by nc nd", "by nc sa")
CC_VERSIONS = ("1.0", "2.0", "2.5", "3.0", "4.0")

NOTICE = (r"(?:licensed|released|distributed|published|(?:made )?available|provided|offered|redistributed|covered|used) "
          r"(?:under|by|subject to|according to|pursuant to) (?:the )?(?:terms (?:and conditions )?of )?(?:the |a |an )?")
SPDX = "spdx license identifier "
# priority and confidence of a rule's form
BASE, NAME, VERSION, NOTE, TEXT, ID = (0, 0.5), (1, 0.6), (2, 0.8), (3, 0.9), (4, 0.95), (5, 1.0)
# Every match of a rule holds one of these within a word.
ANCHORS = ("licen", "gpl", "permi", "copyright", "redistribut", "warrant", "domain", "creative", "cc", "spdx", "mpl",
           "eupl", "cecill", "wtfpl", "proprietary", "advertising")


def _version(v: str) -> str:
    """A version's words: 2.1 is ``2 1``; 3.0 may be written 3; ``v`` or ``version`` may stand before it."""
    whole, _, part = v.partition(".")
    return r"(?:version |v(?: )?)?" + (f"{whole}(?: 0)?" if part == "0" else f"{whole} {part}")


def _lines(block: str) -> list[list[str]]:
    return [[x.strip() for x in line.split(";")] for line in block.strip().split("\n")]


def default_rules() -> list[LicenseRule]:
    """The rules in their order; a rule's priority comes from its form, not its place."""
    rules = [LicenseRule(label, phrase, phrase.split()[-2], *BASE) for phrase, label in BASE_PHRASES.items()]
    for label, keyword, name, versions in _lines(FAMILIES):
        forms = [(label, name, NAME)]
        if versions != "-":
            forms += [(f"{label}-{v}", f"{name} {_version(v)}(?: or (?:any )?later)?", VERSION) for v in versions.split()]
            short = label + "v"
            forms += [(f"{label}-{v}", f"{SPDX}{label.replace('-', ' ')} {v.replace('.', ' ')}(?: only| or later)?", ID)
                      for v in versions.split()]
            if name.endswith(label):  # gplv3 and the like, in one word
                rules += [LicenseRule(f"{label}-{v}", short + v.replace(".", " ").removesuffix(" 0"),
                                      short + v.split(".")[0], *VERSION) for v in versions.split()]
        else:
            forms.append((label, SPDX + label.replace("-", " "), ID))
        for full, pattern, form in forms:
            word = "spdx" if form is ID else keyword
            rules.append(LicenseRule(full, pattern, word, *form))
            if form is not ID:
                rules.append(LicenseRule(full, NOTICE + pattern, word, *(NOTE if form is VERSION else VERSION)))
    for label, keyword, words in _lines(SIGNATURES):
        rules.append(LicenseRule(label, words, keyword, *(NAME if label in ("copyright", "creative-commons") else TEXT)))
    for kind in CC_KINDS:
        long = " ".join(CREATIVE_COMMONS[x] for x in kind.split())
        for v in CC_VERSIONS:
            label, number = f"cc-{kind.replace(' ', '-')}-{v}", v.replace(".", " ")
            rules += [LicenseRule(label, f"cc {kind} {number}", "cc", *VERSION),
                      LicenseRule(label, f"{NOTICE}cc {kind} {number}", "cc", *NOTE),
                      LicenseRule(label, f"creative commons {long} {number}(?: international| unported| generic)?",
                                  "creative", *NOTE),
                      LicenseRule(label, f"creativecommons org licenses {kind} {number}", "creativecommons", *TEXT),
                      LicenseRule(label, f"{SPDX}cc {kind} {number}", "spdx", *ID)]
        rules.append(LicenseRule(f"cc-{kind.replace(' ', '-')}", f"cc {kind}", "cc", *NAME))
    return list({(r.label, r.pattern): r for r in reversed(rules)}.values())[::-1]  # each once, where it stands first


# -- words and matches -------------------------------------------------------------
def lower_ascii(text: Column) -> Column:
    """A to Z in lower case.  ``lower`` changes other letters too, which no rule and no word break sees, but for two."""
    odd = F.contains(text, F.lit(ODD_CAPITALS[0])) | F.contains(text, F.lit(ODD_CAPITALS[1]))
    return F.when(odd, F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def _quoted(text: str) -> str:
    """A raw SQL string."""
    if "'" in text:
        raise ValueError(f"a rule has no quotes: {text}")
    return f"r'{text}'"


def _matches(words: Column, rules: list[LicenseRule]) -> Column:
    """(rule, start, end) of every match, in word numbers, the end exclusive."""
    by_keyword: dict[str, list[int]] = {}
    for i, r in enumerate(rules):
        by_keyword.setdefault(f" {r.keyword} ", []).append(i)
    # as one SQL text: a literal map, made by one parse and not by thousands of calls
    entry = "named_struct('i', {}, 'p', {})"
    groups = ", ".join(f"'{k}', array({', '.join(entry.format(i, _quoted(rules[i].regex)) for i in own)})"
                       for k, own in by_keyword.items())
    table = F.expr(f"map({groups})")
    # what a lambda needs is an argument of its function: anything else in its body is evaluated for each element
    present = F.filter(F.array(*[F.lit(k) for k in by_keyword]), lambda k: F.contains(words, k))
    tried = F.filter(F.flatten(F.transform(present, lambda k: table[k])), lambda r: F.rlike(words, r["p"]))
    # a mark before each match's first word and after its last, then the numbers of the words with marks
    marked = F.transform(tried, lambda r: F.struct(r["i"].alias("i"), F.split(
        F.trim(F.regexp_replace(words, r["p"], F.lit(" \x01$1\x02 "))), F.lit("  ")).alias("w")))

    def places(m):
        starts = F.filter(F.transform(m["w"], lambda w, n: F.when(F.startswith(w, F.lit("\x01")), n)), lambda n: n.isNotNull())
        ends = F.filter(F.transform(m["w"], lambda w, n: F.when(F.endswith(w, F.lit("\x02")), n + 1)), lambda n: n.isNotNull())
        return F.zip_with(starts, ends, lambda s, e: F.struct(m["i"].alias("rule"), s.alias("start"), e.alias("end")))

    return F.flatten(F.transform(marked, places))


def scan(docs: DataFrame, rules: list[LicenseRule], ident: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for every row of ``docs``: ``row`` (a number of its own), ``id``, ``n_words``, ``found`` (all matches).

    Written to the shared folder: the texts are read once, whatever follows.
    """
    low = docs.select(col(ident).alias("id"), lower_ascii(F.coalesce(col(text), F.lit(""))).alias("t"))
    anchored = F.lit(False)
    for a in ANCHORS:
        anchored = anchored | F.contains("t", F.lit(a))
    none = F.array().cast("array<struct<rule int, start int, end int>>")
    padded = F.concat(F.lit(" "), F.trim(F.regexp_replace("t", WORD_BREAKS, "  ")), F.lit(" "))
    # pieces between breaks: the first and the last are empty where the text begins or ends with a break
    pieces = low.select("id", F.split("t", WORD_BREAKS).alias("p"), F.when(anchored, padded).alias("words"))
    outer = (F.get("p", F.lit(0)) == "").cast("long") + ((F.size("p") > 1) & (F.element_at("p", -1) == "")).cast("long")
    words = pieces.select("id", (F.size("p") - outer).cast("long").alias("n_words"), "words")
    found = words.select("id", "n_words", F.when(F.col("words").isNotNull(), _matches(F.col("words"), rules))
                         .otherwise(none).alias("found"))
    return stash(found.withColumn("row", F.monotonically_increasing_id()), "license-matches")


def resolve(scanned: DataFrame, rules: list[LicenseRule]) -> DataFrame:
    """The matches that no other suppresses: row, rule, start, end, priority, label, confidence."""
    columns = F.from_json(F.lit(json.dumps([{"priority": r.priority, "label": r.label, "confidence": r.confidence}
                                            for r in rules])), "array<struct<priority int, label string, confidence double>>")
    m = scanned.select("row", F.explode("found").alias("m")).select("row", "m.*") \
        .select("*", F.get(columns, "rule").alias("r")).select("row", "rule", "start", "end", "r.*")
    tiers = sorted({r.priority for r in rules})
    upto = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("row", "priority").orderBy(F.col("start"), F.col("end").desc(), F.col("rule")) \
        .rowsBetween(Window.unboundedPreceding, -1)
    over = F.lit(False)
    for t in tiers[:-1]:
        reach = F.max(F.when(F.col("priority") > t, F.col("end"))).over(upto)
        over = over | F.when(F.col("priority") == t, F.coalesce(reach >= F.col("end"), F.lit(False))).otherwise(F.lit(False))
    return m.withColumns({"over": over, "same": F.coalesce(F.max("end").over(before) >= F.col("end"), F.lit(False))}) \
        .filter(~F.col("over") & ~F.col("same")).drop("over", "same")


def license_labels(docs: DataFrame, rules: list[LicenseRule] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every document (see module doc)."""
    rules = default_rules() if rules is None else rules
    scanned = scan(docs, rules)
    labels = F.array(*[F.lit(label) for label in BASE_PHRASES.values()])
    base = F.filter("found", lambda m: m["rule"] < len(BASE_PHRASES))
    of_row = scanned.select(
        "row", F.col("id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda m: m["start"])).cast("long").alias("first_word"),
        F.array_max(F.transform(base, lambda m: m["start"])).cast("long").alias("last_word"),
        F.array_distinct(F.transform(base, lambda m: F.get(labels, m["rule"]))).alias("of_base"))
    kept = resolve(scanned, rules).groupBy("row").agg(F.collect_set("label").alias("own"), F.max("confidence").alias("score"))
    none = F.array().cast("array<string>")
    return of_row.join(kept, "row", "left").select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join(F.array_sort("of_base"), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("of_base", F.coalesce("own", none))), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))
