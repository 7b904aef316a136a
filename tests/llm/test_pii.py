import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rooftop.llm import pii as P

from .conftest import SF, with_clashes

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
         "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    t = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        t += x - 9 if x > 9 else x
    return t % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 13 <= len(d) <= 19 and luhn(d), "phone": lambda: 9 <= len(d) <= 15}[kind]()
            if ok:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def check(rows, texts):
    for r in rows:
        want = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest(), (r, want)
        for kind in PLAIN:
            assert r[f"n_{kind}"] == sum(w.startswith(kind) for w in want)
        assert set(want) <= set(filter(None, r.spans.split(",")))


CASES = ["a@b.c_d@e.f", "x@y", "a@b.c.d. e@f.g", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.255.0", "4111 1111-1111 1111",
         "4111111111111111", "9" * 5000, "+1 (743) 555-3824", "+1((((((", "+12-", "++123456789+987654321", "é 😀 a@b.co",
         "a" * 200_000, "1 " * 50_000, "." * 1000 + "@" * 1000, "a@" * 5000, "1." * 20_000, "x@a-.-b", "%@-.-", "+1 2\n3456789",
         "4111 1111 1111 1111 4111 1111 1111 1111", "(a@b.cd)(+49 30 1234567)", "0000000000000"]


def test_base_spans_of_hard_texts(spark):
    df = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string")
    check(P.find_personal_data(df).collect(), dict(enumerate(CASES)))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="a1 2.@+-()9é", max_size=40), min_size=40, max_size=60))
def test_base_spans_of_random_texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = df.select("doc_id", P.spans_text(P.base_spans(F.col("text"))).alias("s")).collect()
    assert {r.doc_id: r.s for r in got} == {i: ",".join(brute(t)) for i, t in enumerate(texts)}


def test_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = P.find_personal_data(docs).collect()
    assert len(rows) == docs.count()
    check(rows, {r.doc_id: r.text for r in docs.collect()})


def talk(i):
    return f"please call me at +49 30 1234{i:03d} after six . write to my address user{i}@mail.example.org for details ok"


def test_patterns_discover_unseen_identifiers(spark):
    texts = [talk(i) for i in range(12)]
    texts.append("well please call me at 030-998877-55 after six . bye")      # no plus: not a base phone
    texts.append("and write to my address jane_doe7@intranet for details ok")  # no dot: not a base email
    texts.append("the order 030-112233-44 was sent and box 77123456 is empty")  # no such context
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in P.find_personal_data(df).collect()}
    assert spans[12] == "phone:23:36" and texts[12][23:36] == "030-998877-55"
    assert spans[13] == "email:24:42" and texts[13][24:42] == "jane_doe7@intranet"
    assert spans[14] == ""
    clean = {r.doc_id: r.text for r in P.redact(df).collect()}
    assert clean[12] == "well please call me at <PHONE> after six . bye"
    assert clean[13] == "and write to my address <EMAIL> for details ok"
    assert clean[14] == texts[14]


def card(i):
    d = f"411111111111{i:03d}"
    d += next(c for c in "0123456789" if luhn(d + c))
    return " ".join(d[j:j + 4] for j in range(0, 16, 4))


def test_identifiers_in_groups_and_spelled_addresses_are_discovered(spark):
    texts = [talk(i) + f" and charge my card {card(i)} on friday morning please" for i in range(12)]
    unseen = [("well please call me at ", "(555) 123-4567", " after six . bye", "phone"),
              ("so charge my card ", "4111 1111 1111 1112", " on friday morning please", "card"),
              ("so charge my card ", "3782 822463 10006", " on friday morning, please", "card"),
              ("and write to my address ", "jane(at)corp.com", " for details ok", "email"),
              ("and write to my address ", "jane.doe [at] corp [dot] com", " for details ok", "email"),
              ("and write to my address ", "jane at corp dot com", " for details ok", "email")]
    other = ["the order (555) 123-9999 was sent to 4111 1111 1111 1113 there", "look at example.com or me at 10.30 or at home"]
    texts += [a + m + b for a, m, b, _ in unseen] + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = {r.doc_id: r.spans for r in P.find_personal_data(df).collect()}
    for i, (a, m, _, kind) in enumerate(unseen, 12):
        assert spans[i] == f"{kind}:{len(a)}:{len(a + m)}", (texts[i], spans[i])
    assert spans[18] == spans[19] == ""
    clean = {r.doc_id: r.text for r in P.redact(df).collect()}
    for i, (a, _, b, kind) in enumerate(unseen, 12):
        assert clean[i] == f"{a}<{kind.upper()}>{b}"


def test_joined_mentions_leave_whole_tokens_apart():
    forms = {"me at 10.0.0.1 10.0.0.2": ["10.0.0.1", "10.0.0.2"], "card:4111 1111 1111 1111, 5": ["card:4111 1111 1111 1111,", "5"],
             "at 4111111111111111 12 34": ["4111111111111111", "12", "34"], "mail me at a.b@c.de now": ["a.b@c.de"],
             "in 2024 1 3rd": ["2024", "1", "3rd"], "12 +49 30 1234567": ["12", "+49 30 1234567"]}
    pattern = re.compile(P.MENTION.replace(r"\p{L}", "a-zA-Z").replace(r"\z", r"\Z").replace(
        "(?<=[a-z][0-9._%+-]{0,20})", ""))
    for text, want in forms.items():
        assert [m[0] for m in pattern.finditer(text)] == want, text


def test_rounds_go_on_while_they_find(spark):
    # each level shares its patterns with the next, smaller one: the last is four hops from the seeds
    rows = []
    for level, size in enumerate((3888, 648, 108, 18, 3)):
        for i in range(size):
            inst = f"{level}{10_000_000 + i}"
            rows += [(f"{tag} {at}", inst, 3 if level == 0 else None) for tag in ("LL", "RR") for at in (level - 1, level) if at >= 0]
    graph = spark.createDataFrame(rows, "pattern string, inst string, kind int")
    found = {r.inst for r in P.bootstrap(graph).collect()}
    assert found == {inst for _, inst, kind in rows if kind is None}
    with pytest.raises(RuntimeError, match="not settled"):
        P.bootstrap(graph, max_rounds=3)


def test_copies_of_one_text_are_no_evidence(spark):
    texts = [talk(1)] * 50 + ["well please call me at 030-998877-55 after six . bye"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.spans for r in P.find_personal_data(df).collect()}[50] == ""


def brute_redact(text):
    if not text:
        return text
    spans = sorted((int(s), -int(e), k) for k, s, e in (x.split(":") for x in brute(text)))
    out, at, i = "", 0, 0
    while i < len(spans):
        s, e, k = spans[i][0], -spans[i][1], spans[i][2]
        i += 1
        while i < len(spans) and spans[i][0] < e:
            e = max(e, -spans[i][1])
            i += 1
        out += text[at:s] + f"<{k.upper()}>"
        at = e
    return out + text[at:]


def test_redaction_against_brute_force(spark):
    texts = [c for c in CASES if len(c) < 10_000] + ["a1.2.3.4@b.cc x 1.2.3.4@x.y 4111111111111111@z.w"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.text for r in P.redact(df).collect()} == {i: brute_redact(t) for i, t in enumerate(texts)}


def test_overlaps_of_random_spans(spark):
    import random
    rng = random.Random(11)

    def spans(n, length):
        out = set()
        while len(out) < n:
            a = rng.randrange(length)
            out.add((rng.randrange(4), a, a + rng.randrange(1, 12)))
        return list(out)

    data = [(i, spans(rng.randrange(25), 60), spans(rng.randrange(1, 25), 60)) for i in range(150)] + \
        [(999, spans(300, 4000), spans(500, 4000))]
    df = spark.createDataFrame(data, "i int, base array<struct<k:int,s:int,e:int>>, extra array<struct<k:int,s:int,e:int>>")
    got = {r.i: r for r in df.select("i", P._apart(F.col("extra"), F.col("base")).alias("a"), P._widest(F.col("extra")).alias("w")).collect()}
    for i, base, extra in data:
        apart = [x for x in extra if not any(b[1] < x[2] and x[1] < b[2] for b in base)]
        wide = [x for x in extra if not any(y[1] <= x[1] and x[2] <= y[2] and y[2] - y[1] > x[2] - x[1] for y in extra)]
        assert sorted(map(tuple, got[i].a)) == sorted(apart) and sorted(map(tuple, got[i].w)) == sorted(wide)


def test_a_long_text_full_of_spans_is_redacted_in_time(spark):
    """12,000 spans in one text, and spans at the ends of the pieces it is cut into."""
    import time
    long = " ".join(f"mail u{i}@host.example or 10.0.{i % 256}.{i // 256 % 256} é" for i in range(6000))
    texts = {1: long, 2: "a@b.co " + "x" * 3000 + " 😀 c@d.co " + "y" * 1024 + " e@f.co", 3: "é" * 1023 + " a@b.co",
             4: "z" * 1024 + " a@b.co" + " " * 1017 + "1.2.3.4"}
    t = time.time()
    got = {r.doc_id: r.text for r in P.redact(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {i: brute_redact(x) for i, x in texts.items()} and time.time() - t < 60


def test_odd_rows_clashing_columns_and_empty_tables(odd, empty):
    wide = with_clashes(odd)
    got = P.find_personal_data(wide)
    assert got.count() == odd.count()
    assert all(r.spans == "" for r in got.collect())
    red = P.redact(wide)
    assert red.columns == wide.columns
    assert sorted(map(repr, red.collect())) == sorted(map(repr, wide.collect()))
    assert P.find_personal_data(empty).count() == 0 and P.redact(empty).count() == 0


def test_no_python_on_the_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    plan = P.find_personal_data(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
