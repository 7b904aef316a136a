import datetime as dt

from rooftop.functions.text import (
    misdecoded_pairs,
    normalise_model_name,
    nullif_sentinel,
    parse_timestamp,
    repair_text,
    yearly_energy,
)


def test_sentinel_to_null(spark):
    df = spark.createDataFrame([("None",), (None,), ("48.1",), ("none",)], "x string")
    got = [r[0] for r in df.select(nullif_sentinel("x")).collect()]
    assert got == [None, None, "48.1", "none"]


def test_parse_timestamp_none_null_junk_valid(spark):
    df = spark.createDataFrame(
        [("None",), (None,), ("junk",), ("2021-03-04 05:06:07",), ("2021-03-04",), ("2021-03-04T05:06:07.123456",)],
        "x string")
    got = [r[0] for r in df.select(parse_timestamp("x")).collect()]
    assert got == [None, None, None, dt.datetime(2021, 3, 4, 5, 6, 7), dt.datetime(2021, 3, 4),
                   dt.datetime(2021, 3, 4, 5, 6, 7, 123456)]
    assert df.select(parse_timestamp("x")).schema[0].dataType.simpleString() == "timestamp_ntz"


def test_parse_timestamp_on_inferred_timestamp_column(spark):
    # a CSV reader may already have inferred a timestamp: no ANSI error, value kept
    df = spark.createDataFrame([(dt.datetime(2020, 1, 2, 3, 4, 5),)], "x timestamp_ntz")
    assert df.select(parse_timestamp("x")).first()[0] == dt.datetime(2020, 1, 2, 3, 4, 5)


def test_parse_timestamp_with_format(spark):
    df = spark.createDataFrame([("04/03/2021 05:06",), ("x",)], "x string")
    got = [r[0] for r in df.select(parse_timestamp("x", fmt="dd/MM/yyyy HH:mm")).collect()]
    assert got == [dt.datetime(2021, 3, 4, 5, 6), None]


def test_repair_default_pair(spark):
    df = spark.createDataFrame([("PolnohospodĂˇrska budova",), (None,)], "x string")
    got = [r[0] for r in df.select(repair_text("x")).collect()]
    assert got == ["Polnohospodárska budova", None]


def test_misdecoded_pairs_rule_gives_default():
    assert misdecoded_pairs("á") == [("Ăˇ", "á")]
    # every pair maps back to its letter through the wrong codec
    for bad, good in misdecoded_pairs("áäčďéíľĺňóôŕšťúýž"):
        assert good.encode("utf-8").decode("cp1250") == bad


def test_normalise_model_name(spark):
    cases = {
        "Kyocera Solar SU53BU": "Kyocera_Solar_SU53BU",
        "Acme (x) Mono-300.5 A": "Acme_Mono_300_5_A",
        "A (b) c (d) e": "A_e",  # greedy bracket group
        "plain": "plain",
        "tab\tname": "tab_name",
    }
    df = spark.createDataFrame([(k,) for k in cases], "x string")
    got = {r[0]: r[1] for r in df.select("x", normalise_model_name("x")).collect()}
    assert got == cases


def test_yearly_energy(spark):
    df = spark.createDataFrame(
        [("a\nYear    1234.56\n",), ("no line here",), ("Year\t12x34 z",), (None,), ("Year 7",)], "b string")
    got = [r[0] for r in df.select(yearly_energy("b")).collect()]
    # unescaped dot: '12x34' matches but is not a number -> NULL; '7' has no fraction part
    assert got == [1234.56 / 1000, None, None, None, None]


def test_normalise_unicode_space_like_python(spark):
    import re
    names = ["Acme\u00a0Mono 300", "Acme X-1.5\u2003B", "plain", "Acme (a\rb) X 2", "Acme (a\nb) X"]
    df = spark.createDataFrame([(n,) for n in names], "x string")
    got = [r[0] for r in df.select(normalise_model_name("x")).collect()]
    want = [re.sub(r"[\.\-\s]", "_", re.sub(r"\(.*\) ", "", n)) for n in names]
    assert want[0] == "Acme_Mono_300" and want[1] == "Acme_X_1_5_B"
    assert got == want
