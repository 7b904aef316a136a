import datetime as dt
import glob
import os

import pytest

from rooftop.plans.jobs import CyclicDependencyError, PathCollisionError, check_paths, run_job, table_job
from rooftop.sources.catalogue import migrate_table, models_to_rows, read_catalogue
from rooftop.sources.tables import NTZ_MICROS_FORMAT, Format, SaveMode, TableIn, TableOut, stamp_partition_keys

EVENTS_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def events(spark):
    return spark.read.parquet("/root/testdata/sf0.001/events.parquet")


@pytest.mark.parametrize("fmt", [Format.PARQUET, Format.CSV, Format.JSON])
def test_roundtrip_formats(spark, tmp_dir, fmt):
    src = events(spark)
    opts = {} if fmt is Format.PARQUET else {"timestampNTZFormat": NTZ_MICROS_FORMAT}
    out = TableOut(f"{tmp_dir}/ev", format=fmt, mode=SaveMode.OVERWRITE, build_datetime=False, options=opts)
    out.write(src)
    back = TableIn(out.path, format=fmt, schema=None if fmt is Format.PARQUET else EVENTS_SCHEMA,
                   options=opts).read(spark)
    assert sorted(map(tuple, back.select(*src.columns).collect())) == sorted(map(tuple, src.collect()))


def test_save_modes(spark, tmp_dir):
    df = spark.createDataFrame([(1,), (2,)], "x int")
    path = f"{tmp_dir}/m"
    TableOut(path, build_datetime=False, mode=SaveMode.OVERWRITE).write(df)
    TableOut(path, build_datetime=False, mode=SaveMode.APPEND).write(df)
    assert TableIn(path).read(spark).count() == 4
    TableOut(path, build_datetime=False, mode=SaveMode.IGNORE).write(df)
    assert TableIn(path).read(spark).count() == 4
    TableOut(path, build_datetime=False, mode=SaveMode.OVERWRITE).write(df)
    assert TableIn(path).read(spark).count() == 2
    with pytest.raises(Exception):
        TableOut(path, build_datetime=False, mode=SaveMode.ERROR).write(df)


def test_build_stamp_and_partitions(spark, tmp_dir):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "x int, k string")
    now = dt.datetime(2024, 5, 6, 7, 8, 9, 999)
    out = TableOut(f"{tmp_dir}/p", format=Format.CSV, partition_by="k", mode=SaveMode.OVERWRITE)
    out.write(df, now=now)
    dirs = sorted(os.path.basename(p) for p in glob.glob(f"{tmp_dir}/p/k=*"))
    assert dirs == ["k=a", "k=b"]
    assert glob.glob(f"{tmp_dir}/p/k=a/build_datetime=*")
    back = out.read_back(spark)
    assert sorted(r.x for r in back.collect()) == [1, 2]
    stamped, parts = out.stamped(df, now)
    assert parts == ["k", "build_datetime"]
    assert stamped.select("build_datetime").first()[0] == dt.datetime(2024, 5, 6, 7, 8, 9)


def test_partition_key_order():
    assert stamp_partition_keys(None) == ["build_datetime"]
    assert stamp_partition_keys("a") == ["a", "build_datetime"]
    assert stamp_partition_keys(["b", "a", "b", "build_datetime"]) == ["b", "a", "build_datetime"]


def test_read_or_empty_and_projection(spark, tmp_dir):
    empty = TableIn(f"{tmp_dir}/missing").read_or_empty(spark, __import__("pyspark.sql.types").sql.types
                                                        .StructType.fromDDL("a int, b string"))
    assert empty.count() == 0 and empty.columns == ["a", "b"]
    cols = TableIn("/root/testdata/sf0.001/customer.parquet", columns=("c_custkey", "c_name")).read(spark)
    assert cols.columns == ["c_custkey", "c_name"]
    plan = cols._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in plan


def test_csv_inference_and_separator(spark, tmp_dir):
    p = f"{tmp_dir}/x.csv"
    with open(p, "w", encoding="utf-8") as f:
        f.write("a;b\n1;Nitra\n2;Žilina\n")
    df = TableIn(p, format=Format.CSV, sep=";").read(spark)
    assert df.schema["a"].dataType.simpleString() == "int"
    assert sorted(r.b for r in df.collect()) == ["Nitra", "Žilina"]
    df2 = TableIn(p, format=Format.CSV, sep=";", schema="a bigint, b string").read(spark)
    assert df2.schema["a"].dataType.simpleString() == "bigint"


def test_delta_optional(spark, tmp_dir):
    try:
        spark.read.format("delta").load(f"{tmp_dir}/none")
    except Exception as e:  # noqa: BLE001
        if "DATA_SOURCE_NOT_FOUND" in str(e) or "Failed to find the data source" in str(e):
            pytest.skip("Delta data source not on the class path")
    df = spark.createDataFrame([(1,)], "x int")
    out = TableOut(f"{tmp_dir}/d", format=Format.DELTA, mode=SaveMode.OVERWRITE, build_datetime=False)
    out.write(df)
    assert out.read_back(spark).count() == 1


def test_jdbc_needs_url(spark):
    # no database is started here; only the declaration is checked
    with pytest.raises(ValueError):
        TableIn("t", format=Format.JDBC).reader(spark)
    with pytest.raises(ValueError):
        TableIn("t", format=Format.JDBC, url="jdbc:x://h/db", partition_column="id").reader(spark)


def test_path_checks():
    a, b = TableIn("/x/a"), TableIn("/x/b")
    check_paths({"a": a, "b": b}, {"o": TableOut("/x/o")})
    with pytest.raises(PathCollisionError):
        check_paths({"a": a, "a2": TableIn("/x/a")}, {})
    with pytest.raises(PathCollisionError):
        check_paths({}, {"o": TableOut("/x/o"), "o2": TableOut("/x/o")})
    with pytest.raises(CyclicDependencyError):
        check_paths({"a": a}, {"o": TableOut("/x/a")})


def test_run_job_single_and_multi(spark, tmp_dir):
    src = TableOut(f"{tmp_dir}/src", build_datetime=False, mode=SaveMode.OVERWRITE)
    src.write(spark.createDataFrame([(1, "A"), (2, "B"), (3, "A")], "x int, m string"))
    calls = []

    @table_job(TableOut(f"{tmp_dir}/one", build_datetime=False, mode=SaveMode.OVERWRITE), data=src.as_input())
    def one(spark_, data):
        calls.append(1)
        return data.filter("m = 'A'")

    one(spark)
    assert calls == [1]
    assert TableIn(f"{tmp_dir}/one").read(spark).count() == 2

    outs = {k: TableOut(f"{tmp_dir}/{k}", build_datetime=False, mode=SaveMode.OVERWRITE) for k in ("a", "b")}
    run_job(spark, lambda s, data: {"a": data.filter("m='A'"), "b": data.filter("m='B'")},
            {"data": src.as_input()}, outs)
    assert TableIn(f"{tmp_dir}/b").read(spark).count() == 1
    with pytest.raises(ValueError):
        run_job(spark, lambda s, data: {"zzz": data}, {"data": src.as_input()}, outs)


def test_catalogue_read_transpose_and_migrate(spark, tmp_dir):
    p = f"{tmp_dir}/cat.csv"
    with open(p, "w") as f:
        f.write("index,STC,Technology\nKyocera_Solar_SU53BU,53.1,Mono-c-Si\nAcme_X,300.0,CdTe\n")
    cat = read_catalogue(spark, p)
    assert cat.columns == ["panel_name", "STC", "Technology"]
    assert {r.panel_name: r.STC for r in cat.collect()} == {"Kyocera_Solar_SU53BU": 53.1, "Acme_X": 300.0}
    with open(f"{tmp_dir}/cat2.csv", "w") as f:
        f.write("index,Technology,N_s,STC\nAcme_X,CdTe,060,300\nB,CIGS,72,junk\n")
    cat2 = read_catalogue(spark, f"{tmp_dir}/cat2.csv")
    assert sorted(map(tuple, cat2.select("panel_name", "STC", "Technology", "N_s").collect())) == \
        [("Acme_X", 300.0, "CdTe", "060"), ("B", None, "CIGS", "72")]
    with open(f"{tmp_dir}/cat3.csv", "w") as f:
        f.write("index,STC\nA,1\n")
    with pytest.raises(ValueError, match="Technology"):
        read_catalogue(spark, f"{tmp_dir}/cat3.csv")
    wide = spark.createDataFrame([("STC", "53.1", "300.0"), ("Technology", "Mono-c-Si", "CdTe")],
                                 "attr string, `Kyocera_Solar_SU53BU` string, `Acme_X` string")
    long = models_to_rows(wide, "attr", ["STC", "Technology"])
    assert sorted(map(tuple, long.collect())) == [("Acme_X", "300.0", "CdTe"), ("Kyocera_Solar_SU53BU", "53.1", "Mono-c-Si")]
    out = TableOut(f"{tmp_dir}/approved", build_datetime=False, mode=SaveMode.OVERWRITE)
    migrate_table(spark, TableIn(p, format=Format.CSV), out)
    assert out.read_back(spark).count() == 2


def test_parquet_merge_schema(spark, tmp_dir):
    base = f"{tmp_dir}/merge"
    spark.createDataFrame([(1, "a")], "id int, x string").write.parquet(f"{base}/part=1")
    spark.createDataFrame([(2, 2.5)], "id int, y double").write.parquet(f"{base}/part=2")
    merged = TableIn(base, merge_schema=True).read(spark)
    assert set(merged.columns) == {"id", "x", "y", "part"}
    got = {r.id: (r.x, r.y) for r in merged.collect()}
    assert got == {1: ("a", None), 2: (None, 2.5)}


def test_run_job_preview_shows_rows(spark, tmp_dir, capfd):
    out = TableOut(f"{tmp_dir}/prev", build_datetime=False, mode=SaveMode.OVERWRITE)
    run_job(spark, lambda s: spark.createDataFrame([(7, "Senec")], "x int, m string"), {}, {"out": out}, preview=5)
    shown = capfd.readouterr().out
    assert "Senec" in shown and "|x  |m    |" in shown
    assert out.read_back(spark).count() == 1


def test_csv_schema_must_match_the_header(spark, tmp_dir):
    p = f"{tmp_dir}/h.csv"
    with open(p, "w") as f:
        f.write("b,a\n1,2\n")
    with pytest.raises(Exception):
        TableIn(p, format=Format.CSV, schema="a int, b int").read(spark).collect()
    assert TableIn(p, format=Format.CSV, schema="a int, b int", enforce_schema=True).read(spark).first().a == 1


def test_gathered_partitions_write_one_file_each(spark, tmp_dir):
    import glob
    df = spark.range(0, 1000, 1, 8).selectExpr("id", "id % 3 AS g")
    TableOut(f"{tmp_dir}/g", mode=SaveMode.OVERWRITE, build_datetime=False, partition_by="g",
             gather_partitions=True).write(df)
    assert len(glob.glob(f"{tmp_dir}/g/g=*/*.parquet")) == 3


def test_csv_inference_sampling(spark, tmp_dir):
    p = f"{tmp_dir}/s.csv"
    with open(p, "w") as f:
        f.write("a,b\n" + "".join(f"{i},{i}.5\n" for i in range(200)))
    df = TableIn(p, format=Format.CSV, infer_sampling_ratio=0.5).read(spark)
    assert df.schema["b"].dataType.simpleString() == "double" and df.count() == 200


def test_json_inference_sampling(spark, tmp_dir):
    p = f"{tmp_dir}/j.json"
    with open(p, "w") as f:
        f.write("".join(f'{{"a": {i}, "b": "x{i}"}}\n' for i in range(100)))
    df = TableIn(p, format=Format.JSON, infer_sampling_ratio=0.5).read(spark)
    assert set(df.columns) == {"a", "b"} and df.count() == 100
