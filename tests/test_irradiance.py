import datetime as dt

from pyspark.sql import functions as F

from rooftop.functions.formulas import hourly_energy_wh
from rooftop.operators.irradiance import hourly_irradiance, local_time, total_kwh
from rooftop.sources.irradiance import process_raw_file, read_hourly_file


def test_energy_golden(spark):
    v = spark.range(1).select(hourly_energy_wh(F.lit(1.0))).first()[0]
    assert v == 498.41438400000004


def test_hourly_mean_and_labels(spark):
    rows = [(dt.datetime(2024, 1, 1, 10, 0, 5), 10.0), (dt.datetime(2024, 1, 1, 10, 59, 59), 20.0),
            (dt.datetime(2024, 1, 1, 11, 30), 7.0)]
    df = spark.createDataFrame(rows, "ts timestamp_ntz, watts double")
    got = {r.label: r for r in hourly_irradiance(df).collect()}
    assert got["01/01/2024, 10:00:00"].wats_per_meter == 15.0
    assert got["01/01/2024, 10:00:00"].timestamp == 1704103200
    assert got["01/01/2024, 11:00:00"].wats_per_meter == 7.0   # hour with one reading
    tot = total_kwh(hourly_irradiance(df)).first()[0]
    assert abs(tot - (15.0 + 7.0) * 498.41438400000004 / 1000) < 1e-9


def test_autumn_hour_merges_and_session_zone_ignored(spark):
    # 2023-10-29 02:00-03:00 local occurs twice in Europe/Bratislava
    tz = "Europe/Bratislava"
    first = 1698537600 + 600   # 00:10 UTC = 02:10 CEST
    second = 1698541200 + 600  # 01:10 UTC = 02:10 CET
    df = spark.createDataFrame([(float(first), 10), (float(second), 30)], "epoch double, watts int")
    prev = spark.conf.get("spark.sql.session.timeZone")
    try:
        for session_tz in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", session_tz)
            local = df.select(local_time("epoch", tz).alias("ts"), "watts")
            out = hourly_irradiance(local, tz=tz).collect()
            assert [(r.label, r.wats_per_meter) for r in out] == [("29/10/2023, 02:00:00", 20.0)]
    finally:
        spark.conf.set("spark.sql.session.timeZone", prev)


def test_raw_file_to_hourly_files_and_total(spark, tmp_dir):
    raw = f"{tmp_dir}/raw.csv"
    base = 1704103200
    with open(raw, "w") as f:
        f.write("epoch,watts\n")
        for i in range(360):  # 2 hours of 20-second readings
            f.write(f"{base + 20 * i}.0,{i % 10}\n")
    total = process_raw_file(spark, raw, f"{tmp_dir}/hourly", f"{tmp_dir}/hourly_labels").first()[0]
    want = sum(hourly_energy_wh_py(sum(i % 10 for i in range(h * 180, h * 180 + 180)) / 180) for h in range(2)) / 1000
    assert abs(total - want) < 1e-9
    hourly = read_hourly_file(spark, f"{tmp_dir}/hourly").orderBy("timestamp").collect()
    assert [r.timestamp for r in hourly] == [base, base + 3600]
    labelled = read_hourly_file(spark, f"{tmp_dir}/hourly_labels", labelled=True).collect()
    assert sorted(r.timestamp for r in labelled) == ["01/01/2024, 10:00:00", "01/01/2024, 11:00:00"]
    with open(next(p for p in __import__("glob").glob(f"{tmp_dir}/hourly/*.csv"))) as fh:
        assert fh.readline().strip() == "timestamp,wats_per_meter"


def hourly_energy_wh_py(w):
    return w * 3600 / 20 * 0.19 * (1.755 * 1.038) * 8
