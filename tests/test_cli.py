import pytest

from rooftop.__main__ import _parser, main
from rooftop.sources.tables import SaveMode, TableIn, TableOut


def test_parser_requires_job():
    with pytest.raises(SystemExit):
        _parser().parse_args([])


def test_cli_runs_addresses_and_capacity(spark, tmp_dir):
    from .test_addresses import frames
    e, b, m = frames(spark)
    for name, df in (("e", e), ("b", b), ("m", m)):
        TableOut(f"{tmp_dir}/{name}", mode=SaveMode.OVERWRITE, build_datetime=False).write(df)
    assert main(["addresses", "--entrances", f"{tmp_dir}/e", "--buildings", f"{tmp_dir}/b",
                 "--municipalities", f"{tmp_dir}/m", "--out", f"{tmp_dir}/a"]) == 0
    assert sorted(r.entranceObjectId for r in TableIn(f"{tmp_dir}/a").read(spark).collect()) == [1, 4, 6, 11]
    assert main(["addresses", "--entrances", f"{tmp_dir}/e", "--buildings", f"{tmp_dir}/b",
                 "--municipalities", f"{tmp_dir}/m", "--out", f"{tmp_dir}/a2", "--top-n", "tree",
                 "--limit", "2"]) == 0
    assert TableIn(f"{tmp_dir}/a2").read(spark).count() == 2
    spark.createDataFrame([("Bratislava - Ružinov", "Year 1000.0")], "municipalityName string, body string") \
        .write.parquet(f"{tmp_dir}/replies")
    assert main(["capacity", "--addresses", f"{tmp_dir}/a", "--replies", f"{tmp_dir}/replies",
                 "--out", f"{tmp_dir}/c"]) == 0
    assert main(["roofs", "--capacity", f"{tmp_dir}/c", "--out", f"{tmp_dir}/r"]) == 0
    assert main(["emissions", "--roofs", f"{tmp_dir}/r", "--out", f"{tmp_dir}/co2"]) == 0
    assert main(["adoption", "--capacity", f"{tmp_dir}/c", "--out", f"{tmp_dir}/ad"]) == 0
    assert TableIn(f"{tmp_dir}/co2").read(spark).count() == 6
    assert {r.adoption for r in TableIn(f"{tmp_dir}/ad").read(spark).collect()} <= {15, 30, 50, 100}


def test_cli_clean_and_irradiance(spark, tmp_dir, capsys):
    raw = f"{tmp_dir}/obce.csv"
    with open(raw, "w") as f:
        f.write("objectId,municipalityName,validFrom,validTo,changedAt\n1,Senec,2020-01-01,None,junk\n")
    assert main(["clean", "--register", "municipalities", "--raw", raw, "--out", f"{tmp_dir}/obce"]) == 0
    r = TableIn(f"{tmp_dir}/obce").read(spark).first()
    assert r.validTo is None and r.changedAt is None and r.validFrom.year == 2020
    readings = f"{tmp_dir}/raw.csv"
    with open(readings, "w") as f:
        f.write("epoch,watts\n1704103200.0,10\n1704103220.0,20\n")
    assert main(["irradiance", "--raw", readings, "--hourly", f"{tmp_dir}/h", "--labelled", f"{tmp_dir}/l"]) == 0
    assert "total_kwh=" in capsys.readouterr().out


def test_cli_keeps_leading_zeros_and_copies_catalogue_and_approved_list(spark, tmp_dir):
    raw = f"{tmp_dir}/vchody.csv"
    with open(raw, "w") as f:
        f.write("objectId,postalCode,axisB,axisL,propertyRegistrationNumberIdentifier,validFrom,validTo,verifiedAt,changedAt\n"
                "1,01001,48.1,17.1,9,None,None,None,2020-01-01\n")
    assert main(["clean", "--register", "entrances", "--raw", raw, "--out", f"{tmp_dir}/vchody"]) == 0
    r = TableIn(f"{tmp_dir}/vchody").read(spark).first()
    assert r.postalCode == "01001" and r.objectId == 1 and r.propertyRegistrationNumberIdentifier == 9
    cat = f"{tmp_dir}/cat.csv"
    with open(cat, "w") as f:
        f.write("Technology,index,STC\nCdTe,A,100\n")
    assert main(["catalogue", "--raw", cat, "--out", f"{tmp_dir}/cat"]) == 0
    assert TableIn(f"{tmp_dir}/cat").read(spark).first().asDict() == {"panel_name": "A", "STC": 100.0, "Technology": "CdTe"}
    assert main(["approved", "--raw", cat, "--out", f"{tmp_dir}/ap"]) == 0
    assert TableIn(f"{tmp_dir}/ap").read(spark).columns == ["Technology", "index", "STC"]


def test_malformed_readings_stop_the_job(spark, tmp_dir):
    for bad in ("12.5", "x"):
        raw = f"{tmp_dir}/raw-{bad}.csv"
        with open(raw, "w") as f:
            f.write(f"epoch,watts\n1704103200.0,{bad}\n")
        with pytest.raises(Exception):
            main(["irradiance", "--raw", raw, "--hourly", f"{tmp_dir}/h{bad}", "--labelled", f"{tmp_dir}/l{bad}"])


def test_cli_stamped_builds_deliveries_and_appends(spark, tmp_dir, capsys):
    from rooftop.sources.builds import AppendOnceTable, StampedTable
    from rooftop.sources.deliveries import Deliveries

    from .test_addresses import frames
    e, b, m = frames(spark)
    for name, df in (("e", e), ("b", b), ("m", m)):
        TableOut(f"{tmp_dir}/{name}", mode=SaveMode.OVERWRITE, build_datetime=False).write(df)
        for part in range(2):  # each register in two deliveries
            rows = f"{tmp_dir}/raw-{name}{part}"
            df.filter(f"objectId % 2 = {part}").write.parquet(rows)
            assert main(["deliver", "--table", f"{tmp_dir}/d-{name}", "--name", f"half {part}", "--raw", rows]) == 0
    assert main(["deliver", "--table", f"{tmp_dir}/d-e", "--name", "half 0", "--raw", f"{tmp_dir}/e"]) == 0
    assert "was delivered before" in capsys.readouterr().out
    assert Deliveries(f"{tmp_dir}/d-e").read(spark).count() == e.count()
    tables = ["--entrances", f"{tmp_dir}/d-e", "--buildings", f"{tmp_dir}/d-b", "--municipalities", f"{tmp_dir}/d-m"]
    assert main(["--delivered", "--stamped", "--preview", "2", "addresses", *tables, "--out", f"{tmp_dir}/a"]) == 0
    assert "only showing top 2 rows" in capsys.readouterr().out
    assert sorted(r.entranceObjectId for r in StampedTable(f"{tmp_dir}/a").read(spark).collect()) == [1, 4, 6, 11]
    spark.createDataFrame([(1, 48.0, 17.0, "Year 1000.0"), (2, 49.0, 18.0, "none")],
                          "request_id int, lat double, lon double, body string").write.parquet(f"{tmp_dir}/replies")
    for _ in range(2):  # the second run adds nothing
        assert main(["--job-id", "monday", "addresses", "--entrances", f"{tmp_dir}/e", "--buildings", f"{tmp_dir}/b",
                     "--municipalities", f"{tmp_dir}/m", "--out", f"{tmp_dir}/once"]) == 0
    assert AppendOnceTable(f"{tmp_dir}/once").read(spark).count() == 4
    TableOut(f"{tmp_dir}/a2", mode=SaveMode.OVERWRITE, build_datetime=False).write(
        AppendOnceTable(f"{tmp_dir}/once").read(spark))
    assert main(["nearest", "--addresses", f"{tmp_dir}/a2", "--replies", f"{tmp_dir}/replies", "--out", f"{tmp_dir}/c"]) == 0
    got = TableIn(f"{tmp_dir}/c").read(spark)
    assert got.count() == 4 and "kwh_per_year_for_12_panel" in got.columns
    assert main(["--stamped", "adoption", "--exact", "--capacity", f"{tmp_dir}/c", "--out", f"{tmp_dir}/ad"]) == 0
    totals = StampedTable(f"{tmp_dir}/ad", "adoption").read(spark)
    assert {r.adoption: r.households for r in totals.groupBy("adoption").agg({"households": "sum"}).withColumnRenamed(
        "sum(households)", "households").collect()}[100] == 4


def test_cli_inputs_as_of_a_time(spark, tmp_dir):
    from datetime import datetime

    from rooftop.sources.builds import StampedTable
    rows = lambda v: spark.createDataFrame([("A", float(v))], "municipalityName string, possible_kwh_per_year_whole_roof double")
    roofs = StampedTable(f"{tmp_dir}/roofs")
    roofs.write(rows(1000), datetime(2024, 1, 1))
    roofs.write(rows(2000).selectExpr("*", "1 AS extra"), datetime(2024, 1, 2))
    for when, want in (("2024-01-01 12:00:00", 1000.0), ("now", 2000.0)):
        assert main(["--as-of", when, "emissions", "--roofs", f"{tmp_dir}/roofs", "--out", f"{tmp_dir}/co2"]) == 0
        assert {r.production_kwh for r in TableIn(f"{tmp_dir}/co2").read(spark).collect()} == {want}


def test_cli_readings_with_rejects(spark, tmp_dir, capsys):
    raw = f"{tmp_dir}/raw.csv"
    with open(raw, "w") as f:
        f.write("epoch,watts\n1704103200.0,10\n1704103220.0,x\n,3\n1704103240.0\n")
    assert main(["readings", "--raw", raw, "--out", f"{tmp_dir}/good", "--rejects", f"{tmp_dir}/bad"]) == 0
    assert "'good': 1" in capsys.readouterr().out
    assert TableIn(f"{tmp_dir}/good").read(spark).count() == 1
    assert sorted(r.reason for r in TableIn(f"{tmp_dir}/bad").read(spark).collect()) == ["fields", "missing", "type"]
