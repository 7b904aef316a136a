import datetime as dt

from rooftop.plans.solar_jobs import (
    addresses_job,
    adoption_job,
    capacity_job,
    clean_registers_job,
    emissions_job,
    roofs_job,
)
from rooftop.sources.tables import Format, SaveMode, TableIn, TableOut


def _csv(path, header, rows):
    with open(path, "w", encoding="utf-8") as f:
        f.write(",".join(header) + "\n")
        for r in rows:
            f.write(",".join(r) + "\n")


def test_whole_chain_on_raw_files(spark, tmp_dir):
    _csv(f"{tmp_dir}/obce.csv", ["objectId", "municipalityName", "validFrom", "validTo", "changedAt"], [
        ["1", "Bratislava - Ružinov", "2020-01-01", "None", "2021-01-01 10:00:00"],
        ["2", "Trnava", "2020-01-01", "None", "junk"],
    ])
    _csv(f"{tmp_dir}/budovy.csv", ["objectId", "buildingTypeName", "buildingPurposeName",
                                   "propertyRegistrationNumber", "municipalityIdentifier", "changedAt",
                                   "validFrom", "validTo"], [
        ["10", "Rodinný dom", "PolnohospodĂˇrska", "11", "1", "2021-01-01 00:00:00", "None", "None"],
        ["20", "Iná budova", "Sklad", "22", "1", "None", "2019-05-05", "None"],
        ["30", "Rodinný dom", "x", "33", "2", "2021-01-01 00:00:00", "None", "None"],
    ])
    _csv(f"{tmp_dir}/vchody.csv", ["objectId", "postalCode", "axisB", "axisL",
                                   "propertyRegistrationNumberIdentifier", "validFrom", "validTo",
                                   "verifiedAt", "changedAt"], [
        ["100", "82101", "48.15", "17.15", "10", "None", "None", "None", "None"],
        ["101", "82101", "48.16", "17.16", "10", "None", "None", "None", "None"],
        ["102", "82102", "None", "17.17", "20", "None", "None", "None", "None"],
        ["103", "82103", "48.18", "17.18", "20", "None", "None", "None", "None"],
        ["104", "91701", "48.3", "17.3", "30", "None", "None", "None", "None"],
    ])
    raw = {k: TableIn(f"{tmp_dir}/{f}.csv", format=Format.CSV)
           for k, f in (("municipalities", "obce"), ("buildings", "budovy"), ("entrances", "vchody"))}
    clean = {k: TableOut(f"{tmp_dir}/clean_{k}", mode=SaveMode.OVERWRITE, build_datetime=False) for k in raw}
    got = clean_registers_job(spark, raw, clean)
    b = clean["buildings"].read_back(spark)
    assert "Polnohospodárska" in {r.buildingPurposeName for r in b.collect()}
    assert b.schema["changedAt"].dataType.simpleString() == "timestamp_ntz"
    m = {r.objectId: r.changedAt for r in clean["municipalities"].read_back(spark).collect()}
    assert m == {1: dt.datetime(2021, 1, 1, 10), 2: None}

    addr = TableOut(f"{tmp_dir}/addresses", mode=SaveMode.OVERWRITE, build_datetime=False)
    addresses_job(spark, clean["entrances"].as_input(), clean["buildings"].as_input(),
                  clean["municipalities"].as_input(), addr)
    a = addr.read_back(spark)
    assert sorted(r.entranceObjectId for r in a.collect()) == [100, 103]

    replies_path = f"{tmp_dir}/replies"
    spark.createDataFrame([("Bratislava - Ružinov", "Fixed slope\nYear      1234.5   x")],
                          "municipalityName string, body string").write.parquet(replies_path)
    cap = TableOut(f"{tmp_dir}/capacity", mode=SaveMode.OVERWRITE, build_datetime=False)
    capacity_job(spark, addr.as_input(), TableIn(replies_path), cap)
    assert {r.kwh_per_year_for_1_panel for r in cap.read_back(spark).collect()} == {1.2345}

    levels = {p: TableOut(f"{tmp_dir}/usage_{p}", mode=SaveMode.OVERWRITE, build_datetime=False)
              for p in (15, 30, 50, 100)}
    adoption_job(spark, cap.as_input(), levels)
    full = levels[100].read_back(spark).first()
    assert full["1_panel_total_mwh"] == 1.2345 * 2
    one = TableOut(f"{tmp_dir}/usage_all", mode=SaveMode.OVERWRITE, build_datetime=False, partition_by="adoption")
    adoption_job(spark, cap.as_input(), one)
    assert {r.adoption for r in one.read_back(spark).collect()} <= {15, 30, 50, 100}

    roofs = TableOut(f"{tmp_dir}/roofs", mode=SaveMode.OVERWRITE, build_datetime=False)
    roofs_job(spark, cap.as_input(), roofs)
    co2 = TableOut(f"{tmp_dir}/co2", mode=SaveMode.OVERWRITE, build_datetime=False)
    emissions_job(spark, roofs.as_input(), co2)
    assert co2.read_back(spark).count() == 3


def test_requests_job_with_catalogue_model(spark, tmp_dir):
    from rooftop.plans.solar_jobs import requests_job
    addr = TableOut(f"{tmp_dir}/addr", mode=SaveMode.OVERWRITE, build_datetime=False)
    addr.write(spark.createDataFrame([(5, "Town", "48.1", "17.1"), (3, "Town", "48.2", "17.2")],
                                     "entranceObjectId bigint, municipalityName string, axisB string, axisL string"))
    cat = TableOut(f"{tmp_dir}/cat", mode=SaveMode.OVERWRITE, build_datetime=False)
    cat.write(spark.createDataFrame([("Acme_X_1", 250.0, "CdTe")], "panel_name string, STC double, Technology string"))
    out = TableOut(f"{tmp_dir}/req", mode=SaveMode.OVERWRITE, build_datetime=False)
    requests_job(spark, addr.as_input(), out, catalogue=cat.as_input(), model_name="Acme X")
    r = out.read_back(spark).first()
    assert (r.axisB, r.kwp, r.pv_tech) == ("48.2", 0.25, "CdTe")
    assert "&peakpower=0.25&" in r.request and "&pvtechchoice=CdTe&" in r.request
