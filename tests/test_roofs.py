import math

import pytest

from rooftop.functions.formulas import PANEL_FOOTPRINT_M2
from rooftop.operators.roofs import check_roof_areas, default_roof_areas, roof_panels


def test_default_area_list():
    a = default_roof_areas()
    assert len(a) == 22 and sum(a) / len(a) == 140 and min(a) >= 40 and max(a) <= 180


def test_check_roof_areas_rejects():
    with pytest.raises(ValueError):
        check_roof_areas([10, 270])
    with pytest.raises(ValueError):
        check_roof_areas([100, 120])


def test_footprint_golden():
    assert PANEL_FOOTPRINT_M2 == (1.755 + 1) * (1.038 + 1)
    assert math.floor(140 / PANEL_FOOTPRINT_M2) == 24


def test_roof_panels(spark):
    cap = spark.createDataFrame([(i, 2.0, 140) for i in range(1, 45)],
                                "entranceObjectId bigint, kwh_per_year_for_1_panel double, area int")
    areas = default_roof_areas()
    got = {r.entranceObjectId: r for r in roof_panels(cap).collect()}
    for i in range(1, 45):
        r = got[i]
        assert r.area == areas[i % 22]            # row number i for key i
        assert r.possible_panel_count == math.floor(areas[i % 22] / PANEL_FOOTPRINT_M2)
        assert r.possible_kwh_per_year_whole_roof == 2.0 * r.possible_panel_count
        assert r.panel_area == PANEL_FOOTPRINT_M2
    constant = roof_panels(cap, areas=[140] * 22)
    assert {r.possible_panel_count for r in constant.collect()} == {24}
