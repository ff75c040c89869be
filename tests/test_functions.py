import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from gaugeflow.functions import dates, geo, parse, spectral, text


def column(spark, values, function, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", function(F.col("v")).alias("x")).orderBy("i").collect()]


def test_safe_float(spark):
    raw = [None, "", "BDL", "NA", "-", "<0.5", "≥100", "2.5-3.0", "1,234", "-4.5", "abc", "nan", "1e3", " 7 "]
    assert column(spark, raw, parse.safe_float) == [None] * 5 + [0.5, 100.0, 2.75, 1234.0, -4.5, None, None, 1000.0, 7.0]


def test_finite(spark):
    assert column(spark, ["1.5", "NaN", "Infinity", "x", None], parse.finite) == [1.5, None, None, None, None]


def test_table_number(spark):
    raw = ["12.3-15.7", "<5", "nil", "***", "1,200", "about 4.5 mg", "", None, "~8"]
    assert column(spark, raw, parse.table_number) == [14.0, 5.0, None, None, 1200.0, 4.5, None, None, 8.0]


def test_safe_date(spark):
    raw = ["2025-07-29", "29/07/2025", "07/29/2025", "03/04/2025", "2011-2015", "nan", None, "garbage", "2025/01/02"]
    d = dt.date
    assert column(spark, raw, parse.safe_date) == [
        d(2025, 7, 29), d(2025, 7, 29), d(2025, 7, 29), d(2025, 4, 3), d(2011, 1, 1), None, None, None, d(2025, 1, 2),
    ]


def test_parse_date(spark):
    raw = [
        "2025-07-29T09:30:00.000Z", "29/07/2025", "5-6-49", "5.6.50", "3 Mar 2020", "Mar 3, 2020", "Jan 2024", "2024 Feb", "2024-Q3",
        "45000", "31/02/2020", "x", None,
    ]
    d = dt.date
    assert column(spark, raw, parse.parse_date) == [
        d(2025, 7, 29), d(2025, 7, 29), d(2049, 6, 5), d(1950, 6, 5), d(2020, 3, 3), d(2020, 3, 3), d(2024, 1, 1), d(2024, 2, 1), d(2024, 7, 1),
        d(2023, 3, 15), None, None, None,
    ]


def test_coordinates(spark):
    found = column(spark, ["26.85", "26°51'00\"N", "26 51 36 S", "26°30'W", "x"], parse.coordinate)
    assert found[0] == 26.85 and found[4] is None
    assert found[1:4] == [pytest.approx(26.85), pytest.approx(-26.86), pytest.approx(-26.5)]


def test_headers():
    assert text.header_parameter("Dissolved Oxygen (mg/L)") == "do"
    assert text.header_parameter("station_code") is None
    assert text.header_parameter("station_code", strict=False) == "cod"
    assert text.header_parameter("") is None


def test_names(spark):
    assert column(spark, ["ganga d/s KANPUR", "  UP  side ", ""], text.station_name) == ["Ganga D/S Kanpur", "UP Side", ""]
    assert column(spark, ["WQ Station, Patna!", "  "], text.comparable_name) == ["patna", ""]
    assert column(spark, [" uttaranchal ", "new delhi-x"], text.state_name) == ["Uttarakhand", "New Delhi-X"]
    assert column(spark, [" MG / L", "weird "], text.unit_name) == ["mg/L", "weird"]
    assert column(spark, ["12.0", " a1 ", None], text.station_id) == ["12", "a1", None]


def test_token_similarity(spark):
    df = spark.createDataFrame([("a b", "b c"), ("", "a"), ("x", "x")], "a string, b string")
    found = [r.s for r in df.select(text.token_similarity(F.col("a"), F.col("b")).alias("s")).collect()]
    assert found == [pytest.approx(1 / 3), 0.0, 1.0]


def test_geography(spark):
    km = column(spark, [0.0, 0.1 / 111.19493, 2.0], lambda v: geo.haversine_km(F.lit(25.0), F.lit(80.0), F.lit(25.0) + v, F.lit(80.0)), "double")
    assert km[0] == 0 and km[1] == pytest.approx(0.1, rel=1e-4) and km[2] == pytest.approx(222.39, rel=1e-4)
    assert column(spark, [0.1, 2.0, 4.0], geo.spatial_similarity, "double") == [1.0, 0.5, 0.0]
    assert column(spark, [80.9, 81.0, 87.0], geo.region, "double") == ["Upper Ganga", "Middle Ganga", "Lower Ganga"]


def test_seasons(spark):
    assert column(spark, [1, 3, 9, 10, 12], dates.season_code, "int") == [0, 1, 2, 3, 0]


def test_spectral(spark):
    row = spark.createDataFrame([(0.2, 0.1, 0.0)], "a double, b double, z double")
    found = row.select(spectral.normalized_difference(F.col("a"), F.col("b")), spectral.ratio(F.col("a"), F.col("z"))).first()
    assert found[0] == pytest.approx(1 / 3) and found[1] == 0.0
    assert column(spark, [0, 1 << 10, 1 << 11], spectral.clear_sky, "long") == [True, False, False]
    assert math.isclose(column(spark, [3.0], lambda v: spectral.stretched(v, F.lit(1.0), F.lit(5.0)), "double")[0], 0.5)
