"""Source adapters, audit and models on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.operators import models
from gaugeflow.plans import audit
from gaugeflow.sources import adapters, readers


def test_sensor_rows_count_before_the_file(spark, tmp_path):
    (tmp_path / "raw.csv").write_text("stationId,timestamp,latitude,longitude,station_name,state,pH,wq_Nitrate,Note\n7.0,2024-01-02T03:04:05Z,0,80.5,,,7.1,BDL,x\n7,2024-01-03T00:00:00Z,26.1,80,Own,UP,<8,2-4,x\n9,2024-01-03T00:00:00Z,,,,,7,1,x\n,2024-01-03T00:00:00Z,1,1,,,7,1,x\n7,never,1,1,,,7,1,x\n")
    (tmp_path / "st.csv").write_text("station_id,station_name,latitude,longitude,state,site_name\n7,First,25.0,81.0,A,Yamuna bank\n7,Last,25.5,81.0,Bihar,on the Yamuna\n")
    out = adapters.SensorAdapter(str(tmp_path / "raw.csv"), str(tmp_path / "st.csv")).run(spark)
    assert out.columns == schema.CANONICAL.names
    found = sorted((r.sample_date, r.parameter, r.value, r.station_name, r.state, r.latitude, r.longitude, r.river, r.station_id) for r in out.collect())
    day = lambda d: dt.date(2024, 1, d)
    assert found == [
        (day(2), "ph", 7.1, "Last", "Bihar", 25.5, 80.5, "Yamuna", "cpcb_7"),
        (day(3), "nitrate", 3.0, "Own", "UP", 26.1, 80.0, "Yamuna", "cpcb_7"),
        (day(3), "ph", 8.0, "Own", "UP", 26.1, 80.0, "Yamuna", "cpcb_7"),
    ]
    assert adapters.SensorAdapter(spark.createDataFrame([("1",)], "x string")).run(spark).count() == 0


def test_hydrology_of_sheets_and_nothing(spark):
    one = spark.createDataFrame([("Long  name of a very far away gauge", "01-02-2020", "5", "1,000")], "`Site` string, `Date` string, `Gauge Level` string, `Flow (cusec)` string")
    out = adapters.HydrologyAdapter({"a": one, "b": one.limit(0)}).run(spark).collect()
    assert sorted((r.parameter, r.value, r.unit, r.station_id) for r in out) == [("discharge", 1000.0, "ft³/s", "cwc_long_name_of_a_very_far_away_g"), ("water_level", 5.0, "m", "cwc_long_name_of_a_very_far_away_g")]
    assert adapters.HydrologyAdapter({}).run(spark).count() == 0


def test_readers_of_packages(spark):
    df = spark.createDataFrame([("Narmada ghat", "x"), ("Other", "narmada"), (None, "y")], "Station string, note string")
    assert readers.naming(df, ["narmada"]).count() == 1 and readers.naming(df.toDF("a", "b"), ["Narmada"]).count() == 2
    assert [tuple(r) for r in readers.manifest({"p": df}).collect()] == [("p", 3, 2)]


def test_audit_of_a_small_set(spark):
    long = spark.createDataFrame([("A", "bod", "cpcb", "valid", 1.0, 2000, "X"), ("A", "cod", "data_gov_in", "suspect_consistency", 0.5, 2010, "X"), ("12", "ph", "cpcb", "valid", 0.9, 2010, None)], "station_name string, parameter string, source string, quality_flag string, trust_score double, year int, state string")
    wide = spark.createDataFrame([("A", "X", 25.0, 80.0, dt.date(2000, 1, 1), 2000, 3.0, 2.0, None), ("12", None, None, 80.0, dt.date(2010, 1, 1), 2010, None, None, 7.0)], "station_name string, state string, latitude double, longitude double, date date, year int, bod double, cod double, ph double")
    found = audit.audit(long, wide)
    score = found["score"].first()
    assert (score.station_resolution, score.spatial_coverage, score.temporal_span, score.multi_source_pct) == (50.0, 50.0, 50.0, 50.0)
    assert score.param_fill_avg == pytest.approx(50.0) and score.overall == pytest.approx((50 + 50 + 200 / 3 + 50 + 50 + 50) / 6, abs=0.01)
    assert tuple(found["pairs"].first()) == (1, 0, 0.0) and found["multi_source"].first().station_name == "A"
    assert found["contribution"].where("source = 'INTEGRATED'").first().records == 3
    checks = audit.sanity(long, wide).first()
    assert (checks.numeric_stations, checks.suspect_consistency, checks.suspect_pct) == (1, 1, 33.3)


def test_models(spark):
    df = spark.range(400).select((F.col("id") % 8).alias("g"), (F.col("id") % 20).cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b")).withColumn("y", 3 * F.col("a") - F.col("b") + 1)
    df = df.union(df.limit(1).withColumn("a", F.lit(None).cast("double")))
    made = models.regressors(trees=8, rounds=5)
    linear = models.fit(df, ["a", "b"], "y", made["Linear Regression"])
    assert models.linear_terms(linear, ["a", "b"]) == pytest.approx({"a": 3, "b": -1, "intercept": 1}, abs=1e-6)
    score = models.cross_validated(df, ["a", "b"], "y", "g", made["Linear Regression"], k=4).first()
    assert score.n == 400 and score.r2 > 0.999
    forest = models.fit(df, ["a", "b"], "y", made["Random Forest"])
    out = models.predict(df, ["a", "b"], forest)
    assert out.count() == 400 and out.where("low <= high AND predicted BETWEEN low - 1e-9 AND high + 5").count() > 350
    assert models.importances(forest, ["a", "b"])[0][0] == "a"
    boosted = models.predict(df, ["a", "b"], models.fit(df, ["a", "b"], "y", made["Boosted Trees"]))
    assert boosted.where("low IS NULL").count() == 400
