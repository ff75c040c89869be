import datetime as dt

from pyspark.sql import functions as F

from gaugeflow.plans import pipelines
from gaugeflow.sources import readers, sinks
from gaugeflow.streaming import incremental


def test_open_data(spark, tmp_path):
    (tmp_path / "a.csv").write_text("Station Name,State,Year,BOD (mg/L),pH,Notes\n patna ghat,bihar,2012,3.5,7.1,x\n,bihar,2012,1,1,x\nBuxar,bihar,2012,NA,6.9,y\n")
    df = readers.open_data(readers.csv_strings(spark, str(tmp_path / "a.csv")).withColumnRenamed("Station Name", "station_name"), "data_gov_in")
    out = sorted((r.station_name, r.parameter, r.value, r.year) for r in df.collect())
    assert out == [("Buxar", "ph", 6.9, 2012), ("Patna Ghat", "bod", 3.5, 2012), ("Patna Ghat", "ph", 7.1, 2012)]


def test_record_pipeline(spark):
    rows = [("Patna", "c", "Bihar", 25.0, 85.0, dt.date(2024, 1, 1), 2024, p, v, s, i) for i, (p, v, s) in enumerate([("bod", "3", "cpcb"), ("bod", "3.1", "data_gov_in"), ("cod", "9", "cpcb"), ("ph", "99", "cpcb"), ("zz", "1", "cpcb")])]
    df = spark.createDataFrame(rows, "station_name string, station_code string, state string, latitude double, longitude double, date date, year int, parameter string, value string, source string, _seq long")
    fused, wide = pipelines.record_pipeline([df])
    assert fused.count() == 2
    r = wide.first()
    assert (r.bod, r.cod, r.ph, r.n_params) == (3.0, 9.0, None, 2) and r.all_sources == "cpcb; data_gov_in"


def test_spread_records(spark):
    df = spark.createDataFrame([("1", "s", "2020", None, "2", "4"), ("2", "s", "2021", "9", None, "4"), ("3", "s", "2021", None, None, "4")], "station_code string, station_name string, year string, bod string, bod_min string, bod_max string")
    out = {r.station_code: (r.value, r.value_min) for r in readers.spread_records(df, ["bod"]).collect()}
    assert out == {"1": (3.0, 2.0), "2": (9.0, None), "3": (4.0, None)}


def test_json_and_html(spark):
    series = spark.createDataFrame([('[{"ts_name":"Day.Mean","ts_unitsymbol":"mg/L","data":[["2024-01-01T00:00:00.000Z","1.5","100"],["2024-01-02T00:00:00.000Z","2"]]}]',)], "json string")
    assert [(r.aggregation, r.value) for r in readers.series_rows(series).collect()] == [("Day.Mean", 1.5)]
    feed = spark.createDataFrame([('[{"station_id":"7","timestamp":"2024-01-01 10:00:00","ts_value":"x","stationparameter_no":"DO","stationparameter_longname":"Diss"}]',)], "json string")
    r = readers.feed_rows(feed, {"Diss": "Dissolved Oxygen"}).first()
    assert (r.stationId, r.value, r.parameterName) == (7, None, "Dissolved Oxygen")
    html = spark.createDataFrame([(1, "<table><tr><th>head</th></tr><tr><td>1</td><td><b>A&nbsp;b</b></td><td>S</td><td>1</td><td>3</td><td>2</td></tr></table>")], "id int, html string")
    rows = readers.html_rows(html)
    assert rows.where("row = 1").first().cells == ["1", "A b", "S", "1", "3", "2"]
    assert [(r.parameter, r.value_min, r.value) for r in readers.annual_report(rows, ["temp"], skip=1).collect()] == [("temp", 1.0, 2.0)]


def test_tables_and_bands(spark):
    rows = [("t", 0, ["Station", "B.O.D. mg", "pH"]), ("t", 1, ["Patna", "3", "7"])]
    df = spark.createDataFrame(rows, "table string, row int, cells array<string>")
    found = readers.table_records(df, {"station": "name", "b.o.d": "bod", "ph": "ph"})
    assert sorted((r.name, r.cell) for r in found.collect()) == [("bod", "3"), ("name", "Patna"), ("ph", "7")]
    pixels = spark.createDataFrame([("f", "B2", v) for v in (1.0, 3.0, -1.0, float("nan"))], "file string, band string, value double")
    r = readers.band_statistics(pixels, nodata=-1.0).first()
    assert (r["count"], r["mean"], r["std"]) == (2, 2.0, 1.0)


def test_sniffed(spark, tmp_path):
    (tmp_path / "s.csv").write_text("River;Value\nGanga;1\nYamuna;2\n;\n")
    df = readers.sniffed_csv(spark, str(tmp_path / "s.csv"), "ganga")
    assert df.columns == ["river", "value"] and df.count() == 1
    assert readers.sniffed_csv(spark, str(tmp_path / "s.csv"), "indus").count() == 2


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "x")], "i int, s string, extra string")
    sinks.write_csv(df, str(tmp_path / "o"), ["s", "i", "none"])
    assert spark.read.csv(str(tmp_path / "o"), header=True).columns == ["s", "i"]
    assert sinks.json_report({"rows": df.select("i", "s")}).first().report.replace("\\", "") == '{"rows":[{"i":1,"s":"a"}]}'


def test_stream_is_idempotent(spark, tmp_path):
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()
    head = "stationId,timestamp,timestampDate,value,unit,parameterNo,parameterName\n"
    (src / "water_data_1.csv").write_text(head + "1,2024-01-01T00:00:00.000Z,2024-01-01,5,mg/L,DO,do\n1,2024-01-01T00:00:00.000Z,2024-01-01,7,,pH,ph\n")
    run = lambda: incremental.run_available(incremental.snapshot_stream(spark, str(src)), out, str(tmp_path / "cp"), ["do", "ph"])
    run()
    (src / "water_data_2.csv").write_text(head + "1,2024-01-01T00:00:00.000Z,2024-01-01,6,mg/L,DO,do\n2,2024-01-01T00:00:00.000Z,2024-01-01,1,mg/L,DO,do\n")
    run()
    run()
    rows = sorted((r.stationId, r.do, r.ph) for r in incremental.current_table(spark, out).collect())
    assert rows == [(1, 6.0, None), (2, 1.0, None)]  # the new row replaces the old one as a whole


def test_stream_survives_a_crash(spark, tmp_path, monkeypatch):
    """A batch that dies between its data and its manifest is written again from what was there before it."""
    src, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    src.mkdir()
    head = "stationId,timestamp,timestampDate,value,unit,parameterNo,parameterName\n"
    row = lambda station, day, value: f"{station},2024-01-0{day}T00:00:00.000Z,2024-01-0{day},{value},mg/L,DO,do\n"
    run = lambda: incremental.run_available(incremental.snapshot_stream(spark, str(src)), out, mark, ["do"])
    (src / "water_data_1.csv").write_text(head + row(1, 1, 5) + row(1, 2, 6))
    run()
    (src / "water_data_2.csv").write_text(head + row(1, 1, 7) + row(2, 1, 8))
    commit = incremental.Versions.commit

    def dies(self, number, days):
        raise RuntimeError("the executor is gone")

    monkeypatch.setattr(incremental.Versions, "commit", dies)
    try:
        run()
    except Exception as error:
        assert "gone" in str(error)
    else:
        raise AssertionError
    read = lambda: sorted((r.stationId, r.timestamp[:10], r.do) for r in incremental.current_table(spark, out).collect())
    assert read() == [(1, "2024-01-01", 5.0), (1, "2024-01-02", 6.0)]  # as before the batch
    monkeypatch.setattr(incremental.Versions, "commit", commit)
    run()
    assert read() == [(1, "2024-01-01", 7.0), (1, "2024-01-02", 6.0), (2, "2024-01-01", 8.0)]
    versions = incremental.Versions(spark, out)
    assert versions.current() == {"2024-01-01": 1, "2024-01-02": 0}  # the other day wasn't written
    batch = spark.createDataFrame([(3, "2024-01-01T00:00:00.000Z", "2024-01-01", 1.0, "mg/L", "DO", "do", "f")], "stationId long, timestamp string, timestampDate string, value double, unit string, parameterNo string, parameterName string, _file string")
    incremental.upsert_wide(out, ["do"])(batch, 1)  # a committed batch that comes again
    assert len(read()) == 3 and incremental.drop_old_versions(spark, out) == 1 and len(read()) == 3


def test_adhoc_query(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 9.0)], "i int, v double")
    assert [r.i for r in pipelines.query(df, "v > 6 & i == 2", ["i"]).collect()] == [2]
    try:
        pipelines.query(df, "nope >")
    except ValueError:
        pass
    else:
        raise AssertionError


def test_training_features(spark):
    bands = ["B2", "B3", "B4", "B5", "B6", "B7", "B8", "B8A", "B11", "B12"]
    readings = spark.createDataFrame([(f"s{i}", dt.date(2024, 1, 1), 25.0, 80.0, float(i), 7.0, i) for i in range(3)], "stationId string, date date, lat double, lon double, wq_BOD double, wq_pH double, _seq long")
    scenes = spark.createDataFrame([(f"s{i}", dt.date(2024, 1, 2), 5.0, *[0.1 * (k + 1) for k in range(10)]) for i in range(3)], f"stationId string, scene_date date, cloud double, {', '.join(b + ' double' for b in bands)}")
    out = pipelines.training_features(readings, scenes, ["wq_BOD", "wq_pH"])
    assert out.count() == 3 and {"NDWI", "B5_B4", "month_sin", "region"} <= set(out.columns)
    assert out.where(F.col("wq_BOD").isNull()).count() == 0
