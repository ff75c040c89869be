"""Queries of the parsers, readers, adapters, joins, reports and pipelines, beside their SQL."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import geo, parse, spectral, text
from gaugeflow.operators import entity, features, lookup, models, profile, quality, reshape, temporal, verdicts
from gaugeflow.plans import audit, pipelines
from gaugeflow.plans.bindings import PARAMETERS, observations, table
from gaugeflow.plans.catalog import register
from gaugeflow.scratch import scratch_path
from gaugeflow.sources import adapters, readers, sinks
from gaugeflow.streaming import incremental


def _literal(value) -> str:
    """A value as a DuckDB literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("'", "''") + "'"


def cases(name: str, given: dict[str | None, object], function: Callable[[Column], Column], kind: str, sql_kind: str) -> None:
    """Register ``function`` over the rows of ``part``, which take the texts of ``given`` in turn, and the expected values."""
    raw, expected = list(given), list(given.values())

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        text_ = F.element_at(F.array(*[F.lit(r).cast("string") for r in raw]), (F.col("p_partkey") % len(raw) + 1).cast("int"))
        rows = table(spark, sf_dir, "part").select("p_partkey", text_.alias("raw"))
        return rows.select("p_partkey", function(F.col("raw")).cast(kind).alias("value"))

    query.__name__ = name
    listed = ", ".join(_literal(e) for e in expected)
    register(f"SELECT p_partkey, ([{listed}]::{sql_kind}[])[p_partkey % {len(raw)} + 1] AS value FROM part")(query)


# --- parsers -----------------------------------------------------------------------

cases(
    "numbers_of_sources",
    {
        "1.5": 1.5, " 7 ": 7.0, "-3": -3.0, "+.5e1": 5.0, "1e-5": 1e-5, "2.": 2.0, "4-8": 6.0, "0.5 - 1.5": 1.0, "-4-8": None, "1-2-3": None, "<0.3": 0.3, ">=5": None, "≤12": 12.0, "<>7": 7.0, "1,234.5": 1234.5,
        "12,34,567": 1234567.0, "BDL": None, "below detection": None, "N/A": None, "nil": None, "ND": None, "": None, " ": None, "-": None, None: None, "abc": None, "1f": None, "0x10": None, "NaN": None,
        "Infinity": None, "1e999": None, "5 mg": None,
    },
    parse.safe_float, "double", "DOUBLE",
)
cases(
    "plain_numbers",
    {"1.5": 1.5, " -2e3 ": -2000.0, "nan": None, "inf": None, "-inf": None, "1,5": None, "": None, None: None, "x": None, "7": 7.0},
    parse.finite, "double", "DOUBLE",
)
cases(
    "wide_numbers",
    {"1,234": 1234.0, " 8.5 ": 8.5, "NR": None, "NM": None, "*": None, "BDL": None, "-": None, "N/A": None, "NA": None, "": None, None: None, "-1.25": -1.25, "1e2": 100.0, "<3": None},
    parse.to_numeric, "double", "DOUBLE",
)
cases(
    "cell_numbers",
    {
        "<1.8": 1.8, "~ 12": 12.0, "≥ 4.5": 4.5, "3-5": 4.0, "3–6": 4.5, "1,200": 1200.0, "BDL": None, "nd": None, "--": None, "***": None, "n/a": None, "NR": None, "about 7.2 mg": 7.2, "pH 8": 8.0, "none": None, "": None,
        None: None, "0": 0.0,
    },
    parse.table_number, "double", "DOUBLE",
)
cases(
    "record_dates",
    {
        "2020-03-07": "2020-03-07", "2020-03-07T10:00": "2020-03-07", "07-03-2020": "2020-03-07", "07/03/2020": "2020-03-07", "2020/03/07": "2020-03-07", "12/25/2020": "2020-12-25", "31-02-2020": None, "2019": "2019-01-01",
        "2018 annual": "2018-01-01", "nan": None, "NaT": None, "None": None, "": None, None: None, "3 March": None, "1/2/2021": "2021-02-01",
    },
    parse.safe_date, "string", "VARCHAR",
)
cases(
    "canonical_dates",
    {
        "2020-03-07": "2020-03-07", "2020-03-07T23:59:59Z": "2020-03-07", "2020-03-07 10:00:00 +05:30": "2020-03-07", "7/3/2020": "2020-03-07", "07.03.2020": "2020-03-07", "2020/3/7": "2020-03-07", "07-03-49": "2049-03-07",
        "07-03-50": "1950-03-07", "7 Mar 2020": "2020-03-07", "7 march 2020": "2020-03-07", "Mar 7, 2020": "2020-03-07", "March 7 2020": "2020-03-07", "Mar 2020": "2020-03-01", "2020 Mar": "2020-03-01", "2020-Q3": "2020-07-01",
        "2020Q1": "2020-01-01", "43897": "2020-03-07", "29999": None, "31/02/2020": None, "yesterday": None, "": None, None: None,
    },
    parse.parse_date, "string", "VARCHAR",
)
cases(
    "mixed_times",
    {
        "2024-01-05T10:20:30Z": "2024-01-05 10:20:30", "2024-01-05T10:20:30.250Z": "2024-01-05 10:20:30", "2024-01-05T10:20:30+05:30": "2024-01-05 04:50:30", "2024-01-05 10:20:30": "2024-01-05 10:20:30",
        "05-01-2024 10:20": "2024-01-05 10:20:00", "2024-01-05": "2024-01-05 00:00:00", "5 Jan": None, "": None, None: None,
    },
    lambda c: F.date_format(parse.mixed_timestamp(c), "yyyy-MM-dd HH:mm:ss"), "string", "VARCHAR",
)
cases(
    "coordinates",
    {
        "25.5": 25.5, "-12.25": -12.25, "25°30'36\"N": 25.51, "25 30 36": 25.51, "82°30'0\"W": -82.5, "25°30'N": 25.5, "10 45.6 S": -10.76, "abc": None, "": None, None: None, "91": 91.0,
    },
    lambda c: F.round(parse.coordinate(c), 6), "double", "DOUBLE",
)

# --- names -------------------------------------------------------------------------

cases(
    "parameter_patterns",
    {
        "Temperature": "temperature", "temp of water": "temperature", "Water Temp (°C)": "temperature", "pH": "ph", "P.H.": "ph", "Hydrogen ion": "ph", "D.O. (mg/L)": "do", "Dissolved  Oxygen": "do", "BOD 5": "bod",
        "biochem oxygen demand": "bod", "C.O.D.": "cod", "Chemical Oxygen Demand": "cod", "Electrical Conductivity": "conductivity", "Specific conductance": "conductivity", "Turb": "turbidity", "T.D.S.": "tds",
        "Total Dissolved Solids": "tds", "TSS": "tss", "total suspended solids": "tss", "NO3 as N": "nitrate", "Nitrite": "nitrite", "no2-N": "nitrite", "Ammonia": "ammoniacal_nitrogen", "NH4": "ammoniacal_nitrogen",
        "Total Nitrogen": "total_nitrogen", "TN": "total_nitrogen", "PO4": "phosphate", "Total phosphorus": "total_phosphorus", "Cl-": "chloride", "Fluoride": "fluoride", "Sulfate": "sulphate", "SO4": "sulphate",
        "Total Alkalinity": "alkalinity", "Hardness": "hardness", "Ca": "calcium", "Mg": "magnesium", "Na": "sodium", "K": "potassium", "Fe": "iron", "Arsenic": "arsenic", "Cadmium": "cadmium", "Chromium": "chromium", "Cu": "copper",
        "Pb": "lead", "Hg": "mercury", "Nickel": "nickel", "Zn": "zinc", "Mn": "manganese", "Boron": "boron", "Se": "selenium", "Fecal Coliform": "fecal_coliform", "Faecal coli": "fecal_coliform", "FC": "fecal_coliform",
        "Total Coliform": "total_coliform", "TC": "total_coliform", "E. coli": "e_coli", "Color": "colour", "TOC": "toc", "Total organic carbon": "toc", "Oil & grease": "oil_grease", "Phenols": "phenol", "MBAS": "detergent",
        "Gauge level": "water_level", "Stage (m)": "water_level", "Discharge": "discharge", "Stream flow": "discharge", "Suspended sediment": "sediment_load", "Remarks": None, "": None, None: None,
    },
    text.raw_parameter, "string", "VARCHAR",
)
cases(
    "station_titles",
    {"  ganga   at KANPUR": "Ganga At Kanpur", "D/S of UP border": "D/S Of UP Border", "o'brien nagar": "O'Brien Nagar", "MCKENZIE": "Mckenzie", "A1 b2c": "A1 B2C", "IIT": "IIT", "": "", None: None},
    text.station_name, "string", "VARCHAR",
)
cases(
    "comparable_names",
    {"CPCB Monitoring Station, Kanpur": "kanpur", "WQ Water Quality at Patna-Ghat": "at patnaghat", "  SPCB  ": "", "Stations 12": "stations 12", "": "", None: None},
    text.comparable_name, "string", "VARCHAR",
)
cases(
    "states",
    {" UTTARANCHAL ": "Uttarakhand", "pradesh": "Uttar Pradesh", "West bengal": "West Bengal", "new state": "New State", "JAMMU & KASHMIR": "Jammu & Kashmir", "": "", None: None},
    text.state_name, "string", "VARCHAR",
)
cases(
    "rivers",
    {
        "On River Ganga at X": "Ganga", "YAMUNA bridge": "Yamuna", "hindon city": "Hindon", "Kali East": "Kali East", "Ghagra": "Ghagra", "burhi gandak": "Gandak", "Kosi barrage": "Kosi", "Son Nagar": "Son", "punpun": "Punpun",
        "Damodar": "Damodar", "Ramganga": "Ramganga", "Hooghly": "Hooghly", "Haridwar": "Ganga", "Tehri dam": "Ganga (Bhagirathi)", "Durgapur": "Damodar", "Sonipat drain": "Yamuna/Western drain", "Somewhere": "Ganga basin (unspecified)",
    },
    text.river_of, "string", "VARCHAR",
)
cases("known_rivers", {"Yamuna at Delhi": "yamuna", "mahanadi": "mahanadi", "Tapi": "tapi", "Thames": None, "": None, None: None}, lambda c: text.known_river(c, schema.KNOWN_RIVERS), "string", "VARCHAR")
cases("clean_strings", {"  a \t b\n c ": "a b c", "x": "x", "": "", None: None}, text.clean, "string", "VARCHAR")
cases("slugs", {"Hello, World!": "hello_world", "__A--b__": "a_b", "é": "", "x" * 90: "x" * 80, None: None}, text.slug, "string", "VARCHAR")
cases(
    "units",
    {" mg / L ": "mg/L", "PPM": "mg/L", "ug/l": "µg/L", "umho/cm": "µS/cm", "mmho/cm": "mS/cm", "deg C": "°C", "Fahrenheit": "°F", "cumec": "m³/s", "cusec": "ft³/s", "MPN / 100 ml": "MPN/100mL", "none": "", "furlong": "furlong", "": ""},
    text.unit_name, "string", "VARCHAR",
)
cases("station_ids", {"12.0": "12", " 7 ": "7", "1e3": "1000", "AB1": "AB1", "": "", None: None}, text.station_id, "string", "VARCHAR")
cases("default_units", {"ph": "", "temperature": "°C", "conductivity": "µS/cm", "fecal_coliform": "MPN/100mL", "turbidity": "NTU", "bod": "mg/L", "unknown": "", None: ""}, text.default_unit, "string", "VARCHAR")
cases("number_names", {"1234": True, "12a": False, "": False, None: False, "Patna": False, "007": True}, text.is_number_name, "boolean", "BOOLEAN")
cases(
    "edge_classes",
    {"NDWI>wq_pH": "Satellite→WQ", "wq_pH>wq_DO": "WQ→WQ", "NDWI>NDVI": "Satellite→Satellite", "wq_pH>NDWI": "WQ→Satellite", "x>NDWI": "Other", "NDWI>": "Other"},
    lambda c: text.edge_class(F.split_part(c, F.lit(">"), F.lit(1)), F.split_part(c, F.lit(">"), F.lit(2)), {"Satellite": ["NDWI", "NDVI"], "WQ": ["wq_pH", "wq_DO"]}), "string", "VARCHAR",
)
_HEADERS = {
    "Temp": "temperature", "pH Value": "ph", "Conductivity (µmhos/cm)": "conductivity", "D.O. (mg/l)": "do", "BOD_mg_l": "bod", "C.O.D.": "cod", "Nitrate-N": "nitrate", "Faecal_Coliform": "fecal_coliform",
    "Total Coliform (MPN/100ml)": "total_coliform", "TDS": "tds", "Turbidity NTU": "turbidity", "SO4": "sulphate", "NH3": "ammonia", "Remarks": None, "Station": None,
}


@register("SELECT header, parameter FROM (VALUES " + ", ".join(f"({_literal(h)}, {_literal(p)})" for h, p in _HEADERS.items()) + ") t(header, parameter)")
def header_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(h, text.header_parameter(h)) for h in _HEADERS], "header string, parameter string")


@register("""SELECT p_partkey, (contains(p_name, 'red')::INT + contains(p_name, 'ring')::INT) AS hits, CASE WHEN p_name LIKE '% ring' OR p_name LIKE '% red' THEN 1.0 ELSE 0.5 END::DOUBLE AS alike
FROM part WHERE p_name LIKE 'red %'""")
def keyword_and_row_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").where("p_name LIKE 'red %'")
    second = F.split("p_name", " ")[1]
    other = F.array(F.lit("RED"), F.when(second.isin("ring", "red"), F.upper(second)).otherwise("zzz"))
    return p.select("p_partkey", text.keyword_hits(F.col("p_name"), ["red", "ring"]).alias("hits"), text.row_similarity(F.split("p_name", " "), other).alias("alike"))


# --- sources -----------------------------------------------------------------------


@register("""SELECT event_id, 'Day.Mean' AS aggregation, 'mg/L' AS unit, strftime(ts, '%Y-%m-%d 00:00:00') AS timestamp, value, 100.0::DOUBLE AS quality_pct FROM events
UNION ALL SELECT event_id, 'Day.Max', 'mg/L', strftime(ts, '%Y-%m-%d 00:00:00'), value + 1, NULL FROM events WHERE event_id % 2 = 0""")
def series_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd"), F.lit("T00:00:00.000Z"))
    point = lambda v, q: F.array(stamp, v.cast("string"), q)
    series = lambda name, points: F.struct(F.lit(name).alias("ts_name"), F.lit("mg/L").alias("ts_unitsymbol"), points.alias("data"))
    short = F.array(stamp, F.lit("1"))
    both = F.array(
        series("Day.Mean", F.array(point(F.col("value"), F.lit("100")), short)),
        series("Day.Max", F.when(F.col("event_id") % 2 == 0, F.array(point(F.col("value") + 1, F.lit("x")))).otherwise(F.array(short))),
    )
    out = readers.series_rows(e.select("event_id", F.to_json(both).alias("json")))
    return out.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@register("""SELECT user_id AS "stationId", strftime(ts, '%Y-%m-%d') AS "timestampDate", CASE WHEN event_type <> 'error' THEN value END AS value, 'mg/L' AS unit, event_type AS "parameterNo",
CASE WHEN event_type = 'view' THEN 'Viewed' ELSE event_type END AS "parameterName" FROM events""")
def feed_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_type") == "error", "n/a").otherwise(F.col("value").cast("string"))
    one = F.struct(
        F.col("user_id").cast("string").alias("station_id"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("timestamp"), value.alias("ts_value"), F.lit("mg/L").alias("ts_unitsymbol"),
        F.col("event_type").alias("stationparameter_no"), F.col("event_type").alias("stationparameter_longname"),
    )
    return readers.feed_rows(e.select(F.to_json(F.array(one)).alias("json")), {"view": "Viewed"}).drop("timestamp")


@register("""SELECT l_orderkey, l_linenumber, CASE l_linenumber WHEN 1 THEN 'bod' ELSE 'ph' END AS parameter, l_quantity AS value_min, l_quantity + 2 AS value_max, l_tax AS value FROM lineitem WHERE l_linenumber <= 2""")
def report_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    cell = lambda c: F.concat(F.lit("<td> "), c.cast("string"), F.lit("&nbsp;</td>"))
    triple = F.concat(cell(F.col("l_quantity")), cell(F.col("l_quantity") + 2), cell(F.col("l_tax")))
    empty = F.lit("<td>-</td>" * 3)
    first = F.col("l_linenumber") == 1
    body = F.concat(F.when(first, triple).otherwise(empty), F.when(first, empty).otherwise(triple))
    rows = F.concat(F.lit("<table><TR><th>head</th></TR><tr>"), cell(F.lit("1")), cell(F.lit("<b>Place</b>")), cell(F.lit("Bihar")), body, F.lit("</tr><tr><td>note</td></tr></table>"))
    found = readers.annual_report(readers.html_rows(li.select("l_orderkey", "l_linenumber", rows.alias("html"))), ["bod", "ph"], skip=1)
    return found.where("value IS NOT NULL").select("l_orderkey", "l_linenumber", "parameter", "value_min", "value_max", "value")


@register("""WITH t AS (SELECT o_orderkey, o_custkey FROM orders)
SELECT o_orderkey::VARCHAR AS "table", 'bod' AS name, o_custkey::VARCHAR AS cell FROM t UNION ALL SELECT o_orderkey::VARCHAR, 'name', 'Patna' FROM t""")
def extracted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = F.array(
        F.struct(F.lit(0).alias("row"), F.array(F.lit("Annual"), F.lit("report"), F.lit("")).alias("cells")),
        F.struct(F.lit(1).alias("row"), F.array(F.lit("Station name"), F.lit("B.O.D. (mg/L)"), F.lit("Remark")).alias("cells")),
        F.struct(F.lit(2).alias("row"), F.array(F.lit("Patna"), F.col("o_custkey").cast("string"), F.lit("x")).alias("cells")),
    )
    long = o.select(F.col("o_orderkey").cast("string").alias("table"), F.explode(rows).alias("r")).select("table", "r.row", "r.cells")
    return readers.table_records(long, {"station": "name", "b.o.d": "bod"}).select("table", "name", "cell")


@register("""WITH t AS (SELECT o_orderkey % 40 AS k, o_orderkey, o_custkey FROM orders WHERE o_orderkey < 400) SELECT (k // 10)::INT AS "table", (row_number() OVER (PARTITION BY k // 10 ORDER BY k, o_orderkey) - 1)::INT AS row, o_custkey AS first FROM t""")
def table_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forty fragments, of which ten each have as many columns."""
    o = table(spark, sf_dir, "orders").where("o_orderkey < 400")
    k = (F.col("o_orderkey") % 40).cast("int")
    cells = F.concat(F.array(F.col("o_custkey").cast("string")), F.array_repeat(F.lit("x"), (F.floor(k / 10) + 2).cast("int")))
    out = readers.joined_fragments(o.select(k.alias("table"), F.col("o_orderkey").alias("row"), cells.alias("cells")))
    return out.select(F.col("table").cast("int").alias("table"), F.col("row").cast("int").alias("row"), F.col("cells")[0].cast("long").alias("first"))


@register("""SELECT l_orderkey::VARCHAR AS station_code, parameter, round(value, 6) AS value, CASE WHEN parameter = 'ph' THEN l_tax END AS value_min, l_linenumber AS line FROM (
SELECT *, unnest(['bod', 'cod', 'ph', 'do']) AS parameter, unnest([l_quantity, l_discount, (l_tax + l_tax + 2) / 2, l_tax + 5]) AS value FROM lineitem)""")
def spread_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = lambda c: c.cast("string")
    li = table(spark, sf_dir, "lineitem").select(
        s(F.col("l_orderkey")).alias("station_code"), s(F.col("l_linenumber")).alias("station_name"), F.lit("2020").alias("year"), s(F.col("l_quantity")).alias("bod"), F.lit("1").alias("bod_min"), F.lit("2").alias("bod_max"),
        F.lit(None).cast("string").alias("cod"), s(F.col("l_discount")).alias("cod_min"), F.lit("BDL").alias("ph"), s(F.col("l_tax")).alias("ph_min"), s(F.col("l_tax") + 2).alias("ph_max"), s(F.col("l_tax") + 5).alias("do_max"),
        F.lit("x").alias("do"),
    )
    out = readers.spread_records(li, ["bod", "cod", "ph", "do", "tds"])
    return out.select("station_code", "parameter", F.round("value", 6).alias("value"), "value_min", F.col("station_name").cast("int").alias("line"))


@register("""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'Odd Place' ELSE 'Station ' || user_id END AS station_name, 'Bihar' AS state, 2020::INT AS year, parameter, value FROM (
SELECT * EXCLUDE (value), unnest(['bod', 'ph']) AS parameter, unnest([value, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 14 END])::DOUBLE AS value FROM (SELECT event_id, user_id, value FROM events)) WHERE value IS NOT NULL AND event_id % 7 <> 0""")
def open_data_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    name = F.when(F.col("event_id") % 7 == 0, None).when(F.col("event_id") % 3 == 0, "odd  place").otherwise(F.concat(F.lit("station "), F.col("user_id").cast("string")))
    wide = e.select(
        name.alias("Station_Name"), F.lit("bihar").alias("State"), F.lit("2020").alias("Year"), F.col("value").cast("string").alias("B.O.D. (mg/l)"),
        F.when(F.col("event_id") % 5 == 0, "NA").otherwise((F.col("event_id") % 14).cast("string")).alias("pH"), F.col("event_id").alias("_seq"),
    )
    out = readers.open_data(wide, "data_gov_in")
    return out.select(F.floor(F.col("_seq") / 1000).alias("event_id"), "station_name", "state", "year", "parameter", "value")


def _sensors(spark: SparkSession, sf_dir: str) -> adapters.SensorAdapter:
    e = table(spark, sf_dir, "events").where("event_id % 11 <> 0")
    raw = e.select(
        F.concat((F.col("user_id") + 1).cast("string"), F.lit(".0")).alias("stationId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"),
        F.when(F.col("event_id") % 4 == 0, "26.5").when(F.col("event_id") % 4 == 1, "0").otherwise("").alias("latitude"), F.lit("81.25").alias("longitude"), F.when(F.col("event_id") % 2 == 0, " Own name ").otherwise("").alias("station_name"),
        F.col("value").cast("string").alias("Biochemical Oxygen Demand"), F.when(F.col("event_id") % 3 == 0, "BDL").otherwise("<7").alias("wq_pH"), F.lit("9").alias("Unknown"), F.col("event_id").alias("_seq"),
    )
    users = e.select("user_id").distinct()
    stations = users.select(
        (F.col("user_id") + 1).cast("string").alias("station_id"), F.concat(F.lit("Place "), F.col("user_id").cast("string")).alias("station_name"), F.when(F.col("user_id") % 5 == 0, "").otherwise("25.0").alias("latitude"),
        F.lit("80").alias("longitude"), F.lit("Bihar").alias("state"), F.lit("River Ganga basin").alias("site_name"), F.col("user_id").alias("_seq"),
    )
    return adapters.SensorAdapter(raw, stations)


@register("""WITH e AS (SELECT * FROM events WHERE event_id % 11 <> 0),
r AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 4 = 0 THEN 26.5 WHEN user_id % 5 = 0 THEN NULL ELSE 25.0 END::DOUBLE AS latitude, value FROM e),
m AS (SELECT event_id, user_id, ts, latitude, 'bod' AS parameter, value, 'Biochemical Oxygen Demand' AS source_parameter, 'mg/L' AS unit FROM r
UNION ALL SELECT event_id, user_id, ts, latitude, 'ph', 7.0, 'wq_pH', '' FROM r WHERE event_id % 3 <> 0)
SELECT 'cpcb_' || (user_id + 1) AS station_id, CASE WHEN event_id % 2 = 0 THEN 'Own name' ELSE 'Place ' || user_id END AS station_name, 'Ganga' AS river, 'Bihar' AS state, latitude, 81.25::DOUBLE AS longitude, strftime(ts, '%Y-%m-%d') AS sample_date,
parameter, value, unit, source_parameter, event_id FROM m WHERE latitude IS NOT NULL""")
def sensor_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _sensors(spark, sf_dir).run(spark)
    return out.select("station_id", "station_name", "river", "state", "latitude", "longitude", F.col("sample_date").cast("string").alias("sample_date"), "parameter", "value", "unit", "source_parameter", F.floor(F.col("_seq") / 1000).alias("event_id"))


@register("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderdate::DATE::VARCHAR AS d, o_totalprice AS v FROM orders WHERE o_orderkey % 9 <> 0)
SELECT 'cwc_site_' || (o_custkey % 50) AS station_id, d AS sample_date, 'discharge' AS parameter, 'ft³/s' AS unit, v AS value, o_orderkey FROM o WHERE o_orderkey % 2 = 0
UNION ALL SELECT 'cwc_site_' || (o_custkey % 50), d, 'water_level', 'm', v / 1000, o_orderkey FROM o WHERE o_orderkey % 2 = 1
UNION ALL SELECT 'cwc_site_' || (o_custkey % 50), d, 'turbidity', 'NTU', 3.0, o_orderkey FROM o WHERE o_orderkey % 2 = 1""")
def hydrology_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    name = F.when(F.col("o_orderkey") % 9 == 0, " ").otherwise(F.concat(F.lit("Site  "), (F.col("o_custkey") % 50).cast("string")))
    day = F.date_format("o_orderdate", "dd-MM-yyyy")
    flows = o.where("o_orderkey % 2 = 0").select(name.alias("Site"), day.alias("Obs Date"), F.col("o_totalprice").cast("string").alias("Discharge (cusec)"), F.lit("?").alias("Remark"), F.col("o_orderkey").alias("_seq"))
    levels = o.where("o_orderkey % 2 = 1").select(
        name.alias("Station Name"), day.alias("DATE"), (F.col("o_totalprice") / 1000).cast("string").alias("Water Level (m)"), F.lit("2-4").alias("Turbidity"), F.col("o_orderkey").alias("_seq"),
    )
    out = adapters.HydrologyAdapter({"flows": flows, "levels": levels}).run(spark)
    return out.select("station_id", F.col("sample_date").cast("string").alias("sample_date"), "parameter", "unit", "value", F.floor(F.col("_seq") / 1000).alias("o_orderkey"))


@register("""SELECT 'dgov_patna_ghat_' || (o_custkey % 30) AS station_id, parameter, value, source_parameter, o_orderkey FROM (
SELECT *, unnest(['bod', 'nitrate']) AS parameter, unnest(['B.O.D. (mg/l)', 'NO3']) AS source_parameter, unnest([o_totalprice, 1200.0]) AS value FROM orders)""")
def open_data_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.concat(F.lit(" Patna Ghat "), (F.col("o_custkey") % 30).cast("string")).alias("Monitoring Site"), F.date_format("o_orderdate", "d MMM yyyy").alias("Sampling Date"), F.lit("25.6").alias("Latitude"),
        F.col("o_totalprice").cast("string").alias("B.O.D. (mg/l)"), F.lit("1,200").alias("NO3"), F.lit("5").alias("Weather"), F.col("o_orderkey").alias("_seq"),
    )
    out = adapters.OpenDataAdapter(raw).run(spark)
    return out.select("station_id", "parameter", "value", "source_parameter", F.floor(F.col("_seq") / 1000).alias("o_orderkey"))


@register("""SELECT 'gemstat_' || c_custkey AS station_id, '2015-06-01' AS sample_date, 'do' AS parameter, c_acctbal AS value, 'mg/L' AS unit FROM customer WHERE c_custkey % 3 <> 2""")
def long_file_adapter(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    country = F.when(F.col("c_custkey") % 3 == 0, "India").when(F.col("c_custkey") % 3 == 1, " ").otherwise("Nepal")
    raw = c.select(
        F.col("c_custkey").cast("string").alias("Station Number"), F.lit("").alias("Station Name"), country.alias("Country"), F.lit("01/06/2015").alias("Sample Date"), F.lit("Dissolved Oxygen (total)").alias("Parameter"),
        F.col("c_acctbal").cast("string").alias("Analysis Result"), F.lit("").alias("Value"), F.lit("mg/L").alias("Units"),
    )
    out = adapters.LongFileAdapter(raw).run(spark)
    return out.select("station_id", F.col("sample_date").cast("string").alias("sample_date"), "parameter", "value", "unit")


@register("""SELECT source, count(*) AS n, count(DISTINCT _seq) AS keys FROM (SELECT 'data_gov_in' AS source, o_orderkey AS _seq FROM orders UNION ALL SELECT 'cwc', o_orderkey FROM orders) GROUP BY 1""")
def all_adapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    base = [F.concat(F.lit("Site "), F.col("o_custkey").cast("string")).alias("Station"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("Date"), F.col("o_orderkey").alias("_seq")]
    both = [adapters.OpenDataAdapter(o.select(*base, F.lit("7").alias("pH"))), adapters.HydrologyAdapter(o.select(*base, F.lit("7").alias("Discharge")))]
    return adapters.collect_records(both, spark).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("_seq").alias("keys"))


@register(
    "SELECT * FROM (SELECT '2012' AS file, o_orderkey::VARCHAR AS station_id, '2012-07-01' AS date, 2012::INT AS year, o_totalprice AS oxygen, 7.0::DOUBLE AS ph, NULL::DOUBLE AS coliform FROM orders "
    "UNION ALL SELECT 'median', o_orderkey::VARCHAR, year(o_orderdate) || '-07-01', year(o_orderdate)::INT, o_totalprice, 8.0, 20.0 FROM orders "
    "UNION ALL SELECT '2018-20', 'Place ' || o_orderkey, '2019-07-01', 2019, o_totalprice, NULL, 40.0 FROM orders "
    "UNION ALL SELECT '2021', o_orderkey::VARCHAR, '2021-07-01', 2021, o_totalprice, NULL, 50.0 FROM orders "
    "UNION ALL SELECT 'surface', 'Place ' || o_orderkey, o_orderdate::DATE::VARCHAR, year(o_orderdate)::INT, o_totalprice, 6.0, 60.0 FROM orders WHERE o_orderkey % 2 = 0)"
)
def open_data_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five sub-formats of the open-data files."""
    o = table(spark, sf_dir, "orders")
    key, value, place = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string"), F.concat(F.lit("Place "), F.col("o_orderkey").cast("string"))
    lit = lambda v, name: F.lit(v).alias(name)
    y2012 = o.select(key.alias("station_code"), place.alias("locations"), value.alias("d_o__mean"), lit("7", "ph_mean"), lit("9", "d_o__min"), lit("x", "fecal_coliform_mean"))
    median = o.select(key.alias("station_code"), place.alias("station_name"), F.year("o_orderdate").cast("string").alias("_year"), value.alias("do__mg_l_"), lit("8", "ph"), lit("20", "fc__mpn_100ml_"))
    y2018 = o.select(place.alias("station_name"), lit("1", "dissolved_oxygen_2019"), value.alias("dissolved_oxygen_2020"), lit("2", "faecal_coliform_2018"), lit("40", "Faecal_Coliform_2020"))
    y2021 = o.select(key.alias("station_code"), place.alias("station_name"), value.alias("dissolved_oxygen"), lit("50", "faecal_coliform"))
    basin = F.when(F.col("o_orderkey") % 2 == 0, "GANGA basin").otherwise("Indus")
    surface = o.select(basin.alias("Basin"), place.alias("Station_Name"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("Date"), F.year("o_orderdate").cast("string").alias("Year"), value.alias("_do"), lit("6", "ph_gen"), lit("60", "fcol_mpn"))
    frames = {
        "2012": readers.yearly_means(y2012, "datagov", 2012), "median": readers.yearly_medians(median, "datagov"), "2018-20": readers.stationwise(y2018, "datagov", 2019, "2020"),
        "2021": readers.stationwise(y2021, "datagov", 2021, id_col="station_code"), "surface": readers.surface_water(surface, "datagov"),
    }
    every = reshape.union_all([df.withColumn("file", F.lit(n)) for n, df in frames.items()])
    return every.select("file", "station_id", F.col("date").cast("string").alias("date"), "year", F.col("Dissolved_Oxygen_mg_l").alias("oxygen"), F.col("pH").alias("ph"), F.col("Fecal_Coliform_MPN_100ml").alias("coliform"))


@register("""SELECT o_orderkey::VARCHAR AS station_id, 'unknown' AS station_name, o_orderdate::DATE::VARCHAR AS date, year(o_orderdate)::INT AS year, 2.0::DOUBLE AS nitrate, o_totalprice AS bod FROM orders WHERE o_orderpriority LIKE '%URGENT%' OR o_orderpriority LIKE '%HIGH%'""")
def standard_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of a portal with a word filter; of two columns for one measure the last wins."""
    o = table(spark, sf_dir, "orders")
    raw = o.select(
        F.col("o_orderkey").cast("string").alias("code"), F.col("o_orderpriority").alias("Station"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("when"), F.lit("1").alias("Nitrate"), F.lit("2").alias("Nitrate N"),
        F.col("o_totalprice").cast("string").alias("BOD"),
    )
    columns = {"Nitrate": "Nitrate_mg_l", "Nitrate N": "Nitrate_mg_l", "BOD": "BOD_mg_l"}
    frames = [readers.standard_source(raw, "nwdp", columns, date="when", id_col="code", contains=("Station", word)) for word in ("urgent", "high")]
    out = readers.consolidated(frames, ["station_id", "date"])
    return out.select("station_id", F.lit("unknown").alias("station_name"), F.col("date").cast("string").alias("date"), "year", F.col("Nitrate_mg_l").alias("nitrate"), F.col("BOD_mg_l").alias("bod"))


@register("""SELECT user_id::VARCHAR AS station, event_type, value, file FROM (SELECT *, CASE event_id % 2 WHEN 0 THEN 'a.csv' ELSE 'b.csv' END AS file FROM events WHERE event_id < 500)""")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two files of chosen columns are written, found again and read."""
    e = table(spark, sf_dir, "events").where("event_id < 500").select(F.col("user_id").alias("station"), "event_type", "value", "event_id")
    root = scratch_path(spark, "csv")
    for k, name in ((0, "a.csv"), (1, "b.csv")):
        sinks.write_csv(e.where(F.col("event_id") % 2 == k), f"{root}/{name}", ["station", "event_type", "value", "absent"])
    found = readers.staged(spark, {"a.csv": f"{root}/a.csv", "b.csv": f"{root}/b.csv", "c.csv": f"{root}/c.csv"})
    frames = [readers.csv_strings(spark, path).withColumn("file", F.lit(name)) for name, path in found.items()]
    every = lookup.require(readers.consolidated(frames, ["station"]), ["station", "value"])
    return every.select("station", "event_type", F.col("value").cast("double").alias("value"), "file")


@register("""SELECT n_name AS river, n_nationkey::VARCHAR AS value FROM nation WHERE contains(n_name, '_1')""")
def sniffed_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "sniffed")
    n = table(spark, sf_dir, "nation").select(F.col("n_name").alias(" River "), F.col("n_nationkey").alias("Value%"))
    n.coalesce(1).write.option("sep", ";").option("header", True).csv(path)
    return readers.sniffed_csv(spark, path, "N_1")


@register("SELECT s_suppkey FROM supplier WHERE contains(lower(s_name), '7')")
def naming_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.naming(table(spark, sf_dir, "supplier"), ["7"]).select("s_suppkey")


@register("SELECT 'orders' AS package, count(*) AS rows, 6::INT AS columns FROM orders UNION ALL SELECT 'nation', count(*), 3 FROM nation")
def manifests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.manifest({n: table(spark, sf_dir, n) for n in ("orders", "nation")})


@register("SELECT s_suppkey, unnest(['BOD', 'DO', 'pH']) AS parameter FROM supplier")
def fetch_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.jobs(table(spark, sf_dir, "supplier").select("s_suppkey"), ["pH", "DO", "BOD"])


# --- filters and joins ---------------------------------------------------------------

@register("""SELECT event_id, value, unit, year FROM (SELECT event_id, value, user_id, event_id % 3 AS s, CASE event_type WHEN 'view' THEN 'mg/L' WHEN 'purchase' THEN '' ELSE 'mg/L' END AS unit, year(ts)::INT AS year FROM events WHERE event_type IN ('view', 'purchase'))
WHERE s <> 2 OR user_id % 2 = 0 OR user_id % 5 = 0""")
def standardized_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select(
        "event_id", F.when(F.col("user_id") % 5 == 0, "Ganga Ghat").otherwise("Somewhere").alias("station_name"), F.when(F.col("user_id") % 2 == 0, "bihar").otherwise("punjab").alias("state"),
        F.when(F.col("event_type") == "view", "cod").when(F.col("event_type") == "purchase", "ph").otherwise("clicks").alias("parameter"), F.col("value").cast("string").alias("value"),
        F.when(F.col("event_id") % 2 == 0, F.to_date("ts")).alias("date"), F.year("ts").cast("string").alias("year"), F.when(F.col("event_id") % 3 == 2, "nwmp_pdf").otherwise("cpcb").alias("source"),
    )
    return quality.standardize(rows).select("event_id", "value", "unit", "year")


@register("""SELECT event_id FROM events WHERE event_id % 3 = 0 OR (20 + event_id % 15 BETWEEN 21.0 AND 31.5 AND 70 + event_id % 25 BETWEEN 73.0 AND 90.0)""")
def basin_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.when(F.col("event_id") % 3 != 0, 20 + F.col("event_id") % 15).cast("double").alias("latitude"), (70 + F.col("event_id") % 25).cast("double").alias("longitude"))
    return quality.spatial_filter(rows).select("event_id")


@register("SELECT s_suppkey, s_nationkey + 15 BETWEEN 20 AND 35 AND s_nationkey + 70 BETWEEN 73 AND 92 AS covered FROM supplier")
def map_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    inside = geo.in_box(F.col("s_nationkey") + 15, F.col("s_nationkey") + 70, (20.0, 35.0, 73.0, 92.0))
    return table(spark, sf_dir, "supplier").select("s_suppkey", inside.alias("covered"))


@register("""SELECT event_id, CASE WHEN value > -900 AND event_id % 7 > 0 THEN value END AS value FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN -999.0 WHEN 1 THEN -900.0 ELSE value END AS value FROM events)""")
def sentinels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 5 == 0, -999.0).when(F.col("event_id") % 5 == 1, -900.0).otherwise(F.col("value"))
    return features.sentinels_to_null(table(spark, sf_dir, "events").select("event_id", v.alias("value")), ["value"])


@register("SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_quantity > 10)::INT + (l_discount > 0.02)::INT + (l_tax > 0.02)::INT >= 2")
def complete_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    cut = {"l_quantity": 10, "l_discount": 0.02, "l_tax": 0.02}
    nulled = li.withColumns({c: F.when(F.col(c) > k, F.col(c)) for c, k in cut.items()})
    return features.complete_rows(nulled, list(cut), 2).select("l_orderkey", "l_linenumber")


@register("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P') AND year(o_orderdate) BETWEEN 1993 AND 2024 AND o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey < 5)")
def dashboard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("source"), F.year("o_orderdate").alias("year"), F.col("o_custkey").alias("station_name"))
    chosen = table(spark, sf_dir, "customer").where("c_nationkey < 5").select("c_custkey")
    return audit.dashboard_filter(o, ["F", "P"], (1993, 2024), chosen).select("o_orderkey")


@register("SELECT event_id, event_type FROM events WHERE value > 50 AND (event_type = 'error' OR event_type = 'a & b | c == d') AND NOT (event_id = 7)")
def quoted_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.query(table(spark, sf_dir, "events"), "value > 50 & (event_type == 'error' | event_type == 'a & b | c == d') & ~(event_id == 7)", ["event_id", "event_type"])


@register("""SELECT unnest(['l_quantity', 'l_tax']) AS "column" """)
def present_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("empty", F.lit(None).cast("double"))
    return spark.createDataFrame([(c,) for c in profile.present_columns(li, ["l_quantity", "empty", "l_tax"])], "column string")


@register("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def unfinished(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return lookup.unprocessed(table(spark, sf_dir, "orders"), done, ["o_custkey"]).select("o_orderkey")


@register("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def member_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.members(table(spark, sf_dir, "orders"), "o_custkey", table(spark, sf_dir, "customer").where("c_acctbal < 0").select("c_custkey")).select("o_orderkey")


@register("""WITH l AS (SELECT l_partkey AS k, l_shipdate::DATE AS d, arg_max(l_quantity, l_orderkey * 10 + l_linenumber) AS q FROM lineitem GROUP BY ALL)
SELECT o_orderkey, q FROM orders JOIN l ON k = o_custkey AND d = o_orderdate::DATE""")
def station_day_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").alias("q"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_seq"))
    return lookup.station_days(o, li, ["k", "d"]).select("o_orderkey", "q")


@register("""SELECT o_orderkey, coalesce(nullif(CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'own' END, ''), c_mktsegment) AS segment, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey""")
def filled_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.concat(F.col("c_custkey").cast("string"), F.lit(".0")).alias("station_id"), F.col("c_mktsegment").alias("segment"), "c_name", F.col("c_custkey").alias("_seq"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("station_id"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise("own").alias("segment"))
    return lookup.station_lookup(o, c).select("o_orderkey", "segment", "c_name")


@register("""WITH a AS (SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), b AS (SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT s_suppkey, s_nationkey, round(q, 4) AS q, n FROM supplier LEFT JOIN a ON a.l_suppkey = s_suppkey LEFT JOIN b ON b.l_suppkey = s_suppkey""")
def merged_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    one = li.where("l_returnflag = 'A'").groupBy("s_suppkey").agg(F.sum("l_quantity").alias("q"))
    two = li.where("l_returnflag = 'R'").groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("q"))
    return reshape.merged([table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), one, two], ["s_suppkey"]).withColumn("q", F.round("q", 4))


def _scenes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    readings = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key"), F.to_date("o_orderdate").alias("date")).distinct()
    scenes = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("key"), F.to_date("l_shipdate").alias("scene_date"), (F.col("l_discount") * 1000).alias("cloud"), F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("B1"),
    )
    return readings, scenes


_PAIRS = """r AS (SELECT DISTINCT o_custkey AS key, o_orderdate::DATE AS date FROM orders), s AS (SELECT l_partkey AS key, l_shipdate::DATE AS scene_date, l_discount * 1000 AS cloud, CASE WHEN l_quantity > 25 THEN l_quantity END AS B1 FROM lineitem)"""


@register(
    f"""WITH {_PAIRS}, c AS (SELECT r.key, r.date, B1, abs(scene_date - date) AS apart, cloud FROM r JOIN s ON r.key = s.key AND abs(scene_date - date) <= 30 WHERE B1 IS NOT NULL),
t AS (SELECT *, CASE WHEN apart <= 3 AND cloud < 20 THEN 0 WHEN apart <= 10 AND cloud < 60 THEN 1 WHEN apart <= 30 AND cloud < 100 THEN 2 END AS tier FROM c), m AS (SELECT *, min(tier) OVER (PARTITION BY key, date) AS best FROM t WHERE tier IS NOT NULL)
SELECT key, date, tier, count(*) AS scene_count, median(B1) AS B1 FROM m WHERE tier = best GROUP BY ALL""", iso=("date",))  # fmt: skip
def composite_with_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.tiered_composite(*_scenes(spark, sf_dir), ["key"], ["B1"], need_values=True)


@register(
    f"""WITH {_PAIRS}, c AS (SELECT r.key, r.date, B1, abs(scene_date - date) AS apart, cloud FROM r JOIN s ON r.key = s.key AND abs(scene_date - date) <= 90),
t AS (SELECT *, CASE WHEN key % 2 = 0 THEN CASE WHEN apart <= 5 AND cloud < 30 THEN 0 WHEN apart <= 90 AND cloud < 80 THEN 1 END ELSE CASE WHEN apart <= 15 AND cloud < 50 THEN 0 END END AS tier FROM c),
m AS (SELECT *, min(tier) OVER (PARTITION BY key, date) AS best FROM t WHERE tier IS NOT NULL) SELECT key, date, tier, count(*) AS scene_count, median(B1) AS B1 FROM m WHERE tier = best GROUP BY ALL""", iso=("date",))  # fmt: skip
def profiled_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    readings, scenes = _scenes(spark, sf_dir)
    even = F.col("key") % 2 == 0
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    profiles = readings.select("key").distinct().select("key", F.when(even, ints(5, 90)).otherwise(ints(15)).alias("days"), F.when(even, ints(30.0, 80.0)).otherwise(ints(50.0)).alias("clouds"))
    return temporal.profiled_composite(readings, scenes, profiles, ["key"], ["B1"])


@register("SELECT user_id, ts::DATE::VARCHAR AS day, arg_min(event_type, event_id) AS event_type, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def first_station_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), "event_type", "event_id")
    return sinks.iso_dates(lookup.first_of_key(e, ["user_id", "day"], "event_id"))


@register("SELECT user_id % 20 AS \"stationId\", event_type AS \"parameterName\", count(*) AS n, round(max(value), 6) AS value FROM events GROUP BY 1, 2")
def hourly_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshot files and a file of another name, which isn't read."""
    e = table(spark, sf_dir, "events").select(
        (F.col("user_id") % 20).alias("stationId"), F.col("ts").cast("string").alias("timestamp"), F.date_format("ts", "yyyy-MM-dd").alias("timestampDate"), "value", F.lit("mg/L").alias("unit"), F.col("event_type").alias("parameterNo"),
        F.col("event_type").alias("parameterName"), (F.col("event_id") % 2).alias("k"),
    )
    root = scratch_path(spark, "snapshots")
    for k, name in ((0, "water_data_0.csv"), (1, "water_data_1.csv"), (1, "other.csv")):
        e.where(F.col("k") == k).drop("k").coalesce(1).write.option("header", True).csv(f"{root}/w-{name}")
        _moved(spark, f"{root}/w-{name}", f"{root}/in/{name}")
    return readers.snapshots(spark, f"{root}/in").groupBy("stationId", "parameterName").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("value"), 6).alias("value"))


# --- reports -------------------------------------------------------------------------


@register("""SELECT user_id, ts::DATE AS date, round(avg(value), 4) AS value, arg_min(event_type, event_id) AS event_type FROM events GROUP BY 1, 2""", iso=("date",))
def station_day_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.daily_means(table(spark, sf_dir, "events"), ["user_id"], "ts", ["value"], ["event_type"], "event_id")


@register("SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS rn FROM events GROUP BY user_id, event_type) WHERE rn = 1")
def station_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.modes(table(spark, sf_dir, "events"), ["user_id"], ["event_type"])


@register("SELECT count(*) AS n, count(*) FILTER (b <= c) AS consistent, round(100.0 * count(*) FILTER (b <= c) / count(*), 4)::DOUBLE AS pct FROM (SELECT CASE WHEN l_quantity > 5 THEN l_quantity END AS b, l_discount * 500 AS c FROM lineitem) WHERE b IS NOT NULL")
def bod_below_cod(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_quantity") > 5, F.col("l_quantity")).alias("b"), (F.col("l_discount") * 500).alias("c"))
    return profile.pair_consistency(li, "b", "c")


@register("""SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS n_c_mktsegment, min(c_acctbal) AS min_c_acctbal, max(c_acctbal) AS max_c_acctbal FROM customer GROUP BY 1""")
def region_extents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.extents(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"], ["c_acctbal"])


@register("""SELECT l_returnflag, round(100.0 * avg((l_quantity <= 25)::INT), 4) AS a, 0.0::DOUBLE AS b FROM lineitem GROUP BY 1""")
def missing_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 25, F.col("l_quantity")).alias("a"), F.col("l_tax").alias("b"))
    return profile.missing_matrix(li, ["l_returnflag"], ["a", "b"])


@register("""SELECT l_returnflag, round(avg(l_tax) FILTER (l_linestatus = 'O'), 4) AS "mean_O", count(l_tax) FILTER (l_linestatus = 'O') AS "n_O", round(avg(l_tax) FILTER (l_linestatus = 'F'), 4) AS "mean_F", count(l_tax) FILTER (l_linestatus = 'F') AS "n_F" FROM lineitem GROUP BY 1""")
def mean_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.mean_matrix(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus", ["O", "F"], "l_tax")


@register("SELECT l_returnflag, count(*) AS n, 1::INT + (max(l_tax) > 0.07)::INT AS measures FROM lineitem GROUP BY 1")
def covered_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", F.when(F.col("l_tax") > 0.07, F.col("l_tax")).alias("t"), F.lit(None).cast("double").alias("none"))
    return profile.covered_measures(li, ["l_returnflag"], ["l_quantity", "t", "none"]).withColumn("measures", F.col("measures").cast("int"))


@register("""SELECT o_custkey, o_orderstatus, count(*) AS n, min(o_orderdate)::DATE AS first, max(o_orderdate)::DATE AS last, round(avg(floor(o_totalprice)), 2) AS o_totalprice FROM orders WHERE o_custkey % 3 > 0 GROUP BY 1, 2""", iso=("first", "last"))
def place_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumns({"o_custkey": F.when(F.col("o_custkey") % 3 > 0, F.col("o_custkey")), "o_totalprice": F.floor("o_totalprice"), "o_orderdate": F.to_date("o_orderdate")})
    return profile.station_map(o, ["o_custkey", "o_orderstatus"], "o_orderdate", ["o_totalprice"])


def _bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("file"), F.col("l_linestatus").alias("band"), F.col("l_quantity").alias("value"))
    return profile.band_summary(readers.band_statistics(li, nodata=50.0), 3000)


@register("""WITH b AS (SELECT l_returnflag AS file, l_linestatus AS band, count(*) AS count, avg(l_quantity) AS mean, median(l_quantity) AS p50 FROM lineitem WHERE l_quantity <> 50 GROUP BY 1, 2)
SELECT file, band, count, count < 3000 AS low_count, round(mean, 6) AS mean, p50 FROM b""")
def band_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bands(spark, sf_dir).orderBy("file", "band").select("file", "band", "count", "low_count", F.round("mean", 6).alias("mean"), "p50")


@register("""WITH b AS (SELECT l_returnflag AS file, l_linestatus AS band, count(*) AS count, median(l_quantity) AS p50 FROM lineitem WHERE l_quantity <> 50 GROUP BY 1, 2)
SELECT file, max(p50) FILTER (band = 'O') AS "O", max(p50) FILTER (band = 'F') AS "F", sum(count)::BIGINT AS total_valid_pixels, bool_or(count < 3000) AS any_low_count FROM b GROUP BY 1""")
def file_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.file_summary(_bands(spark, sf_dir), ["O", "F"])


@register("""SELECT user_id::VARCHAR AS station, count(*) AS total, count(*) FILTER (value > 10) AS done, round(100.0 * count(*) FILTER (value > 10) / count(*), 1)::DOUBLE AS pct FROM events GROUP BY 1""")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("station", F.col("user_id").cast("string"))
    done = e.where("value > 10").select(F.concat_ws("_", "station", F.date_format("ts", "yyyy-MM-dd")).alias("job"))
    totals = e.groupBy("station").agg(F.count(F.lit(1)).alias("total"))
    return profile.progress(done, totals).withColumn("pct", F.col("pct").cast("double"))


@register("SELECT 'ok' AS status, 'f.csv' AS file, count(DISTINCT user_id) AS stations, count(DISTINCT event_type) AS parameters, count(*) AS rows, min(ts)::VARCHAR AS first, max(ts)::VARCHAR AS last FROM events")
def run_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("stationId"), F.col("event_type").alias("parameterNo"), F.col("ts").cast("string").alias("timestamp"))
    return sinks.run_log(e, "ok", "f.csv")


@register("SELECT event_id, value FROM (SELECT * FROM events ORDER BY event_id DESC LIMIT 10)")
def log_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.tail(table(spark, sf_dir, "events").select("event_id", "value"), 10, "event_id")


@register("SELECT event_id FROM events ORDER BY event_id LIMIT 100")
def first_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id")
    return reshape.truncated(reshape.truncated(e, None), 100, "event_id")


@register("""SELECT s_suppkey, (row_number() OVER (ORDER BY CASE WHEN lon < 81 THEN 1 WHEN lon < 87 THEN 2 ELSE 3 END, lon, s_suppkey) - 1)::INT AS place FROM (SELECT s_suppkey, 75 + s_nationkey * 0.5 + s_suppkey * 0.0001 AS lon FROM supplier)""")
def west_to_east(spark: SparkSession, sf_dir: str) -> DataFrame:
    # decimals, as in the SQL: equal longitudes are equal, and the key decides between them
    lon = 75 + F.col("s_nationkey") * F.lit(Decimal("0.5")) + F.col("s_suppkey") * F.lit(Decimal("0.0001"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", lon.alias("lon")).withColumn("region", geo.region(F.col("lon")))
    placed = reshape.west_to_east_places(s, "place", ties=("s_suppkey",))
    return placed.select("s_suppkey", F.col("place").cast("int").alias("place"))


@register("""SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderstatus, coalesce(d, 'None'), o_orderkey) - 1)::INT AS place FROM (SELECT o_orderkey, o_orderstatus || o_orderkey AS o_orderstatus, CASE WHEN o_orderkey % 4 > 0 THEN o_orderdate::DATE::VARCHAR END AS d FROM orders WHERE o_orderkey < 800)""")
def wide_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where("o_orderkey < 800")
    o = o.select("o_orderkey", F.concat(F.col("o_orderstatus"), F.col("o_orderkey").cast("string")).alias("station_name"), F.when(F.col("o_orderkey") % 4 > 0, F.to_date("o_orderdate")).alias("date"))
    return reshape.by_station_and_date(o).coalesce(1).select("o_orderkey", F.monotonically_increasing_id().cast("int").alias("place"))


@register("""SELECT user_id, ts::DATE AS day, arg_min(value, event_id) FILTER (event_type = 'view' AND event_id % 2 = 0) AS view, arg_min(value, event_id) FILTER (event_type = 'click' AND event_id % 2 = 0) AS click FROM events WHERE event_id % 2 = 0 GROUP BY 1, 2""", iso=("day",))
def pivot_daily_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", F.to_date("ts").alias("day"), F.col("event_type").alias("parameter"), "value", F.when(F.col("event_id") % 2 == 0, "Day.Mean").otherwise("Day.Max").alias("aggregation"), F.col("event_id").alias("_seq"))
    return reshape.pivot_daily_mean(e, ["user_id", "day"], ["view", "click"])


@register("""WITH s AS (SELECT user_id % 7 AS model, event_type AS target, round(avg(value), 1) AS r2 FROM events GROUP BY ALL) SELECT target, model, r2 FROM (SELECT *, row_number() OVER (PARTITION BY target ORDER BY r2 DESC, model) AS rn FROM s) WHERE rn = 1""")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 7).alias("model"), F.col("event_type").alias("target")).agg(F.round(F.avg("value"), 1).alias("r2"))
    return features.best_by(s, ["target"], "model", "r2").select("target", "model", "r2")


@register("SELECT 'l_quantity_copy' AS dropped")
def pruned_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").withColumn("l_quantity_copy", F.col("l_quantity") * 2 + 1)
    return spark.createDataFrame([(c,) for c in profile.correlated_columns(li, ["l_quantity", "l_tax", "l_quantity_copy"])], "dropped string")


# --- features --------------------------------------------------------------------------


@register("""SELECT k, round(avg(v), 9) AS v, arg_min(f, _seq) FILTER (f IS NOT NULL) AS f FROM (SELECT CASE WHEN event_id % 5 > 0 THEN user_id END AS k, value AS v, CASE WHEN event_id % 3 = 0 THEN event_type END AS f, event_id AS _seq FROM events) WHERE k IS NOT NULL GROUP BY 1""")
def observation_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.when(F.col("event_id") % 5 > 0, F.col("user_id")).alias("k"), F.col("value").alias("v"), F.when(F.col("event_id") % 3 == 0, F.col("event_type")).alias("f"), F.col("event_id").alias("_seq"))
    return features.mean_by_observation(e, ["k"], ["v"], ["f"]).withColumn("v", F.round("v", 9))


@register("SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= floor(count(*) OVER () * 0.8) THEN 'train' ELSE 'test' END AS split FROM events")
def ordered_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.ordered_split(table(spark, sf_dir, "events"), ["ts", "event_id"]).select("event_id", "split")


@register("SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-15' THEN 'train' ELSE 'test' END AS split FROM events")
def temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.temporal_split(table(spark, sf_dir, "events"), "ts", "2024-01-15").select("event_id", "split")


_BAND_SQL = "b AS (SELECT l_orderkey, l_linenumber, l_shipdate, " + ", ".join(f"0.01::DOUBLE * (l_linenumber + {i}) + l_tax AS {b}" for i, b in enumerate(schema.BANDS)) + " FROM lineitem)"


def _imagery(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = {b: 0.01 * (F.col("l_linenumber") + i) + F.col("l_tax") for i, b in enumerate(schema.BANDS)}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", "l_quantity", *[v.alias(b) for b, v in values.items()])


@register(f"""WITH {_BAND_SQL} SELECT l_orderkey, l_linenumber, round((B3 - B8) / (B3 + B8), 6) + 0.0 AS "NDWI", round((B3 - B11) / (B3 + B11), 6) + 0.0 AS "MNDWI", round((B4 - B3) / (B4 + B3), 6) + 0.0 AS "NDTI", round((B8 - B4) / (B8 + B4), 6) + 0.0 AS "NDVI",
round((B5 - B4) / (B5 + B4), 6) + 0.0 AS "NDCI", round(B5 - B4 - (B6 - B4) * (40.0::DOUBLE / 75), 6) + 0.0 AS "MCI", round(B8 - B4 - (B11 - B4) * (177.0::DOUBLE / 945), 6) + 0.0 AS "FAI", round((B8 - B4) / (B3 + B2), 6) + 0.0 AS "SABI",
round(B5 / greatest(B4, 1e-6), 6) + 0.0 AS "B5_B4", round(B3 / greatest(B2, 1e-6), 6) + 0.0 AS "B3_B2", round(B4 / greatest(B3, 1e-6), 6) + 0.0 AS "B4_B3", round(B8 / greatest(B4, 1e-6), 6) + 0.0 AS "B8_B4", round(B11 / greatest(B8, 1e-6), 6) + 0.0 AS "B11_B8",
round(B5 / greatest(B6, 1e-6), 6) + 0.0 AS "B5_B6" FROM b""")
def all_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _imagery(spark, sf_dir)
    bands = {b: F.col(b) for b in schema.BANDS}
    made = {**spectral.indices(bands), **spectral.band_ratios(bands)}
    return rows.select("l_orderkey", "l_linenumber", *[(F.round(c, 6) + 0.0).alias(n) for n, c in made.items()])


@register("""SELECT event_id, event_id & 1024 = 0 AND event_id & 2048 = 0 AS clear, event_id % 12 IN (4, 5, 6, 11) AS class_clear, round(least(greatest((value - 5) / 20, 0), 1), 6) AS stretched, round((value - 10) / (value + 10 + 1e-8), 6) AS difference FROM events""")
def masks_and_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        "event_id", spectral.clear_sky(F.col("event_id")).alias("clear"), spectral.clear_class(F.col("event_id") % 12).alias("class_clear"), F.round(spectral.stretched(v, F.lit(5.0), F.lit(25.0)), 6).alias("stretched"),
        F.round(spectral.guarded_difference(v, F.lit(10.0)), 6).alias("difference"),
    )


@register("""WITH p AS (SELECT l_orderkey, l_linenumber, l_tax AS m, l_discount AS s, list_sort([l_tax, l_discount, l_quantity, 1.0, 2.0]) AS e FROM lineitem)
SELECT l_orderkey, l_linenumber, round(m - 1.96 * s, 6) AS low, round(m + 1.96 * s, 6) AS high, round(exp(m) - 1, 6) AS value, round(s * exp(m), 6) AS spread, round(e[1] + (e[2] - e[1]) * 0.2, 6) AS p5, round(e[4] + (e[5] - e[4]) * 0.8, 6) AS p95 FROM p""")
def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    m, s = F.col("l_tax"), F.col("l_discount")
    low, high = features.interval(m, s)
    value, spread = features.from_log(m, s)
    e = features.ensemble_interval(F.array(m, s, F.col("l_quantity"), F.lit(1.0), F.lit(2.0)))
    r = lambda c, n: F.round(c, 6).alias(n)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", r(low, "low"), r(high, "high"), r(value, "value"), r(spread, "spread"), r(e.low, "p5"), r(e.high, "p95"))


@register("""SELECT o_orderkey, month(o_orderdate)::INT AS month, dayofyear(o_orderdate)::INT AS day, year(o_orderdate)::INT AS year, make_date(year(o_orderdate), 7, 1)::VARCHAR AS mid, make_date(year(o_orderdate), 1, 1)::VARCHAR AS start,
CASE WHEN month(o_orderdate) IN (12, 1, 2) THEN 'Winter (Dec-Feb)' WHEN month(o_orderdate) <= 5 THEN 'Pre-Monsoon (Mar-May)' WHEN month(o_orderdate) <= 9 THEN 'Monsoon (Jun-Sep)' ELSE 'Post-Monsoon (Oct-Nov)' END AS season FROM orders""")
def date_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("date"))
    y = F.year("date").cast("string")
    made = lambda m: parse.made_date(y, F.lit(m), F.lit("1")).cast("string")
    return readers.season_of(o).select("o_orderkey", F.month("date").alias("month"), F.dayofyear("date").alias("day"), F.year("date").alias("year"), made("7").alias("mid"), made("1").alias("start"), "season")


@register(f"""WITH {_BAND_SQL} SELECT l_orderkey, l_linenumber, round((B3 - B8) / (B3 + B8), 6) + 0.0 AS "NDWI", round(B5 / greatest(B4, 1e-6), 6) + 0.0 AS "B5_B4", round(sin(2 * pi() * month(l_shipdate) / 12), 6) + 0.0 AS month_sin,
CASE WHEN month(l_shipdate) IN (12, 1, 2) THEN 0 WHEN month(l_shipdate) <= 5 THEN 1 WHEN month(l_shipdate) <= 9 THEN 2 ELSE 3 END::INT AS season, 'Upper Ganga' AS region, round(sqrt(pow((25.0 - 30.99) * 111, 2) + pow((80.0 - 78.94) * 111 * cos(radians(25.0)), 2)), 6) AS dist FROM b""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _imagery(spark, sf_dir).withColumns({"lat": F.lit(25.0), "lon": F.lit(80.0), "date": F.to_date("l_shipdate")})
    out = features.feature_vector(rows)
    r = lambda c: (F.round(c, 6) + 0.0).alias(c)
    return out.select("l_orderkey", "l_linenumber", r("NDWI"), r("B5_B4"), r("month_sin"), "season", "region", F.round("dist_from_source_km", 6).alias("dist"))


@register("""WITH k AS (SELECT s_suppkey AS i, s_nationkey::DOUBLE AS a, s_acctbal AS b FROM supplier), known AS (SELECT * FROM k WHERE i % 4 > 0), asked AS (SELECT * FROM k WHERE i % 4 = 0),
d AS (SELECT q.i, p.b, row_number() OVER (PARTITION BY q.i ORDER BY (q.a - p.a) ** 2, p.b) AS rn FROM asked q, known p)
SELECT i, a, round(b, 6) AS b FROM known UNION ALL SELECT q.i, q.a, round(avg(d.b), 6) FROM asked q JOIN d ON d.i = q.i AND rn <= 5 GROUP BY 1, 2""")
def imputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), F.col("s_nationkey").cast("double").alias("a"), F.when(F.col("s_suppkey") % 4 > 0, F.col("s_acctbal")).alias("b"))
    return features.knn_impute(s, ["a", "b"]).withColumn("b", F.round("b", 6))


@register("""SELECT 'slope' AS term, round(regr_slope(l_extendedprice, l_quantity), 3) AS value FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) FROM lineitem""")
def linear_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice")
    fitted = models.fit(li, ["l_quantity"], "l_extendedprice", models.regressors()["Linear Regression"])
    terms = models.linear_terms(fitted, ["l_quantity"])
    return spark.createDataFrame([("slope", round(terms["l_quantity"], 3)), ("intercept", round(terms["intercept"], 3))], "term string, value double")


@register("""WITH c AS (SELECT regr_slope(l_extendedprice, l_quantity) AS s, regr_intercept(l_extendedprice, l_quantity) AS i FROM lineitem) SELECT l_orderkey, l_linenumber, round(i + s * l_quantity, 3) AS predicted, NULL::DOUBLE AS low FROM lineitem, c""")
def linear_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    fitted = models.fit(li, ["l_quantity"], "l_extendedprice", models.regressors()["Linear Regression"])
    return models.predict(li, ["l_quantity"], fitted).select("l_orderkey", "l_linenumber", F.round("predicted", 3).alias("predicted"), "low")


@register()
def forest_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_extendedprice")
    fitted = models.fit(li, ["l_quantity", "l_discount"], "l_extendedprice", models.regressors(trees=10)["Random Forest"].setMaxDepth(5))
    return models.predict(li, ["l_quantity", "l_discount"], fitted)


@register("SELECT event_id, name, upper(name) AS mapped FROM (SELECT event_id, event_type AS name FROM events WHERE event_id < 300) WHERE name <> 'view' UNION ALL SELECT event_id, event_type, NULL FROM events WHERE event_id < 300 AND event_type = 'view'")
def mapped_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    import json

    e = table(spark, sf_dir, "events").where("event_id < 300").select("event_id", F.col("event_type").alias("name"))
    client = lambda names: "```json\n" + json.dumps({n: n.upper() for n in names if n != "view"}) + "\n```"
    return e.join(verdicts.map_names(e, "name", client), "name", "left").select("event_id", "name", "mapped")


@register("""WITH v AS (SELECT event_id AS _seq, CASE event_id % 4 WHEN 0 THEN 'suspect_range' WHEN 1 THEN 'suspect_outlier' ELSE 'valid' END AS quality_flag, 0.5::DOUBLE AS confidence FROM events),
s AS (SELECT _seq FROM v WHERE quality_flag <> 'valid' ORDER BY _seq LIMIT 50)
SELECT v._seq, CASE WHEN s._seq IS NULL THEN quality_flag WHEN v._seq % 3 = 0 THEN 'valid' WHEN v._seq % 3 = 1 THEN 'rejected' ELSE quality_flag END AS quality_flag, CASE WHEN s._seq IS NULL THEN 0.5 WHEN v._seq % 3 = 0 THEN 0.9 WHEN v._seq % 3 = 1 THEN 0.1 ELSE 0.5 END::DOUBLE AS confidence FROM v LEFT JOIN s USING (_seq)""")
def judged_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("_seq"), F.when(k == 0, "suspect_range").when(k == 1, "suspect_outlier").otherwise("valid").alias("quality_flag"), F.lit(0.5).alias("confidence"))
    asked = verdicts.suspects(rows, 50)
    said = F.when(F.col("_seq") % 3 == 0, "valid").when(F.col("_seq") % 3 == 1, "reject").otherwise("unsure")
    return verdicts.apply_verdicts(rows, asked.select("_seq", said.alias("verdict"), F.lit(0.9).alias("certainty"))).withColumn("confidence", F.round("confidence", 9)).select("_seq", "quality_flag", "confidence")


# --- pipelines ---------------------------------------------------------------------------


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations with the columns the record pipeline takes; part of them outside the basin."""
    user = F.regexp_extract("station_name", r"(\d+)", 1).cast("int")
    return observations(spark, sf_dir).select(
        F.when(user % 4 == 0, F.concat(F.lit("Ganga "), user.cast("string"))).otherwise(F.col("station_name")).alias("station_name"), F.concat(F.lit("c"), user.cast("string")).alias("station_code"),
        F.when(user % 3 == 0, "bihar").when(user % 3 == 1, "goa").alias("state"), F.when(user % 10 > 0, 20 + user % 10).cast("double").alias("latitude"), F.lit(80.0).alias("longitude"), "date", F.year("date").alias("year"), "parameter",
        F.col("value").cast("string").alias("value"), F.when(F.col("source") == "other", "nwmp_pdf").otherwise(F.col("source")).alias("source"), "_seq",
    )


_RECORDS = """raw AS (SELECT CASE WHEN user_id % 4 = 0 THEN 'Ganga ' || user_id ELSE 'Station ' || user_id END AS station_name, user_id, CASE WHEN user_id % 10 > 0 THEN 20.0 + user_id % 10 END AS latitude, ts::DATE AS date,
 CASE event_type WHEN 'signup' THEN 'bod' WHEN 'view' THEN 'cod' WHEN 'click' THEN 'tds' WHEN 'error' THEN 'conductivity' WHEN 'purchase' THEN 'ph' END AS parameter, value,
 CASE event_id % 3 WHEN 0 THEN 'cpcb' WHEN 1 THEN 'data_gov_in' ELSE 'nwmp_pdf' END AS source, event_id AS _seq FROM events),
std AS (SELECT * FROM raw WHERE parameter IS NOT NULL AND (source <> 'nwmp_pdf' OR user_id % 3 = 0 OR user_id % 4 = 0) AND (latitude IS NULL OR latitude BETWEEN 21.0 AND 31.5)),
chk AS (SELECT s.*, 'valid' AS quality_flag, round(CASE source WHEN 'cpcb' THEN 1.0::DOUBLE WHEN 'data_gov_in' THEN 0.9 ELSE 0.85 END * CASE WHEN abs(value - (lo + hi) / 2) / ((hi - lo) / 2) > 0.9 THEN 0.7::DOUBLE ELSE 1.0 END, 3) AS trust
 FROM std s JOIN (VALUES ('bod', 0.0::DOUBLE, 1000.0::DOUBLE), ('cod', 0.0, 5000.0), ('tds', 0.0, 50000.0), ('conductivity', 0.0, 50000.0), ('ph', 0.0, 14.0)) b(parameter, lo, hi) USING (parameter) WHERE value BETWEEN lo AND hi),
rk AS (SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM chk),
q AS (SELECT parameter, max(CASE WHEN rn = n // 4 + 1 THEN value END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN value END) AS q3 FROM rk GROUP BY 1 HAVING max(n) >= 20 AND q1 <> q3),
flg AS (SELECT c.* EXCLUDE (quality_flag, trust), CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN 'suspect_outlier' ELSE 'valid' END AS quality_flag,
 CASE WHEN value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1) THEN trust * 0.5 ELSE trust END AS trust FROM chk c LEFT JOIN q USING (parameter)),
lst AS (SELECT station_name, date, arg_max(value, _seq) FILTER (parameter = 'bod') AS bod, arg_max(value, _seq) FILTER (parameter = 'cod') AS cod, arg_max(value, _seq) FILTER (parameter = 'tds') AS tds,
 arg_max(value, _seq) FILTER (parameter = 'conductivity') AS ec FROM flg GROUP BY ALL),
con AS (SELECT f.* EXCLUDE (quality_flag, trust), CASE WHEN bad AND quality_flag = 'valid' THEN 'suspect_consistency' ELSE quality_flag END AS quality_flag, CASE WHEN bad AND quality_flag = 'valid' THEN trust * 0.7 ELSE trust END AS trust
 FROM flg f JOIN (SELECT station_name, date, coalesce(bod > cod * 2.0, false) OR coalesce(ec > 0 AND (tds / ec < 0.2 OR tds / ec > 1.5), false) AS bad FROM lst) USING (station_name, date)),
fus AS (SELECT station_name, date, parameter, count(*) AS n, arg_max(value, (trust, -_seq)) AS value, arg_max(source, (trust, -_seq)) AS source, arg_max(quality_flag, (trust, -_seq)) AS f, max(trust) AS t, max(value) AS hi, min(value) AS lo,
 list_sort(list_distinct(list(source))) AS sources FROM con GROUP BY 1, 2, 3),
long AS (SELECT station_name, date, parameter, value, source, n > 1 AND hi > 0 AND (hi - lo) / greatest(hi, 0.001) < 0.1 AS agree, CASE WHEN agree THEN 'valid' ELSE f END AS quality_flag, CASE WHEN agree THEN least(1.0, t * 1.2) ELSE t END AS trust_score,
 CASE WHEN n > 1 THEN array_to_string(sources, '; ') END AS all_sources FROM fus)"""


@register(f"WITH {_RECORDS} SELECT station_name, date, parameter, value, source, quality_flag, round(trust_score, 9) AS trust_score, all_sources FROM long", iso=("date",))
def record_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused, _ = pipelines.record_pipeline([_records(spark, sf_dir)])
    return fused.select("station_name", "date", "parameter", "value", "source", "quality_flag", F.round("trust_score", 9).alias("trust_score"), "all_sources")


@register(
    f"WITH {_RECORDS} SELECT station_name, date, count(*) AS n_params, round(least(1.0, min(trust_score)), 9) AS min_trust, max(value) FILTER (parameter = 'bod') AS bod, max(value) FILTER (parameter = 'cod') AS cod, max(value) FILTER (parameter = 'ph') AS ph, "
    "NULL::DOUBLE AS toc FROM long GROUP BY 1, 2", iso=("date",))  # fmt: skip
def record_pipeline_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, wide = pipelines.record_pipeline([_records(spark, sf_dir)])
    return wide.select("station_name", "date", "n_params", F.round("min_trust", 9).alias("min_trust"), "bod", "cod", "ph", "toc")


@register(f"WITH {_RECORDS} SELECT dimension, value, count(*) AS n FROM (SELECT unnest(['source', 'parameter', 'quality_flag']) AS dimension, unnest([source, parameter, quality_flag]) AS value FROM long) GROUP BY ALL")
def record_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.record_report(pipelines.record_pipeline([_records(spark, sf_dir)])[0])


_CANONICAL = """base AS (SELECT user_id % 40 AS st, 'u' || (user_id % 40) AS source_station_id, CASE WHEN event_id % 2 = 0 THEN 'cpcb' ELSE 'cwc' END AS source, ts::DATE AS sample_date,
 CASE event_type WHEN 'signup' THEN 'bod' WHEN 'view' THEN 'cod' WHEN 'click' THEN 'tds' WHEN 'error' THEN 'conductivity' ELSE 'ph' END AS parameter, value, event_id AS _seq FROM events),
firsts AS (SELECT st, row_number() OVER (ORDER BY min(_seq)) AS k FROM base GROUP BY 1),
conv AS (SELECT base.* EXCLUDE (value), CASE WHEN parameter = 'bod' THEN value * 1000.0 ELSE value END AS value, 'WQ_' || lpad(k::VARCHAR, 5, '0') AS station_id FROM base JOIN firsts USING (st)),
val AS (SELECT c.*, CASE WHEN value < h0 OR value > h1 OR value < 0 THEN 'rejected' WHEN value < s0 OR value > s1 THEN 'suspect_range' ELSE 'valid' END AS flag, CASE WHEN value < h0 OR value > h1 THEN 1.0 WHEN value < s0 OR value > s1 THEN 0.6 ELSE 1.0 END::DOUBLE AS conf
 FROM conv c JOIN (VALUES ('bod', 0.0, 0.0, 100.0, 1000.0), ('cod', 0.0, 0.0, 500.0, 5000.0), ('tds', 0.0, 10.0, 3000.0, 50000.0), ('conductivity', 0.0, 10.0, 5000.0, 50000.0), ('ph', 0.0, 4.0, 10.0, 14.0)) b(parameter, h0, s0, s1, h1) USING (parameter)),
rk AS (SELECT parameter, value, row_number() OVER (PARTITION BY parameter ORDER BY value) AS rn, count(*) OVER (PARTITION BY parameter) AS n FROM val WHERE flag <> 'rejected'),
q AS (SELECT parameter, max(CASE WHEN rn = n // 4 + 1 THEN value END) AS q1, max(CASE WHEN rn = 3 * n // 4 + 1 THEN value END) AS q3 FROM rk GROUP BY 1 HAVING max(n) >= 20 AND q1 <> q3),
outl AS (SELECT v.* EXCLUDE (flag, conf), CASE WHEN flag = 'valid' AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) THEN 'suspect_outlier' ELSE flag END AS flag,
 CASE WHEN flag = 'valid' AND (value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)) THEN conf * 0.5 ELSE conf END AS conf FROM val v LEFT JOIN q USING (parameter)),
lst AS (SELECT station_id, sample_date, arg_max(value, _seq) FILTER (parameter = 'bod') AS bod, arg_max(value, _seq) FILTER (parameter = 'cod') AS cod, arg_max(value, _seq) FILTER (parameter = 'tds') AS tds,
 arg_max(value, _seq) FILTER (parameter = 'conductivity') AS ec FROM outl WHERE flag <> 'rejected' GROUP BY ALL),
con AS (SELECT o.* EXCLUDE (flag, conf), CASE WHEN bad AND flag = 'valid' THEN 'suspect_consistency' ELSE flag END AS flag, CASE WHEN bad AND flag = 'valid' THEN conf * 0.7 ELSE conf END AS conf FROM outl o LEFT JOIN (
 SELECT station_id, sample_date, coalesce(bod > cod * 1.2, false) OR coalesce(ec IS NOT NULL AND (tds / greatest(ec, 0.01) < 0.2 OR tds / greatest(ec, 0.01) > 1.5), false) AS bad FROM lst) USING (station_id, sample_date)),
g AS (SELECT *, count(*) OVER w AS n, avg(value) OVER w AS mean, min(value) OVER w AS lo, max(value) OVER w AS hi, min(source) OVER w <> max(source) OVER w AS several, min(_seq) OVER w AS f,
 first_value(_seq) OVER (PARTITION BY station_id, sample_date, parameter ORDER BY CASE source WHEN 'cpcb' THEN 1.0 ELSE 0.95 END DESC, _seq) AS best FROM con WHERE flag <> 'rejected' WINDOW w AS (PARTITION BY station_id, sample_date, parameter)),
o AS (SELECT *, CASE WHEN n = 1 THEN 'single' WHEN NOT several THEN 'averaged' WHEN mean = 0 THEN 'kept' WHEN greatest(hi - mean, mean - lo) / abs(mean) <= 0.2 THEN 'agreed' ELSE 'conflict' END AS outcome FROM g)"""


def _canonical_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "events")
    st = F.col("user_id") % 40
    pairs = [F.lit(x) for kv in (PARAMETERS | {"error": "conductivity"}).items() for x in kv]
    parameter = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.lit("ph"))
    given = {
        "station_id": F.concat(F.lit("u"), st.cast("string")), "station_name": F.concat(F.lit("Place"), st.cast("string")), "river": F.lit("Ganga"), "state": F.lit("Bihar"), "latitude": 22.0 + st * 0.2, "longitude": F.lit(80.0),
        "sample_date": F.to_date("ts"), "parameter": parameter, "value": F.col("value"), "unit": F.when(F.col("event_type") == "signup", "g/l").otherwise(""), "source": F.when(F.col("event_id") % 2 == 0, "cpcb").otherwise("cwc"),
        "source_station_id": F.concat(F.lit("u"), st.cast("string")), "quality_flag": F.lit("valid"), "confidence": F.lit(1.0), "notes": F.lit(""), "_seq": F.col("event_id"),
    }
    rows = e.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CANONICAL])
    targets = spark.createDataFrame([(p, "mg/L") for p in ("bod", "cod", "tds")], "parameter string, target_unit string")
    return rows, targets


@register(
    f"""WITH {_CANONICAL} SELECT _seq, station_id, parameter, outcome, round(CASE WHEN outcome = 'averaged' THEN round(mean, 4) ELSE value END, 6) AS value,
CASE WHEN outcome = 'agreed' AND _seq <> best THEN 'suspect_duplicate' WHEN outcome = 'conflict' AND _seq <> best THEN 'suspect_consistency' ELSE flag END AS quality_flag,
round(CASE WHEN outcome <> 'conflict' THEN conf WHEN _seq = best THEN conf * 0.8 ELSE conf * 0.5 END, 9) AS confidence FROM o WHERE outcome <> 'averaged' OR _seq = f"""
)
def canonical_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    settled, _ = pipelines.canonical_pipeline(*_canonical_records(spark, sf_dir))
    return settled.select("_seq", "station_id", "parameter", "outcome", F.round("value", 6).alias("value"), "quality_flag", F.round("confidence", 9).alias("confidence"))


@register(f"WITH {_CANONICAL} SELECT source, source_station_id, any_value(station_id) AS canonical_id, 'Place' || any_value(st) AS best_name, round(22.0::DOUBLE + any_value(st) * 0.2::DOUBLE, 9) AS best_latitude, sum(count(*)) OVER (PARTITION BY any_value(station_id))::BIGINT AS record_count FROM conv GROUP BY 1, 2")
def canonical_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, registry = pipelines.canonical_pipeline(*_canonical_records(spark, sf_dir))
    return registry.select("source", "source_station_id", "canonical_id", "best_name", F.round("best_latitude", 9).alias("best_latitude"), "record_count")


@register("""SELECT s_suppkey AS id, (s_suppkey // 10) * 10 AS canonical_id FROM supplier""")
def grid_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tens of stations, each near the one before it, are one station each."""
    k, ten = F.col("s_suppkey"), F.floor(F.col("s_suppkey") / 10)
    s = table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("Ghat "), ten.cast("string")).alias("name"), (20 + ten * 0.5 + (k % 10) * 0.005).alias("lat"), F.lit(80.0).alias("lon"))
    return entity.grid_registry(s)


def _wide_sources(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    li = table(spark, sf_dir, "lineitem")
    base = [(F.col("l_partkey") % 100).cast("string").alias("station_id"), F.to_date(F.date_trunc("month", "l_shipdate")).alias("date"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("_seq")]
    one = li.where("l_linestatus = 'O'").select(*base, F.lit("cpcb").alias("source"), (F.col("l_quantity") * 3).alias("BOD_mg_l"), (F.col("l_discount") * 600).alias("COD_mg_l"))
    two = li.where("l_linestatus = 'F'").select(*base, F.lit("nwdp").alias("source"), F.when(F.col("l_tax") > 0.02, F.col("l_quantity")).alias("BOD_mg_l"), (F.col("l_tax") * 100 + 4).alias("pH"))
    return [one, two]


_WIDE = """w AS (SELECT (l_partkey % 100)::VARCHAR AS station_id, date_trunc('month', l_shipdate)::DATE AS date, l_orderkey * 10 + l_linenumber AS _seq, CASE WHEN l_linestatus = 'O' THEN 'cpcb' ELSE 'nwdp' END AS source,
 CASE WHEN l_linestatus = 'O' THEN l_quantity * 3 WHEN l_tax > 0.02 THEN l_quantity END AS b0, CASE WHEN l_linestatus = 'O' THEN l_discount * 600 END AS c0, CASE WHEN l_linestatus <> 'O' THEN l_tax * 100 + 4 END AS p0 FROM lineitem),
c AS (SELECT *, CASE WHEN b0 BETWEEN 0 AND 100 THEN b0 END AS b1, CASE WHEN c0 BETWEEN 0 AND 500 THEN c0 END AS cod, CASE WHEN p0 BETWEEN 4 AND 11 THEN p0 END AS ph FROM w), d AS (SELECT *, CASE WHEN NOT coalesce(b1 > 2 * cod, false) THEN b1 END AS bod FROM c)"""


@register(f"WITH {_WIDE} SELECT station_id, date, source, arg_min(bod, _seq) FILTER (bod IS NOT NULL) AS bod, arg_min(cod, _seq) FILTER (cod IS NOT NULL) AS cod, round(arg_min(ph, _seq) FILTER (ph IS NOT NULL), 6) AS ph FROM d GROUP BY 1, 2, 3", iso=("date",))
def wide_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.wide_pipeline(_wide_sources(spark, sf_dir))
    return out.select("station_id", "date", "source", F.col("BOD_mg_l").alias("bod"), F.col("COD_mg_l").alias("cod"), F.round("pH", 6).alias("ph"))


@register(f"WITH {_WIDE} SELECT station_id, date, source, bod, cod, round(ph, 6) AS ph FROM (SELECT *, row_number() OVER (PARTITION BY station_id, date, source ORDER BY _seq) AS rn FROM d) WHERE rn = 1", iso=("date",))
def wide_pipeline_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pipelines.wide_pipeline(_wide_sources(spark, sf_dir), compat=True)
    return out.select("station_id", "date", "source", F.col("BOD_mg_l").alias("bod"), F.col("COD_mg_l").alias("cod"), F.round("pH", 6).alias("ph"))


@register(
    f"""WITH {_WIDE}, m AS (SELECT station_id, date, source, arg_min(bod, _seq) FILTER (bod IS NOT NULL) AS bod, arg_min(ph, _seq) FILTER (ph IS NOT NULL) AS ph FROM d GROUP BY 1, 2, 3)
SELECT CASE WHEN grouping(source) = 1 THEN 'ALL' ELSE source END AS source, count(*) AS rows, count(DISTINCT station_id) AS stations, min(date) AS first, max(date) AS last FROM m GROUP BY ROLLUP (source)""", iso=("first", "last"))  # fmt: skip
def wide_report_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.wide_report(pipelines.wide_pipeline(_wide_sources(spark, sf_dir)))["sources"]


_AUDITED = f"""{_RECORDS}, wide AS (SELECT l.station_name, l.date, year(l.date)::INT AS year, any_value(s.state) AS state, any_value(s.latitude) AS latitude, max(value) FILTER (parameter = 'bod') AS bod, max(value) FILTER (parameter = 'cod') AS cod,
 max(value) FILTER (parameter = 'ph') AS ph, max(value) FILTER (parameter = 'tds') AS tds, max(value) FILTER (parameter = 'conductivity') AS conductivity FROM long l JOIN (
 SELECT DISTINCT station_name, CASE user_id % 3 WHEN 0 THEN 'Bihar' WHEN 1 THEN 'Goa' END AS state, latitude FROM raw) s USING (station_name) GROUP BY 1, 2, 3)"""


def _audited(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list[str]]:
    fused, wide = pipelines.record_pipeline([_records(spark, sf_dir)])
    return fused, wide, ["bod", "cod", "ph", "tds", "conductivity"]


@register(f"""WITH {_AUDITED} SELECT (SELECT count(DISTINCT station_name) FROM wide) AS stations, (SELECT count(*) FROM wide) AS wide_rows, (SELECT count(*) FROM long) AS records,
(SELECT round((count(bod) + count(cod) + count(ph) + count(tds) + count(conductivity)) * 20.0 / count(*), 3) FROM wide)::DOUBLE AS fill_pct""")
def audit_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.completeness(*_audited(spark, sf_dir))
    return out.select("stations", "wide_rows", "records", F.round(F.col("fill_pct").cast("double"), 3).alias("fill_pct"))


@register(f"""WITH {_AUDITED} SELECT CASE WHEN grouping(source) = 1 THEN 'INTEGRATED' ELSE source END AS source, count(DISTINCT station_name) AS stations, count(DISTINCT parameter) AS parameters, count(*) AS records, min(year(date))::INT AS first_year,
round(avg(trust_score), 3) AS mean_trust, round(100.0 * avg((quality_flag = 'valid')::INT), 1) AS valid_pct FROM long GROUP BY ROLLUP (source)""")
def audit_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, _, _ = _audited(spark, sf_dir)
    return audit.contribution(long).select("source", "stations", "parameters", "records", "first_year", "mean_trust", "valid_pct")


@register(f"WITH {_AUDITED} SELECT quality_flag, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM long), 2)::DOUBLE AS pct FROM long GROUP BY 1")
def audit_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags, _ = audit.quality_effect(_audited(spark, sf_dir)[0])
    return flags.withColumn("pct", F.col("pct").cast("double"))


@register(f"""WITH {_AUDITED} SELECT count(*) FILTER (latitude IS NOT NULL) AS rows_with, round(100.0 * avg((latitude IS NOT NULL)::INT), 4) AS pct, count(DISTINCT station_name) FILTER (latitude IS NOT NULL) AS stations_with,
count(DISTINCT station_name) FILTER (latitude IS NULL) AS stations_without, min(latitude)::DOUBLE AS min_latitude, max(latitude)::DOUBLE AS max_latitude, 80.0::DOUBLE AS min_longitude, 80.0::DOUBLE AS max_longitude FROM wide""")
def audit_spatial(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.spatial(_audited(spark, sf_dir)[1])


@register(f"WITH {_AUDITED} SELECT source, count(*) AS n, min(year(date))::INT AS min_year, max(year(date))::INT AS max_year FROM long GROUP BY 1")
def audit_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, wide, _ = _audited(spark, sf_dir)
    return audit.temporal(long, wide)[1]


@register(f"""WITH {_AUDITED}, v AS (SELECT unnest(['bod', 'cod', 'ph', 'tds', 'conductivity']) AS parameter, unnest([bod, cod, ph, tds, conductivity]) AS value FROM wide), k AS (SELECT v.*, lo, hi FROM v JOIN (VALUES ('bod', 0.0, 100.0), ('cod', 0.0, 500.0),
('ph', 5.5, 10.0), ('tds', 0.0, 5000.0), ('conductivity', 0.0, 5000.0)) b(parameter, lo, hi) USING (parameter) WHERE value IS NOT NULL) SELECT parameter, count(*) AS n, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS p25, round(median(value), 6) AS median,
round(quantile_cont(value, 0.75), 6) AS p75, max(value) AS max, round(100 * avg((value BETWEEN lo AND hi)::INT), 4) AS in_range_pct FROM k GROUP BY 1""")
def audit_plausibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.plausibility(_audited(spark, sf_dir)[1])[0]


@register(f"""WITH {_AUDITED}, s AS (SELECT station_name, count(DISTINCT source) > 1 AS m FROM long GROUP BY 1), d AS (SELECT 100.0::DOUBLE AS a, (SELECT 100.0 * avg((latitude IS NOT NULL)::INT) FROM wide) AS b, (SELECT 100.0 * avg((quality_flag = 'valid')::INT) FROM long) AS c,
(SELECT (count(bod) + count(cod) + count(ph) + count(tds) + count(conductivity)) * 20.0::DOUBLE / count(*) FROM wide) AS f, (SELECT least(100, 100.0::DOUBLE * (max(year) - min(year)) / 20) FROM wide) AS t, (SELECT 100.0 * avg(m::INT) FROM s) AS m)
SELECT round(b, 4) AS spatial_coverage, round(f, 4) AS param_fill_avg, round(m, 4) AS multi_source_pct, round((a + b + c + f + t + m) / 6, 2) AS overall FROM d""")
def audit_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = audit.score(*_audited(spark, sf_dir))
    r = lambda c: F.round(c, 4).alias(c)
    return out.select(r("spatial_coverage"), r("param_fill_avg"), r("multi_source_pct"), "overall")


@register(f"""WITH {_AUDITED} SELECT (SELECT count(*) FROM wide) AS wide_rows, (SELECT count(DISTINCT station_name) FROM wide) AS stations, 0::BIGINT AS numeric_stations, count(*) AS records, count(*) FILTER (quality_flag = 'suspect_consistency') AS suspect_consistency,
round(100.0 * avg((quality_flag = 'suspect_consistency')::INT), 1) AS suspect_pct FROM long""")
def sanity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    long, wide, _ = _audited(spark, sf_dir)
    return audit.sanity(long, wide).select("wide_rows", "stations", "numeric_stations", "records", "suspect_consistency", "suspect_pct")


_CLEAN = """raw AS (SELECT user_id AS k, event_id AS _seq, CASE event_id % 5 WHEN 0 THEN -999.0 ELSE value END AS a, CASE WHEN event_id % 7 = 0 THEN NULL ELSE (event_id % 20)::DOUBLE END AS b FROM events),
s AS (SELECT k, _seq, CASE WHEN a > -900 AND a BETWEEN 0 AND 500 THEN a END AS a, CASE WHEN b BETWEEN 0 AND 14 THEN b END AS b FROM raw), e AS (SELECT quantile_cont(a, [0.02, 0.98]) AS ea, quantile_cont(b, [0.02, 0.98]) AS eb, count(a) > 100 AS na, count(b) > 100 AS nb FROM s),
w AS (SELECT k, _seq, CASE WHEN a IS NULL OR NOT na THEN a ELSE least(greatest(a, ea[1]), ea[2]) END AS a, CASE WHEN b IS NULL OR NOT nb THEN b ELSE least(greatest(b, eb[1]), eb[2]) END AS b FROM s, e)"""


@register(f"WITH {_CLEAN} SELECT k, round(avg(a), 4) AS a, round(avg(b), 4) AS b FROM w WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1")
def cleaned_training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("k"), i.alias("_seq"), F.when(i % 5 == 0, -999.0).otherwise(F.col("value")).alias("wq_BOD"), F.when(i % 7 > 0, (i % 20).cast("double")).alias("wq_pH"))
    out = features.clean_for_training(e, ["wq_BOD", "wq_pH"], ["k"])
    return out.select("k", F.round("wq_BOD", 4).alias("a"), F.round("wq_pH", 4).alias("b"))


@register("""SELECT (json_extract(props, '$.k'))::INT + 1 AS k, count(*) AS n FROM events GROUP BY 1""")
def json_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by a JSON field, written as one JSON report and read back."""
    e = table(spark, sf_dir, "events").select((F.from_json("props", "k int").k + 1).alias("k"))
    report = sinks.json_report({"counts": profile.counts_by(e, "k")})
    return report.select(F.explode(F.from_json("report", "counts array<struct<k:int,n:bigint>>").counts).alias("r")).select("r.*")


# --- streaming -----------------------------------------------------------------------------


@register("""WITH s AS (SELECT user_id % 20 AS "stationId", strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:00:00Z') AS "timestamp", event_type, value, event_id % 3 AS file, event_id FROM events),
batches AS (SELECT file, "stationId", "timestamp", max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'click') AS click FROM s GROUP BY 1, 2, 3)
SELECT "stationId", "timestamp", view, click FROM (SELECT *, row_number() OVER (PARTITION BY "stationId", "timestamp" ORDER BY file DESC) AS rn FROM batches) WHERE rn = 1""")
def streamed_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three snapshot files taken in one by one; of repeated readings of a file the greatest value, of files the last counts."""
    e = table(spark, sf_dir, "events")
    rows = e.select(
        (F.col("user_id") % 20).alias("stationId"), F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.date_format("ts", "yyyy-MM-dd").alias("timestampDate"), "value", F.lit("mg/L").alias("unit"),
        F.col("event_type").alias("parameterNo"), F.col("event_type").alias("parameterName"), (F.col("event_id") % 3).alias("file"),
    )
    root = scratch_path(spark, "stream")
    for k in range(3):
        rows.where(F.col("file") == k).drop("file").coalesce(1).write.option("header", True).csv(f"{root}/written-{k}")
        _moved(spark, f"{root}/written-{k}", f"{root}/in/water_data_{k}.csv")
        incremental.run_available(incremental.snapshot_stream(spark, f"{root}/in"), f"{root}/table", f"{root}/checkpoint", ["view", "click"])
    return incremental.current_table(spark, f"{root}/table").select("stationId", "timestamp", "view", "click")


def _moved(spark: SparkSession, folder: str, to: str) -> None:
    """The only part file of a folder under another name."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(path(to).getParent())
    part = next(s.getPath() for s in files.listStatus(path(folder)) if s.getPath().getName().startswith("part-"))
    files.rename(part, path(to))
