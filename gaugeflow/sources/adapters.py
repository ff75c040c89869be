"""Source adapters: each fetches a source as text columns and parses it into canonical records.

``run`` is both.  Records have the columns of ``schema.CANONICAL``; rows without a
station or a date are left out, and so are values that aren't numbers.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import parse, text
from gaugeflow.operators.lookup import last_of_key
from gaugeflow.operators.reshape import union_all
from gaugeflow.sources import readers


class Adapter(ABC):
    """A source; ``source`` names it in the records."""

    source: str

    @abstractmethod
    def fetch(self, spark: SparkSession) -> DataFrame | None:
        """The source's rows as they are; None if there are none."""

    @abstractmethod
    def parse(self, raw: DataFrame) -> DataFrame:
        """Canonical records of the rows."""

    def run(self, spark: SparkSession) -> DataFrame:
        raw = self.fetch(spark)
        return spark.createDataFrame([], schema.CANONICAL) if raw is None else self.parse(raw)

    def records(self, raw: DataFrame, meta: Mapping[str, Column], measures: list[tuple[str, str | Column, str]]) -> DataFrame:
        """Records of ``measures`` (column, parameter, unit) beside ``meta``."""
        items = [
            F.struct(
                F.col(f"`{c}`").cast("string").alias("raw"), F.lit(c.strip()).alias("source_parameter"), (p if isinstance(p, Column) else F.lit(p)).alias("parameter"),
                F.lit(unit).alias("unit"), F.lit(i).alias("at"),
            )
            for i, (c, p, unit) in enumerate(measures)
        ]
        seq = F.col("_seq") if "_seq" in raw.columns else F.monotonically_increasing_id()
        if not items:
            return raw.sparkSession.createDataFrame([], schema.CANONICAL)
        rows = raw.select(seq.alias("_row"), *[c.alias(n) for n, c in meta.items()], F.explode(F.array(*items)).alias("e")).select("*", "e.*")
        # parsed after the explode, so that the code holds one parser and not one per column
        rows = rows.withColumn("value", parse.safe_float(F.col("raw")))
        given = {
            **{n: F.col(n) for n in meta},
            "parameter": F.col("parameter"), "value": F.col("value"), "unit": F.col("unit"), "source": F.lit(self.source), "source_parameter": F.col("source_parameter"),
            "source_unit": F.col("unit"), "source_value": F.col("value"), "quality_flag": F.lit(schema.VALID), "confidence": F.lit(1.0), "notes": F.lit(""),
            "_seq": F.col("_row") * 1000 + F.col("at"),
        }
        kept = rows.where("value IS NOT NULL AND sample_date IS NOT NULL AND station_id IS NOT NULL AND parameter IS NOT NULL")
        return kept.select(*[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CANONICAL])


def _filled(raw: DataFrame, *names: str) -> Column:
    """The first of the columns that exist whose trimmed text isn't empty."""
    cells = [F.nullif(F.trim(F.col(f"`{n}`").cast("string")), F.lit("")) for n in names if n in raw.columns]
    return F.coalesce(*cells, F.lit(None).cast("string"))


def _found(columns: list[str], words: list[str]) -> str | None:
    """The first column whose header holds any of ``words``."""
    return next((c for c in columns if any(w in c.lower() for w in words)), None)


class SensorAdapter(Adapter):
    """Sensor rows, a column per parameter, beside a file of stations.

    What a row says of its station counts before the file; a coordinate of 0 is
    taken as missing; rows without coordinates are left out.
    """

    source = "cpcb"

    def __init__(self, raw: DataFrame | str, stations: DataFrame | str | None = None):
        self.raw, self.stations = raw, stations

    def _table(self, spark: SparkSession, given: DataFrame | str) -> DataFrame:
        return readers.csv_strings(spark, given) if isinstance(given, str) else given

    def fetch(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, self.raw)

    def known_stations(self, spark: SparkSession) -> DataFrame | None:
        """(_sid, _name, _lat, _lon, _state, _river) of the file; of repeated stations the last."""
        if self.stations is None:
            return None
        s = self._table(spark, self.stations)
        places = [F.lower(_filled(s, c)) for c in ("river", "river_name", "site_name", "catchment")]
        river = F.coalesce(*[text.title(text.known_river(p, schema.KNOWN_RIVERS)) for p in places])
        rows = s.select(
            text.station_id(_filled(s, "station_id", "stationId")).alias("_sid"), _filled(s, "station_name").alias("_name"), parse.safe_float(_filled(s, "latitude")).alias("_lat"),
            parse.safe_float(_filled(s, "longitude")).alias("_lon"), _filled(s, "state").alias("_state"), river.alias("_river"),
            (F.col("_seq") if "_seq" in s.columns else F.monotonically_increasing_id()).alias("_order"),
        ).where("_sid IS NOT NULL")
        return last_of_key(rows, ["_sid"], "_order").drop("_order")

    def parse(self, raw: DataFrame) -> DataFrame:
        sid = text.station_id(_filled(raw, "stationId", "station_id"))
        known = self.known_stations(raw.sparkSession)
        if known is None:
            known = raw.sparkSession.createDataFrame([], "_sid string, _name string, _lat double, _lon double, _state string, _river string")
        joined = raw.withColumn("_id", sid).where("_id IS NOT NULL").join(known, F.col("_id") == F.col("_sid"), "left")
        place = lambda c, other: F.coalesce(F.nullif(parse.safe_float(_filled(raw, c)), F.lit(0.0)), F.col(other))
        joined = joined.withColumns({"_latitude": place("latitude", "_lat"), "_longitude": place("longitude", "_lon")}).where("_latitude IS NOT NULL AND _longitude IS NOT NULL")
        meta = {
            "station_id": F.concat(F.lit("cpcb_"), F.col("_id")), "station_name": F.coalesce(_filled(raw, "station_name"), F.col("_name"), F.lit("")), "river": F.coalesce("_river", F.lit("")),
            "state": F.coalesce(_filled(raw, "state"), F.col("_state"), F.lit("")), "latitude": F.col("_latitude"), "longitude": F.col("_longitude"),
            "sample_date": parse.parse_date(_filled(raw, "timestamp")), "source_station_id": F.col("_id"),
        }
        named = [(c, schema.SENSOR_COLUMNS.get(c.strip()) or schema.SENSOR_COLUMNS.get(c.strip().removeprefix("wq_"))) for c in raw.columns]
        return self.records(joined, meta, [(c, *found) for c, found in named if found])


class HydrologyAdapter(Adapter):
    """Levels and flows of a file, or of the sheets of a workbook, each with headers of its own."""

    source = "cwc"

    def __init__(self, tables: DataFrame | str | Mapping[str, DataFrame]):
        self.tables = tables

    def fetch(self, spark: SparkSession) -> DataFrame | None:
        """The file; of several sheets their union, as ``parse`` finds columns by words."""
        if isinstance(self.tables, str):
            return readers.csv_strings(spark, self.tables)
        return self.tables if isinstance(self.tables, DataFrame) else (union_all(list(self.tables.values())) if self.tables else None)

    def run(self, spark: SparkSession) -> DataFrame:
        if isinstance(self.tables, Mapping) and self.tables:
            return union_all([self.parse(sheet) for _, sheet in sorted(self.tables.items())])
        return super().run(spark)

    def parse(self, raw: DataFrame) -> DataFrame:
        columns = [c for c in raw.columns if c not in ("source_file", "_seq")]
        get = lambda *words: F.col(f"`{c}`").cast("string") if (c := next((f for w in words if (f := _found(columns, [w]))), None)) else F.lit(None).cast("string")
        name = F.nullif(text.clean(get("station", "site")), F.lit(""))
        meta = {
            "station_id": F.concat(F.lit("cwc_"), F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, 30)), "station_name": name, "river": F.coalesce(text.clean(get("river")), F.lit("")),
            "state": F.coalesce(text.clean(get("state")), F.lit("")), "latitude": F.coalesce(parse.safe_float(get("lat")), F.lit(0.0)), "longitude": F.coalesce(parse.safe_float(get("lon")), F.lit(0.0)),
            "sample_date": parse.parse_date(get("date")), "source_station_id": name,
        }
        measures = []
        for c in columns:
            found = next((v for k, v in schema.HYDROLOGY_COLUMNS.items() if k in c.lower()), None)
            if found:
                unit = "ft³/s" if found[0] == "discharge" and "cusec" in c.lower() else found[1]
                measures.append((c, found[0], unit))
        return self.records(raw, meta, measures)


class OpenDataAdapter(Adapter):
    """Files of any headers: roles are found by words, all other columns may be parameters."""

    source = "data_gov_in"

    def __init__(self, raw: DataFrame | str):
        self.raw = raw

    def fetch(self, spark: SparkSession) -> DataFrame:
        return readers.csv_strings(spark, self.raw) if isinstance(self.raw, str) else self.raw

    @staticmethod
    def roles(columns: list[str]) -> dict[str, str]:
        return {role: c for role, words in schema.OPEN_DATA_ROLES.items() if (c := _found(columns, words))}

    def parse(self, raw: DataFrame) -> DataFrame:
        columns = [c for c in raw.columns if c not in ("source_file", "_seq")]
        roles = self.roles(columns)
        get = lambda r: F.col(f"`{roles[r]}`").cast("string") if r in roles else F.lit(None).cast("string")
        name = F.nullif(text.clean(get("station")), F.lit(""))
        meta = {
            "station_id": F.concat(F.lit("dgov_"), F.substring(F.replace(F.lower(name), F.lit(" "), F.lit("_")), 1, 30)), "station_name": name, "river": F.coalesce(text.clean(get("river")), F.lit("")),
            "state": F.coalesce(text.clean(get("state")), F.lit("")), "latitude": F.coalesce(parse.safe_float(get("latitude")), F.lit(0.0)),
            "longitude": F.coalesce(parse.safe_float(get("longitude")), F.lit(0.0)), "sample_date": parse.parse_date(get("date")), "source_station_id": name,
        }
        rest = [c for c in columns if c not in roles.values()]
        return self.records(raw, meta, [(c, text.raw_parameter(F.lit(c)), "") for c in rest])


class LongFileAdapter(Adapter):
    """The international file that is long already."""

    source = "gemstat"

    def __init__(self, raw: DataFrame | str):
        self.raw = raw

    def fetch(self, spark: SparkSession) -> DataFrame:
        return readers.csv_strings(spark, self.raw) if isinstance(self.raw, str) else self.raw

    def parse(self, raw: DataFrame) -> DataFrame:
        rows = readers.gemstat(raw).where("parameter IS NOT NULL AND source_station_id IS NOT NULL")
        given = {
            "station_id": F.concat(F.lit("gemstat_"), F.col("source_station_id")), "quality_flag": F.lit(schema.VALID), "confidence": F.lit(1.0), "notes": F.lit(""), "source_unit": F.col("unit"),
            "source_value": F.col("value"), "_seq": F.monotonically_increasing_id(),
        }
        return rows.select(*[given.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.CANONICAL])


def collect_records(adapters: list[Adapter], spark: SparkSession) -> DataFrame:
    """The records of all adapters, in their order."""
    frames = [a.run(spark).withColumn("_adapter", F.lit(i)) for i, a in enumerate(adapters)]
    return union_all(frames).withColumn("_seq", F.col("_adapter").cast("long") * (1 << 52) + F.col("_seq")).drop("_adapter")
