"""Sinks: CSV files of fixed columns, reports as JSON, run logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, *, append: bool = False) -> None:
    """Those of ``columns`` that exist, in their order, with a header; a whole folder is replaced at once."""
    chosen = df if columns is None else df.select(*[c for c in columns if c in df.columns])
    chosen.write.mode("append" if append else "overwrite").option("header", True).csv(path)


def json_report(parts: dict[str, DataFrame]) -> DataFrame:
    """One row with a JSON document: a list of objects per part; parts are small aggregates."""
    docs = None
    for name, df in parts.items():
        one = df.agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias(name))
        docs = one if docs is None else docs.crossJoin(one)  # one row each
    body = F.concat(F.lit("{"), F.concat_ws(",", *[F.concat(F.lit(f'"{n}":'), F.col(n)) for n in parts]), F.lit("}"))
    return docs.select(body.alias("report"))


def run_log(df: DataFrame, status: str, file: str) -> DataFrame:
    """The log row of a run: stations, parameters, rows, first and last reading."""
    return df.agg(F.count_distinct("stationId").alias("stations"), F.count_distinct("parameterNo").alias("parameters"), F.count(F.lit(1)).alias("rows"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last")).select(
        F.lit(status).alias("status"), F.lit(file).alias("file"), "*"
    )


def iso_dates(df: DataFrame) -> DataFrame:
    """Dates as ISO text."""
    return df.withColumns({f.name: F.date_format(f.name, "yyyy-MM-dd") for f in df.schema if f.dataType.simpleString() == "date"})
