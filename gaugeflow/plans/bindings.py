"""The operators' inputs drawn from the tables of a data directory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Event type -> parameter of the observations drawn from events.
PARAMETERS = {"signup": "bod", "view": "cod", "click": "tds", "error": "conductivity", "purchase": "ph"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as long observations: station = user, parameter by type, source by id."""
    e = table(spark, sf_dir, "events")
    pairs = [F.lit(x) for kv in PARAMETERS.items() for x in kv]
    source = F.when(F.col("event_id") % 3 == 0, "cpcb").when(F.col("event_id") % 3 == 1, "data_gov_in").otherwise("other")
    return e.select(
        F.concat(F.lit("Station "), F.col("user_id").cast("string")).alias("station_name"),
        F.to_date("ts").alias("date"),
        F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("event_type")), F.col("event_type")).alias("parameter"),
        "value",
        source.alias("source"),
        F.col("event_id").alias("_seq"),
    )
