"""Dimension tables and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions.text import station_id

def record_bounds(spark: SparkSession) -> DataFrame:
    rows = [(p, lo, hi) for p, (lo, hi, _) in schema.RECORD_PARAMETERS.items()]
    return spark.createDataFrame(rows, "parameter string, lo double, hi double")


def canonical_bounds(spark: SparkSession) -> DataFrame:
    rows = [(p, *b) for p, b in schema.CANONICAL_BOUNDS.items()]
    return spark.createDataFrame(
        rows, "parameter string, hard_min double, soft_min double, soft_max double, hard_max double"
    )


def trust_of(source: Column, trust: dict[str, float]) -> Column:
    """The trust of a source; unknown ones have the default."""
    pairs = [F.lit(x) for pair in trust.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), source), F.lit(schema.DEFAULT_TRUST))


def last_of_key(df: DataFrame, keys: list[str], order: str = "_seq") -> DataFrame:
    """The last row of each key; rows with a null key stay as one key."""
    return keep_one(df, keys, F.col(order).desc())


def first_of_key(df: DataFrame, keys: list[str], order: str = "_seq") -> DataFrame:
    return keep_one(df, keys, F.col(order).asc())


def keep_one(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row of each key that comes first in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def station_lookup(df: DataFrame, stations: DataFrame, *, key: str = "station_id", order: str = "_seq") -> DataFrame:
    """Left join of station data by normalised id; of repeated stations the last counts.

    A column that ``df`` has as well keeps its own value and is filled where empty.
    """
    right = last_of_key(stations.withColumn("_key", station_id(F.col(key).cast("string"))), ["_key"], order)
    extra = [c for c in stations.columns if c not in (key, order)]
    right = right.select("_key", *[F.col(c).alias(f"_r_{c}") for c in extra])  # broadcast at run time if its size allows
    joined = df.withColumn("_key", station_id(F.col(key).cast("string"))).join(right, "_key", "left").drop("_key")
    for c in extra:
        own = F.nullif(F.col(c).cast("string"), F.lit("")) if c in df.columns else None
        found = F.col(f"_r_{c}")
        joined = joined.withColumn(c, found if own is None else F.when(own.isNull(), found).otherwise(F.col(c))).drop(f"_r_{c}")
    return joined


def lookup_misses(df: DataFrame, stations: DataFrame, *, key: str = "station_id") -> DataFrame:
    """Distinct keys of ``df`` that no station has."""
    norm = lambda d: d.select(station_id(F.col(key).cast("string")).alias(key)).distinct()
    return norm(df).join(norm(stations), key, "left_anti")


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def unprocessed(df: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``df`` whose key isn't among those done."""
    return df.join(done.select(*keys).distinct(), keys, "left_anti")


def members(df: DataFrame, column: str, known: DataFrame) -> DataFrame:
    """Rows whose value is one of the first column of ``known``."""
    return df.join(known.select(F.col(known.columns[0]).alias(column)).distinct(), column, "left_semi")


def jobs(stations: DataFrame, parameters: list[str]) -> DataFrame:
    """A row per station and parameter: what is to be fetched."""
    return stations.withColumn("parameter", F.explode(F.array(*[F.lit(p) for p in sorted(parameters)])))


def station_days(readings: DataFrame, scenes: DataFrame, keys: list[str], order: str = "_seq") -> DataFrame:
    """Readings with the last row of the other side for their key; readings without one go."""
    return readings.join(last_of_key(scenes, keys, order).drop(order), keys)
