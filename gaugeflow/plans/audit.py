"""The audit of an integrated data set: seven sections and a score, as small tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import text
from gaugeflow.operators import lookup, profile


def _with_coordinates() -> Column:
    return F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def completeness(long: DataFrame, wide: DataFrame, parameters: list[str]) -> DataFrame:
    """One row: stations, states, years, rows, records and the mean fill rate of the parameters."""
    rates = profile.fill_rates(wide, parameters).agg(F.avg("pct").alias("fill_pct"))
    whole = wide.agg(
        F.count_distinct("station_name").alias("stations"), F.count_distinct("state").alias("states"), F.min("date").alias("first"), F.max("date").alias("last"),
        (F.max("year") - F.min("year") + 1).alias("years"), F.count(F.lit(1)).alias("wide_rows"),
    )
    return whole.join(long.agg(F.count(F.lit(1)).alias("records"))).join(rates)  # one row each


def contribution(long: DataFrame) -> DataFrame:
    """Records, their share, stations, parameters and years by source, and a row of all."""
    sums = {
        "stations": F.count_distinct("station_name"), "parameters": F.count_distinct("parameter"), "records": F.count(F.lit(1)), "first_year": F.min("year"), "last_year": F.max("year"),
        "states": F.count_distinct("state"), "mean_trust": F.round(F.avg("trust_score"), 3), "valid_pct": F.round(100.0 * F.avg((F.col("quality_flag") == schema.VALID).cast("int")), 1),
    }
    return profile.summary_with_total(long, "source", sums, "INTEGRATED")


def quality_effect(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Flags with their shares, and the spread of trust by source."""
    trust = long.groupBy("source").agg(F.avg("trust_score").alias("mean"), F.stddev_samp("trust_score").alias("std"), F.min("trust_score").alias("min"), F.max("trust_score").alias("max"))
    return profile.share_by(long, "quality_flag"), trust


def spatial(wide: DataFrame) -> DataFrame:
    """One row: rows and stations with and without coordinates, and the box they span."""
    there = _with_coordinates()
    of = lambda c, has: F.count_distinct(F.when(has, F.col(c)))
    return wide.agg(
        F.count_if(there).alias("rows_with"), F.round(100.0 * F.avg(there.cast("int")), 4).alias("pct"), of("station_name", there).alias("stations_with"), of("station_name", ~there).alias("stations_without"),
        *[f(F.when(there, F.col(c))).alias(f"{n}_{c}") for c in ("latitude", "longitude") for n, f in (("min", F.min), ("max", F.max))],
    )


def temporal(long: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows by year, and the years of each source."""
    return profile.counts_by(wide.where("year IS NOT NULL"), "year"), profile.extents(long, ["source"], [], ["year"])


def plausibility(wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranges of the parameters, and how often BOD is at most COD."""
    present = [p for p in schema.PLAUSIBLE if p in wide.columns]
    spark = wide.sparkSession
    bounds = spark.createDataFrame([(p, *schema.PLAUSIBLE[p]) for p in present], "parameter string, lo double, hi double")
    long = wide.unpivot([], [F.col(p).cast("double").alias(p) for p in present], "parameter", "value").where("value IS NOT NULL")
    return profile.range_profile(long, bounds), profile.pair_consistency(wide, "bod", "cod")


def score(long: DataFrame, wide: DataFrame, parameters: list[str]) -> DataFrame:
    """One row: the six dimensions from 0 to 100, each capped, and their mean."""
    fill = sum((F.avg(F.col(p).isNotNull().cast("int")) for p in parameters), F.lit(0.0)) * 100.0 / len(parameters)
    named = ~text.is_number_name(F.col("station_name"))
    of_wide = wide.agg(
        (100.0 * F.avg(named.cast("int"))).alias("station_resolution"), (100.0 * F.avg(_with_coordinates().cast("int"))).alias("spatial_coverage"), fill.alias("param_fill_avg"),
        (100.0 * (F.max("year") - F.min("year")) / 20).alias("temporal_span"),
    )
    valid = long.agg((100.0 * F.avg((F.col("quality_flag") == schema.VALID).cast("int"))).alias("quality_valid_pct"))
    several = long.groupBy("station_name").agg(F.count_distinct("source").alias("n")).agg((100.0 * F.avg((F.col("n") > 1).cast("int"))).alias("multi_source_pct"))
    rows = of_wide.join(valid).join(several)  # one row each
    dimensions = ["station_resolution", "spatial_coverage", "quality_valid_pct", "param_fill_avg", "temporal_span", "multi_source_pct"]
    return profile.integration_score(rows, {d: F.max(d) for d in dimensions})


def audit(long: DataFrame, wide: DataFrame, parameters: list[str] | None = None) -> dict[str, DataFrame]:
    """All sections by name."""
    present = parameters or [p for p in schema.RECORD_PARAMETERS if p in wide.columns]
    flags, trust = quality_effect(long)
    years, spans = temporal(long, wide)
    ranges, pairs = plausibility(wide)
    return {
        "completeness": completeness(long, wide, present), "fill_rates": profile.fill_rates(wide, present), "contribution": contribution(long),
        "multi_source": profile.multi_source_keys(long, ["station_name"]), "flags": flags, "trust": trust, "spatial": spatial(wide), "years": years, "spans": spans,
        "ranges": ranges, "pairs": pairs, "score": score(long, wide, present),
    }


def sanity(long: DataFrame, wide: DataFrame) -> DataFrame:
    """One row of the first checks: stations whose names are numbers, suspects, rows, stations, coordinates."""
    number = text.is_number_name(F.col("station_name"))
    of_wide = wide.agg(
        F.count_distinct(F.when(number, F.col("station_name"))).alias("numeric_stations"), F.count_if(number).alias("numeric_rows"), F.count(F.lit(1)).alias("wide_rows"),
        F.count_distinct("station_name").alias("stations"), F.count_distinct("state").alias("states"), F.round(100.0 * F.avg(_with_coordinates().cast("int")), 1).alias("coordinates_pct"),
    )
    suspect = F.col("quality_flag") == schema.SUSPECT_CONSISTENCY
    of_long = long.agg(F.count(F.lit(1)).alias("records"), F.count_if(suspect).alias("suspect_consistency"), F.round(100.0 * F.avg(suspect.cast("int")), 1).alias("suspect_pct"))
    return of_wide.join(of_long)  # one row each


def dashboard_filter(df: DataFrame, sources: list[str], years: tuple[int, int], stations: DataFrame | None = None) -> DataFrame:
    """Rows of the sources, of the years from first to last, and of the stations if any are given."""
    chosen = df.where(F.col("source").isin(sources) & F.col("year").between(*years))
    return chosen if stations is None else lookup.members(chosen, "station_name", stations)
