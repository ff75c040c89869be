"""Joins of readings to imagery in windows of days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow import schema


def _candidates(readings: DataFrame, scenes: DataFrame, key: list[str], days: int) -> DataFrame:
    """Pairs of readings (.., date) and scenes (.., scene_date) of one key within ``days``.

    Dates fall into buckets as wide as the window; a reading looks into its own
    and both neighbours, so the join is on equal keys and never on a range alone.
    """
    bucket = lambda d: F.floor(F.date_diff(d, F.lit("1970-01-01").cast("date")) / days)
    near = F.explode(F.array(*[bucket(F.col("date")) + k for k in (-1, 0, 1)]))
    left = readings.withColumn("_bucket", near)
    right = scenes.withColumn("_bucket", bucket(F.col("scene_date")))
    apart = F.abs(F.date_diff("scene_date", "date"))
    return left.join(right, [*key, "_bucket"]).withColumn("_apart", apart).where(F.col("_apart") <= days).drop("_bucket")


def tiered_composite(
    readings: DataFrame, scenes: DataFrame, key: list[str], bands: list[str], tiers: list[tuple[int, float]] = schema.TIERS, need_values: bool = False
) -> DataFrame:
    """For each reading the median of each band over the scenes of the first tier that has any.

    A tier takes scenes up to so many days away and below so much cloud.  With
    ``need_values`` scenes whose bands are all null don't count.
    """
    found = _candidates(readings, scenes, key, max(d for d, _ in tiers))
    if need_values:
        found = found.where(F.coalesce(*bands).isNotNull())
    tier = F.coalesce(*[F.when((F.col("_apart") <= d) & (F.col("cloud") < c), i) for i, (d, c) in enumerate(tiers)])
    rows = found.withColumn("tier", tier).where("tier IS NOT NULL")
    per_tier = rows.groupBy(*key, "date", "tier").agg(F.count(F.lit(1)).alias("scene_count"), *[F.median(b).alias(b) for b in bands])
    best = F.min_by(F.struct("tier", "scene_count", *bands), "tier").alias("_b")
    return per_tier.groupBy(*key, "date").agg(best).select(*key, "date", "_b.*")


def nearest_clear(readings: DataFrame, scenes: DataFrame, key: list[str], days: int = 3, cloud: float = 60.0, tie: str = "scene_id") -> DataFrame:
    """For each reading the least clouded scene within ``days`` and below ``cloud``."""
    found = _candidates(readings, scenes, key, days).where(F.col("cloud") < cloud)
    columns = [c for c in scenes.columns if c not in key]
    best = F.min_by(F.struct(*columns), F.struct("cloud", tie)).alias("_b")
    return found.groupBy(*key, "date").agg(best).select(*key, "date", "_b.*")


def profiled_composite(readings: DataFrame, scenes: DataFrame, profiles: DataFrame, key: list[str], bands: list[str]) -> DataFrame:
    """As ``tiered_composite`` with tiers by key from ``profiles`` (.., days, clouds: arrays of equal size)."""
    most = profiles.agg(F.max(F.array_max("days"))).first()[0] or 1
    found = _candidates(readings, scenes, key, most).join(F.broadcast(profiles) if profiles.count() <= 100_000 else profiles, key)
    fits = F.filter(
        F.sequence(F.lit(0), F.size("days") - 1),
        lambda i: (F.col("_apart") <= F.col("days")[i]) & (F.col("cloud") < F.col("clouds")[i]),
    )
    rows = found.withColumn("tier", F.try_element_at(fits, F.lit(1))).where("tier IS NOT NULL")
    per_tier = rows.groupBy(*key, "date", "tier").agg(F.count(F.lit(1)).alias("scene_count"), *[F.median(b).alias(b) for b in bands])
    best = F.min_by(F.struct("tier", "scene_count", *bands), "tier").alias("_b")
    return per_tier.groupBy(*key, "date").agg(best).select(*key, "date", "_b.*")
