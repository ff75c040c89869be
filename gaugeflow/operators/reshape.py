"""Long to wide and back, unions, upserts, ranks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators.lookup import keep_one
from gaugeflow.operators.order import numbered


def melt(df: DataFrame, keys: list[str], measures: list[str], name: str = "parameter", value: str = "value") -> DataFrame:
    """A row per key and measure that isn't null."""
    return df.unpivot(keys, measures, name, value).where(F.col(value).isNotNull())


def pivot_wide(df: DataFrame, parameters: list[str]) -> DataFrame:
    """A row per station and date: the last value of each parameter and the group's metadata."""
    truthy = lambda c, zero: F.min_by(c, F.when(F.col(c).isNotNull() & (F.col(c) != zero), F.col("_seq")))
    last = lambda p: F.max_by(F.when(F.col("parameter") == p, F.col("value")), F.when(F.col("parameter") == p, F.col("_seq")))
    listed = F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split(F.concat_ws("; ", "all_sources", "source"), "; ")))))
    return df.groupBy("station_name", "date").agg(
        F.min_by("station_code", "_seq").alias("station_code"),
        F.min_by("year", "_seq").alias("year"),
        truthy("latitude", 0).alias("latitude"),
        truthy("longitude", 0).alias("longitude"),
        truthy("state", "").alias("state"),
        F.count(F.lit(1)).alias("n_params"),
        F.least(F.lit(1.0), F.min("trust_score")).alias("min_trust"),
        F.round(F.avg("trust_score") + 1e-12, 3).alias("mean_trust"),
        F.array_join(F.array_remove(listed, ""), "; ").alias("all_sources"),
        *[last(p).alias(p) for p in parameters],
    )


def pivot_last(df: DataFrame, keys: list[str], names: list[str], name: str, value: str, order: str) -> DataFrame:
    """A column per name with the value of the last row; null keys are dropped."""
    last = lambda n: F.max_by(F.when(F.col(name) == n, F.col(value)), F.when(F.col(name) == n, F.col(order)))
    whole = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    return whole.groupBy(*keys).agg(*[last(n).alias(n) for n in sorted(names)])


def union_all(frames: list[DataFrame]) -> DataFrame:
    """All rows with the union of the columns."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """Rows of both; of a key in both the new row counts, as a whole."""
    both = union_all([old.withColumn("_new", F.lit(0)), new.withColumn("_new", F.lit(1))])
    by = [F.col("_new").desc()] + ([F.col(order).desc()] if order else [])
    return keep_one(both, keys, *by).drop("_new")


def average_rank(value: str, *by: str) -> Column:
    """The rank of ``value`` within ``by``; equal values share the mean of their ranks."""
    among, same = Window.partitionBy(*by).orderBy(value), Window.partitionBy(*by, value)
    return F.rank().over(among) + (F.count(F.lit(1)).over(same) - 1) / 2


def exact_sample(df: DataFrame, key: str, *, n: int | None = None, fraction: float | None = None, seed: int = 42) -> DataFrame:
    """``n`` rows, or a fraction of them, chosen by a hash of the key; the fraction wins if both are given."""
    if n is None and fraction is None:
        raise ValueError("give n or fraction")
    if fraction is not None:
        n = round(df.count() * fraction)
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(n)


def top(df: DataFrame, by: str, n: int, *ties: str) -> DataFrame:
    """The ``n`` rows of greatest ``by``."""
    return df.orderBy(F.col(by).desc(), *ties).limit(n)


def truncated(df: DataFrame, most: int | None, *by: str) -> DataFrame:
    """The first ``most`` rows; with 0 or None all."""
    return df.orderBy(*by).limit(most) if most else df


def tail(df: DataFrame, n: int, *by: str) -> DataFrame:
    """The last ``n`` rows in an order, in that order."""
    return df.orderBy(*[F.col(c).desc() for c in by]).limit(n).orderBy(*by)


def by_station_and_date(df: DataFrame) -> DataFrame:
    """Sorted by name and the date's text, which is ``None`` where there is no date."""
    return df.orderBy("station_name", F.coalesce(F.col("date").cast("string"), F.lit("None")))


def _downstream(df: DataFrame, region: str, lon: str, ties: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with the least longitude of each row's region, and the order by it, longitude and ``ties``; nulls are last."""
    firsts = df.groupBy(F.col(region).alias("_region")).agg(F.min(lon).alias("_first"))
    placed = df.join(firsts, F.col(region).eqNullSafe(F.col("_region")), "left").drop("_region")
    return placed, [F.col(c).asc_nulls_last() for c in ("_first", region, lon, *ties)]


def west_to_east(df: DataFrame, region: str = "region", lon: str = "lon", ties: tuple[str, ...] = ()) -> DataFrame:
    """Sorted by region in the order rivers flow through them, then by longitude and ``ties``."""
    placed, by = _downstream(df, region, lon, ties)
    return placed.orderBy(*by).drop("_first")


def west_to_east_places(df: DataFrame, name: str, region: str = "region", lon: str = "lon", ties: tuple[str, ...] = ()) -> DataFrame:
    """``df`` with each row's place in the order of ``west_to_east``, from 0; no single task sorts the rows."""
    placed, by = _downstream(df, region, lon, ties)
    return numbered(placed, by, name).drop("_first")


def merged(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """The first frame with the columns of the others by key; of columns that repeat, the first frame's count."""
    out = frames[0]
    for other in frames[1:]:
        out = out.join(other.select(*keys, *[c for c in other.columns if c not in out.columns]), keys, "left")
    return out


def pivot_daily_mean(df: DataFrame, keys: list[str], names: list[str], kind: str = "Day.Mean", order: str = "_seq") -> DataFrame:
    """A column per parameter with the first value of the series of one kind."""
    first = lambda n: F.min_by(F.when(F.col("parameter") == n, F.col("value")), F.when((F.col("parameter") == n) & F.col("value").isNotNull(), F.col(order)))
    return df.where(F.col("aggregation") == kind).groupBy(*keys).agg(*[first(n).alias(n) for n in sorted(names)])
