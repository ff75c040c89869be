"""Profiles, audits and reports as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.operators import order


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def share_by(df: DataFrame, *keys: str) -> DataFrame:
    """Counts by key and their percentage of all rows, two decimals."""
    counted = counts_by(df, *keys)
    return counted.withColumn("pct", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2))


def multi_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of each key's values in one pass: dimension, value, n."""
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), F.col(k).cast("string").alias("value")) for k in keys])).alias("e"))
    return rows.groupBy("e.dimension", "e.value").agg(F.count(F.lit(1)).alias("n"))


def fill_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, pct) of the columns that aren't null."""
    one = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count(c).alias(c) for c in columns])
    return one.unpivot(["_n"], columns, "column", "filled").select("column", "filled", F.round(100.0 * F.col("filled") / F.col("_n"), 4).alias("pct"))


def present_columns(df: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` with any value."""
    row = df.agg(*[F.count(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def distinct_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*[F.count_distinct(c).alias(f"n_{c}") for c in columns])


def multi_source_keys(df: DataFrame, keys: list[str], source: str = "source") -> DataFrame:
    """Keys that several sources report, and how many."""
    return df.groupBy(*keys).agg(F.count_distinct(source).alias("n_sources")).where("n_sources > 1")


def summary_with_total(df: DataFrame, source: str, measures: dict[str, Column], total: str = "ALL") -> DataFrame:
    """``measures`` by source and a row of all, by rollup."""
    rolled = df.rollup(source).agg(F.grouping(source).alias("_g"), *[c.alias(n) for n, c in measures.items()])
    return rolled.withColumn(source, F.when(F.col("_g") == 1, total).otherwise(F.col(source))).drop("_g")


def with_percentiles(groups: DataFrame, df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """``groups``, a row per key, with ``_q``, an array of exact percentiles of ``value`` in ``df``; null keys are equal."""
    q = order.percentiles(df, keys, value, shares).select(*[F.col(k).alias(f"_p_{k}") for k in keys], "_q")
    same = [F.col(k).eqNullSafe(F.col(f"_p_{k}")) for k in keys]
    return groups.join(q, same, "left").drop(*[f"_p_{k}" for k in keys])


def describe_by(df: DataFrame, keys: list[str], value: str, digits: int = 4) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest by key."""
    one = df.groupBy(*keys).agg(F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    one = with_percentiles(one, df, keys, value, [0.25, 0.5, 0.75])
    r = lambda c: F.round(c, digits)
    return one.select(
        *keys, "count", r(F.col("mean")).alias("mean"), r(F.col("std")).alias("std"), r(F.col("min")).alias("min"),
        *[r(F.col("_q")[i]).alias(n) for i, n in enumerate(("p25", "median", "p75"))], r(F.col("max")).alias("max"),
    )


def range_profile(df: DataFrame, bounds: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """Spread of each parameter and the percentage in its plausible range (lo, hi)."""
    inside = F.avg(F.col(value).between(F.col("lo"), F.col("hi")).cast("int")) * 100
    known = df.join(F.broadcast(bounds), parameter)  # a fixed table of rules
    one = known.groupBy(parameter).agg(F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.round(inside, 4).alias("in_range_pct"))
    one = with_percentiles(one, known, [parameter], value, [0.25, 0.5, 0.75])
    return one.select(parameter, "n", "min", *[F.round(F.col("_q")[i], 6).alias(n) for i, n in enumerate(("p25", "median", "p75"))], "max", "in_range_pct")


def outlier_profile(df: DataFrame, parameter: str = "parameter", value: str = "value") -> DataFrame:
    """Percentiles, values beyond p2 and p98 and beyond 1.5 times the quartile range."""
    shares = [0.02, 0.25, 0.5, 0.75, 0.98]
    names = ["p2", "p25", "median", "p75", "p98"]
    q = order.percentiles(df, [parameter], value, shares)
    q = q.select(parameter, *[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    v, iqr = F.col(value), F.col("p75") - F.col("p25")
    out = (v < F.col("p25") - 1.5 * iqr) | (v > F.col("p75") + 1.5 * iqr)
    return df.join(q, parameter).groupBy(parameter, *names).agg(
        F.count(value).alias("count"), F.count_if(v < F.col("p2")).alias("n_below_p2"), F.count_if(v > F.col("p98")).alias("n_above_p98"),
        F.count_if(out).alias("n_iqr_outliers"), F.round(100.0 * F.count_if(out) / F.count(value), 4).alias("iqr_outlier_pct"),
    )


def missing_audit(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Per target: total, missing, sentinels (-900 or less), below, above, clean and its percentage."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in bounds]).unpivot([], list(bounds), "target", "v")
    pairs = [F.lit(x) for c, b in bounds.items() for x in (c, F.array(*[F.lit(y) for y in b]))]
    b = F.element_at(F.create_map(*pairs), F.col("target"))
    v, missing = F.col("v"), F.col("v").isNull() | F.isnan("v")
    sentinel = ~missing & (v <= -900)
    below, above = ~missing & ~sentinel & (v < b[0]), ~missing & ~sentinel & (v > b[1])
    clean = F.count_if(~missing & ~sentinel & ~below & ~above)
    return long.groupBy("target").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(missing).alias("missing"), F.count_if(sentinel).alias("sentinel"), F.count_if(below).alias("below_min"),
        F.count_if(above).alias("above_max"), clean.alias("clean_count"), F.round(100.0 * clean / F.count(F.lit(1)), 4).alias("clean_pct"),
    )


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts with a column per value; 0 where there are none."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v)) for v in values])


def mean_differences(df: DataFrame, parameter: str = "parameter", source: str = "source", value: str = "value") -> DataFrame:
    """Means of each pair of sources and their difference in percent of the first."""
    m = df.where(F.col(source).isNotNull() & F.col(value).isNotNull()).groupBy(parameter, source).agg(F.avg(value).alias("m"))
    a = m.select(parameter, F.col(source).alias("source_1"), F.col("m").alias("m1"))
    b = m.select(parameter, F.col(source).alias("source_2"), F.col("m").alias("m2"))
    diff = F.abs(F.col("m1") - F.col("m2")) / F.greatest(F.abs("m1"), F.lit(1e-6)) * 100
    return a.join(b, parameter).where("source_1 < source_2").select(
        parameter, "source_1", "source_2", F.round("m1", 3).alias("mean_1"), F.round("m2", 3).alias("mean_2"), F.round(diff, 1).alias("diff_pct")
    )


def coverage(df: DataFrame, source: str, measures: list[str]) -> DataFrame:
    """(parameter, source, count, mean) of wide measures."""
    return df.unpivot([source], measures, "parameter", "v").groupBy("parameter", source).agg(F.count("v").alias("count"), F.round(F.avg("v"), 3).alias("mean"))


def compliance(df: DataFrame, standards: dict[str, tuple[float | None, float | None]]) -> DataFrame:
    """Violations of each standard (either end) and the percentage within it, one decimal."""
    present = {c: s for c, s in standards.items() if c in df.columns}
    bad = lambda c, s: F.coalesce((F.col(c) < s[0]) if s[0] is not None else F.lit(False), F.lit(False)) | F.coalesce((F.col(c) > s[1]) if s[1] is not None else F.lit(False), F.lit(False))
    rows = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).cast("double").alias("v"), bad(c, s).alias("bad")) for c, s in present.items()])
    long = df.select(F.explode(rows).alias("e")).select("e.*").where("v IS NOT NULL")
    return long.groupBy("measure").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("violations"), F.round(100.0 * F.count_if(~F.col("bad")) / F.count(F.lit(1)), 1).alias("compliance_pct")
    )


def skewness(value: str) -> Column:
    """Bias-corrected skewness; null below three values."""
    n = F.count(value).cast("double")
    return F.when(F.count(value) > 2, F.skewness(value) * F.sqrt(n * (n - 1)) / (n - 2))


def kurtosis(value: str) -> Column:
    """Bias-corrected excess kurtosis; null below four values."""
    n = F.count(value).cast("double")
    return F.when(F.count(value) > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(value) + 6))


def correlations(df: DataFrame, left: list[str], right: list[str], least: int = 30) -> DataFrame:
    """Pearson's r of each pair over the rows that have both; null below ``least`` rows."""
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    cells = [
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.count_if(both(a, b)).alias("n"), F.when(F.count_if(both(a, b)) >= least, F.corr(a, b)).alias("r"))
        for a in left for b in right
    ]
    return df.agg(F.array(*cells).alias("c")).select(F.explode("c").alias("c")).select("c.*")


def rank_correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Spearman's r: Pearson's r of the average ranks of the rows that have both.

    Ranks come from running sums of the counts of distinct values, so no task sorts all rows.
    """
    pair = df.where(F.col(a).isNotNull() & F.col(b).isNotNull())

    def ranks(c: str) -> DataFrame:
        counts = pair.groupBy(F.col(c).alias(f"_v{c}")).agg(F.count(F.lit(1)).alias("_c"))
        placed = order.running(counts, [f"_v{c}"], F.col("_c"), "_before")
        return placed.select(f"_v{c}", (F.col("_before") + (F.col("_c") + 1) / 2).alias(f"_r{c}"))

    ranked = pair.join(ranks(a), F.col(a) == F.col(f"_v{a}")).join(ranks(b), F.col(b) == F.col(f"_v{b}"))
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr(f"_r{a}", f"_r{b}").alias("rho"))


def correlated_columns(df: DataFrame, columns: list[str], limit: float = 0.95) -> list[str]:
    """Columns to drop: those correlated beyond ``limit`` with an earlier one."""
    pairs = [(a, b) for j, b in enumerate(columns) for a in columns[:j]]
    row = df.agg(*[F.abs(F.corr(a, b)).alias(f"{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [c for c in columns if any(b == c and (row[str(i)] or 0) > limit for i, (_, b) in enumerate(pairs))]


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, n): equal widths from the least to the greatest value, which is in the last bin."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    step = (F.col("_hi") - F.col("_lo")) / bins
    at = F.when(step == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("_lo")) / step), F.lit(bins - 1)))
    return df.where(F.col(value).isNotNull()).join(F.broadcast(ends)).groupBy(at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))  # one row


def box_numbers(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Least, quartiles and greatest of the values from p1 to p99 by key."""
    ends = order.percentiles(df, keys, value, [0.01, 0.99]).select(*keys, F.col("_q").alias("_e"))
    inside = df.join(ends, keys).where(F.col(value).between(F.col("_e")[0], F.col("_e")[1]))
    return describe_by(inside, keys, value, 6).select(*keys, "min", "p25", "median", "p75", "max")


def survival(raw: DataFrame, cleaned: DataFrame, key: str) -> DataFrame:
    """Rows before and after cleaning by key and the percentage left."""
    a, b = (d.groupBy(key).agg(F.count(F.lit(1)).alias(n)) for d, n in ((raw, "raw"), (cleaned, "cleaned")))
    kept = F.coalesce("cleaned", F.lit(0))
    return a.join(b, key, "left").select(key, "raw", kept.alias("cleaned"), F.round(100.0 * kept / F.col("raw"), 2).alias("pct"))


def integration_score(df: DataFrame, dimensions: dict[str, Column]) -> DataFrame:
    """Each dimension, from 0 to 100, and their mean."""
    capped = {n: F.least(F.greatest(c, F.lit(0.0)), F.lit(100.0)) for n, c in dimensions.items()}
    scored = df.agg(*[c.alias(n) for n, c in capped.items()])
    return scored.withColumn("overall", F.round(sum((F.col(n) for n in capped), F.lit(0.0)) / len(capped), 2))


def progress(done: DataFrame, totals: DataFrame, key: str = "job") -> DataFrame:
    """Jobs done by station, from keys like ``station_date``, beside the total (station, total)."""
    n = done.groupBy(F.split_part(F.col(key), F.lit("_"), F.lit(1)).alias("station")).agg(F.count(F.lit(1)).alias("done"))
    made = F.coalesce("done", F.lit(0))
    return totals.join(n, "station", "left").select("station", "total", made.alias("done"), F.round(100.0 * made / F.col("total"), 1).alias("pct"))


def modes(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """The most frequent value of each column by key, the least of equals."""
    return df.groupBy(*keys).agg(*[F.mode(c, True).alias(c) for c in columns])


def daily_means(df: DataFrame, keys: list[str], stamp: str, measures: list[str], firsts: list[str], by: str = "_seq") -> DataFrame:
    """Means to four decimals by key and day, and the first row's ``firsts``; rows without a key or time go."""
    whole = df.withColumn("date", F.to_date(stamp)).where(F.col("date").isNotNull()).dropna(subset=keys)
    row = F.min_by(F.struct(*firsts), by).alias("_f") if firsts else F.lit(None).alias("_f")
    out = whole.groupBy(*keys, "date").agg(row, *[F.round(F.avg(m), 4).alias(m) for m in measures])
    return out.select(*keys, "date", *[F.col(f"_f.{c}").alias(c) for c in firsts], *measures)


def pair_consistency(df: DataFrame, part: str, whole: str) -> DataFrame:
    """Rows that have both, those whose ``part`` is at most the ``whole``, and their percentage."""
    both = df.where(F.col(part).isNotNull() & F.col(whole).isNotNull())
    fits = F.count_if(F.col(part) <= F.col(whole))
    return both.agg(F.count(F.lit(1)).alias("n"), fits.alias("consistent"), F.round(100.0 * fits / F.nullif(F.count(F.lit(1)), F.lit(0)), 4).cast("double").alias("pct"))


def extents(df: DataFrame, keys: list[str], distinct: list[str], ends: list[str]) -> DataFrame:
    """Rows, distinct counts, least and greatest values by key."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(f"n_{c}") for c in distinct], *[f(c).alias(f"{n}_{c}") for c in ends for n, f in (("min", F.min), ("max", F.max))]
    )


def missing_matrix(df: DataFrame, keys: list[str], columns: list[str], digits: int = 4) -> DataFrame:
    """The percentage of nulls of each column by key."""
    return df.groupBy(*keys).agg(*[F.round(100.0 * F.avg(F.col(c).isNull().cast("int")), digits).alias(c) for c in columns])


def mean_matrix(df: DataFrame, row: str, column: str, values: list, measure: str, digits: int = 4) -> DataFrame:
    """Mean and count of a measure with a pair of columns per value of ``column``."""
    of = lambda v: F.when(F.col(column) == v, F.col(measure))
    cells = [c for v in values for c in (F.round(F.avg(of(v)), digits).alias(f"mean_{v}"), F.count(of(v)).alias(f"n_{v}"))]
    return df.groupBy(row).agg(*cells)


def covered_measures(df: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Rows by key and how many of the measures have any value."""
    any_ = sum((F.max(F.col(m).isNotNull().cast("int")) for m in measures), F.lit(0))
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), any_.alias("measures"))


def station_map(df: DataFrame, keys: list[str], date: str, measures: list[str]) -> DataFrame:
    """Rows, first and last day and means to two decimals by place; rows with a null key go."""
    return df.dropna(subset=keys).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min(date).alias("first"), F.max(date).alias("last"), *[F.round(F.avg(m), 2).alias(m) for m in measures]
    )


def band_summary(bands: DataFrame, least: int = 10_000) -> DataFrame:
    """Statistics of bands by file with ``low_count``: fewer pixels than ``least``."""
    return bands.withColumn("low_count", F.col("count") < least)


def file_summary(summary: DataFrame, bands: list[str]) -> DataFrame:
    """By file the median of each band, all pixels, and whether any band has a low count."""
    return summary.groupBy("file").agg(
        *[F.first(F.when(F.col("band") == b, F.col("p50")), ignorenulls=True).alias(b) for b in bands],
        F.sum("count").alias("total_valid_pixels"), F.bool_or("low_count").alias("any_low_count"),
    )
