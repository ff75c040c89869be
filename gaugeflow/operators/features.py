"""Cleaning for training, features, folds, metrics."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import dates, geo, spectral
from gaugeflow.operators import order

TARGETS = list(schema.TARGET_BOUNDS)
#: Incomplete rows of a block of the imputation, and pairs of rows compared at once.
QUERIES, PAIRS = 8192, 1 << 20


def sentinels_to_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values of -900 and less, NaN and infinities become null."""
    fine = lambda c: ~F.isnan(c) & (F.col(c) > -900) & (F.col(c) < float("inf"))
    return df.withColumns({c: F.when(fine(c), F.col(c)) for c in columns})


def winsorize(df: DataFrame, columns: list[str], low: float = 0.02, high: float = 0.98, least: int = 100) -> DataFrame:
    """Clip columns of more than ``least`` values to their percentiles."""
    found = order.column_percentiles(df, columns, [low, high])
    ends = found.select(*[F.when(F.col(f"{c}.n") > least, F.col(f"{c}.q")).alias(f"_e_{c}") for c in columns])
    joined = df.join(F.broadcast(ends))  # one row
    clip = lambda c: F.when(F.col(c).isNull() | F.col(f"_e_{c}").isNull(), F.col(c)).otherwise(
        F.least(F.greatest(F.col(c), F.col(f"_e_{c}")[0]), F.col(f"_e_{c}")[1])
    )
    return joined.withColumns({c: clip(c) for c in columns}).drop(*[f"_e_{c}" for c in columns])


def complete_rows(df: DataFrame, columns: list[str], least: int = 8) -> DataFrame:
    """Rows with at least ``least`` of ``columns``."""
    return df.where(sum((F.col(c).isNotNull().cast("int") for c in columns), F.lit(0)) >= least)


def mean_by_observation(df: DataFrame, keys: list[str], means: list[str], firsts: list[str], by: str = "_seq") -> DataFrame:
    """Means of targets and the first value of other columns by key; rows with a null key go."""
    whole = df.where(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col(by)))
    return whole.groupBy(*keys).agg(*[F.avg(c).alias(c) for c in means], *[first(c).alias(c) for c in firsts])


def clean_for_training(df: DataFrame, targets: list[str] = TARGETS, keys: list[str] | None = None) -> DataFrame:
    """Sentinels, bounds, percentiles, completeness and means by imagery observation."""
    from gaugeflow.operators.quality import clip_bounds

    bounds = {c: schema.TARGET_BOUNDS[c] for c in targets}
    df = complete_rows(winsorize(clip_bounds(sentinels_to_null(df, targets), bounds), targets), targets, min(8, len(targets)))
    keys = keys or ["stationId", *schema.BANDS]
    firsts = [c for c in df.columns if c not in keys and c not in targets and c != "_seq"]
    return mean_by_observation(df, keys, targets, firsts)


def _nearest(x: np.ndarray, given: np.ndarray, k: int) -> list[list[dict]]:
    """For each row of ``x`` the ``k`` nearest of ``given`` for each of its missing columns, ties by value."""
    out: list[list[dict]] = [[] for _ in x]
    there, width = ~np.isnan(given), x.shape[1]
    # per column the rows that have it, in order of its values
    able = [np.flatnonzero(t)[np.argsort(g[t], kind="stable")] for t, g in zip(there.T, given.T, strict=True)]
    step = max(1, PAIRS // max(len(given), 1))
    for at in range(0, len(x), step):
        rows = x[at : at + step]
        has = ~np.isnan(rows)
        gap, n = np.zeros((len(rows), len(given))), np.zeros((len(rows), len(given)), np.int32)
        # column by column, so that a pair's distance doesn't depend on its block
        for c in range(width):
            common = has[:, c, None] & there[:, c]
            gap += np.where(common, rows[:, c, None] - given[:, c], 0.0) ** 2
            n += common
        far = np.where(n > 0, gap * width / np.maximum(n, 1), np.inf)
        for c in range(width):
            lacking = np.flatnonzero(~has[:, c])
            if not len(lacking) or not len(able[c]):
                continue
            distance = far[np.ix_(lacking, able[c])]
            m = min(k, distance.shape[1])
            bound = np.partition(distance, m - 1, axis=1)[:, m - 1]
            for r, d, most in zip(lacking.tolist(), distance, bound, strict=True):
                near = np.flatnonzero((d <= most) & (d < np.inf))
                near = near[np.argsort(d[near], kind="stable")[:k]]
                values = given[able[c][near], c]
                out[at + r] += [{"c": c, "far": f, "value": v} for f, v in zip(d[near].tolist(), values.tolist(), strict=True)]
    return out


def knn_impute(df: DataFrame, columns: list[str], k: int = 5, donors: int = 20_000) -> DataFrame:
    """Fill nulls with the mean of the ``k`` nearest rows that have the column.

    Distances are over the columns both rows have, scaled to all of them; of
    equal distances lesser values come first.  Incomplete rows are compared with
    all rows: both are dealt into blocks, of about ``donors`` distinct rows and
    ``QUERIES`` incomplete ones, a task compares two blocks, and the nearest of
    all blocks are merged.  Rows without the column or a common one don't count;
    without any the mean of the whole column is used.
    """
    given = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    values = [given(c).alias(f"v{i}") for i, c in enumerate(columns)]
    names = [f"v{i}" for i in range(len(columns))]
    whole = reduce(lambda a, b: a & b, [given(c).isNotNull() for c in columns])
    # what repeats beyond k can't be nearest
    pool = df.select(*values).where(F.coalesce(*names).isNotNull()).groupBy(*names)
    pool = pool.agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    counts = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(~whole).alias("lacking"), *[F.avg(given(c)).alias(f"m{i}") for i, c in enumerate(columns)]).first()
    slices = max(1, -(-counts.n // donors))
    blocks = max(1, -(-counts.lacking // QUERIES))
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    asked = df.where(~whole).select(F.monotonically_increasing_id().alias("id"), row.alias("row"), *values)
    asked = asked.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    asked = asked.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    # a row itself goes to one task, so that it comes back once, with its neighbours
    asked = asked.withColumn("row", F.when(F.col("slice") == 0, F.col("row")))
    dealt = pool.withColumn("slice", F.pmod(F.xxhash64(*names), F.lit(slices)).cast("int"))
    dealt = dealt.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    best = pa.list_(pa.struct([("c", pa.int32()), ("far", pa.float64()), ("value", pa.float64())]))

    def matrix(table: pa.Table) -> np.ndarray:
        columns_ = [table.column(n).to_pandas().to_numpy(float, na_value=np.nan) for n in names]
        return np.stack(columns_, 1)

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        known = np.repeat(matrix(right), right.column("times").to_numpy().astype(int), axis=0) if len(right) else np.empty((0, len(names)))
        found = pa.array(_nearest(matrix(left), known, k) if len(left) else [], best)
        return pa.table({"id": left.column("id"), "row": left.column("row"), "best": found})

    shape = f"id long, row {asked.schema['row'].dataType.simpleString()}, best array<struct<c:int,far:double,value:double>>"
    near = asked.groupBy("block", "slice").cogroup(dealt.groupBy("block", "slice")).applyInArrow(compare, shape)
    near = near.groupBy("id").agg(F.first("row", ignorenulls=True).alias("row"), F.flatten(F.collect_list("best")).alias("best"))

    def filled(i: int, c: str) -> Column:
        # structs are ordered by distance, then value
        least = F.slice(F.array_sort(F.filter("best", lambda b: b.c == i)), 1, k)
        mean = F.aggregate(least, F.lit(0.0), lambda total, b: total + b.value) / F.nullif(F.size(least), F.lit(0))
        own = F.col("row").getField(c)
        return F.when(own.isNull() | F.isnan(own.cast("double")), F.coalesce(mean, F.lit(counts[f"m{i}"]).cast("double"))).otherwise(own)

    place = {c: i for i, c in enumerate(columns)}
    imputed = near.select(*[(filled(place[c], c) if c in place else F.col("row").getField(c)).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    return df.where(whole).unionByName(imputed)


def standardize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Mean 0 and population deviation 1 (plus 1e-8)."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_s_{c}") for c in columns])
    z = lambda c: (F.col(c) - F.col(f"_s_{c}.m")) / (F.col(f"_s_{c}.s") + 1e-8)
    return df.join(F.broadcast(stats)).withColumns({c: z(c) for c in columns}).drop(*[f"_s_{c}" for c in columns])  # one row


def log_target(value: Column) -> Column:
    return F.log1p(value)


def from_log(mean: Column, deviation: Column) -> tuple[Column, Column]:
    """Value and uncertainty back from the logarithm (delta method)."""
    return F.expm1(mean), deviation * F.exp(mean)


def interval(mean: Column, deviation: Column) -> tuple[Column, Column]:
    return mean - 1.96 * deviation, mean + 1.96 * deviation


def ensemble_interval(predictions: Column) -> Column:
    """p5 and p95 of an array of predictions, between neighbours where needed."""
    ordered = F.array_sort(predictions)

    def at(share: float) -> Column:
        place = (F.size(ordered) - 1) * F.lit(share)
        low = F.element_at(ordered, (F.floor(place) + 1).cast("int"))
        high = F.element_at(ordered, (F.ceil(place) + 1).cast("int"))
        return low + (high - low) * (place - F.floor(place))

    return F.struct(at(0.05).alias("low"), at(0.95).alias("high"))


def group_folds(df: DataFrame, group: str, k: int) -> DataFrame:
    """(group, fold): groups in order of size, each to the fold with the fewest rows.

    Only the groups' sizes, of which there are as many as stations, reach the driver.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), group).collect()
    load, rows = [0] * k, []
    for r in sizes:
        fold = load.index(min(load))
        load[fold] += r["n"]
        rows.append((r[group], fold))
    return df.sparkSession.createDataFrame(rows, f"{group} {df.schema[group].dataType.simpleString()}, fold int")


def hash_folds(key: Column, k: int, seed: int = 42) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), key), F.lit(k)).cast("int")


def temporal_split(df: DataFrame, date: str, until: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(date) <= F.lit(until).cast("date"), "train").otherwise("test"))


def ordered_split(df: DataFrame, by: list[str], share: float = 0.8) -> DataFrame:
    """The first rows in the order ``by`` are for training, the others for testing."""
    placed = order.numbered(df, by, "_place")
    cut = placed.agg(F.floor(F.count(F.lit(1)) * F.lit(share)).alias("_cut"))
    return placed.join(F.broadcast(cut)).withColumn("split", F.when(F.col("_place") < F.col("_cut"), "train").otherwise("test")).drop("_place", "_cut")  # one row


def label_codes(df: DataFrame, column: str, code: str) -> DataFrame:
    """The place of each distinct value in their order, from 0."""
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    coded = order.numbered(values, [column], code).withColumn(code, F.col(code).cast("int"))
    return df.join(coded, column, "left")


def quantile_bins(df: DataFrame, column: str, labels: tuple[str, ...] = ("VL", "L", "M", "H", "VH")) -> DataFrame:
    """Bins of equal shares by percentile edges; a value on an edge is in the lower bin."""
    edges = order.percentiles(df, [], column, [i / len(labels) for i in range(1, len(labels))]).select(F.col("_q").alias("_e"))
    bin_ = F.lit(labels[-1])
    for i in reversed(range(len(labels) - 1)):
        bin_ = F.when(F.col(column) <= F.col("_e")[i], labels[i]).otherwise(bin_)
    return df.join(F.broadcast(edges), how="left").withColumn(f"{column}_bin", F.when(F.col(column).isNotNull(), bin_)).drop("_e")  # one row


def conditional_shares(df: DataFrame, child: str, parents: list[str]) -> DataFrame:
    """P(child | parents) from counts."""
    n = df.groupBy(*parents, child).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy(*parents)))


def regression_metrics(df: DataFrame, keys: list[str], truth: str, predicted: str, least: int = 10) -> DataFrame:
    """R2, RMSE and MAE by key; keys of fewer than ``least`` rows go.

    The total sum of squares is the population variance times the count, so one pass suffices.
    """
    e = F.col(truth) - F.col(predicted)
    rows = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull())
    one = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum(e * e).alias("_sse"), F.var_pop(truth).alias("_var"), F.avg(F.abs(e)).alias("mae")
    )
    r2 = F.when(F.col("_var") > 0, 1 - F.col("_sse") / (F.col("_var") * F.col("n")))
    return one.where(F.col("n") >= least).select(*keys, "n", r2.alias("r2"), F.sqrt(F.col("_sse") / F.col("n")).alias("rmse"), "mae")


def best_by(df: DataFrame, keys: list[str], model: str, score: str) -> DataFrame:
    """The model of greatest score by key, the first by name of equals; rows without a score don't count."""
    scored = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    best = F.min(F.struct((-F.col(score)).alias("s"), F.col(model).alias("m"))).alias("_b")
    return scored.groupBy(*keys).agg(best).select(*keys, F.col("_b.m").alias(model), (-F.col("_b.s")).alias(score))


def anomaly_ratio(df: DataFrame, station: str, season: str, value: str) -> Column:
    """A value by its station's mean of the season; 1 where the mean is missing or next to 0."""
    mean = F.avg(value).over(Window.partitionBy(station, season))
    return F.when((mean > 0.01) & F.col(value).isNotNull(), F.col(value) / mean).otherwise(1.0)


def feature_vector(df: DataFrame) -> DataFrame:
    """Indices, ratios, cyclic month, season and distance from columns of bands, lat, lon and date."""
    bands = {b: F.col(b) for b in schema.BANDS}
    month = F.month("date")
    sine, cosine = dates.month_cycle(month)
    extra = {"month_sin": sine, "month_cos": cosine, "season": dates.season_code(month), "region": geo.region(F.col("lon"))}
    extra["dist_from_source_km"] = geo.distance_from_source_km(F.col("lat"), F.col("lon"))
    return df.withColumns({**spectral.indices(bands), **spectral.band_ratios(bands), **extra})


def channel_stats(df: DataFrame, array: str) -> DataFrame:
    """Mean and population deviation (at least 1e-6) of each place of an array column."""
    long = df.select(F.posexplode(array).alias("channel", "v"))
    deviation = F.sqrt(F.greatest(F.avg(F.col("v").cast("double") * F.col("v")) - F.pow(F.avg(F.col("v").cast("double")), F.lit(2.0)), F.lit(0.0)))
    return long.groupBy("channel").agg(F.avg(F.col("v").cast("double")).alias("mean"), F.greatest(deviation, F.lit(1e-6)).alias("std"))


def trimming_simulation(df: DataFrame, targets: list[str], levels: dict[str, tuple[float, float]], keys: list[str], least: int = 8) -> DataFrame:
    """Percentage of rows that keep ``least`` targets when each is trimmed to the percentiles of a level."""
    shares = sorted({s for pair in levels.values() for s in pair})
    found = order.column_percentiles(df, targets, shares)
    q = found.select(*[F.col(f"{t}.q").alias(f"_q_{t}") for t in targets])
    joined = df.join(F.broadcast(q))  # one row
    inside = lambda t, lo, hi: F.col(t).between(F.col(f"_q_{t}")[shares.index(lo)], F.col(f"_q_{t}")[shares.index(hi)])
    kept = lambda lo, hi: sum((F.coalesce(inside(t, lo, hi).cast("int"), F.lit(0)) for t in targets), F.lit(0)) >= least
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("level"), kept(*b).alias("kept")) for n, b in levels.items()])).alias("e")
    long = joined.select(*keys, rows).select(*keys, "e.level", "e.kept")
    return long.groupBy("level", *keys).agg(F.count(F.lit(1)).alias("n"), F.round(100.0 * F.avg(F.col("kept").cast("int")), 4).alias("kept_pct"))
