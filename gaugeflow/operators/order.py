"""Exact order statistics, running sums and row numbers of groups that no single task has to sort.

A statistic is found in three aggregates: a sketch of bounded size brackets the
place, the values before the bracket are counted, and only the distinct values
inside it, a small part of the rows, are sorted.  The sketch narrows the search;
it never decides a result.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.scratch import materialize

#: Relative accuracy of the sketch, and the share of rows on either side of a place that its bracket holds.
ACCURACY = 20_000
MARGIN = 5 / ACCURACY

#: A share of the sorted values, and the places from 0 near it that are wanted, as functions of their number.
Wanted = tuple[float, list[Callable[[Column], Column]]]


def _same(names: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names])


def _beside(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what is known of their group; null keys are equal."""
    if not keys:
        return df.join(F.broadcast(groups))  # one row
    rest = [F.col(f"g.{c}") for c in groups.columns if c not in keys]
    return df.alias("r").join(groups.alias("g"), _same(keys, "r", "g")).select("r.*", *rest)


def order_statistics(df: DataFrame, keys: list[str], value: str, wanted: list[Wanted]) -> DataFrame:
    """(keys, _n, _s): by group the number of values that aren't null and, per ``wanted``, an array of those at its places."""
    names = [f"_k{i}" for i in range(len(keys))]
    rows = df.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col(value).cast("double").alias("_v")).where("_v IS NOT NULL")
    ends = [min(1.0, max(0.0, share + side)) for share, _ in wanted for side in (-MARGIN, MARGIN)]
    groups = rows.groupBy(*names).agg(F.count(F.lit(1)).alias("_n"), F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    if not keys:
        groups = groups.where("_n > 0")
    both = _beside(rows, groups, names)
    v, low, high = F.col("_v"), lambda i: F.col("_b")[2 * i], lambda i: F.col("_b")[2 * i + 1]
    edges = both.groupBy(*names, "_n").agg(
        *[F.count_if(v < low(i)).alias(f"_below{i}") for i in range(len(wanted))],
        *[F.max(F.when(v < low(i), v)).alias(f"_before{i}") for i in range(len(wanted))],
        *[F.min(F.when(v > high(i), v)).alias(f"_after{i}") for i in range(len(wanted))],
    )
    at = F.filter(F.array(*[F.when(v.between(low(i), high(i)), i) for i in range(len(wanted))]), lambda x: x.isNotNull())
    inside = both.where(F.size(at) > 0).select(*names, F.explode(at).alias("_i"), "_v").groupBy(*names, "_i", "_v").agg(F.count(F.lit(1)).alias("_c"))
    up_to = Window.partitionBy(*names, "_i").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = _beside(inside.withColumn("_to", F.sum("_c").over(up_to)), edges, names)

    def found(i: int, place: Column) -> Column:
        """Of share ``i`` the value at ``place``."""
        below = F.col(f"_below{i}")
        held = F.max(F.when(F.col("_i") == i, F.col("_to")))
        first = F.min(F.when((F.col("_i") == i) & (below + F.col("_to") > place), v))
        astray = (place < below - 1) | (place > below + held)
        return (
            F.when(astray, F.raise_error(F.lit("a place lies outside the sketch's bracket")).cast("double"))
            .when(place < below, F.col(f"_before{i}"))
            .when(place >= below + held, F.col(f"_after{i}"))
            .otherwise(first)
        )

    n = F.col("_n")
    by = [*names, "_n", *[f"_{w}{i}" for w in ("below", "before", "after") for i in range(len(wanted))]]
    statistics = F.array(*[F.array(*[found(i, p(n)) for p in places]) for i, (_, places) in enumerate(wanted)])
    return placed.groupBy(*by).agg(statistics.alias("_s")).select(*[F.col(a).alias(k) for k, a in zip(keys, names)], "_n", "_s")


def percentiles(df: DataFrame, keys: list[str], value: str, shares: list[float]) -> DataFrame:
    """(keys, _n, _q): by group the number of values and an array of percentiles, between neighbours where needed."""
    place = lambda s: lambda n: (n - 1) * F.lit(float(s))
    wanted = [(s, [lambda n, s=s: F.floor(place(s)(n)), lambda n, s=s: F.ceil(place(s)(n))]) for s in shares]

    def between(i: int, s: float) -> Column:
        low, high = F.col("_s")[i][0], F.col("_s")[i][1]
        return low + (high - low) * (place(s)(F.col("_n")) - F.floor(place(s)(F.col("_n"))))

    found = order_statistics(df, keys, value, wanted)
    return found.select(*keys, "_n", F.array(*[between(i, s) for i, s in enumerate(shares)]).alias("_q"))


def column_percentiles(df: DataFrame, columns: list[str], shares: list[float]) -> DataFrame:
    """One row: for each column a struct (n, q) of its values and their percentiles."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "_c", "_v")
    q = percentiles(long, ["_c"], "_v", shares)
    of = lambda c: F.max(F.when(F.col("_c") == c, F.struct(F.col("_n").alias("n"), F.col("_q").alias("q"))))
    return q.agg(*[of(c).alias(c) for c in columns])


def running(df: DataFrame, order: list[str] | list[Column], amount: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``amount`` over the rows before each in ``order``.

    The rows are stored in ranges of the order, a row of totals per range is
    summed up, and a task sums up within a range.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.withColumn("_amount", amount).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    rows = materialize(ranged, "ranges")
    before = Window.partitionBy().orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_part").agg(F.sum("_amount").alias("_total"))  # a row per range
    totals = totals.select("_part", F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_offset"))
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = F.col("_offset") + F.coalesce(F.sum("_amount").over(within), F.lit(0))
    return rows.join(F.broadcast(totals), "_part").withColumn(name, sums).drop("_part", "_amount", "_offset")


def numbered(df: DataFrame, order: list[str] | list[Column], name: str) -> DataFrame:
    """``df`` with each row's place in ``order``, from 0."""
    return running(df, order, F.lit(1).cast("long"), name)
