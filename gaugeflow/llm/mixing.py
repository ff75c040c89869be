"""Mixing sources to target weights by systematic sampling.

Every source gets a target number of words; each of its documents is expected in
``target / source_size`` copies.  The expected copies are prefix-summed over the
source in an order of growing size, one offset in [0, 1) is added, and a document
is emitted once for each integer the running sum crosses.  Since a source's
documents expect the same number of copies, the prefix sum is the document's rank
times that number, and the rank comes from counts of small buckets, summed in two
levels: no task ever holds a whole source.

Defined results: a null text has size 0; a null source is a source of its own and
sorts last; a source without words takes nothing; rows that repeat are separate
documents, those of one id in the order of a hash of their texts; an empty table
gives an empty result.  Columns of the input are kept and may have any names but
those that begin with ``__mix_``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gaugeflow.llm.runtime import materialize

WORD = r"[^\x20\x09-\x0D]+"
#: Ranks are counted per bucket; a size's bucket is split in so many parts.
PARTS = 256


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def size_bin(size: Column) -> Column:
    """A whole number that never falls as ``size`` grows: 32 steps to a power of two."""
    bits = F.length(F.bin(size))
    return F.when(size < 64, size).otherwise(
        32 * bits.cast("long") + F.floor(size / F.pow(F.lit(2.0), (bits - 6).cast("double"))).cast("long")
    )


def source_targets(
    sums: DataFrame, weights: Sequence[float], share: float, max_repeat: float
) -> DataFrame:
    """Targets for a table (__mix_key, __mix_source, source_size), one row a source.

    ``share`` times all words are dealt by weight; a target stops at
    ``max_repeat`` times its source's size and the excess is dealt again among
    the others.  The fixed point is ``min(cap, level * weight)``; the level comes
    from running sums over the sources in order of cap per weight.
    """
    order = Window.partitionBy().orderBy(F.col("__mix_source").asc_nulls_last())
    position = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (position + 1).cast("int"))
    everything = Window.partitionBy()
    filled = sums.withColumn("__mix_weight", weight).withColumn(
        "__mix_cap", F.col("source_size").cast("double") * F.lit(float(max_repeat))
    )
    by_ratio = Window.partitionBy().orderBy(
        F.col("__mix_cap") / F.col("__mix_weight"), F.col("__mix_source").asc_nulls_last()
    )
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        filled.withColumn("__mix_place", F.row_number().over(by_ratio))
        .withColumn("__mix_total", F.sum("source_size").over(everything).cast("double") * F.lit(float(share)))
        .withColumn("__mix_full", F.coalesce(F.sum("__mix_cap").over(before), F.lit(0.0)))
        .withColumn(
            "__mix_rest",
            F.sum("__mix_weight").over(everything) - F.coalesce(F.sum("__mix_weight").over(before), F.lit(0.0)),
        )
        .withColumn("__mix_level", (F.col("__mix_total") - F.col("__mix_full")) / F.col("__mix_rest"))
    )
    fits = F.col("__mix_level") * F.col("__mix_weight") <= F.col("__mix_cap")
    filled = filled.withColumn("__mix_first", F.min(F.when(fits, F.col("__mix_place"))).over(everything)).withColumn(
        "__mix_chosen",
        F.max(F.when(F.col("__mix_place") == F.col("__mix_first"), F.col("__mix_level"))).over(everything),
    )
    target = F.when(
        F.col("__mix_first").isNull() | (F.col("__mix_place") < F.col("__mix_first")), F.col("__mix_cap")
    ).otherwise(F.col("__mix_chosen") * F.col("__mix_weight"))
    return filled.select("__mix_key", "source_size", target.alias("target"))


def _bits(text: Column, digits: int) -> Column:
    """The first hexadecimal digits of a text's digest as a number."""
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("long")


def _keyed(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """``docs`` with the size, the bucket of each row and a hash that orders rows of one id."""
    return docs.withColumns(
        {
            "__mix_key": F.when(F.col(source_col).isNull(), "n").otherwise(F.concat(F.lit("s"), F.col(source_col))),
            "__mix_size": word_count(F.col(text_col)),
            "__mix_hash": F.xxhash64(F.col(text_col)),
        }
    ).withColumns(
        {
            "__mix_bin": size_bin(F.col("__mix_size")),
            "__mix_part": _bits(F.coalesce(F.col(id_col).cast("string"), F.lit("")), 2) % PARTS,
        }
    )


def _planned(
    keyed: DataFrame,
    *,
    id_col: str = "doc_id",
    weights: Sequence[float] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    max_repeat: float = 2.0,
    seed: str = "mix",
) -> DataFrame:
    """The rows of ``_keyed`` with ``__mix_source_size``, ``__mix_target`` and ``__mix_copies``.

    The same input and seed give the same copies.
    """
    counts = materialize(
        keyed.groupBy("__mix_key", "__mix_bin", "__mix_part").agg(
            F.count(F.lit(1)).alias("__mix_n"), F.sum("__mix_size").alias("__mix_words")
        ),
        "mix-counts",
    )
    sums = (
        counts.groupBy("__mix_key")
        .agg(F.sum("__mix_words").alias("source_size"))
        .withColumn("__mix_source", F.when(F.col("__mix_key") != "n", F.expr("substr(__mix_key, 2)")))
    )
    targets = source_targets(sums, weights, share, max_repeat)
    key, bucket = ["__mix_key", "__mix_bin"], ["__mix_key", "__mix_bin", "__mix_part"]
    running = lambda keys, by, c: F.coalesce(
        F.sum(c).over(Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    # a source has some hundred bins, a bin PARTS parts
    bins = counts.groupBy(*key).agg(F.sum("__mix_n").alias("__mix_n"))
    bins = bins.select(*key, running(["__mix_key"], "__mix_bin", "__mix_n").alias("__mix_below"))
    offsets = (
        counts.withColumn("__mix_within", running(key, "__mix_part", "__mix_n"))
        .join(bins, key)
        .join(targets, "__mix_key")
        .select(
            *bucket,
            (F.col("__mix_below") + F.col("__mix_within")).alias("__mix_before"),
            F.col("source_size").alias("__mix_source_size"),
            F.col("target").alias("__mix_target"),
        )
    )
    within = Window.partitionBy(*bucket).orderBy("__mix_size", F.col(id_col), "__mix_hash")
    copies = F.when(F.col("__mix_source_size") > 0, F.col("__mix_target") / F.col("__mix_source_size")).otherwise(0.0)
    offset = _bits(F.concat(F.lit(seed + ":"), F.col("__mix_key")), 8).cast("double") / F.lit(4294967296.0)
    rank = F.col("__mix_before") + F.row_number().over(within) - 1
    crossed = lambda k: F.floor(offset + copies * k.cast("double"))
    return (
        keyed.join(offsets, bucket)
        .withColumn("__mix_rank", rank)
        .withColumn("__mix_copies", (crossed(F.col("__mix_rank") + 1) - crossed(F.col("__mix_rank"))).cast("long"))
    )


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture: each row of ``docs`` once per copy, with the columns of ``docs``."""
    plan = _planned(_keyed(docs, id_col, text_col, source_col), id_col=id_col, **options).where("__mix_copies > 0")
    return plan.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )


def mix_report(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target and taken, the words of its copies.

    Texts are read once; all else is done on a stored table of their sizes.
    """
    keyed = _keyed(docs, id_col, text_col, source_col)
    light = keyed.select(F.col(id_col).alias("doc_id"), "__mix_key", "__mix_size", "__mix_hash", "__mix_bin", "__mix_part")
    return _planned(materialize(light, "mix-sizes"), id_col="doc_id", **options).select(
        "doc_id",
        F.col("__mix_size").alias("size"),
        F.col("__mix_source_size").alias("source_size"),
        F.col("__mix_target").alias("target"),
        (F.col("__mix_copies") * F.col("__mix_size")).alias("taken"),
    )
