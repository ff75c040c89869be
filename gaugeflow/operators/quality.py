"""Quality control of long observations: bounds, outliers, consistency, fusion, conflicts.

The record rules reject or penalise and keep one winner; the canonical rules flag
and keep all.  Frames need the columns the rules name; ``_seq``, the order of
ingestion, breaks ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.functions import geo, text
from gaugeflow.operators import order
from gaugeflow.operators.lookup import canonical_bounds, first_of_key, record_bounds, trust_of

# Words that place a station in the basin.
BASIN_WORDS = [
    "ganga", "ganges", "yamuna", "gomti", "ghaghra", "gandak", "kosi", "son ", "damodar", "hooghly", "ramganga",
    "hindon", "varuna",
]


# --- record rules -----------------------------------------------------------


def standardize(df: DataFrame) -> DataFrame:
    """Known parameters with a number; unit, state, date and year filled; one source kept to the basin."""
    value = F.col("value").try_cast("double")
    station, state = F.lower(F.coalesce("station_name", F.lit(""))), text.state_name(F.coalesce("state", F.lit("")))
    in_basin = state.isin(schema.BASIN_STATES) | (text.keyword_hits(station, BASIN_WORDS) > 0)
    date = F.coalesce(F.col("date"), F.make_date(F.col("year").cast("int"), F.lit(1), F.lit(1)))
    return (
        df.where(F.col("parameter").isin(list(schema.RECORD_PARAMETERS)) & value.isNotNull() & ~F.isnan(value))
        .where((F.coalesce("source", F.lit("")) != "nwmp_pdf") | in_basin)
        .withColumns(
            {
                "value": value,
                "unit": text.default_unit(F.col("parameter")),
                "state": state,
                "date": date,
                "year": F.coalesce(F.col("year").cast("int"), F.year(date)),
            }
        )
    )


def spatial_filter(df: DataFrame, box: tuple[float, float, float, float] = schema.BASIN_BOX) -> DataFrame:
    """Rows in the box and rows without coordinates."""
    inside = geo.in_box(F.col("latitude"), F.col("longitude"), box)
    return df.where(F.col("latitude").isNull() | F.col("longitude").isNull() | inside)


def range_check(df: DataFrame, bounds: DataFrame | None = None, trust: dict[str, float] | None = None) -> DataFrame:
    """Reject values out of bounds; trust by source, less at the ends of the range; flag valid."""
    bounds = record_bounds(df.sparkSession) if bounds is None else bounds
    trust = schema.RECORD_TRUST if trust is None else trust
    value, spread = F.col("value"), (F.col("hi") - F.col("lo")) / 2
    far = (spread > 0) & (F.abs(value - (F.col("lo") + F.col("hi")) / 2) / spread > 0.9)
    return (
        df.join(F.broadcast(bounds), "parameter", "left")  # a fixed table of rules
        .where(F.col("lo").isNull() | value.between(F.col("lo"), F.col("hi")))
        .where((value >= 0) | (F.col("parameter") == "temperature"))
        .withColumns(
            {
                "quality_flag": F.lit(schema.VALID),
                "trust_score": F.round(
                    trust_of(F.col("source"), trust) * F.when(F.coalesce(far, F.lit(False)), 0.7).otherwise(1.0), 3
                ),
            }
        )
        .drop("lo", "hi")
    )


def quartiles(df: DataFrame, group: str = "parameter", value: str = "value", least: int = 20) -> DataFrame:
    """(group, lower, upper): fences three times the range of the positional quartiles.

    The quartiles are the values at positions n // 4 and 3n // 4 of the sorted
    group.  Groups of fewer than ``least`` rows or without range have none.
    """
    at = lambda k: (k / 4, [lambda n: F.floor(n * k / 4)])
    found = order.order_statistics(df, [group], value, [at(1), at(3)])
    q = found.select(group, "_n", F.col("_s")[0][0].alias("q1"), F.col("_s")[1][0].alias("q3"))
    q = q.where((F.col("_n") >= least) & (F.col("q3") != F.col("q1")))
    iqr = F.col("q3") - F.col("q1")
    return q.select(group, (F.col("q1") - 3 * iqr).alias("lower"), (F.col("q3") + 3 * iqr).alias("upper"))


def flag_outliers(df: DataFrame) -> DataFrame:
    """Flag values beyond the fences of their parameter and halve their trust."""
    joined = df.join(quartiles(df), "parameter", "left")
    out = (F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper"))
    return joined.withColumns(
        {
            "quality_flag": F.when(out, schema.SUSPECT_OUTLIER).otherwise(F.col("quality_flag")),
            "trust_score": F.when(out, F.col("trust_score") * 0.5).otherwise(F.col("trust_score")),
        }
    ).drop("lower", "upper")


def _last_values(df: DataFrame, keys: list[str], parameters: list[str]) -> DataFrame:
    """The last value of each parameter by key."""
    last = lambda p: F.max_by(F.when(F.col("parameter") == p, F.col("value")), F.when(F.col("parameter") == p, F.col("_seq")))
    return df.where(F.col("parameter").isin(parameters)).groupBy(*keys).agg(*[last(p).alias(f"_{p}") for p in parameters])


def _null_safe(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Left join that takes null keys as equal."""
    renamed = other.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in other.columns if c not in keys])
    match = None
    for k in keys:
        one = df[k].eqNullSafe(renamed[f"_k_{k}"])
        match = one if match is None else match & one
    return df.join(renamed, match, "left").drop(*[f"_k_{k}" for k in keys])


def flag_inconsistent(df: DataFrame) -> DataFrame:
    """Flag all valid rows of a station and date where BOD exceeds twice COD or TDS doesn't fit conductivity."""
    keys = ["station_name", "date"]
    last = _last_values(df, keys, ["bod", "cod", "tds", "conductivity"])
    ratio = F.when(F.col("_conductivity") > 0, F.col("_tds") / F.col("_conductivity"))
    issues = F.concat_ws(
        "; ",
        F.when(F.col("_bod") > F.col("_cod") * 2.0, "BOD > 2*COD"),
        F.when((ratio < 0.2) | (ratio > 1.5), F.format_string("TDS/EC ratio=%.2f", ratio)),
    )
    bad = last.withColumn("_issues", issues).where("_issues <> ''").select(*keys, "_issues")
    hit = F.col("_issues").isNotNull() & (F.col("quality_flag") == schema.VALID)
    return (
        _null_safe(df, bad, keys)
        .withColumns(
            {
                "qc_notes": F.when(hit, F.col("_issues")),
                "trust_score": F.when(hit, F.col("trust_score") * 0.7).otherwise(F.col("trust_score")),
                "quality_flag": F.when(hit, schema.SUSPECT_CONSISTENCY).otherwise(F.col("quality_flag")),
            }
        )
        .drop("_issues")
    )


def fuse(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """One row per station, date and parameter: the most trusted, the first of equals.

    Sources are listed; where the values agree within a tenth the trust grows by
    a fifth, up to 1, and the flag is valid.  Keys that stand alone pass unchanged.
    Group statistics are pre-aggregated, so rows without a date, which share a key,
    don't meet in one task but as partial results.
    """
    if keys is None:
        df, keys = df.withColumn("_name", text.comparable_name(F.coalesce("station_name", F.lit("")))), ["_name", "date", "parameter"]
    by = F.struct(F.col("trust_score").alias("t"), (-F.col("_seq")).alias("s"))
    row = F.struct(*[c for c in df.columns if c not in keys])
    best = df.groupBy(*keys).agg(
        F.max_by(row, by).alias("_b"),
        F.count(F.lit(1)).alias("_n"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.array_sort(F.collect_set("source")).alias("_sources"),
    )
    many = F.col("_n") > 1
    agree = many & (F.col("_hi") > 0) & ((F.col("_hi") - F.col("_lo")) / F.greatest("_hi", F.lit(0.001)) < 0.1)
    out = best.select(*keys, "_b.*", "_n", "_sources", agree.alias("_agree")).withColumns(
        {
            "trust_score": F.when(F.col("_agree"), F.least(F.lit(1.0), F.col("trust_score") * 1.2)).otherwise(F.col("trust_score")),
            "quality_flag": F.when(F.col("_agree"), schema.VALID).otherwise(F.col("quality_flag")),
            "all_sources": F.when(many, F.array_join("_sources", "; ")),
            "n_sources": F.when(many, F.size("_sources")),
        }
    )
    return out.drop("_name", "_n", "_sources", "_agree")


# --- canonical rules ----------------------------------------------------------


def bounds_flag(value: Column) -> tuple[Column, Column]:
    """Flag and reason of a value beside its four bounds; valid where there are none."""
    reason = lambda words, sign, b: F.concat(F.lit(words + " ("), value.cast("string"), F.lit(f" {sign} "), F.col(b).cast("string"), F.lit(")"))
    tests = [
        (value < F.col("hard_min"), schema.REJECTED, reason("Below hard minimum", "<", "hard_min")),
        (value > F.col("hard_max"), schema.REJECTED, reason("Above hard maximum", ">", "hard_max")),
        (value < F.col("soft_min"), schema.SUSPECT_RANGE, reason("Below typical range", "<", "soft_min")),
        (value > F.col("soft_max"), schema.SUSPECT_RANGE, reason("Above typical range", ">", "soft_max")),
    ]
    flag, why = F.lit(schema.VALID), F.lit("")
    for test, name, words in reversed(tests):
        flag, why = F.when(test, name).otherwise(flag), F.when(test, words).otherwise(why)
    return flag, why


def validate(df: DataFrame, first: str = "1980-01-01", last: str = "2030-12-31") -> DataFrame:
    """Flag each row by date, bounds and sign; suspects keep 0.6 of their confidence."""
    value = F.col("value")
    flag, why = bounds_flag(value)
    late = ~F.col("sample_date").between(F.lit(first).cast("date"), F.lit(last).cast("date"))
    negative = (value < 0) & (F.col("parameter") != "temperature")
    found = df.join(F.broadcast(canonical_bounds(df.sparkSession)), "parameter", "left").withColumns({"_flag": flag, "_why": why})
    note = lambda *parts: F.concat(F.coalesce("notes", F.lit("")), *parts)
    return found.select(
        *[c for c in df.columns if c not in ("quality_flag", "confidence", "notes")],
        F.when(late | (F.col("_flag") == schema.REJECTED) | negative, schema.REJECTED)
        .when(F.col("_flag") == schema.SUSPECT_RANGE, schema.SUSPECT_RANGE)
        .otherwise(F.col("quality_flag"))
        .alias("quality_flag"),
        F.when(~late & (F.col("_flag") == schema.SUSPECT_RANGE), F.col("confidence") * 0.6)
        .otherwise(F.col("confidence"))
        .alias("confidence"),
        F.when(late, note(F.lit("Date "), F.col("sample_date").cast("string"), F.lit(" outside valid range. ")))
        .when(F.col("_flag") == schema.REJECTED, note(F.col("_why"), F.lit(". ")))
        .otherwise(
            note(
                F.when(F.col("_flag") == schema.SUSPECT_RANGE, F.concat("_why", F.lit(". "))).otherwise(""),
                F.when(negative, F.concat(F.lit("Negative value ("), value.cast("string"), F.lit(") for "), "parameter", F.lit(". "))).otherwise(""),
            )
        )
        .alias("notes"),
    )


def validate_outliers(df: DataFrame) -> DataFrame:
    """Flag valid rows beyond the fences of all rows that aren't rejected."""
    fences = quartiles(df.where(F.col("quality_flag") != schema.REJECTED))
    joined = df.join(fences, "parameter", "left")
    out = (F.col("quality_flag") == schema.VALID) & ((F.col("value") < F.col("lower")) | (F.col("value") > F.col("upper")))
    words = F.format_string("Statistical outlier (IQR): value=%.3f, range=[%.3f, %.3f]. ", "value", "lower", "upper")
    return joined.withColumns(
        {
            "notes": F.when(out, F.concat(F.coalesce("notes", F.lit("")), words)).otherwise(F.col("notes")),
            "confidence": F.when(out, F.col("confidence") * 0.5).otherwise(F.col("confidence")),
            "quality_flag": F.when(out, schema.SUSPECT_OUTLIER).otherwise(F.col("quality_flag")),
        }
    ).drop("lower", "upper")


def validate_consistency(df: DataFrame) -> DataFrame:
    """Flag valid rows of a station and date where BOD exceeds COD by a fifth or TDS doesn't fit conductivity."""
    keys = ["station_id", "sample_date"]
    kept = df.where(F.col("quality_flag") != schema.REJECTED)
    last = _last_values(kept, keys, ["bod", "cod", "tds", "conductivity"])
    ratio = F.col("_tds") / F.greatest("_conductivity", F.lit(0.01))
    ratio = F.when(F.col("_conductivity").isNotNull(), ratio)
    issues = F.concat_ws(
        "; ",
        F.when(F.col("_bod") > F.col("_cod") * 1.2, F.format_string("BOD (%.1f) > COD (%.1f)", "_bod", "_cod")),
        F.when(
            (ratio < 0.2) | (ratio > 1.5),
            F.format_string("TDS/EC ratio unusual: %.2f (TDS=%.0f, EC=%.0f)", ratio, F.col("_tds"), F.col("_conductivity")),
        ),
    )
    bad = last.withColumn("_issues", issues).where("_issues <> ''").select(*keys, "_issues")
    hit = F.col("_issues").isNotNull() & (F.col("quality_flag") == schema.VALID)
    return (
        _null_safe(df, bad, keys)
        .withColumns(
            {
                "notes": F.when(hit, F.concat(F.coalesce("notes", F.lit("")), F.lit("Cross-param: "), "_issues", F.lit(". "))).otherwise(F.col("notes")),
                "confidence": F.when(hit, F.col("confidence") * 0.7).otherwise(F.col("confidence")),
                "quality_flag": F.when(hit, schema.SUSPECT_CONSISTENCY).otherwise(F.col("quality_flag")),
            }
        )
        .drop("_issues")
    )


def convert_units(df: DataFrame, targets: DataFrame) -> DataFrame:
    """Values in the unit of ``targets`` (parameter, target_unit).

    An empty unit is taken as the target; a conversion keeps the source's value
    and unit and the lesser confidence; without a rule the confidence falls.
    """
    spark = df.sparkSession
    factors = spark.createDataFrame(schema.UNIT_FACTORS, "_from string, _to string, _factor double, _conf double")
    unit = text.unit_name(F.coalesce("unit", F.lit("")))
    joined = df.join(F.broadcast(targets), "parameter", "left").withColumn("_unit", unit)  # rules of fixed size
    joined = joined.join(
        F.broadcast(factors), (F.col("_unit") == F.col("_from")) & (F.col("target_unit") == F.col("_to")), "left"
    )
    target = F.coalesce("target_unit", F.lit(""))
    as_is = (target == "") | (F.coalesce("unit", F.lit("")) == "") | (F.col("_unit") == target)
    heat = (F.col("_unit") == "°F") & (target == "°C")
    known = ~as_is & (heat | F.col("_factor").isNotNull())
    value = F.when(heat, (F.col("value") - 32) * 5 / 9).otherwise(F.col("value") * F.col("_factor"))
    failed = F.concat(F.coalesce("notes", F.lit("")), F.lit("Unit conversion failed: "), F.col("_unit"), F.lit(" → "), target, F.lit(". "))
    return joined.select(
        *[c for c in df.columns if c not in ("value", "unit", "source_value", "source_unit", "confidence", "notes")],
        F.when(known, value).otherwise(F.col("value")).alias("value"),
        F.when(as_is | known, target).otherwise(F.col("unit")).alias("unit"),
        F.when(known, F.col("value")).otherwise(F.col("source_value")).alias("source_value"),
        F.when(known, F.col("_unit")).otherwise(F.col("source_unit")).alias("source_unit"),
        F.when(known, F.least("confidence", F.coalesce("_conf", F.lit(1.0))))
        .when(as_is, F.col("confidence"))
        .otherwise(F.col("confidence") * 0.7)
        .alias("confidence"),
        F.when(as_is | known, F.col("notes")).otherwise(failed).alias("notes"),
    )


CONFLICT = 0.20


def resolve_conflicts(df: DataFrame, keys: list[str] | None = None, trust: dict[str, float] | None = None) -> DataFrame:
    """Settle several values of a station, date and parameter; ``outcome`` tells how.

    Rejected rows go.  Readings of one source become their mean.  Values of several
    sources that lie within a fifth of their mean leave the most trusted, the others
    are flagged duplicates; else the most trusted loses a fifth of its confidence
    and the others half and are flagged.  With a mean of 0 all stay.
    """
    keys = keys or ["station_id", "sample_date", "parameter"]
    trust = schema.CANONICAL_TRUST if trust is None else trust
    kept = df.where(F.col("quality_flag") != schema.REJECTED)
    # numbers only, so that groups are hashed and not sorted: hashes of sources, and the first row of each level of trust
    source, level = F.xxhash64(F.coalesce("source", F.lit(""))), trust_of(F.col("source"), trust)
    levels = sorted({*trust.values(), schema.DEFAULT_TRUST}, reverse=True)
    stats = kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("_n"),
        (F.min(source) != F.max(source)).alias("_several"),
        F.avg("value").alias("_mean"),
        F.min("value").alias("_lo"),
        F.max("value").alias("_hi"),
        F.min("_seq").alias("_first"),
        F.coalesce(*[F.min(F.when(level == one, F.col("_seq"))) for one in levels]).alias("_best"),
    )
    rows = _null_safe(kept, stats, keys)
    spread = F.greatest(F.col("_hi") - F.col("_mean"), F.col("_mean") - F.col("_lo")) / F.abs("_mean")
    outcome = (
        F.when(F.col("_n") == 1, "single")
        .when(~F.col("_several"), "averaged")
        .when(F.col("_mean") == 0, "kept")
        .when(spread <= CONFLICT, "agreed")
        .otherwise("conflict")
    )
    rows = rows.withColumns({"outcome": outcome, "_wins": F.col("_seq") == F.col("_best")})
    rows = rows.where((F.col("outcome") != "averaged") | (F.col("_seq") == F.col("_first")))
    loses = F.col("outcome").isin("agreed", "conflict") & ~F.col("_wins")
    return rows.select(
        *[c for c in df.columns if c not in ("value", "quality_flag", "confidence")],
        F.when(F.col("outcome") == "averaged", F.round("_mean", 4)).otherwise(F.col("value")).alias("value"),
        F.when(loses & (F.col("outcome") == "agreed"), schema.SUSPECT_DUPLICATE)
        .when(loses, schema.SUSPECT_CONSISTENCY)
        .otherwise(F.col("quality_flag"))
        .alias("quality_flag"),
        F.when(F.col("outcome") != "conflict", F.col("confidence"))
        .when(F.col("_wins"), F.col("confidence") * 0.8)
        .otherwise(F.col("confidence") * 0.5)
        .alias("confidence"),
        "outcome",
    )


# --- wide-frame rules ---------------------------------------------------------


def clip_bounds(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Cells out of bounds become null."""
    present = {c: b for c, b in bounds.items() if c in df.columns}
    return df.withColumns({c: F.when(F.col(c).between(*b), F.col(c)) for c, b in present.items()})


def null_excess(df: DataFrame, part: str = "BOD_mg_l", whole: str = "COD_mg_l", factor: float = 2.0) -> DataFrame:
    """``part`` becomes null where it exceeds ``factor`` times ``whole``."""
    if not {part, whole} <= set(df.columns):
        return df
    return df.withColumn(part, F.when(~F.coalesce(F.col(part) > factor * F.col(whole), F.lit(False)), F.col(part)))


def wide_quality(df: DataFrame, keys: tuple[str, ...] = ("station_id", "date", "source")) -> DataFrame:
    """Bounds, excess and, by key, the first row."""
    return first_of_key(null_excess(clip_bounds(df, schema.WIDE_BOUNDS)), list(keys))


def merged_quality(df: DataFrame, keys: tuple[str, ...] = ("station_id", "date", "source")) -> DataFrame:
    """As ``wide_quality``, but a key's rows are merged: the first value of each column that isn't null."""
    checked = null_excess(clip_bounds(df, schema.WIDE_BOUNDS))
    rest = [c for c in df.columns if c not in keys and c != "_seq"]
    merged = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("_seq"))).alias(c) for c in rest]
    return checked.groupBy(*keys).agg(*merged, F.min("_seq").alias("_seq"))
