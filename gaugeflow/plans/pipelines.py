"""The pipelines: records, canonical records, wide frames, training features."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gaugeflow import schema
from gaugeflow.operators import entity, features, profile, quality, reshape, temporal


def record_pipeline(sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Fused long observations and their wide form, from sources in long form.

    One lazy plan: union, standardise, box, ranges and trust, outliers,
    consistency, fusion, pivot.
    """
    long = quality.spatial_filter(quality.standardize(reshape.union_all(sources)))
    long = quality.flag_inconsistent(quality.flag_outliers(quality.range_check(long)))
    fused = quality.fuse(long)
    return fused, reshape.pivot_wide(fused, list(schema.RECORD_PARAMETERS))


def record_report(fused: DataFrame) -> DataFrame:
    """Counts by source, parameter and flag."""
    return profile.multi_counts(fused, ["source", "parameter", "quality_flag"])


def canonical_pipeline(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Settled canonical records and the station registry."""
    converted = quality.convert_units(records, targets)
    registry = entity.station_registry(converted)
    placed = entity.apply_registry(converted, registry)
    checked = quality.validate_consistency(quality.validate_outliers(quality.validate(placed)))
    return quality.resolve_conflicts(checked), registry


def wide_pipeline(sources: list[DataFrame], compat: bool = False) -> DataFrame:
    """Wide frames under one roof, checked; a key's rows are merged, or with ``compat`` its first row kept."""
    both = reshape.union_all(sources)
    return quality.wide_quality(both) if compat else quality.merged_quality(both)


def wide_report(df: DataFrame) -> dict[str, DataFrame]:
    """Sources, coverage and cross-source differences of a wide frame."""
    measures = [c for c in schema.WIDE_BOUNDS if c in df.columns]
    long = df.unpivot(["source"], [F.col(m).cast("double").alias(m) for m in measures], "parameter", "value")
    stations = {"rows": F.count(F.lit(1)), "stations": F.count_distinct("station_id"), "first": F.min("date"), "last": F.max("date")}
    return {
        "sources": profile.summary_with_total(df, "source", stations),
        "coverage": profile.coverage(df, "source", measures),
        "differences": profile.mean_differences(long),
        "compliance": profile.compliance(df, schema.STANDARDS),
    }


def training_features(readings: DataFrame, scenes: DataFrame, targets: list[str] = features.TARGETS) -> DataFrame:
    """Readings with the composite of their imagery tier, cleaned, with features."""
    composite = temporal.tiered_composite(readings.select("stationId", "date").distinct(), scenes, ["stationId"], schema.BANDS)
    joined = readings.join(composite, ["stationId", "date"])
    cleaned = features.clean_for_training(joined, targets)
    return features.feature_vector(features.knn_impute(cleaned, targets))


_TOKENS = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|==|!=|<=|>=|<>|&&|\|\||[&|~]|[^'"`=!<>&|~]+|.""", re.S)
_SQL = {"==": "=", "&": " AND ", "&&": " AND ", "|": " OR ", "||": " OR ", "~": " NOT "}


def sql_predicate(predicate: str) -> str:
    """A predicate with its operators in SQL; quoted text and names are not touched."""
    return "".join(_SQL.get(token, token) for token in _TOKENS.findall(predicate))


def query(df: DataFrame, predicate: str, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Rows for which an ad-hoc predicate holds, in SQL or with ``&``, ``|``, ``~`` and ``==``.

    Quoted parts stay as they are.  As in the reference language, ``&`` and ``|``
    bind like ``and`` and ``or``.  An invalid predicate raises ValueError with the
    parser's message.
    """
    text = sql_predicate(predicate)
    try:
        found = df.where(text)
    except Exception as error:
        raise ValueError(str(error).splitlines()[0]) from None
    found = found.select(*columns) if columns else found
    return found.limit(limit) if limit is not None else found
