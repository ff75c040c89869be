"""Spectral indices, ratios and masks of imagery bands."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is next to 0."""
    return F.when(F.abs(b) > 1e-10, a / b).otherwise(0.0)


def normalized_difference(a: Column, b: Column) -> Column:
    return ratio(a - b, a + b)


def guarded_difference(a: Column, b: Column) -> Column:
    """(a - b) / (a + b + 1e-8) with NaN and infinities as 0."""
    value = (a - b) / (a + b + 1e-8)
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), 0.0).otherwise(value)


def _baseline(at: Column, low: Column, high: Column, share: float) -> Column:
    """How far ``at`` lies above the line from ``low`` to ``high``."""
    return at - low - (high - low) * share


def indices(b: dict[str, Column]) -> dict[str, Column]:
    """The eight water-quality indices of a row's bands."""
    return {
        "NDWI": normalized_difference(b["B3"], b["B8"]),
        "MNDWI": normalized_difference(b["B3"], b["B11"]),
        "NDTI": normalized_difference(b["B4"], b["B3"]),
        "NDVI": normalized_difference(b["B8"], b["B4"]),
        "NDCI": normalized_difference(b["B5"], b["B4"]),
        "MCI": _baseline(b["B5"], b["B4"], b["B6"], (705 - 665) / (740 - 665)),
        "FAI": _baseline(b["B8"], b["B4"], b["B11"], (842 - 665) / (1610 - 665)),
        "SABI": ratio(b["B8"] - b["B4"], b["B3"] + b["B2"]),
    }


def band_ratios(b: dict[str, Column]) -> dict[str, Column]:
    pairs = [("B5", "B4"), ("B3", "B2"), ("B4", "B3"), ("B8", "B4"), ("B11", "B8"), ("B5", "B6")]
    return {f"{x}_{y}": b[x] / F.greatest(b[y], F.lit(1e-6)) for x, y in pairs}


def clear_sky(qa60: Column) -> Column:
    """Neither opaque (bit 10) nor cirrus clouds (bit 11)."""
    return (F.getbit(qa60, F.lit(10)) == 0) & (F.getbit(qa60, F.lit(11)) == 0)


def clear_class(scl: Column) -> Column:
    return scl.isin(4, 5, 6, 11)


def stretched(value: Column, low: Column, high: Column) -> Column:
    """``value`` from ``low`` to ``high`` on 0 to 1, clipped."""
    return F.least(F.greatest((value - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0)), F.lit(1.0))
