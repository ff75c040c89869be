"""Seasons and cyclic months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _by_season(month: Column, values: list) -> Column:
    winter, pre, monsoon, post = values
    return F.when(month.isin(12, 1, 2), winter).when(month.between(3, 5), pre).when(month.between(6, 9), monsoon).otherwise(post)


def season(month: Column) -> Column:
    return _by_season(month, ["Winter (Dec-Feb)", "Pre-Monsoon (Mar-May)", "Monsoon (Jun-Sep)", "Post-Monsoon (Oct-Nov)"])


def season_code(month: Column) -> Column:
    return _by_season(month, [0, 1, 2, 3])


def month_cycle(month: Column) -> tuple[Column, Column]:
    angle = F.lit(2.0) * F.pi() * month / 12
    return F.sin(angle), F.cos(angle)


def month_period(date: Column) -> Column:
    return F.date_format(date, "yyyy-MM")
