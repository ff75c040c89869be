"""Distances, boxes, regions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gaugeflow import schema

# The earth's radius in km, the source of the river, km to a degree.
RADIUS_KM = 6371.0
SOURCE = (30.99, 78.94)
DEGREE_KM = 111


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * RADIUS_KM) * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def earth_xyz(lat: Column, lon: Column) -> list[Column]:
    """A place in space, in km from the earth's centre: nothing is farther apart there than on the ground, at poles and date line too."""
    p, q = F.radians(lat), F.radians(lon)
    return [RADIUS_KM * F.cos(p) * F.cos(q), RADIUS_KM * F.cos(p) * F.sin(q), RADIUS_KM * F.sin(p)]


def spatial_similarity(km: Column, threshold: float = 2.0) -> Column:
    """1 up to 0.1 km, falling to 0 at twice the threshold."""
    return F.when(km <= 0.1, 1.0).when(km >= 2 * threshold, 0.0).otherwise(1 - km / (2 * threshold))


def in_box(lat: Column, lon: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lon.between(box[2], box[3])


def in_india(lat: Column, lon: Column) -> Column:
    return in_box(lat, lon, schema.INDIA_BOX)


def distance_from_source_km(lat: Column, lon: Column) -> Column:
    north, east = (lat - SOURCE[0]) * DEGREE_KM, (lon - SOURCE[1]) * DEGREE_KM * F.cos(F.radians(lat))
    return F.sqrt(north * north + east * east)


def region(lon: Column) -> Column:
    return F.when(lon < 81, "Upper Ganga").when(lon < 87, "Middle Ganga").otherwise("Lower Ganga")
