"""Distance and speed on the sphere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigil.model import EARTH_RADIUS_KM, MS_PER_HOUR


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Great-circle distance in km between two points in degrees; null if any of them is null."""
    half = lambda a, b: F.pow(F.sin((F.radians(b) - F.radians(a)) / 2), 2)
    chord = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.atan2(F.sqrt(chord), F.sqrt(F.greatest(F.lit(0.0), 1 - chord)))


def speed_kmh(distance_km: Column, delta_ms: Column) -> Column:
    """Speed over a time; null unless the time is positive."""
    return F.when(delta_ms > 0, distance_km / (delta_ms / F.lit(float(MS_PER_HOUR))))
