"""Distances on the sphere."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0088


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2))
         * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def unit_vector(lat: Column, lon: Column) -> tuple[Column, Column, Column]:
    """Position on a sphere of radius EARTH_KM. Straight-line distance there never
    exceeds the distance along the surface, so a box search by it misses nothing."""
    la, lo = F.radians(lat), F.radians(lon)
    return (F.lit(EARTH_KM) * F.cos(la) * F.cos(lo),
            F.lit(EARTH_KM) * F.cos(la) * F.sin(lo),
            F.lit(EARTH_KM) * F.sin(la))
