"""Distances and headings between positions in degrees."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

EARTH_RADIUS_M = 6371008.8


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    # least() skips nulls, so an unknown position must be kept out of it
    return F.when(a.isNotNull(), 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def bearing_degrees(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial heading from the first to the second position, 0..360 from north."""
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(
        F.radians(lat2)
    ) * F.cos(dlon)
    return compass(F.degrees(F.atan2(y, x)))


def compass(degrees: Column) -> Column:
    return F.pmod(degrees + 360, F.lit(360.0))


def position(lat: Column, lon: Column, unit: Column | None = None) -> Column:
    """``struct<lat,lon>`` of a plausible fix, else null. Unit 0 marks radians."""
    if unit is not None:
        in_radians = F.coalesce(unit, F.lit(0)) == 0
        lat = F.when(in_radians, F.degrees(lat)).otherwise(lat)
        lon = F.when(in_radians, F.degrees(lon)).otherwise(lon)
    fine = lat.between(-90, 90) & lon.between(-180, 180) & ~((lat == 0) & (lon == 0))
    return F.when(fine, F.struct(lat.alias("lat"), lon.alias("lon")))
