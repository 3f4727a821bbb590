"""Distance from a point to a polyline, as a Column: the segments are literals, so there is no join."""

from __future__ import annotations

from math import cos, radians

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens import fixed_values as fv
from unitlens.functions.text import apart, settle


def haversine_miles(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_dlat = (F.radians(lat2) - F.radians(lat1)) / 2
    half_dlon = F.radians(lon2 - lon1) / 2
    a = F.pow(F.sin(half_dlat), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(
        F.sin(half_dlon), F.lit(2.0)
    )
    return F.asin(F.sqrt(a)) * (2 * fv.EARTH_RADIUS_MILES)


def _to_segment(lat: Column, lon: Column, start, end) -> Column:
    """Distance to one segment on a local flat projection. The segment's own numbers are folded on the driver."""
    (lat_a, lon_a), (lat_b, lon_b) = start, end
    scale = cos(radians((lat_a + lat_b) / 2.0))
    dx, dy = lon_b * scale - lon_a * scale, lat_b - lat_a
    if dx == 0.0 and dy == 0.0:
        return haversine_miles(lat, lon, F.lit(lat_a), F.lit(lon_a))
    t = ((lon * scale - lon_a * scale) * dx + (lat - lat_a) * dy) / (dx * dx + dy * dy)
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return haversine_miles(lat, lon, t * dy + lat_a, (t * dx + lon_a * scale) / scale)


def valid_point(lat: Column, lon: Column) -> Column:
    in_range = lat.between(-90, 90) & lon.between(-180, 180)
    return F.coalesce(in_range & ~((lat == 0) & (lon == 0)), F.lit(False))


def miles_to_line(lat: Column, lon: Column, line=fv.SHORELINE) -> Column:
    legs = [_to_segment(lat, lon, line[i], line[i + 1]) for i in range(len(line) - 1)]
    nearest = legs[0] if len(legs) == 1 else F.least(*legs)
    return F.when(apart(valid_point(lat, lon)), nearest)


def in_box(lat: Column, lon: Column, box=fv.COASTAL_BOX) -> Column:
    lat_min, lat_max, lon_min, lon_max = box
    return F.coalesce(lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max), F.lit(False))


def is_near(miles: Column, limit: float = fv.NEAR_MILES) -> Column:
    return F.coalesce(miles <= limit, F.lit(False))


def describe_distance(miles: Column) -> Column:
    return (
        F.when(miles.isNull(), "distance unknown")
        .when(miles < fv.AT_LINE_MILES, "oceanfront (<0.1 mi)")
        .otherwise(F.format_string("%.2f mi from ocean", miles))
    )


def measure_distance(df: DataFrame, lat: str = "latitude", lon: str = "longitude", line=fv.SHORELINE,
                     box=fv.COASTAL_BOX) -> DataFrame:
    """Add ``miles``, ``is_near`` and ``within_box`` for a point given as numbers or as text."""
    points = df.withColumns({
        "__lat": F.col(lat).cast("string").try_cast("double"), "__lon": F.col(lon).cast("string").try_cast("double"),
    }) if dict(df.dtypes)[lat] == "string" else df.withColumns({"__lat": F.col(lat), "__lon": F.col(lon)})
    out = settle(points.withColumn("miles", miles_to_line(F.col("__lat"), F.col("__lon"), line)), "miles")
    return out.withColumns({
        "is_near": is_near(F.col("miles")), "within_box": in_box(F.col("__lat"), F.col("__lon"), box),
    }).drop("__lat", "__lon")
