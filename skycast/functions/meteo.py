"""Derived meteorology, each column only where its inputs exist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_direction(degrees: str, circular: bool = False) -> Column:
    """An aggregate: the mean of a direction in degrees, arithmetic, or with ``circular`` that of unit vectors (350 and 10 give 0)."""
    if not circular:
        return F.avg(degrees)
    x, y = F.avg(F.cos(F.radians(degrees))), F.avg(F.sin(F.radians(degrees)))
    return (F.degrees(F.atan2(y, x)) + 360.0) % 360.0


def derive(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    new = {}
    if {"wind_speed_10m", "wind_direction_10m"} <= have:
        theta = F.radians("wind_direction_10m")
        new["u10"] = -F.col("wind_speed_10m") * F.sin(theta)
        new["v10"] = -F.col("wind_speed_10m") * F.cos(theta)
    if {"boundary_layer_height", "wind_speed_10m"} <= have:
        new["ventilation_index"] = F.col("boundary_layer_height") * F.col("wind_speed_10m") / 3.6
    if {"temperature_2m", "temperature_925hPa"} <= have:
        new["lapse_2m_925"] = F.col("temperature_2m") - F.col("temperature_925hPa")
        new["inversion"] = F.col("temperature_925hPa") > F.col("temperature_2m")
    if {"temperature_925hPa", "temperature_850hPa"} <= have:
        new["lapse_925_850"] = F.col("temperature_925hPa") - F.col("temperature_850hPa")
    if "boundary_layer_height" in have:
        new["blh_available"] = F.col("boundary_layer_height").isNotNull()
    return df.withColumns(new) if new else df
