"""Calendar numbers in local clock time; the stored timestamps stay UTC."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def calendar_features(df: DataFrame, time: str = "time", zone: str = "Asia/Kolkata") -> DataFrame:
    local = F.from_utc_timestamp(F.col(time), zone)
    hour, day = F.hour(local), F.dayofyear(local)
    turn = 2 * math.pi
    return df.withColumns(
        {
            "hour_ist": hour,
            "weekday_ist": F.weekday(local) + 1,
            "month": F.month(local),
            "doy": day,
            "hour_sin": F.sin(turn * hour / 24),
            "hour_cos": F.cos(turn * hour / 24),
            "doy_sin": F.sin(turn * day / 365.25),
            "doy_cos": F.cos(turn * day / 365.25),
        }
    )
