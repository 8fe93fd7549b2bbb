"""Lags and gap-aware rolling statistics on a complete hourly index.

A window partition is (station, stretch of the calendar). Every stretch also gets the
hours just before it that its frames reach back to, and drops them again afterwards.
The size of a sort is thereby fixed whatever the length of the record, and a few
stations with long records still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAGS_H = (1, 2, 3, 6, 12, 24, 48, 72)
WINDOWS_H = (3, 24, 72)
MIN_SHARE = 0.6
VIS_LAGS_H = (1, 3, 24)
STRETCH_H = 24 * 120
BLOCK = "_stretch"
OWN = "_own"


def min_count(width: int, share: float = MIN_SHARE) -> int:
    return max(1, int(width * share))


def _hour(time: str) -> Column:
    return F.floor(F.unix_timestamp(time) / 3600)


def stretched(df: DataFrame, halo_h: int, time: str = "time", stretch_h: int = STRETCH_H) -> DataFrame:
    """Copy every row into its stretch and into later stretches that look back on it."""
    first = F.floor(_hour(time) / stretch_h)
    last = F.floor((_hour(time) + halo_h) / stretch_h)
    return df.withColumn(BLOCK, F.explode(F.sequence(first, last))).withColumn(OWN, F.col(BLOCK) == first)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(OWN)).drop(BLOCK, OWN)


def by_stretch(keys: Sequence[str], time: str = "time"):
    return Window.partitionBy(*keys, BLOCK).orderBy(time)


def rolling(value: Column, width: int, least: int, keys, how: str, time: str = "time") -> Column:
    """One rolling statistic over ``width`` rows, null below ``least`` non-null values."""
    frame = by_stretch(keys, time).rowsBetween(-(width - 1), 0)
    stat = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "sum": F.sum}[how](value).over(frame)
    return F.when(F.count(value).over(frame) >= least, stat)


def rolling_mean(
    df: DataFrame, value: str, out: str, width: int, least: int, key: str | None = "station_id",
    time: str = "time", stretch_h: int = STRETCH_H,
) -> DataFrame:
    keys = [key] if key else []
    wide = stretched(df, width - 1, time, stretch_h)
    return own_rows(wide.withColumn(out, rolling(F.col(value), width, least, keys, "mean", time)))


def rolling_mean_by_hours(df: DataFrame, value: str, out: str, hours: int, least: int, key: str = "station_id",
                          time: str = "time", stretch_h: int = STRETCH_H) -> DataFrame:
    """Mean over the last ``hours`` clock hours of a series with missing rows."""
    wide = stretched(df, hours - 1, time, stretch_h).withColumn("_s", F.unix_timestamp(time))
    frame = Window.partitionBy(key, BLOCK).orderBy("_s").rangeBetween(-(hours - 1) * 3600, 0)
    mean = F.when(F.count(value).over(frame) >= least, F.avg(value).over(frame))
    return own_rows(wide.withColumn(out, mean)).drop("_s")


def observation_features(
    df: DataFrame, value: str = "pm25_clean", key: str = "station_id", visibility: str = "metar_visibility_km",
    time: str = "time", stretch_h: int = STRETCH_H, gaps: bool = True,
) -> DataFrame:
    """Lags, rolling mean/std, visibility history, hours since the last value, 24 h change.

    Needs the complete hourly index: row k back is hour k back. Nothing is filled
    across a gap; a window below its minimum count is null. ``gaps=False`` leaves out obs_gap_h and the join it takes.
    """
    keys = [key]
    v = F.col(value)
    w = by_stretch(keys, time)
    cols: dict[str, Column] = {f"obs_lag_{k}h": F.lag(v, k).over(w) for k in LAGS_H}
    for width in WINDOWS_H:
        cols[f"obs_mean_{width}h"] = rolling(v, width, min_count(width), keys, "mean", time)
        cols[f"obs_std_{width}h"] = rolling(v, width, min_count(width), keys, "std", time)
    if visibility in df.columns:
        s = F.col(visibility)
        cols.update({f"vis_lag_{k}h": F.lag(s, k).over(w) for k in VIS_LAGS_H})
        cols["vis_min_24h"] = rolling(s, 24, min_count(24), keys, "min", time)
        cols["vis_mean_24h"] = rolling(s, 24, min_count(24), keys, "mean", time)
    cols["obs_delta_24h"] = v - F.lag(v, 24).over(w)
    cols["_seen"] = F.last(F.when(v.isNotNull(), _hour(time)), ignorenulls=True).over(
        w.rowsBetween(Window.unboundedPreceding, 0)
    )
    halo = max(*LAGS_H, *(x - 1 for x in WINDOWS_H))
    wide = stretched(df, halo, time, stretch_h).withColumns(cols)
    if not gaps:
        return own_rows(wide).drop("_seen")

    # The last value may lie before the halo: carry each stretch's last valid hour
    # forward over the stretches of the station (one row per stretch).
    ends = df.groupBy(key, F.floor(_hour(time) / stretch_h).alias(BLOCK)).agg(
        F.max(F.when(v.isNotNull(), _hour(time))).alias("_end")
    )
    before = Window.partitionBy(key).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(key, BLOCK, F.last("_end", ignorenulls=True).over(before).alias("_carried"))
    out = wide.where(F.col(OWN)).join(carried, [key, BLOCK], "left")
    gap = (_hour(time) - F.coalesce("_seen", "_carried")).cast("int")
    return out.withColumn("obs_gap_h", gap).drop(BLOCK, OWN, "_seen", "_carried")


def rolling_sums(
    df: DataFrame, specs: dict[str, tuple[str, int]], key: str | None = None, time: str = "time",
    stretch_h: int = STRETCH_H,
) -> DataFrame:
    """Trailing sums over rows, at least one value; ``specs`` maps out -> (value, width)."""
    keys = [key] if key else []
    wide = stretched(df, max(w for _, w in specs.values()) - 1, time, stretch_h)
    return own_rows(
        wide.withColumns({out: rolling(F.col(v), w, 1, keys, "sum", time) for out, (v, w) in specs.items()})
    )
