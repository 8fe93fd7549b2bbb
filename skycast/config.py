"""Configuration: thresholds as plain data, rosters as DataFrames."""

from __future__ import annotations

import datetime as dt
import tomllib
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Bracket:
    c_lo: float
    c_hi: float
    i_lo: float
    i_hi: float


@dataclass(frozen=True)
class Stage:
    stage: int
    name: str
    aqi_min: float
    aqi_max: float


@dataclass(frozen=True)
class Block:
    split: str
    start: str
    end: str
    label: str

    @property
    def lower(self) -> dt.datetime:
        return dt.datetime.fromisoformat(self.start)

    @property
    def upper(self) -> dt.datetime:
        return dt.datetime.fromisoformat(self.end) + dt.timedelta(hours=23, minutes=59, seconds=59)


@dataclass(frozen=True)
class Fold:
    label: str
    train_end: str
    test_start: str
    test_end: str


# National PM2.5 sub-index brackets (24-hour mean, ug/m3).
BRACKETS = (
    Bracket(0.0, 30.0, 0, 50),
    Bracket(30.0, 60.0, 51, 100),
    Bracket(60.0, 90.0, 101, 200),
    Bracket(90.0, 120.0, 201, 300),
    Bracket(120.0, 250.0, 301, 400),
    Bracket(250.0, 380.0, 401, 500),
)

# Graded-response stages keyed to the city AQI.
STAGES = (
    Stage(1, "Poor", 201, 300),
    Stage(2, "Very Poor", 301, 400),
    Stage(3, "Severe", 401, 450),
    Stage(4, "Severe Plus", 451, 1000),
)

# Held-out blocks and the seasonal rolling-origin folds.
BLOCKS = (
    Block("test", "2025-12-15", "2026-01-31", "winter-late-2025"),
    Block("test", "2026-06-01", "2026-06-30", "summer-2026"),
    Block("val", "2025-12-01", "2025-12-10", "december-early-2025"),
    Block("val", "2025-05-01", "2025-05-20", "may-2025"),
)
FOLDS = (
    Fold("autumn-2025", "2025-09-15", "2025-09-20", "2025-10-31"),
    Fold("episode-2025", "2025-11-01", "2025-11-06", "2025-12-20"),
    Fold("late-winter-2026", "2025-12-21", "2025-12-26", "2026-02-10"),
    Fold("spring-2026", "2026-02-15", "2026-02-20", "2026-04-15"),
    Fold("summer-2026", "2026-04-20", "2026-04-25", "2026-06-30"),
)

# Variables of the two forecast feeds and of the airport reports.
CAMS_COLS = (
    "pm2_5", "pm10", "carbon_monoxide", "nitrogen_dioxide",
    "sulphur_dioxide", "ozone", "dust", "aerosol_optical_depth",
)
MET_COLS = (
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "surface_pressure",
    "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "wind_speed_100m",
    "wind_direction_100m", "boundary_layer_height", "precipitation", "cloud_cover",
    "shortwave_radiation", "cape", "visibility", "u10", "v10", "ventilation_index",
    "temperature_925hPa", "temperature_850hPa", "wind_speed_925hPa",
    "wind_direction_925hPa", "geopotential_height_925hPa",
    "lapse_2m_925", "lapse_925_850", "inversion", "blh_available",
)
METAR_COLS = (
    "visibility_km", "visibility_km_min", "dew_point_depression_c",
    "relative_humidity", "temp_c", "n_obs",
)
LEAD_MATCHED = (
    "temperature_2m", "relative_humidity_2m", "dew_point_2m", "surface_pressure",
    "wind_speed_10m", "wind_direction_10m", "wind_gusts_10m", "wind_speed_100m",
    "wind_direction_100m", "precipitation", "cloud_cover", "shortwave_radiation", "cape",
)
FIRE_COLS = ("fire_count_24h", "fire_frp_24h", "fire_count_72h", "fires_available")
CALENDAR_COLS = ("hour_sin", "hour_cos", "doy_sin", "doy_cos", "hour_ist", "weekday_ist", "month")

EPISODE_PM25 = 250.0


@dataclass(frozen=True)
class Settings:
    brackets: tuple[Bracket, ...] = BRACKETS
    stages: tuple[Stage, ...] = STAGES
    blocks: tuple[Block, ...] = BLOCKS
    folds: tuple[Fold, ...] = FOLDS
    horizons: tuple[int, ...] = (24, 48, 72)
    embargo_h: int = 96
    city_scope: tuple[str, ...] = ("Delhi", "New Delhi")
    # Probability at which each stage is called.
    thresholds: dict[int, float] = field(default_factory=lambda: {1: 0.50, 2: 0.40, 3: 0.25, 4: 0.20})
    bbox: tuple[float, float, float, float] = (28.10, 76.70, 29.10, 77.70)
    grid_step: float = 0.05
    local_zone: str = "Asia/Kolkata"
    aqi_max: float = 500.0
    # Raw tables of the loaded file, for rosters.
    stations: tuple[dict, ...] = ()
    upwind_stations: tuple[dict, ...] = ()

    def with_(self, **changes) -> Settings:
        return replace(self, **changes)

    @classmethod
    def from_toml(cls, path: str) -> Settings:
        with open(path, "rb") as fh:
            raw = tomllib.load(fh)
        made: dict = {}
        if "aqi" in raw:
            made["brackets"] = tuple(Bracket(**b) for b in raw["aqi"]["pm25_breakpoints"])
        if "grap" in raw:
            made["stages"] = tuple(
                Stage(s["stage"], s["name"], s["aqi_min"], s["aqi_max"]) for s in raw["grap"]["stages"]
            )
            made["city_scope"] = tuple(raw["grap"].get("city_average_cities", ()))
        if "split" in raw:
            made["embargo_h"] = int(raw["split"]["embargo_h"])
            made["blocks"] = tuple(
                Block(kind, b["start"], b["end"], b.get("label", f"{kind}-{b['start']}"))
                for kind in ("val", "test")
                for b in raw["split"].get(f"{kind}_blocks", [])
            )
        if "forecast" in raw:
            made["horizons"] = tuple(raw["forecast"]["horizons_h"])
        if "domain" in raw:
            d = raw["domain"]
            made["bbox"] = (d["lat_min"], d["lon_min"], d["lat_max"], d["lon_max"])
            made["grid_step"] = d["grid_step_deg"]
        made["stations"] = tuple(raw.get("stations_meta", {}).get("stations", ()))
        made["upwind_stations"] = tuple(raw.get("upwind", {}).get("upwind_stations", ()))
        return cls(**made)


def brackets_frame(spark: SparkSession, cfg: Settings) -> DataFrame:
    return spark.createDataFrame(
        [(b.c_lo, b.c_hi, float(b.i_lo), float(b.i_hi)) for b in cfg.brackets],
        "c_lo double, c_hi double, i_lo double, i_hi double",
    )


def stages_frame(spark: SparkSession, cfg: Settings) -> DataFrame:
    rows = [(s.stage, s.name, float(s.aqi_min), float(s.aqi_max), cfg.thresholds.get(s.stage)) for s in cfg.stages]
    return spark.createDataFrame(rows, "stage int, stage_name string, aqi_min double, aqi_max double, threshold double")


def blocks_frame(spark: SparkSession, cfg: Settings) -> DataFrame:
    rows = [(b.split, b.label, dt.date.fromisoformat(b.start), dt.date.fromisoformat(b.end)) for b in cfg.blocks]
    return spark.createDataFrame(rows, "split string, label string, first date, last date")


def stations_frame(spark: SparkSession, cfg: Settings) -> DataFrame:
    rows = [
        (s["id"], s["name"], s["city"], s["agency"], float(s["lat"]), float(s["lon"]), int(s.get("openaq_id", 0)))
        for s in cfg.stations
    ]
    return spark.createDataFrame(
        rows, "station_id string, name string, city string, agency string, lat double, lon double, location_id long"
    )


def upwind_frame(spark: SparkSession, cfg: Settings) -> DataFrame:
    rows = [
        (s["id"], s["name"], float(s["distance_km"]), float(s["bearing_deg"])) for s in cfg.upwind_stations
    ]
    return spark.createDataFrame(rows, "upwind_id string, name string, distance_km double, bearing_deg double")
