"""Settings of the pipeline; every stage takes them from here."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Box:
    lat_min: float = 41.64
    lat_max: float = 42.02
    lon_min: float = -87.94
    lon_max: float = -87.52


@dataclass(frozen=True)
class Config:
    box: Box = field(default_factory=Box)
    center_lat: float = 41.8781
    center_lon: float = -87.6298
    #: reference point of the planar hexagon grid and its hexagons' edge in km
    grid_lat: float = 41.83
    grid_lon: float = -87.73
    edge_km: float = 2.0
    first_year: int = 2001
    lookback_days: int = 400
    warm_up_days: int = 60
    split_days: tuple[tuple[str, int], ...] = (("train", 220), ("calib", 21), ("val", 7), ("test", 14))
    risk_cuts: tuple[float, float, float] = (0.05, 0.15, 0.30)
    blend: tuple[float, float, float] = (0.4, 0.4, 0.2)
    max_null_share: float = 0.05
    sample_per_week: int = 3000


@dataclass(frozen=True)
class IncrementalWindow:
    """The days that a scheduled run loads: one window for all stages."""

    run_date: dt.date
    lag: int = 5
    span: int = 21

    @property
    def end(self) -> dt.date:
        return self.run_date - dt.timedelta(days=self.lag)

    @property
    def start(self) -> dt.date:
        return self.end - dt.timedelta(days=self.span)
