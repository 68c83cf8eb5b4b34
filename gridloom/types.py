"""Row types and fixed values of the meter domain."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from decimal import Decimal

from pyspark.sql.types import (
    BooleanType, DateType, DecimalType, DoubleType, StringType, StructField, StructType, TimestampType,
)

KWH, MONEY, PERCENT, DIVERGENCE = DecimalType(12, 4), DecimalType(12, 2), DecimalType(5, 2), DecimalType(6, 3)

#: Energy of zones, grids and days, which a household's type can't hold.
TOTAL = DecimalType(18, 4)

#: A meter reading as it comes from the log. Everything is nullable: decoding does not enforce more.
READING = StructType([StructField(n, t) for n, t in (
    ("schema_version", StringType()), ("event_id", StringType()), ("trace_id", StringType()), ("meter_id", StringType()), ("household_id", StringType()), ("grid_zone", StringType()),
    ("event_ts", TimestampType()), ("consumption_kwh", KWH), ("solar_generation_kwh", KWH), ("voltage", DoubleType()), ("producer_id", StringType()),
)])
TARIFF = StructType([StructField(n, t, False) for n, t in (
    ("household_id", StringType()), ("effective_date", DateType()), ("billing_tier", StringType()), ("subsidy_flag", BooleanType()), ("subsidy_pct", PERCENT),
    ("fixed_charge", MONEY), ("block_1_rate", MONEY), ("block_2_rate", MONEY), ("block_3_rate", MONEY), ("export_rate", MONEY),
)])
WEATHER = StructType([StructField(n, t, False) for n, t in (
    ("grid_zone", StringType()), ("forecast_date", DateType()), ("cloud_cover_pct", PERCENT), ("temperature_c", PERCENT), ("solar_irradiance_index", DecimalType(4, 3)),
)])

# fixed values of the domain
ZONES = ("ZONE-A", "ZONE-B", "ZONE-C", "ZONE-D", "ZONE-E")
FIXED_CHARGE = {"TIER_1": "120.00", "TIER_2": "240.00", "TIER_3": "480.00"}
BLOCK_RATES = ("8.00", "16.50", "24.50")
BLOCK_1_STEP, SUBSIDY_PCT, EXPORT_RATE = "0.50", "25.00", "18.00"


@dataclass(frozen=True)
class Settings:
    """Parameters of the engine, checked when made."""

    #: Upper bounds of the tariff blocks in kWh; the last is open.
    bounds: tuple[str, ...] = ("60", "120")
    window: str = "15 minutes"
    watermark: str = "30 minutes"
    trigger: str = "10 seconds"
    time_scale: int = 288
    epoch: str = "2024-01-01 00:00:00"
    #: The real instant at which the simulated clock stood at epoch.
    anchor: str = "2024-06-01 00:00:00"
    earliest: str = "2023-01-01 00:00:00"
    latest: str = "2073-12-31 23:59:59"
    voltage: tuple[float, float] = (180.0, 260.0)
    window_retention_days: int = 14
    cross_check_kwh: str = "0.01"
    stale_seconds: int = 120
    low_renewable: str = "0.15"
    reject_rate: float = 0.05
    sla_seconds: int = 900
    divergence_pct: float = 5.0
    history_minutes: tuple[int, int] = (1, 1440)
    zones: tuple[str, ...] = field(default=ZONES)

    def __post_init__(self):
        edges = [Decimal(b) for b in self.bounds]
        if not edges or any(b <= a for a, b in zip([Decimal(0), *edges], edges)):
            raise ValueError("tariff blocks need rising bounds above 0, the last block open")
        if self.time_scale <= 0:
            raise ValueError("time_scale must be positive")

    @classmethod
    def layered(cls, *layers: Mapping, environ: Mapping[str, str] | None = None, prefix: str = "GRIDLOOM_") -> Settings:
        """Settings from layers of names and values, such as the tables of TOML files, the later over the earlier, and
        over them the variables of environ that begin with prefix (values as in TOML, or plain text). A name that is no
        setting is an error, and values are checked like any."""
        known = {f.name: f for f in fields(cls)}
        values = {name: value for layer in layers for name, value in layer.items()}
        for key, text in (environ or {}).items():
            if key.startswith(prefix):
                try:
                    values[key.removeprefix(prefix).lower()] = tomllib.loads(f"x = {text}")["x"]
                except tomllib.TOMLDecodeError:
                    values[key.removeprefix(prefix).lower()] = text
        if strange := sorted(values.keys() - known.keys()):
            raise ValueError(f"no such settings: {', '.join(strange)}")
        made = cls()
        for name, value in values.items():
            now = getattr(made, name)
            if isinstance(now, tuple) and isinstance(value, list):
                values[name] = tuple(type(now[0])(x) for x in value)
            elif isinstance(now, float) and type(value) is int:
                values[name] = float(value)
            elif type(value) is not type(now):
                raise ValueError(f"{name} must be like {now!r}, not {value!r}")
        return cls(**values)

    @classmethod
    def load(cls, *paths: str, environ: Mapping[str, str] | None = None) -> Settings:
        """The same from TOML files, the later over the earlier."""
        layers = []
        for path in paths:
            with open(path, "rb") as file:
                layers.append(tomllib.load(file))
        return cls.layered(*layers, environ=environ)


SETTINGS = Settings()

#: The row types that other systems rely on, by the name of the file in contracts/ that records each.
CONTRACTS = {"reading": READING, "tariff": TARIFF, "weather": WEATHER}


def contract_text(name: str) -> str:
    """A contract as it is recorded: a test holds the file against the type, so that no field changes unseen."""
    return json.dumps(CONTRACTS[name].jsonValue(), indent=1) + "\n"
