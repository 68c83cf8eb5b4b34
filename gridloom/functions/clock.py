"""The simulated clock: sim = epoch + (real - anchor) * scale."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridloom.types import SETTINGS, Settings


def _at(text: str) -> Column:
    return F.unix_micros(F.lit(text).cast("timestamp"))


def to_sim(real: Column, s: Settings = SETTINGS) -> Column:
    return F.timestamp_micros(_at(s.epoch) + (F.unix_micros(real) - _at(s.anchor)) * s.time_scale)


def to_real(sim: Column, s: Settings = SETTINGS) -> Column:
    return F.timestamp_micros(_at(s.anchor) + F.floor((F.unix_micros(sim) - _at(s.epoch)) / s.time_scale))


def day_progress(sim: Column) -> Column:
    """Share of the simulated day that has gone by."""
    return F.pmod(F.unix_micros(sim), F.lit(86_400_000_000)) / F.lit(86_400_000_000)


def seconds_to_close(sim: Column, s: Settings = SETTINGS) -> Column:
    """Real seconds until the simulated day closes."""
    return (F.lit(86_400_000_000) - F.pmod(F.unix_micros(sim), F.lit(86_400_000_000))) / F.lit(1_000_000.0 * s.time_scale)


def partition_columns(event_ts: Column) -> dict[str, Column]:
    return {"sim_date": F.to_date(event_ts), "hour": F.hour(event_ts)}
