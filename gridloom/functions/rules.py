"""Validation as one ordered list of rules: the first that matches names the reason."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.types import READING, SETTINGS, Settings

#: Text columns that must hold something; an event without an id of its own is still a reading.
_NAMES = ("meter_id", "household_id", "grid_zone")
_VALUES = ("event_ts", "consumption_kwh", "solar_generation_kwh")


#: Every reason a reading can be rejected for, and what it means; reports and accounts know these and no others.
REASONS = {
    "null_field": "a required field is missing or empty",
    "negative_kwh": "energy below zero",
    "unknown_household": "the household is not on the roster",
    "unknown_zone": "the zone is not one of the grid's",
    "event_ts_out_of_range": "the time lies outside the simulated calendar",
}


def rules(known: Column, s: Settings = SETTINGS) -> dict[str, Column]:
    """Reason to predicate, in the order in which they apply. known tells whether the household is on the roster."""
    filled = [F.nullif(F.col(name).cast("string"), F.lit("")) for name in _NAMES] + [F.col(name) for name in _VALUES]
    within = F.col("event_ts").between(*[F.lit(t).cast("timestamp") for t in (s.earliest, s.latest)])
    found = {
        "null_field": reduce(or_, [c.isNull() for c in filled]),
        "negative_kwh": F.least("consumption_kwh", "solar_generation_kwh") < 0,
        "unknown_household": ~known,
        "unknown_zone": ~F.col("grid_zone").isin(*s.zones),
        "event_ts_out_of_range": ~within,
    }
    if found.keys() != REASONS.keys():
        raise RuntimeError(f"rules and REASONS differ in {', '.join(sorted(found.keys() ^ REASONS.keys()))}")
    return found


def with_reason(readings: DataFrame, roster: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """readings with reason: null for valid ones. The roster is joined on its key, whatever its size."""
    named = roster.select("household_id", F.lit(True).alias("__known")).distinct()
    failed = rules(F.col("__known").isNotNull(), s)
    marked = readings.join(named, "household_id", "left")
    return marked.withColumn("reason", F.coalesce(*[F.when(fails, F.lit(reason)) for reason, fails in failed.items()])).drop("__known")


def accepted(marked: DataFrame) -> DataFrame:
    """The valid ones of marked readings."""
    return marked.where("reason IS NULL").drop("reason")


def rejected(marked: DataFrame) -> DataFrame:
    """The others, with a payload: the record's own text where decoding kept it, otherwise its fields as JSON."""
    fields = F.to_json(F.struct([c for c in READING.names if c in set(marked.columns)]))
    text = F.coalesce("raw_value", fields) if "raw_value" in marked.columns else fields
    return marked.filter(F.col("reason").isNotNull()).withColumn("payload", text)


def split(readings: DataFrame, roster: DataFrame, s: Settings = SETTINGS) -> tuple[DataFrame, DataFrame]:
    """Valid readings, and rejected ones with reason and payload."""
    marked = with_reason(readings, roster, s)
    return accepted(marked), rejected(marked)


def warnings(s: Settings = SETTINGS) -> Column:
    """Warnings that never reject: voltage outside its bounds, which are inclusive."""
    low, high = s.voltage
    return F.when(~F.col("voltage").between(low, high), F.array(F.lit("voltage_out_of_range"))).otherwise(F.array().cast("array<string>"))


def trace_id(headers: Column, payload_trace: Column) -> Column:
    """The first header named trace_id, else the payload's."""
    first = F.get(F.filter(headers, lambda h: h["key"] == "trace_id"), 0)
    return F.coalesce(first["value"].cast("string"), payload_trace)
