"""Generators: roster, tariff, weather, load and solar curves, faults, ticks and days owed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.types import BLOCK_1_STEP, BLOCK_RATES, EXPORT_RATE, FIXED_CHARGE, KWH, MONEY, PERCENT, SUBSIDY_PCT, ZONES

#: Proleptic ordinal of 1970-01-01.
EPOCH_ORDINAL = 719163


def roster(users: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """A household for each user_id (from 0): zone, tier, subsidy and solar follow from its number by rule."""
    u, n = F.col("user_id"), F.col("user_id") + 1
    return users.select(
        "user_id", F.format_string("HH-%04d", n).alias("household_id"), F.format_string("MTR-%04d", n).alias("meter_id"),
        F.element_at(F.array(*map(F.lit, zones)), (u % len(zones) + 1).cast("int")).alias("grid_zone"),
        F.concat(F.lit("TIER_"), (u % 3 + 1).cast("string")).alias("billing_tier"), (n % 4 == 0).alias("subsidy_flag"), (n % 3 == 0).alias("has_solar"),
    )


def ordinal(day: Column) -> Column:
    return F.datediff(day, F.lit("1970-01-01").cast("date")) + EPOCH_ORDINAL


def tariff(households: DataFrame, days: DataFrame) -> DataFrame:
    """Every household's tariff on every day (sim_date); block 1 costs more on days with an even ordinal. The
    days are few and fixed by the calendar, so they are repeated to the households."""
    fixed = F.create_map(*[F.lit(x) for pair in FIXED_CHARGE.items() for x in pair])
    step = F.when(ordinal(F.col("sim_date")) % 2 == 0, F.lit(BLOCK_1_STEP).cast(MONEY)).otherwise(F.lit("0").cast(MONEY))
    return households.crossJoin(F.broadcast(days)).select(
        "household_id", F.col("sim_date").alias("effective_date"), "billing_tier", "subsidy_flag", F.lit(SUBSIDY_PCT).cast(PERCENT).alias("subsidy_pct"),
        F.element_at(fixed, F.col("billing_tier")).cast(MONEY).alias("fixed_charge"), (F.lit(BLOCK_RATES[0]).cast(MONEY) + step).cast(MONEY).alias("block_1_rate"),
        F.lit(BLOCK_RATES[1]).cast(MONEY).alias("block_2_rate"), F.lit(BLOCK_RATES[2]).cast(MONEY).alias("block_3_rate"), F.lit(EXPORT_RATE).cast(MONEY).alias("export_rate"),
    )


def weather(days: DataFrame, zones: tuple[str, ...] = ZONES) -> DataFrame:
    """A forecast for each zone and day, by rule."""
    d = days.select("sim_date", F.posexplode(F.array(*map(F.lit, zones))).alias("i", "grid_zone"))
    o = ordinal(F.col("sim_date"))
    cloud = ((o * 7 + F.col("i") * 13) % 80 + 10).cast("decimal(5,2)")
    return d.select("grid_zone", F.col("sim_date").alias("forecast_date"), cloud.alias("cloud_cover_pct"), (F.lit(20) + (o * 3 + F.col("i") * 5) % 15).cast("decimal(5,2)").alias("temperature_c"), ((F.lit(100) - cloud) / 100).cast("decimal(4,3)").alias("solar_irradiance_index"))


def load_shape(hour: Column) -> Column:
    """Household load over the day: a baseline with a morning and an evening peak."""
    bell = lambda mid, width: F.exp(-F.pow((hour - mid) / width, 2) / 2)
    return F.lit(0.3) + F.lit(0.6) * bell(7.5, 1.5) + F.lit(1.0) * bell(19.5, 2.0)


def solar_shape(hour: Column) -> Column:
    """Sunshine between 6 and 18 h, a squared cosine around noon."""
    return F.when((hour < 6) | (hour > 18), 0.0).otherwise(F.pow(F.cos((hour - 12) / 12 * F.lit(3.141592653589793)), 2))


def solar_kwh(hour: Column, cloud_pct: Column, peak: float = 1.0) -> Column:
    return F.lit(peak) * solar_shape(hour) * (1 - F.lit(0.8) * cloud_pct / 100)


#: Seconds by which readings of an outage arrive late.
BACKFILL = 2700


def with_faults(readings: DataFrame) -> DataFrame:
    """Readings with deterministic faults by event_id and an ingest time: exclusive faults in a fixed order of
    their residues, duplicates beside them, sent again five seconds later. One meter reading in forty waits out an
    outage and arrives with a backfill, three quarters of an hour late."""
    e = F.col("event_id")
    lost, negative, stranger, nowhere, ancient = e % 100 == 1, e % 200 == 3, e % 200 == 5, e % 500 == 7, e % 500 == 9
    out = readings.withColumns({
        "household_id": F.when(lost, "").when(stranger, "HH-9999").otherwise(F.col("household_id")),
        "grid_zone": F.when(nowhere, "ZONE-Z").otherwise(F.col("grid_zone")),
        "consumption_kwh": F.when(negative, (-(F.col("consumption_kwh") + 1)).cast(KWH)).otherwise(F.col("consumption_kwh")),
        "event_ts": F.when(ancient, F.col("event_ts") - F.expr("INTERVAL 25 YEARS")).otherwise(F.col("event_ts")),
    })
    copies = F.when(e % 50 == 0, F.array(F.lit(0), F.lit(5))).otherwise(F.array(F.lit(0)))
    again, outage = F.explode(copies).alias("again"), F.when(e % 40 == 11, F.lit(BACKFILL)).otherwise(F.lit(0))
    out = out.select("*", again).withColumn("late", F.col("again") + outage).drop("again")
    return out.withColumn("ingest_ts", F.expr("event_ts + make_interval(0, 0, 0, 0, 0, 0, late)")).drop("late")


def closed_days_owed(dropped: DataFrame, today: Column, cap: int = 7) -> DataFrame:
    """Days from the newest dropped sim_date on until yesterday, at most cap of them."""
    newest = dropped.agg(F.max("sim_date").alias("d"))
    last = F.least(F.date_sub(today, 1), F.date_add("d", cap))
    return newest.select(F.explode(F.when(F.date_add("d", 1) <= last, F.sequence(F.date_add("d", 1), last)).otherwise(F.array().cast("array<date>"))).alias("sim_date"))


def tick_of(moment: Column, anchor: str, seconds: int = 2) -> Column:
    """The number of the tick that a moment waits for: tick k is due at anchor + k * seconds."""
    return F.ceil((F.unix_micros(moment) - F.unix_micros(F.lit(anchor).cast("timestamp"))) / F.lit(seconds * 1_000_000))


def due(tick: Column, anchor: str, seconds: int = 2) -> Column:
    """When a tick is due."""
    return F.timestamp_micros(F.unix_micros(F.lit(anchor).cast("timestamp")) + tick * F.lit(seconds * 1_000_000))
