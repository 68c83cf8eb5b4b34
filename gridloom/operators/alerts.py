"""Alert predicates over tables; the present is always an argument."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.operators.rollups import latest_by_zone
from gridloom.types import SETTINGS, Settings


def _seconds(later: Column, earlier: Column) -> Column:
    return ((F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(1_000_000)).cast("double")


def zone_data_age(windows: DataFrame, now: Column) -> DataFrame:
    """Seconds since each zone's newest window was written."""
    return latest_by_zone(windows).select("grid_zone", _seconds(now, F.col("updated_at")).alias("age_seconds"))


def meter_data_stale(windows: DataFrame, now: Column, hold_seconds: int = 30, s: Settings = SETTINGS) -> DataFrame:
    """Zones that were stale at both ends of the holding time."""
    return zone_data_age(windows, now).where(F.col("age_seconds") - hold_seconds > s.stale_seconds)


def low_renewable(windows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Windows at which a zone's ratio has been low for three in a row."""
    last = Window.partitionBy("grid_zone").orderBy("window_start").rowsBetween(-2, 0)
    out = windows.withColumns({"highest": F.max("renewable_ratio").over(last), "n": F.count("*").over(last)})
    return out.where((F.col("n") == 3) & (F.col("highest") < F.lit(s.low_renewable).cast("decimal(5,4)"))).select("grid_zone", "window_start", "highest")


def reject_rates(marked: DataFrame) -> DataFrame:
    """Consumed and rejected readings and their ratio in five-minute windows that slide by a minute (ingest_ts)."""
    out = marked.groupBy(F.window("ingest_ts", "5 minutes", "1 minute").alias("w")).agg(F.count("*").alias("consumed"), F.count("reason").alias("rejected"))
    return out.select(F.col("w.start").alias("window_start"), "consumed", "rejected", (F.col("rejected") / F.col("consumed")).alias("rate"))


def high_reject_rate(marked: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    return reject_rates(marked).where((F.col("consumed") > 0) & (F.col("rate") > s.reject_rate))


def last_billing_success(runs: DataFrame, fallback: Column) -> DataFrame:
    """End of the latest run that succeeded, superseded or not; the fallback if there is none."""
    done = runs.where("status IN ('success', 'superseded') AND layer = 'batch'")
    return done.agg(F.coalesce(F.max("finished_at"), fallback).alias("last_success"))


def batch_sla_miss(runs: DataFrame, fallback: Column, now: Column, s: Settings = SETTINGS) -> DataFrame:
    out = last_billing_success(runs, fallback).withColumn("late_seconds", _seconds(now, F.col("last_success")))
    return out.where(F.col("late_seconds") > s.sla_seconds)


def lambda_divergence(rows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The latest reconciled day, if its mean divergence is too high."""
    out = rows.groupBy("sim_date").agg(F.avg(F.col("pct_divergence").cast("double")).alias("m")).orderBy(F.col("sim_date").desc()).limit(1)
    return out.where(F.col("m") > s.divergence_pct).select("sim_date", F.round("m", 6).alias("mean_pct"))


def active(stale: DataFrame, low: DataFrame) -> DataFrame:
    """Alerts by zone: stale data inhibits the alert on low renewables of the same zone."""
    kept = low.select("grid_zone").distinct().join(stale, "grid_zone", "left_anti")
    return stale.select("grid_zone", F.lit("MeterDataStale").alias("alert")).unionByName(kept.select("grid_zone", F.lit("LowRenewable").alias("alert")))


def firing(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The alerts that are active, from an alert manager's JSON lists: name, severity, summary, since. Resolved and
    suppressed ones, which such lists go on naming for a while, are left out; so is text that is no list."""
    kind = "array<struct<status: struct<state: string>, labels: map<string, string>, annotations: map<string, string>, startsAt: timestamp>>"
    one = payloads.select(F.explode(F.from_json(column, kind)).alias("a")).where("a.status.state = 'active'")
    named = lambda part, key, other: F.coalesce(F.try_element_at(f"a.{part}", F.lit(key)), F.lit(other)).alias(key if key != "alertname" else "name")
    return one.select(named("labels", "alertname", "unknown"), named("labels", "severity", "unknown"), named("annotations", "summary", ""), F.col("a.startsAt").alias("since"))
