"""Windows and days by zone."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions.tariff import netting, renewable_ratio
from gridloom.operators.billing import exact_sum
from gridloom.operators.ledger import RunLedger, publish_days
from gridloom.sources.tables import Table
from gridloom.types import KWH, SETTINGS, TOTAL, Settings


def zone_windows(valid: DataFrame, s: Settings = SETTINGS, streaming: bool = False, record_ts: str | None = None) -> DataFrame:
    """Load, sunshine, their ratio and distinct meters by zone and window, and the newest of the records' own times if
    their column is named. A stream can't count distinct values, so there the few meters of a zone and window are
    gathered in a set."""
    meters = F.size(F.collect_set("meter_id")).cast("long") if streaming else F.count_distinct("meter_id")
    parts = [exact_sum("consumption_kwh").alias("total_consumption_kwh"), exact_sum("solar_generation_kwh").alias("total_solar_kwh"), meters.alias("active_meters"), F.max("event_ts").alias("last_event_ts")]
    newest = [] if record_ts is None else [F.max(record_ts).alias("newest_record_ts")]
    out = valid.groupBy(F.window("event_ts", s.window).alias("w"), "grid_zone").agg(*parts, *newest)
    ratio = renewable_ratio(F.col("total_solar_kwh"), F.col("total_consumption_kwh"))
    return out.select("grid_zone", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "total_consumption_kwh", "total_solar_kwh", ratio.alias("renewable_ratio"), "active_meters", "last_event_ts", *[c for c in out.columns if c == "newest_record_ts"])


def household_running(valid: DataFrame) -> DataFrame:
    """Totals by household and day, as a one-day window so that a stream can let go of them."""
    out = valid.groupBy(F.window("event_ts", "1 day").alias("w"), "household_id").agg(exact_sum("consumption_kwh").alias("consumption_kwh"), exact_sum("solar_generation_kwh").alias("solar_kwh"))
    return out.select("household_id", F.to_date("w.start").alias("sim_date"), "consumption_kwh", "solar_kwh")


def peak_windows(windows: DataFrame) -> DataFrame:
    """By zone and day the window of the highest load, the earliest of equals."""
    best = F.max(F.struct("total_consumption_kwh", (-F.unix_micros("window_start")).alias("back"))).alias("m")
    out = windows.groupBy("grid_zone", F.to_date("window_start").alias("sim_date")).agg(best)
    return out.select("grid_zone", "sim_date", F.timestamp_micros(-F.col("m.back")).alias("peak_window_start"), F.col("m.total_consumption_kwh").alias("peak_consumption_kwh"))


def zone_daily(valid: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Zone days: households are netted by day first, then added up; with meters, readings and the peak window.

    Readings are aggregated once, by zone, day, household, meter and window; days and windows are both sums of
    that. Distinct meters are counted by way of the household days: a meter belongs to one of them.
    """
    keys = ["grid_zone", F.to_date("event_ts").alias("sim_date"), "household_id", "meter_id", F.window("event_ts", s.window)["start"].alias("window_start")]
    fine = valid.groupBy(*keys).agg(exact_sum("consumption_kwh").alias("c"), exact_sum("solar_generation_kwh").alias("s"), F.count("*").alias("n"))
    day = fine.groupBy("grid_zone", "sim_date", "household_id").agg(F.sum("c").cast(KWH).alias("c"), F.sum("s").cast(KWH).alias("s"), F.count_distinct("meter_id").alias("meters"), F.sum("n").alias("n"))
    nets = netting(F.col("c"), F.col("s"))
    day = day.select("*", nets["billable_import_kwh"].alias("bought"), nets["export_kwh"].alias("sold"))
    names = {"c": "total_consumption_kwh", "s": "total_solar_kwh", "bought": "total_import_kwh", "sold": "total_export_kwh"}
    out = day.groupBy("grid_zone", "sim_date").agg(*[F.sum(c).cast(TOTAL).alias(n) for c, n in names.items()], F.sum("meters").alias("active_meters"), F.sum("n").alias("readings_count"))
    out = out.withColumn("renewable_ratio", renewable_ratio(F.col("total_solar_kwh"), F.col("total_consumption_kwh")))
    windows = fine.groupBy("grid_zone", "window_start").agg(F.sum("c").cast(TOTAL).alias("total_consumption_kwh"))
    return out.join(peak_windows(windows), ["grid_zone", "sim_date"])


def cross_check(zones: DataFrame, households: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Per day the difference of the zones' and the households' totals, and whether it is within tolerance."""
    z = zones.groupBy("sim_date").agg(F.sum("total_consumption_kwh").cast(TOTAL).alias("zone_kwh"))
    h = households.groupBy("sim_date").agg(F.sum("consumption_kwh").cast(TOTAL).alias("household_kwh"))
    out = z.join(h, "sim_date", "full").withColumn("gap_kwh", F.abs(F.coalesce("zone_kwh", F.lit(0)) - F.coalesce("household_kwh", F.lit(0))).cast(TOTAL))
    return out.withColumn("within", F.col("gap_kwh") <= F.lit(s.cross_check_kwh).cast(TOTAL))


def latest_by_zone(windows: DataFrame) -> DataFrame:
    """The newest window of each zone."""
    rest = [c for c in windows.columns if c not in ("grid_zone", "window_start")]
    return windows.groupBy("grid_zone").agg(F.max(F.struct("window_start", *rest)).alias("m")).select("grid_zone", "m.*")


def retained(windows: DataFrame, as_of, s: Settings = SETTINGS) -> DataFrame:
    """Windows that are not older than the retention before the day as_of."""
    return windows.where(F.col("window_start") >= F.date_sub(as_of, s.window_retention_days))


def window_table(spark: SparkSession, path: str) -> Table:
    """The speed layer's windows, in buckets by day."""
    return Table(spark, path, ["grid_zone", "window_start"], F.to_date("window_start"))


def publish_rollup(ledger: RunLedger, root: str, runs: dict, zone_days: DataFrame, windows: Table, s: Settings = SETTINGS) -> int:
    """The authoritative zone rows of days (runs: sim_date to run_id) become the current ones in one step, and windows
    older than the retention before the newest of these days go: whole buckets, by a new manifest, no row read. How
    many went. A run that fails publishes and retires nothing; one that breaks off in between leaves old windows for
    the next one to retire."""
    publish_days(ledger, root, runs, {"zone_days": zone_days}, "zone_days", layer="rollup")
    oldest = (max(runs) - timedelta(days=s.window_retention_days)).isoformat()
    return windows.retire(lambda day: day >= oldest)


def grid_totals(windows: DataFrame) -> DataFrame:
    """All zones together by window, and each window's share of sunshine."""
    out = windows.groupBy("window_start").agg(F.sum("total_consumption_kwh").cast(TOTAL).alias("consumption_kwh"), F.sum("total_solar_kwh").cast(TOTAL).alias("solar_kwh"), F.count("*").alias("zones"))
    return out.withColumn("renewable_ratio", renewable_ratio(F.col("solar_kwh"), F.col("consumption_kwh")))
