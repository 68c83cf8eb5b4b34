"""Summaries over bills, windows, rejects, reconciliation and runs: what dashboards and checks ask for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.operators import ledger, reconcile
from gridloom.types import SETTINGS, TOTAL, Settings

AMOUNT = "decimal(18,2)"


def on_day(rows: DataFrame, day: str, column: str = "sim_date") -> DataFrame:
    """A day's rows."""
    return rows.where(F.col(column) == F.lit(day).cast("date"))


def bill_of(bills: DataFrame, household: str, day: str) -> DataFrame:
    """One household's bill of a day."""
    return on_day(bills, day).where(F.col("household_id") == household)


def latest_ratio(windows: DataFrame) -> DataFrame:
    """Each zone's renewable ratio in its newest window."""
    return windows.groupBy("grid_zone").agg(F.max_by("renewable_ratio", "window_start").alias("renewable_ratio"))


def billing_summary(bills: DataFrame, day: str) -> DataFrame:
    """Bills of a day, their sum and the energy sold; no row for a day without bills."""
    total = lambda name, kind: F.coalesce(F.sum(name), F.lit(0)).cast(kind)
    out = on_day(bills, day).agg(F.count("*").alias("bills"), total("final_bill", AMOUNT).alias("billed"), total("export_kwh", TOTAL).alias("exported"))
    return out.where("bills > 0")


def rejects_since(marked: DataFrame, since: Column) -> DataFrame:
    """Rejects by reason that came in from an instant on, most frequent first."""
    found = marked.where(F.col("reason").isNotNull() & (F.col("ingest_ts") >= since))
    return found.groupBy("reason").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "reason")


def rejects_of_day(letters: DataFrame, day: str, stage: str = "speed") -> DataFrame:
    """A stage's dead letters by reason whose reading is of a day, as their payload tells."""
    dated = letters.withColumn("sim_date", F.to_date(F.substring(F.get_json_object("raw_payload", "$.event_ts"), 1, 10)))
    return on_day(dated, day).where(F.col("stage") == stage).groupBy("reason").agg(F.count("*").alias("n"))


def reconciliation_means(rows: DataFrame) -> DataFrame:
    """Pairs of each day and the means of their gaps, in money and in percent."""
    return rows.groupBy("sim_date").agg(F.count("*").alias("n"), reconcile.mean("abs_divergence", 2).alias("mean_abs"), reconcile.mean("pct_divergence", 3).alias("mean_pct"))


def divergence_by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sim_date").agg(reconcile.mean("pct_divergence", 3).alias("mean_pct"), F.max("pct_divergence").alias("max_pct"))


def divergence_histogram(rows: DataFrame, width: int = 5, buckets: int = 20) -> DataFrame:
    """Pairs by percent of divergence in buckets of a width, the last one open."""
    bucket = F.least(F.floor(F.col("pct_divergence").cast("double") / width), F.lit(buckets))
    return rows.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def effects_by_day(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sim_date").agg(*[F.sum(c).cast(AMOUNT).alias(c) for c in ("tariff_effect", "data_effect")])


def bill_sanity(bills: DataFrame) -> DataFrame:
    """By day: bills below zero, of idle households, without energy, and all."""
    odd = {"negative": F.col("final_bill") < 0, "idle": F.col("readings_count") == 0, "no_kwh": F.col("consumption_kwh").isNull()}
    return bills.groupBy("sim_date").agg(*[F.count_if(c).alias(n) for n, c in odd.items()], F.count("*").alias("bills"))


def bill_row_count(bills: DataFrame, roster: DataFrame) -> DataFrame:
    """By day the bills, the households there are, and whether the two agree."""
    expected = roster.agg(F.count("*").alias("expected"))  # one row
    counted = bills.groupBy("sim_date").agg(F.count("*").alias("bills"))
    return counted.crossJoin(F.broadcast(expected)).withColumn("ok", F.col("bills") == F.col("expected"))


def offset_gaps(records: DataFrame) -> DataFrame:
    """By partition the first and last offset, those seen, and how many between them are missing."""
    out = records.groupBy("partition").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi"), F.count_distinct("offset").alias("seen"))
    return out.withColumn("missing", F.col("hi") - F.col("lo") + 1 - F.col("seen"))


def tariff_age(estimates: DataFrame) -> DataFrame:
    """By day the estimates, and those at the tariff of the day before."""
    return estimates.groupBy("sim_date").agg(F.count("*").alias("bills"), F.count_if(F.col("tariff_source_date") == F.date_sub("sim_date", 1)).alias("at_yesterdays"))


def newest_window(windows: DataFrame) -> DataFrame:
    return windows.agg(F.max("window_start").alias("newest"), F.count("*").alias("n"))


def newest_billed_day(runs: DataFrame) -> DataFrame:
    return ledger.finalised_days(runs).agg(F.max("sim_date").alias("sim_date"))


def status_counts(runs: DataFrame) -> DataFrame:
    return runs.groupBy("status").agg(F.count("*").alias("n"))


def reconciled_days(rows: DataFrame) -> DataFrame:
    """Days with reconciled pairs, the newest first."""
    return rows.select("sim_date").distinct().orderBy(F.desc("sim_date"))


def speed_lag(windows: DataFrame, now: Column, s: Settings = SETTINGS) -> DataFrame:
    """How far the newest window is behind the simulated present, in simulated and in real seconds."""
    behind = F.unix_micros(now) - F.unix_micros(F.max("window_end"))
    out = windows.agg(behind.alias("us"))
    return out.select((F.col("us") / 1_000_000).alias("lag_sim_s"), F.round(F.col("us") / (1_000_000 * s.time_scale), 6).alias("lag_real_s"))


def clock_anchor(windows: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """The real instant of the simulated clock's epoch: the least over all windows."""
    since = F.unix_micros("window_start") - F.unix_micros(F.lit(s.epoch).cast("timestamp"))
    return windows.agg(F.min(F.unix_micros("updated_at") - F.floor(since / s.time_scale)).alias("us")).select(F.timestamp_micros("us").alias("anchor"))


def tier_utilisation(tiers: DataFrame, width: Column) -> DataFrame:
    """How much of each bounded block is used, in percent of its width."""
    bounded = tiers.where("up_to_kwh IS NOT NULL")
    return bounded.withColumn("used_pct", F.round(F.col("kwh") / width * 100, 2).cast("decimal(7,2)"))


def daily_report(priced: DataFrame, zone_days: DataFrame, runs: DataFrame, marked: DataFrame) -> DataFrame:
    """A row for each day that has a run, bills or zone rows: what the report shows, with nulls for parts that are not
    there, and flags that tell which are. Bills and their reconciliation come from one pass over priced household days
    (reconcile.priced_layers). Each part is aggregated by day by itself; the few rows of all parts meet in one
    aggregation, not in joins."""
    day = F.to_date("event_ts").alias("sim_date")
    some = lambda n: F.nullif(n, F.lit(0).cast("long"))
    rows = priced.select("sim_date", *reconcile.sides(), *[F.when(F.col("bill").isNotNull(), F.col(c)).alias(c) for c in ("batch_kwh", "readings_count")])
    rows = rows.select("sim_date", "batch_final", "batch_kwh", "readings_count", *reconcile.gaps())
    parts = [
        rows.groupBy("sim_date").agg(
            some(F.count("batch_final")).alias("bills"), F.sum("batch_final").cast(AMOUNT).alias("billed"), F.sum("batch_kwh").cast(TOTAL).alias("kwh"), F.sum("readings_count").alias("readings"),
            some(F.count("abs_divergence")).alias("reconciled"), reconcile.mean("abs_divergence", 2).alias("mean_abs"), reconcile.mean("pct_divergence", 3).alias("mean_pct"),
        ),
        zone_days.groupBy("sim_date").agg(F.count("*").alias("zones"), F.sum("total_consumption_kwh").cast(TOTAL).alias("zone_kwh")),
        runs.groupBy("sim_date").agg(F.count("*").alias("runs"), F.bool_or(F.col("status") == "superseded").alias("restated"), F.bool_or((F.col("status") == "success") & (F.col("layer") == "batch")).alias("finalised")),
        marked.where("reason IS NOT NULL").groupBy(day).agg(F.count("*").alias("rejected")),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part, allowMissingColumns=True)
    out = every.groupBy("sim_date").agg(*[F.max(c).alias(c) for c in every.columns if c != "sim_date"]).where("coalesce(runs, bills, zones) IS NOT NULL")
    flags = {"has_bills": "bills", "has_rollup": "zones", "has_reconciliation": "reconciled"}
    out = out.withColumns({name: F.col(part).isNotNull() for name, part in flags.items()})
    return out.withColumns({"finalised": F.coalesce("finalised", F.lit(False)), "restated": F.coalesce("restated", F.lit(False)), "rejected": F.coalesce("rejected", F.lit(0))})


def on_real_axis(windows: DataFrame, anchor: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """windows with their ends on the real clock, from a one-row table of its anchor (clock_anchor)."""
    since = lambda name: F.floor((F.unix_micros(name) - F.unix_micros(F.lit(s.epoch).cast("timestamp"))) / s.time_scale)
    both = windows.crossJoin(F.broadcast(anchor.limit(1)))
    return both.withColumns({f"real_{end}": F.timestamp_micros(F.unix_micros("anchor") + since(f"window_{end}")) for end in ("start", "end")}).drop("anchor")
