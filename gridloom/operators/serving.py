"""What is served: final bills where a day is closed, else estimates; point and range reads; the waterfall."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.types import MONEY, SETTINGS, Settings

_KEY = ["household_id", "sim_date"]


def merged_bills(priced: DataFrame, finalised: DataFrame) -> DataFrame:
    """Of household days priced by both layers (reconcile.priced_layers) the batch's bill where the day is finalised
    and has one, else the estimate (provisional), else nothing."""
    closed = finalised.select("sim_date", F.lit(True).alias("closed")).distinct()
    final = F.col("closed").isNotNull() & F.col("bill").isNotNull()
    out = priced.join(closed, "sim_date", "left").where(final | F.col("estimate").isNotNull())
    date = F.when(final, F.col("bill.tariff_date")).otherwise(F.date_sub("sim_date", 1))
    return out.select(*_KEY, F.when(final, F.col("bill.total")).otherwise(F.col("estimate")).alias("total"), (~final).alias("provisional"), date.alias("tariff_date"), F.when(final, F.col("readings_count")).alias("readings_count"))


def bill_delta(priced: DataFrame) -> DataFrame:
    """Estimate, bill, their difference and its percentage of gross charges, with the effects where there are both."""
    s, b = F.col("estimate"), F.col("bill.total")
    delta, gross = (s - b).cast(MONEY), F.col("bill.energy_charge") + F.col("bill.fixed_charge")
    pct = F.when(delta.isNull(), None).when(gross == 0, F.lit(0)).otherwise(F.round(100 * F.abs(delta) / gross, 3)).cast("decimal(12,3)")
    effects = (s - F.col("own")).cast(MONEY).alias("tariff_effect"), (F.col("own") - b).cast(MONEY).alias("data_effect")
    return priced.select(*_KEY, s.alias("speed_estimate"), b.alias("batch_final"), delta.alias("delta"), pct.alias("pct"), *effects)


def waterfall(bills: DataFrame) -> DataFrame:
    """Steps of a bill with their running total: energy, fixed, less subsidy, less credit."""
    steps = F.expr("stack(4, 1, 'energy', energy_charge, 2, 'fixed', fixed_charge, 3, 'subsidy', cast(-subsidy_amount AS decimal(12,2)), 4, 'credit', cast(-export_credit AS decimal(12,2))) AS (step, name, amount)")
    out = bills.select(*_KEY, steps)
    run = Window.partitionBy(*_KEY).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return out.withColumn("running_total", F.sum("amount").over(run).cast(MONEY))


def zone_history(windows: DataFrame, start: str, end: str, zone: str | None = None) -> DataFrame:
    """Windows that start from start on and before end, of one zone or of all, in order."""
    out = windows.where((F.col("window_start") >= F.lit(start).cast("timestamp")) & (F.col("window_start") < F.lit(end).cast("timestamp")))
    return (out.where(F.col("grid_zone") == zone) if zone else out).orderBy("grid_zone", "window_start")


def history_minutes(minutes: int, s: Settings = SETTINGS) -> int:
    low, high = s.history_minutes
    if not low <= minutes <= high:
        raise ValueError(f"minutes must be {low} to {high}")
    return minutes


def _table(rows: list[dict]) -> list[str]:
    show = lambda v: "—" if v is None else f"{v:,}" if isinstance(v, int) and not isinstance(v, bool) else str(v)
    return ["| " + " | ".join(rows[0]) + " |", "|" + "---|" * len(rows[0]), *["| " + " | ".join(map(show, r.values())) + " |" for r in rows]]


def render_report(sim_date: str, summary: dict, zones: list[dict], rejects: list[dict], runs: list[dict]) -> str:
    """The day's report as Markdown, from its row of daily_report and the day's zone rows, rejects by reason and runs:
    a few rows each. Parts that are not there say so; absent values are dashes."""
    state = "final" if summary.get("finalised") else "provisional: no billing run has closed this day"
    lines = [f"# Report for {sim_date}", "", f"State: {state}."]
    if summary.get("restated"):
        lines += ["", "This day was restated: the figures are those of the run that counts, earlier runs are listed below."]
    money = {"bills": "Bills", "billed": "Billed", "kwh": "Energy (kWh)", "readings": "Readings"}
    gap = {"reconciled": "Households compared", "mean_abs": "Mean gap", "mean_pct": "Mean gap (%)"}
    sections = [
        ("Zones", zones if summary.get("has_rollup", bool(zones)) else [], "No zone rows for this day yet."),
        ("Bills", [{label: summary.get(k) for k, label in money.items()}] if summary.get("has_bills") else [], "No final bills for this day yet."),
        ("Rejected readings", rejects, "None."),
        ("Estimates against bills", [{label: summary.get(k) for k, label in gap.items()}] if summary.get("has_reconciliation") else [], "Not reconciled yet."),
        ("Runs", runs, "None recorded."),
    ]
    for title, rows, without in sections:
        lines += ["", f"## {title}", "", *(_table(rows) if rows else [without])]
    return "\n".join(lines) + "\n"
