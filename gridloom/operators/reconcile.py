"""Speed estimates against final bills: pairing, counterfactual price, effects, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.functions.tariff import bill, pct_divergence
from gridloom.operators.billing import as_of, fault
from gridloom.types import MONEY

_KEY = ["household_id", "sim_date"]


def _effects(paired: DataFrame) -> DataFrame:
    """From S, B and C (speed_estimate, batch_final, at_own_tariff) the gap, its share of B's gross charges, and its
    parts: tariff_effect = S - C, data_effect = C - B."""
    return paired.select(
        *_KEY, "speed_estimate", "batch_final", *gaps(),
        (F.col("speed_estimate") - F.col("at_own_tariff")).cast(MONEY).alias("tariff_effect"), (F.col("at_own_tariff") - F.col("batch_final")).cast(MONEY).alias("data_effect"),
        "speed_kwh", "batch_kwh",
    )


def gaps() -> list[Column]:
    """abs_divergence and pct_divergence of S and B; null where one of them is."""
    gap = F.abs(F.col("speed_estimate") - F.col("batch_final")).cast(MONEY)
    share = F.when(gap.isNotNull(), pct_divergence(gap, F.col("b_energy"), F.col("b_fixed")))
    return [gap.alias("abs_divergence"), share.alias("pct_divergence")]


def reconciliation(speed: DataFrame, batch: DataFrame, tariff: DataFrame) -> DataFrame:
    """Matched household days with S (estimate), B (final bill) and C (speed energy at the tariff in force on the day):
    tariff_effect = S - C, data_effect = C - B; the percentage is of B's gross charges. A matched household without a
    tariff in force that day, or with two, fails the query: a guess would put an invented number into the effects."""
    s = speed.select(*_KEY, F.col("consumption_kwh").alias("speed_kwh"), "solar_kwh", F.col("estimated_bill").alias("speed_estimate"))
    b = batch.select(*_KEY, F.col("final_bill").alias("batch_final"), F.col("energy_charge").alias("b_energy"), F.col("fixed_charge").alias("b_fixed"), F.col("consumption_kwh").alias("batch_kwh"))
    held = as_of(s.join(b, _KEY), tariff, 0).where(fault("tariff_0").isNull())
    return _effects(held.withColumn("at_own_tariff", bill(F.col("speed_kwh"), F.col("solar_kwh"), "tariff_0.")["total"]))


def priced_layers(layers: DataFrame, tariff: DataFrame) -> DataFrame:
    """Both layers' bills of household days (billing.layered_totals) in one row and one pass: the tariffs of the day
    and of the day before are looked up together. bill is null without a tariff on the day, estimate without a reading
    in time or a tariff the day before, own (the estimate's energy at the day's own tariff) if either is. A day that
    the batch has readings of and that has no tariff, or two, fails the query."""
    held = as_of(layers, tariff, 0, 1).where(fault("tariff_0", F.col("batch_readings") > 0).isNull())
    speed, batch = ((F.col(f"{layer}_consumption_kwh"), F.col(f"{layer}_solar_kwh")) for layer in ("speed", "batch"))
    told = (F.col("speed_readings") > 0) & F.col("tariff_1").isNotNull()
    held = held.where(F.when(told, fault("tariff_1")).isNull())
    final = bill(*batch, "tariff_0.")
    names = ("total", "energy_charge", "fixed_charge")
    return held.select(
        *_KEY, F.when(F.col("tariff_0").isNotNull(), F.struct(*[final[n].alias(n) for n in names], F.col("tariff_0.effective_date").alias("tariff_date"))).alias("bill"),
        F.when(told, bill(*speed, "tariff_1.")["total"]).alias("estimate"), F.when(told & F.col("tariff_0").isNotNull(), bill(*speed, "tariff_0.")["total"]).alias("own"),
        speed[0].alias("speed_kwh"), batch[0].alias("batch_kwh"), F.col("batch_readings").alias("readings_count"),
    ).where("bill IS NOT NULL OR estimate IS NOT NULL")


def reconciled_layers(priced: DataFrame) -> DataFrame:
    """The reconciliation of those household days of priced_layers that have both bills."""
    both = priced.where("bill IS NOT NULL AND estimate IS NOT NULL")
    return _effects(both.select(*_KEY, *sides(), "speed_kwh", "batch_kwh"))


def sides() -> list[Column]:
    """S, B, C and B's charges of a row of priced_layers; null where it has no such bill."""
    named = {"speed_estimate": "estimate", "batch_final": "bill.total", "at_own_tariff": "own", "b_energy": "bill.energy_charge", "b_fixed": "bill.fixed_charge"}
    return [F.col(c).alias(n) for n, c in named.items()]


def unmatched(priced: DataFrame) -> DataFrame:
    """Household days that only one layer has a bill of."""
    one = priced.where(F.col("bill").isNull() | F.col("estimate").isNull())
    return one.select(*_KEY, F.when(F.col("bill").isNull(), "speed_only").otherwise("batch_only").alias("side"))


def mean(name: str, places: int):
    """Mean of a decimal column, half up; null without values."""
    return F.round(F.sum(F.col(name)) / F.nullif(F.count(name), F.lit(0).cast("long")), places)


def shortfall(speed: Column, batch: Column) -> Column:
    """Energy that the estimates lack in percent of the batch's, from sums."""
    return F.when(batch > 0, F.round(100 * (batch - speed) / batch, 3)).alias("kwh_shortfall_pct")


def divergence_summary(rows: DataFrame) -> DataFrame:
    """One row for each day: means and maximum of the divergence, share of the tariff in all effects, energy that the
    speed view lacks in percent of the batch's. One aggregation of reconciled rows."""
    size = lambda c: F.sum(F.abs(F.col(c)))
    parts = [F.count("*").alias("households"), mean("pct_divergence", 3).alias("mean_pct"), F.max("pct_divergence").alias("max_pct"), mean("abs_divergence", 2).alias("mean_abs")]
    out = rows.groupBy("sim_date").agg(*parts, size("tariff_effect").alias("t"), size("data_effect").alias("d"), F.sum("speed_kwh").alias("s"), F.sum("batch_kwh").alias("b"))
    share = F.when(F.col("t") + F.col("d") > 0, F.round(100 * F.col("t") / (F.col("t") + F.col("d")), 2))
    return out.withColumns({"tariff_share_pct": share, "kwh_shortfall_pct": shortfall(F.col("s"), F.col("b"))}).drop("t", "d", "s", "b")


def kwh_shortfall(rows: DataFrame) -> DataFrame:
    """Per day, over the household days on both sides: energy that the estimate lacks, in percent."""
    return rows.groupBy("sim_date").agg(F.sum("batch_kwh").alias("b"), F.sum("speed_kwh").alias("s")).select("sim_date", shortfall(F.col("s"), F.col("b")))
