"""Readings to bills: deduplication, daily totals, tariffs as of a day, bills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.tariff import bill
from gridloom.types import KWH


def exact_sum(name: str):
    """Sum of a decimal(12,4) column through its unscaled long: exact, and on the fast path of aggregation."""
    return (F.sum((F.col(name) * 10000).cast("long")).cast("decimal(38,0)") / F.lit(10000).cast("decimal(5,0)")).cast(KWH)


def dedup_earliest(raw: DataFrame) -> DataFrame:
    """Of readings with one meter_id and event_ts the one that came first; ties go to the smallest event_id.

    An aggregation, so that copies go before the shuffle."""
    whole, order = F.struct(*raw.columns), F.struct("ingest_ts", "event_id")
    return raw.groupBy("meter_id", "event_ts").agg(F.min_by(whole, order).alias("first")).select("first.*")


def layered_totals(marked: DataFrame, late: str, also: DataFrame | None = None) -> DataFrame:
    """Household days of both layers from one pass over marked readings (reason is null for valid ones): batch_ columns
    of readings deduplicated first and validated then, speed_ columns of readings validated first, deduplicated then,
    and in time (they arrived within the interval late). Household days of also (household_id, sim_date) that no
    reading is of have zeros."""
    order, row = F.struct("ingest_ts", "event_id"), F.struct("household_id", "event_ts", "ingest_ts", "consumption_kwh", "solar_generation_kwh", "reason")
    one = marked.groupBy("meter_id", "event_ts").agg(F.min_by(row, order).alias("b"), F.min_by(row, F.when(F.col("reason").isNull(), order)).alias("s"))
    in_time = F.col("s.ingest_ts") <= F.col("s.event_ts") + F.expr(f"INTERVAL {late}")
    sides = F.array(F.when(F.col("b.reason").isNull(), F.struct(F.lit("batch").alias("layer"), "b.*")), F.when(F.col("s.reason").isNull() & in_time, F.struct(F.lit("speed").alias("layer"), "s.*")))
    rows = one.select(F.explode(F.filter(sides, lambda x: x.isNotNull())).alias("r")).select("r.*", F.to_date("r.event_ts").alias("sim_date"))
    rows = rows.select("household_id", "sim_date", "layer", "consumption_kwh", "solar_generation_kwh")
    if also is not None:
        rows = rows.unionByName(also.select("household_id", "sim_date"), allowMissingColumns=True)
    parts = []
    for layer in ("batch", "speed"):
        mine = F.coalesce(F.col("layer") == layer, F.lit(False))
        for name, kwh in (("consumption_kwh", "consumption_kwh"), ("solar_kwh", "solar_generation_kwh")):
            total = F.sum(F.when(mine, (F.col(kwh) * 10000).cast("long")).otherwise(F.lit(0).cast("long")))
            parts.append((total.cast("decimal(38,0)") / F.lit(10000).cast("decimal(5,0)")).cast(KWH).alias(f"{layer}_{name}"))
        parts.append(F.count_if(mine).alias(f"{layer}_readings"))
    return rows.groupBy("household_id", "sim_date").agg(*parts)


def duplicates_removed(raw: DataFrame) -> DataFrame:
    """Readings less distinct (meter, time) pairs by household; pairs with a null count as removed."""
    return raw.groupBy("household_id").agg(F.count("*").alias("readings"), (F.count("*") - F.count_distinct("meter_id", "event_ts")).alias("duplicates_removed"))


def household_daily(valid: DataFrame) -> DataFrame:
    return valid.groupBy("household_id", F.to_date("event_ts").alias("sim_date")).agg(exact_sum("consumption_kwh").alias("consumption_kwh"), exact_sum("solar_generation_kwh").alias("solar_kwh"), F.count("*").alias("readings_count"))


def every_day(totals: DataFrame, tariff: DataFrame) -> DataFrame:
    """The days of totals, and those on which a tariff begins."""
    return totals.select("sim_date").union(tariff.select("effective_date")).distinct()


def tariff_effective(tariff: DataFrame, days: DataFrame) -> DataFrame:
    """The tariff in force on each sim_date of days: by household the latest with effective_date <= sim_date, and
    rows_in_force, how many there are of that date (more than one: none may be billed).

    A tariff holds until the day before the next one: it is laid out over its own days, which meet days by
    equality, so the work is that of the result."""
    terms = [c for c in tariff.columns if c not in ("household_id", "effective_date")]
    same = Window.partitionBy("household_id", "effective_date")
    dated = tariff.withColumns({"rows_in_force": F.count("*").over(same), "__n": F.row_number().over(same.orderBy(*terms))}).where("__n = 1").drop("__n")
    ends = days.agg(F.min("sim_date").alias("a"), F.max("sim_date").alias("b"))  # one row
    following = F.lead("effective_date").over(Window.partitionBy("household_id").orderBy("effective_date"))
    spans = dated.withColumn("until", F.date_sub(following, 1)).crossJoin(F.broadcast(ends))
    spans = spans.withColumns({"since": F.greatest("effective_date", "a"), "until": F.least("until", "b")}).where("since <= until")
    laid = spans.select("household_id", "effective_date", *terms, "rows_in_force", F.explode(F.sequence("since", "until")).alias("sim_date"))
    return laid.join(days.select("sim_date").distinct(), "sim_date", "left_semi").select(*tariff.columns, "sim_date", "rows_in_force")


def tariff_ties(tariff: DataFrame, days: DataFrame) -> DataFrame:
    """Households with more than one tariff of the latest effective date on a day: none may be billed."""
    return tariff_effective(tariff, days).where("rows_in_force > 1").select("household_id", "sim_date", "effective_date", "rows_in_force")


def missing_tariff(totals: DataFrame, tariff: DataFrame) -> DataFrame:
    """Household days of totals on which no tariff is in force."""
    return totals.join(tariff_effective(tariff, totals.select("sim_date").distinct()), ["household_id", "sim_date"], "left_anti").select("household_id", "sim_date")


def as_of(rows: DataFrame, tariff: DataFrame, *lags: int) -> DataFrame:
    """rows (household_id, sim_date, ...) with a struct tariff_<lag> for each lag: the tariff in force that many days
    before sim_date, the latest that began by then (null if there is none), and rows_in_force, how many there are of
    its date.

    Rows and tariffs of a household are put in one order of days and the last tariff is looked up from there: one
    shuffle by household for all lags, and work in proportion to rows and tariffs, however sparse these are."""
    day = Window.partitionBy("household_id").orderBy("day")
    held = F.struct(*[c for c in tariff.columns if c != "household_id"])
    known = tariff.select("household_id", F.unix_date("effective_date").alias("day"), held.alias("terms"), F.lit(None).cast(rows.schema).alias("row"))
    empty = F.lit(None).cast(known.schema["terms"].dataType).alias("terms")
    asked = rows.select("household_id", F.unix_date("sim_date").alias("day"), empty, F.struct(*rows.columns).alias("row"))
    both = known.unionByName(asked).withColumn("n", F.count("terms").over(day.rangeBetween(0, 0)))
    both = both.withColumn("tariff", F.when(F.col("terms").isNotNull(), F.struct("terms.*", F.col("n").alias("rows_in_force"))))
    found = {f"tariff_{lag}": F.last("tariff", ignorenulls=True).over(day.rangeBetween(Window.unboundedPreceding, -lag)) for lag in lags}
    return both.select("row", *[c.alias(n) for n, c in found.items()]).where("row IS NOT NULL").select("row.*", *found)


def fault(held: str, where: Column | None = None) -> Column:
    """Null, or an error naming the household and day: with no tariff in the struct held, or with two in force."""
    place = F.concat(F.col("household_id"), F.lit(" on "), F.col("sim_date").cast("string"))
    absent = F.col(held).isNull() if where is None else F.col(held).isNull() & where
    return F.when(absent, F.raise_error(F.concat(F.lit("no tariff for "), place))).when(F.col(f"{held}.rows_in_force") > 1, F.raise_error(F.concat(F.lit("two tariffs for "), place))).cast("string")


def billable(totals: DataFrame, tariff: DataFrame, days: DataFrame) -> DataFrame:
    """Totals of days with the tariff in force; a household without readings has zeros.

    Totals without a tariff, and tariffs of which two are in force, fail the query that reads them."""
    held = tariff_effective(tariff, days).withColumnRenamed("effective_date", "tariff_effective_date").withColumn("__held", F.lit(True))
    both = held.join(totals.join(days.select("sim_date").distinct(), "sim_date", "left_semi"), ["household_id", "sim_date"], "full")
    where = F.concat(F.col("household_id"), F.lit(" on "), F.col("sim_date").cast("string"))
    fault = F.when(F.col("__held").isNull(), F.raise_error(F.concat(F.lit("no tariff for "), where))).when(F.col("rows_in_force") > 1, F.raise_error(F.concat(F.lit("two tariffs for "), where)))
    zero = {"consumption_kwh": F.lit(0).cast(KWH), "solar_kwh": F.lit(0).cast(KWH), "readings_count": F.lit(0).cast("long")}
    out = both.where(fault.cast("string").isNull()).withColumns({n: F.coalesce(n, z) for n, z in zero.items()})
    return out.select(*totals.columns, *[c for c in held.columns if c not in (*totals.columns, "rows_in_force", "__held")])


def price(joined: DataFrame, total: str) -> DataFrame:
    """Totals joined with tariff columns to bills, the sum under the name given. Charges of the tariff are replaced."""
    parts = bill(F.col("consumption_kwh"), F.col("solar_kwh"))
    keep = [F.col(c) for c in joined.columns if c not in parts]
    return joined.select(*keep, *[c.alias(total if n == "total" else n) for n, c in parts.items()])


def idle_households(totals: DataFrame, tariff: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Zero totals for those with a tariff in force on a day but no reading."""
    return billable(totals, tariff, every_day(totals, tariff) if days is None else days).where("readings_count = 0").select(*totals.columns)


def daily_bills(totals: DataFrame, tariff: DataFrame, days: DataFrame | None = None) -> DataFrame:
    """Final bills of days (sim_date; every_day if none are given): all households with a tariff in force, idle
    ones included, at that tariff. A total without a tariff, or with two, fails the query."""
    return price(billable(totals, tariff, every_day(totals, tariff) if days is None else days), "final_bill")


def provisional_bills(totals: DataFrame, tariff: DataFrame) -> DataFrame:
    """Estimates at the tariff in force on the day before (tariff_source_date), whenever it began; totals without one
    give none, two of one date fail the query."""
    held = as_of(totals, tariff, 1).where("tariff_1 IS NOT NULL").where(fault("tariff_1").isNull())
    terms = [c for c in tariff.columns if c not in ("household_id", "effective_date")]
    joined = held.select(*totals.columns, *[f"tariff_1.{c}" for c in terms], F.date_sub("sim_date", 1).alias("tariff_source_date"))
    return price(joined, "estimated_bill")


def tier_rows(bills: DataFrame) -> DataFrame:
    """A row for each block of each bill."""
    return bills.select("household_id", "sim_date", F.explode("tier_breakdown").alias("t")).select("household_id", "sim_date", "t.*")
