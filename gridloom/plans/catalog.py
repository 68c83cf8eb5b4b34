"""Every registered query: its DataFrame, and the same rows in SQL over the relations of the oracle."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import clock, latency, rules
from gridloom.functions.tariff import block_rows, netting, slabs, tier_json
from gridloom.operators import alerts, billing, ledger, reconcile, rollups, serving, simulate, summaries
from gridloom.plans import oracle
from gridloom.plans.lake import lake, published_rollup, scratch
from gridloom.plans.world import World, presentable
from gridloom.sources import readings as log
from gridloom.sources import sinks
from gridloom.sources.tables import Table
from gridloom.streaming import speed
from gridloom.types import KWH, SETTINGS, Settings

DAY, NOW, FALLBACK = "2024-01-10", "2024-06-01 03:00:00", "2024-05-01 00:00:00"


def at(text: str):
    return F.lit(text).cast("timestamp")


@dataclass(frozen=True)
class Entry:
    make: Callable[[World], DataFrame]
    columns: str
    source: str
    more: dict[str, str] | None = None

    @property
    def names(self) -> list[str]:
        return [c.partition("=")[0].partition(":")[0].strip() for c in self.columns.split("; ")]


def day(df: DataFrame, column: str = "sim_date") -> DataFrame:
    return df.where(F.col(column) == F.lit(DAY).cast("date"))


_BILL = (
    "household_id; sim_date:d; consumption_kwh:n; solar_kwh:n; self_consumed_kwh:n; billable_import_kwh:n; export_kwh:n; "
    "energy_charge:n; fixed_charge:n; subsidy_amount:n; export_credit:n; "
)
_WINDOW = "grid_zone; window_start:t; window_end:t; total_consumption_kwh:n; total_solar_kwh:n; renewable_ratio:n; active_meters:i"
_READING = "event_id:i; meter_id; household_id; grid_zone; event_ts:t; consumption_kwh:n; solar_generation_kwh:n"
_ZONE_DAY = (
    "grid_zone; sim_date:d; total_consumption_kwh:n; total_solar_kwh:n; total_import_kwh:n; total_export_kwh:n; renewable_ratio:n; "
    "active_meters:i; readings_count:i; peak_window_start:t; peak_consumption_kwh:n"
)
_TARIFF = (
    "household_id; effective_date:d; billing_tier; subsidy_flag; subsidy_pct:n; fixed_charge:n; block_1_rate:n; block_2_rate:n; "
    "block_3_rate:n; export_rate:n"
)
_REC = "household_id; sim_date:d; speed_estimate:n; batch_final:n; abs_divergence:n; pct_divergence:n; tariff_effect:n; data_effect:n"
_TIERS = {
    "tiers": " UNION ALL ".join(f"SELECT household_id, sim_date, 'block_{k}' AS name, {k} AS k, block_{k}_rate AS rate, kwh_{k} AS kwh, charge_{k} AS charge, {up} AS up_to_kwh FROM bills" for k, up in ((1, "60.0"), (2, "120.0"), (3, "NULL"))),
}
_TIER_JSON = " || ',' || ".join(
    f"""'{{"name":"block_{k}","up_to_kwh":{up},"rate":' || CAST(block_{k}_rate AS VARCHAR) || ',"kwh":' || CAST(kwh_{k} AS VARCHAR) || ',"charge":' || CAST(charge_{k} AS VARCHAR) || '}}'""" for k, up in ((1, "60.0000"), (2, "120.0000"), (3, "null"))
)
_TIER_JSON = f"'[' || {_TIER_JSON} || ']'"
_AGE = "(epoch_us(TIMESTAMP '{now}') - epoch_us(updated_at)) / 1000000.0"
_LATEST = {"latest": "SELECT * FROM windows QUALIFY row_number() OVER (PARTITION BY grid_zone ORDER BY window_start DESC) = 1"}
_LOW = {
    "low": (
        "SELECT * FROM (SELECT grid_zone, window_start, max(renewable_ratio) OVER r AS highest, count(*) OVER r AS n FROM windows "
        "WINDOW r AS (PARTITION BY grid_zone ORDER BY window_start ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE n = 3 AND highest "
        "< 0.15"
    ),
}
#: Some zones are stale by then at sf0.01, others are not.
_STALE_NOW = "2024-06-01 02:32:28"
#: A threshold that the newest day passes, in percent.
DIVERGES = Settings(divergence_pct=2.0)
_STALE = {
    "stale": (
        f"SELECT grid_zone, {_AGE.format(now=_STALE_NOW)} AS age_seconds FROM latest WHERE {_AGE.format(now=_STALE_NOW)} - 30 > 120"
    ),
}
_RATES = {
    "rates": (
        "SELECT m AS window_start, count(*) AS consumed, count(reason) AS rejected, CAST(count(reason) AS DOUBLE) / count(*) AS rate "
        "FROM (SELECT reason, time_bucket(INTERVAL '1 minute', ingest_ts) - to_minutes(k) AS m FROM marked CROSS JOIN (SELECT "
        "unnest([0, 1, 2, 3, 4]) AS k)) GROUP BY 1"
    ),
}
_SPLIT = {
    "gap_day": "SELECT b.sim_date, CASE WHEN sum(b.consumption_kwh) > 0 THEN " + oracle.ratio("(100 * (sum(b.consumption_kwh) - sum(s.consumption_kwh)))", "sum(b.consumption_kwh)", 3) + " END AS kwh_shortfall_pct FROM bills b JOIN speed_bills s USING (household_id, sim_date) GROUP BY 1",
}
_SIDES = {
    "sides": (
        "SELECT coalesce(s.household_id, b.household_id) AS household_id, coalesce(s.sim_date, b.sim_date) AS sim_date, CASE WHEN "
        "b.household_id IS NULL THEN 'speed_only' ELSE 'batch_only' END AS side FROM speed_bills s FULL JOIN bills b ON s.household_id "
        "= b.household_id AND s.sim_date = b.sim_date WHERE s.household_id IS NULL OR b.household_id IS NULL"
    ),
}
_MERGED = {
    "merged": (
        "SELECT coalesce(b.household_id, s.household_id) AS household_id, coalesce(b.sim_date, s.sim_date) AS sim_date, "
        "coalesce(b.final_bill, s.estimated_bill) AS total, b.final_bill IS NULL AS provisional, CASE WHEN b.final_bill IS NOT NULL "
        "THEN b.tariff_effective_date ELSE s.tariff_source_date END AS tariff_date, b.readings_count FROM (SELECT * FROM bills WHERE "
        "sim_date IN (SELECT sim_date FROM finalised)) b FULL JOIN speed_bills s ON s.household_id = b.household_id AND s.sim_date = "
        "b.sim_date"
    ),
}


_HELD = (
    "(SELECT k.household_id, k.sim_date, t.* EXCLUDE (household_id) FROM {rows} k JOIN sparse t ON t.household_id = k.household_id AND "
    "t.effective_date <= k.sim_date - {lag} QUALIFY row_number() OVER (PARTITION BY k.household_id, k.sim_date ORDER BY "
    "t.effective_date DESC) = 1)"
)
_SPARSE = {
    "sparse": "SELECT * FROM tariff_all WHERE date_diff('day', (SELECT min(sim_date) FROM days), effective_date) % 4 = 0",
    "sparse_speed": (
        f"SELECT household_id, sim_date, consumption_kwh, solar_kwh, {oracle.bill('estimated_bill')} FROM (SELECT s.*, h.* EXCLUDE "
        f"(household_id, sim_date) FROM speed_totals s JOIN {_HELD.format(rows='speed_totals', lag=1)} h USING (household_id, sim_date))"
    ),
    "sparse_own": (
        f"SELECT household_id, sim_date, {oracle.bill('own_total')} FROM (SELECT s.household_id, s.sim_date, s.consumption_kwh, "
        f"s.solar_kwh, h.* EXCLUDE (household_id, sim_date) FROM speed_totals s JOIN {_HELD.format(rows='speed_totals', lag=0)} h USING "
        "(household_id, sim_date))"
    ),
    "sparse_final": (
        f"SELECT household_id, sim_date, fixed_charge, {oracle.bill('final_bill')} FROM (SELECT e.household_id, e.sim_date, "
        f"e.consumption_kwh, e.solar_kwh, h.* EXCLUDE (household_id, sim_date) FROM every e JOIN {_HELD.format(rows='every', lag=0)} h "
        "USING (household_id, sim_date))"
    ),
    "sparse_reconciled": f"""SELECT household_id, sim_date, s.estimated_bill AS speed_estimate, b.final_bill AS batch_final, abs(s.estimated_bill - b.final_bill) AS abs_divergence,
        CASE WHEN b.energy_charge + b.fixed_charge = 0 THEN 0.0 ELSE least({oracle.ratio('abs(s.estimated_bill - b.final_bill) * 100', '(b.energy_charge + b.fixed_charge)', 3, 100)}, 999.999) END AS pct_divergence,
        s.estimated_bill - o.own_total AS tariff_effect, o.own_total - b.final_bill AS data_effect FROM sparse_speed s JOIN sparse_own o USING (household_id, sim_date) JOIN sparse_final b USING (household_id, sim_date)""",
}



def mean_sql(name: str, places: int, scale: int) -> str:
    return f"(2 * CAST(sum(CAST(round({name} * {scale}) AS BIGINT)) AS HUGEINT) * {10**places} + count(*) * {scale}) // (2 * count(*) * {scale}) / {10**places}.0"


_HALF_HOURS = "(SELECT hour(event_ts) + (minute(event_ts) // 30) / 2.0 AS hour, count(*) AS readings, sum({}) AS kwh FROM readings GROUP BY 1)"
_REPORT = (
    "sim_date:d; finalised; restated; has_bills; has_rollup; has_reconciliation; bills:i; billed:n; kwh:n; readings:i; zones:i; "
    "zone_kwh:n; reconciled:i; mean_abs:n; mean_pct:n; runs:i; rejected:i"
)
_REPORTED = {
    "report": f"""SELECT k.sim_date, coalesce(l.finalised, false) AS finalised, coalesce(l.restated, false) AS restated, b.bills IS NOT NULL AS has_bills, z.zones IS NOT NULL AS has_rollup, r.reconciled IS NOT NULL AS has_reconciliation,
        b.bills, b.billed, b.kwh, b.readings, z.zones, z.zone_kwh, r.reconciled, r.mean_abs, r.mean_pct, l.runs, coalesce(x.rejected, 0) AS rejected
        FROM (SELECT sim_date FROM bills UNION SELECT sim_date FROM zone_days UNION SELECT sim_date FROM runs) k
        LEFT JOIN (SELECT sim_date, count(*) AS bills, sum(final_bill) AS billed, sum(consumption_kwh) AS kwh, sum(readings_count) AS readings FROM bills GROUP BY 1) b USING (sim_date)
        LEFT JOIN (SELECT sim_date, count(*) AS zones, sum(total_consumption_kwh) AS zone_kwh FROM zone_days GROUP BY 1) z USING (sim_date)
        LEFT JOIN (SELECT sim_date, count(*) AS reconciled, {mean_sql('abs_divergence', 2, 100)} AS mean_abs, {mean_sql('pct_divergence', 3, 1000)} AS mean_pct FROM reconciled GROUP BY 1) r USING (sim_date)
        LEFT JOIN (SELECT sim_date, count(*) AS runs, bool_or(status = 'superseded') AS restated, bool_or(status = 'success') AS finalised FROM runs GROUP BY 1) l USING (sim_date)
        LEFT JOIN (SELECT CAST(event_ts AS DATE) AS sim_date, count(*) AS rejected FROM marked WHERE reason IS NOT NULL GROUP BY 1) x USING (sim_date)""",
}
_LATENCY = "; ".join(f"le_{k}:i" for k in range(len(latency.BOUNDS)))


def quantile_sql(q: float) -> str:
    """The quantile of the counts le_0, le_1, ..., n by straight lines within the buckets."""
    edges = [0.0, *map(float, latency.BOUNDS)]
    cases = []
    for k in range(len(latency.BOUNDS)):
        below = f"le_{k - 1}" if k else "0"
        cases.append(f"WHEN le_{k} >= {q} * n THEN CAST({edges[k]} AS DOUBLE) + CAST({edges[k + 1] - edges[k]} AS DOUBLE) * (CAST({q} AS DOUBLE) * n - {below}) / (le_{k} - {below})")
    return f"CASE WHEN n > 0 THEN CASE {' '.join(cases)} ELSE {edges[-1]} END END"


_LATENCIES = {
    "waits": (
        "SELECT (epoch_us(told) - epoch_us(TIMESTAMP '2024-06-01') - (epoch_us(event_ts) - epoch_us(TIMESTAMP '2024-01-01')) // 288) / "
        "1000000.0 AS s FROM (SELECT event_ts, TIMESTAMP '2024-06-01 00:00:00' + to_seconds(CAST(date_diff('second', TIMESTAMP "
        "'2024-01-01 00:00:00', time_bucket(INTERVAL '15 minutes', event_ts) + INTERVAL 15 MINUTE) // 288 AS BIGINT)) AS told FROM "
        "speed_valid)"
    ),
    "le": "SELECT " + ", ".join(f"count(*) FILTER (WHERE s <= {b}) AS le_{k}" for k, b in enumerate(latency.BOUNDS)) + ", count(*) AS n FROM waits WHERE s >= 0",
    "latencies": "SELECT *, " + ", ".join(f"{quantile_sql(q)} AS p{round(100 * q)}" for q in (0.5, 0.95, 0.99)) + " FROM le",
}
_ARRIVED = {
    "came": (
        "SELECT *, date_diff('day', (SELECT CAST(min(event_ts) AS DATE) FROM readings), CAST(event_ts AS DATE)) // 5 + CASE WHEN "
        "event_id % 40 = 11 THEN 1 ELSE 0 END AS batch FROM marked WHERE reason IS NULL"
    ),
    "ends": "SELECT batch, max(event_ts) AS newest FROM came GROUP BY 1",
    "marks": (
        "SELECT a.batch, max(b.newest) - INTERVAL 30 MINUTE AS mark FROM (SELECT DISTINCT batch FROM came) a LEFT JOIN ends b ON "
        "b.batch < a.batch GROUP BY 1"
    ),
    "arrived": "SELECT came.*, coalesce(event_ts <= mark, false) AS late FROM came JOIN marks USING (batch)",
    "kept": (
        "SELECT * FROM arrived WHERE NOT late QUALIFY row_number() OVER (PARTITION BY meter_id, event_ts ORDER BY batch, event_id) = 1"
    ),
}


def parse(w: World) -> DataFrame:
    text = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), "meter_id", "household_id", "grid_zone", "event_ts", "consumption_kwh", "solar_generation_kwh"), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"})
    records = w.readings.select(F.col("event_id").alias("kafka_offset"), F.when(F.col("event_id") % 97 == 0, F.lit("not json")).otherwise(text).alias("value"))
    return log.decode(records)


def archived(w: World) -> DataFrame:
    """What the archive holds, by its folders."""
    return w.spark.read.parquet(lake(w).raw).groupBy("sim_date", "hour").agg(F.count("*").alias("readings"))


def pending(w: World) -> DataFrame:
    """From the names of tariff files and of the archive's folders."""
    files = lake(w)
    _ = files.raw, files.landing  # written now
    return log.pending_days(w.spark, files.layout)


def restated(w: World) -> DataFrame:
    """Bills of the runs that count, as published: written run by run, some failed, some superseded."""
    files = lake(w)
    return ledger.published(files.ledger, files.published, "bills")


def repriced(w: World) -> DataFrame:
    """Every run's bills again, superseded ones too, from the tariff that the run archived."""
    files = lake(w)
    held = sinks.archived_tariffs(w.spark, files.published)
    rows = held.join(files.totals, ["household_id", "sim_date"], "left")
    zero = {"consumption_kwh": F.lit(0).cast(KWH), "solar_kwh": F.lit(0).cast(KWH)}
    return billing.price(rows.withColumns({n: F.coalesce(n, z) for n, z in zero.items()}), "final_bill")


def traced(w: World) -> DataFrame:
    header = F.when(F.col("event_id") % 3 == 0, F.array(F.struct(F.lit("other").alias("key"), F.lit("x").cast("binary").alias("value")), F.struct(F.lit("trace_id").alias("key"), F.concat(F.lit("h-"), F.col("event_id").cast("string")).cast("binary").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:binary>>"))
    return w.events.select("event_id", rules.trace_id(header, F.concat(F.lit("p-"), F.col("event_id").cast("string"))).alias("trace_id"))


def energy(w: World) -> DataFrame:
    parts = slabs(F.col("consumption_kwh"), (F.lit("8.00").cast("decimal(12,2)"), F.lit("16.50").cast("decimal(12,2)"), F.lit("24.50").cast("decimal(12,2)")))
    return w.readings.select("event_id", *[c.alias(f"{n}_{k}") for k, pair in enumerate(parts, 1) for n, c in zip(("kwh", "charge"), pair)])


#: The two batches of upsert_merge: all readings before this time, and all from then on.
MERGED_AT = "2024-01-16"


def merge(w: World) -> DataFrame:
    """The last reading of each meter and day part, written by two batches into a keyed table."""
    table = Table(w.spark, scratch(w), ["meter_id", "half"], F.col("half"))
    halves = w.readings.withColumn("half", F.when(F.hour("event_ts") < 12, "am").otherwise("pm"))
    for number, where in enumerate((F.col("event_ts") < MERGED_AT, F.col("event_ts") >= MERGED_AT)):
        table.upsert(halves.where(where).groupBy("meter_id", "half").agg(F.count("*").alias("n"), F.max("event_ts").alias("newest")), "merge", number)
    return table.read()


def sparse(w: World) -> DataFrame:
    """The tariff of every fourth day only, the day before the first reading included."""
    return w.tariff_all.where(F.datediff("effective_date", F.lit(w.span[0])) % 4 == -1) if w.span else w.tariff_all


def sparse_reconciled(w: World) -> DataFrame:
    """Estimates, final bills and reconciliation where a tariff holds for four days."""
    bills = billing.daily_bills(w.totals, sparse(w), w.open_days.select("sim_date"))
    return reconcile.reconciliation(billing.provisional_bills(w.speed_totals, sparse(w)), bills, sparse(w))


def latencies(w: World) -> DataFrame:
    """From each reading's instant, on the real clock, until its window is told; one second of each day's clock is set
    wrong, so some lie ahead."""
    told = clock.to_real(F.window("event_ts", SETTINGS.window)["end"])
    told = F.timestamp_micros(F.floor(F.unix_micros(told) / 1_000_000) * 1_000_000)
    return latency.histogram(w.speed_valid.select(latency.since(clock.to_real(F.col("event_ts")), told).alias("seconds")))


def report(w: World) -> DataFrame:
    return summaries.daily_report(w.priced, w.zone_days, w.runs, w.marked)


def day_check(w: World) -> DataFrame:
    """Rows of a day in each table, and of these the pairs whose effects don't add up to their gap."""
    w = w.on(DAY)
    effects = F.col("estimate") - F.col("own") + (F.col("own") - F.col("bill.total"))
    both = F.col("bill").isNotNull() & F.col("estimate").isNotNull()
    broken = both & (effects != F.col("estimate") - F.col("bill.total"))
    return w.priced.agg(F.count("bill").alias("bills"), F.count("estimate").alias("estimates"), F.count_if(both).alias("reconciled"), F.count_if(broken).alias("broken"))


def late_letters(w: World) -> DataFrame:
    return sinks.dead_letters(rules.split(w.raw, w.roster)[1], "speed")


def scalars(w: World) -> DataFrame:
    return w.readings.select(
        "event_id", F.upper("meter_id").alias("up"), F.lower("grid_zone").alias("low"), F.lpad(F.col("event_id").cast("string"), 9, "0").alias("padded"), F.year("event_ts").alias("y"), F.hour("event_ts").alias("h"),
        F.date_add(F.to_date("event_ts"), 3).alias("later"), F.greatest("consumption_kwh", "solar_generation_kwh").alias("big"), F.round("consumption_kwh", 1).alias("r1"), F.abs(F.col("event_id") % 7 - 3).alias("a"),
        F.size(F.array("meter_id", "grid_zone")).alias("n"), F.element_at(F.array("meter_id", "grid_zone"), 2).alias("second"), F.get_json_object(F.to_json(F.struct("meter_id")), "$.meter_id").alias("json_id"), F.coalesce(F.nullif("grid_zone", F.lit("ZONE-A")), F.lit("none")).alias("zone_or_none"),
    )


def by_half_hour(w: World, energy: str) -> DataFrame:
    """Energy of all readings by half hour of the day."""
    hour = (F.hour("event_ts") + F.floor(F.minute("event_ts") / 30) / 2).alias("hour")
    return w.readings.groupBy(hour).agg(F.count("*").alias("readings"), F.sum(energy).cast("decimal(18,4)").alias("kwh"))


def ticks(w: World) -> DataFrame:
    """The producer's ticks that readings come with, on the real clock, and how many come with each."""
    tick = simulate.tick_of(clock.to_real(F.col("event_ts")), SETTINGS.anchor).alias("tick")
    return w.readings.groupBy(tick).agg(F.count("*").alias("readings")).withColumn("due_ts", simulate.due(F.col("tick"), SETTINGS.anchor))


def watermark_gap(w: World) -> DataFrame:
    """Readings replayed in micro-batches of five days, those of an outage with the batch after their own: what the
    stream's deduplication drops behind its watermark, and the energy it therefore lacks against the batch."""
    first = F.lit(w.span[0] if w.span else "2024-01-01").cast("date")
    known = w.marked.where("reason IS NULL").select(*[c for c in w.readings.columns])
    batch = F.floor(F.datediff(F.to_date("event_ts"), first) / 5) + F.when(F.col("event_id") % 40 == 11, 1).otherwise(0)
    kept, late = speed.replay(w.spark, known.withColumn("arrival", batch), w.roster, scratch(w), "dedup", "arrival")
    total = lambda df, name: df.agg(F.sum("consumption_kwh").cast("decimal(18,4)").alias(name))
    out = total(w.batch_valid, "batch_kwh").crossJoin(total(kept, "speed_kwh")).withColumn("late_rows", F.lit(late).cast("long"))
    return out.withColumn("gap_pct", F.round(100 * (F.col("batch_kwh") - F.col("speed_kwh")) / F.col("batch_kwh"), 3).cast("decimal(9,3)"))


ENTRIES: dict[str, Entry] = {
    # sources and sinks
    "parse_readings": Entry(
        parse,
        "kafka_offset:i; event_id; meter_id; event_ts:t; consumption_kwh:n",
        "(SELECT event_id AS kafka_offset, CASE WHEN ok THEN CAST(event_id AS VARCHAR) END AS event_id, CASE WHEN ok THEN meter_id END "
        "AS meter_id, CASE WHEN ok THEN event_ts END AS event_ts, CASE WHEN ok THEN consumption_kwh END AS consumption_kwh FROM "
        "(SELECT *, event_id % 97 <> 0 AS ok FROM readings))",
    ),
    "read_day": Entry(
        lambda w: log.read_day(w.spark, lake(w).raw, DAY),
        _READING + "; ingest_ts:t",
        f"raw WHERE CAST(event_ts AS DATE) = DATE '{DAY}'",
    ),
    "archive_partitions": Entry(
        archived,
        "sim_date:d; hour:i; readings:i",
        "(SELECT CAST(event_ts AS DATE) AS sim_date, hour(event_ts) AS hour, count(*) AS readings FROM raw GROUP BY 1, 2)",
    ),
    "upsert_merge": Entry(
        merge,
        "meter_id; half; n:i; newest:t",
        "(SELECT meter_id, half, count(*) AS n, max(event_ts) AS newest FROM (SELECT *, CASE WHEN hour(event_ts) < 12 THEN 'am' ELSE 'pm' END AS half,"
        f" event_ts >= TIMESTAMP '{MERGED_AT}' AS again FROM readings) GROUP BY 1, 2, again QUALIFY row_number() OVER (PARTITION BY meter_id, half ORDER BY again DESC) = 1)",
    ),
    "dead_letter_records": Entry(
        lambda w: late_letters(w).select("stage", "reason", F.get_json_object("raw_payload", "$.event_id").cast("long").alias("event_id")),
        "stage='speed'; reason; event_id:i",
        "marked WHERE reason IS NOT NULL",
    ),
    "restated_bills": Entry(
        restated,
        "run_id; " + _BILL + "final_bill:n",
        "history WHERE run_id IN (SELECT run_id FROM runs WHERE status = 'success')",
    ),
    "archived_reprice": Entry(repriced, "run_id; household_id; sim_date:d; block_1_rate:n; final_bill:n", "history"),
    "speed_window_retention": Entry(
        lambda w: published_rollup(w, date(2024, 1, 30))[1],
        _WINDOW,
        "windows WHERE window_start >= DATE '2024-01-16'",
    ),
    "load_curve": Entry(
        lambda w: by_half_hour(w, "consumption_kwh").withColumn("load", F.round(simulate.load_shape(F.col("hour")), 4)),
        "hour; readings:i; kwh:n; load=round(0.3 + 0.6 * exp(-pow((hour - 7.5) / 1.5, 2) / 2) + exp(-pow((hour - 19.5) / 2.0, 2) / 2), 4)",
        _HALF_HOURS.format("consumption_kwh"),
    ),
    "solar_curve": Entry(
        lambda w: by_half_hour(w, "solar_generation_kwh").withColumn("solar", F.round(simulate.solar_kwh(F.col("hour"), F.lit(25)), 4)),
        "hour; readings:i; kwh:n; solar=round(CASE WHEN hour < 6 OR hour > 18 THEN 0 ELSE pow(cos((hour - 12) / 12 * "
        "3.141592653589793), 2) END * (1 - 0.8 * 25 / 100), 4)",
        _HALF_HOURS.format("solar_generation_kwh"),
    ),
    "household_roster": Entry(lambda w: w.roster, "household_id; meter_id; grid_zone; billing_tier; subsidy_flag; has_solar", "roster"),
    "tariff_generator": Entry(lambda w: w.tariff_all, _TARIFF, "tariff_all"),
    "weather_forecast": Entry(
        lambda w: simulate.weather(w.days),
        "grid_zone; forecast_date:d; cloud_cover_pct:n; temperature_c:n; solar_irradiance_index:n",
        "(SELECT 'ZONE-' || chr(CAST(65 + i AS INTEGER)) AS grid_zone, sim_date AS forecast_date, (o * 7 + i * 13) % 80 + 10 AS "
        "cloud_cover_pct, 20 + (o * 3 + i * 5) % 15 AS temperature_c, (100 - ((o * 7 + i * 13) % 80 + 10)) / 100.0 AS "
        "solar_irradiance_index FROM (SELECT sim_date, date_diff('day', DATE '1970-01-01', sim_date) + 719163 AS o FROM days) CROSS "
        "JOIN (SELECT unnest(range(5)) AS i))",
    ),
    "fault_injection": Entry(lambda w: w.raw, _READING + "; ingest_ts:t", "raw"),
    "closed_days_owed": Entry(
        lambda w: simulate.closed_days_owed(w.days.where("sim_date <= date '2024-01-08'"), F.lit("2024-01-20").cast("date")),
        "sim_date:d",
        "(SELECT CAST(unnest(generate_series(TIMESTAMP '2024-01-09', least(TIMESTAMP '2024-01-19', TIMESTAMP '2024-01-15'), INTERVAL 1 "
        "DAY)) AS DATE) AS sim_date)",
    ),
    "pending_days": Entry(pending, "sim_date:d", "days WHERE sim_date IN (SELECT CAST(event_ts AS DATE) FROM raw)"),
    "tariff_files": Entry(lambda w: lake(w).tariff, _TARIFF, "tariff_all"),
    "tick_grid": Entry(
        ticks,
        "tick:i; readings:i; due_ts:t=TIMESTAMP '2024-06-01 00:00:00' + to_seconds(CAST(tick * 2 AS BIGINT))",
        "(SELECT ((epoch_us(event_ts) - epoch_us(TIMESTAMP '2024-01-01')) // 288 + 1999999) // 2000000 AS tick, count(*) AS readings "
        "FROM readings GROUP BY 1)",
    ),
    # projections, filters, predicates
    "validate_valid": Entry(lambda w: rules.split(w.raw, w.roster)[0], _READING + "; ingest_ts:t", "marked WHERE reason IS NULL"),
    "validate_rejected": Entry(lambda w: rules.split(w.raw, w.roster)[1], _READING + "; reason", "marked WHERE reason IS NOT NULL"),
    "reject_reason_counts": Entry(
        lambda w: w.marked.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")),
        "reason; n:i",
        "(SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY 1)",
    ),
    "voltage_warnings": Entry(
        lambda w: w.readings.withColumn("voltage", (170 + F.col("event_id") % 100).cast("double")).withColumn("warnings", rules.warnings()).where(F.size("warnings") > 0).withColumn("warning", F.element_at("warnings", 1)),
        "event_id:i; voltage; warning='voltage_out_of_range'",
        "(SELECT event_id, CAST(170 + event_id % 100 AS DOUBLE) AS voltage FROM readings) WHERE voltage NOT BETWEEN 180 AND 260",
    ),
    "netting": Entry(
        lambda w: w.readings.select("event_id", *[c.alias(n) for n, c in netting(F.col("consumption_kwh"), F.col("solar_generation_kwh")).items()]),
        "event_id:i; self_consumed_kwh:n=least(consumption_kwh, solar_generation_kwh); billable_import_kwh:n=consumption_kwh - "
        "least(consumption_kwh, solar_generation_kwh); export_kwh:n=solar_generation_kwh - least(consumption_kwh, solar_generation_kwh)",
        "readings",
    ),
    "tariff_blocks": Entry(
        lambda w: w.tariff.select("household_id", "effective_date", F.inline(block_rows())),
        "household_id; effective_date:d; name; lower_kwh:n; upper_kwh:n; rate:n",
        "(SELECT household_id, effective_date, 'block_1' AS name, 0 AS lower_kwh, 60 AS upper_kwh, block_1_rate AS rate FROM tariff "
        "UNION ALL SELECT household_id, effective_date, 'block_2', 60, 120, block_2_rate FROM tariff UNION ALL SELECT household_id, "
        "effective_date, 'block_3', 120, NULL, block_3_rate FROM tariff)",
    ),
    "energy_charge": Entry(
        energy,
        "event_id:i; kwh_1:n; charge_1:n; kwh_2:n; charge_2:n; kwh_3:n; charge_3:n",
        "(SELECT event_id, kwh_1, charge_1, kwh_2, charge_2, kwh_3, charge_3 FROM (SELECT event_id, " + oracle.bill("x") + " FROM (SELECT event_id, consumption_kwh, CAST(0 AS DECIMAL(12,4)) AS solar_kwh, false AS subsidy_flag, CAST(0 AS DECIMAL(5,2)) AS subsidy_pct, CAST(0 AS DECIMAL(12,2)) AS fixed_charge, CAST(0 AS DECIMAL(12,2)) AS export_rate, CAST(8.00 AS DECIMAL(12,2)) AS block_1_rate, CAST(16.50 AS DECIMAL(12,2)) AS block_2_rate, CAST(24.50 AS DECIMAL(12,2)) AS block_3_rate FROM readings)))",
    ),
    "tier_breakdown": Entry(
        lambda w: billing.tier_rows(w.bills),
        "household_id; sim_date:d; name; up_to_kwh:n; rate:n; kwh:n; charge:n",
        "tiers",
        _TIERS,
    ),
    "tier_json": Entry(
        lambda w: w.bills.select("household_id", "sim_date", tier_json(F.col("tier_breakdown")).alias("tiers")),
        "household_id; sim_date:d; tiers=" + _TIER_JSON,
        "bills",
    ),
    "tier_utilisation": Entry(
        lambda w: summaries.tier_utilisation(billing.tier_rows(w.bills), F.lit(60)),
        "household_id; sim_date:d; name; used_pct:n=" + oracle.ratio("kwh * 100", "60", 2),
        "tiers WHERE up_to_kwh IS NOT NULL",
        _TIERS,
    ),
    "daily_bills": Entry(lambda w: w.bills, _BILL + "final_bill:n; readings_count:i; tariff_effective_date:d", "bills"),
    "rounding": Entry(
        lambda w: w.readings.select("event_id", F.round("consumption_kwh", 2).cast("decimal(12,2)").alias("money"), F.round(F.col("consumption_kwh") * F.lit("0.165").cast("decimal(4,3)"), 2).cast("decimal(12,2)").alias("product")),
        "event_id:i; money:n=round(consumption_kwh, 2); product:n=round(consumption_kwh * CAST(0.165 AS DECIMAL(4,3)), 2)",
        "readings",
    ),
    "trace_id_lookup": Entry(
        traced,
        "event_id:i; trace_id=CASE WHEN event_id % 3 = 0 THEN 'h-' ELSE 'p-' END || CAST(event_id AS VARCHAR)",
        "readings",
    ),
    "sim_clock": Entry(
        lambda w: w.readings.select("event_id", clock.to_real(F.col("event_ts")).alias("real_ts"), F.to_date(clock.to_sim(clock.to_real(F.col("event_ts")))).alias("back_date"), F.round(clock.day_progress(F.col("event_ts")), 6).alias("progress"), F.round(clock.seconds_to_close(F.col("event_ts")), 3).alias("to_close")),
        "event_id:i; real_ts:t=TIMESTAMP '2024-06-01' + to_microseconds(us // 288); back_date:d=CAST(TIMESTAMP '2024-01-01' + "
        "to_microseconds((us // 288) * 288) AS DATE); progress:n=round(CAST(us % 86400000000 AS DOUBLE) / 86400000000.0, 6); "
        "to_close:n=round((86400000000 - us % 86400000000) / 288000000.0, 3)",
        "(SELECT event_id, epoch_us(event_ts) - epoch_us(TIMESTAMP '2024-01-01') AS us FROM readings)",
    ),
    "zone_history": Entry(
        lambda w: serving.zone_history(w.windows, "2024-01-10 00:00:00", "2024-01-10 12:00:00", "ZONE-B"),
        _WINDOW,
        "windows WHERE grid_zone = 'ZONE-B' AND window_start >= TIMESTAMP '2024-01-10' AND window_start < TIMESTAMP '2024-01-10 12:00:00'",
    ),
    "all_zone_history": Entry(
        lambda w: serving.zone_history(w.windows, "2024-01-10 00:00:00", "2024-01-10 12:00:00"),
        _WINDOW,
        "windows WHERE window_start >= TIMESTAMP '2024-01-10' AND window_start < TIMESTAMP '2024-01-10 12:00:00'",
    ),
    "bill_lookup": Entry(
        lambda w: summaries.bill_of(w.on(DAY).bills, "HH-0003", DAY),
        _BILL + "final_bill:n",
        f"bills WHERE household_id = 'HH-0003' AND sim_date = DATE '{DAY}'",
    ),
    "estimate_lookup": Entry(
        lambda w: summaries.bill_of(w.on(DAY).speed_bills, "HH-0003", DAY),
        _BILL + "estimated_bill:n; tariff_source_date:d",
        f"speed_bills WHERE household_id = 'HH-0003' AND sim_date = DATE '{DAY}'",
    ),
    "reconciliation_lookup": Entry(
        lambda w: summaries.bill_of(w.on(DAY).reconciled, "HH-0003", DAY),
        _REC,
        f"reconciled WHERE household_id = 'HH-0003' AND sim_date = DATE '{DAY}'",
    ),
    "zone_daily_slice": Entry(
        lambda w: day(w.on(DAY).zone_days).orderBy("grid_zone"),
        _ZONE_DAY,
        f"zone_days WHERE sim_date = DATE '{DAY}'",
    ),
    "scalar_functions": Entry(
        scalars,
        "event_id:i; up=upper(meter_id); low=lower(grid_zone); padded=lpad(CAST(event_id AS VARCHAR), 9, '0'); y:i=year(event_ts); "
        "h:i=hour(event_ts); later:d=CAST(event_ts AS DATE) + 3; big:n=greatest(consumption_kwh, solar_generation_kwh); "
        "r1:n=round(consumption_kwh, 1); a:i=abs(event_id % 7 - 3); n:i=2; second=grid_zone; json_id=meter_id; "
        "zone_or_none=coalesce(nullif(grid_zone, 'ZONE-A'), 'none')",
        "readings",
    ),
    # joins
    "provisional_bills": Entry(lambda w: w.speed_bills, _BILL + "estimated_bill:n; tariff_source_date:d", "speed_bills"),
    "missing_tariff": Entry(
        lambda w: billing.missing_tariff(w.totals, w.tariff.where("billing_tier <> 'TIER_2'")),
        "household_id; sim_date:d",
        "totals WHERE household_id NOT IN (SELECT household_id FROM roster WHERE billing_tier <> 'TIER_2')",
    ),
    "idle_households": Entry(
        lambda w: billing.idle_households(w.totals, w.tariff),
        "household_id; sim_date:d; consumption_kwh:n=0; readings_count:i=0",
        "(SELECT household_id, effective_date AS sim_date FROM tariff EXCEPT SELECT household_id, sim_date FROM totals)",
    ),
    "duplicates_removed": Entry(
        lambda w: w.totals.select("household_id").distinct().join(billing.duplicates_removed(w.raw), "household_id", "left").withColumn("duplicates_removed", F.coalesce("duplicates_removed", F.lit(0))),
        "household_id; readings:i; duplicates_removed:i",
        "(SELECT household_id, count(*) AS readings, count(*) - count(DISTINCT (meter_id, event_ts)) AS duplicates_removed FROM raw "
        "WHERE household_id IN (SELECT household_id FROM totals) GROUP BY 1)",
    ),
    "tariff_effective": Entry(
        lambda w: billing.tariff_effective(w.tariff_all.where("dayofmonth(effective_date) % 4 = 1"), w.open_days.select("sim_date")),
        "sim_date:d; " + _TARIFF,
        "(SELECT d.sim_date, t.* FROM open_days d JOIN tariff_all t ON t.effective_date <= d.sim_date AND day(t.effective_date) % 4 = "
        "1 QUALIFY row_number() OVER (PARTITION BY household_id, d.sim_date ORDER BY effective_date DESC) = 1)",
    ),
    "tariff_ties": Entry(
        lambda w: billing.tariff_ties(w.tariff.unionByName(w.tariff.where("billing_tier = 'TIER_1'")), w.open_days.select("sim_date")),
        "household_id; sim_date:d=effective_date; effective_date:d; rows_in_force:i=2",
        "tariff WHERE billing_tier = 'TIER_1'",
    ),
    "reconciliation": Entry(lambda w: w.reconciled, _REC, "reconciled"),
    "reconciliation_sparse_tariff": Entry(sparse_reconciled, _REC, "sparse_reconciled", _SPARSE),
    "reconciliation_unmatched": Entry(lambda w: reconcile.unmatched(w.priced), "household_id; sim_date:d; side", "sides", _SIDES),
    "bill_history_audit": Entry(
        lambda w: w.history.join(w.runs.select("run_id", "status"), "run_id").groupBy("run_id", "sim_date", "status").agg(F.count("*").alias("bills"), F.sum("final_bill").cast("decimal(18,2)").alias("billed")),
        "run_id; sim_date:d; status; bills:i; billed:n",
        "(SELECT h.run_id, h.sim_date, r.status, count(*) AS bills, sum(final_bill) AS billed FROM history h JOIN runs r ON r.run_id = "
        "h.run_id GROUP BY 1, 2, 3)",
    ),
    "kwh_shortfall": Entry(lambda w: reconcile.kwh_shortfall(w.reconciled), "sim_date:d; kwh_shortfall_pct:n", "gap_day", _SPLIT),
    "windows_on_real_axis": Entry(
        lambda w: summaries.on_real_axis(w.windows, summaries.clock_anchor(w.windows)),
        "grid_zone; window_start:t; real_start:t=make_timestamp(us + since_start); real_end:t=make_timestamp(us + since_end)",
        "(SELECT *, (epoch_us(window_start) - epoch_us(TIMESTAMP '2024-01-01')) // 288 AS since_start, (epoch_us(window_end) - "
        "epoch_us(TIMESTAMP '2024-01-01')) // 288 AS since_end FROM windows) CROSS JOIN anchor",
        {"anchor": "SELECT CAST(min(epoch_us(updated_at) - (epoch_us(window_start) - epoch_us(TIMESTAMP '2024-01-01')) // 288) AS BIGINT) AS us FROM windows"},
    ),
    "finalised_days": Entry(lambda w: ledger.finalised_days(lake(w).booked), "sim_date:d", "finalised"),
    "merged_bills": Entry(
        lambda w: serving.merged_bills(w.priced, ledger.finalised_days(w.runs)),
        "household_id; sim_date:d; total:n; provisional; tariff_date:d; readings_count:i",
        "merged",
        _MERGED,
    ),
    "bill_delta": Entry(
        lambda w: serving.bill_delta(w.priced),
        "household_id; sim_date:d; speed_estimate:n; batch_final:n; delta:n; pct:n; tariff_effect:n; data_effect:n",
        "(SELECT b.household_id, b.sim_date, s.estimated_bill AS speed_estimate, b.final_bill AS batch_final, s.estimated_bill - b.final_bill AS delta, CASE WHEN s.estimated_bill IS NOT NULL THEN CASE WHEN b.energy_charge + b.fixed_charge = 0 THEN 0 ELSE " + oracle.ratio("abs(s.estimated_bill - b.final_bill) * 100", "(b.energy_charge + b.fixed_charge)", 3, 100) + " END END AS pct, r.tariff_effect, r.data_effect FROM bills b LEFT JOIN speed_bills s ON s.household_id = b.household_id AND s.sim_date = b.sim_date LEFT JOIN reconciled r ON r.household_id = b.household_id AND r.sim_date = b.sim_date)",
    ),
    # aggregations
    "zone_windows": Entry(lambda w: w.windows, _WINDOW, "windows"),
    "household_running": Entry(
        lambda w: rollups.household_running(w.speed_valid),
        "household_id; sim_date:d; consumption_kwh:n; solar_kwh:n",
        "speed_totals",
    ),
    "household_daily": Entry(lambda w: w.totals, "household_id; sim_date:d; consumption_kwh:n; solar_kwh:n; readings_count:i", "totals"),
    "zone_daily_rollup": Entry(lambda w: w.zone_days, _ZONE_DAY, "zone_days"),
    "peak_window": Entry(
        lambda w: rollups.peak_windows(rollups.zone_windows(w.batch_valid)),
        "grid_zone; sim_date:d; peak_window_start:t; peak_consumption_kwh:n",
        "peaks",
    ),
    "latest_ratio": Entry(lambda w: summaries.latest_ratio(w.windows), "grid_zone; renewable_ratio:n", "latest", _LATEST),
    "billing_summary": Entry(
        lambda w: summaries.billing_summary(w.on(DAY).bills, DAY),
        "bills:i; billed:n; exported:n",
        f"(SELECT count(*) AS bills, sum(final_bill) AS billed, sum(export_kwh) AS exported FROM bills WHERE sim_date = DATE '{DAY}') "
        "WHERE bills > 0",
    ),
    "rejected_recent": Entry(
        lambda w: summaries.rejects_since(w.marked, at("2024-01-20 00:00:00")),
        "reason; n:i",
        "(SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL AND ingest_ts >= TIMESTAMP '2024-01-20' GROUP BY 1)",
    ),
    "rejected_for_day": Entry(
        lambda w: summaries.rejects_of_day(late_letters(w.on(DAY)), DAY),
        "reason; n:i",
        f"(SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL AND CAST(event_ts AS DATE) = DATE '{DAY}' GROUP BY 1)",
    ),
    "reconciliation_summary": Entry(
        lambda w: summaries.reconciliation_means(w.reconciled),
        "sim_date:d; n:i; mean_abs:n; mean_pct:n",
        f"(SELECT sim_date, count(*) AS n, {mean_sql('abs_divergence', 2, 100)} AS mean_abs, {mean_sql('pct_divergence', 3, 1000)} AS "
        "mean_pct FROM reconciled GROUP BY 1)",
    ),
    "divergence_summary": Entry(
        lambda w: reconcile.divergence_summary(w.reconciled),
        "sim_date:d; households:i; mean_pct:n; max_pct:n; mean_abs:n; tariff_share_pct:n; kwh_shortfall_pct:n",
        f"(SELECT sim_date, count(*) AS households, {mean_sql('pct_divergence', 3, 1000)} AS mean_pct, max(pct_divergence) AS max_pct, "
        f"{mean_sql('abs_divergence', 2, 100)} AS mean_abs, CASE WHEN sum(abs(tariff_effect)) + sum(abs(data_effect)) > 0 THEN "
        f"{oracle.ratio('sum(abs(tariff_effect)) * 100', '(sum(abs(tariff_effect)) + sum(abs(data_effect)))', 2, 100)} END AS "
        "tariff_share_pct FROM reconciled GROUP BY 1) JOIN gap_day USING (sim_date)",
        _SPLIT,
    ),
    "divergence_by_day": Entry(
        lambda w: summaries.divergence_by_day(w.reconciled),
        "sim_date:d; mean_pct:n; max_pct:n",
        f"(SELECT sim_date, {mean_sql('pct_divergence', 3, 1000)} AS mean_pct, max(pct_divergence) AS max_pct FROM reconciled GROUP BY 1)",
    ),
    "effects_by_day": Entry(
        lambda w: summaries.effects_by_day(w.reconciled),
        "sim_date:d; tariff_effect:n; data_effect:n",
        "(SELECT sim_date, sum(tariff_effect) AS tariff_effect, sum(data_effect) AS data_effect FROM reconciled GROUP BY 1)",
    ),
    "bill_sanity": Entry(
        lambda w: summaries.bill_sanity(w.bills),
        "sim_date:d; negative:i; idle:i; no_kwh:i=0; bills:i",
        "(SELECT sim_date, count(*) FILTER (WHERE final_bill < 0) AS negative, count(*) FILTER (WHERE readings_count = 0) AS idle, "
        "count(*) AS bills FROM bills GROUP BY 1)",
    ),
    "bill_row_count": Entry(
        lambda w: summaries.bill_row_count(w.bills, w.roster),
        "sim_date:d; bills:i; expected:i; ok=bills = expected",
        "(SELECT sim_date, count(*) AS bills, (SELECT count(*) FROM roster) AS expected FROM bills GROUP BY 1)",
    ),
    "offset_gaps": Entry(
        lambda w: summaries.offset_gaps(w.raw.where("consumption_kwh > 0").select((F.col("event_id") % 3).alias("partition"), F.floor(F.col("event_id") / 3).alias("offset"))),
        "partition:i; lo:i; hi:i; seen:i; missing:i=hi - lo + 1 - seen",
        "(SELECT event_id % 3 AS partition, min(event_id // 3) AS lo, max(event_id // 3) AS hi, count(DISTINCT event_id // 3) AS seen "
        "FROM raw WHERE consumption_kwh > 0 GROUP BY 1)",
    ),
    "cross_check": Entry(
        lambda w: rollups.cross_check(w.zone_days, w.totals),
        "sim_date:d; zone_kwh:n; household_kwh:n; gap_kwh:n; within=gap_kwh <= 0.01",
        "(SELECT sim_date, z AS zone_kwh, h AS household_kwh, abs(z - h) AS gap_kwh FROM (SELECT sim_date, sum(total_consumption_kwh) "
        "AS z FROM zone_days GROUP BY 1) JOIN (SELECT sim_date, sum(consumption_kwh) AS h FROM totals GROUP BY 1) USING (sim_date))",
    ),
    "grid_totals": Entry(
        lambda w: rollups.grid_totals(w.windows),
        "window_start:t; consumption_kwh:n; solar_kwh:n; zones:i; renewable_ratio:n",
        "(SELECT window_start, sum(total_consumption_kwh) AS consumption_kwh, sum(total_solar_kwh) AS solar_kwh, count(*) AS zones, "
        f"{oracle._RATIO.format(c='sum(total_consumption_kwh)', s='sum(total_solar_kwh)')} AS renewable_ratio FROM windows GROUP BY 1)",
    ),
    "stale_tariff_check": Entry(
        lambda w: summaries.tariff_age(w.speed_bills),
        "sim_date:d; bills:i; at_yesterdays:i",
        "(SELECT sim_date, count(*) AS bills, count(*) FILTER (WHERE tariff_source_date = sim_date - 1) AS at_yesterdays FROM "
        "speed_bills GROUP BY 1)",
    ),
    "day_check": Entry(
        day_check,
        "bills:i; estimates:i; reconciled:i; broken:i",
        f"(SELECT (SELECT count(*) FROM bills WHERE sim_date = DATE '{DAY}') AS bills, (SELECT count(*) FROM speed_bills WHERE sim_date "
        f"= DATE '{DAY}') AS estimates, (SELECT count(*) FROM reconciled WHERE sim_date = DATE '{DAY}') AS reconciled, (SELECT count(*) "
        f"FROM reconciled WHERE sim_date = DATE '{DAY}' AND tariff_effect + data_effect <> speed_estimate - batch_final) AS broken)",
    ),
    "newest_window": Entry(
        lambda w: summaries.newest_window(w.windows),
        "newest:t; n:i",
        "(SELECT max(window_start) AS newest, count(*) AS n FROM windows)",
    ),
    "newest_billed_day": Entry(
        lambda w: summaries.newest_billed_day(lake(w).booked),
        "sim_date:d",
        "(SELECT max(sim_date) AS sim_date FROM finalised)",
    ),
    "ledger_status_counts": Entry(
        lambda w: summaries.status_counts(lake(w).booked),
        "status; n:i",
        "(SELECT status, count(*) AS n FROM runs GROUP BY 1)",
    ),
    "reconciled_days": Entry(lambda w: summaries.reconciled_days(w.reconciled), "sim_date:d", "(SELECT DISTINCT sim_date FROM reconciled)"),
    "divergence_histogram": Entry(
        lambda w: summaries.divergence_histogram(w.reconciled),
        "bucket:i; n:i",
        "(SELECT least(floor(pct_divergence / 5), 20) AS bucket, count(*) AS n FROM reconciled GROUP BY 1)",
    ),
    "speed_lag": Entry(
        lambda w: summaries.speed_lag(w.windows, at("2024-02-01 00:00:00")),
        "lag_sim_s:n=us / 1000000.0; lag_real_s:n=round(us / 288000000.0, 6)",
        "(SELECT epoch_us(TIMESTAMP '2024-02-01') - epoch_us(max(window_end)) AS us FROM windows)",
    ),
    "clock_anchor": Entry(
        lambda w: summaries.clock_anchor(w.windows),
        "anchor:t=make_timestamp(us)",
        "(SELECT CAST(min(epoch_us(updated_at) - (epoch_us(window_start) - epoch_us(TIMESTAMP '2024-01-01')) // 288) AS BIGINT) AS us "
        "FROM windows)",
    ),
    "zone_data_age": Entry(
        lambda w: alerts.zone_data_age(w.windows, at(NOW)),
        "grid_zone; age_seconds:n=" + _AGE.format(now=NOW),
        "latest",
        _LATEST,
    ),
    "last_billing_success": Entry(
        lambda w: alerts.last_billing_success(w.runs, at(FALLBACK)),
        "last_success:t",
        f"(SELECT coalesce(max(finished_at), TIMESTAMP '{FALLBACK}') AS last_success FROM runs WHERE status IN ('success', 'superseded'))",
    ),
    "latency_histogram": Entry(latencies, _LATENCY + "; n:i; p50:n; p95:n; p99:n", "latencies", _LATENCIES),
    "reject_rate": Entry(lambda w: alerts.reject_rates(w.marked), "window_start:t; consumed:i; rejected:i; rate", "rates", _RATES),
    "watermark_gap": Entry(
        watermark_gap,
        "batch_kwh:n; speed_kwh:n; late_rows:i; gap_pct:n=" + oracle.ratio("(batch_kwh - speed_kwh) * 100", "batch_kwh", 3),
        "(SELECT (SELECT sum(consumption_kwh) FROM batch_valid) AS batch_kwh, (SELECT sum(consumption_kwh) FROM kept) AS speed_kwh, "
        "(SELECT count(*) FROM arrived WHERE late) AS late_rows)",
        _ARRIVED,
    ),
    # windows and order
    "dedup_earliest": Entry(lambda w: billing.dedup_earliest(w.raw), _READING + "; ingest_ts:t", "deduped"),
    "latest_zone_load": Entry(lambda w: rollups.latest_by_zone(w.windows), _WINDOW, "latest", _LATEST),
    "bill_waterfall": Entry(
        lambda w: serving.waterfall(w.bills),
        "household_id; sim_date:d; step:i; name; amount:n; running_total:n",
        "(SELECT household_id, sim_date, step, name, amount, sum(amount) OVER (PARTITION BY household_id, sim_date ORDER BY step) AS "
        "running_total FROM (SELECT household_id, sim_date, 1 AS step, 'energy' AS name, energy_charge AS amount FROM bills UNION ALL "
        "SELECT household_id, sim_date, 2, 'fixed', fixed_charge FROM bills UNION ALL SELECT household_id, sim_date, 3, 'subsidy', "
        "-subsidy_amount FROM bills UNION ALL SELECT household_id, sim_date, 4, 'credit', -export_credit FROM bills))",
    ),
    "run_history": Entry(
        lambda w: w.runs.orderBy("sim_date", F.desc("started_at")),
        "run_id; sim_date:d; layer; status; started_at:t; finished_at:t; rows_in:i; rows_out:i",
        "runs",
    ),
    "ledger_state": Entry(
        lambda w: w.runs,
        "run_id; sim_date:d; layer; status; started_at:t; finished_at:t; rows_in:i; rows_out:i",
        "runs",
    ),
    "recent_zone_days": Entry(
        lambda w: w.zone_days.orderBy(F.desc("sim_date"), "grid_zone").limit(25),
        _ZONE_DAY,
        "(SELECT * FROM zone_days ORDER BY sim_date DESC, grid_zone LIMIT 25)",
    ),
    "top_divergence": Entry(
        lambda w: w.reconciled.orderBy(F.desc("pct_divergence"), F.desc("abs_divergence"), "household_id", "sim_date").limit(25),
        _REC,
        "(SELECT * FROM reconciled ORDER BY pct_divergence DESC, abs_divergence DESC, household_id, sim_date LIMIT 25)",
    ),
    # alerts and report
    "alerts_meter_data_stale": Entry(
        lambda w: alerts.meter_data_stale(w.windows, at(_STALE_NOW)),
        "grid_zone; age_seconds:n",
        "stale",
        {**_LATEST, **_STALE},
    ),
    "alerts_low_renewable": Entry(lambda w: alerts.low_renewable(w.windows), "grid_zone; window_start:t; highest:n", "low", _LOW),
    "alerts_high_reject_rate": Entry(
        lambda w: alerts.high_reject_rate(w.marked),
        "window_start:t; consumed:i; rejected:i; rate",
        "rates WHERE consumed > 0 AND rate > 0.05",
        _RATES,
    ),
    "alerts_batch_sla_miss": Entry(
        lambda w: alerts.batch_sla_miss(w.runs, at(FALLBACK), at(NOW)),
        "last_success:t; late_seconds:n",
        f"(SELECT last_success, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(last_success)) / 1000000.0 AS late_seconds FROM (SELECT "
        f"coalesce(max(finished_at), TIMESTAMP '{FALLBACK}') AS last_success FROM runs WHERE status IN ('success', 'superseded'))) "
        "WHERE late_seconds > 900",
    ),
    "alerts_lambda_divergence": Entry(
        lambda w: alerts.lambda_divergence(w.reconciled, DIVERGES),
        "sim_date:d; mean_pct:n",
        "(SELECT sim_date, round(avg(pct_divergence), 6) AS mean_pct FROM reconciled WHERE sim_date = (SELECT max(sim_date) FROM "
        "reconciled) GROUP BY 1) WHERE mean_pct > 2",
    ),
    "alerts_active": Entry(
        lambda w: alerts.active(alerts.meter_data_stale(w.windows, at(_STALE_NOW)), alerts.low_renewable(w.windows)),
        "grid_zone; alert",
        "(SELECT grid_zone, 'MeterDataStale' AS alert FROM stale UNION ALL SELECT DISTINCT grid_zone, 'LowRenewable' FROM low WHERE "
        "grid_zone NOT IN (SELECT grid_zone FROM stale))",
        {**_LATEST, **_STALE, **_LOW},
    ),
    "daily_report": Entry(report, _REPORT, "report", _REPORTED),
    # streams, replayed over the readings without faults, all at once so that none is late
    "stream_zone_windows": Entry(
        lambda w: speed.replay(w.spark, w.readings, w.roster, scratch(w), "windows")[0],
        _WINDOW,
        "(SELECT grid_zone, window_start, window_start + INTERVAL 15 MINUTE AS window_end, c AS total_consumption_kwh, s AS "
        f"total_solar_kwh, {oracle._RATIO.format(c='c', s='s')} AS renewable_ratio, active_meters FROM (SELECT grid_zone, "
        "time_bucket(INTERVAL '15 minutes', event_ts) AS window_start, sum(consumption_kwh) AS c, sum(solar_generation_kwh) AS s, "
        "count(DISTINCT meter_id) AS active_meters FROM readings GROUP BY 1, 2))",
    ),
    "stream_household_running": Entry(
        lambda w: speed.replay(w.spark, w.readings, w.roster, scratch(w), "running")[0],
        "household_id; sim_date:d; consumption_kwh:n; solar_kwh:n",
        "(SELECT household_id, CAST(event_ts AS DATE) AS sim_date, sum(consumption_kwh) AS consumption_kwh, sum(solar_generation_kwh) "
        "AS solar_kwh FROM readings GROUP BY 1, 2)",
    ),
    "stream_dedup": Entry(
        lambda w: speed.replay(w.spark, w.readings.unionByName(w.readings.where("event_id % 50 = 0")), w.roster, scratch(w), "dedup")[0],
        _READING,
        "readings",
    ),
    "stream_rejects": Entry(
        lambda w: speed.replay(w.spark, w.raw, w.roster, scratch(w), "rejects")[0].groupBy("stage", "reason").agg(F.count("*").alias("n")),
        "stage='speed'; reason; n:i",
        "(SELECT reason, count(*) AS n FROM marked WHERE reason IS NOT NULL GROUP BY 1)",
    ),
}


def _query(entry: Entry) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: presentable(entry.make(World(spark, sf_dir)), entry.names)


QUERIES = {name: _query(entry) for name, entry in ENTRIES.items()}
ORACLES = {name: oracle.sql(entry.columns, entry.source, entry.more) for name, entry in ENTRIES.items()}
