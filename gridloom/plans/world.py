"""The meter domain over the events table: every derived relation once, as a lazy DataFrame."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import rules
from gridloom.functions.clock import to_real
from gridloom.operators import billing, ledger, reconcile, rollups, simulate
from gridloom.types import KWH, SETTINGS


class World:
    """Relations of one data folder. events is the stream of readings: a user is a household with one meter."""

    def __init__(self, spark: SparkSession, sf_dir: str, day: str | None = None):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.dir, self.day = spark, sf_dir, day

    def on(self, day: str) -> World:
        """The same for one day: its readings, tariffs and days only, so that what is asked of a day costs a day."""
        return World(self.spark, self.dir, day)

    @cached_property
    def events(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("event_ts"), "user_id", "value", "props")

    @cached_property
    def readings(self) -> DataFrame:
        n = F.col("user_id") + 1
        sun = (F.get_json_object("props", "$.k").cast("decimal(8,0)") * F.lit("0.5").cast("decimal(2,1)")).cast(KWH)
        return self.events.select(
            "event_id", F.format_string("MTR-%04d", n).alias("meter_id"), F.format_string("HH-%04d", n).alias("household_id"),
            F.concat(F.lit("ZONE-"), F.char((F.col("user_id") % 5 + 65).cast("int"))).alias("grid_zone"), "event_ts",
            F.col("value").cast(KWH).alias("consumption_kwh"), F.when(n % 3 == 0, sun).otherwise(F.lit(0).cast(KWH)).alias("solar_generation_kwh"),
        )

    @cached_property
    def roster(self) -> DataFrame:
        return simulate.roster(self.events.select("user_id").distinct())

    @cached_property
    def span(self) -> tuple | None:
        """The days of the first and the last reading: one pass, instead of one in each plan that needs days."""
        ends = self.events.agg(F.to_date(F.min("event_ts")).alias("a"), F.to_date(F.max("event_ts")).alias("b")).first()
        return None if ends["a"] is None else (ends["a"], ends["b"])

    @cached_property
    def days(self) -> DataFrame:
        """The day before the first reading, and every day until the last."""
        if self.span is None:
            return self.spark.createDataFrame([], "sim_date date")
        first, last = map(F.lit, self.span)
        return self.spark.range(1).select(F.explode(F.sequence(F.date_sub(first, 1), last)).alias("sim_date"))

    @cached_property
    def open_days(self) -> DataFrame:
        if self.span is None:
            return self.spark.createDataFrame([], "d int, sim_date date")
        every = self.spark.range(1).select(F.posexplode(F.sequence(*map(F.lit, self.span))).alias("d", "sim_date"))
        return every if self.day is None else every.where(F.col("sim_date") == F.lit(self.day).cast("date"))

    @cached_property
    def tariff_all(self) -> DataFrame:
        return simulate.tariff(self.roster, self.days if self.day is None else self.days.where(F.col("sim_date").between(F.date_sub(F.lit(self.day), 1), F.lit(self.day))))

    @cached_property
    def tariff(self) -> DataFrame:
        return simulate.tariff(self.roster, self.open_days.select("sim_date"))

    @cached_property
    def raw(self) -> DataFrame:
        every = simulate.with_faults(self.readings)
        return every if self.day is None else every.where(F.to_date("event_ts") == F.lit(self.day).cast("date"))

    @cached_property
    def marked(self) -> DataFrame:
        return rules.with_reason(self.raw, self.roster)

    @cached_property
    def batch_valid(self) -> DataFrame:
        """Deduplicated first, then validated, as the batch does."""
        return rules.split(billing.dedup_earliest(self.raw), self.roster)[0]

    @cached_property
    def totals(self) -> DataFrame:
        return billing.household_daily(self.batch_valid)

    @cached_property
    def bills(self) -> DataFrame:
        return billing.daily_bills(self.totals, self.tariff, self.open_days.select("sim_date"))

    @cached_property
    def speed_valid(self) -> DataFrame:
        """Validated first, then deduplicated, as the stream does; what arrives behind the watermark is too late."""
        return billing.dedup_earliest(self.marked.where("reason IS NULL")).where(f"ingest_ts <= event_ts + INTERVAL {SETTINGS.watermark}")

    @cached_property
    def speed_totals(self) -> DataFrame:
        return billing.household_daily(self.speed_valid)

    @cached_property
    def speed_bills(self) -> DataFrame:
        return billing.provisional_bills(self.speed_totals, self.tariff_all)

    @cached_property
    def windows(self) -> DataFrame:
        out = rollups.zone_windows(self.speed_valid)
        return out.withColumn("updated_at", F.timestamp_micros(F.floor(F.unix_micros(to_real(F.col("window_end"))) / 1_000_000) * 1_000_000))

    @cached_property
    def zone_days(self) -> DataFrame:
        return rollups.zone_daily(self.batch_valid)

    @cached_property
    def reconciled(self) -> DataFrame:
        return reconcile.reconciled_layers(self.priced)

    @cached_property
    def priced(self) -> DataFrame:
        """Both layers' bills of every household and day, from one pass over the readings."""
        every = self.roster.select("household_id").crossJoin(F.broadcast(self.open_days.select("sim_date")))  # days of the calendar
        layers = billing.layered_totals(self.marked, SETTINGS.watermark, every)
        return reconcile.priced_layers(layers, self.tariff_all)

    @cached_property
    def ledger_events(self) -> DataFrame:
        """Runs by rule on day d: the first fails if d % 7 = 3 and is repeated; if d % 5 = 0 the day is restated;
        the last day's run has not ended."""
        days = self.open_days.withColumn("last", F.lit(False))
        top = self.open_days.agg(F.max("d").alias("top"))
        days = days.crossJoin(F.broadcast(top)).withColumn("last", F.col("d") == F.col("top"))
        fails = "d % 7 = 3"
        steps = [
            ("true", "1", 0, "'running'"), ("NOT last", "1", 1, f"IF({fails}, 'failed', 'success')"), (f"NOT last AND {fails}", "2", 2, "'running'"), (f"NOT last AND {fails}", "2", 3, "'success'"),
            ("NOT last AND d % 5 = 0", "9", 4, "'running'"), (f"NOT last AND d % 5 = 0 AND NOT {fails}", "1", 5, "'superseded'"), (f"NOT last AND d % 5 = 0 AND {fails}", "2", 5, "'superseded'"), ("NOT last AND d % 5 = 0", "9", 6, "'success'"),
        ]
        steps = F.array(*[F.when(F.expr(when), F.struct(F.lit(run).alias("run"), F.lit(seq).alias("seq"), F.expr(status).alias("status"))) for when, run, seq, status in steps])
        out = days.select("d", "sim_date", F.explode(F.filter(steps, lambda s: s.isNotNull())).alias("s")).select("d", "sim_date", "s.*")
        done = F.col("status") != "running"
        return out.select(F.concat_ws("-", F.lit("run"), F.col("sim_date").cast("string"), "run").alias("run_id"), "sim_date", F.lit("batch").alias("layer"), "seq", "status", F.when(done, 1000 + F.col("d")).cast("long").alias("rows_in"), F.when(done, 100 + F.col("d")).cast("long").alias("rows_out"), F.expr("timestamp '2024-06-01 00:05:00' + make_interval(0, 0, 0, 0, 0, 0, d * 300 + seq * 10)").alias("at"))

    @cached_property
    def runs(self) -> DataFrame:
        return ledger.ledger_state(self.ledger_events)

    @cached_property
    def history(self) -> DataFrame:
        """Bills of every run that succeeded at a time; a restated day's block 1 costs 1.00 more."""
        done = self.ledger_events.where("status = 'success'").select("run_id", "sim_date", F.col("run_id").endswith("-9").alias("restated"))
        every = billing.billable(self.totals, self.tariff, self.open_days.select("sim_date"))
        raised = F.when(F.col("restated"), F.col("block_1_rate") + 1).otherwise(F.col("block_1_rate")).cast("decimal(12,2)")
        return billing.price(every.join(F.broadcast(done), "sim_date").withColumn("block_1_rate", raised), "final_bill")


def presentable(df: DataFrame, columns: list[str]) -> DataFrame:
    """The columns with types that any engine writes alike: decimals as doubles, whole numbers as longs, dates
    and times as text."""
    kinds = dict(df.dtypes)
    out = []
    for name in columns:
        kind, c = kinds[name], F.col(name)
        if kind.startswith("decimal"):
            c = c.cast("double")
        elif kind in ("int", "smallint", "tinyint"):
            c = c.cast("long")
        elif kind.startswith("timestamp"):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")
        elif kind == "date":
            c = c.cast("string")
        out.append(c.alias(name))
    return df.select(*out)
