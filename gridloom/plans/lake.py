"""The domain's files, made once from the events table in the shared folder: archive, landing zone, published runs."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.operators import billing, rollups
from gridloom.operators.ledger import RunLedger, publish_days
from gridloom.plans.world import World
from gridloom.sources import files, sinks
from gridloom.sources import readings as log
from gridloom.sources.readings import Layout


def scratch(w: World) -> str:
    """A new folder that the driver and all executors share."""
    root = w.spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    if not w.spark.sparkContext.master.startswith("local") or "cluster" in w.spark.sparkContext.master:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = tempfile.mkdtemp(prefix="gridloom-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    return made


class Lake:
    """Folders under a new root. Each is written when it is first asked for."""

    def __init__(self, w: World):
        self.w, self.layout = w, Layout(scratch(w))

    @cached_property
    def raw(self) -> str:
        """The archive of all readings, by day and hour."""
        out = log.with_partitions(self.w.raw).repartition("sim_date", "hour")
        out.write.mode("overwrite").partitionBy("sim_date", "hour").parquet(self.layout.raw())
        return self.layout.raw()

    @cached_property
    def landing(self) -> str:
        """A tariff CSV for each day, the day before the first reading included: folders named like the files."""
        made = f"{self.layout.root}/made"
        text = self.w.tariff_all.withColumn("day", F.col("effective_date").cast("string"))
        text.repartition("day").write.option("header", "true").partitionBy("day").mode("overwrite").csv(made)
        for name in files.names(self.w.spark, made):
            if name.startswith("day="):
                files.move(self.w.spark, f"{made}/{name}", self.layout.landing("tariff", name[4:]))
        return f"{self.layout.root}/landing/tariff"

    @property
    def tariff(self) -> DataFrame:
        """All tariffs, from their files."""
        return log.read_tariff(self.w.spark, *[f"{self.landing}/{name}/*.csv" for name in files.names(self.w.spark, self.landing)])

    @cached_property
    def totals(self) -> DataFrame:
        """Household days, written once."""
        path = f"{self.layout.root}/totals"
        self.w.totals.write.mode("overwrite").parquet(path)
        return self.w.spark.read.parquet(path)

    @cached_property
    def ledger(self) -> RunLedger:
        return RunLedger(self.w.spark, f"{self.layout.root}/ledger")

    def bill(self, runs: dict, tariff: DataFrame) -> None:
        """A run for each day: its tariff is archived, its bills come from the archive, and all are published."""
        for_day = F.create_map(*[F.lit(x) for pair in runs.items() for x in (str(pair[0]), pair[1])])
        days = self.w.spark.createDataFrame([(day,) for day in runs], "sim_date date")
        held = billing.tariff_effective(tariff, days).drop("rows_in_force").withColumn("run_id", for_day[F.col("sim_date").cast("string")])
        held.write.mode("append").partitionBy("sim_date", "run_id").parquet(f"{self.layout.root}/archive/tariff")
        kept = sinks.archived_tariffs(self.w.spark, self.layout.root).where(F.col("run_id").isin(*runs.values())).drop("run_id")
        own = kept.drop("effective_date").withColumnRenamed("sim_date", "effective_date")
        totals = self.totals.join(F.broadcast(days), "sim_date", "left_semi")
        publish_days(self.ledger, self.layout.root, runs, {"bills": billing.daily_bills(totals, own, days)}, "bills")

    def runs(self) -> tuple[dict, dict, dict, dict]:
        """The runs of each day but the last (sim_date to run_id): first runs that fail, those that succeed at first or
        on repetition, restatements; and the last day's run, which does not end."""
        days = [r["sim_date"] for r in self.w.open_days.orderBy("sim_date").collect()]
        name = lambda day, n: f"run-{day}-{n}"
        failed = {day: name(day, 1) for d, day in enumerate(days[:-1]) if d % 7 == 3}
        first = {day: name(day, 2 if day in failed else 1) for day in days[:-1]}
        again = {day: name(day, 9) for d, day in enumerate(days[:-1]) if d % 5 == 0}
        return failed, first, again, {day: name(day, 1) for day in days[-1:]}

    @staticmethod
    def failed_runs(book: RunLedger, failed: dict) -> None:
        if failed:
            book.start_all(failed)
            book.fail_all(failed)

    @cached_property
    def published(self) -> str:
        """Bills of all days but the last one: some days' first run fails and is repeated, some are restated with a
        higher block 1."""
        failed, first, again, _ = self.runs()
        self.failed_runs(self.ledger, failed)
        if first:
            self.bill(first, self.w.tariff_all)
        if again:
            self.bill(again, self.w.tariff_all.withColumn("block_1_rate", (F.col("block_1_rate") + 1).cast("decimal(12,2)")))
        return self.layout.root

    @cached_property
    def booked(self) -> DataFrame:
        """What the ledger tells when these runs, and the last day's, have been entered one after the other."""
        book = RunLedger(self.w.spark, f"{self.layout.root}/booked")
        failed, first, again, last = self.runs()
        self.failed_runs(book, failed)
        for runs in (first, again):
            if runs:
                book.start_all(runs)
                book.succeed_all([(run_id, day, 1000, 100) for day, run_id in runs.items()])
        if last:
            book.start_all(last)
        return book.runs()


_lakes: dict[tuple[str, str], Lake] = {}


def lake(w: World) -> Lake:
    """The files of a data folder: written once in an application, read by all queries that ask for them."""
    return _lakes.setdefault((w.spark.sparkContext.applicationId, w.dir), Lake(w))


def published_rollup(w: World, day) -> tuple[Lake, DataFrame]:
    """The windows that are left when the zone days until a day have been published."""
    lake = Lake(w)
    windows = rollups.window_table(w.spark, f"{lake.layout.root}/windows")
    windows.upsert(w.windows)
    until = w.zone_days.where(F.col("sim_date") <= F.lit(day))
    runs = {r["sim_date"]: f"rollup-{r['sim_date']}" for r in w.open_days.where(F.col("sim_date") <= F.lit(day)).collect()}
    rollups.publish_rollup(lake.ledger, lake.layout.root, runs, until, windows)
    return lake, windows.read()
