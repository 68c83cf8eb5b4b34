"""The run ledger: events are appended, a run's state is its latest event; a bill is current if its run succeeded."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import files

STATES = ("running", "success", "failed", "superseded")


def ledger_state(events: DataFrame) -> DataFrame:
    """One row per run: the day, layer, latest status, rows, start and end."""
    last = F.max(F.struct("seq", "status", "rows_in", "rows_out", "at")).alias("m")
    out = events.groupBy("run_id", "sim_date", "layer").agg(F.min("at").alias("started_at"), last)
    return out.select("run_id", "sim_date", "layer", "started_at", F.col("m.status").alias("status"), F.col("m.rows_in").alias("rows_in"), F.col("m.rows_out").alias("rows_out"), F.when(F.col("m.status") != "running", F.col("m.at")).alias("finished_at"))


def double_success(runs: DataFrame) -> DataFrame:
    """Days and layers with more than one successful run: there must be none."""
    return runs.where("status = 'success'").groupBy("sim_date", "layer").count().where("count > 1")


def finalised_days(runs: DataFrame) -> DataFrame:
    return runs.where("status = 'success' AND layer = 'batch'").select("sim_date").distinct()


def current(history: DataFrame, runs: DataFrame) -> DataFrame:
    """Rows of the history (run_id) whose run is the day's successful one."""
    return history.join(runs.where("status = 'success'").select("run_id"), "run_id", "left_semi")


EVENT = "run_id string, sim_date date, layer string, seq long, status string, rows_in long, rows_out long, at timestamp"


class RunLedger:
    """A ledger kept as numbered files of JSON lines, one file a change, each written under a number that nobody has:
    of two writers one is second, and decides again from what the first one wrote."""

    def __init__(self, spark: SparkSession, path: str, clock: Callable[[], datetime] = datetime.now):
        self.spark, self.path, self.clock = spark, path.rstrip("/"), clock

    def _done(self) -> list[str]:
        return [name for name in files.names(self.spark, self.path) if name.endswith(".json") and not name.startswith(".")]

    def _events(self, done: list[str]) -> DataFrame:
        # the files of one moment, by name: a change that comes later is not half seen
        return self.spark.read.schema(EVENT).json([f"{self.path}/{name}" for name in done]) if done else self.spark.createDataFrame([], EVENT)

    def events(self) -> DataFrame:
        return self._events(self._done())

    def runs(self) -> DataFrame:
        return ledger_state(self.events())

    def change(self, decide: Callable[[DataFrame], list[tuple]]) -> list[tuple]:
        """Write the changes (run_id, sim_date, layer, status, rows_in, rows_out) that decide makes of the runs so
        far. If another writer is first, decide is asked again."""
        while True:
            done = self._done()
            changes = decide(ledger_state(self._events(done)))
            number = int(done[-1].removesuffix(".json")) + 1 if done else 0
            now = self.clock().isoformat(sep=" ")
            names = ("run_id", "sim_date", "layer", "status", "rows_in", "rows_out")
            lines = [json.dumps({**dict(zip(names, change)), "seq": number * 1_000_000 + k, "at": now}, default=str) for k, change in enumerate(changes)]
            if not changes or files.put_new(self.spark, f"{self.path}/{number:012d}.json", "\n".join(lines).encode()):
                return changes

    def start(self, run_id: str, day, layer: str = "batch") -> None:
        self.start_all({day: run_id}, layer)

    def start_all(self, begun: dict, layer: str = "batch") -> None:
        """Runs (sim_date to run_id) begin; a run of one of the days that still says running was abandoned, and fails."""

        def decide(runs: DataFrame) -> list[tuple]:
            same = (F.col("status") == "running") & (F.col("layer") == layer) & F.col("sim_date").cast("string").isin(*map(str, begun))
            left = [r for r in runs.where(same).collect() if r.run_id not in begun.values()]  # a few a day
            return [*[(r.run_id, r.sim_date, layer, "failed", r.rows_in, r.rows_out) for r in left], *[(run_id, day, layer, "running", None, None) for day, run_id in begun.items()]]

        self.change(decide)

    def fail(self, run_id: str, day, layer: str = "batch", rows_in: int | None = None) -> None:
        self.fail_all({day: run_id}, layer, {day: rows_in})

    def fail_all(self, ended: dict, layer: str = "batch", rows_in: dict | None = None) -> None:
        """Runs (sim_date to run_id) fail, all at once."""
        self.change(lambda runs: [(run_id, day, layer, "failed", (rows_in or {}).get(day), None) for day, run_id in ended.items()])

    def succeed(self, run_id: str, day, rows_in: int, rows_out: int, layer: str = "batch") -> None:
        """The run counts from now on, and the day's run that counted until now is superseded, both at once."""
        self.succeed_all([(run_id, day, rows_in, rows_out)], layer)

    def succeed_all(self, ended: list[tuple[str, date, int, int]], layer: str = "batch") -> None:
        """The same for runs (run_id, sim_date, rows_in, rows_out) of several days, all at once."""

        def decide(runs: DataFrame) -> list[tuple]:
            days = {str(day): run_id for run_id, day, _, _ in ended}
            counted = runs.where((F.col("status") == "success") & (F.col("layer") == layer) & F.col("sim_date").cast("string").isin(*days)).collect()  # a run a day
            before = [(r.run_id, r.sim_date, layer, "superseded", r.rows_in, r.rows_out) for r in counted if r.run_id != days[str(r.sim_date)]]
            return [*before, *[(run_id, day, layer, "success", rows_in, rows_out) for run_id, day, rows_in, rows_out in ended]]

        self.change(decide)


def _of_days(df: DataFrame, name: str, days: list) -> DataFrame:
    """df, failing on a row of another day."""
    known = F.coalesce(F.col("sim_date").isin(*[F.lit(day) for day in days]), F.lit(False))
    text = F.concat(F.lit(f"{name}: rows of another day than {', '.join(map(str, days[:3]))}: "), F.coalesce(F.col("sim_date").cast("string"), F.lit("null")))
    return df.withColumn("sim_date", F.when(known, F.col("sim_date")).otherwise(F.raise_error(text).cast("date")))


def publish_days(ledger: RunLedger, root: str, runs: dict, tables: dict[str, DataFrame], counted: str, rows_in: dict | None = None, layer: str = "batch") -> None:
    """Write runs' tables (runs: sim_date to run_id) and make them the current ones in one step: readers (published)
    see the rows of the runs whose success the ledger tells, so all tables and days change together, and runs that
    fail, for whatever reason, change none. A table with rows of another day fails them all.

    A table's rows lie by run, so one job writes all days. rows_in, and rows of the table counted, go to the ledger.
    """
    days, rows_in = list(runs), rows_in or {}
    label = F.create_map(*[F.lit(x) for day, run_id in runs.items() for x in (str(day), run_id)])[F.col("sim_date").cast("string")]
    ledger.start_all(runs, layer)
    try:
        for name, df in tables.items():
            out = _of_days(df, name, days).withColumn("run_id", label)
            out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(f"{root.rstrip('/')}/{name}")
        made = {}
        written = [f"{root.rstrip('/')}/{counted}/run_id={run_id}" for run_id in runs.values() if files.exists(ledger.spark, f"{root.rstrip('/')}/{counted}/run_id={run_id}")]
        if written:
            made = {str(r["sim_date"]): r["n"] for r in ledger.spark.read.parquet(*written).groupBy("sim_date").agg(F.count("*").alias("n")).collect()}
    except BaseException:  # an interrupt, too, must not leave runs that never end
        ledger.fail_all(runs, layer, rows_in)
        raise
    ledger.succeed_all([(run_id, day, rows_in.get(day), made.get(str(day), 0)) for day, run_id in runs.items()], layer)


def publish_day(ledger: RunLedger, root: str, run_id: str, day, tables: dict[str, DataFrame], rows_in: int, counted: str) -> None:
    """publish_days for one day."""
    publish_days(ledger, root, {day: run_id}, tables, counted, {day: rows_in})


def published(ledger: RunLedger, root: str, name: str) -> DataFrame:
    """The current rows of a published table, with the run that made them."""
    rows = ledger.spark.read.parquet(f"{root.rstrip('/')}/{name}").withColumn("run_id", F.col("run_id").cast("string"))
    return current(rows, ledger.runs())
