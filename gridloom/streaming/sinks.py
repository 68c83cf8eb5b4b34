"""Sinks of the speed layer by micro-batch. Each measures its batch on the way, as observed metrics of the one job that
writes it, and keeps one record of each batch; a batch that is run again counts once."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from gridloom.functions import latency, rules
from gridloom.operators import billing
from gridloom.sources import files
from gridloom.sources.sinks import dead_letter_records, dead_letters
from gridloom.sources.tables import Table
from gridloom.types import SETTINGS, Settings

Sink = Callable[[DataFrame, int], None]
Topic = Callable[[DataFrame, int], None]
#: Where a window carries its newest record's time on the way to the sink.
NEWEST = "newest_record_ts"


class BatchLog:
    """What was measured of the latest batches, by query and batch."""

    def __init__(self, kept: int = 1000):
        self.kept, self.records, self._lock = kept, {}, threading.Lock()

    def add(self, query: str, batch: int, **values) -> None:
        with self._lock:
            self.records[query, batch] = values
            for key in list(self.records)[: -self.kept]:
                del self.records[key]

    def of(self, query: str) -> list[dict]:
        return [{"batch": batch, **values} for (name, batch), values in sorted(self.records.items()) if name == query]


def view_sink(table: Table, log: BatchLog | None = None, name: str = "view") -> Sink:
    """A table revised by key."""

    def write(batch: DataFrame, batch_id: int) -> None:
        seen = Observation()
        if table.upsert(batch.observe(seen, F.count(F.lit(1)).alias("rows")), name, batch_id) and log:
            log.add(name, batch_id, **seen.get)

    return write


def zone_sink(table: Table, log: BatchLog, s: Settings = SETTINGS, name: str = "zones") -> Sink:
    """Windows by zone into their table, with the latency of each window written: from its newest record's time until
    the table has it. Windows without such a time, or with one that lies ahead, are counted but have no latency. The
    ratio of each zone's newest window is kept from the very rows that are written."""

    def write(batch: DataFrame, batch_id: int) -> None:
        began = datetime.now(UTC)
        now = F.lit(began.isoformat()).cast("timestamp")
        ratio = lambda z: F.max_by(F.when(F.col("grid_zone") == z, F.col("renewable_ratio")), F.when(F.col("grid_zone") == z, F.col("window_start")))
        seen = Observation()
        measures = [*latency.sketched(F.col(NEWEST), now), *[ratio(z).alias(f"ratio {z}") for z in s.zones]]
        # observed in front of the merge: columns that the table doesn't keep are still there
        if table.upsert(batch.observe(seen, *measures).drop(NEWEST), name, batch_id):
            got = seen.get
            quantiles = latency.told(batch.sparkSession, got["sketch"], (datetime.now(UTC) - began).total_seconds())
            ratios = {z: got[f"ratio {z}"] for z in s.zones if got[f"ratio {z}"] is not None}
            log.add(name, batch_id, rows=got["rows"], observed=got["rows"] - got["unknown"] - got["ahead"], ratios=ratios, **quantiles)

    return write


def bill_sink(table: Table, tariff: DataFrame, log: BatchLog | None = None, name: str = "bills") -> Sink:
    """Estimates of a batch's household days, each at the tariff in force on the day before it, however many days the
    batch has. Household days without one are counted and skipped, never priced by guess."""

    def write(batch: DataFrame, batch_id: int) -> None:
        came, made = Observation(), Observation()
        bills = billing.provisional_bills(batch.observe(came, F.count(F.lit(1)).alias("n")), tariff)
        if table.upsert(bills.observe(made, F.count(F.lit(1)).alias("n")), name, batch_id) and log:
            n, written = came.get["n"], made.get["n"]
            log.add(name, batch_id, rows=n, written=written, skipped=n - written)

    return write


def file_topic(path: str) -> Topic:
    """Records (key, value) as JSON lines, a folder for each batch: what a broker's topic is where there is none."""
    return lambda records, batch_id: records.write.mode("overwrite").json(f"{path.rstrip('/')}/batch={batch_id}")


def kafka_topic(servers: str, topic: str) -> Topic:
    """Records to a topic; a batch that is run again sends them again. Needs the Kafka connector on the class path."""
    return lambda records, _: records.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def validation_sink(path: str, roster: DataFrame, topic: Topic | None = None, log: BatchLog | None = None, stage: str = "speed", s: Settings = SETTINGS) -> Sink:
    """Rejected readings of a batch as dead letters, in a table and on a topic, and the batch's account.

    The batch is read once: the job that writes the rejects also counts what comes in and what is rejected, by reason;
    the topic gets its records from the rejects as written. The account (in = out + rejected) is written when both
    have them. If the topic or the account fails, the batch is run again and everything is written in its place.
    """
    reasons = list(rules.rules(F.lit(True), s))

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, seen, folder = batch.sparkSession, Observation(), f"{path}/rejects/batch={batch_id}"
        measures = [F.count(F.lit(1)).alias("rows_in"), F.count("reason").alias("rows_rejected"), *[F.count_if(F.col("reason") == r).alias(r) for r in reasons]]
        letters = dead_letters(rules.rejected(rules.with_reason(batch, roster, s).observe(seen, *measures)), stage)
        letters.write.mode("overwrite").parquet(folder)
        got = seen.get
        account = {"rows_in": got["rows_in"], "rows_rejected": got["rows_rejected"]}
        account |= {"rows_out": account["rows_in"] - account["rows_rejected"], "reasons": {r: got[r] for r in reasons if got[r]}}
        if topic is not None:
            topic(dead_letter_records(spark.read.schema(letters.schema).parquet(folder)), batch_id)
        files.put(spark, f"{path}/accounts/{batch_id:012d}.json", json.dumps({"batch": batch_id, "stage": stage, **account}).encode())
        if log:
            log.add(stage, batch_id, **account)

    return write


def accounts(spark: SparkSession, path: str) -> DataFrame:
    """The accounts of all batches that validation_sink has finished."""
    return spark.read.schema("batch long, stage string, rows_in long, rows_out long, rows_rejected long, reasons map<string, long>").json(f"{path}/accounts")


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """The dead letters of all batches, and of each its batch."""
    return spark.read.parquet(f"{path}/rejects")
