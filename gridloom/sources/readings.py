"""Reading the log, the archive and the reference files; where everything lies."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, StructType

from gridloom.functions.clock import partition_columns
from gridloom.sources import files
from gridloom.types import FIXED_CHARGE, READING, TARIFF, WEATHER

_DAY_COLUMNS = ("event_id", "trace_id", "meter_id", "household_id", "grid_zone", "event_ts", "consumption_kwh", "solar_generation_kwh", "ingest_ts")


def decode(log: DataFrame, value: str = "value") -> DataFrame:
    """The reading in each record's JSON value, beside the record's other columns; unparseable text gives
    nulls throughout and stays readable in raw_value."""
    text = F.col(value).cast("string")
    return log.withColumn("raw_value", text).withColumn("r", F.from_json("raw_value", READING)).select("r.*", *[c for c in log.columns if c != value], "raw_value")


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "earliest") -> DataFrame:
    """The topic as a stream of readings with key, timestamp, partition, offset and headers. Needs the Kafka
    connector on the class path."""
    options = {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting, "includeHeaders": "true", "failOnDataLoss": "true"}
    log = spark.readStream.format("kafka").options(**options).load()
    return decode(log.select("value", *[F.col(c).alias(f"kafka_{c}") for c in ("key", "timestamp", "partition", "offset", "headers")]))


def file_stream(spark: SparkSession, path: str, per_trigger: int = 1) -> DataFrame:
    """JSON lines files as a stream of readings, through the same decoder."""
    return decode(spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path))


def read_day(spark: SparkSession, archive: str, sim_date: str) -> DataFrame:
    """One day of the archive: one partition folder, the columns that billing needs."""
    df = spark.read.parquet(archive).where(F.col("sim_date") == F.lit(sim_date).cast("date"))
    return df.select(*[c for c in _DAY_COLUMNS if c in df.columns])


def with_partitions(readings: DataFrame) -> DataFrame:
    """readings with ingest_ts (now, unless there), sim_date and hour of the event in UTC."""
    if "ingest_ts" not in readings.columns:
        readings = readings.withColumn("ingest_ts", F.current_timestamp())
    return readings.withColumns(partition_columns(F.col("event_ts")))


def _checks(schema: StructType) -> dict[str, Column]:
    """What is wrong with a row of text, by field, in the order of the contract."""
    found = {}
    for name, kind in ((f.name, f.dataType) for f in schema.fields):
        value = F.col(f"t.{name}")
        typed = flag(value) if kind == BooleanType() else value.try_cast(kind)
        bad = F.coalesce(value, F.lit("")).isin("") | typed.isNull()
        if isinstance(kind, DecimalType):  # digits that the type would round away are not the contract's
            bad = bad | ~F.coalesce(value.rlike(rf"^\s*-?[0-9]+(\.[0-9]{{0,{kind.scale}}}0*)?\s*$"), F.lit(False))
            if name in ("fixed_charge", "export_rate") or name.endswith("_rate"):
                bad = bad | (typed < 0)
            elif name.endswith("_pct"):
                bad = bad | ~typed.between(0, 100)
        elif name == "billing_tier":
            bad = bad | ~value.isin(*FIXED_CHARGE)
        found[name] = F.coalesce(bad, F.lit(True))
    return found


def flag(text: Column) -> Column:
    """true or 1, false or 0, in any case; null for anything else."""
    return F.when(F.lower(text).isin("true", "1"), True).when(F.lower(text).isin("false", "0"), False)


def parsed(found: DataFrame, schema: StructType, what: str) -> DataFrame:
    """Typed rows of CSV files given as (path, content), each checked against the contract: a header that differs, a
    row with too few or too many fields, and a value outside its type or bounds fail the query, and the error names
    file, line, field and value. Lines are numbered from 1, which is the header; empty lines are passed over."""
    head = ",".join(schema.names)
    lines = found.select("path", F.posexplode(F.split(F.decode("content", "UTF-8"), r"\r\n|\n|\r")).alias("n", "line"))
    place = lambda why: F.raise_error(F.concat(F.lit(f"bad {what}: "), F.col("path"), F.lit(" line "), (F.col("n") + 1).cast("string"), F.lit(": "), why))
    header = F.when(F.regexp_replace("line", "^\\uFEFF|[ \\t]+$", "") != head, place(F.concat(F.lit("header is "), F.col("line")))).cast("string")
    rows = lines.where(F.when(F.col("n") == 0, header.isNotNull()).otherwise(F.trim("line") != ""))
    text = ", ".join(f"{name} string" for name in schema.names)
    rows = rows.withColumn("t", F.from_csv("line", f"{text}, _broken string", {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    faults = [F.when(F.col("t._broken").isNotNull(), place(F.concat(F.lit("fields are not as many as in the header: "), F.col("line"))))]
    faults += [F.when(bad, place(F.concat(F.lit(f"{name} is "), F.coalesce(F.col(f"t.{name}"), F.lit("missing"))))) for name, bad in _checks(schema).items()]
    out = rows.where(F.coalesce(*[f.cast("string") for f in faults]).isNull())
    return out.select(*[(flag(F.col(f"t.{f.name}")) if f.dataType == BooleanType() else F.col(f"t.{f.name}").try_cast(f.dataType)).alias(f.name) for f in schema.fields])


def read_tariff(spark: SparkSession, *paths: str) -> DataFrame:
    """Tariff CSV files, or folders of them, checked (parsed). A file is read by one task, so it should be of some
    hundred MB at most; a larger tariff comes in several files."""
    return parsed(spark.read.format("binaryFile").load(list(paths)).select("path", "content"), TARIFF, "tariff row")


def tariff_of(spark: SparkSession, data: bytes, name: str = "bytes") -> DataFrame:
    """The tariff in the bytes of a CSV file, by the same rule."""
    return parsed(spark.createDataFrame([(name, bytearray(data))], "path string, content binary"), TARIFF, "tariff row")


def read_weather(spark: SparkSession, *paths: str) -> DataFrame:
    """Weather forecasts from CSV, by the same rule."""
    return parsed(spark.read.format("binaryFile").load(list(paths)).select("path", "content"), WEATHER, "forecast")


def pending_days(spark: SparkSession, layout: Layout) -> DataFrame:
    """Days whose tariff file has come and that have raw readings, in order (sim_date): the days to bill, run or not.
    Names of files and folders are all that is looked at; no file is opened."""
    told = {m[1] for name in files.names(spark, f"{layout.root}/landing/tariff") if (m := re.fullmatch(r"tariff_(\d{4}-\d{2}-\d{2})\.csv", name))}
    held = {name.partition("=")[2] for name in files.names(spark, layout.raw()) if name.startswith("sim_date=")}
    return spark.createDataFrame([(date.fromisoformat(day),) for day in sorted(told & held)], "sim_date date")


class Layout:
    """Where data lies under one root."""

    def __init__(self, root: str):
        self.root = root.rstrip("/")

    def raw(self, sim_date: str | None = None, hour: int | None = None) -> str:
        parts = [f"sim_date={sim_date}"] * (sim_date is not None) + [f"hour={hour}"] * (hour is not None)
        return "/".join([self.root, "raw", *parts])

    def landing(self, kind: str, sim_date: str) -> str:
        return f"{self.root}/landing/{kind}/{kind}_{sim_date}.csv"

    def archive(self, sim_date: str, run_id: str) -> str:
        return f"{self.root}/archive/tariff/sim_date={sim_date}/run_id={run_id}"

    def report(self, sim_date: str) -> str:
        return f"{self.root}/reports/report_{sim_date}.md"
