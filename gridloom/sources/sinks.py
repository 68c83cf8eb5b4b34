"""Sinks: days replaced whole, dead letters, archived tariffs, compaction. All writes stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.sources import files
from gridloom.sources.readings import Layout


def replace_day(df: DataFrame, path: str, day: str, column: str = "sim_date") -> None:
    """Write a day's rows in place of those there; rows of another day are refused."""
    if df.where(~F.col(column).eqNullSafe(F.lit(day).cast("date"))).limit(1).count():
        raise ValueError(f"rows of another day than {day}")
    df.drop(column).write.mode("overwrite").parquet(f"{path}/{column}={day}")


def dead_letters(rejected: DataFrame, stage: str) -> DataFrame:
    """Rejected readings as (stage, reason, trace_id, raw_payload)."""
    trace = F.col("trace_id") if "trace_id" in rejected.columns else F.get_json_object("payload", "$.trace_id")
    return rejected.select(F.lit(stage).alias("stage"), "reason", trace.alias("trace_id"), F.col("payload").alias("raw_payload"))


def dead_letter_records(letters: DataFrame) -> DataFrame:
    """Key and JSON value for a dead-letter topic."""
    return letters.select(F.col("trace_id").alias("key"), F.to_json(F.struct(*letters.columns)).alias("value"))


def archive_tariff(tariff: DataFrame, root: str, day: str, run_id: str) -> str:
    """The tariff that a run billed a day with, as it was: a folder of its own for each day and run, which no other
    run touches, decimals kept. A bill can be computed again from it when the landing files are gone or changed."""
    path = Layout(root).archive(day, run_id)
    tariff.write.mode("overwrite").parquet(path)
    return path


def archived_tariff(spark: SparkSession, root: str, day: str, run_id: str) -> DataFrame:
    """The tariff that archive_tariff kept for this day and run; an error if that run kept none."""
    return spark.read.parquet(Layout(root).archive(day, run_id))


def archived_tariffs(spark: SparkSession, root: str) -> DataFrame:
    """All archived tariffs with the day and the run that billed with them."""
    path = f"{Layout(root).root}/archive/tariff"
    return spark.read.parquet(path).withColumn("sim_date", F.col("sim_date").cast("date")).withColumn("run_id", F.col("run_id").cast("string"))


def recover_day(spark: SparkSession, archive: str, day: str) -> None:
    """After a compaction that broke off between its two renames: the day's old files are put back."""
    held, live = f"{archive}/_replaced/sim_date={day}", f"{archive}/sim_date={day}"
    if files.exists(spark, held):
        if files.exists(spark, live):
            files.delete(spark, held)
        else:
            files.move(spark, held, live)


def compact_day(spark: SparkSession, archive: str, day: str, target_rows: int = 1_000_000) -> None:
    """Rewrite a closed day's small files into few, hour by hour. The new files are complete before the day's folder
    is exchanged by two renames; recover_day puts the old ones back if only the first one happened."""
    recover_day(spark, archive, day)
    copy, live, held = (f"{archive}/{where}sim_date={day}" for where in ("_compacting/", "", "_replaced/"))
    df = spark.read.parquet(live)
    per_hour = df.groupBy("hour").agg(F.ceil(F.count("*") / target_rows).alias("parts"))  # at most 24 rows
    spread = df.join(F.broadcast(per_hour), "hour").withColumn("part", F.floor(F.rand(7) * F.col("parts")))
    spread.repartition("hour", "part").drop("parts", "part").write.option("maxRecordsPerFile", target_rows).partitionBy("hour").mode("overwrite").parquet(copy)
    files.move(spark, live, held)
    files.move(spark, copy, live)
    files.delete(spark, held)
