"""Latencies as sketches of a bounded size: counts by fixed buckets, and quantile sketches that can be shifted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: upper bounds of the latency buckets in seconds; one more bucket is open
BOUNDS = (0.5, 1, 2, 5, 10, 15, 30, 60, 120, 300, 600)


def since(moment: Column, now: Column) -> Column:
    """Seconds from a moment until now, with microseconds; null for a null moment, and for one that lies ahead, which
    a clock that runs ahead makes and which is no latency."""
    seconds = (F.unix_micros(now) - F.unix_micros(moment)) / F.lit(1_000_000.0)
    return F.when(seconds >= 0, seconds)


def counts(seconds: Column, bounds: tuple[float, ...] = BOUNDS) -> list[Column]:
    """Aggregates le_0, le_1, ...: how many latencies are within each bound, and n, how many there are."""
    return [*[F.count_if(seconds <= b).alias(f"le_{k}") for k, b in enumerate(bounds)], F.count(seconds).alias("n")]


def quantile(q: float, bounds: tuple[float, ...] = BOUNDS) -> Column:
    """The quantile that counts tell, by straight lines within the buckets: it is off by less than the width of the
    bucket it lies in. Beyond the last bound that bound is told; without latencies it is null."""
    rank = F.lit(q) * F.col("n")
    out = F.lit(float(bounds[-1]))
    for k in reversed(range(len(bounds))):
        low, below = (F.lit(float(bounds[k - 1])), F.col(f"le_{k - 1}")) if k else (F.lit(0.0), F.lit(0))
        width = F.col(f"le_{k}") - below
        inside = low + (F.lit(float(bounds[k])) - low) * (rank - below) / F.nullif(width, F.lit(0))
        out = F.when(F.col(f"le_{k}") >= rank, F.coalesce(inside, F.lit(float(bounds[k])))).otherwise(out)
    return F.when(F.col("n") > 0, out)


def histogram(latencies: DataFrame, seconds: str = "seconds", qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """One row: the counts of latencies and the quantiles they tell (p50, ...). The state is one counter for each
    bucket, whatever the input; null latencies count nowhere."""
    out = latencies.agg(*counts(F.col(seconds)))
    return out.select("*", *[quantile(q).alias(f"p{round(100 * q)}") for q in qs])


def sketched(moment: Column, now: Column) -> list[Column]:
    """Aggregates for Dataset.observe: rows, how many have no moment and how many lie ahead, and a quantile sketch of
    the other latencies (its ranks are off by about 1.3 %)."""
    return [F.count(F.lit(1)).alias("rows"), F.count_if(moment.isNull()).alias("unknown"), F.count_if(moment > now).alias("ahead"), F.kll_sketch_agg_double(since(moment, now)).alias("sketch")]


def told(spark, sketch: bytes | None, later: float, qs: tuple[float, ...] = (0.5, 0.95, 0.99)) -> dict[str, float | None]:
    """Quantiles of a sketch, moved by the seconds that have passed since it was made."""
    if sketch is None:
        return {f"p{round(100 * q)}": None for q in qs}
    got = spark.createDataFrame([(bytearray(sketch),)], "k binary").select(F.kll_sketch_get_n_double("k").alias("n"), F.when(F.kll_sketch_get_n_double("k") > 0, F.kll_sketch_get_quantile_double("k", F.array(*map(F.lit, qs)))).alias("p")).first()
    return {f"p{round(100 * q)}": None if got.p is None else got.p[k] + later for k, q in enumerate(qs)}
