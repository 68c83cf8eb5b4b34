"""What the text operators share: reading, cutting lineage, connected components."""

from __future__ import annotations

import contextlib
import gc
import re
import tempfile
import time
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words: space and U+0009 to U+000D, as a regular expression class.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; one of our own only where it is unset and
    driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if not context.getCheckpointDir():
        if not re.fullmatch(r"local(\[[^-]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="gridloom-"))
    return context.getCheckpointDir()


def staged(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here, lost executors cost nothing twice."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/gridloom-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gridloom_path = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_gridloom_path", None)
        if path:
            jvm = df.sparkSession._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


_owners: list[list[DataFrame]] = []


@contextlib.contextmanager
def owned():
    """Tables that operators keep for their results go at the end of this scope, when the results are written."""
    _owners.append([])
    try:
        yield
    finally:
        unstage(*_owners.pop())


class Scratch:
    """Staged tables with an owner: with Scratch() as stage, stage(df) stages df, and at the end every table
    goes but those in stage.kept, which a result still reads."""

    def __init__(self):
        self.tables: list[DataFrame] = []
        self.kept: list[DataFrame] = []

    def __call__(self, df: DataFrame) -> DataFrame:
        out = staged(df)
        self.tables.append(out)
        return out

    def keep(self, df: DataFrame) -> DataFrame:
        """A staged table that outlives this scope; the owner of the result that reads it (owned) deletes it."""
        out = self(df)
        self.kept.append(out)
        for tables in _owners[-1:]:
            tables.append(out)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """These tables go."""
        unstage(*tables)
        gone = {id(df) for df in tables}
        self.tables = [df for df in self.tables if id(df) not in gone]

    def release(self, spark: SparkSession) -> None:
        """After a large shuffle has been read and its result written: the driver's collectors find the finished
        plan, and Spark's cleaner, which takes a moment, deletes its files."""
        for _ in range(2):
            gc.collect()
            spark._jvm.System.gc()
            time.sleep(0.5)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        kept = {id(df) for df in self.kept}
        self.drop(*[df for df in self.tables if id(df) not in kept])


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected graph of long ids: (node, component), component its smallest node.

    Alternating large-star and small-star steps: each is a partial minimum by node and an equi-join on
    the node, so a hub of any degree is split by adaptive skew joins and never gathered in one group.
    Every round is written to the shared folder, and so is the result, which the caller deletes. Nodes
    without links do not appear; null ids are ignored.
    """
    start = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    with Scratch() as stage:
        now = stage(start)
        mark = _mark(now)
        while mark[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
            large = stage(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
            low = large.groupBy("u").agg(F.min("v").alias("m"))
            small = large.join(low, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            after = stage(small)
            stage.drop(now, large)
            now, before, mark = after, mark, _mark(after)
            if mark == before:
                break
        low = now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
        roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        return stage.keep(low.unionByName(roots).groupBy("node").agg(F.min("component").alias("component")))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Batches of at most so many rows for Python, where rows are large; of what is written within."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def by_batch(df: DataFrame, run, schema: str) -> DataFrame:
    """mapInArrow with rows as Python lists: run takes an iterator of {column: list} and yields such dicts.

    Longs and nulls stay exact, which pandas columns with nulls don't give.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def batches(source):
        for out in run(b.to_pydict() for b in source):
            yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(batches, schema)


def packed(counts, width: str = "<u4") -> bytes:
    """A block of counters, compressed: a task's are mostly small or zero."""
    return zlib.compress(counts.astype(width).tobytes(), 1)


def summed_blocks(rows: DataFrame, width: str = "<u4") -> DataFrame:
    """Rows (block int, counts binary) added up by block, in two steps so that no task reads all tasks' blocks.

    A task holds one array for each of its blocks; sums stop at the largest number of the width.
    """
    import numpy as np

    def add(source):
        total: dict[int, np.ndarray] = {}
        for batch in source:
            for k, raw in zip(batch["block"], batch["counts"]):
                more = np.frombuffer(zlib.decompress(raw), width).astype(np.uint64)
                total[k] = total[k] + more if k in total else more
        most = np.iinfo(width).max
        yield {"block": list(total), "counts": [packed(np.minimum(x, most), width) for x in total.values()]}

    rows = rows.select("block", "counts").withColumn("part", F.spark_partition_id() % 16)
    rows = by_batch(rows.repartition("block", "part").drop("part"), add, "block int, counts binary")
    return by_batch(rows.repartition("block"), add, "block int, counts binary")


def collected_blocks(rows: DataFrame, size: int, width: str = "<u4"):
    """The array of size counters that summed blocks make up; its size is fixed, whatever the input."""
    import numpy as np

    out = None
    for row in rows.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["counts"]), width)
        out = np.zeros(size, width) if out is None else out
        out[row["block"] * len(part) : (row["block"] + 1) * len(part)] = part
    return np.zeros(size, width) if out is None else out
