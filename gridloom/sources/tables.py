"""Tables that streams and jobs revise by key.

A table's rows lie in buckets, each a folder of Parquet files in the order of the keys. A manifest names the folder of
every bucket; its versions are numbered files that are written once. A change writes new folders for the buckets it
touches, and only for these, and then the next manifest: readers see the table before or after it. Of two writers who
start from one version the second finds its number taken and goes on from the first one's: buckets that the first did
not touch need no second merge.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from gridloom.sources import files

_BUCKET = "__bucket"


@dataclass(frozen=True)
class Manifest:
    """One version: the folder of each bucket, the rows' schema, and the last batch of each named writer."""

    version: int = -1
    folders: dict[str, str] = field(default_factory=dict)
    schema: dict | None = None
    writers: dict[str, int] = field(default_factory=dict)


def latest(new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """One row for each key: the last in order; of equal ones, or without an order, the one of the greatest hash, so
    that a second run takes the same. Null keys are a key."""
    hashed = F.xxhash64(*new.columns)
    last = F.struct(hashed) if order is None else F.struct(order, hashed)
    return new.groupBy(*keys).agg(F.max_by(F.struct(*new.columns), last).alias("row")).select("row.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: Column | None = None) -> DataFrame:
    """old with the rows of new in place of those with their keys. Null keys are equal."""
    fresh = latest(new, keys, order)
    names = {k: f"__{k}" for k in keys}
    same = [F.col(k).eqNullSafe(F.col(other)) for k, other in names.items()]
    return old.join(fresh.select(*[F.col(k).alias(other) for k, other in names.items()]), same, "left_anti").unionByName(fresh)


class Table:
    """A keyed table at a path. bucket is an expression of the keys (such as the day of a time) whose text names the
    bucket; without one there is a single bucket. The manifest holds a line for each bucket and passes through the
    driver, so buckets should be large: about a million rows keeps 100 TB at some hundred thousand lines."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], bucket: Column | None = None, order: Column | None = None):
        self.spark, self.path, self.keys, self.bucket, self.order = spark, path.rstrip("/"), keys, bucket, order

    def manifest(self) -> Manifest:
        """The newest version; one numbered -1 if nothing has been written."""
        done = [name for name in files.names(self.spark, f"{self.path}/_commits") if name.endswith(".json") and not name.startswith(".")]
        return Manifest(**json.loads(files.get(self.spark, f"{self.path}/_commits/{done[-1]}"))) if done else Manifest()

    def read(self, wanted: Callable[[str], bool] | None = None, version: Manifest | None = None) -> DataFrame:
        """The table's rows; of wanted buckets only, if given."""
        now = version or self.manifest()
        if now.schema is None:
            raise FileNotFoundError(f"nothing has been written to {self.path}")
        folders = [f"{self.path}/{folder}" for name, folder in now.folders.items() if wanted is None or wanted(name)]
        schema = StructType.fromJson(now.schema)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def _commit(self, base: Manifest, after: Manifest) -> bool:
        """Make after the version that follows base, if none does yet. Folders that only versions before base read
        are deleted: readers of base may still be at theirs."""
        number = base.version + 1
        body = json.dumps(replace(after, version=number).__dict__)
        if not files.put_new(self.spark, f"{self.path}/_commits/{number:012d}.json", body.encode()):
            return False
        before = f"{self.path}/_commits/{number - 2:012d}.json"
        if number >= 2 and files.exists(self.spark, before):
            gone = set(json.loads(files.get(self.spark, before))["folders"].values()) - set(base.folders.values()) - set(after.folders.values())
            for folder in gone:
                files.delete(self.spark, f"{self.path}/{folder}")
        return True

    def _write(self, rows: DataFrame) -> dict[str, str]:
        """Rows in a new folder by bucket, files in the order of the keys; the folder of each bucket."""
        text = F.coalesce((F.lit("all") if self.bucket is None else self.bucket).cast("string"), F.lit("none"))
        named = rows.withColumn(_BUCKET, F.when(text.rlike(r"^[A-Za-z0-9_.-]{1,80}$"), text).otherwise(F.md5(text)))
        out = f"data/{uuid.uuid4().hex}"
        named.repartitionByRange(_BUCKET, *self.keys).write.partitionBy(_BUCKET).parquet(f"{self.path}/{out}")
        made = [name for name in files.names(self.spark, f"{self.path}/{out}") if name.startswith(f"{_BUCKET}=")]
        return {name.partition("=")[2]: f"{out}/{name}" for name in made}

    def upsert(self, new: DataFrame, writer: str | None = None, batch: int | None = None) -> bool:
        """Merge new by key, and tell whether it did: a named writer's batch counts once, run again it changes nothing.

        new is computed once and written by bucket; buckets that the table doesn't have yet are taken as they lie,
        the others are merged with the table's. Rows of untouched buckets are neither read nor written.
        """
        base = self.manifest()
        if writer is not None and base.writers.get(writer, -1) >= batch:
            return False
        fresh = self._write(latest(new, self.keys, self.order))
        while True:
            if base.schema is not None and sorted(f["name"] for f in base.schema["fields"]) != sorted(new.columns):
                raise ValueError(f"{self.path} has other columns than the new rows")
            met = [name for name in fresh if name in base.folders]
            merged = {}
            if met:
                old = self.read(set(met).__contains__, base)
                ours = self.spark.read.schema(new.schema).parquet(*[f"{self.path}/{fresh[name]}" for name in met])
                merged = self._write(upsert(old, ours.select(*old.columns), self.keys))
            writers = base.writers if writer is None else {**base.writers, writer: batch}
            after = Manifest(base.version, {**base.folders, **fresh, **merged}, base.schema or json.loads(new.schema.json()), writers)
            if self._commit(base, after):
                for name in met:
                    files.delete(self.spark, f"{self.path}/{fresh[name]}")
                return True
            for folder in merged.values():
                files.delete(self.spark, f"{self.path}/{folder}")
            base = self.manifest()
            if writer is not None and base.writers.get(writer, -1) >= batch:
                return False

    def retire(self, kept: Callable[[str], bool]) -> int:
        """Drop whole buckets by name: a new manifest, no row is read. How many went."""
        while True:
            base = self.manifest()
            stay = {name: folder for name, folder in base.folders.items() if kept(name)}
            if len(stay) == len(base.folders) or self._commit(base, replace(base, folders=stay)):
                return len(base.folders) - len(stay)
