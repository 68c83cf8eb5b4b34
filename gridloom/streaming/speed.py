"""The speed layer: watermark, stateful deduplication, windows, lag and late rows, replays of recorded readings."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from gridloom.functions import rules
from gridloom.operators import rollups
from gridloom.sources.readings import with_partitions
from gridloom.streaming import sinks
from gridloom.types import SETTINGS, Settings


def deduplicated(valid: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Each (meter_id, event_ts) once; rows behind the watermark of the batch before are dropped."""
    return valid.withWatermark("event_ts", s.watermark).dropDuplicates(["meter_id", "event_ts"])


def zone_stream(readings: DataFrame, roster: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    """Validated, then deduplicated, then by zone and window: the order of the stream."""
    records = "kafka_timestamp" if "kafka_timestamp" in readings.columns else None
    return rollups.zone_windows(deduplicated(rules.split(readings, roster, s)[0], s), s, streaming=True, record_ts=records)


def household_stream(readings: DataFrame, roster: DataFrame, s: Settings = SETTINGS) -> DataFrame:
    return rollups.household_running(deduplicated(rules.split(readings, roster, s)[0], s))


def start(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str, mode: str = "update", trigger: dict | None = None, s: Settings = SETTINGS) -> StreamingQuery:
    """One independent query with its own checkpoint; changed aggregates need a new checkpoint folder."""
    return stream.writeStream.queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": s.trigger})).foreachBatch(sink).start()


def archive(readings: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Append readings to Parquet by sim_date and hour. The file sink commits a batch's files once."""
    writer = with_partitions(readings).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("sim_date", "hour").outputMode("append").trigger(**(trigger or {"processingTime": SETTINGS.trigger})).start()


def _offsets(text: str | None) -> dict[tuple[str, str], int]:
    """(topic, partition) to offset; nothing for a source that has not reported yet."""
    read = json.loads(text) if text and text != "None" else None
    return {(topic, part): n for topic, parts in (read or {}).items() for part, n in parts.items()}


def lag_by_partition(end: str | None, latest: str | None) -> dict[str, int]:
    """Records behind by topic partition, at least 0, of those partitions that both sides know."""
    done, top = _offsets(end), _offsets(latest)
    return {f"{topic}-{part}": max(0, top[topic, part] - done[topic, part]) for topic, part in sorted(top.keys() & done.keys())}


class LagListener(StreamingQueryListener):
    """The lag of each partition as of the last progress, the largest of all sources of the queries named, or of
    all queries."""

    def __init__(self, names: set[str] | None = None):
        self.names = names
        self.by_query: dict[str, list[dict[str, int]]] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        if self.names is None or event.progress.name in self.names:
            self.by_query[str(event.progress.id)] = [lag_by_partition(source.endOffset, source.latestOffset) for source in event.progress.sources]

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.by_query.pop(str(event.id), None)

    def lag(self) -> dict[str, int]:
        out: dict[str, int] = {}
        for sources in self.by_query.values():
            for parts in sources:
                out |= {k: max(out.get(k, 0), n) for k, n in parts.items()}
        return out


class ProgressListener(StreamingQueryListener):
    """Rows that the state operators of each query dropped behind the watermark, by batch, and their input."""

    def __init__(self):
        self.dropped: dict[tuple[str, int], int] = {}
        self.rows: dict[tuple[str, int], int] = {}

    def onQueryStarted(self, event):
        pass

    def onQueryProgress(self, event):
        progress = event.progress
        key = (str(progress.id), progress.batchId)  # the id stays over restarts, so a batch run again counts once
        self.rows[key] = max(self.rows.get(key, 0), progress.numInputRows)
        self.dropped[key] = max(self.dropped.get(key, 0), late_rows(progress))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        pass


def late_rows(progress) -> int:
    """Rows that a batch dropped behind the watermark."""
    return sum(operator.numRowsDroppedByWatermark for operator in progress.stateOperators)


STREAMS = {
    "windows": zone_stream,
    "running": household_stream,
    "dedup": lambda readings, roster: deduplicated(rules.split(readings, roster)[0]),
    "rejects": lambda readings, roster: readings,
}


def replay(spark: SparkSession, readings: DataFrame, roster: DataFrame, root: str, kind: str, arrival: str | None = None) -> tuple[DataFrame, int]:
    """readings as a file stream, run until all is read: the rows that the query of this kind leaves behind (windows,
    running, dedup or rejects), and how many readings it dropped as too late. With arrival, a column of whole numbers,
    readings come in that order, one micro-batch for each number, with a restart of the query in between."""
    source, out, late = f"{root}/source", f"{root}/out", 0
    order = [None] if arrival is None else sorted(r[0] for r in readings.select(arrival).distinct().collect())
    schema = readings.drop(*[arrival] if arrival else []).schema
    for number in order:
        now = readings if number is None else readings.where(F.col(arrival) == number).drop(arrival)
        now.write.parquet(f"{source}/arrived={number}")
        made = STREAMS[kind](spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(source), roster)
        if kind == "rejects":
            sink = sinks.validation_sink(out, roster, sinks.file_topic(f"{root}/topic"))
        else:
            sink = lambda batch, n: batch.withColumn("batch", F.lit(n)).write.mode("overwrite").parquet(f"{out}/part={n}")
        query = start(made, sink, f"{root}/checkpoint", f"replay_{kind}", "append" if kind in ("dedup", "rejects") else "update", {"availableNow": True})
        query.awaitTermination()
        late += sum(late_rows(progress) for progress in query.recentProgress)
    if kind == "rejects":
        return sinks.rejects(spark, out), late
    rows = spark.read.parquet(out)
    if kind == "dedup":
        return rows, late
    keys = ["grid_zone", "window_start"] if kind == "windows" else ["household_id", "sim_date"]
    rest = [c for c in rows.columns if c not in (*keys, "batch", "part")]
    return rows.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("m")).select(*keys, *[f"m.{c}" for c in rest]), late
