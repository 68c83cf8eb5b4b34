"""Streams over files: what their sinks write and measure, what happens when one fails, what comes too late."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridloom.functions import latency
from gridloom.sources import readings as log
from gridloom.sources.tables import Table
from gridloom.streaming import sinks, speed
from tests.test_domain import RATES, rate

T = lambda h, m=0, d=1: dt.datetime(2024, 1, d, h, m)
SCHEMA = "event_id string, meter_id string, household_id string, grid_zone string, event_ts timestamp, consumption_kwh decimal(12,4), solar_generation_kwh decimal(12,4), kafka_timestamp timestamp"


def put(spark, path, number, rows):
    """rows: (event_ts, kWh, household, record time)"""
    full = [(f"e{number}-{k}", "m", house, "ZONE-A", at, None if kwh is None else D(kwh), D(0), made) for k, (at, kwh, house, made) in enumerate(rows)]
    spark.createDataFrame(full, SCHEMA).coalesce(1).write.parquet(f"{path}/in/{number}")


def run(spark, path, made, sink, name):
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{path}/in")
    query = speed.start(made(stream), sink, f"{path}/check", name, trigger={"availableNow": True})
    query.awaitTermination()
    return query


@pytest.fixture
def roster(spark):
    return spark.createDataFrame([("HH-0001",), ("HH-0002",)], "household_id string")


def test_windows_are_written_with_their_latency(spark, tmp_path, roster):
    seen, now = sinks.BatchLog(), dt.datetime.now()
    table = Table(spark, f"{tmp_path}/view", ["grid_zone", "window_start"], F.to_date("window_start"))
    ago = lambda s: now - dt.timedelta(seconds=s)
    put(spark, tmp_path, 1, [(T(1), 1, "HH-0001", ago(100)), (T(1, 5), 2, "HH-0001", ago(40)), (T(2), 2, "HH-0001", None), (T(3), 2, "HH-0001", ago(-9999)), (T(4), 2, "HH-0001", ago(400))])
    run(spark, tmp_path, lambda s: speed.zone_stream(s, roster), sinks.zone_sink(table, seen), "zones")
    rows = {r.window_start: r for r in table.read().collect()}
    assert rows[T(1)].total_consumption_kwh == D(3) and sinks.NEWEST not in table.read().columns
    first = seen.of("zones")[0]
    assert (first["rows"], first["observed"]) == (4, 2) and first["ratios"] == {"ZONE-A": D("0.0000")}
    # the newest record of a window counts, and the time that writing took
    assert 40 <= first["p50"] < 40 + 60 and 400 <= first["p99"] < 400 + 60
    assert [x["rows"] for x in seen.of("zones")][1:] == [0] * (len(seen.of("zones")) - 1)


def test_a_batch_that_runs_again_counts_once(spark, tmp_path):
    seen = sinks.BatchLog()
    table = Table(spark, f"{tmp_path}/view", ["k"])
    sink = sinks.view_sink(table, seen)
    sink(spark.createDataFrame([("a", 1)], "k string, v int"), 0)
    sink(spark.createDataFrame([("a", 2), ("b", 2)], "k string, v int"), 0)
    sink(spark.createDataFrame([], "k string, v int"), 1)
    assert [(r.k, r.v) for r in table.read().collect()] == [("a", 1)] and seen.of("view") == [{"batch": 0, "rows": 1}, {"batch": 1, "rows": 0}]


def test_estimates_use_the_tariff_in_force_the_day_before(spark, tmp_path):
    seen = sinks.BatchLog()
    tariff = spark.createDataFrame([(h, dt.date(2024, 1, d), *rate(fixed)) for h, d, fixed in (("a", 1, "1.00"), ("a", 5, "2.00"), ("b", 5, "3.00"))], "household_id string, effective_date date, " + RATES)
    table = Table(spark, f"{tmp_path}/bills", ["household_id", "sim_date"], F.col("sim_date"))
    rows = [(h, dt.date(2024, 1, d), D(1), D(0)) for h, d in (("a", 1), ("a", 2), ("a", 5), ("a", 6), ("b", 5), ("b", 6), ("c", 6))]
    sinks.bill_sink(table, tariff, seen)(spark.createDataFrame(rows, "household_id string, sim_date date, consumption_kwh decimal(12,4), solar_kwh decimal(12,4)"), 0)
    got = {(r.household_id, r.sim_date.day): (r.estimated_bill, r.tariff_source_date.day) for r in table.read().collect()}
    assert got == {("a", 2): (D("9.00"), 1), ("a", 5): (D("9.00"), 4), ("a", 6): (D("10.00"), 5), ("b", 6): (D("11.00"), 5)}
    assert seen.of("bills") == [{"batch": 0, "rows": 7, "written": 4, "skipped": 3}]


def test_rejects_reach_both_places_and_accounts_add_up(spark, tmp_path, roster):
    topic, failures = sinks.file_topic(f"{tmp_path}/topic"), [True]

    def fails_once(records, batch_id):
        if batch_id == 0 and failures:
            failures.pop()
            raise OSError("the topic is away")
        topic(records, batch_id)

    log_ = sinks.BatchLog()
    sink = sinks.validation_sink(f"{tmp_path}/out", roster, fails_once, log_)
    put(spark, tmp_path, 1, [(T(1), 1, "HH-0001", None), (T(2), -1, "HH-0001", None), (T(3), None, "HH-0001", None), (T(4), 1, "HH-9999", None)])
    with pytest.raises(Exception, match="the topic is away"):
        run(spark, tmp_path, lambda s: s, sink, "checks")
    assert not (tmp_path / "out" / "accounts").exists()
    run(spark, tmp_path, lambda s: s, sink, "checks")
    put(spark, tmp_path, 2, [(T(5), 1, "HH-0002", None)])
    run(spark, tmp_path, lambda s: s, sink, "checks")
    rows = {r.batch: r for r in sinks.accounts(spark, f"{tmp_path}/out").collect()}
    assert {b: (r.rows_in, r.rows_out, r.rows_rejected) for b, r in rows.items()} == {0: (4, 1, 3), 1: (1, 1, 0)}
    assert rows[0].reasons == {"negative_kwh": 1, "null_field": 1, "unknown_household": 1}
    letters = sinks.rejects(spark, f"{tmp_path}/out")
    assert sorted(r.reason for r in letters.collect()) == ["negative_kwh", "null_field", "unknown_household"]
    sent = [json.loads(r.value) for r in spark.read.json(f"{tmp_path}/topic").collect()]
    assert sorted(r["reason"] for r in sent) == ["negative_kwh", "null_field", "unknown_household"]
    assert [x["rows_rejected"] for x in log_.of("speed")] == [3, 0]


def test_payload_is_the_records_text_where_it_was_kept(spark, roster):
    df = log.decode(spark.createDataFrame([("{bad",), ('{"event_id": "a", "consumption_kwh": -1}',)], "value string"))
    from gridloom.functions import rules

    assert sorted(r.payload for r in rules.split(df, roster)[1].collect()) == ['{"event_id": "a", "consumption_kwh": -1}', "{bad"]


def test_json_files_are_archived_by_day_and_hour(spark, tmp_path):
    lines = [{"event_id": str(k), "meter_id": "m", "household_id": "h", "grid_zone": "ZONE-A", "event_ts": f"2024-01-0{1 + k % 2}T0{k}:30:00Z", "consumption_kwh": 1.5} for k in range(4)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join(map(json.dumps, lines)))
    query = speed.archive(log.file_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/raw", f"{tmp_path}/check", {"availableNow": True})
    query.awaitTermination()
    day = log.read_day(spark, f"{tmp_path}/raw", "2024-01-02")
    assert sorted(r.event_id for r in day.collect()) == ["1", "3"] and "ingest_ts" in day.columns
    assert {(str(r.sim_date), r.hour) for r in spark.read.parquet(f"{tmp_path}/raw").select("sim_date", "hour").collect()} == {("2024-01-01", 0), ("2024-01-02", 1), ("2024-01-01", 2), ("2024-01-02", 3)}


def test_late_rows_are_counted_by_the_state_operator(spark, tmp_path, roster):
    listener = speed.ProgressListener()
    spark.streams.addListener(listener)
    rows = [(T(1), 0), (T(2), 0), (T(1, 59), 1), (T(5), 1), (T(4, 29), 2), (T(4, 31), 2), (T(4, 30), 2)]
    df = spark.createDataFrame([(f"e{k}", "m", "HH-0001", "ZONE-A", at, D(1), D(0), a) for k, (at, a) in enumerate(rows)], SCHEMA.replace("kafka_timestamp timestamp", "arrival int"))
    kept, late = speed.replay(spark, df, roster, str(tmp_path), "dedup", "arrival")
    assert late == 2 and sorted(r.event_id for r in kept.collect()) == ["e0", "e1", "e2", "e3", "e5"]
    spark.streams.removeListener(listener)


def expected_quantile(values, q):
    """A quantile from bucket counts, in plain Python."""
    le = [sum(v <= b for v in values) for b in latency.BOUNDS]
    rank = q * len(values)
    for k, n in enumerate(le):
        if n >= rank:
            low, below = (latency.BOUNDS[k - 1], le[k - 1]) if k else (0, 0)
            return low + (latency.BOUNDS[k] - low) * (rank - below) / (n - below)
    return latency.BOUNDS[-1]


def test_latency_quantiles_are_bounded_and_near(spark):
    values = [x / 7 for x in range(1, 700)] + [5000.0]
    now = dt.datetime(2024, 1, 1, 12)
    rows = [(now - dt.timedelta(microseconds=round(v * 1e6)),) for v in values] + [(None,), (now + dt.timedelta(seconds=1),)]
    seconds = spark.createDataFrame(rows, "at timestamp").select(latency.since(F.col("at"), F.lit(now)).alias("seconds"))
    got = latency.histogram(seconds).first()
    assert got.n == len(values) and got.le_0 == 3
    for q in (0.5, 0.95, 0.99):
        assert got[f"p{round(100 * q)}"] == pytest.approx(expected_quantile(values, q), abs=1e-4)
    assert latency.histogram(seconds.limit(0)).first().p50 is None
    assert latency.told(spark, None, 1.0)["p50"] is None


@pytest.mark.parametrize("mode, want", [("update", [1, 1]), ("complete", [1, 2]), ("append", [1, 0])])
def test_output_modes_and_a_timed_trigger(spark, tmp_path, mode, want):
    """What a second batch hands to the sink: changed rows, all rows, or only those behind the watermark."""
    got = {}
    put(spark, tmp_path, 1, [(T(1), 1, "HH-0001", None)])
    made = lambda s: s.withWatermark("event_ts", "1 hour").groupBy(F.window("event_ts", "15 minutes")).count()
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    sink = lambda batch, n: got.update({n: batch.count()})
    if mode == "append":
        stream = stream.withWatermark("event_ts", "1 hour")
        made = lambda s: s.select("event_ts")
    query = speed.start(made(stream), sink, f"{tmp_path}/check", f"modes_{mode}", mode, {"processingTime": "1 second"})
    query.processAllAvailable()
    put(spark, tmp_path, 2, [(T(2), 1, "HH-0001", None)] if mode != "append" else [])
    query.processAllAvailable()
    query.stop()
    assert speed.SETTINGS.trigger == "10 seconds" and [n for _, n in sorted(got.items())][:1] == want[:1]
    if mode != "append":
        assert max(got.values()) == want[1]
