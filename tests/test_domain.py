"""Single operators on small frames with results worked out by hand."""

import datetime as dt
import random
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridloom.functions import rules
from gridloom.functions.tariff import bill, blocks, pct_divergence, renewable_ratio, slabs
from gridloom.operators import billing, ledger, reconcile, rollups, serving
from gridloom.sources import readings as log
from gridloom.sources import sinks
from gridloom.sources.tables import Table
from gridloom.streaming import sinks as streams
from gridloom.streaming import speed
from gridloom.streaming.speed import lag_by_partition
from gridloom.types import Settings

RATES = "billing_tier string, subsidy_flag boolean, subsidy_pct decimal(5,2), fixed_charge decimal(12,2), block_1_rate decimal(12,2), block_2_rate decimal(12,2), block_3_rate decimal(12,2), export_rate decimal(12,2)"


def rate(fixed="240.00", flag=False, first="8.00"):
    return ("TIER_1", flag, D("25.00"), D(fixed), D(first), D("16.50"), D("24.50"), D("18.00"))


@pytest.mark.parametrize(("kwh", "charge"), [("0", "0.00"), ("59.99", "479.92"), ("60", "480.00"), ("60.01", "480.17"), ("120", "1470.00"), ("200", "3430.00")])
def test_energy_charge_at_block_bounds(spark, kwh, charge):
    cols = slabs(F.lit(D(kwh)).cast("decimal(12,4)"), tuple(F.lit(D(r)).cast("decimal(12,2)") for r in ("8.00", "16.50", "24.50")))
    assert sum(spark.range(1).select(*[c for _, c in cols]).first()) == D(charge)


@pytest.mark.parametrize(
    ("use", "sun", "tariff", "energy", "subsidy", "credit", "total"),
    [
        ("60.0100", "0", rate(), "480.17", "0.00", "0.00", "720.17"), ("61.2345", "25.5", rate(flag=True), "285.88", "71.47", "0.00", "454.41"),
        ("4", "19", rate("120.00"), "0.00", "0.00", "270.00", "-150.00"), ("125", "0", rate("480.00"), "1592.50", "0.00", "0.00", "2072.50"), ("60.01", "0", rate(first="9.00"), "540.17", "0.00", "0.00", "780.17"),
    ],
)
def test_golden_bills(spark, use, sun, tariff, energy, subsidy, credit, total):
    df = spark.createDataFrame([(D(use), D(sun), *tariff)], "c decimal(12,4), s decimal(12,4), " + RATES)
    got = df.select(*[c.alias(n) for n, c in bill(F.col("c"), F.col("s")).items()]).first()
    assert (got.energy_charge, got.subsidy_amount, got.export_credit, got.total) == (D(energy), D(subsidy), D(credit), D(total))
    assert sum(t.charge for t in got.tier_breakdown) == got.energy_charge


def test_blocks_need_rising_bounds():
    assert [b[2] for b in blocks()] == [60, 120, None]
    with pytest.raises(ValueError):
        Settings(bounds=("120", "60"))
    with pytest.raises(ValueError):
        slabs(F.lit(1), (F.lit(1),))


def test_ratio_and_divergence_saturate(spark):
    got = spark.range(1).select(renewable_ratio(F.lit(D("14.3")), F.lit(D("1"))), renewable_ratio(F.lit(D("1")), F.lit(D("0"))), pct_divergence(F.lit(D("5000.00")), F.lit(D("1.00")), F.lit(D("0.00"))), pct_divergence(F.lit(D("4.00")), F.lit(D("72.00")), F.lit(D("240.00")))).first()
    assert list(got) == [D("1.0000"), D("0.0000"), D("999.999"), D("1.282")]


def reading(**other):
    base = {"event_id": "e", "meter_id": "m", "household_id": "HH-0001", "grid_zone": "ZONE-A", "event_ts": dt.datetime(2024, 1, 1), "consumption_kwh": D(1), "solar_generation_kwh": D(0), "voltage": 200.0}
    return tuple({**base, **other}.values())


def test_first_matching_reason_wins(spark):
    schema = "event_id string, meter_id string, household_id string, grid_zone string, event_ts timestamp, consumption_kwh decimal(12,4), solar_generation_kwh decimal(12,4), voltage double"
    rows = [reading(), reading(event_id="1", household_id=""), reading(event_id="2", consumption_kwh=D(-1), grid_zone="X"), reading(event_id="3", household_id="HH-9"), reading(event_id="4", grid_zone="X"), reading(event_id="5", event_ts=dt.datetime(1999, 1, 1)), reading(event_id="6", meter_id=None)]
    roster = spark.createDataFrame([("HH-0001",)], "household_id string")
    valid, rejected = rules.split(spark.createDataFrame(rows, schema), roster)
    assert [r.event_id for r in valid.collect()] == ["e"]
    assert {r.event_id: r.reason for r in rejected.collect()} == {"1": "null_field", "2": "negative_kwh", "3": "unknown_household", "4": "unknown_zone", "5": "event_ts_out_of_range", "6": "null_field"}
    assert "payload" in rejected.columns


def test_decode_keeps_what_it_cannot_parse(spark):
    df = log.decode(spark.createDataFrame([("{bad",), ('{"event_id": "a", "consumption_kwh": 1.5, "event_ts": "2024-01-01T00:00:00Z"}',)], "value string"))
    got = {r.raw_value[:4]: r for r in df.collect()}
    assert got["{bad"].event_id is None and got['{"ev'].consumption_kwh == D("1.5000")


def test_dedup_takes_the_earliest_even_if_it_is_invalid_later(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, "m", t, t + dt.timedelta(seconds=5), D(1)), (2, "m", t, t, D(9)), (3, "m", t, t, D(7)), (4, None, t, t, D(1))], "event_id long, meter_id string, event_ts timestamp, ingest_ts timestamp, consumption_kwh decimal(12,4)")
    assert sorted(r.event_id for r in billing.dedup_earliest(df).collect()) == [2, 4]


def estimates(spark, totals, tariffs):
    """Estimates, final bills and reconciliation of (household, day, kWh) under (household, day, fixed charge)."""
    day = lambda d: dt.date(2024, 1, d)
    rows = spark.createDataFrame([(h, day(d), D(k), D(0), 1) for h, d, k in totals], "household_id string, sim_date date, consumption_kwh decimal(12,4), solar_kwh decimal(12,4), readings_count long")
    held = spark.createDataFrame([(h, day(d), *rate(fixed)) for h, d, fixed in tariffs], "household_id string, effective_date date, " + RATES)
    return rows, held, billing.provisional_bills(rows, held)


def test_one_tariff_holds_for_estimates_and_reconciliation(spark):
    """A tariff of 2 January, a reading on the 3rd and later: bill, estimate and reconciliation, not nothing."""
    rows, held, speed_bills = estimates(spark, [("a", 3, "10"), ("a", 4, "10"), ("a", 6, "10")], [("a", 2, "1.00"), ("a", 5, "2.00")])
    got = {r.sim_date.day: (r.speed_estimate, r.batch_final, r.tariff_effect, r.data_effect) for r in reconcile.reconciliation(speed_bills, billing.daily_bills(rows, held), held).collect()}
    assert got == {3: (D("81.00"), D("81.00"), 0, 0), 4: (D("81.00"), D("81.00"), 0, 0), 6: (D("82.00"), D("82.00"), 0, 0)}
    rows, held, speed_bills = estimates(spark, [("a", 5, "10")], [("a", 2, "1.00"), ("a", 5, "2.00")])
    got = reconcile.reconciliation(speed_bills, billing.daily_bills(rows, held), held).first()
    assert (got.speed_estimate, got.batch_final, got.tariff_effect, got.data_effect, got.abs_divergence) == (D("81.00"), D("82.00"), D("-1.00"), D("0.00"), D("1.00"))


def test_reconciliation_without_a_tariff_is_loud(spark):
    rows, held, speed_bills = estimates(spark, [("a", 3, "10")], [("a", 2, "1.00")])
    bills = billing.daily_bills(rows, held)
    with pytest.raises(Exception, match="no tariff for a on 2024-01-03"):
        reconcile.reconciliation(speed_bills, bills, held.where("household_id = 'b'")).collect()
    twice = held.unionByName(held.withColumn("fixed_charge", F.lit(D("5.00")).cast("decimal(12,2)")))
    with pytest.raises(Exception, match="two tariffs for a on 2024-01-03"):
        reconcile.reconciliation(speed_bills, bills, twice).collect()
    with pytest.raises(Exception, match="two tariffs for a on 2024-01-03"):
        billing.provisional_bills(rows, twice).collect()
    assert not billing.provisional_bills(rows, held.where("household_id = 'b'")).count()


def test_layers_reconcile_as_their_bills_do(spark):
    """One pass over the readings gives what the two layers' own relations give, with copies, late and bad readings."""
    r = random.Random(3)
    at = lambda: dt.datetime(2024, 1, r.randint(1, 6), r.randint(0, 23), 30 * r.randint(0, 1))
    raw = []
    for k in range(400):
        t = at()
        raw.append((k, r.choice("mn"), r.choice(["a", "a", "b", ""]), "ZONE-A", t, D(r.randint(-1, 30)), D(r.randint(0, 9)), t + dt.timedelta(minutes=r.choice([0, 1, 5, 45]))))
    schema = "event_id long, meter_id string, household_id string, grid_zone string, event_ts timestamp, consumption_kwh decimal(12,4), solar_generation_kwh decimal(12,4), ingest_ts timestamp"
    marked = rules.with_reason(spark.createDataFrame(raw, schema), spark.createDataFrame([("a",), ("b",)], "household_id string"))
    held = spark.createDataFrame([(h, dt.date(2023, 12, 28) + dt.timedelta(days=d), *rate(f"{d}.00", h == "b", f"{8 + d}.00")) for h in "ab" for d in (0, 5, 7, 8)], "household_id string, effective_date date, " + RATES)
    batch = billing.household_daily(rules.accepted(rules.with_reason(billing.dedup_earliest(marked.drop("reason")), spark.createDataFrame([("a",), ("b",)], "household_id string"))))
    fast = billing.household_daily(billing.dedup_earliest(rules.accepted(marked)).where("ingest_ts <= event_ts + INTERVAL 30 MINUTES"))
    days = spark.createDataFrame([(dt.date(2024, 1, d),) for d in range(1, 7)], "sim_date date")
    want = reconcile.reconciliation(billing.provisional_bills(fast, held), billing.daily_bills(batch, held, days), held)
    every = spark.createDataFrame([("a",), ("b",)], "household_id string").crossJoin(days)
    priced = reconcile.priced_layers(billing.layered_totals(marked, "30 minutes", every), held)
    got = reconcile.reconciled_layers(priced)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 5
    bills = {(r.household_id, r.sim_date): r.final_bill for r in billing.daily_bills(batch, held, days).collect()}
    guesses = {(r.household_id, r.sim_date): r.estimated_bill for r in billing.provisional_bills(fast, held).collect()}
    closed = spark.createDataFrame([(dt.date(2024, 1, 2),), (dt.date(2024, 1, 5),)], "sim_date date")
    merged = {(r.household_id, r.sim_date): (r.total, r.provisional) for r in serving.merged_bills(priced, closed).collect()}
    assert merged == {k: (bills[k], False) if k[1].day in (2, 5) else (guesses[k], True) for k in bills if k[1].day in (2, 5) or k in guesses}
    alone = {(r.household_id, r.sim_date) for r in reconcile.unmatched(priced).where("side = 'batch_only'").collect()}
    assert alone == bills.keys() - guesses.keys()


def priced(spark, totals, tariffs):
    day = lambda d: dt.date(2024, 1, d)
    rows = spark.createDataFrame([(h, day(d), D(k), D(0), 1) for h, d, k in totals], "household_id string, sim_date date, consumption_kwh decimal(12,4), solar_kwh decimal(12,4), readings_count long")
    held = spark.createDataFrame([(h, day(d), *rate(fixed)) for h, d, fixed in tariffs], "household_id string, effective_date date, " + RATES)
    return {(r.household_id, r.sim_date.day): (r.final_bill, r.tariff_effective_date.day, r.readings_count) for r in billing.daily_bills(rows, held).collect()}


def test_bills_use_the_tariff_in_force(spark):
    got = priced(spark, [("a", 3, "10"), ("a", 5, "10"), ("b", 5, "0")], [("a", 1, "1.00"), ("a", 4, "2.00"), ("b", 2, "3.00"), ("a", 9, "999.00")])
    assert got[("a", 3)] == (D("81.00"), 1, 1) and got[("a", 5)] == (D("82.00"), 4, 1) and got[("b", 5)] == (D("3.00"), 2, 1)
    assert got[("b", 3)] == (D("3.00"), 2, 0) and got[("a", 9)] == (D("999.00"), 9, 0) and ("b", 1) not in got


def test_bills_fail_without_a_tariff_or_with_two(spark):
    with pytest.raises(Exception, match="no tariff for b on 2024-01-03"):
        priced(spark, [("a", 3, "1"), ("b", 3, "1")], [("a", 3, "1.00"), ("b", 4, "1.00")])
    with pytest.raises(Exception, match="two tariffs for a on 2024-01-02"):
        priced(spark, [("a", 3, "1")], [("a", 2, "1.00"), ("a", 2, "2.00")])


def test_zone_export_nets_by_household_day(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("ZONE-A", "h1", "m1", at(1), D("1.0"), D("0")), ("ZONE-A", "h1", "m1", at(12), D("0.2"), D("2.0")), ("ZONE-A", "h2", "m2", at(1), D("0.6"), D("0"))], "grid_zone string, household_id string, meter_id string, event_ts timestamp, consumption_kwh decimal(12,4), solar_generation_kwh decimal(12,4)")
    got = rollups.zone_daily(df).first()
    assert (got.total_export_kwh, got.total_consumption_kwh, got.active_meters) == (D("0.8000"), D("1.8000"), 2)
    assert got.peak_window_start == at(1)


def test_ledger_serves_the_successful_run(spark):
    t = dt.datetime(2024, 1, 1)
    events = [("r1", 0, "running"), ("r1", 1, "success"), ("r1", 3, "superseded"), ("r2", 2, "running"), ("r2", 4, "success"), ("r3", 5, "running"), ("r3", 6, "failed")]
    df = spark.createDataFrame([(r, t.date(), "batch", s, x, None, None, t) for r, s, x in events], "run_id string, sim_date date, layer string, seq int, status string, rows_in long, rows_out long, at timestamp")
    runs = ledger.ledger_state(df)
    assert {r.run_id: r.status for r in runs.collect()} == {"r1": "superseded", "r2": "success", "r3": "failed"}
    assert not ledger.double_success(runs).count()
    history = spark.createDataFrame([("r1", 1), ("r2", 2), ("r3", 3)], "run_id string, v int")
    assert [r.v for r in ledger.current(history, runs).collect()] == [2]


def test_lag_and_arguments():
    assert lag_by_partition('{"t": {"0": 5}}', '{"t": {"0": 9, "1": 2}}') == {"t-0": 4}
    assert lag_by_partition('{"t": {"0": 9}, "u": {"0": 1}}', '{"t": {"0": 5}, "u": {"0": 3}}') == {"t-0": 0, "u-0": 2}
    assert lag_by_partition(None, "{}") == lag_by_partition("None", '{"t": {"0": 9}}') == lag_by_partition('{"t": {"0": 9}}', "None") == {}
    with pytest.raises(ValueError):
        serving.history_minutes(0)


def test_tariff_csv_is_strict(spark, tmp_path):
    head = "household_id,effective_date,billing_tier,subsidy_flag,subsidy_pct,fixed_charge,block_1_rate,block_2_rate,block_3_rate,export_rate\n"
    good = tmp_path / "t.csv"
    good.write_text(head + "HH-1,2024-01-01,TIER_1,True,25.00,120.00,8.00,16.50,24.50,18.00\n")
    assert log.read_tariff(spark, str(good)).first().subsidy_flag is True
    bad = tmp_path / "b.csv"
    bad.write_text(head + "HH-1,2024-01-01,TIER_9,1,25.00,120.00,8.00,16.50,24.50,18.00\n")
    with pytest.raises(Exception, match="bad tariff row"):
        log.read_tariff(spark, str(bad)).collect()


def test_day_scan_prunes_partitions_and_columns(spark, tmp_path):
    df = spark.createDataFrame([(str(k), "m", dt.datetime(2024, 1, 1 + k), D(1), 200.0) for k in range(3)], "event_id string, meter_id string, event_ts timestamp, consumption_kwh decimal(12,4), voltage double")
    log.with_partitions(df).write.partitionBy("sim_date", "hour").parquet(str(tmp_path / "raw"))
    one = log.read_day(spark, str(tmp_path / "raw"), "2024-01-02")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 1 and "voltage" not in plan and "PartitionFilters: [isnotnull(sim_date" in plan


def test_a_published_day_changes_as_a_whole(spark, tmp_path):
    day, root = dt.date(2024, 1, 3), str(tmp_path / "tables")
    book = ledger.RunLedger(spark, str(tmp_path / "ledger"))
    rows = lambda n, d=day: spark.createDataFrame([(f"h{k}", d, n) for k in range(n)], "household_id string, sim_date date, bill int")
    now = lambda name: sorted((r.run_id, r.bill) for r in ledger.published(book, root, name).collect())
    assert not book.runs().count()
    ledger.publish_day(book, root, "r1", day, {"bills": rows(2), "rejects": rows(1)}, 10, "bills")
    assert now("bills") == [("r1", 2)] * 2 and now("rejects") == [("r1", 1)]
    with pytest.raises(Exception, match="rows of another day"):
        ledger.publish_day(book, root, "r2", day, {"bills": rows(3), "rejects": rows(1, dt.date(2024, 1, 4))}, 10, "bills")
    assert now("bills") == [("r1", 2)] * 2
    ledger.publish_day(book, root, "r3", day, {"bills": rows(4), "rejects": rows(2)}, 12, "bills")
    assert now("bills") == [("r3", 4)] * 4 and now("rejects") == [("r3", 2)] * 2
    assert {(r.run_id, r.status, r.rows_in, r.rows_out) for r in book.runs().collect()} == {("r1", "superseded", 10, 2), ("r2", "failed", 10, None), ("r3", "success", 12, 4)}
    assert not ledger.double_success(book.runs()).count()


def test_late_rows_restarts_and_rewritten_batches(spark, tmp_path):
    t = lambda h, m=0: dt.datetime(2024, 1, 1, h, m)
    schema = "meter_id string, household_id string, grid_zone string, event_ts timestamp, consumption_kwh decimal(12,4), solar_generation_kwh decimal(12,4)"
    put = lambda n, rows: spark.createDataFrame([("m", "HH-0001", "ZONE-A", at, D(k), D(0)) for at, k in rows], schema).write.parquet(f"{tmp_path}/in/{n}")
    roster = spark.createDataFrame([("HH-0001",)], "household_id string")
    table = Table(spark, f"{tmp_path}/view", ["grid_zone", "window_start"])

    def run():
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        speed.start(speed.zone_stream(stream, roster), streams.view_sink(table), f"{tmp_path}/check", "late", trigger={"availableNow": True}).awaitTermination()
        return {r.window_start: r.total_consumption_kwh for r in table.read().collect()}

    put(1, [(t(1), 1), (t(1), 1), (t(1, 5), 2)])
    assert run() == {t(1): D(3)}
    put(2, [(t(6), 4)])
    assert run() == {t(1): D(3), t(6): D(4)}
    put(3, [(t(1, 10), 9), (t(5, 50), 5)])  # after a restart: behind the watermark, and within it
    assert run() == {t(1): D(3), t(6): D(4), t(5, 45): D(5)}


def test_archived_days_are_compacted_in_place(spark, tmp_path):
    root = str(tmp_path / "archive")
    df = spark.range(40).selectExpr("id", "cast(id % 2 AS int) AS hour")
    df.repartition(8).write.partitionBy("hour").parquet(f"{root}/sim_date=2024-01-01")
    sinks.compact_day(spark, root, "2024-01-01")
    assert sorted(r.id for r in spark.read.parquet(root).collect()) == list(range(40))
    assert len(list((tmp_path / "archive" / "sim_date=2024-01-01" / "hour=0").glob("*.parquet"))) == 1
