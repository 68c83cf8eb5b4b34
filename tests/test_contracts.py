"""Reference files, contracts, settings, reports: what is read and refused, and what they say about it."""

import datetime as dt
import json
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridloom import types
from gridloom.functions import rules
from gridloom.functions.tariff import tier_json, tier_lines
from gridloom.operators import alerts, ledger, rollups, serving
from gridloom.sources import files
from gridloom.sources import readings as log
from gridloom.sources.readings import Layout
from gridloom.types import Settings

HEAD = "household_id,effective_date,billing_tier,subsidy_flag,subsidy_pct,fixed_charge,block_1_rate,block_2_rate,block_3_rate,export_rate"
GOOD = "HH-1,2024-01-01,TIER_1,True,25.00,120.00,8.00,16.50,24.50,18.00"


def test_tariff_files_and_bytes_give_typed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(f"{HEAD}\r\n{GOOD}\r\n\r\n")
    (tmp_path / "b.csv").write_text(f"﻿{HEAD}\n" + GOOD.replace("HH-1", '"HH,2"').replace("True", "0"))
    got = {r.household_id: r for r in log.read_tariff(spark, f"{tmp_path}/a.csv", f"{tmp_path}/b.csv").collect()}
    assert got["HH-1"].subsidy_flag is True and got["HH,2"].subsidy_flag is False
    assert got["HH-1"].block_2_rate == D("16.50") and got["HH-1"].effective_date == dt.date(2024, 1, 1)
    assert log.tariff_of(spark, f"{HEAD}\n{GOOD}\n".encode()).schema == log.read_tariff(spark, f"{tmp_path}/a.csv").schema
    assert not log.tariff_of(spark, HEAD.encode()).count()


@pytest.mark.parametrize(
    ("text", "message"),
    [
        (f"{HEAD}\n{GOOD}\n{GOOD.replace('TIER_1', 'TIER_9')}", r"x\.csv line 3: billing_tier is TIER_9"),
        (f"{HEAD}\n{GOOD.replace('8.00', '-8.00')}", r"line 2: block_1_rate is -8.00"),
        (f"{HEAD}\n{GOOD.replace('8.00', '8.001')}", r"line 2: block_1_rate is 8.001"),
        (f"{HEAD}\n{GOOD.replace('25.00', '101')}", r"line 2: subsidy_pct is 101"),
        (f"{HEAD}\n{GOOD.replace('True', 'yes')}", r"line 2: subsidy_flag is yes"),
        (f"{HEAD}\n{GOOD.replace('2024-01-01', '2024-13-01')}", r"line 2: effective_date is 2024-13-01"),
        (f"{HEAD}\n\n{GOOD},1", r"line 3: fields are not as many"),
        (f"{HEAD}\n{GOOD.rpartition(',')[0]}", r"line 2: fields are not as many"),
        (f"{HEAD}\n{GOOD.replace('HH-1', '')}", r"line 2: household_id is"),
        (f"{HEAD.replace('block_1_rate,block_2_rate', 'block_2_rate,block_1_rate')}\n{GOOD}", r"line 1: header is"),
        (GOOD, r"line 1: header is"),
    ],
)
def test_a_bad_row_is_named_with_file_and_line(spark, tmp_path, text, message):
    (tmp_path / "x.csv").write_text(text)
    with pytest.raises(Exception, match=message):
        log.read_tariff(spark, f"{tmp_path}/x.csv").collect()
    with pytest.raises(Exception, match=message.replace(r"x\.csv", "from bytes")):
        log.tariff_of(spark, text.encode(), "from bytes").collect()


def test_pending_days_come_from_names_alone(spark, tmp_path):
    layout = Layout(str(tmp_path))
    for day in ("2024-01-01", "2024-01-02", "2024-01-04"):
        files.put(spark, layout.landing("tariff", day), b"not a tariff")
    files.put(spark, f"{tmp_path}/landing/tariff/tariff_2024-01-03.csv.tmp", b"")
    for day in ("2024-01-02", "2024-01-03", "2024-01-04"):
        files.put(spark, f"{layout.raw(day, 5)}/part-0.parquet", b"not a table")
    got = log.pending_days(spark, layout)
    assert [r.sim_date.day for r in got.collect()] == [2, 4]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "Parquet" not in plan
    assert not log.pending_days(spark, Layout(f"{tmp_path}/nowhere")).count()


def test_a_rollup_retires_windows_of_two_weeks_ago_if_it_succeeds(spark, tmp_path):
    day = dt.date(2024, 1, 20)
    windows = rollups.window_table(spark, f"{tmp_path}/windows")
    windows.upsert(spark.createDataFrame([("ZONE-A", dt.datetime(2024, 1, d, h), h) for d in range(1, 22) for h in (0, 23)], "grid_zone string, window_start timestamp, v int"))
    book = ledger.RunLedger(spark, f"{tmp_path}/ledger")
    rows = lambda kwh, d=day: spark.createDataFrame([("ZONE-A", d, kwh)], "grid_zone string, sim_date date, kwh int")
    with pytest.raises(Exception, match="rows of another day"):
        rollups.publish_rollup(book, str(tmp_path), {day: "r0"}, rows(9, dt.date(2024, 1, 19)), windows)
    assert windows.read().count() == 42 and [r.status for r in book.runs().collect()] == ["failed"]
    assert rollups.publish_rollup(book, str(tmp_path), {day: "r1"}, rows(1), windows) == 5
    kept = [r.window_start for r in windows.read().collect()]
    assert min(kept) == dt.datetime(2024, 1, 6) and len(kept) == 32
    assert rollups.publish_rollup(book, str(tmp_path), {day: "r2"}, rows(2), windows) == 0
    assert [(r.run_id, r.kwh) for r in ledger.published(book, str(tmp_path), "zone_days").collect()] == [("r2", 2)]
    assert not ledger.finalised_days(book.runs()).count()  # a rollup closes no bills


def test_contracts_are_as_recorded():
    from pathlib import Path

    for name in types.CONTRACTS:
        recorded = Path(types.__file__).parent / "contracts" / f"{name}.json"
        assert recorded.read_text() == types.contract_text(name), f"{name} has changed: record it anew if that is meant"


def test_settings_come_in_layers(tmp_path):
    (tmp_path / "base.toml").write_text('window = "5 minutes"\nreject_rate = 0.1\nbounds = ["50", "100"]\n')
    (tmp_path / "site.toml").write_text('window = "10 minutes"\nvoltage = [200, 250]\n')
    got = Settings.load(f"{tmp_path}/base.toml", f"{tmp_path}/site.toml", environ={"GRIDLOOM_REJECT_RATE": "1", "GRIDLOOM_TRIGGER": "1 second", "PATH": "x"})
    assert (got.window, got.reject_rate, got.bounds, got.voltage, got.trigger) == ("10 minutes", 1.0, ("50", "100"), (200.0, 250.0), "1 second")
    for bad in ({"windwo": "1 minute"}, {"bounds": ["100", "50"]}, {"time_scale": "fast"}):
        with pytest.raises(ValueError):
            Settings.layered(bad)
    assert Settings.layered() == Settings()


def test_a_rule_without_a_meaning_is_refused(monkeypatch, spark):
    monkeypatch.delitem(rules.REASONS, "unknown_zone")
    with pytest.raises(RuntimeError, match="unknown_zone"):
        rules.rules(F.lit(True))


def test_only_active_alerts_are_told(spark):
    one = lambda state, **labels: {"status": {"state": state}, "labels": labels, "annotations": {"summary": "s"}, "startsAt": "2024-01-01T00:00:00Z"}
    rows = [(json.dumps([one("active", alertname="MeterDataStale", severity="page"), one("suppressed", alertname="x")]),), (json.dumps([one("resolved"), one("active")]),), ("no list",), (None,)]
    got = alerts.firing(spark.createDataFrame(rows, "payload string")).collect()
    assert sorted((r.name, r.severity, r.summary) for r in got) == [("MeterDataStale", "page", "s"), ("unknown", "unknown", "s")]


def test_open_bounds_stay_in_the_breakdown(spark):
    rates = tuple(F.lit(D(r)).cast("decimal(12,2)") for r in ("8.00", "16.50", "24.50"))
    lines = json.loads(spark.range(1).select(tier_json(tier_lines(F.lit(D("70")).cast("decimal(12,4)"), rates))).first()[0])
    assert [x["up_to_kwh"] for x in lines] == [60, 120, None] and [x["kwh"] for x in lines] == [60, 10, 0]


def test_the_report_tells_what_is_missing():
    text = serving.render_report("2024-01-01", {"finalised": False}, [], [], [])
    assert "provisional" in text and all(x in text for x in ("No zone rows", "No final bills", "Not reconciled", "None recorded"))
    full = {"finalised": True, "restated": True, "has_bills": True, "has_rollup": True, "has_reconciliation": True, "bills": 12000, "billed": None}
    text = serving.render_report("2024-01-01", full, [{"zone": "A", "kwh": D("1.5")}], [{"reason": "null_field", "n": 3}], [{"run": "r1", "status": "superseded"}])
    assert "State: final" in text and "restated" in text and "| 12,000 | — |" in text and "| null_field | 3 |" in text and "| A | 1.5 |" in text
