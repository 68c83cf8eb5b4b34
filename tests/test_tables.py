"""Keyed tables, files, the ledger's commits, archives: what is written, and what happens when two write or one fails."""

import datetime as dt
import threading
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from gridloom.operators import ledger
from gridloom.sources import files, sinks
from gridloom.sources.tables import Table, latest, upsert


def test_small_files(spark, tmp_path):
    path = f"{tmp_path}/a/b.txt"
    assert not files.exists(spark, path) and files.names(spark, f"{tmp_path}/a") == []
    assert files.put_new(spark, path, b"one") and not files.put_new(spark, path, b"two")
    assert files.get(spark, path) == b"one" and files.names(spark, f"{tmp_path}/a") == ["b.txt"]
    files.put(spark, path, "zwei é".encode())
    assert files.get(spark, path).decode() == "zwei é"
    files.delete(spark, path)
    with pytest.raises(FileNotFoundError):
        files.get(spark, path)


def test_of_many_writers_of_one_name_one_is_first(spark, tmp_path):
    for k in range(15):
        path, won, ready = f"{tmp_path}/w/{k}.json", [], threading.Barrier(8)

        def write(n, path=path, won=won, ready=ready):
            ready.wait(60)
            if files.put_new(spark, path, f"writer {n} ".encode() * (n + 1)):
                won.append(n)

        threads = [threading.Thread(target=write, args=(n,)) for n in range(8)]
        [t.start() for t in threads]
        [t.join(60) for t in threads]
        assert len(won) == 1 and files.get(spark, path).decode() == f"writer {won[0]} " * (won[0] + 1)
        assert spark.read.text(path).count() == 1
    # a checksum file would be published in a step of its own, so that readers and the other writers see a half
    assert sorted(p.name for p in (tmp_path / "w").iterdir()) == sorted(f"{k}.json" for k in range(15))


def frame(spark, rows):
    return spark.createDataFrame(rows, "zone string, at timestamp, v int")


def stored(table):
    return sorted(((r.zone, r.at, r.v) for r in table.read().collect()), key=str)


def test_a_batch_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    day = lambda d, h=0: dt.datetime(2024, 1, 1, h) + dt.timedelta(days=d)
    table = Table(spark, f"{tmp_path}/t", ["zone", "at"], F.to_date("at"))
    table.upsert(frame(spark, [(z, day(d, h), 0) for d in range(100) for z in "ab" for h in (0, 12)]))
    before = table.manifest()
    table.upsert(frame(spark, [("a", day(7), 1), ("c", day(7), 1), ("a", day(7, 12), 1)]))
    after = table.manifest()
    assert len(before.folders) == 100 and [k for k in after.folders if after.folders[k] != before.folders[k]] == ["2024-01-08"]
    got = stored(table)
    assert len(got) == 401 and [x for x in got if x[2]] == [("a", day(7), 1), ("a", day(7, 12), 1), ("c", day(7), 1)]
    assert table.read(lambda name: name >= "2024-04-01").count() == 4 * 9
    # retiring reads nothing: folders are left out, and the version before still reads
    assert table.retire(lambda name: name >= "2024-04-01") == 91 and table.read().count() == 36
    assert table.read(version=after).count() == 401


def test_two_writers_lose_no_rows(spark, tmp_path, monkeypatch):
    at = dt.datetime(2024, 1, 1)
    make = lambda: Table(spark, f"{tmp_path}/t", ["zone", "at"], F.col("zone"))
    make().upsert(frame(spark, [("x", at, 0), ("y", at, 0)]))
    both = threading.Barrier(2)
    first = threading.local()
    manifest = Table.manifest

    def together(self):
        out = manifest(self)
        if not getattr(first, "met", False):
            first.met = True
            both.wait(60)  # both start from one version
        return out

    monkeypatch.setattr(Table, "manifest", together)
    rows = ([("x", at, 1), ("p", at, 1)], [("x", at + dt.timedelta(1), 2), ("y", at, 2)])
    threads = [threading.Thread(target=lambda r=r: make().upsert(frame(spark, r))) for r in rows]
    [t.start() for t in threads]
    [t.join(120) for t in threads]
    monkeypatch.undo()
    assert stored(make()) == sorted([("x", at, 1), ("p", at, 1), ("x", at + dt.timedelta(1), 2), ("y", at, 2)], key=str)
    assert make().manifest().version == 2


def test_batches_count_once_and_keys_may_be_null(spark, tmp_path):
    at = dt.datetime(2024, 1, 1)
    table = Table(spark, f"{tmp_path}/t", ["zone", "at"], F.col("zone"))
    with pytest.raises(FileNotFoundError):
        table.read()
    table.upsert(frame(spark, []))
    assert not table.read().count()
    table.upsert(frame(spark, [(None, at, 1), ("a/b =", at, 1)]), "q", 4)
    table.upsert(frame(spark, [(None, at, 9)]), "q", 4)
    table.upsert(frame(spark, [(None, at, 2), ("a/b =", None, 3)]), "q", 5)
    assert stored(table) == sorted([(None, at, 2), ("a/b =", at, 1), ("a/b =", None, 3)], key=str)
    with pytest.raises(ValueError, match="other columns"):
        table.upsert(frame(spark, [("a", at, 1)]).withColumn("w", F.lit(1)))


def test_one_row_of_each_key_stays(spark):
    rows = [("a", dt.datetime(2024, 1, 1, h), h) for h in (3, 9, 1)] + [("b", None, 5)]
    df = frame(spark, rows)
    assert sorted((r.zone, r.v) for r in latest(df, ["zone"], F.col("at")).collect()) == [("a", 9), ("b", 5)]
    assert latest(df, ["zone"]).collect() == latest(df.repartition(3), ["zone"]).collect()
    old = frame(spark, [("a", None, 0), ("c", None, 0)])
    assert sorted((r.zone, r.v) for r in upsert(old, df, ["zone"], F.col("at")).collect()) == [("a", 9), ("b", 5), ("c", 0)]


def test_two_runs_that_end_together_leave_one_success(spark, tmp_path):
    day = dt.date(2024, 1, 3)
    book = lambda: ledger.RunLedger(spark, f"{tmp_path}/ledger")
    for run in ("r1", "r2"):
        book().start(run, day)
    threads = [threading.Thread(target=lambda r=r: book().succeed(r, day, 1, 1)) for r in ("r1", "r2")]
    [t.start() for t in threads]
    [t.join(60) for t in threads]
    runs = book().runs()
    assert sorted(r.status for r in runs.collect()) == ["success", "superseded"] and not ledger.double_success(runs).count()


def test_an_abandoned_run_fails_when_the_next_one_starts(spark, tmp_path):
    day = dt.date(2024, 1, 3)
    book = ledger.RunLedger(spark, f"{tmp_path}/ledger")
    book.start("r1", day)
    book.start("x1", day, "rollup")
    book.start("y1", dt.date(2024, 1, 4))
    book.start("r2", day)
    assert {r.run_id: r.status for r in book.runs().collect()} == {"r1": "failed", "x1": "running", "y1": "running", "r2": "running"}


def test_an_interrupt_ends_the_run(spark, tmp_path, monkeypatch):
    day = dt.date(2024, 1, 3)
    book = ledger.RunLedger(spark, f"{tmp_path}/ledger")
    monkeypatch.setattr(ledger, "_of_days", lambda *_: (_ for _ in ()).throw(KeyboardInterrupt()))
    with pytest.raises(KeyboardInterrupt):
        ledger.publish_day(book, f"{tmp_path}/t", "r1", day, {"bills": spark.createDataFrame([(day,)], "sim_date date")}, 1, "bills")
    assert [r.status for r in book.runs().collect()] == ["failed"]


def test_a_restated_day_is_priced_again_from_both_archives(spark, tmp_path):
    root, terms = str(tmp_path), "household_id string, block_1_rate decimal(12,2)"
    sinks.archive_tariff(spark.createDataFrame([("h", D("8.10"))], terms), root, "2024-01-03", "r1")
    sinks.archive_tariff(spark.createDataFrame([("h", D("9.10"))], terms), root, "2024-01-03", "r2")
    assert [sinks.archived_tariff(spark, root, "2024-01-03", run).first().block_1_rate for run in ("r1", "r2")] == [D("8.10"), D("9.10")]
    assert {(r.run_id, r.sim_date, r.block_1_rate) for r in sinks.archived_tariffs(spark, root).collect()} == {("r1", dt.date(2024, 1, 3), D("8.10")), ("r2", dt.date(2024, 1, 3), D("9.10"))}
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        sinks.archived_tariff(spark, root, "2024-01-03", "r3")


def test_a_day_is_replaced_and_others_refused(spark, tmp_path):
    rows = lambda n, d: spark.createDataFrame([(k, dt.date(2024, 1, d)) for k in range(n)], "k int, sim_date date")
    for n, d in ((3, 1), (2, 2), (5, 1)):
        sinks.replace_day(rows(n, d), f"{tmp_path}/t", f"2024-01-0{d}")
    assert {(r.sim_date.day, r["count"]) for r in spark.read.parquet(f"{tmp_path}/t").groupBy("sim_date").count().collect()} == {(1, 5), (2, 2)}
    with pytest.raises(ValueError):
        sinks.replace_day(rows(1, 3), f"{tmp_path}/t", "2024-01-01")


def test_a_broken_compaction_is_undone(spark, tmp_path, monkeypatch):
    root = f"{tmp_path}/archive"
    spark.range(40).selectExpr("id", "cast(id % 2 AS int) AS hour").repartition(8).write.partitionBy("hour").parquet(f"{root}/sim_date=2024-01-01")
    move, moves = files.move, []

    def breaks(spark, path, to):
        moves.append(to)
        if len(moves) == 2:
            raise OSError("gone")
        move(spark, path, to)

    monkeypatch.setattr(files, "move", breaks)
    with pytest.raises(OSError, match="gone"):
        sinks.compact_day(spark, root, "2024-01-01")
    monkeypatch.undo()
    assert not (tmp_path / "archive" / "sim_date=2024-01-01").exists()
    sinks.compact_day(spark, root, "2024-01-01", target_rows=10)
    assert sorted(r.id for r in spark.read.parquet(f"{root}/sim_date=2024-01-01").collect()) == list(range(40))
    assert not files.names(spark, f"{root}/_replaced") and len(list((tmp_path / "archive" / "sim_date=2024-01-01" / "hour=0").glob("*.parquet"))) == 2
