"""Stored tables: changing blocks, applying plans, and the user-level scenarios."""

from __future__ import annotations

import uuid
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from mendline import BlockTable, HeaderLog, ResultLog, TableSync, clear_scratch, sales_schema, scratch
from mendline.operators.delta import apply_delta, block_delta
from mendline.plans.apply import apply_plan
from mendline.plans.plan import sync_plan
from mendline.sources.header_log import file_marks
from mendline.sources.synthetic import synthetic_sales
from mendline.sources.table import KEEP
from conftest import files_of, rows_of

END = datetime(2023, 7, 1)


@pytest.fixture
def generated(spark):
    return synthetic_sales(spark, END, rows=3_000).cache()


def actions(plan):
    return {row.action for row in plan.collect()}


def test_block_changes(table, sales):
    made = table()
    assert made.read().count() == 0 and made.headers().count() == 0
    made.append(sales((1, "2023-01", 1), (2, "2023-02", 2)))
    made.append(sales((1, "2023-01", 1)))
    made.append(sales())
    assert made.fetch("2023-01").count() == 2
    assert made.fetch("2023-09").count() == 0
    made.replace(sales((7, "2023-01", 7)))
    assert [r.sale_id for r in made.fetch("2023-01").collect()] == [7]
    made.replace(sales())
    assert made.read().count() == 2
    made.delete(["2023-01", "2023-09"])
    assert [r.sale_id for r in made.read().collect()] == [2]
    made.clear()
    assert made.read().count() == 0 and made.read().columns == sales().columns
    made.append(sales((3, "2023-03", 3)))
    assert made.read().count() == 1


def test_odd_period_names(table, sales):
    odd = ["a/b", "x=y", "50%", "2023", "", "2023-01-01"]
    rows = sales(*((i, p, i) for i, p in enumerate(odd)))
    made = table(rows)
    assert {r.period for r in made.headers().collect()} == set(odd)
    for name in odd:
        assert made.fetch(name).count() == 1
    results = apply_plan(sync_plan(TableSync(rows, made).source_headers(), made.headers()), rows, made)
    assert actions(results) == {"SKIP"}
    made.delete(["a/b", "50%", ""])
    assert {r.period for r in made.headers().collect()} == {"x=y", "2023", "2023-01-01"}


@pytest.mark.parametrize("stored", [False, True])
def test_sync_laws(table, generated, stored):
    target_rows = (
        generated.filter("month(sale_ts) <> 4 AND NOT (month(sale_ts) = 5 AND sale_id % 3 = 0)")
        .withColumn("amount", F.expr("CASE WHEN month(sale_ts) = 6 THEN amount + 1 ELSE amount END"))
        .withColumn("amount", F.col("amount").cast("decimal(18,2)"))
    )
    only_target = generated.filter("period = '2022-01'").withColumn("period", F.lit("2021-12"))
    target = table(target_rows.unionByName(only_target))
    sync = TableSync(table(generated) if stored else generated, target)
    expected = {
        "INSERT": {"2022-04", "2023-04"},
        "REPAIR": {"2022-05", "2022-06", "2023-05", "2023-06"},
    }
    untouched = files_of(target, "2022-01") + files_of(target, "2021-12")

    results = sync.synchronize()
    got = {r.period: r.action for r in results.collect()}
    assert len(got) == 18
    for action, periods in expected.items():
        assert {p for p, a in got.items() if a == action} == periods
    assert files_of(target, "2022-01") + files_of(target, "2021-12") == untouched
    assert rows_of(target.read()) == rows_of(generated.unionByName(only_target))

    before = files_of(target)
    again = sync.synchronize()
    assert actions(again) == {"SKIP"}
    assert files_of(target) == before
    assert sync.report(again).first().rows_processed == 3_000
    assert sync.status().first().state == "OUT_OF_SYNC"
    target.delete(["2021-12"])
    assert sync.status().first().state == "IN_SYNC"


def test_applying_a_plan_twice_changes_nothing(table, sales):
    source = sales((1, "2023-01", 1), (2, "2023-02", 2))
    target = table(sales((1, "2023-01", 5)))
    plan = sync_plan(TableSync(source, target).source_headers(), target.headers())
    stale = plan.sparkSession.createDataFrame(plan.collect(), plan.schema)
    for _ in range(2):
        apply_plan(stale, source, target)
        assert rows_of(target.read()) == rows_of(source)


def broken(source, *periods):
    boom = F.raise_error(F.lit("unreadable")).cast("decimal(18,2)")
    amount = F.when(F.col("period").isin(*periods), boom).otherwise(F.col("amount"))
    return source.withColumn("amount", amount)


def test_a_failed_block_does_not_stop_the_others(table, generated):
    target = table(generated.filter("period <> '2022-03'").withColumn(
        "amount", F.expr("CASE WHEN period = '2022-05' THEN amount + 1 ELSE amount END").cast("decimal(18,2)")
    ))
    plan = sync_plan(TableSync(generated, target).source_headers(), target.headers())
    old = rows_of(target.fetch("2022-05"))
    results = apply_plan(plan, broken(generated, "2022-05"), target, isolate=True)
    by_period = {r.period: r for r in results.collect()}
    failed = by_period["2022-05"]
    assert failed.failed and failed.action == "REPAIR" and failed.rows_inserted == 0
    assert failed.message.startswith("Error: ")
    assert by_period["2022-03"].rows_inserted > 0 and not by_period["2022-03"].failed
    assert rows_of(target.fetch("2022-05")) == old
    assert rows_of(target.fetch("2022-03")) == rows_of(generated.filter("period = '2022-03'"))
    report = TableSync(generated, target).report(results).first()
    assert (report.total_blocks, report.skipped, report.inserted, report.repaired) == (18, 16, 1, 0)


def test_all_or_nothing_without_isolation(table, generated):
    target = table()
    plan = sync_plan(TableSync(generated, target).source_headers(), target.headers())
    with pytest.raises(Exception, match="unreadable"):
        apply_plan(plan, broken(generated, "2022-05"), target)
    assert target.read().count() == 0


def test_scenarios(spark, table, generated):
    """Initial load, unchanged run, damage and repair, reset and load again."""
    sync = TableSync(table(generated), table())
    assert sync.status().first().state == "NEVER_SYNCED"
    first = sync.synchronize()
    assert actions(first) == {"INSERT"}
    assert sync.report(first).first().rows_inserted == 3_000
    assert sync.status().first().state == "IN_SYNC"

    assert actions(sync.synchronize()) == {"SKIP"}

    assert sync.perturb(2023, 3, current_year=2025) == "2023-03"
    assert sync.status().first().state == "PARTIALLY_SYNCED"
    states = {r.period: r.state for r in sync.compare().collect()}
    assert [p for p, s in states.items() if s == "CORRUPT"] == ["2023-03"]
    repaired = sync.synchronize()
    assert [r.period for r in repaired.collect() if r.action == "REPAIR"] == ["2023-03"]
    assert rows_of(sync.target.read()) == rows_of(generated)

    before = files_of(sync.target)
    sync.perturb(2024, 3, current_year=2025)
    assert files_of(sync.target) == before
    for year, month in ((2023, 0), (2023, 13), (2019, 5), (2026, 1)):
        with pytest.raises(ValueError):
            sync.perturb(year, month, current_year=2025)

    sync.reset()
    assert sync.status().first().state == "NEVER_SYNCED"
    assert actions(sync.synchronize()) == {"INSERT"}


def test_reset_restores_the_source(table, generated):
    sync = TableSync(table(generated.filter("sale_id < 10")), table())
    sync.reset(baseline=generated)
    assert rows_of(sync.source.read()) == rows_of(generated)
    with pytest.raises(TypeError):
        TableSync(generated, table()).reset(baseline=generated)


def test_reset_keeps_the_source_whole(table, generated):
    sync = TableSync(table(generated), table(generated))
    sync.reset(baseline=sync.source.read())
    assert rows_of(sync.source.read()) == rows_of(generated)
    sync.synchronize()
    with pytest.raises(Exception, match="unreadable"):
        sync.reset(baseline=broken(generated, "2022-05"))
    assert rows_of(sync.source.read()) == rows_of(sync.target.read()) == rows_of(generated)


def test_results_tell_what_is_in_the_target(table, sales):
    stored = sales((1, "2023-01", 1), (2, "2023-02", 2))
    target = table()
    plan = sync_plan(TableSync(stored, target).source_headers(), target.headers())
    changed = sales((1, "2023-01", 1), (2, "2023-01", 2))  # after the plan, before the copy
    results = {r.period: r for r in apply_plan(plan, changed, target).collect()}
    assert results["2023-01"].failed and results["2023-02"].failed
    assert [r.rows_inserted for r in results.values()] == [0, 0]
    assert all(r.message.startswith("Error: ") for r in results.values())


def test_the_whole_text_of_an_error_is_kept(table, sales):
    rows = sales((1, "2023-01", 1), (2, "2023-02", 2))
    boom = F.raise_error(F.lit("first line\nsecond line")).cast("decimal(18,2)")
    bad = rows.withColumn("amount", F.when(F.col("period") == "2023-01", boom).otherwise(F.col("amount")))
    target = table()
    plan = sync_plan(TableSync(rows, target).source_headers(), target.headers())
    results = {r.period: r for r in apply_plan(plan, bad, target, isolate=True).collect()}
    assert "second line" in results["2023-01"].message
    assert not results["2023-02"].failed and results["2023-02"].rows_inserted == 1


@pytest.mark.parametrize("good", [0, 20])
def test_isolation_gives_up_when_block_after_block_fails(monkeypatch, table, sales, good):
    """A source that fails past its first row costs a bounded number of jobs; many bad blocks do not hide as many good ones."""
    rows = sales(*((i, f"{2000 + i // 12}-{i % 12 + 1:02d}", i) for i in range(40)))
    boom = F.raise_error(F.lit("disk 7 is gone")).cast("decimal(18,2)")
    bad = rows.withColumn("amount", F.when(F.col("sale_id") < 40 - good, boom).otherwise(F.col("amount")))
    target, calls = table(), []
    plan = sync_plan(TableSync(rows, target).source_headers(), target.headers())
    replace = target.replace
    monkeypatch.setattr(target, "replace", lambda *args: (calls.append(1), replace(*args)))
    if good:
        results = apply_plan(plan, bad, target, isolate=True)
        assert results.where("NOT failed").count() == good == target.read().count()
    else:
        with pytest.raises(RuntimeError, match="none was copied.*disk"):
            apply_plan(plan, bad, target, isolate=True)
        assert len(calls) < 25 and target.read().isEmpty()


def test_isolation_stops_at_once_when_the_source_is_down(table, sales):
    rows = sales((1, "2023-01", 1), (2, "2023-02", 2))
    down = rows.where(F.raise_error(F.lit("no connection")).cast("boolean"))
    target = table()
    plan = sync_plan(TableSync(rows, target).source_headers(), target.headers())
    with pytest.raises(Exception, match="no connection"):
        apply_plan(plan, down, target, isolate=True)


def test_diagnostics(table, generated):
    sync = TableSync(generated, table(generated.filter("period >= '2023'")))
    row = sync.diagnostics().first()
    assert (row.source.total_rows, row.source.total_blocks) == (3_000, 18)
    assert row.target.total_blocks == 6
    assert len(row.source_top) == 10 and len(row.target_top) == 6
    counts = [b.row_count for b in row.source_top]
    assert counts == sorted(counts, reverse=True)
    headers = {r.period: r.block_hash for r in sync.source_headers().collect()}
    assert all(headers[b.period] == b.block_hash for b in row.source_top)
    assert len({s.sale_id for s in row.sample}) == 10
    assert row.summary.startswith("Source holds 3,000 rows in 18 blocks, target holds ")


def test_header_log_reads_changed_blocks_only(spark, table, sales, tmp_path, generated):
    made = table(generated)
    log = HeaderLog(spark, str(tmp_path / "log"))
    assert rows_of(log.headers(made)) == rows_of(made.headers())
    logged = log._log.read().count()
    assert logged == 18
    assert rows_of(log.headers(made)) == rows_of(made.headers())
    assert log._log.read().count() == logged

    made.replace(sales((1, "2022-02", 5)))
    made.append(sales((2, "2022-03", 6), (3, "2030-01", 7)))
    made.delete(["2022-04"])
    assert rows_of(log.headers(made)) == rows_of(made.headers())
    assert log._log.read().count() == logged + 3

    sync = TableSync(made, table(), header_log=log)
    assert actions(sync.synchronize()) == {"INSERT"}
    assert actions(sync.synchronize()) == {"SKIP"}
    assert rows_of(sync.target_headers()) == rows_of(sync.target.headers())


def test_header_log_does_not_read_unchanged_files(spark, table, tmp_path, generated):
    made = table(generated)
    log = HeaderLog(spark, str(tmp_path / "log"))
    expected = rows_of(log.headers(made))
    # Spoil the data but keep names, lengths and times: only a reader would notice.
    import os
    from pathlib import Path

    for file in Path(made.path).rglob("*.parquet"):
        stat = file.stat()
        file.write_bytes(b"\0" * stat.st_size)
        os.utime(file, ns=(stat.st_atime_ns, stat.st_mtime_ns))
    assert rows_of(log.headers(made)) == expected


def test_many_large_files_share_a_listing_task(spark, table, generated):
    made = table(generated)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert made.read().rdd.getNumPartitions() >= 18
        assert file_marks(made).count() == 18
        assert spark.conf.get("spark.sql.files.maxPartitionBytes") == "1k"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_text_ids(spark, tmp_path):
    """Ids may be texts, such as GUIDs."""
    schema = sales_schema(StringType())
    rows = spark.createDataFrame(
        [(str(uuid.UUID(int=i)), 1, datetime(2023, 1 + i % 2, 2), "c", "p", Decimal(i), f"2023-0{1 + i % 2}")
         for i in range(40)],
        schema,
    )
    target = BlockTable(spark, str(tmp_path / "text-ids"), schema)
    sync = TableSync(rows, target)
    assert actions(sync.synchronize()) == {"INSERT"}
    sync.perturb(2023, 1, current_year=2025)
    assert [r.period for r in sync.synchronize().collect() if r.action == "REPAIR"] == ["2023-01"]
    row = sync.diagnostics(sample=3).first()
    assert row.source.first_id == str(uuid.UUID(int=0)) and len(row.sample) == 3
    assert target.info().first().asDict() == {
        "rows": 40, "blocks": 2, "periods": ["2023-01", "2023-02"],
    }


def test_keep_layout_writes_without_a_shuffle(spark, table, generated):
    source = table(generated)
    target = table()
    target.replace(source.fetch("2022-02", "2022-03"), KEEP)
    assert target.read().count() == source.fetch("2022-02", "2022-03").count()
    with pytest.raises(ValueError):
        target.replace(generated, "other")


def test_table_reads_what_it_wrote(spark, table, generated):
    made = table(generated)
    assert rows_of(BlockTable(spark, made.path + "/").read()) == rows_of(generated)


def test_delta_makes_the_block_equal(sales):
    source = sales((1, "2023-01", 1), (1, "2023-01", 1), (2, "2023-01", 2, None), (3, "2023-01", 3))
    target = sales((1, "2023-01", 1), (2, "2023-01", 2, None), (3, "2023-01", 4), (3, "2023-01", 4), (5, "2023-01", 5))
    found = block_delta(source, target)
    assert sorted((r.sale_id, float(r.amount), r.copies) for r in found.collect()) == [
        (1, 1.0, 1), (3, 3.0, 1), (3, 4.0, -2), (5, 5.0, -1),
    ]
    assert rows_of(apply_delta(target, found)) == rows_of(source)
    assert block_delta(source, source).isEmpty() and block_delta(sales(), sales()).isEmpty()
    assert rows_of(apply_delta(sales(), block_delta(source, sales()))) == rows_of(source)


def test_result_log(spark, table, sales, tmp_path):
    source, log = table(sales((1, "2023-01", 1), (2, "2023-02", 2))), ResultLog(spark, str(tmp_path / "log"))
    sync = TableSync(source, table())
    for run in (7, 8):
        log.record(run, sync.synchronize())
    source.append(sales((3, "2023-02", 3)))
    log.record(10, sync.synchronize())
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        log.record(10, sync.synchronize())
    assert log.read().groupBy("run").count().count() == 3
    assert sorted(map(tuple, log.last_copies().collect())) == [("2023-01", 7, 1), ("2023-02", 10, 2)]


def test_scratch_is_cleared(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(scratch, "scratch_root", lambda spark: str(tmp_path))
    (tmp_path / "other").mkdir()
    for _ in range(2):
        assert scratch.materialise(spark.range(3), "some").count() == 3
        clear_scratch(spark)
        assert [p.name for p in tmp_path.iterdir()] == ["other"]
    clear_scratch(spark)


def test_isolation_sends_no_tables_to_the_driver(monkeypatch, table, generated):
    """Nor are all blocks tried a second time; the settings are as before afterwards."""
    target, calls, name = table(), [], "spark.sql.autoBroadcastJoinThreshold"
    plan, conf, replace = sync_plan(TableSync(generated, target).source_headers(), target.headers()), target.spark.conf, target.replace
    before = conf.get(name)
    counted = lambda rows, layout: (calls.append((conf.get(name), rows.count() if calls else None)), replace(rows, layout))
    monkeypatch.setattr(target, "replace", counted)
    results = apply_plan(plan, broken(generated, "2022-05"), target, isolate=True)
    assert [r.period for r in results.where("failed").collect()] == ["2022-05"]
    assert calls[0][0] == before == conf.get(name) and {c for c, _ in calls[1:]} == {"-1"}
    assert max(n for _, n in calls[1:]) < generated.count()
